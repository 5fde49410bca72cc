"""Words of many texts at once, in numpy: places and 64-bit hashes.

A word is a maximal run of bytes other than space and U+0009 to U+000D. Texts are laid one after the other with a
space between, so that no word crosses from one text to the next.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(1, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
BASE = int(_rng.integers(1, 1 << 63)) * 2 + 1
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Steps from one block of a word to the next.
BLOCK = _rng.integers(1, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: list[np.ndarray] = [_powers(BASE, 1 << 16), _powers(INVERSE, 1 << 16)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Return the first ``n`` powers of the hash's base and of its inverse modulo 2^64."""
    if len(_tables[0]) < n:
        size = 1 << (n - 1).bit_length()
        _tables[:] = [_powers(BASE, size), _powers(INVERSE, size)]
    return _tables[0][:n], _tables[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit hashes over all bits."""
    h = (h ^ (h >> np.uint64(31))) * MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of texts: ``data`` holds the bytes of all texts, words lie at ``start`` to ``end``."""

    raw: bytes
    data: np.ndarray
    text_start: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: Number of words before each text, and at last of all.
    first: np.ndarray

    def dictionary(self) -> tuple[np.ndarray, pa.Array]:
        """Return every word's number in a dictionary of these texts, and the dictionary: only equal words share a number."""
        size = self.end - self.start
        offsets = np.concatenate([[0], np.cumsum(size)])
        flat = ragged(self.data, self.start, size)
        words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
        return words.indices.to_numpy(), words.dictionary

    def codes(self) -> tuple[np.ndarray, list[bytes]]:
        """Return what ``dictionary`` does, the dictionary as a list."""
        code, words = self.dictionary()
        return code, words.to_numpy(zero_copy_only=False).tolist()

    def hashes(self) -> np.ndarray:
        """Return a 64-bit hash of every word; equal words have equal hashes. Different words may share one.

        A word is cut into blocks of eight bytes. Each block is mixed with its number in the word, and mixed again, before
        the sum: no polynomial, so words made of two repeated parts don't meet by rule.
        """
        size = self.end - self.start
        blocks = (size + 7) >> 3
        if not len(size):
            return np.zeros(0, dtype=np.uint64)
        edge = np.cumsum(blocks) - blocks
        number = np.arange(int(blocks.sum())) - np.repeat(edge, blocks)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        value = eights[np.repeat(self.start, blocks) + 8 * number]
        # The last block holds what is left of the word.
        last = edge + blocks - 1
        value[last] &= np.uint64((1 << 64) - 1) >> (8 * (8 * blocks - size)).astype(np.uint64)
        value = mixed(mixed(value) + (number + 1).astype(np.uint64) * BLOCK)
        return mixed(np.add.reduceat(value, edge) + size.astype(np.uint64))


def split_words(texts: list[bytes], space: np.ndarray = SPACE) -> Words:
    """Find the words of ``texts``; ``space`` tells of each byte whether it parts words (0x20 must)."""
    raw = b" " + b" ".join(texts) + b" "
    data = np.frombuffer(raw, dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    text_start = np.cumsum(lengths + 1) - lengths
    parts = space[data]
    edges = np.flatnonzero(parts[1:] != parts[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    first = np.append(np.searchsorted(start, text_start), len(start))
    return Words(raw, data, text_start, start, end, first)


def ragged(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Return ``pool[start : start + length]`` for every pair, one after the other."""
    stop = np.cumsum(length)
    total = int(stop[-1]) if len(stop) else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    place = np.arange(total, dtype=kind)
    place += np.repeat((start - (stop - length)).astype(kind), length)
    return pool.take(place)
