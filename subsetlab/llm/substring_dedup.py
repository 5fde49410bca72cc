"""Substring dedup on words by suffix automata.

The automaton of a set of word sequences accepts every sequence that occurs in one of them. Streaming a document
through it gives matching statistics: for each word, the longest sequence that ends there and occurs in the set.
Where it reaches the window length, the words of that window go.

One automaton of all earlier documents would be as large as the corpus, and sending each document to every shard of
it would cost shards times documents. So the reference is sharded by content (see ``anchors``): all blocks of windows
with the same anchor go to one shard, from documents and from what they are compared with alike. A shard takes its
blocks in the order of doc_id: each is streamed through the automaton of the smaller doc_ids, and joins it if the
automaton doesn't yet hold all its windows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from subsetlab.llm.anchors import Blocks, Entries, by_bucket, duplicate_spans, pieces, remove_spans
from subsetlab.llm.words import Words, mixed, split_words

_rng = np.random.Generator(np.random.PCG64(20240608))
FACTOR = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


#: Shares of a shard's anchors that are worked on one after the other, which bounds an automaton's memory.
SHARES = 16
#: Types of the columns that travel with blocks: doc_ids, rows, first windows, buckets, ranges, shares.
COLUMNS = (np.int64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8)


class SuffixAutomaton:
    """The automaton of several sequences, built sequence by sequence, symbol by symbol."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, moves: dict[int, int], length: int, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """Give the shorter sequences of state ``q`` a state of their own."""
        clone = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        moves, link, length = self.next, self.link, self.length
        last = 0
        for symbol in sequence:
            p, q = last, moves[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[p] + 1 else self._split(p, symbol, q)
                continue
            last = self._state({}, length[p] + 1, 0)
            while p >= 0 and symbol not in moves[p]:
                moves[p][symbol] = last
                p = link[p]
            if p >= 0:
                q = moves[p][symbol]
                link[last] = q if length[q] == length[p] + 1 else self._split(p, symbol, q)

    def matches(self, sequence: list[int]) -> Iterator[int]:
        """Yield, for each symbol, the length of the longest match that ends with it."""
        moves, link, length = self.next, self.link, self.length
        state, size = 0, 0
        for symbol in sequence:
            while state and symbol not in moves[state]:
                state = link[state]
                size = length[state]
            to = moves[state].get(symbol)
            if to is not None:
                state, size = to, size + 1
            yield size


class WordWindows:
    """Windows of ``window`` words with anchors of ``gram`` words."""

    def __init__(self, window: int = 13, gram: int | None = None) -> None:
        self.window = window
        self.gram = gram or max(1, window // 2)

    def units(self, texts: list[bytes]) -> tuple[tuple[Words, np.ndarray], np.ndarray, np.ndarray]:
        words = split_words([b" ".join(x.split()) for x in texts])
        h = words.hashes()
        return (words, h), self._hashes(h, self.gram), words.first

    @staticmethod
    def _hashes(h: np.ndarray, size: int) -> np.ndarray:
        n = len(h) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total += h[k : k + n] * FACTOR[k]
        return mixed(total)

    def window_hashes(self, units: tuple[Words, np.ndarray], start: np.ndarray) -> np.ndarray:
        return self._hashes(units[1], self.window)[start]

    def gather(self, b: Blocks, pick: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Return the blocks' words, joined by spaces."""
        words = b.units[0]
        a, z = words.start[b.start[pick]].tolist(), words.end[b.last[pick] + self.window - 1].tolist()
        out = np.empty(len(pick), object)
        out[:] = [words.raw[x:y] for x, y in zip(a, z, strict=True)]
        return out

    @staticmethod
    def order(data: np.ndarray) -> np.ndarray:
        return np.argsort(data, kind="stable")

    @staticmethod
    def changes(data: np.ndarray) -> np.ndarray:
        return np.append(True, (data[1:] != data[:-1]).astype(bool))

    def packed(self, e: Entries, bucket: int) -> bytes:
        return self.joined(e.data.tolist(), e.ids, e.row, e.start, np.full(len(e.ids), bucket), e.where, e.hashes % np.uint64(SHARES))

    @staticmethod
    def joined(texts: list[bytes], *columns: np.ndarray) -> bytes:
        """Pack blocks: doc_ids, rows, first windows, buckets, ranges, shares, and texts with line ends between (words hold none)."""
        return struct.pack("<Q", len(texts)) + b"".join(x.astype(t).tobytes() for x, t in zip(columns, COLUMNS, strict=True)) + b"\n".join(texts)

    @staticmethod
    def opened(data: bytes) -> tuple[list[bytes], list[np.ndarray]]:
        (n,) = struct.unpack_from("<Q", data)
        at, columns = 8, []
        for t in COLUMNS:
            columns.append(np.frombuffer(data, t, n, at))
            at += columns[-1].nbytes
        return data[at:].split(b"\n"), columns

    def relay(self, runs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        texts, columns = [], []
        for data in runs:
            own, more = self.opened(data)
            texts += own
            columns.append(more)
        if not columns:
            return
        every = [np.concatenate(x) for x in zip(*columns, strict=True)]
        order = np.argsort(every[4], kind="stable")
        for a, b in pieces(every[4][order]):
            own = order[a:b]
            yield int(every[4][own[0]]), self.joined([texts[i] for i in own.tolist()], *(x[own] for x in every))

    def resolve(self, runs: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        for share in range(SHARES):
            blocks: list[tuple[int, int, int, int, bytes]] = []
            for data in runs:
                texts, (ids, rows, starts, buckets, _, shares) = self.opened(data)
                own = np.flatnonzero(shares == share)
                blocks += zip(*(x[own].tolist() for x in (ids, buckets, rows, starts)), [texts[i] for i in own.tolist()], strict=True)
            blocks.sort()
            yield from self._stream(blocks)

    def _stream(self, blocks: list[tuple[int, int, int, int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
        """Stream blocks in the order of their doc_ids through the automaton of the smaller ones."""
        automaton, numbers = SuffixAutomaton(), {}
        waiting: list[list[int]] = []
        previous = None
        for doc_id, bucket, row, start, text in blocks:
            if doc_id != previous:
                for x in waiting:
                    automaton.add(x)
                waiting, previous = [], doc_id
            sequence = [numbers.setdefault(w, len(numbers)) for w in text.split(b" ")]
            first, found = -1, 0
            for k, size in enumerate(automaton.matches(sequence)):
                if size >= self.window:
                    found += 1
                    first = k - self.window + 1 if first < 0 else first
                elif first >= 0 and k - first >= self.window:
                    yield bucket, row, start + first, start + k
                    first = -1
            if first >= 0:
                yield bucket, row, start + first, start + len(sequence)
            if found < len(sequence) - self.window + 1:
                waiting.append(sequence)


def remove_repeats(docs: DataFrame, window: int = 13, with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Remove each word that a window of ``window`` words covers whose words also start in a document with a smaller doc_id.

    Return per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by a
    space), with ``with_text`` also kept and spans (array of start and stop, in words). Windows are judged on the
    input. A null text has no words. Rows with a null doc_id take no part and stay whole; rows with the same doc_id
    remove nothing of each other. Repeated rows stay, an empty table gives no rows. Texts of any length are taken whole: a
    task's memory grows with the longest one. Columns in ``carry`` come back in a struct ``rest``; others are left out.
    """
    rows, n = by_bucket(docs, carry)
    spans = duplicate_spans(rows, WordWindows(window), n)

    def finish(doc_ids: list, texts: list[bytes], spans: list[np.ndarray]) -> pa.Table:
        counts, kept = [], []
        for text, own in zip(texts, spans, strict=True):
            words = text.split()
            counts.append(len(words))
            if len(own):
                keep = np.ones(len(words), bool)
                for a, b in own.tolist():
                    keep[a:b] = False
                words = list(compress(words, keep.tolist()))
            kept.append((len(words), b" ".join(words)))
        columns = [
            pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array([n - k for n, (k, _) in zip(counts, kept, strict=True)], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for _, x in kept], pa.string()),
        ]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            pair = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
            columns += [pa.array([x.decode() for _, x in kept], pa.string()), pa.array([[{"start": a, "stop": b} for a, b in x.tolist()] for x in spans], pa.list_(pair))]
            names += ["kept", "spans"]
        return pa.table(columns, names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return remove_spans(rows, spans, finish, schema + (", kept string, spans array<struct<start: long, stop: long>>" if with_text else ""))
