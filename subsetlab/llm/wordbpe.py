"""Encoding of whole texts piece by piece: a text's encoding is that of its white-space separated pieces.

The vocabulary's normaliser turns white space into single spaces, its pre-tokeniser drops white space and never
joins characters across it. So the ids of a text are the ids of its pieces in turn, and pieces recur. The ids of
pieces are kept by their bytes in a table; a full one is emptied, which costs time and changes no result. Texts are
taken apart by a dictionary of their words, so the table is asked once for each different word of a batch. A piece
may have any length.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np

from subsetlab.llm.words import Words, ragged, split_words

#: Pieces whose ids one worker keeps, and their bytes; a batch may pass them.
PIECES, BYTES = 400_000, 32 << 20
#: A line each: a piece of Latin letters and then marks, whose pre-tokens are the letters, and the marks if there are any; or any other piece.
PLAIN = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#*$%&]*)|(.*))$", re.MULTILINE)


#: Cores whose ids one worker keeps, and ids that a table keeps before it is emptied.
CORES, POOL = 250_000, 1 << 24


class PieceEncoder:
    """Encode texts (UTF-8) with ``encode_all``, which turns pieces into their ids in turn and how many each has.

    ``split`` takes texts apart into pieces that are encoded alone.
    """

    def __init__(
        self, encode_all: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], pieces: int = PIECES, split: Callable[[list[bytes]], Words] = split_words
    ) -> None:
        self.encode_all, self.most, self.split = encode_all, pieces, split
        self._empty()

    def _empty(self) -> None:
        #: By a piece's bytes its number; by that number where its ids begin in the pool, and how many they are.
        self.number: dict[bytes, int] = {}
        self.at, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool, self.pooled, self.bytes = np.zeros(1 << 16, np.uint16), 0, 0

    def _learn(self, pieces: list[bytes]) -> None:
        """Add pieces and their ids to the table."""
        ids, size = self.encode_all([x.decode() for x in pieces])
        while self.pooled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.pooled : self.pooled + len(ids)] = ids
        n = len(self.number)
        while n + len(pieces) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.at[n : n + len(pieces)], self.size[n : n + len(pieces)] = self.pooled + np.cumsum(size) - size, size
        self.pooled += len(ids)
        self.bytes += sum(map(len, pieces))
        self.number.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Return the ids of all texts in turn, and how many each text has."""
        words = self.split(texts)
        code, pieces = words.codes()
        if len(self.number) > self.most or self.pooled > POOL or self.bytes > BYTES:
            self._empty()
        new = [x for x in pieces if x not in self.number]
        if new:
            self._learn(new)
        number = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))[code]
        size = self.size[number]
        before = np.concatenate([[0], np.cumsum(size)])
        return ragged(self.pool, self.at[number], size), np.diff(before[words.first])


class Cores:
    """Encode pieces by ``encode``, which gets cores of one kind: plain ones (lower-case, one pre-token each) or others."""

    def __init__(self, encode: Callable[[list[str], bool], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode = encode
        self._empty()

    def _empty(self) -> None:
        self.cores: dict[str, int] = {}
        #: By the number of a core: where its ids begin in the pool, and how many they are.
        self.at, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool, self.pooled = np.zeros(1 << 16, np.uint16), 0

    def _keep(self, cores: list[str], plain: bool) -> None:
        ids, size = self.encode(cores, plain)
        while self.pooled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.pooled : self.pooled + len(ids)] = ids
        n = len(self.cores)
        while n + len(cores) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.at[n : n + len(cores)], self.size[n : n + len(cores)] = self.pooled + np.cumsum(size) - size, size
        self.pooled += len(ids)
        self.cores.update(zip(cores, range(n, n + len(cores)), strict=True))

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Pieces hold no line end: one search finds the parts of all of them.
        letters, marks, others = zip(*PLAIN.findall("\n".join(pieces)), strict=True) if pieces else ((), (), ())
        letters = "\n".join(letters).lower().split("\n")
        if len(self.cores) > CORES or self.pooled > POOL:
            self._empty()
        plain = list({*letters}.difference(self.cores, ("",)))
        for k in range(0, len(plain), 500):
            self._keep(plain[k : k + 500], True)
        self._keep(list({*marks, *others}.difference(self.cores)), False)
        n = len(pieces)
        heads = [x or y for x, y in zip(letters, others, strict=True)] if n else []
        both = np.empty((n, 2), np.int64)
        both[:, 0] = np.fromiter(map(self.cores.__getitem__, heads), np.int64, n)
        both[:, 1] = np.fromiter(map(self.cores.__getitem__, marks), np.int64, n)
        size = self.size[both]
        return ragged(self.pool, self.at[both].ravel(), size.ravel()), size.sum(axis=1)


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((x for own in ids for x in own), np.uint16, int(size.sum())), size


_workers: dict[str, PieceEncoder] = {}


def library_encoder(path: str) -> PieceEncoder:
    """Return this worker's encoder by the tokenizers library with the vocabulary file at ``path``."""
    if path not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids don't fit into 16 bits")
        ends = np.zeros(1 << 16, dtype=bool)
        ends[[i for x, i in tokenizer.get_vocab().items() if x.endswith("</w>")]] = True

        def encode(cores: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
            if not plain:
                return flat([e.ids for e in tokenizer.encode_batch_fast(cores, add_special_tokens=False)])
            # One call for all: of a pre-token's ids the last alone has a word end.
            ids = np.asarray(tokenizer.encode_batch_fast([" ".join(cores)], add_special_tokens=False)[0].ids, dtype=np.uint16)
            return ids, np.diff(np.flatnonzero(ends[ids]) + 1, prepend=0)

        _workers[path] = PieceEncoder(Cores(encode))
    return _workers[path]
