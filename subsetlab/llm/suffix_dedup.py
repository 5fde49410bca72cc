"""Suffix-array dedup: remove bytes that a long string of an earlier document covers.

Suffixes that can match one of another document (see ``anchors``) are sorted where they are. Sorted runs travel
front-coded: each suffix says how many bytes it shares with the one before and adds the rest. A range merges its
runs with a loser tree that knows, for every suffix, how much of it the last winner shares: two suffixes are first
compared by these numbers, and bytes only from there on. The merge yields suffixes in order with the length of the
prefix shared with the one before, as a suffix array and its LCP array do. Where there are very many ranges, runs are
merged in two passes.

A suffix starts at an anchor and holds the bytes after it, then those before it in reverse, as far as the windows
of its block reach. Two suffixes share a window that takes l bytes from before the anchor if they share its other bytes after the
anchor, which the merge's shared lengths say, and l bytes before it. So what goes follows from shared lengths alone.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from subsetlab.llm.anchors import Blocks, Entries, by_bucket, duplicate_spans, pieces, remove_spans
from subsetlab.llm.words import BYTE, mixed, powers

#: Types of the columns that travel with suffixes: doc_ids, rows, first windows, buckets, ranges.
COLUMNS = (np.int64, np.uint32, np.uint32, np.uint32, np.uint32)
#: Suffixes around one anchor whose pairs are looked at one by one.
FEW = 8


def first_difference(a: bytes, b: bytes, at: int) -> int:
    """Return the first place from ``at`` on where ``a`` and ``b`` of equal length differ, or their length."""
    n = len(a)
    while a[at : at + 8] == b[at : at + 8]:
        at += 8
        if at >= n:
            return n
    while a[at] == b[at]:
        at += 1
    return at


def merge_runs(runs: list[tuple[bytes, bytes]], size: int) -> Iterator[tuple[int, int, bytes, int]]:
    """Merge front-coded sorted runs of ``size``-byte suffixes with a loser tree.

    A run is (shared lengths as bytes, rests in turn). Yield (run, place in it, suffix, bytes shared with the suffix
    before). ``shared[i]`` is how much of the head of run i the last winner that it met shares.
    """
    count = len(runs)
    if not count:
        return
    head: list[bytes] = [b""] * count
    shared, place, at = [0] * count, [0] * count, [0] * count
    done = [False] * count

    def advance(i: int) -> None:
        lengths, rests = runs[i]
        if place[i] == len(lengths):
            done[i] = True
            return
        k = lengths[place[i]]
        head[i] = head[i][:k] + rests[at[i] : at[i] + size - k]
        at[i] += size - k
        place[i] += 1
        shared[i] = k

    losers = [-1] * count

    def climb(i: int, node: int) -> int:
        """Let run i play up the tree from ``node``; return who wins (-1: a place in the tree was free)."""
        while node:
            j = losers[node]
            if j < 0:
                losers[node] = i
                return -1
            if done[i] or (not done[j] and shared[j] > shared[i]):
                losers[node], i = i, j
            elif not done[j] and shared[j] == shared[i]:
                a, b = head[i], head[j]
                k = first_difference(a, b, shared[i])
                if k < size and a[k] > b[k]:
                    shared[i] = k
                    losers[node], i = i, j
                else:
                    shared[j] = k
            node >>= 1
        return i

    winner = -1
    for i in range(count):
        advance(i)
        shared[i] = 0
        winner = climb(i, (i + count) >> 1)
    while not done[winner]:
        yield winner, place[winner] - 1, head[winner], shared[winner]
        advance(winner)
        winner = climb(winner, (winner + count) >> 1)


class ByteWindows:
    """Windows of ``window`` bytes with anchors of ``gram`` bytes."""

    def __init__(self, window: int = 50, gram: int | None = None) -> None:
        self.window = window
        self.gram = gram or max(1, window * 12 // 25)
        self.reach = window - self.gram
        #: Hot mark, bytes from the anchor on, bytes before it in reverse, and how many there are of both.
        self.size = 1 + window + self.reach + 2
        if self.size > 255:
            raise ValueError("windows this long don't fit the run format")

    def units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        first = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
        return data, self._hashes(data, self.gram), first

    @staticmethod
    def _hashes(data: np.ndarray, size: int) -> np.ndarray:
        n = len(data) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        power, inverse = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * power[:-1], out=total[1:])
        return mixed((total[size:] - total[:-size]) * inverse[:n])

    def window_hashes(self, units: np.ndarray, start: np.ndarray) -> np.ndarray:
        return self._hashes(units, self.window)[start]

    def gather(self, b: Blocks, pick: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Return the suffixes of blocks as rows of a matrix that sort as they should."""
        out = np.zeros((len(pick), self.size), np.uint8)
        anchor = b.anchor[pick]
        right, left = b.last[pick] + self.window - anchor, anchor - b.start[pick]
        data = np.concatenate([np.zeros(self.reach, np.uint8), b.units, np.zeros(self.window, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view
        out[:, 0] = hot
        out[:, 1 : 1 + self.window] = view(data, self.window)[anchor + self.reach]
        out[:, 1 : 1 + self.window][np.arange(self.window) >= right[:, None]] = 0
        if self.reach:
            out[:, 1 + self.window : -2] = view(data, self.reach)[anchor][:, ::-1]
            out[:, 1 + self.window : -2][np.arange(self.reach) >= left[:, None]] = 0
        out[:, -2], out[:, -1] = right, left + 1
        return out

    def order(self, data: np.ndarray) -> np.ndarray:
        return np.argsort(np.ascontiguousarray(data).view(f"S{self.size}").ravel(), kind="stable")

    @staticmethod
    def changes(data: np.ndarray) -> np.ndarray:
        return np.append(True, (data[1:] != data[:-1]).any(axis=1))

    def packed(self, e: Entries, bucket: int) -> bytes:
        return self.coded(e.data, e.ids, e.row, e.start, np.full(len(e.ids), bucket), e.where)

    def coded(self, own: np.ndarray, *columns: np.ndarray) -> bytes:
        """Front-code sorted suffixes: shared lengths and rests, then doc_ids, rows, first windows, buckets, ranges."""
        differ = own[1:] != own[:-1]
        shared = np.append(0, np.where(differ.any(axis=1), differ.argmax(axis=1), self.size)).astype(np.uint8)
        rests = own[np.arange(self.size) >= shared[:, None]]
        head = struct.pack("<QQ", len(own), len(rests))
        return head + shared.tobytes() + rests.tobytes() + b"".join(x.astype(t).tobytes() for x, t in zip(columns, COLUMNS, strict=True))

    @staticmethod
    def opened(runs: list[bytes]) -> tuple[list[tuple[bytes, bytes]], list[list[np.ndarray]]]:
        """Return runs as ``merge_runs`` takes them, and the columns of each."""
        coded, columns = [], []
        for data in runs:
            n, m = struct.unpack_from("<QQ", data)
            coded.append((data[16 : 16 + n], data[16 + n : 16 + n + m]))
            at, own = 16 + n + m, []
            for t in COLUMNS:
                own.append(np.frombuffer(data, t, n, at))
                at += own[-1].nbytes
            columns.append(own)
        return coded, columns

    def relay(self, runs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        coded, columns = self.opened(runs)
        if not coded:
            return
        met = [(run, k, suffix) for run, k, suffix, _ in merge_runs(coded, self.size)]
        rows = np.frombuffer(b"".join(x for _, _, x in met), np.uint8).reshape(-1, self.size)
        first = np.cumsum([0, *[len(own[0]) for own in columns]])
        place = np.array([first[run] + k for run, k, _ in met])
        every = [np.concatenate([own[c] for own in columns])[place] for c in range(len(COLUMNS))]
        order = np.argsort(every[-1], kind="stable")
        for a, b in pieces(every[-1][order]):
            own = order[a:b]
            yield int(every[-1][own[0]]), self.coded(rows[own], *(c[own] for c in every))

    def resolve(self, runs: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        coded, columns = self.opened(runs)
        ids, rows, starts, buckets = ([own[c].tolist() for own in columns] for c in range(4))
        # Suffixes, how many bytes after the anchor they share with the one before, and who has them.
        group: list[tuple[bytes, int, list[tuple[int, int, int, int]]]] = []
        for run, k, suffix, shared in merge_runs(coded, self.size):
            member = ids[run][k], buckets[run][k], rows[run][k], starts[run][k]
            if shared == self.size:
                group[-1][2].append(member)
                continue
            # Windows can be equal only where the anchor is; hot windows only where all is.
            if shared <= self.gram or suffix[0]:
                yield from self._group(group)
                group = []
            group.append((suffix, min(shared - 1, self.window), [member]))
        yield from self._group(group)

    def _group(self, group: list[tuple[bytes, int, list]]) -> Iterator[tuple[int, int, int, int]]:
        if not group or len(group) == 1 == len(group[0][2]):
            return
        owners = [min(x[0] for x in members) for _, _, members in group]
        lost: list[list[tuple[int, int]]] = [[] for _ in group]
        if len(group) > 1 and min(owners) != max(owners):
            lost = self._pairs(group, owners) if len(group) <= FEW else self._classes(group, owners)
        for (suffix, _, members), owner, own in zip(group, owners, lost, strict=True):
            right, left = suffix[-2], suffix[-1] - 1
            for doc_id, bucket, row, start in members:
                if doc_id > owner:
                    yield bucket, row, start, start + right + left
                else:
                    for low, high in own:
                        yield bucket, row, start + left - high, start + left - low + self.window

    def _before(self, suffix: bytes) -> bytes:
        return suffix[1 + self.window : self.window + suffix[-1]]

    def _pairs(self, group: list, owners: list[int]) -> list[list[tuple[int, int]]]:
        """Return for each suffix what it loses: (least, most) bytes before the anchor, by looking at each pair."""
        out: list[list[tuple[int, int]]] = [[] for _ in group]
        before = [self._before(x) for x, _, _ in group]
        for i, (a, _, _) in enumerate(group):
            shared = self.window
            for j in range(i + 1, len(group)):
                b = group[j][0]
                shared = min(shared, group[j][1])
                if owners[i] == owners[j]:
                    continue
                low = max(0, self.window - min(shared, a[-2], b[-2]))
                n = min(len(before[i]), len(before[j]))
                high = first_difference(before[i][:n], before[j][:n], 0) if n else 0
                if low <= high:
                    out[i if owners[i] > owners[j] else j].append((low, high))
        return out

    def _classes(self, group: list, owners: list[int]) -> list[list[tuple[int, int]]]:
        """Return the same for many suffixes: for each number of bytes before the anchor, by classes that shared lengths give."""
        m = len(group)
        out: list[list[tuple[int, int]]] = [[] for _ in group]
        right = np.array([x[-2] for x, _, _ in group])
        left = np.array([x[-1] - 1 for x, _, _ in group])
        after = np.array([x for _, x, _ in group])
        before = [self._before(x) for x, _, _ in group]
        order = sorted(range(m), key=before.__getitem__)
        shared = [0]
        for i, j in zip(order, order[1:], strict=False):
            n = min(len(before[i]), len(before[j]))
            shared.append(first_difference(before[i][:n], before[j][:n], 0) if n else 0)
        shared, order, owner = np.array(shared), np.array(order), np.array(owners)
        for at in range(int(left.max()) + 1):
            fits = np.flatnonzero((left >= at) & (right >= self.window - at))
            if len(fits) < 2:
                continue
            second = np.empty(m, np.int64)
            second[order] = np.cumsum(shared < at)
            key = (np.cumsum(after < self.window - at) * (m + 1) + second)[fits]
            _, of = np.unique(key, return_inverse=True)
            least = np.full(int(of.max()) + 1, owner.max())
            np.minimum.at(least, of, owner[fits])
            for i in fits[owner[fits] > least[of]].tolist():
                if out[i] and out[i][-1][1] == at - 1:
                    out[i][-1] = (out[i][-1][0], at)
                else:
                    out[i].append((at, at))
        return out


def remove_repeats(docs: DataFrame, window: int = 50, with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Remove each byte that a ``window``-byte string covers which also starts in a document with a smaller doc_id.

    Return per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 (of the remaining bytes), with ``with_text`` also kept (binary: a cut may fall inside a character)
    and spans (array of start and stop). Strings are judged on the input. A null text is empty. Rows with a null
    doc_id take no part and stay whole. Rows with the same doc_id remove nothing of each other. Texts shorter than
    the window stay. Repeated rows stay, an empty table gives no rows. Texts of any length are taken whole: a
    task's memory grows with the longest one. Columns in ``carry`` come back in a struct ``rest``; others are left out.
    """
    rows, n = by_bucket(docs, carry)
    spans = duplicate_spans(rows, ByteWindows(window), n)

    def finish(doc_ids: list, texts: list[bytes], spans: list[np.ndarray]) -> pa.Table:
        kept = []
        for text, own in zip(texts, spans, strict=True):
            cut = [0, *own.ravel().tolist(), len(text)]
            kept.append(b"".join([text[a:b] for a, b in zip(cut[::2], cut[1::2], strict=True)]) if len(own) else text)
        columns = [
            pa.array(doc_ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()),
            pa.array([len(x) - len(y) for x, y in zip(texts, kept, strict=True)], pa.int64()), pa.array([len(x) for x in spans], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        ]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            pair = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
            columns += [pa.array(kept, pa.binary()), pa.array([[{"start": a, "stop": b} for a, b in x.tolist()] for x in spans], pa.list_(pair))]
            names += ["kept", "spans"]
        return pa.table(columns, names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return remove_spans(rows, spans, finish, schema + (", kept binary, spans array<struct<start: long, stop: long>>" if with_text else ""))
