"""Find what documents share, without comparing them: the exchange behind both exact span removals.

A text is a row of units (bytes or words). Two equal windows of ``window`` units hold the same anchor: the
``gram`` units in them with the smallest hash. So, instead of every window, only the units around an anchor travel:
the block of all consecutive windows with that anchor. Four steps, all keyed evenly:

1. Each bucket of documents sends the hashes of its anchors, once each, to hash ranges.
2. Each range sends back to the buckets the hashes that more than one document has.
3. Each bucket sends its blocks with such anchors to the ranges, gathered over its texts. Of equal blocks in a bucket only
   those of the smallest doc_id travel; the others are decided on the spot. So a passage that very many documents share
   costs a range one block a bucket. An anchor that more than ``HOT`` documents have is taken window by window,
   by the hash of the whole window, so that no range gets all that surrounds a common phrase.
4. Each range compares exact units (a scheme's ``resolve``) and sends the spans to remove to the buckets.

What goes from every bucket to every range would be rows in number as the square of the input. So, above ``RELAY`` ranges,
each way has a stop: a bucket sends one row to each group of ranges, where the rows of a group of buckets become one row
for each range, and back in the same way. Groups are as many as they have members, so rows grow with the input to the
power of 1.5, and hold more the larger it is.

Hashes only select candidates. A row with a null doc_id takes no part: it loses nothing and is no earlier document. Texts of
any length are taken whole; a task's memory grows with the longest one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm.shared import bucket_count, give_back
from subsetlab.llm.words import mixed
from subsetlab.session import ship

#: Documents that share an anchor, above which its blocks are taken apart into windows.
HOT = 4096
#: Ranges up to which buckets and ranges exchange rows without a stop.
RELAY = 4096
#: Blocks that a bucket gathers before it packs them.
GATHERED = 1 << 18
#: Units that are hashed at once (a longer text is one block of its own).
AT_ONCE = 1 << 19
LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)


@dataclass
class Blocks:
    """Blocks of windows with one anchor: text, first and last window, and the anchor, as places in ``units``."""

    units: object
    #: First unit of each text.
    first: np.ndarray
    text: np.ndarray
    anchor: np.ndarray
    start: np.ndarray
    last: np.ndarray
    hashes: np.ndarray


@dataclass
class Entries:
    """Blocks on their way: what a scheme makes of them, doc_ids, rows in the bucket, first windows, numbers of windows, ranges, hashes."""

    data: np.ndarray
    ids: np.ndarray
    row: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    where: np.ndarray
    hashes: np.ndarray

    def take(self, pick: np.ndarray) -> Entries:
        return Entries(*(x[pick] for x in vars(self).values()))

    @staticmethod
    def joined(parts: list[Entries]) -> Entries:
        return Entries(*(np.concatenate(x) for x in zip(*(vars(p).values() for p in parts), strict=True)))


class Scheme(Protocol):
    window: int
    gram: int

    def units(self, texts: list[bytes]) -> tuple[object, np.ndarray, np.ndarray]:
        """Return the texts' units, a hash of the gram that starts at each, and the texts' first units and the end."""

    def window_hashes(self, units: object, start: np.ndarray) -> np.ndarray:
        """Return hashes of the windows that start at ``start``."""

    def gather(self, blocks: Blocks, pick: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Return what travels of the blocks ``pick``: rows that are equal only if the blocks are."""

    def order(self, data: np.ndarray) -> np.ndarray:
        """Return the order in which rows travel; equal ones lie side by side in it."""

    def changes(self, data: np.ndarray) -> np.ndarray:
        """Tell for each ordered row whether it differs from the one before."""

    def packed(self, entries: Entries, bucket: int) -> bytes:
        """Pack entries in their order."""

    def relay(self, runs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """Yield (range, packed blocks) from packed blocks of several buckets and ranges."""

    def resolve(self, runs: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """Yield (bucket, row, first unit, end) of spans to remove, from packed blocks of one range."""


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def find_blocks(scheme: Scheme, texts: list[bytes]) -> Blocks:
    units, grams, first = scheme.units(texts)
    none = np.zeros(0, np.int64)
    windows = np.maximum(np.diff(first) - scheme.window + 1, 0)
    total = int(windows.sum())
    if not total:
        return Blocks(units, first, none, none, none, none, none.astype(np.uint64))
    # Of equal hashes the first one counts; 32 bits hold the place.
    key = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(key, scheme.window - scheme.gram + 1)
    place = np.arange(total) + np.repeat(first[:-1] - (np.cumsum(windows) - windows), windows)
    anchor = (least[place] & LOW).astype(np.int64)
    edge = np.flatnonzero(np.diff(anchor, prepend=-1))
    text = np.repeat(np.arange(len(texts)), windows)[edge]
    last = place[np.append(edge[1:], total) - 1]
    return Blocks(units, first, text, anchor[edge], place[edge], last, mixed(grams[anchor[edge]]))


def in_portions(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Yield (number of the first, texts) for consecutive texts of about AT_ONCE bytes."""
    at, size = 0, 0
    for k, x in enumerate(texts):
        if size and size + len(x) > AT_ONCE:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(x)
    if at < len(texts):
        yield at, texts[at:]


def keys(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Return range << 32 | low half of the hash, which rises with the hash within a range."""
    return ((hashes >> HALF) * np.uint64(ranges) >> HALF << HALF) | (hashes & LOW)


def in_order(table: pa.Table) -> tuple[list, list[bytes], list[int]]:
    """Return doc_ids and texts, and the places of rows with a doc_id by (doc_id, text): the same in every step."""
    ids = table.column("doc_id").to_pylist()
    texts = [x or b"" for x in table.column("text").cast(pa.large_binary()).to_pylist()]
    order = sorted((i for i in range(len(ids)) if ids[i] is not None), key=lambda i: (ids[i], texts[i]))
    return ids, texts, order


def ordered(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    ids, texts, order = in_order(table)
    return np.array([ids[i] for i in order], dtype=np.int64), [texts[i] for i in order]


def by_bucket(docs: DataFrame, carry: list[str] | None = None, mb: int = 16) -> tuple[DataFrame, int]:
    """Return doc_id, text, bucket, and as ``rest`` the columns in ``carry`` of every row, and the number of buckets."""
    rest = [F.struct(*carry).alias("rest")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)
    n = bucket_count(rows, "text", mb)
    return rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n


def joined(parts: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def pieces(edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Yield (first, end) of runs of equal values."""
    cut = np.append(np.flatnonzero(np.append(True, edges[1:] != edges[:-1])), len(edges)) if len(edges) else np.zeros(1, np.int64)
    return zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)


class Routes:
    """Which way rows go between buckets and ``ranges`` ranges: groups of ``width``, or a range for itself (width 1)."""

    def __init__(self, ranges: int) -> None:
        self.ranges = ranges
        self.width = math.isqrt(ranges - 1) + 1 if ranges > RELAY else 1

    @property
    def stops(self) -> bool:
        return self.width > 1


def offered(rows: DataFrame, scheme: Scheme, routes: Routes) -> DataFrame:
    """Send the hashes of anchors: rows (range, source, keys, docs, own), own being the bucket within a group of them."""
    ranges, width = routes.ranges, routes.width

    def offer(key: tuple, table: pa.Table) -> pa.Table:
        doc_ids, texts = ordered(table)
        found, owner = [], []
        for at, part in in_portions(texts):
            blocks = find_blocks(scheme, part)
            found.append(keys(blocks.hashes, ranges))
            owner.append(doc_ids[at + blocks.text])
        if not found:
            return OFFER.empty_table()
        k, d = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(k, kind="stable")
        k, d = k[order], d[order]
        new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
        other = new | np.append(True, d[1:] != d[:-1]) if len(k) else new
        at = np.flatnonzero(new)
        docs = np.minimum(np.add.reduceat(other, at, dtype=np.int64), 65535).astype(np.uint16) if len(at) else at
        k = k[at]
        group, bucket = (k >> HALF).astype(np.int64) // width, key[0].as_py()
        # Within one range the low half says all.
        shown = k if routes.stops else (k & LOW).astype(np.uint32)
        out = [(int(group[a]), bucket, shown[a:b].tobytes(), docs[a:b].tobytes(), b"") for a, b in pieces(group)]
        return give_back(table_of(out, OFFER))

    def stop(key: tuple, table: pa.Table) -> pa.Table:
        parts = table.column("keys").to_pylist()
        size = [len(x) // 8 for x in parts]
        k, docs = joined(parts, np.uint64), joined(table.column("docs").to_pylist(), np.uint16)
        own = np.repeat(np.array(table.column("source").to_pylist(), np.int64) % width, size).astype(np.uint16)
        order = np.argsort(k, kind="stable")
        k, docs, own = k[order], docs[order], own[order]
        low = (k & LOW).astype(np.uint32)
        out = [(int(k[a] >> HALF), key[1].as_py(), low[a:b].tobytes(), docs[a:b].tobytes(), own[a:b].tobytes()) for a, b in pieces(k >> HALF)]
        return give_back(table_of(out, OFFER))

    sent = rows.groupBy("bucket").applyInArrow(offer, OFFER_SQL)
    return sent.groupBy("range", F.floor(F.col("source") / width).cast("int").alias("group")).applyInArrow(stop, OFFER_SQL) if routes.stops else sent


def answered(offers: DataFrame, routes: Routes) -> DataFrame:
    """Return (bucket, keys, hot): which of the anchors that a bucket offered more than one document has."""
    width = routes.width

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        at_range = np.uint64(key[0].as_py()) << HALF
        lows = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
        low, n = np.concatenate(lows), joined(table.column("docs").to_pylist(), np.uint16).astype(np.int64)
        every, back = np.unique(low, return_inverse=True)
        docs = np.bincount(back, n)
        many, hot = (docs > 1)[back], (docs > HOT)[back]
        out, at = [], 0
        for source, own, inside in zip(table.column("source").to_pylist(), lows, table.column("own").to_pylist(), strict=True):
            pick, mine = many[at : at + len(own)], hot[at : at + len(own)]
            if pick.any():
                inside = np.frombuffer(inside, np.uint16)[pick].tobytes() if inside else b""
                out.append((source, int(key[0].as_py()) // width, (own[pick].astype(np.uint64) | at_range).tobytes(), mine[pick].tobytes(), inside))
            at += len(own)
        return table_of(out, ANSWER)

    def stop(key: tuple, table: pa.Table) -> pa.Table:
        k, hot, own = (joined(table.column(c).to_pylist(), t) for c, t in (("keys", np.uint64), ("hot", np.uint8), ("own", np.uint16)))
        order = np.lexsort((k, own))
        k, hot, own = k[order], hot[order], own[order]
        first = key[0].as_py() * width
        return table_of([(first + int(own[a]), key[1].as_py(), k[a:b].tobytes(), hot[a:b].tobytes(), b"") for a, b in pieces(own)], ANSWER)

    out = offers.groupBy("range").applyInArrow(answer, ANSWER_SQL)
    return out.groupBy("bucket", "group").applyInArrow(stop, ANSWER_SQL) if routes.stops else out


def duplicate_spans(rows: DataFrame, scheme: Scheme, ranges: int) -> DataFrame:
    """Return (bucket, row, start, stop): little-endian uint32 arrays of the spans, in units, that rows of a bucket lose."""
    ship(rows.sparkSession)
    routes = Routes(ranges)
    width = routes.width

    def send(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return SENT.empty_table()
        bucket = key[0].as_py()
        doc_ids, texts = ordered(table)
        known, known_hot = joined(answers.column("keys").to_pylist(), np.uint64), joined(answers.column("hot").to_pylist(), bool)
        order = np.argsort(known)
        known, known_hot = known[order], known_hot[order]
        out: list[tuple] = []
        squeeze = zstandard.ZstdCompressor(level=3).compress
        gone: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held: list[Entries] = []

        def first_ones(e: Entries) -> Entries:
            """Order entries; of equal ones only those of the smallest doc_id go on, the others lose all their windows."""
            e = e.take(scheme.order(e.data))
            new = scheme.changes(e.data)
            least = np.minimum.reduceat(e.ids, np.flatnonzero(new))[np.cumsum(new) - 1]
            lost = e.take(np.flatnonzero(e.ids > least))
            if len(lost.ids):
                gone.append((lost.row, lost.start, lost.start + lost.windows - 1 + scheme.window))
            return e.take(np.flatnonzero(e.ids == least))

        def flush() -> None:
            e = first_ones(Entries.joined(held)) if len(held) > 1 else held[0]
            held.clear()
            group = e.where // width
            order = np.argsort(group, kind="stable")
            for x, y in pieces(group[order]):
                out.append((int(group[order[x]]), bucket, squeeze(scheme.packed(e.take(order[x:y]), bucket)), None, None, None))

        for at, part in in_portions(texts):
            b = find_blocks(scheme, part)
            k = keys(b.hashes, ranges)
            place = np.minimum(np.searchsorted(known, k), len(known) - 1)
            pick = np.flatnonzero(known[place] == k)
            if not len(pick):
                continue
            hot = known_hot[place[pick]]
            if hot.any():
                # Take hot blocks apart: each window is a block of its own, whose anchor is its start.
                own = pick[hot]
                n = b.last[own] - b.start[own] + 1
                start = np.arange(n.sum()) + np.repeat(b.start[own] - (np.cumsum(n) - n), n)
                own = np.repeat(own, n)
                hashes = mixed(scheme.window_hashes(b.units, start))
                b = Blocks(b.units, b.first, *(np.concatenate([x[pick[~hot]], y]) for x, y in ((b.text, b.text[own]), (b.anchor, start), (b.start, start), (b.last, start), (b.hashes, hashes))))
                hot = np.arange(len(b.text)) >= len(pick) - hot.sum()
                pick = np.arange(len(b.text))
                k = keys(b.hashes, ranges)
            text = b.text[pick]
            e = Entries(scheme.gather(b, pick, hot), doc_ids[at + text], at + text, b.start[pick] - b.first[text], b.last[pick] - b.start[pick] + 1, (k[pick] >> HALF).astype(np.int64), b.hashes[pick])
            held.append(first_ones(e))
            if sum(len(x.ids) for x in held) > GATHERED:
                flush()
        if held:
            flush()
        if gone:
            row, start, stop = merged(*(np.concatenate(x) for x in zip(*gone, strict=True)))
            out.append((bucket % ranges // width, bucket, None, *(x.astype(np.uint32).tobytes() for x in (row, start, stop))))
        return give_back(table_of(out, SENT))

    def stop_sent(key: tuple, table: pa.Table) -> pa.Table:
        squeeze, open_up = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        columns = {x: table.column(x).to_pylist() for x in SENT.names}
        runs = [open_up(x) for x in columns["blocks"] if x is not None]
        out = [(r, key[1].as_py() * width, squeeze(x), None, None, None) for r, x in scheme.relay(runs)]
        # Spans that a bucket found by itself pass through.
        out += [(x[1] % ranges, *x[1:]) for x in zip(*columns.values(), strict=True) if x[2] is None]
        return give_back(table_of(out, SENT))

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        columns = {x: table.column(x).to_pylist() for x in ("source", "blocks", "row", "start", "stop")}
        open_up = zstandard.ZstdDecompressor().decompress
        spans: list[tuple[np.ndarray, ...]] = []
        for source, blocks, *own in zip(*columns.values(), strict=True):
            if blocks is None:
                row, start, stop = (np.frombuffer(x, np.uint32).astype(np.int64) for x in own)
                spans.append((np.full(len(row), source), row, start, stop))
        found = np.array(list(scheme.resolve([open_up(x) for x in columns["blocks"] if x is not None])), dtype=np.int64).reshape(-1, 4)
        spans.append(tuple(found.T))
        bucket, row, start, stop = (np.concatenate(x) for x in zip(*spans, strict=True))
        order = np.argsort(bucket, kind="stable")
        bucket, row, start, stop = bucket[order], row[order], start[order], stop[order]
        whole = []
        for a, b in pieces(bucket):
            one = merged(row[a:b], start[a:b], stop[a:b])
            whole.append((np.full(len(one[0]), bucket[a]), *one))
        if not whole:
            return SPANS.empty_table()
        bucket, *rest = (np.concatenate(x) for x in zip(*whole, strict=True))
        out = []
        for a, b in pieces(bucket // width):
            own = [x[a:b].astype(np.uint32).tobytes() for x in (bucket % width, *rest)]
            out.append((int(bucket[a]) // width, key[0].as_py() // width, *own))
        return give_back(table_of(out, SPANS))

    def stop_spans(key: tuple, table: pa.Table) -> pa.Table:
        own, row, start, stop = (joined(table.column(c).to_pylist(), np.uint32).astype(np.int64) for c in ("own", "row", "start", "stop"))
        order = np.argsort(own, kind="stable")
        out = []
        for a, b in pieces(own[order]):
            pick = order[a:b]
            spans = (x.astype(np.uint32).tobytes() for x in merged(row[pick], start[pick], stop[pick]))
            out.append((key[0].as_py() * width + int(own[pick[0]]), key[1].as_py(), b"", *spans))
        return give_back(table_of(out, SPANS))

    answers = answered(offered(rows, scheme, routes), routes)
    sent = rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(send, SENT_SQL)
    if routes.stops:
        sent = sent.groupBy("range", F.floor(F.col("source") / width).cast("int").alias("group")).applyInArrow(stop_sent, SENT_SQL)
    spans = sent.groupBy("range").applyInArrow(settle, SPANS_SQL)
    return (spans.groupBy("bucket", "group").applyInArrow(stop_spans, SPANS_SQL) if routes.stops else spans).select("bucket", "row", "start", "stop")


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([list(x) for x in zip(*rows, strict=True)] if rows else [[]] * len(schema), schema=schema)


OFFER = pa.schema([("range", pa.int32()), ("source", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("own", pa.binary())])
OFFER_SQL = "range int, source int, keys binary, docs binary, own binary"
ANSWER = pa.schema([("bucket", pa.int32()), ("group", pa.int32()), ("keys", pa.binary()), ("hot", pa.binary()), ("own", pa.binary())])
ANSWER_SQL = "bucket int, group int, keys binary, hot binary, own binary"
SENT = pa.schema([("range", pa.int32()), ("source", pa.int32()), ("blocks", pa.binary()), ("row", pa.binary()), ("start", pa.binary()), ("stop", pa.binary())])
SENT_SQL = "range int, source int, blocks binary, row binary, start binary, stop binary"
SPANS = pa.schema([("bucket", pa.int32()), ("group", pa.int32()), ("own", pa.binary()), ("row", pa.binary()), ("start", pa.binary()), ("stop", pa.binary())])
SPANS_SQL = "bucket int, group int, own binary, row binary, start binary, stop binary"


def merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join spans of a row that overlap or touch."""
    if not len(row):
        return row, start, stop
    order = np.lexsort((stop, start, row))
    row, start, stop = row[order], start[order], stop[order]
    # Rows are far apart on this line, so the furthest end so far is one of the same row.
    far = np.maximum.accumulate(stop + (row << 32))
    new = np.append(True, (start + (row << 32))[1:] > far[:-1])
    at = np.flatnonzero(new)
    return row[at], start[at], far[np.append(at[1:], len(row)) - 1] & 0xFFFFFFFF


def remove_spans(rows: DataFrame, spans: DataFrame, finish: Callable[[list, list[bytes], list[np.ndarray]], pa.Table], schema: str) -> DataFrame:
    """Give ``finish`` doc_ids, texts and their spans (n x 2) of a bucket; rows without a doc_id have no spans.

    A column ``rest`` of the rows is added to what it returns.
    """
    carries = "rest" in rows.columns

    def run(key: tuple, table: pa.Table, spans: pa.Table) -> pa.Table:
        ids, texts, order = in_order(table)
        order = order + [i for i, x in enumerate(ids) if x is None]
        own: list[np.ndarray] = [np.zeros((0, 2), np.int64)] * len(ids)
        if spans.num_rows:
            row, start, stop = (np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) for x in spans.column(c).to_pylist()]) for c in ("row", "start", "stop"))
            row, start, stop = merged(row, start, stop)
            cut = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                own[row[a]] = np.stack([start[a:b], stop[a:b]], axis=1)
        out = finish([ids[i] for i in order], [texts[i] for i in order], own)
        del ids, texts, own
        return give_back(out.append_column("rest", table.column("rest").take(pa.array(order, pa.int64()))) if carries else out)

    kind = f", rest {rows.schema['rest'].dataType.simpleString()}" if carries else ""
    return rows.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(run, schema + kind)
