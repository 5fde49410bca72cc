"""Best-fit packing of token pieces into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so a histogram of lengths, whose size the capacity bounds, is all
that planning needs: documents count only through it. ``plan`` works on the histogram by large-item matching:

1. A piece above half the capacity opens a bin. Pieces above a third of it fit at most twice into a bin: in
   falling order each large one is matched with the largest medium one that still fits, and the medium ones
   that are left pair up in the same greedy way.
2. The smaller pieces, in falling order, go to the fullest bin that takes them (best fit), else open bins.

The plan says, for each length and rank among the pieces of that length, the sequence and the offset. Pieces get
their ranks in salted groups, so that a length that many pieces share is not one task's work.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subsetlab.llm.shared import cut, map_batches, text_bytes
from subsetlab.llm.wordbpe import library_encoder

#: Pieces in one group that ranks are given in.
RANKED = 100_000
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each, cut what is longer than ``capacity``.

    One row a piece: doc_id, piece (from 0), start, length, ids_crc32 (of little-endian uint32 ids), with
    ``with_ids`` also ids (array of int). A null text is empty, so it is one piece that holds ``end_id`` alone. A
    null doc_id stays null; repeated rows are pieces of their own. Further columns are left out. Texts of any length are
    encoded whole: a task's memory grows with the longest one.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, count = library_encoder(tokenizer).encode(text_bytes(batch.column(1)))
        doc, piece, start, length, crc, all_ids = [], [], [], [], [], []
        at = 0
        for d, n in zip(batch.column(0).to_pylist(), count.tolist(), strict=True):
            own = np.append(ids[at : at + n], np.uint16(end_id)).astype("<u4")
            at += n
            for k in range(0, n + 1, capacity):
                part = own[k : k + capacity]
                doc.append(d)
                piece.append(k // capacity)
                start.append(k)
                length.append(len(part))
                crc.append(zlib.crc32(part))
                if with_ids:
                    all_ids.append(part.astype(np.int32))
        columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, work, PIECES + (", ids array<int>" if with_ids else ""))


class _Bins:
    """Bins by what is left in them; bins alike form one group: (first sequence number, how many)."""

    def __init__(self) -> None:
        self.groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.gaps: list[int] = []

    def add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if not self.groups[gap]:
                bisect.insort(self.gaps, gap)
            self.groups[gap].append((first, count))

    def fullest(self, least: int) -> tuple[int, int, int] | None:
        """Take out a group of the bins with the smallest gap that is not below ``least``."""
        k = bisect.bisect_left(self.gaps, least)
        if k == len(self.gaps):
            return None
        gap = self.gaps[k]
        first, count = self.groups[gap].pop()
        if not self.groups[gap]:
            self.gaps.pop(k)
        return gap, first, count


def plan(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """Pack ``histogram`` (length to count) and return where the pieces of each length go.

    Columns: length, rank (first of a run of pieces, from 0), count, bin (of the first), per_bin (pieces of the run
    that share a bin), offset (of the first in its bin). An empty histogram gives an empty plan.
    """
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    left, rank = dict(histogram), defaultdict(int)
    rows: list[tuple[int, int, int, int, int, int]] = []
    bins, opened = _Bins(), 0

    def put(length: int, count: int, first_bin: int, per_bin: int, offset: int) -> None:
        rows.append((length, rank[length], count, first_bin, per_bin, offset))
        rank[length] += count
        left[length] -= count

    above_third = sorted(x for x in histogram if 3 * x > capacity)
    for large in reversed(above_third):
        while left[large]:
            k = bisect.bisect_right(above_third, min(large, capacity - large)) - 1
            while k >= 0 and not (left[above_third[k]] - (above_third[k] == large) > 0):
                k -= 1
            small = above_third[k] if k >= 0 else 0
            n = left[large] if not small else min(left[large], left[small]) if small != large else left[large] // 2
            if small == large:
                put(large, 2 * n, opened, 2, 0)
            else:
                put(large, n, opened, 1, 0)
                if small:
                    put(small, n, opened, 1, large)
            bins.add(capacity - large - small, opened, n)
            opened += n
    for small in sorted((x for x in histogram if 3 * x <= capacity), reverse=True):
        while left[small]:
            found = bins.fullest(small)
            gap, first, count = found or (capacity, opened, math.ceil(left[small] / (capacity // small)))
            if not found:
                opened += count
            fit = gap // small
            whole = min(count, left[small] // fit)
            if whole:
                put(small, whole * fit, first, fit, capacity - gap)
                bins.add(gap - fit * small, first, whole)
            if whole < count and left[small]:
                some = left[small]
                put(small, some, first + whole, some, capacity - gap)
                bins.add(gap - some * small, first + whole, 1)
                whole += 1
            bins.add(gap, first + whole, count - whole)
    return pd.DataFrame(rows, columns=["length", "rank", "count", "bin", "per_bin", "offset"]).astype("int64")


def ranked(pieces: DataFrame, count: int) -> DataFrame:
    """Return ``row`` (a struct of each row of ``pieces``, read from a written table), length and rank.

    rank is a number from 0 among the pieces of the same length, given in salted groups. Salts go by place, so that equal
    rows are dealt as well.
    """
    salts = max(16, math.ceil(count / RANKED))
    place = F.monotonically_increasing_id()
    salted = pieces.select(F.struct("*").alias("row"), "length", place.alias("place")).withColumn("salt", F.pmod("place", F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("place")) - 1)
    return own.join(bases, ["length", "salt"]).select("row", "length", (F.col("base") + F.col("own")).alias("rank"))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (length, and any other columns; own ones of these two names are replaced).

    Sequences hold no gaps and at most ``capacity`` tokens. Which of several pieces of equal length goes where is free.
    An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces.drop("sequence_id", "offset"))
    # A row a length: the capacity bounds what the driver gets.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    steps = plan(histogram, capacity).sort_values(["length", "rank"])
    key = (steps["length"].to_numpy() << 44) + steps["rank"].to_numpy()
    table = spark.sparkContext.broadcast((key, *(steps[c].to_numpy() for c in ("rank", "bin", "per_bin", "offset"))))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, first, bins, per_bin, offset = table.value
        wanted = length.to_numpy().astype("int64")
        k = np.searchsorted(keys, (wanted << 44) + rank.to_numpy(), side="right") - 1
        n = rank.to_numpy() - first[k]
        return pd.DataFrame({"sequence_id": bins[k] + n // per_bin[k], "offset": offset[k] + n % per_bin[k] * wanted})

    placed = ranked(pieces, sum(histogram.values())).select("row", place("length", "rank").alias("placed"))
    return placed.select("row.*", "placed.*")


def sequences(packed: DataFrame) -> DataFrame:
    """Join the ids of packed pieces (with ids) to sequences: sequence_id, ids, doc_ids and lengths in their order.

    A sequence's pieces are at most as many as its tokens, so a group is bounded by the capacity.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("parts")
    return packed.groupBy("sequence_id").agg(parts).select(
        "sequence_id",
        F.flatten("parts.ids").alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.length").alias("lengths"),
    )
