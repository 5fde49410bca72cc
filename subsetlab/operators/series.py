"""Ordered series in chunks: no task holds the series, and one row a draw is shuffled, not one for each draw and number.

A chunk gets its own draws, the last ones before it, and how often each number occurred before it. Counts up to any of
its draws, over all draws or the last few, then are differences of cumulative sums inside the chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subsetlab.model import MAIN, N, main_array
from subsetlab.session import cut, ship

#: Draws of a chunk that hands its last rows on, and of one that is counted in memory (4 MB for each N counts a draw).
CHUNK, BLOCK = 100_000, 10_000
#: Draws of a task that gathers chunks, about: it doesn't grow with the series.
PART_DRAWS = 50_000


def halo(rows: DataFrame, most: int, size: int | None = None) -> DataFrame:
    """Chunk ``rows`` by t and hand the last ``most`` of each chunk on to the next one: adds _chunk and _own (false for those handed on)."""
    size = max(size or CHUNK, most)
    place = F.col("t") - 1
    own = F.floor(place / size)
    here, there = F.struct(own.alias("_chunk"), F.lit(True).alias("_own")), F.struct((own + 1).alias("_chunk"), F.lit(False).alias("_own"))
    copies = F.explode(F.when(place % size >= size - most, F.array(here, there)).otherwise(F.array(here)))
    return rows.withColumn("_copy", copies).select(*rows.columns, "_copy.*")


class Chunk:
    """The draws of a chunk in order: t, y (draws x N, whether a number was drawn) and c (how often it was up to and with t)."""

    def __init__(self, rows: pa.Table, base: np.ndarray) -> None:
        t = rows.column("t").to_numpy()
        order = np.argsort(t, kind="stable")
        main = np.stack([rows.column(c).fill_null(0).to_numpy() for c in MAIN], axis=1)[order]
        y = np.zeros((len(t), N + 1), np.int64)
        y[np.arange(len(t))[:, None], np.where((main < 1) | (main > N), 0, main)] = 1
        self._t, handed = t[order], len(t) - int(rows.column("_own").to_numpy(zero_copy_only=False).sum())
        total = np.concatenate([np.zeros((1, N), np.int64), y[:, 1:].cumsum(axis=0)])
        self._total = total + (base - total[handed])
        self.t, self.y, self.c = self._t[handed:], y[handed:, 1:], self._total[handed + 1 :]

    def upto(self, width: int) -> np.ndarray:
        """Return the counts up to draw t - width, for a width of at most the draws handed on."""
        return self._total[np.searchsorted(self._t, self.t - width, side="right")]


def prepared(draws: DataFrame, most: int, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Return the rows of chunks (see ``halo``), and _of (their chunk) and base: the counts of all N numbers before each chunk.

    Draws are derived once and written; both results come in the same parts, of about PART_DRAWS draws each.
    """
    draws = cut(draws.select("t", *MAIN))
    parts = max(1, math.ceil(draws.count() / PART_DRAWS))
    rows = halo(draws, most, size or BLOCK)
    own = rows.where("_own").select("_chunk", main_array().alias("main"))
    counts = own.select("_chunk", F.explode("main").alias("num")).groupBy("_chunk", "num").agg(F.count(F.lit(1)).alias("n"))
    every = own.select("_chunk").distinct().withColumn("num", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(N).cast("long"))))
    before = Window.partitionBy("num").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = every.join(counts, ["_chunk", "num"], "left").withColumn("s", F.coalesce(F.sum("n").over(before), F.lit(0)))
    base = F.transform(F.array_sort(F.collect_list(F.struct("num", "s"))), lambda x: x["s"])
    bases = sums.groupBy(F.col("_chunk").alias("_of")).agg(base.alias("base"))
    return rows.repartition(parts, "_chunk"), bases.repartition(parts, "_of")


def by_chunk(parts: tuple[DataFrame, DataFrame], work: Callable[[Chunk], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Return what ``work`` makes of every chunk of ``parts`` (see ``prepared``): columns by name, in the order of ``schema``."""
    rows, bases = parts
    ship(rows.sparkSession)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        base = np.array(right.column("base")[0].as_py(), np.int64) if right.num_rows else np.zeros(N, np.int64)
        return pa.table(work(Chunk(left, base)))

    return rows.groupBy("_chunk").cogroup(bases.groupBy("_of")).applyInArrow(run, schema)
