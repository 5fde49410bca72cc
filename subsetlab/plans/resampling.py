"""A block bootstrap of a long series: sums of blocks are made once, and only they meet the resamples.

No task or driver holds the series. A resample names the places where its blocks begin; a block's sum is looked up by its
place, so a resample costs one row a block, whatever the length of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subsetlab.model import with_ordinal
from subsetlab.operators.series import halo
from subsetlab.plans.montecarlo import SEED
from subsetlab.session import cut, ship

#: Resamples that one task draws the places of.
TOGETHER = 50


def block_sums(series: DataFrame, n: int, block: int, size: int | None = None) -> DataFrame:
    """Return config, start (from 0), length and total of the circular blocks of ``length`` in ``block`` and the tail's.

    ``series`` has config, i (0 to n - 1) and x. Blocks that begin near the end go on with the first rows. Rows are summed
    within chunks that hand their last rows on, so one row a value is shuffled.
    """
    tail = n - (-(-n // block) - 1) * block
    wrapped = series.unionByName(series.where(F.col("i") < block - 1).withColumn("i", F.col("i") + n))
    rows = halo(wrapped.withColumn("t", F.col("i") + 1).select("config", "t", "x"), block - 1, size) if block > 1 else wrapped.select("config", (F.col("i") + 1).alias("t"), "x", F.lit(0).alias("_chunk"), F.lit(True).alias("_own"))
    w = Window.partitionBy("config", "_chunk").orderBy("t")
    out = None
    for length in {block, tail}:
        total = F.sum("x").over(w.rangeBetween(-(length - 1), 0))
        own = rows.withColumn("total", total).where(F.col("_own") & (F.col("t") >= length) & (F.col("t") <= n + length - 1))
        own = own.select("config", (F.col("t") - length).alias("start"), F.lit(length).alias("length"), "total")
        out = own if out is None else out.unionByName(own)
    return out


def bootstrap_series(per_draw: DataFrame, column: str, block: int = 10, resamples: int = 10_000, seed: int = SEED, stream: int = 201, size: int | None = None) -> DataFrame:
    """Return config, mean, lo, hi (95 %), resamples of ``column`` (columns config, t), as ``montecarlo.bootstrap`` does, for any length.

    All configs have the same draws and share the resamples. A series shorter than a block raises; no rows give none. Each
    resample has a generator of its own, so results don't depend on how resamples are dealt.
    """
    spark = ship(per_draw.sparkSession)
    places = with_ordinal(per_draw.select("t").distinct().withColumn("_coarse", F.floor(F.col("t") / 1000)), "_coarse", "t", "_place")
    series = cut(per_draw.join(places.select("t", "_place"), "t").select("config", (F.col("_place") - 1).alias("i"), F.col(column).cast("double").alias("x")))
    by_config = series.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), (F.max("i") + 1).alias("last"))
    sizes = by_config.agg(F.min("n").alias("a"), F.max("n").alias("b"), F.max("last").alias("c")).first()
    n = sizes["a"] or 0
    if not n:
        return spark.createDataFrame([], "config string, mean double, lo double, hi double, resamples long")
    if {sizes["b"], sizes["c"]} != {n}:
        raise ValueError("configs differ in their draws")
    if n < block:
        raise ValueError(f"{n} draws are fewer than a block of {block}")
    blocks, tail = -(-n // block), n - (-(-n // block) - 1) * block

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch["id"]:
                starts = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, stream, int(r)]))).integers(0, n, blocks)
                length = np.full(blocks, block, np.int32)
                length[-1] = tail
                yield pd.DataFrame({"r": r, "start": starts, "length": length})

    wanted = spark.range(0, resamples, 1, -(-resamples // TOGETHER)).mapInPandas(run, "r long, start long, length int")
    # Spark takes the rows that Python makes for few and would send them all through the driver, so the join is a sorted one.
    totals = wanted.hint("merge").join(block_sums(series, n, block, size), ["start", "length"]).groupBy("r", "config").agg((F.sum("total") / n).alias("mean"))
    ends = totals.groupBy("config").agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    out = by_config.select("config", "mean").join(ends, "config")
    return out.select("config", "mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), F.lit(resamples).cast("long").alias("resamples"))
