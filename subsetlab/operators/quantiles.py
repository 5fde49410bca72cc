"""Exact quantiles in passes: a group's values are never gathered, only counts of them.

Each wanted order statistic keeps the bounds between which it lies. A pass counts the values between the bounds in BUCKETS
equal steps, takes the step that holds the wanted rank, and moves the bounds to that step's own least and largest value.
A statistic is known once its bounds are equal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subsetlab.session import cut

#: Steps between the bounds. A pass makes at most so many counts for each group and statistic, in Spark.
BUCKETS = 4096


def _wanted(probabilities: list[float]) -> Column:
    """Return the ranks (from 0) of both neighbours of each quantile of ``_n`` values."""
    ranks = [f((F.col("_n") - 1) * F.lit(float(q))).cast("long") for q in probabilities for f in (F.floor, F.ceil)]
    return F.array_distinct(F.array(*ranks))


def order_statistics(rows: DataFrame, value: str, by: list[str], ranks: Column, buckets: int | None = None) -> DataFrame:
    """Return the ``by`` columns, rank (from 0), statistic and n: the values at ``ranks`` (an array made from _n) of each group.

    Nulls, NaN and infinite values are left out; a group without any other value gives no row. Null keys are a group.
    A pass reads the two columns once more and shuffles counts only: at most ``buckets`` rows a statistic and map task.
    Bounds shrink by a factor of ``buckets`` a pass where values are spread evenly; a pass always moves one of them.
    """
    buckets = buckets or BUCKETS
    keys = [f"_by{i}" for i in range(len(by))]
    x = F.col(value).cast("double")
    own = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], x.alias("_x"))
    ends = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    open_ones = ends.select(*keys, "_n", "_low", "_high", F.explode(ranks).alias("_rank")).withColumn("_below", F.lit(0).cast("long"))
    open_ones = cut(open_ones.where("_n > 0"))
    done = [open_ones.where("_low = _high")]
    open_ones = open_ones.where("_low < _high")
    while not open_ones.isEmpty():
        # Halves where the widest bounds overflow. Every step is monotonic, so the buckets are in the order of the values.
        wide = F.col("_high") - F.col("_low") == math.inf
        share = F.when(wide, (F.col("_x") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)).otherwise((F.col("_x") - F.col("_low")) / (F.col("_high") - F.col("_low")))
        step = F.floor(share * buckets)
        targets = open_ones.groupBy(*keys, "_low", "_high", "_below").agg(F.collect_set("_rank").alias("_ranks"))
        inside = (F.col("_x") >= F.col("_low")) & (F.col("_x") <= F.col("_high"))
        found = _matched(own, targets, keys).where(inside)
        counts = found.groupBy(*keys, "_low", "_high", "_below", "_ranks", F.least(step, F.lit(buckets - 1)).alias("_step"))
        counts = counts.agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        order = Window.partitionBy(*keys, "_low", "_high", "_below").orderBy("_step")
        counts = counts.withColumn("_upto", F.col("_below") + F.sum("_c").over(order))
        hit = counts.withColumn("_rank", F.explode("_ranks")).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
        moved = hit.select(*keys, "_rank", F.col("_a").alias("_low"), F.col("_b").alias("_high"), (F.col("_upto") - F.col("_c")).alias("_below"))
        moved = cut(moved)
        done.append(moved.where("_low = _high"))
        open_ones = moved.where("_low < _high")
    out = done[0].select(*keys, "_rank", "_low")
    for df in done[1:]:
        out = out.unionByName(df.select(*keys, "_rank", "_low"))
    sizes = ends.select(*keys, "_n")
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"o.{k}").eqNullSafe(F.col(f"s.{k}"))
    both = out.alias("o").join(sizes.alias("s"), same)
    return both.select(*[F.col(f"o.{k}").alias(c) for c, k in zip(by, keys, strict=True)], F.col("_rank").alias("rank"), F.col("_low").alias("statistic"), F.col("_n").alias("n"))


def _matched(own: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Join each value to the bounds of its group."""
    if not keys:
        return own.crossJoin(F.broadcast(targets))
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"v.{k}").eqNullSafe(F.col(f"w.{k}"))
    return own.alias("v").join(targets.alias("w"), same).select("w.*", "v._x")


def quantiles(rows: DataFrame, value: str, by: list[str], probabilities: list[float], buckets: int | None = None) -> DataFrame:
    """Return ``by``, q, n, and the exact linear, lower and higher quantiles of ``value`` in each group, a row for each q.

    lower and higher are the values on both sides of the place q (n - 1); linear lies between them by its fraction.
    What is left out, and memory: as in ``order_statistics``.
    """
    if not all(0 <= q <= 1 for q in probabilities):
        raise ValueError("probabilities lie between 0 and 1")
    known = order_statistics(rows, value, by, _wanted(probabilities), buckets)
    by_rank = known.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "statistic"))).alias("_of"), F.max("n").alias("n"))
    every = by_rank.select(*by, "n", "_of", F.explode(F.array(*[F.lit(float(q)) for q in probabilities])).alias("q"))
    place = (F.col("n") - 1) * F.col("q")
    at = lambda f: F.element_at("_of", f(place).cast("long"))
    lower, higher = at(F.floor), at(F.ceil)
    linear = lower + (higher - lower) * (place - F.floor(place))
    return every.select(*by, "q", "n", linear.alias("linear"), lower.alias("lower"), higher.alias("higher"))
