"""Joins by order: the nearest row before or after (as-of), and points in intervals, both with two large sides.

Neither sends one side to every task, and no key has to fit into one task: an as-of join cuts the common order into
ranges and carries the last row over their borders, an interval join cuts intervals at the borders of buckets of their
own length and deals crowded buckets over parts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subsetlab.session import cut, ship

#: Rows of one bucket and side that one task takes; less than KEYS buckets have more.
ROWS, KEYS = 200_000, 100_000


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], take: list[str], direction: str = "backward", strict: bool = False, name: str = "match") -> DataFrame:
    """Add to each row of ``left`` the nearest row of ``right`` with equal ``by``: ``name``, a struct of ``on`` and ``take``, or null.

    backward looks for the largest ``on`` up to the row's own, forward for the smallest from there on; a ``strict`` join
    leaves out equal ones. Of several rows of ``right`` at that place the one with the largest (forward: smallest)
    ``take`` counts. Rows with a null in ``on`` or ``by`` match nothing; those of ``left`` stay. Repeated rows stay.

    Both sides are sorted together by key and ``on`` in range partitions. The last row of ``right`` in each range and key is
    handed on to the following ranges; a key with very many rows, or one instant with many, is just cut more often.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction is backward or forward, not {direction!r}")
    forward = direction == "forward"
    # Rows of both sides at one place: the one that is passed first in the direction of the join has to be looked up.
    first = 1 if forward == strict else 0
    keys = [f"_by{i}" for i in range(len(by))]
    whole = F.struct(*left.columns)
    known = F.struct(on, *take)
    kind = right.select(known.alias("m")).schema["m"].dataType
    usable = F.lit(True)
    for c in [on, *by]:
        usable &= F.col(c).isNotNull()
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    a = left.where(usable).select(*named, F.col(on).alias("_on"), F.lit(first).alias("_side"), F.lit(None).cast(kind).alias("_m"), F.xxhash64(whole).alias("_tie"), whole.alias("_row"))
    b = right.where(usable).select(*named, F.col(on).alias("_on"), F.lit(1 - first).alias("_side"), known.alias("_m"), F.lit(0).cast("long").alias("_tie"), F.lit(None).cast(left.select(whole.alias("r")).schema["r"].dataType).alias("_row"))
    order = [*keys, "_on", "_side", "_m", "_tie"]
    # What a range is follows from a sample, so it is settled before two jobs read it.
    rows = cut(a.unionByName(b).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    way = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    nearest = F.min if forward else F.max
    ends = rows.groupBy("_range", *keys).agg(nearest("_m").alias("_end"))
    before = Window.partitionBy(*keys).orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select("_range", *keys, F.last("_end", ignorenulls=True).over(before).alias("_handed"))
    within = Window.partitionBy("_range", *keys).orderBy(*map(way, order[len(keys) :])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumn("_own", F.last("_m", ignorenulls=True).over(within)).where("_row is not null")
    out = own.join(handed, ["_range", *keys]).select("_row.*", F.coalesce("_own", "_handed").alias(name))
    return out.unionByName(left.where(~F.coalesce(usable, F.lit(False))).withColumn(name, F.lit(None).cast(kind)))


def _ticks(df: DataFrame, column: str) -> Column:
    """Return a column of whole numbers, dates or instants as a long."""
    kind = df.select(F.col(column).alias("c")).schema["c"].dataType.typeName()
    if kind == "timestamp":
        return F.unix_micros(column)
    if kind == "timestamp_ntz":
        return F.unix_micros(F.col(column).cast("timestamp"))
    if kind == "date":
        return F.unix_date(column).cast("long")
    if kind in ("byte", "short", "integer", "long"):
        return F.col(column).cast("long")
    raise TypeError(f"{column} is a {kind}: whole numbers, dates or instants are needed")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, by: list[str] | None = None) -> DataFrame:
    """Return point and interval (structs of the sides' rows) for each point between ``low`` and ``high``, both included.

    ``by`` names columns that must be equal too. Nulls in these columns match nothing, nor do intervals that end before
    they begin. Repeated rows stay. An interval of length l is cut at the borders of buckets of the next power of four:
    two pieces at most, and every point of a bucket is tested against intervals of about its width only, so long
    intervals don't make many copies and short ones aren't tested against far points. A point is sent once for each
    length that occurs, 32 at most. A crowded bucket is dealt over a grid of parts of both sides.
    """
    by = by or []
    keys = [f"_by{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    usable = F.lit(True)
    for c in by:
        usable &= F.col(c).isNotNull()
    p = points.where(usable & F.col(at).isNotNull()).select(*named, _ticks(points, at).alias("_at"), F.struct(*points.columns).alias("point"))
    i = intervals.where(usable & (F.col(low) <= F.col(high))).select(*named, _ticks(intervals, low).alias("_low"), _ticks(intervals, high).alias("_high"), F.struct(*intervals.columns).alias("interval"))
    # Bits of the length, rounded up to an even number.
    i = i.withColumn("_bits", F.expr("cast(2 * ((length(bin(_high - _low)) + 1) div 2) as int)"))
    first, last = F.expr("shiftright(_low, _bits)"), F.expr("shiftright(_high, _bits)")
    i = i.withColumn("_bucket", F.explode(F.array_distinct(F.array(first, last))))
    sizes = i.select("_bits").distinct()
    p = p.crossJoin(F.broadcast(sizes)).withColumn("_bucket", F.expr("shiftright(_at, _bits)"))
    place = [*keys, "_bits", "_bucket"]
    p, i = _dealt(p, i, place)
    both = p.join(i, [*place, "_p", "_i"]).where((F.col("_at") >= F.col("_low")) & (F.col("_at") <= F.col("_high")))
    return both.select("point", "interval")


class Ranges:
    """Sums and least values of ranges of rows: sums by differences, least values from those of spans of 1, 2, 4, ... rows."""

    #: What no row has as its least value.
    NONE = np.iinfo(np.int64).max

    def __init__(self, sums: list[np.ndarray], least: np.ndarray) -> None:
        self.sums = [np.concatenate([[0], np.cumsum(x)]).astype(np.int64) for x in sums]
        self.spans = [least.astype(np.int64)]
        while 2 << (len(self.spans) - 1) <= len(least):
            half = 1 << (len(self.spans) - 1)
            self.spans.append(np.minimum(self.spans[-1][:-half], self.spans[-1][half:]))

    def of(self, a: np.ndarray, z: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Return the sums and least values of rows a to z - 1 (z at least a)."""
        least, size = np.full(len(a), self.NONE), z - a
        for k, span in enumerate(self.spans):
            here = np.flatnonzero((size >= 1 << k) & (size < 2 << k))
            least[here] = np.minimum(span[a[here]], span[z[here] - (1 << k)])
        return [x[z] - x[a] for x in self.sums], least


def interval_totals(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, value: str, rows: int = ROWS) -> DataFrame:
    """Return ``intervals`` (those that end where they begin or later) with n, least and total: how many points lie in each, both
    ends included, and the least and the sum of their whole-numbered ``value`` (null if none has one).

    No pair is made, so dense points cost no more: points are counted by instant and cut into buckets of about ``rows`` instants; an
    interval goes to the buckets of its two ends, and what lies between them comes from the few buckets' own totals. A
    bucket where very many intervals end is dealt over parts. Repeated rows stay. Sums that could pass 64 bits raise.
    """
    spark = ship(points.sparkSession)
    v = F.col(value).cast("long")
    found = points.where(F.col(at).isNotNull()).select(_ticks(points, at).alias("_at"), v.alias("_v")).groupBy("_at")
    instants = cut(found.agg(F.count(F.lit(1)).alias("n"), F.count("_v").alias("m"), F.sum("_v").alias("total"), F.min("_v").alias("least")))
    own = intervals.where(F.col(low) <= F.col(high))
    kept = cut(own.select(F.monotonically_increasing_id().alias("_id"), _ticks(own, low).alias("_low"), _ticks(own, high).alias("_high"), F.struct(*own.columns).alias("_row")))
    size = instants.agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("total").cast("decimal(38,0)"))).alias("s")).first()
    if (size["s"] or 0) > Ranges.NONE:
        raise OverflowError(f"sums of {value} pass 64 bits")
    parts = max(1, math.ceil(size["n"] / rows))
    # Where the borders lie decides how even the buckets are, not what is found.
    borders = np.unique(np.array(instants.approxQuantile("_at", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else [], np.int64))

    @F.pandas_udf("long")
    def bucket(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, x.to_numpy(), side="right").astype(np.int64))

    instants = instants.withColumn("_bucket", bucket("_at"))
    ends = kept.select("_id", "_low", "_high", bucket("_low").alias("_first"), bucket("_high").alias("_last"))
    ends = cut(ends.withColumn("_bucket", F.explode(F.array_distinct(F.array("_first", "_last")))))
    # A row a bucket, and there are as many as ``rows`` fits into the instants.
    sums = {r["_bucket"]: r for r in instants.groupBy("_bucket").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("total").alias("total"), F.min("least").alias("least")).collect()}
    column = lambda c, none: np.array([none if k not in sums or sums[k][c] is None else sums[k][c] for k in range(len(borders) + 1)], np.int64)
    whole = Ranges([column(c, 0) for c in ("n", "m", "total")], column("least", Ranges.NONE))
    crowd = [(r["_bucket"], math.ceil(r["count"] / rows)) for r in ends.groupBy("_bucket").count().collect()]
    dealt = F.broadcast(spark.createDataFrame(crowd, "_bucket long, _parts int"))
    instants = instants.join(dealt, "_bucket").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    ends = ends.join(dealt, "_bucket").withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int")).drop("_parts")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        x = left.sort_by("_at")
        place = x.column("_at").to_numpy()
        here = Ranges([x.column(c).fill_null(0).to_numpy() for c in ("n", "m", "total")], x.column("least").fill_null(Ranges.NONE).to_numpy())
        one = {c: right.column(c).to_numpy() for c in ("_id", "_low", "_high", "_first", "_last", "_bucket")}
        opens, closes = one["_first"] == one["_bucket"], one["_last"] == one["_bucket"]
        a = np.where(opens, np.searchsorted(place, one["_low"], side="left"), 0)
        z = np.where(closes, np.searchsorted(place, one["_high"], side="right"), len(place))
        (n, m, total), least = here.of(a, np.maximum(a, z))
        # What lies between the two ends' buckets is added where the interval begins.
        first = np.where(opens, one["_first"] + 1, 0)
        (n2, m2, total2), least2 = whole.of(first, np.where(opens, np.maximum(first, one["_last"]), 0))
        return pa.table({"_id": one["_id"], "n": n + n2, "m": m + m2, "total": total + total2, "least": np.minimum(least, least2)})

    each = instants.groupBy("_bucket", "_part").cogroup(ends.groupBy("_bucket", "_part")).applyInArrow(answer, "_id long, n long, m long, total long, least long")
    each = each.groupBy("_id").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("total").alias("total"), F.min("least").alias("least"))
    some = lambda c: F.when(F.col("m") > 0, F.col(c)).alias(c)
    return kept.select("_id", "_row").join(each, "_id").select("_row.*", "n", some("least"), some("total"))


def _dealt(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Deal the rows of both sides over a grid (_p, _i) where a key has many: every two rows with one key meet once."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    counts = a.select(*keys, one.alias("a"), none.alias("b")).unionByName(b.select(*keys, none.alias("a"), one.alias("b"))).groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = cut(counts.where("a > 0 and b > 0"))
    total = counts.agg(F.coalesce(F.sum(F.col("a") + F.col("b")), none).alias("n")).first()["n"]
    most = max(ROWS, total // KEYS)
    # Fewer keys than KEYS pass the limit on either side, so this has a bound.
    crowded = F.broadcast(counts.where((F.col("a") > most) | (F.col("b") > most)).select(*keys, F.ceil(F.col("a") / most).cast("int").alias("_ps"), F.ceil(F.col("b") / most).cast("int").alias("_is")))

    def deal(df: DataFrame, own: str, other: str, of: str, others: str) -> DataFrame:
        dealt = df.join(crowded, keys, "left")
        part = F.pmod(F.xxhash64(*df.columns), F.coalesce(F.col(of), F.lit(1))).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(others), F.lit(1)) - 1))
        return dealt.withColumn(own, part).withColumn(other, copies).drop("_ps", "_is")

    return deal(a, "_p", "_i", "_ps", "_is"), deal(b, "_i", "_p", "_is", "_ps")
