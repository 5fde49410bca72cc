"""Descriptive tables of a series of draws (see ``subsetlab.model``), each next to its null reference.

Counts over time run in two levels: blocks of draws are summed up per number, and rows are summed within their block
(see ``series``). So a running count over any number of draws is spread over blocks, and a rolling one is the difference of two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subsetlab.functions import nulls
from subsetlab.model import K, LOW, MAIN, N, P_MAIN, P_SPECIAL, long, main_array, numbers
from subsetlab.operators import series
from subsetlab.session import ship

#: Draws in one block of a series of gaps.
BLOCK = 10_000
#: The chance of a pair in a draw.
P_PAIR = K * (K - 1) / (N * (N - 1))
METRICS = ["sum", "min", "max", "range", "odd", "low", "consecutive", "gap", "min_gap", "max_gap"]


def draw_metrics(draws: DataFrame) -> DataFrame:
    """Return per draw: sum, min, max, range, odd/even, low/high, the five gaps, consecutive pairs, least and largest gap.

    All of it is arithmetic on six columns, so it stays in one stage of generated code.
    """
    gaps = [F.col(b) - F.col(a) for a, b in zip(MAIN[:-1], MAIN[1:], strict=True)]
    out = {
        "sum": sum((F.col(c) for c in MAIN[1:]), F.col(MAIN[0])), "min": F.col(MAIN[0]), "max": F.col(MAIN[-1]), "range": F.col(MAIN[-1]) - F.col(MAIN[0]),
        "odd": sum((F.col(c) % 2 for c in MAIN[1:]), F.col(MAIN[0]) % 2), "low": sum(((F.col(c) <= LOW).cast("long") for c in MAIN[1:]), (F.col(MAIN[0]) <= LOW).cast("long")),
        **{f"gap_{i}": g for i, g in enumerate(gaps, 1)},
        "consecutive": sum(((g == 1).cast("long") for g in gaps[1:]), (gaps[0] == 1).cast("long")),
        "min_gap": F.least(*gaps), "max_gap": F.greatest(*gaps),
    }
    cols = [c.cast("long").alias(k) for k, c in out.items()]
    return draws.select("t", "draw_id", *cols).withColumns({"even": K - F.col("odd"), "high": K - F.col("low")})


def metric_values(draws: DataFrame) -> DataFrame:
    """Return t, metric and value: one row a draw and metric, five for the pooled gaps."""
    m = draw_metrics(draws)
    pairs = [F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in METRICS if k != "gap"]
    pairs += [F.struct(F.lit("gap").alias("metric"), F.col(f"gap_{i}").alias("value")) for i in range(1, K)]
    return m.select("t", F.explode(F.array(*pairs)).alias("x")).select("t", "x.metric", "x.value")


def metric_histogram(draws: DataFrame) -> DataFrame:
    return metric_values(draws).groupBy("metric", "value").agg(F.count(F.lit(1)).alias("observed"))


def metric_distribution(draws: DataFrame) -> DataFrame:
    """Return observed and expected counts of each metric's pooled cells, with a binomial band.

    Draws are counted by value first; a histogram has at most a few hundred rows, so cells are looked up there.
    """
    spark = draws.sparkSession
    n = draws.count()
    rows = []
    for metric in METRICS:
        trials = (K - 1) * n if metric == "gap" else n
        for place, (name, a, b, p) in enumerate(nulls.metric_cells(metric, trials)):
            rows.append((metric, place, name, a, b, p, p * trials, *nulls.binomial_band(trials, min(p, 1.0))))
    cells = spark.createDataFrame(rows, "metric string, place int, cell string, lo long, hi long, null_prob double, expected double, band_lo long, band_hi long")
    h = metric_histogram(draws)
    found = F.broadcast(cells).join(h.withColumnRenamed("metric", "m"), (F.col("m") == F.col("metric")) & F.col("value").between(F.col("lo"), F.col("hi")), "left")
    out = found.groupBy(*cells.columns).agg(F.coalesce(F.sum("observed"), F.lit(0)).alias("observed"))
    trials = F.when(F.col("metric") == "gap", F.lit((K - 1) * n)).otherwise(F.lit(n))
    return out.withColumn("share", F.when(trials > 0, F.col("observed") / trials)).orderBy("metric", "place")


def metric_summary(draws: DataFrame) -> DataFrame:
    """Return n, mean, sd (0 for one value) and linear quantiles of each metric, next to the null's moments and quantiles."""
    levels = [0.05, 0.25, 0.5, 0.75, 0.95]
    names = ["q05", "q25", "q50", "q75", "q95"]
    v = F.col("value").cast("double")
    own = metric_values(draws).groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.percentile(v, F.array(*map(F.lit, levels))).alias("q")
    )
    null = []
    for m in METRICS:
        pmf = nulls.PMFS[m]()
        null.append((m, *nulls.moments(pmf), *(nulls.quantile(pmf, q) for q in levels)))
    table = draws.sparkSession.createDataFrame(null, "metric string, null_mean double, null_sd double, " + ", ".join(f"null_{x} long" for x in names))
    cols = [F.col("q")[i].alias(x) for i, x in enumerate(names)]
    return own.select("metric", "n", "mean", "sd", *cols).join(F.broadcast(table), "metric")


def null_pmfs(spark: SparkSession) -> DataFrame:
    rows = [(m, v, p) for m in METRICS for v, p in nulls.PMFS[m]().items()]
    return spark.createDataFrame(rows, "metric string, value long, prob double")


def z_score(observed: Column, trials: Column, p: float) -> Column:
    """Return (observed - trials p) / sd, 0 where the sd is 0."""
    sd = F.sqrt(trials * (p * (1 - p)))
    return F.when(sd > 0, (observed - trials * p) / F.when(sd > 0, sd)).otherwise(0.0)


def wilson(x: Column, n: Column) -> tuple[Column, Column]:
    """Return the Wilson interval's ends, inside [0, 1]; (0, 0) without trials."""
    z, z2 = nulls.Z95, nulls.Z95 * nulls.Z95
    n = F.when(n > 0, n.cast("double"))
    share = x / n
    centre = (share + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.coalesce(F.greatest(centre - half, F.lit(0.0)), F.lit(0.0)), F.coalesce(F.least(centre + half, F.lit(1.0)), F.lit(0.0))


def _frequency(counted: DataFrame, p: float, band: int | None) -> DataFrame:
    """Return the table of counts (columns num, observed, n: out of how many); ``band``: for how many a band is added."""
    n = F.col("n")
    low, high = wilson(F.col("observed"), n)
    out = counted.select(
        F.col("num").alias("number"), "observed", F.coalesce(F.col("observed") / F.when(n > 0, n), F.lit(0.0)).alias("rel_freq"), low.alias("wilson_lo"), high.alias("wilson_hi"),
        (n * p).alias("expected"), z_score(F.col("observed"), n, p).alias("z"),
    )
    if band is not None:
        a, b = nulls.binomial_band(band, p)
        out = out.withColumns({"band_lo": F.lit(a).cast("long"), "band_hi": F.lit(b).cast("long")})
    return out


def counted_numbers(draws: DataFrame) -> DataFrame:
    """Return num, observed (zeros kept) and n, the number of draws: numbers are counted once, and a draw has K of them."""
    counts = long(draws).groupBy("num").agg(F.count(F.lit(1)).alias("n"))
    every = F.broadcast(numbers(draws)).join(counts, "num", "left").select("num", F.coalesce("n", F.lit(0)).alias("observed"))
    total = every.agg((F.sum("observed") / K).cast("long").alias("n"))
    return every.crossJoin(F.broadcast(total))


def number_frequency(draws: DataFrame, band: bool = True) -> DataFrame:
    """Count each number 1..N (zeros kept) with share, Wilson interval, expectation, binomial band and z."""
    return _frequency(counted_numbers(draws), P_MAIN, draws.count() if band else None)


def special_frequency(draws: DataFrame, band: bool = True) -> DataFrame:
    """The same for special numbers, over the draws that have one; n_missing counts the others."""
    counts = draws.groupBy(F.col("special_number").alias("num")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.coalesce(F.sum(F.when(F.col("num").isNotNull(), F.col("c"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("num").isNull(), F.col("c"))), F.lit(0)).alias("missing"))
    every = F.broadcast(numbers(draws)).join(counts, "num", "left").select("num", F.coalesce("c", F.lit(0)).alias("observed")).crossJoin(F.broadcast(total))
    out = _frequency(every, P_SPECIAL, draws.where(F.col("special_number").isNotNull()).count() if band else None)
    missing = F.broadcast(total.select(F.col("missing").alias("n_missing")))
    return out.crossJoin(missing)


def frequency_by_period(draws: DataFrame, kind: str) -> DataFrame:
    """Count numbers by ``year`` or ``quarter`` (zeros kept), with z and whether the series covers the period only in part."""
    day = F.col("draw_date")
    year, quarter = F.year(day), F.quarter(day)
    label = year.cast("string") if kind == "year" else F.concat(year.cast("string"), F.lit("-Q"), quarter.cast("string"))
    start = F.make_date(year, F.lit(1) if kind == "year" else quarter * 3 - 2, F.lit(1))
    rows = draws.select(main_array().alias("main"), label.alias("period"), start.alias("start"), day.alias("day"))
    # Draws are counted by period before periods meet all numbers: a few periods, N numbers.
    sizes = rows.groupBy("period", "start").agg(F.count(F.lit(1)).alias("draws"), F.min("day").alias("a"), F.max("day").alias("b"))
    ends = sizes.agg(F.min("a").alias("first"), F.max("b").alias("last"))
    counts = rows.select("period", F.explode("main").alias("num")).groupBy("period", "num").agg(F.count(F.lit(1)).alias("n"))
    every = sizes.withColumn("num", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(N).cast("long"))))
    out = every.join(counts, ["period", "num"], "left").crossJoin(F.broadcast(ends))
    stop = F.date_sub(F.add_months("start", 12 if kind == "year" else 3), 1)
    observed = F.coalesce("n", F.lit(0))
    return out.select(
        "period", F.col("num").alias("number"), "draws", observed.alias("observed"), (F.col("draws") * P_MAIN).alias("expected"),
        z_score(observed, F.col("draws"), P_MAIN).alias("z"), ((F.col("start") < F.col("first")) | (stop > F.col("last"))).alias("partial"),
    )


def running_counts(draws: DataFrame) -> DataFrame:
    """Return t, num, y and c: how often each number occurred up to and with draw t."""
    return counts_and_before(draws, ())


def cumulative_counts(draws: DataFrame) -> DataFrame:
    expected = F.col("t") * P_MAIN
    return running_counts(draws).select("t", F.col("num").alias("number"), F.col("c").alias("observed"), expected.alias("expected"))


def counts_and_before(draws: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """Return t, num, y, c (see ``running_counts``) and before_<w>: the count up to draw t - w (0 if there is none).

    Counts are made in chunks (see ``series``): a draw is shuffled as one row, and its N rows are made where they are used.
    """

    def work(chunk: series.Chunk) -> dict[str, np.ndarray]:
        out = {"t": np.repeat(chunk.t, N), "num": np.tile(np.arange(1, N + 1), len(chunk.t)), "y": chunk.y.ravel(), "c": chunk.c.ravel()}
        return out | {f"before_{w}": chunk.upto(w).ravel() for w in widths}

    names = ["t", "num", "y", "c", *(f"before_{w}" for w in widths)]
    return series.by_chunk(series.prepared(draws, max(widths, default=0)), work, ", ".join(f"{c} long" for c in names))


def rolling_counts(draws: DataFrame, width: int) -> DataFrame:
    """Return counts in the trailing ``width`` draws up to t, for t >= width, with z."""
    observed = F.col("c") - F.col(f"before_{width}")
    kept = counts_and_before(draws, (width,)).where(F.col("t") >= width)
    return kept.select("t", F.col("num").alias("number"), observed.alias("observed"), z_score(observed, F.lit(width), P_MAIN).alias("z"))


def rolling_extremes(draws: DataFrame, width: int) -> DataFrame:
    """Return the largest and the least z of each draw's window: z rises with the count, so they are those of two counts."""

    def work(chunk: series.Chunk) -> dict[str, np.ndarray]:
        observed = (chunk.c - chunk.upto(width))[chunk.t >= width]
        return {"t": chunk.t[chunk.t >= width], "most": observed.max(axis=1), "least": observed.min(axis=1)}

    ends = series.by_chunk(series.prepared(draws, width), work, "t long, most long, least long")
    return ends.select("t", *[z_score(F.col(a), F.lit(width), P_MAIN).alias(b) for a, b in (("most", "max_z"), ("least", "min_z"))])


def gaps(draws: DataFrame) -> DataFrame:
    """Return num, t and gap: draws since the number's last occurrence (none for the first).

    Occurrences are lagged within blocks of draws; a block gets the last one before it from the blocks' ends.
    """
    rows = long(draws).select("num", "t", ((F.col("t") - 1) / BLOCK).cast("long").alias("block"))
    earlier = Window.partitionBy("num").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("num", "block").agg(F.max("t").alias("end")).select("num", "block", F.max("end").over(earlier).alias("carried"))
    own = rows.withColumn("own", F.lag("t").over(Window.partitionBy("num", "block").orderBy("t")))
    gap = F.col("t") - F.coalesce("own", "carried")
    return own.join(ends, ["num", "block"]).select("num", "t", gap.alias("gap")).where(F.col("gap").isNotNull())


def expected_gaps(n: int, p: float = P_MAIN) -> list[tuple[str, int, int | None, float]]:
    """Return cells of gaps between occurrences in n draws: label, first and last gap, expected count.

    Single gaps run as far as at least five are expected; the rest is a tail, which joins the last single one if it
    is expected less than five times.
    """
    e = {g: N * (n - g) * p**2 * (1 - p) ** (g - 1) for g in range(1, n)}
    last = max((g for g, x in e.items() if x >= 5), default=0)
    if not last:
        return [(">=1", 1, None, sum(e.values()))]
    tail = sum(x for g, x in e.items() if g > last)
    single = last - 1 if 0 < tail < 5 else last
    cells = [(str(g), g, g, e[g]) for g in range(1, single + 1)]
    if tail > 0:
        cells.append((f">={single + 1}", single + 1, None, sum(x for g, x in e.items() if g > single)))
    return cells


def interarrival(draws: DataFrame) -> DataFrame:
    """Count gaps in the cells of ``expected_gaps``. Gaps are counted by length before cells are looked up."""
    cells = expected_gaps(draws.count())
    total = sum(c[3] for c in cells) or 1.0
    rows = [(i, c[0], c[1], c[2] if c[2] is not None else 1 << 62, c[3], c[3] / total) for i, c in enumerate(cells)]
    table = draws.sparkSession.createDataFrame(rows, "place int, cell string, lo long, hi long, expected double, null_share double")
    counts = gaps(draws).groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
    found = F.broadcast(table).join(counts, F.col("gap").between(F.col("lo"), F.col("hi")), "left")
    return found.groupBy("place", "cell", "expected", "null_share").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("observed")).orderBy("place")


def appearance_summary(draws: DataFrame) -> DataFrame:
    """Return for each number its first and last draw, and number, mean and sd of its gaps (null where undefined)."""
    seen = draws.select("t", "draw_id", F.explode(main_array()).alias("num")).groupBy("num").agg(
        F.min_by("draw_id", "t").alias("first_id"), F.max_by("draw_id", "t").alias("last_id")
    )
    g = F.col("gap").cast("double")
    own = gaps(draws).groupBy("num").agg(F.count(F.lit(1)).alias("n_gaps"), F.avg(g).alias("mean_gap"), F.stddev_samp(g).alias("sd_gap"))
    out = F.broadcast(numbers(draws)).join(seen, "num", "left").join(own, "num", "left")
    return out.select(F.col("num").alias("number"), "first_id", "last_id", F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), "mean_gap", "sd_gap")


def pair_counts(draws: DataFrame) -> DataFrame:
    """Count the draws that hold both a and b, for all pairs a < b (zeros kept), with z.

    A draw has 15 pairs, made without a join and counted where they are before the counts travel.
    """
    pairs = [F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for i, a in enumerate(MAIN) for b in MAIN[i + 1 :]]
    counts = draws.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    every = numbers(draws).select(F.col("num").alias("a"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(N).cast("long"))).alias("b")).where("a < b")
    # A draw has as many pairs as K numbers make.
    total = F.broadcast(counts.agg(F.coalesce(F.sum("n") / (K * (K - 1) // 2), F.lit(0.0)).cast("long").alias("draws")))
    out = F.broadcast(every).join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("observed")).crossJoin(total)
    return out.select("a", "b", "observed", (F.col("draws") * P_PAIR).alias("expected"), z_score(F.col("observed"), F.col("draws"), P_PAIR).alias("z"))


def pair_bands(draws: DataFrame) -> DataFrame:
    """Add to each pair's count the band that chance leaves it in (the same for all)."""
    a, b = nulls.binomial_band(draws.count(), P_PAIR)
    return pair_counts(draws).withColumns({"band_lo": F.lit(a).cast("long"), "band_hi": F.lit(b).cast("long")})


def pair_count_distribution(draws: DataFrame) -> DataFrame:
    """Return how many pairs occur how often, for all counts from the least to the largest, and how many are expected to."""
    h = pair_counts(draws).groupBy(F.col("observed").alias("count")).agg(F.count(F.lit(1)).alias("pairs"))
    ends = h.agg(F.min("count").alias("a"), F.max("count").alias("b"))
    every = ends.select(F.explode(F.sequence("a", "b")).alias("count"))
    out = every.join(h, "count", "left").select("count", F.coalesce("pairs", F.lit(0)).alias("pairs"))
    # A row for each count between two counts: few, as pairs are.
    n, pairs = draws.count(), N * (N - 1) // 2
    span = ends.first()
    rows = [(k, math.exp(nulls._log_binomial(n, P_PAIR, k))) for k in range(span["a"], span["b"] + 1)] if n else []
    null = draws.sparkSession.createDataFrame(rows, "count long, null_prob double")
    return out.join(F.broadcast(null), "count").withColumn("expected", F.col("null_prob") * pairs)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Return the logarithm of the gamma function of positive numbers, by Stirling's series from 10 on."""
    shift = np.zeros_like(x)
    x = x.copy()
    while (low := x < 10).any():
        shift[low] -= np.log(x[low])
        x[low] += 1
    inverse = 1 / (x * x)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse / 1188)))) / x
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series


#: Draws between two bands up to which one follows from the other, and nearness to a level at which it is worked out anew.
STEPS, NEAR = 200, 1e-9


def _band_ends(t: int, p: float, levels: tuple[float, ...]) -> list[tuple[int, float, float]]:
    """Return for each level the least count whose chance up to it is the level or more, that chance, and the count's own.

    Chances are added up from far below the mean, where nothing is left, to above the upper end.
    """
    spread = 12 * math.sqrt(t * p * (1 - p)) + 12
    x = np.arange(max(0, int(t * p - spread)), min(t, int(t * p + spread)) + 1, dtype=np.float64)
    own = np.exp(math.lgamma(t + 1) - log_gamma(x + 1) - log_gamma(t - x + 1) + x * math.log(p) + (t - x) * math.log1p(-p))
    cum = np.cumsum(own)
    at = np.minimum(np.searchsorted(cum, levels), len(x) - 1)
    return [(int(x[i]), float(cum[i]), float(own[i])) for i in at]


def _next_end(t: int, p: float, level: float, end: tuple[int, float, float]) -> tuple[int, float, float]:
    """Return the end for t + 1 draws from that for t: it is the same or one more, as one more draw adds one at most."""
    x, upto, own = end
    upto -= p * own
    own *= (t + 1) * (1 - p) / (t + 1 - x)
    if upto < level:
        own *= (t + 1 - x) / (x + 1) * p / (1 - p)
        x, upto = x + 1, upto + own
    return x, upto, own


def bands_by_draw(draws: DataFrame) -> DataFrame:
    """Return t, expected, band_lo and band_hi of a number's running count, for every draw.

    A band follows from that of the draw before in a few steps; the first of a run, and any whose end is so near to its level
    that rounding could decide it, is worked out from all chances.
    """
    p, levels = P_MAIN, (0.025, 0.975)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, last, ends = [], None, []
            for t in sorted(batch["t"].tolist()):
                if last is not None and t - last <= STEPS:
                    for s in range(last, t):
                        ends = [_next_end(s, p, level, end) for level, end in zip(levels, ends, strict=True)]
                    sure = all(abs(upto - level) > NEAR and abs(upto - own - level) > NEAR for level, (_, upto, own) in zip(levels, ends, strict=True))
                else:
                    sure = False
                if not sure:
                    ends = _band_ends(t, p, levels)
                last = t
                rows.append((t, t * p, ends[0][0], ends[1][0]))
            yield pd.DataFrame(rows, columns=["t", "expected", "band_lo", "band_hi"])

    ship(draws.sparkSession)
    return draws.select("t").mapInPandas(run, "t long, expected double, band_lo long, band_hi long")


def outside_bands(draws: DataFrame) -> DataFrame:
    """Return scope, cells, outside and expected: how many counts of numbers, special numbers and pairs lie outside their bands."""
    special = draws.where(F.col("special_number").isNotNull()).count()
    n, pairs = draws.count(), N * (N - 1) // 2
    out = None
    for scope, df, trials, p, cells in (("main", number_frequency(draws), n, P_MAIN, N), ("special", special_frequency(draws), special, P_SPECIAL, N), ("pairs", pair_bands(draws), n, P_PAIR, pairs)):
        one = cells_outside(df).select(F.lit(scope).alias("scope"), "cells", "outside", F.lit(expected_outside(trials, p, cells)).alias("expected"))
        out = one if out is None else out.unionByName(one)
    return out


def block_of(t: Column, n: int, blocks: int) -> Column:
    """Return the block (from 0) of draw t when n draws are cut into blocks whose first ones have one more draw."""
    q, r = divmod(n, blocks)
    edge = r * (q + 1)
    late = F.lit(r) + F.floor((t - 1 - edge) / max(q, 1))
    return F.when(t <= edge, F.floor((t - 1) / (q + 1))).otherwise(late).cast("long")


def correlations(vectors: DataFrame, key: list[str]) -> DataFrame:
    """Return Pearson correlations of all pairs of blocks (columns block, x and the key's); null if one is constant.

    A block's vector has as many entries as there are numbers or pairs of numbers, whatever the number of draws.
    """
    a, b = vectors.select(*key, F.col("block").alias("a"), F.col("x").alias("xa")), vectors.select(*key, F.col("block").alias("b"), F.col("x").alias("xb"))
    both = a.join(b, key).where("a < b")
    # Exact whole numbers, wide enough that no product passes them; only the last product is one of doubles.
    whole = "decimal(38,0)"
    n, sa, sb = F.count(F.lit(1)).cast(whole), F.sum("xa").cast(whole), F.sum("xb").cast(whole)
    product = lambda x, y: F.sum(F.col(x).cast(whole) * F.col(y).cast(whole)).cast(whole)
    cov = n * product("xa", "xb") - sa * sb
    spread = (n * product("xa", "xa") - sa * sa).cast("double") * (n * product("xb", "xb") - sb * sb).cast("double")
    return both.groupBy("a", "b").agg(cov.cast("double").alias("cov"), spread.alias("spread")).select(
        "a", "b", F.when(F.col("spread") > 0, F.col("cov") / F.sqrt(F.when(F.col("spread") > 0, F.col("spread")))).alias("r")
    )


def block_stability(draws: DataFrame, blocks: int, pairs: bool = False) -> DataFrame:
    """Correlate the counts of numbers, or of pairs, between contiguous blocks of draws."""
    n = draws.count()
    rows = draws.withColumn("block", block_of(F.col("t"), n, blocks))
    every = draws.sparkSession.range(blocks).select(F.col("id").alias("block"))
    span = F.sequence(F.lit(1).cast("long"), F.lit(N).cast("long"))
    cells = every.withColumn("num", F.explode(span))
    key = ["num"]
    if pairs:
        key = ["num", "other"]
        cells = cells.withColumn("other", F.explode(span)).where("num < other")
        structs = [F.struct(F.col(x).alias("num"), F.col(y).alias("other")) for i, x in enumerate(MAIN) for y in MAIN[i + 1 :]]
        counts = rows.select("block", F.explode(F.array(*structs)).alias("p")).select("block", "p.*")
    else:
        counts = rows.select("block", F.explode(main_array()).alias("num"))
    counts = counts.groupBy("block", *key).agg(F.count(F.lit(1)).alias("n"))
    return correlations(cells.join(counts, ["block", *key], "left").select("block", *key, F.coalesce("n", F.lit(0)).alias("x")), key)


def cells_outside(observed: DataFrame) -> DataFrame:
    """Count cells whose observed count lies outside its band (columns observed, band_lo, band_hi)."""
    out = (F.col("observed") < F.col("band_lo")) | (F.col("observed") > F.col("band_hi"))
    return observed.agg(F.count(F.lit(1)).alias("cells"), F.count_if(out).alias("outside"))


def expected_outside(n: int, p: float, cells: int) -> float:
    """Return how many of ``cells`` counts lie outside their band by chance."""
    a, b = nulls.binomial_band(n, p)
    inside = sum(math.exp(nulls._log_binomial(n, p, x)) for x in range(a, b + 1))
    return cells * (1 - inside)
