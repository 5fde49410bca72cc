"""Observed statistics of the confirmatory family C1 to C13 as queries, and the Holm adjustment.

Draws are reduced to counts by number, year, window, value or lag before anything else, so all that is left for the
last steps has a size that N, the grid of values or the number of windows bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subsetlab.functions import nulls
from subsetlab.model import K, MAIN, N, SUMS, long, main_array
from subsetlab.operators.describe import counted_numbers, draw_metrics, number_frequency, special_frequency
from subsetlab.operators.series import halo

LAGS = 10
OVERLAP_MEAN = K * K / N
#: Variance of the overlap of two draws.
OVERLAP_VARIANCE = K * (K / N) * ((N - K) / N) * ((N - K) / (N - 1))
MEDIAN_SUM = sum(SUMS) // 2
WINDOW, STEP = 170, 85


def chi2_main(draws: DataFrame) -> DataFrame:
    """C1: counts of main numbers against K n / N."""
    e = F.col("n") * K / N
    return counted_numbers(draws).agg(F.sum(F.pow(F.col("observed") - e, 2) / F.when(e > 0, e)).alias("statistic"))


def chi2_special(draws: DataFrame) -> DataFrame:
    """C2: counts of special numbers against n' / N."""
    f = special_frequency(draws, band=False)
    return f.agg(F.sum(F.pow(F.col("observed") - F.col("expected"), 2) / F.when(F.col("expected") > 0, F.col("expected"))).alias("statistic"))


def lag_overlap(draws: DataFrame, lags: int = LAGS, size: int | None = None) -> DataFrame:
    """C3: mean number of common numbers of draws ``lag`` apart, and its z score.

    A draw is one number with a bit for each of its numbers, so about one row a draw is shuffled: to its chunk, and the
    last ``lags`` of a chunk to the next. Common numbers are the bits that two draws share.
    """
    bits = F.lit(0).cast("long")
    for c in MAIN:
        bits = bits.bitwiseOR(F.expr(f"shiftleft(1L, cast({c} - 1 as int))"))
    rows = halo(draws.select("t", bits.alias("bits")), lags, size)
    w = Window.partitionBy("_chunk").orderBy("t")
    common = {h: F.bit_count(F.col("bits").bitwiseAND(F.max("bits").over(w.rangeBetween(-h, -h)))) for h in range(1, lags + 1)}
    shared = rows.withColumns({f"_c{h}": x for h, x in common.items()}).where("_own")
    sums = [F.struct(F.lit(h).cast("long").alias("lag"), F.coalesce(F.sum(f"_c{h}"), F.lit(0)).alias("c")) for h in common]
    every = shared.agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("x")).select("n", F.explode("x").alias("x")).select("n", "x.*").where("lag < n")
    out = every.select("lag", (F.col("c") / (F.col("n") - F.col("lag"))).alias("overlap"), "n")
    return out.withColumn("z", (F.col("overlap") - OVERLAP_MEAN) / F.sqrt(OVERLAP_VARIANCE / (F.col("n") - F.col("lag")))).drop("n")


def autocorrelation(draws: DataFrame, lags: int = LAGS) -> DataFrame:
    """C5: autocorrelations of the sums (centred, over the full sample's squares) and each one's share of Ljung-Box Q."""
    y = draw_metrics(draws).select("t", F.col("sum").cast("double").alias("y"))
    r = y.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m")).first()
    n, mean = r["n"], r["m"]
    c = y.select("t", (F.col("y") - mean).alias("c")) if n else y.select("t", F.col("y").alias("c"))
    later = c.select("t", F.col("c").alias("d"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(lags).cast("long"))).alias("lag"))
    sent = later.select((F.col("t") + F.col("lag")).alias("t"), "lag", "d")
    total = c.agg(F.sum(F.col("c") * F.col("c")).alias("s"))
    products = c.join(sent, "t").groupBy("lag").agg(F.sum(F.col("c") * F.col("d")).alias("x"))
    rh = F.when(F.col("s") > 0, F.col("x") / F.when(F.col("s") > 0, F.col("s")))
    out = products.crossJoin(F.broadcast(total)).select("lag", rh.alias("r"))
    return out.withColumn("q_part", n * (n + 2.0) * F.col("r") * F.col("r") / (n - F.col("lag")))


def runs(draws: DataFrame, centre: int = MEDIAN_SUM) -> DataFrame:
    """C6: runs of sums above and below ``centre``, ties left out: ties, n_plus, n_minus, runs, expected runs, statistic.

    Draws follow each other in chunks; a chunk gives its first and last side and its changes, and the few chunks are
    joined in order.
    """
    y = draw_metrics(draws).select("t", F.col("sum").alias("y"))
    ties = y.agg(F.count_if(F.col("y") == centre).alias("ties"))
    side = y.where(F.col("y") != centre).select("t", (F.col("y") > centre).cast("int").alias("up"), ((F.col("t") - 1) / 100_000).cast("long").alias("chunk"))
    w = Window.partitionBy("chunk").orderBy("t")
    part = side.withColumn("change", (F.lag("up").over(w) != F.col("up")).cast("int")).groupBy("chunk").agg(
        F.min_by("up", "t").alias("first"), F.max_by("up", "t").alias("last"), F.sum("change").alias("changes"), F.sum("up").alias("plus"), F.count(F.lit(1)).alias("n")
    )
    over = Window.orderBy("chunk")
    joined = part.withColumn("meets", (F.lag("last").over(over) != F.col("first")).cast("int"))
    s = joined.agg(F.coalesce(F.sum("plus"), F.lit(0)).alias("n_plus"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.coalesce(F.sum("changes"), F.lit(0)) + F.coalesce(F.sum("meets"), F.lit(0)) + 1).alias("runs"))
    minus = F.col("n") - F.col("n_plus")
    mu = F.when((F.col("n_plus") > 0) & (minus > 0), 1 + 2.0 * F.col("n_plus") * minus / F.when(F.col("n") > 0, F.col("n")))
    out = s.crossJoin(F.broadcast(ties)).select("ties", F.col("n_plus").cast("long").alias("n_plus"), minus.cast("long").alias("n_minus"), F.when(F.col("n") > 0, F.col("runs")).otherwise(0).cast("long").alias("runs"), mu.alias("mu"))
    return out.withColumn("statistic", F.abs(F.col("runs") - F.col("mu")))


def year_chi2(draws: DataFrame) -> DataFrame:
    """C7: counts by year against the year's share of each number's count. Draws go by t, so years must not fall."""
    rows = draws.withColumn("year", F.year("draw_date"))
    return _homogeneity(rows, draws, "year").agg(F.sum("part").alias("statistic"))


def _homogeneity(rows: DataFrame, draws: DataFrame, group: str) -> DataFrame:
    """Return (group, num, part): each cell's share of chi-squared for equal shares of numbers in all groups."""
    n = draws.count()
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    seen = rows.select(group, F.explode(main_array()).alias("num")).groupBy(group, "num").agg(F.count(F.lit(1)).alias("o"))
    total = long(draws).groupBy("num").agg(F.count(F.lit(1)).alias("f"))
    cells = sizes.withColumn("num", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(N).cast("long")))).join(F.broadcast(total), "num").join(seen, [group, "num"], "left")
    e = F.col("size") * F.col("f") / n
    return cells.select(group, "num", (F.pow(F.coalesce("o", F.lit(0)) - e, 2) / e).alias("part"))


def window_chi2(draws: DataFrame, width: int = WINDOW, step: int = STEP) -> DataFrame:
    """C8: chi-squared of each window of ``width`` draws, every ``step``. A draw goes to the windows it lies in."""
    n = draws.count()
    last = (n - width) // step
    if last < 0:
        return draws.sparkSession.createDataFrame([], "win long, x2 double")
    a = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("t") - width) / step))
    b = F.least(F.lit(last).cast("long"), F.floor((F.col("t") - 1) / step))
    rows = draws.where(a <= b).select(main_array().alias("main"), F.explode(F.sequence(a, b)).alias("win"))
    seen = rows.select("win", F.explode("main").alias("num")).groupBy("win", "num").agg(F.count(F.lit(1)).alias("o"))
    total = long(draws).groupBy("num").agg(F.count(F.lit(1)).alias("f"))
    cells = draws.sparkSession.range(last + 1).select(F.col("id").alias("win")).join(F.broadcast(total)).join(seen, ["win", "num"], "left")
    e = width * F.col("f") / n
    return cells.groupBy("win").agg(F.sum(F.pow(F.coalesce("o", F.lit(0)) - e, 2) / e).alias("x2"))


def ks_distance(draws: DataFrame, metric: str) -> DataFrame:
    """C9, C10: largest distance of the distribution of ``sum`` or ``range`` from its null, over all values."""
    pmf = nulls.PMFS[metric]()
    rows, total = [], 0.0
    for v, p in pmf.items():
        total += p
        rows.append((v, total))
    support = draws.sparkSession.createDataFrame(rows, "value long, f0 double")
    n = draws.count()
    counts = draw_metrics(draws).groupBy(F.col(metric).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    # As many rows as the metric has values.
    so_far = F.sum(F.coalesce("c", F.lit(0))).over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return F.broadcast(support).join(counts, "value", "left").select(F.abs(so_far / max(n, 1) - F.col("f0")).alias("d")).agg(F.max("d").alias("statistic"))


def cells_chi2(draws: DataFrame, metric: str) -> DataFrame:
    """C11 to C13: observed and expected counts of the test's pooled cells for ``odd``, ``low`` or ``consecutive``."""
    n = draws.count()
    cells = draws.sparkSession.createDataFrame([(x, a, b, p * n) for x, a, b, p in nulls.test_cells(metric, n)], "cell string, lo long, hi long, expected double")
    counts = draw_metrics(draws).groupBy(F.col(metric).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    found = F.broadcast(cells).join(counts, F.col("value").between(F.col("lo"), F.col("hi")), "left")
    out = found.groupBy("cell", "lo", "expected").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("observed"))
    return out.withColumn("part", F.pow(F.col("observed") - F.col("expected"), 2) / F.when(F.col("expected") > 0, F.col("expected")))


def holm(tests: DataFrame, p: str = "p", within: list[str] | None = None) -> DataFrame:
    """Add p_holm: the step-down adjustment of ``p`` among all rows, or within groups."""
    part = Window.partitionBy(*(within or []))
    order = part.orderBy(p)
    m, i = F.count(F.lit(1)).over(part), F.row_number().over(order)
    step = F.least(F.lit(1.0), (m - i + 1) * F.col(p))
    ranked = tests.withColumn("_step", step).withColumn("_i", i)
    return ranked.withColumn("p_holm", F.max("_step").over(part.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))).drop("_step", "_i")


def simulated_p(observed: Column, replicate: Column) -> Column:
    """Aggregate: (1 + number of replicates not below the observed value) / (replicates + 1); never 0."""
    return (1 + F.count_if(replicate >= observed)) / (F.count(replicate) + 1)


def mean_interval(draws: DataFrame, z: float = 1.96) -> DataFrame:
    """Return for sum, range, odd, low and consecutive: mean less the null's mean, and the normal 95 % interval of the mean."""
    m = draw_metrics(draws)
    names = ("sum", "range", "odd", "low", "consecutive")
    cells = F.array(*[F.struct(F.lit(x).alias("metric"), F.lit(nulls.moments(nulls.PMFS[x]())[0]).alias("null_mean"), F.col(x).cast("double").alias("v")) for x in names])
    rows = m.select(F.explode(cells).alias("x")).select("x.*")
    own = rows.groupBy("metric", "null_mean").agg(F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("se"))
    return own.select("metric", (F.col("mean") - F.col("null_mean")).alias("difference"), (F.col("mean") - z * F.col("se")).alias("lo"), (F.col("mean") + z * F.col("se")).alias("hi"))


def effects(draws: DataFrame) -> DataFrame:
    """Return (test, effect, value): the sizes that go with the statistics of C1 to C13, each from a few aggregated rows."""
    n, spread = draws.count(), (N - K)
    years = draws.select(F.year("draw_date").alias("y")).distinct().count()

    def named(df: DataFrame, test: str, **values: Column) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(k).alias("effect"), v.cast("double").alias("value")) for k, v in values.items()])
        return df.select(F.lit(test).alias("test"), F.explode(cells).alias("x")).select("test", "x.*")

    def by_lag(df: DataFrame, test: str, **values: Column) -> DataFrame:
        cells = F.array(*[F.struct(F.concat(F.lit(f"{k}_"), F.col("lag").cast("string")).alias("effect"), v.cast("double").alias("value")) for k, v in values.items()])
        return df.select(F.lit(test).alias("test"), F.explode(cells).alias("x")).select("test", "x.*")

    one, lag = F.col("statistic"), F.col("lag")
    out = [
        named(chi2_main(draws), "C1", dispersion_ratio=one / spread), named(number_frequency(draws, band=False).agg(F.max(F.abs("z")).alias("z")), "C1", max_abs_z=F.col("z")),
        named(chi2_special(draws), "C2", ratio=one / (N - 1)),
        by_lag(lag_overlap(draws), "C3", overlap_minus_null=F.col("overlap") - OVERLAP_MEAN, ci_halfwidth=1.96 * F.sqrt(OVERLAP_VARIANCE / (n - lag))),
        by_lag(autocorrelation(draws), "C5", r=F.col("r")), named(autocorrelation(draws).agg(F.max(F.abs("r")).alias("r")), "C5", max_abs_r=F.col("r"), ci_halfwidth=F.lit(1.96 / max(n, 1) ** 0.5)),
        named(runs(draws), "C6", runs=F.col("runs"), mu=F.col("mu"), n_plus=F.col("n_plus"), n_minus=F.col("n_minus"), n_ties=F.col("ties")),
        named(year_chi2(draws), "C7", cramers_v=F.when(F.lit(years) > 1, F.sqrt(one / (K * n * max(years - 1, 1))))),
    ]
    if n >= WINDOW + 2 * STEP:
        out.append(named(window_chi2(draws).agg(F.max("x2").alias("statistic")), "C8", v_roll=F.sqrt(one / (K * WINDOW))))
    means = mean_interval(draws)
    for test, metric in (("C9", "sum"), ("C10", "range"), ("C11", "odd"), ("C12", "low"), ("C13", "consecutive")):
        row = means.where(F.col("metric") == metric)
        out.append(named(row, test, mean_minus_null=F.col("difference"), **({"ci_lo": F.col("lo"), "ci_hi": F.col("hi")} if test in ("C9", "C10") else {})))
        if test in ("C11", "C12", "C13"):
            out.append(named(cells_chi2(draws, metric).agg(F.sum("part").alias("statistic")), test, w=F.sqrt(one / n)))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def special_ranks(draws: DataFrame) -> DataFrame:
    """Return rank and observed: how often the special number is the rank-th of those not drawn (every rank kept)."""
    special = F.col("special_number")
    rank = special - F.size(F.filter(main_array(), lambda x: x < special))
    counts = draws.where(special.isNotNull()).groupBy(rank.cast("long").alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    every = draws.sparkSession.range(1, N - K + 1).select(F.col("id").alias("rank"))
    return F.broadcast(every).join(counts, "rank", "left").select("rank", F.coalesce("n", F.lit(0)).alias("observed"))


def sum_bins(n: int) -> list[tuple[int, int, float]]:
    """Return first and last sum and chance of bins of ten, pooled from the ends for n draws."""
    pmf, last = nulls.sum_pmf(), SUMS[1]
    bins = {a: sum(pmf.get(v, 0.0) for v in range(a, a + 10)) for a in range(SUMS[0], last + 1, 10)}
    return [(a, min(b + 9, last), p) for a, b, p in nulls.merge_ends(bins, n)]


def exploratory(draws: DataFrame) -> DataFrame:
    """Return (name, statistic, df, p): unadjusted statistics; p is of chi-squared where it has that limit, else null.

    C1 scaled by (N - 1) / (N - K), Ljung-Box over 5, 10 and 20 lags, the special number's rank among the numbers not drawn,
    and sums in pooled bins of ten.
    """
    spark, n = draws.sparkSession, draws.count()
    scaled = chi2_main(draws).first()["statistic"] * (N - 1) / (N - K)
    rows = [("c1_scaled", float(scaled), N - 1, nulls.chi2_sf(scaled, N - 1))]
    parts = {r["lag"]: r["q_part"] for r in autocorrelation(draws, 20).collect()}
    for h in (5, 10, 20):
        q = sum(parts[k] for k in parts if k <= h)
        rows.append((f"ljung_box_{h}", q, h, nulls.chi2_sf(q, h)))
    ranks = [r["observed"] for r in special_ranks(draws).collect()]
    e = sum(ranks) / len(ranks)
    rows.append(("special_rank", sum((x - e) ** 2 / e for x in ranks) if e else float("nan"), N - K - 1, None))
    bins = spark.createDataFrame(sum_bins(n), "lo long, hi long, p double")
    sums = draw_metrics(draws).groupBy("sum").agg(F.count(F.lit(1)).alias("c"))
    found = F.broadcast(bins).join(sums, F.col("sum").between(F.col("lo"), F.col("hi")), "left").groupBy("lo", "p").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("o"))
    x2 = found.agg(F.sum(F.pow(F.col("o") - n * F.col("p"), 2) / (n * F.col("p"))).alias("x"), F.count(F.lit(1)).alias("k")).first()
    rows.append(("sum_bins", x2["x"], x2["k"] - 1, None))
    return spark.createDataFrame(rows, "name string, statistic double, df long, p double")
