"""Monte Carlo references and the confirmatory family: replicates are the parallel dimension.

Replicate r of a stream uses the same random numbers wherever it is computed: the generator jumps to the place where
a sequential run would have been. So results don't depend on how replicates are dealt to tasks. A task turns its
replicates into one row of statistics each; draws of replicates never become rows.

Permutations draw a varying amount of random bits, so the driver runs through them once and hands each range of
replicates the generator's state where it begins.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsetlab.functions import nulls
from subsetlab.model import K, MAIN, N, SUMS
from subsetlab.operators.infer import LAGS, MEDIAN_SUM, OVERLAP_MEAN, OVERLAP_VARIANCE, STEP, WINDOW
from subsetlab.session import ship

SEED = 20260924
FRESH, PERMUTED, FRESH_MORE, PERMUTED_MORE = 101, 102, 1101, 1102
REFERENCE_MAIN, REFERENCE_SPECIAL = 1, 2
REPLICATES, MORE_REPLICATES = 10_000, 100_000
#: Level of the decisions, and an interval around it: if an adjusted p-value lies there, the family is computed again with more replicates.
LEVEL, ESCALATE = 0.05, (0.04, 0.06)
#: Draws that a kernel holds at once, and those of a block that are simulated in a processor's cache.
AT_ONCE, BLOCK = 60_000, 4_000


def generator(seed: int, stream: int, skip: int = 0) -> np.random.Generator:
    bits = np.random.PCG64(np.random.SeedSequence([seed, stream]))
    return np.random.Generator(bits.advance(skip) if skip else bits)


def simulate(rng: np.random.Generator, replicates: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Return main numbers (replicates x n x K, rising) and special ones, from N uniform numbers a draw."""
    order = rng.random((replicates * n, N)).argsort(axis=1)[:, : K + 1].astype(np.int16) + 1
    return np.sort(order[:, :K], axis=1).reshape(replicates, n, K), order[:, K].reshape(replicates, n)


def indicator(main: np.ndarray) -> np.ndarray:
    """Return n x N: whether each number is in each draw."""
    out = np.zeros((len(main), N))
    np.put_along_axis(out, main.astype(np.int64) - 1, 1.0, axis=1)
    return out


def overlaps(y: np.ndarray) -> np.ndarray:
    return np.array([(y[j:] * y[:-j]).sum() / (len(y) - j) for j in range(1, LAGS + 1)])


def ljung_box(sums: np.ndarray) -> tuple[float, np.ndarray]:
    c = sums - sums.mean()
    total = (c * c).sum()
    r = np.array([(c[h:] * c[:-h]).sum() for h in range(1, LAGS + 1)]) / total
    n = len(c)
    return float(n * (n + 2) * (r**2 / (n - np.arange(1, LAGS + 1))).sum()), r


def runs_statistic(sums: np.ndarray) -> float:
    up = sums[sums != MEDIAN_SUM] > MEDIAN_SUM
    plus, minus = int(up.sum()), int((~up).sum())
    if not plus or not minus:
        return float("nan")
    return abs(1 + int((up[1:] != up[:-1]).sum()) - (1 + 2 * plus * minus / (plus + minus)))


def distance(values: np.ndarray, metric: str) -> float:
    pmf = nulls.PMFS[metric]()
    first = min(pmf)
    counts = np.bincount(values.astype(np.int64) - first, minlength=len(pmf))
    return float(np.abs(np.cumsum(counts) / len(values) - np.cumsum(list(pmf.values()))).max())


def fit_cells(values: np.ndarray, metric: str, n: int) -> tuple[float, np.ndarray]:
    cells = nulls.test_cells(metric, n)
    observed = np.array([((values >= a) & (values <= b)).sum() for _, a, b, _ in cells], dtype=float)
    expected = np.array([p * n for *_, p in cells])
    return float(((observed - expected) ** 2 / expected).sum()), observed


def fresh_statistics(main: np.ndarray, special: np.ndarray) -> dict[str, float | list]:
    """Return the statistics of one data set whose null is chance: C1, C2, C3, C5, C6, C9 to C13, and their parts."""
    n = len(main)
    y = indicator(main)
    f = y.sum(axis=0)
    e = K * n / N
    s = np.bincount(special.astype(np.int64) - 1, minlength=N).astype(float)
    es = len(special) / N
    lag = overlaps(y)
    wide = main.astype(np.int64)
    sums = wide.sum(axis=1)
    gaps = np.diff(wide, axis=1)
    q, r = ljung_box(sums.astype(float))
    out: dict[str, float | list] = {
        "C1": float(((f - e) ** 2 / e).sum()), "C2": float(((s - es) ** 2 / es).sum()) if len(special) else float("nan"),
        "C3": float(((lag - OVERLAP_MEAN) ** 2 * (n - np.arange(1, LAGS + 1)) / OVERLAP_VARIANCE).sum()), "C5": q,
        "C6": runs_statistic(sums), "C9": distance(sums, "sum"), "C10": distance(wide[:, -1] - wide[:, 0], "range"),
    }
    for name, metric, values in (("C11", "odd", (wide % 2).sum(axis=1)), ("C12", "low", (wide <= 27).sum(axis=1)), ("C13", "consecutive", (gaps == 1).sum(axis=1))):
        out[name], cells = fit_cells(values, metric, n)
        out[f"{name}_parts"] = cells.tolist()
    return out | {"C3_parts": lag.tolist(), "C5_parts": r.tolist()}


def order_statistics(y: np.ndarray, years: np.ndarray) -> dict[str, float | list]:
    """Return what depends on the order of draws: overlaps (for C4), C7 by year, C8 by window, and parts."""
    n, f = len(y), y.sum(axis=0)
    by_year = []
    for year in np.unique(years):
        own = y[years == year]
        e = len(own) * f / n
        by_year.append(float(((own.sum(axis=0) - e) ** 2 / e).sum()))
    windows = []
    total = np.concatenate([np.zeros((1, N)), np.cumsum(y, axis=0)])
    for a in range(0, n - WINDOW + 1, STEP):
        e = WINDOW * f / n
        windows.append(float(((total[a + WINDOW] - total[a] - e) ** 2 / e).sum()))
    return {"overlap": overlaps(y).tolist(), "C7": float(sum(by_year)), "C7_parts": by_year, "C8": max(windows, default=float("nan")), "C8_parts": windows}


FRESH_SCHEMA = "replicate long, " + ", ".join(f"C{i} double" for i in (1, 2, 3, 5, 6, 9, 10, 11, 12, 13)) + ", C3_parts array<double>, C5_parts array<double>, C11_parts array<double>, C12_parts array<double>, C13_parts array<double>"
PERMUTED_SCHEMA = "replicate long, overlap array<double>, C7 double, C7_parts array<double>, C8 double, C8_parts array<double>"


def _ranges(spark: SparkSession, replicates: int) -> DataFrame:
    """Return ranges of replicates (first, count), about four to a core."""
    parts = max(1, min(replicates, 4 * spark.sparkContext.defaultParallelism))
    edges = [replicates * k // parts for k in range(parts + 1)]
    rows = [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return spark.createDataFrame(rows, "first long, count long").repartition(parts)


def _portions(first: int, count: int, n: int) -> Iterator[tuple[int, int]]:
    step = max(1, AT_ONCE // max(n, 1))
    for a in range(first, first + count, step):
        yield a, min(step, first + count - a)


def fresh(spark: SparkSession, n: int, n_special: int, replicates: int = REPLICATES, seed: int = SEED, stream: int = FRESH) -> DataFrame:
    """Return a row of statistics for each data set of n chance draws, whose first ``n_special`` have a special number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, count in batch.itertuples(index=False):
                for a, c in _portions(first, count, n):
                    main, special = simulate(generator(seed, stream, a * n * N), c, n)
                    yield pd.DataFrame([{"replicate": a + i} | fresh_statistics(main[i], special[i][:n_special]) for i in range(c)])[FRESH_COLUMNS]

    return _ranges(ship(spark), replicates).mapInPandas(run, FRESH_SCHEMA)


FRESH_COLUMNS = [x.split()[0] for x in FRESH_SCHEMA.split(", ")]


def permuted(spark: SparkSession, main: np.ndarray, years: np.ndarray, replicates: int = REPLICATES, seed: int = SEED, stream: int = PERMUTED) -> DataFrame:
    """Return a row of order statistics for each permutation of the draws; the series is a few bytes a draw, sent once."""
    sent = ship(spark).sparkContext.broadcast((main.astype(np.int16), years.astype(np.int16)))
    ranges = sorted((r["first"], r["count"]) for r in _ranges(spark, replicates).collect())
    rng, rows = generator(seed, stream), []
    for first, count in ranges:
        rows.append((first, count, pickle.dumps(rng.bit_generator.state)))
        for _ in range(count):
            rng.permutation(len(main))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, own_years = indicator(sent.value[0]), sent.value[1]
        for batch in batches:
            for first, count, state in batch.itertuples(index=False):
                rng = generator(seed, stream)
                rng.bit_generator.state = pickle.loads(state)
                yield pd.DataFrame([{"replicate": first + i} | order_statistics(y[rng.permutation(len(y))], own_years) for i in range(count)])

    dealt = spark.createDataFrame(rows, "first long, count long, state binary").repartition(len(rows))
    return dealt.mapInPandas(run, PERMUTED_SCHEMA)


#: Rows that a family's series may have: it is collected, as every permutation needs all of it.
SERIES = 200_000


def series(draws: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Return main numbers, special numbers (of draws that have one) and years, by t. At most SERIES draws."""
    rows = draws.orderBy("t").select(*MAIN, "special_number", F.year("draw_date").alias("year")).limit(SERIES + 1).toPandas()
    if len(rows) > SERIES:
        raise ValueError(f"a family is for {SERIES} draws at most")
    return rows[MAIN].to_numpy(np.int64), rows["special_number"].dropna().to_numpy(np.int64), rows["year"].to_numpy(np.int64)


def family(draws: DataFrame, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """Return test, statistic, replicate_mean, p, replicates, p_holm and decision of C1 to C13 (C8 only with three windows or more).

    If an adjusted p-value lies in ESCALATE, the whole family is computed again with ten times the replicates, on streams of its
    own. Those decide then; the first rows stay, with the decision ``superseded``.
    """
    from subsetlab.operators.infer import holm

    spark = draws.sparkSession
    main, special, years = series(draws)
    n = len(main)
    observed = fresh_statistics(main, special) | order_statistics(indicator(main), years)
    fresh_tests = ["C1", "C2", "C3", "C5", "C6", "C9", "C10", "C11", "C12", "C13"]
    windows = len(range(0, n - WINDOW + 1, STEP))

    def tested(count: int, streams: tuple[int, int]) -> dict[str, tuple[float, float, float]]:
        f = fresh(spark, n, len(special), count, seed, streams[0])
        cells = [F.array(F.avg(c), F.count_if(F.col(c) >= observed[c]).cast("double")).alias(c) for c in fresh_tests]
        row = f.agg(*cells).first()
        out = {c: (observed[c], row[c][0], (1 + row[c][1]) / (count + 1)) for c in fresh_tests}
        p = permuted(spark, main, years, count, seed, streams[1]).cache()
        lags = [F.struct(F.avg(F.col("overlap")[j]).alias("m"), F.stddev_pop(F.col("overlap")[j]).alias("s")).alias(f"l{j}") for j in range(LAGS)]
        m = p.agg(*lags).first()
        mean, sd = np.array([m[f"l{j}"]["m"] for j in range(LAGS)]), np.array([m[f"l{j}"]["s"] for j in range(LAGS)])
        own = float((((np.array(observed["overlap"]) - mean) / sd) ** 2).sum())
        z = F.array(*[F.pow((F.col("overlap")[j] - float(mean[j])) / float(sd[j]), 2) for j in range(LAGS)])
        total = F.aggregate(z, F.lit(0.0), lambda a, v: a + v)
        values = {"C4": (own, total), "C7": (observed["C7"], F.col("C7"))} | ({"C8": (observed["C8"], F.col("C8"))} if windows >= 3 else {})
        row = p.agg(*[F.array(F.avg(c), F.count_if(c >= o).cast("double")).alias(k) for k, (o, c) in values.items()]).first()
        p.unpersist()
        return out | {k: (o, row[k][0], (1 + row[k][1]) / (count + 1)) for k, (o, _) in values.items()}

    def table(count: int, streams: tuple[int, int]) -> DataFrame:
        rows = [(k, float(o), float(m), float(p), count) for k, (o, m, p) in sorted(tested(count, streams).items(), key=lambda x: int(x[0][1:]))]
        out = holm(spark.createDataFrame(rows, "test string, statistic double, replicate_mean double, p double, replicates long"))
        return out.withColumn("decision", F.when(F.col("p_holm") <= LEVEL, "reject").otherwise("not_reject"))

    first = table(replicates, (FRESH, PERMUTED))
    if replicates >= MORE_REPLICATES or not first.where(F.col("p_holm").between(*ESCALATE)).limit(1).count():
        return first
    return first.withColumn("decision", F.lit("superseded")).unionByName(table(10 * replicates, (FRESH_MORE, PERMUTED_MORE)))


def interpreted(parts: DataFrame, test: str, family: DataFrame) -> DataFrame:
    """Add to a follow-up whether its test was rejected: only then is it to be interpreted."""
    own = F.broadcast(family.where((F.col("test") == test) & (F.col("decision") != "superseded")).select(F.col("decision").alias("_d"), F.col("p_holm").alias("_p")))
    label = F.when(F.col("_d") == "reject", F.format_string("parent rejected (p_holm=%.5f)", "_p")).otherwise("parent not rejected; not interpreted")
    return parts.join(own, F.lit(True), "left").withColumn("interpretation", label).drop("_d", "_p")


def follow_up(draws: DataFrame, test: str, replicates: int = 1000, seed: int = SEED) -> DataFrame:
    """Return what a test is made of, each with its raw and Holm-adjusted p.

    Numbers for C1 and C2, lags for C3 to C5 (C4 against the permutations' means), years for C7, windows for C8, cells for C11 to C13.
    """
    from subsetlab.operators.infer import holm

    spark = draws.sparkSession
    main, special, years = series(draws)
    n = len(main)
    if test in ("C1", "C2"):
        counts = indicator(main).sum(axis=0) if test == "C1" else np.bincount(special - 1, minlength=N)
        trials, p = (n, K / N) if test == "C1" else (len(special), 1 / N)
        rows = [(str(k + 1), float(c), nulls.binomial_test(int(c), trials, p)) for k, c in enumerate(counts)]
    else:
        column = "overlap" if test == "C4" else f"{test}_parts"
        permutes = test in ("C4", "C7", "C8")
        observed = (order_statistics(indicator(main), years) if permutes else fresh_statistics(main, special))[column]
        reps = permuted(spark, main, years, replicates, seed) if permutes else fresh(spark, n, len(special), replicates, seed)
        centre = [OVERLAP_MEAN] * LAGS if test == "C3" else [0.0] * len(observed)
        if test == "C4":
            reps = reps.cache()
            means = reps.agg(*[F.avg(F.col(column)[j]).alias(f"m{j}") for j in range(LAGS)]).first()
            centre = [means[f"m{j}"] for j in range(LAGS)]
        if test.startswith("C1"):
            metric = {"C11": "odd", "C12": "low", "C13": "consecutive"}[test]
            centre = [p * n for *_, p in nulls.test_cells(metric, n)]
        over = [F.count_if(F.abs(F.col(column)[i] - centre[i]) >= abs(x - centre[i])).alias(f"k{i}") for i, x in enumerate(observed)]
        row = reps.agg(*over).first()
        rows = [(str(i + 1), float(x), (1 + row[f"k{i}"]) / (replicates + 1)) for i, x in enumerate(observed)]
    return holm(spark.createDataFrame(rows, "part string, observed double, p double"))


#: Streams of the exploratory p-values.
RANKS, BINS, MOST = 103, 104, 2000


def _blocks(n: int) -> Iterator[tuple[int, int]]:
    """Return begins and sizes of blocks of n draws: a task holds one of them, however long the series is."""
    for a in range(0, n, BLOCK):
        yield a, min(BLOCK, n - a)


def sum_counts(seed: int, stream: int, first: int, n: int) -> np.ndarray:
    """Return how often each sum (its place) occurs in replicate ``first`` of n draws, the same draws as ``simulate`` makes."""
    rng, out = generator(seed, stream, first * n * N), np.zeros(SUMS[1] + 1, np.int64)
    # A draw has the numbers of its K least chances; the offset tells how many were found.
    offset = SUMS[1] + 1
    number = np.arange(1, N + 1) + float(offset)
    for _, c in _blocks(n):
        x = rng.random((c, N))
        sums = ((x <= np.partition(x, K - 1, axis=1)[:, K - 1 : K]) @ number).astype(np.int64) - K * offset
        if sums.max() > SUMS[1]:
            # Equal chances: the order decides.
            sums = (x.argsort(axis=1)[:, :K] + 1).sum(axis=1)
        out += np.bincount(sums, minlength=len(out))
    return out


def rank_counts(rng: np.random.Generator, special: int) -> np.ndarray:
    """Return how often each rank among the numbers not drawn occurs in the next ``special`` ones."""
    out = np.zeros(N - K, np.int64)
    for _, c in _blocks(special):
        out += np.bincount(rng.integers(1, N - K + 1, c) - 1, minlength=N - K)
    return out


def _rank_states(spark: SparkSession, replicates: int, special: int, seed: int) -> DataFrame:
    """Return first, count and state: ranges of replicates, each with the state of the one generator of ranks at its begin.

    The driver runs through the generator once, a block at a time; ranges are the same rows whatever their number.
    """
    rng, rows = generator(seed, RANKS), []
    for first, count in sorted((r["first"], r["count"]) for r in _ranges(spark, replicates).collect()):
        rows.append((first, count, pickle.dumps(rng.bit_generator.state)))
        for _ in range(count):
            for _, c in _blocks(special):
                rng.integers(1, N - K + 1, c)
    return spark.createDataFrame(rows, "first long, count long, state binary").repartition(max(len(rows), 1))


def exploratory(draws: DataFrame, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """Add simulated p-values to the exploratory statistics that have no limit of their own, and how many replicates gave them (at most MOST).

    Both streams of numbers are those of one generator from begin to end, so results don't depend on how replicates are dealt.
    A task simulates its replicates block by block and keeps counts only, so series may have any length.
    """
    from subsetlab.operators import infer

    spark = ship(draws.sparkSession)
    r = draws.agg(F.count(F.lit(1)).alias("n"), F.count("special_number").alias("special")).first()
    n, special, count = r["n"], r["special"], min(replicates, MOST)
    bins = infer.sum_bins(n)
    edges, chances = np.array([a for a, _, _ in bins]), np.array([p for *_, p in bins])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Sums below the first edge don't occur.
        bin_of = np.maximum(np.searchsorted(edges, np.arange(SUMS[1] + 1), side="right") - 1, 0)
        for batch in batches:
            for first, own, state in batch.itertuples(index=False):
                rng = generator(seed, RANKS)
                rng.bit_generator.state = pickle.loads(state)
                rows = []
                for a in range(first, first + own):
                    o = np.bincount(bin_of, weights=sum_counts(seed, BINS, a, n), minlength=len(edges))
                    ranks, e = rank_counts(rng, special), special / (N - K)
                    rows.append((float(((o - n * chances) ** 2 / (n * chances)).sum()), float(((ranks - e) ** 2 / e).sum()) if special else float("nan")))
                yield pd.DataFrame(rows, columns=["sum_bins", "special_rank"])

    reps = _rank_states(spark, count, special, seed).mapInPandas(run, "sum_bins double, special_rank double")
    seen = infer.exploratory(draws).cache()
    own = {x["name"]: x["statistic"] for x in seen.collect()}
    row = reps.agg(*[F.count_if(F.col(c) >= own[c]).alias(c) for c in ("sum_bins", "special_rank")]).first()
    simulated = F.when(F.col("name") == "sum_bins", (1 + row["sum_bins"]) / (count + 1)).when(F.col("name") == "special_rank", (1 + row["special_rank"]) / (count + 1))
    return seen.withColumn("replicates", F.when(F.col("p").isNull() & simulated.isNotNull(), count)).withColumn("p", F.coalesce("p", simulated))


def pearson(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    spread = math.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / spread) if spread else float("nan")


def mc_reference(spark: SparkSession, n: int, n_special: int, widths: tuple[int, ...] = (50, 100, 200), replicates: int = REPLICATES, seed: int = SEED, blocks: int = 4) -> DataFrame:
    """Return bounds (name, lo, hi, mean, least, most) over replicates of n chance draws.

    Least and largest count of a number, of a pair and of a special number (quantiles of values that occur: the lower
    neighbour below, the higher one above); largest and smallest z of the numbers in one window of each width, and the correlations of
    numbers' and pairs' counts between blocks (linear quantiles).
    """
    meets = [(a, b) for a in range(blocks) for b in range(a + 1, blocks)]
    counted = ["min_count", "max_count", "min_pair", "max_pair"]
    smooth = [f"{k}_z_w{w}" for w in widths if w <= n for k in ("max", "min")] + [f"stability_{k}_{a}-{b}" for k in ("number", "pair") for a, b in meets]
    upper = np.triu_indices(N, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = K / N
        for batch in batches:
            for first, count in batch.itertuples(index=False):
                for a, c in _portions(first, count, n):
                    main, _ = simulate(generator(seed, REFERENCE_MAIN, a * n * N), c, n)
                    rows = []
                    for i in range(c):
                        y = indicator(main[i])
                        parts = np.array_split(y, blocks)
                        numbers = [x.sum(axis=0) for x in parts]
                        pairs = [(x.T @ x)[upper] for x in parts]
                        f, together = sum(numbers), sum(pairs)
                        values = [f.min(), f.max(), together.min(), together.max()]
                        for w in widths:
                            if w <= n:
                                z = (y[:w].sum(axis=0) - w * p) / np.sqrt(w * p * (1 - p))
                                values += [z.max(), z.min()]
                        rows.append(values + [pearson(v[j], v[k]) for v in (numbers, pairs) for j, k in meets])
                    yield pd.DataFrame(rows, columns=counted + smooth)

    def run_special(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, count in batch.itertuples(index=False):
                for a, c in _portions(first, count, n_special):
                    _, special = simulate(generator(seed, REFERENCE_SPECIAL, a * n_special * N), c, n_special)
                    counts = np.stack([np.bincount(x.astype(np.int64) - 1, minlength=N) for x in special])
                    yield pd.DataFrame({"min_special": counts.min(axis=1).astype(float), "max_special": counts.max(axis=1).astype(float)})

    rows = _ranges(ship(spark), replicates).mapInPandas(run, ", ".join(f"`{x}` double" for x in counted + smooth))
    special = _ranges(spark, replicates).mapInPandas(run_special, "min_special double, max_special double")

    def bounds(df: DataFrame, exact: list[str], linear: list[str]) -> DataFrame:
        # One number a replicate: a sorted array of them gives the exact neighbours of a quantile.
        cells = []
        for c in exact + linear:
            own = F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`"))
            order = F.array_sort(F.collect_list(own))
            at = lambda q, up: F.get(order, (F.ceil if up else F.floor)(F.lit(q) * (F.size(order) - 1)).cast("int"))  # noqa: E731, B023
            lo, hi = (at(0.025, False), at(0.975, True)) if c in exact else (F.percentile(own, F.lit(0.025)), F.percentile(own, F.lit(0.975)))
            cells.append(F.struct(F.lit(c).alias("name"), lo.alias("lo"), hi.alias("hi"), F.avg(own).alias("mean"), F.min(own).alias("least"), F.max(own).alias("most")))
        return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")

    return bounds(rows, counted, smooth).unionByName(bounds(special, ["min_special", "max_special"], []))


def bootstrap(per_draw: DataFrame, column: str, block: int = 10, resamples: int = 10_000, seed: int = SEED, stream: int = 201) -> DataFrame:
    """Return mean and 95 % interval of ``column`` by config (columns config, t), by circular blocks of consecutive draws.

    All configs share the resamples. A block's sum comes from running sums, so a resample costs as many look-ups as it has
    blocks. The scored draws are collected in the order of t (at most SERIES).
    """
    spark = ship(per_draw.sparkSession)
    wide = per_draw.groupBy("t").pivot("config").agg(F.first(column)).orderBy("t").limit(SERIES + 1).toPandas().drop(columns="t")
    if len(wide) > SERIES:
        raise ValueError(f"a bootstrap is for {SERIES} draws at most")
    configs, x = list(wide.columns), wide.to_numpy(np.float64)
    n = len(x)
    blocks, tail = -(-n // block), n - (-(-n // block) - 1) * block
    sent = spark.sparkContext.broadcast(np.concatenate([np.zeros((1, len(configs))), np.cumsum(np.concatenate([x, x[: block - 1]]) if n >= block else np.concatenate([x] * (block + 1))[: n + block - 1], axis=0)]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sent.value
        for batch in batches:
            for first, count in batch.itertuples(index=False):
                means = []
                for r in range(first, first + count):
                    starts = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, stream, r]))).integers(0, n, blocks)
                    own = total[starts[:-1] + block] - total[starts[:-1]]
                    means.append((own.sum(axis=0) + total[starts[-1] + tail] - total[starts[-1]]) / n)
                yield pd.DataFrame(np.array(means), columns=configs)

    reps = _ranges(spark, resamples).mapInPandas(run, ", ".join(f"`{c}` double" for c in configs))
    q = reps.agg(*[F.percentile(f"`{c}`", F.array(F.lit(0.025), F.lit(0.975))).alias(c) for c in configs]).first()
    rows = [(c, float(x[:, i].mean()), q[c][0], q[c][1], resamples) for i, c in enumerate(configs)]
    return spark.createDataFrame(rows, "config string, mean double, lo double, hi double, resamples long")


def bootstrap_ece(scored: DataFrame, block: int = 10, resamples: int = 1000, seed: int = SEED, stream: int = 201) -> DataFrame:
    """Return ECE and its 95 % interval by config: every resample of draws is binned again by its own deciles.

    The scored draws are collected in the order of t (at most SERIES). All configs need the same draws.
    """
    spark = ship(scored.sparkSession)
    if scored.select("t").distinct().limit(SERIES + 1).count() > SERIES:
        raise ValueError(f"a bootstrap is for {SERIES} draws at most")
    rows = scored.groupBy("config", "t").agg(F.array_sort(F.collect_list(F.struct("num", "p", "y"))).alias("x"))
    data = rows.select("config", "t", "x.p", "x.y").orderBy("t").toPandas()
    configs = sorted(data["config"].unique())
    if len(data) != len(configs) * data["t"].nunique():
        raise ValueError("configs differ in their draws")
    sent = spark.sparkContext.broadcast({c: tuple(np.stack(data.loc[data["config"] == c, k].to_numpy()) for k in ("p", "y")) for c in configs})
    n = int((data["config"] == configs[0]).sum())

    def calibration(p: np.ndarray, y: np.ndarray) -> float:
        p, y = p.ravel(), y.ravel()
        edges = np.unique(np.quantile(p, np.arange(1, 10) / 10))
        bins = np.searchsorted(edges, p, side="right")
        count = np.bincount(bins, minlength=len(edges) + 1)
        gap = np.abs(np.bincount(bins, p, len(edges) + 1) - np.bincount(bins, y, len(edges) + 1))
        return float(gap.sum() / count.sum())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, count in batch.itertuples(index=False):
                out = []
                for r in range(first, first + count):
                    starts = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, stream, r]))).integers(0, n, -(-n // block))
                    pick = ((starts[:, None] + np.arange(block)) % n).ravel()[:n]
                    out.append([calibration(p[pick], y[pick]) for p, y in (sent.value[c] for c in configs)])
                yield pd.DataFrame(out, columns=configs)

    reps = _ranges(spark, resamples).mapInPandas(run, ", ".join(f"`{c}` double" for c in configs))
    q = reps.agg(*[F.percentile(f"`{c}`", F.array(F.lit(0.025), F.lit(0.975))).alias(c) for c in configs]).first()
    out = [(c, calibration(*sent.value[c]), q[c][0], q[c][1], resamples) for c in configs]
    return spark.createDataFrame(out, "config string, ece double, lo double, hi double, resamples long")


#: What the experiment resamples, of a draw and config: log loss, Brier score, error of the sum forecast (also squared), clipped cells.
MEANS = ("log_loss", "brier", "mae", "rmse", "n_clipped")


def experiment(draws: DataFrame, resamples: int = 10_000, seed: int = SEED, block: int = 10) -> DataFrame:
    """Return (period, config, metric, draws, value, lo, hi) of the baseline experiment.

    Periods are the folds, all scored draws and the last of them as validation. Metrics are the means, RMSE and ECE, and the differences to
    B0; intervals are percentiles over circular blocks of draws. A period's resamples come from one generator, the same
    for every period and config, as in the published run; the driver runs through it once to hand each range of resamples its state.
    The scored draws are collected (at most SERIES). Without scored draws there are no rows.
    """
    from subsetlab.operators import baselines

    spark = ship(draws.sparkSession)
    n = draws.count()
    if n > SERIES:
        raise ValueError(f"an experiment is for {SERIES} draws at most")
    schema = "period string, config string, metric string, draws long, value double, lo double, hi double"
    if n <= baselines.INITIAL:
        return spark.createDataFrame([], schema)
    scored = baselines.scores(draws).where(F.col("t") > baselines.INITIAL).cache()
    per = baselines.draw_scores(scored).orderBy("config", "t").toPandas()
    chances = scored.groupBy("config", "t").agg(F.array_sort(F.collect_list(F.struct("num", "p", "y"))).alias("x")).select("config", "t", "x.p", "x.y").orderBy("config", "t").toPandas()
    scored.unpersist()
    configs = sorted(per["config"].unique())
    times = np.sort(per["t"].unique())
    own = {c: per[per["config"] == c] for c in configs}
    error = {c: (x["sum_actual"] - x["sum_forecast"]).to_numpy() for c, x in own.items()}
    x = np.stack([[own[c]["log_loss"], own[c]["brier"], np.abs(error[c]), error[c] ** 2, own[c]["n_clipped"]] for c in configs]).astype(np.float64)
    p, y = ([np.stack(chances.loc[chances["config"] == c, k].to_numpy()) for c in configs] for k in ("p", "y"))
    masks = {r["period"]: np.isin(times, r["ts"]) for r in baselines.periods(draws, n).groupBy("period").agg(F.collect_list("t").alias("ts")).collect()}
    sent = spark.sparkContext.broadcast({k: (x[:, :, m], [a[m] for a in p], [b[m] for b in y]) for k, m in masks.items()})
    base = configs.index("B0")

    def calibration(p: np.ndarray, y: np.ndarray) -> float:
        p, y = p.ravel(), y.ravel()
        edges = np.unique(np.quantile(p, np.arange(1, 10) / 10))
        bins = np.searchsorted(edges, p, side="right")
        return float(np.abs(np.bincount(bins, p, len(edges) + 1) - np.bincount(bins, y, len(edges) + 1)).sum() / len(p))

    def measures(means: np.ndarray, ece: list[float]) -> np.ndarray:
        """Return, by config, the metrics and their differences to B0 (log loss, Brier score, MAE, RMSE)."""
        out = means.copy()
        out[:, 3] = np.sqrt(out[:, 3])
        return np.concatenate([out, np.array(ece)[:, None], out[:, :4] - out[base, :4]], axis=1)

    names = [*MEANS, "ece", *[f"delta_{k}" for k in MEANS[:4]]]

    def starts_of(rng: np.random.Generator, size: int, count: int) -> np.ndarray:
        return rng.integers(0, size, size=(count, -(-size // block)))

    ranges = []
    for k, m in masks.items():
        size, rng = int(m.sum()), np.random.default_rng(seed)
        # More ranges for longer periods: a resample costs as much as it has draws.
        step = max(1, math.ceil(resamples / max(1, math.ceil(4 * spark.sparkContext.defaultParallelism * size / len(times)))))
        for first in range(0, resamples, step):
            count = min(step, resamples - first)
            ranges.append((k, count, pickle.dumps(rng.bit_generator.state)))
            starts_of(rng, size, count)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for period, count, state in batch.itertuples(index=False):
                means, p, y = sent.value[period]
                size, rng, rows = means.shape[2], np.random.default_rng(seed), []
                rng.bit_generator.state = pickle.loads(state)
                for starts in starts_of(rng, size, count):
                    pick = ((starts[:, None] + np.arange(block)) % size).ravel()[:size]
                    rows.append(measures(means[:, :, pick].mean(axis=2), [calibration(a[pick], b[pick]) for a, b in zip(p, y, strict=True)]).ravel().tolist())
                yield pd.DataFrame({"period": period, "values": rows})

    def summarised(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One period's resamples: as many rows as were asked for, whatever the number of draws."""
        means, p, y = sent.value[key[0]]
        low, high = np.percentile(np.stack(rows["values"].to_numpy()), [2.5, 97.5], axis=0)
        value = measures(means.mean(axis=2), [calibration(a, b) for a, b in zip(p, y, strict=True)])
        value[:, 4] = means[:, 4].sum(axis=1)
        cells = [(key[0], c, k, means.shape[2], v) for c, row in zip(configs, value, strict=True) for k, v in zip(names, row, strict=True)]
        return pd.DataFrame(cells, columns=["period", "config", "metric", "draws", "value"]).assign(lo=low, hi=high)

    dealt = spark.createDataFrame(ranges, "period string, count long, state binary").repartition(len(ranges))
    reps = dealt.mapInPandas(run, "period string, values array<double>")
    return reps.groupBy("period").applyInPandas(summarised, schema)
