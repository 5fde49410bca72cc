"""Baseline scores for the next draw, and how they are judged.

Each configuration gives every number a probability for draw t from the draws before t alone: B0 is K / N, B1 uses all
of them, B2 the last W, both with one pseudo-count a number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subsetlab.model import K, N
from subsetlab.operators import series
from subsetlab.operators.describe import counts_and_before
from subsetlab.session import cut

WIDTHS = (50, 100, 200)
CLIP = 1e-6
INITIAL, STEP, VALIDATION = 500, 50, 210
CONFIGS = ("B0", "B1", *(f"B2_w{w}" for w in WIDTHS))
#: Bits of a chance that one pass over the scores settles.
DIGIT = 12


def scores(draws: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Return config, t, num, y and p. Counts before t are running counts less draw t's own; windows are differences."""
    seen, c = F.col("t") - 1, F.col("c") - F.col("y")
    chances = {"B0": F.lit(K / N), "B1": K * (c + 1.0) / (K * seen + N)}
    # The last w draws before t begin after draw t - w - 1.
    chances |= {f"B2_w{w}": K * (c - F.col(f"before_{w + 1}") + 1.0) / (K * F.least(F.lit(w), seen) + N) for w in widths}
    every = F.array(*[F.struct(F.lit(k).alias("config"), p.alias("p")) for k, p in chances.items()])
    return counts_and_before(draws, tuple(w + 1 for w in widths)).select("t", "num", "y", F.explode(every).alias("x")).select("x.config", "t", "num", "y", "x.p")


def clipped(p: Column) -> Column:
    return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))


def draw_scores(scored: DataFrame) -> DataFrame:
    """Return per config and draw: log loss (clipped), Brier score, sum of p, forecast and actual sum, clipped cells."""
    p, y = F.col("p"), F.col("y")
    loss = -(y * F.log(clipped(p)) + (1 - y) * F.log(1 - clipped(p)))
    return scored.groupBy("config", "t").agg(
        F.avg(loss).alias("log_loss"), F.avg(F.pow(p - y, 2)).alias("brier"), F.sum("p").alias("sum_p"), F.sum(F.col("num") * p).alias("sum_forecast"),
        F.sum(F.col("num") * y).alias("sum_actual"), F.count_if((p < CLIP) | (p > 1 - CLIP)).alias("n_clipped"),
    )


def _width(config: str) -> int:
    """Return how many draws before the last ones a config looks back over (0: it has no window)."""
    return int(config.removeprefix("B2_w")) if config.startswith("B2_w") else 0


def _chances(chunk: series.Chunk, configs: tuple[str, ...]) -> Iterator[tuple[str, np.ndarray]]:
    """Give each config's chances (draws x N) in a chunk, by the arithmetic of ``scores``."""
    seen, c = (chunk.t - 1)[:, None], chunk.c - chunk.y
    for config in configs:
        w = _width(config)
        if config == "B0":
            yield config, np.full(c.shape, K / N)
        elif config == "B1":
            yield config, K * (c + 1.0) / (K * seen + N)
        elif w:
            yield config, K * (c - chunk.upto(w + 1) + 1.0) / (K * np.minimum(w, seen) + N)
        else:
            raise ValueError(f"no config {config!r}")


def _handed(configs: tuple[str, ...]) -> int:
    return max((_width(c) + 1 for c in configs), default=0)


def scored_draws(draws: DataFrame, configs: tuple[str, ...] = CONFIGS) -> DataFrame:
    """Return ``draw_scores`` of ``scores`` for these configs. A draw's N scores are added up where its chunk is counted: none is shuffled."""
    num = np.arange(1, N + 1)

    def work(chunk: series.Chunk) -> dict[str, np.ndarray]:
        found: dict[str, list] = {}
        for config, p in _chances(chunk, configs):
            q = np.clip(p, CLIP, 1 - CLIP)
            one = {
                "config": np.repeat(config, len(p)), "t": chunk.t, "log_loss": -np.where(chunk.y == 1, np.log(q), np.log(1 - q)).mean(axis=1), "brier": ((p - chunk.y) ** 2).mean(axis=1),
                "sum_p": p.sum(axis=1), "sum_forecast": (num * p).sum(axis=1), "sum_actual": (num * chunk.y).sum(axis=1), "n_clipped": ((p < CLIP) | (p > 1 - CLIP)).sum(axis=1),
            }
            for k, v in one.items():
                found.setdefault(k, []).append(v)
        return {k: np.concatenate(v) for k, v in found.items()}

    schema = "config string, t long, log_loss double, brier double, sum_p double, sum_forecast double, sum_actual long, n_clipped long"
    return series.by_chunk(series.prepared(draws, _handed(configs)), work, schema)


def calibration(draws: DataFrame, configs: tuple[str, ...] = CONFIGS, after: int = INITIAL) -> DataFrame:
    """Return ``reliability`` of ``scores`` by config for the draws after ``after``, for series of any length.

    Edges come from exact order statistics: a positive double's bits are in the order of its value, so each pass over the chunks
    settles DIGIT more of them, by counts. No config's chances are gathered; a pass gives up to 2 ** DIGIT counts a chunk and rank.
    """
    rows, bases = series.prepared(draws, _handed(configs))
    # Passes read chunks again, so the draws are derived once.
    parts = cut(rows), cut(bases)
    spark = draws.sparkSession

    def bits(chunk: series.Chunk) -> Iterator[tuple[int, np.ndarray]]:
        for k, (_, p) in enumerate(_chances(chunk, configs)):
            yield k, p[chunk.t > after].ravel().view(np.int64)

    def sizes(chunk: series.Chunk) -> dict[str, np.ndarray]:
        return {"k": np.arange(len(configs)), "n": np.full(len(configs), N * int((chunk.t > after).sum()))}

    n = {r["k"]: r["n"] for r in series.by_chunk(parts, sizes, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect() if r["n"]}
    places = {k: [(m - 1) * (d / 10) for d in range(1, 10)] for k, m in n.items()}
    # For each wanted rank: the leading bits of its value, and its rank among values that share them.
    known = {(k, r): (0, r) for k in n for x in places[k] for r in (int(np.floor(x)), int(np.ceil(x)))}
    shift = 64
    while known and shift:
        above, shift = shift, max(0, shift - DIGIT)
        wanted = {k: np.unique([v for (j, _), (v, _) in known.items() if j == k]) for k in n}

        def counts(chunk: series.Chunk, above: int = above, shift: int = shift, wanted: dict = wanted) -> dict[str, np.ndarray]:
            found = [(np.zeros(0, np.int64),) * 3]
            for k, x in bits(chunk):
                if len(x):
                    head = x >> shift
                    inside = head[np.isin(head >> (above - shift), wanted[k])] if above < 64 else head
                    value, c = np.unique(inside, return_counts=True)
                    found.append((np.full(len(value), k), value, c))
            return {name: np.concatenate(v) for name, v in zip(("k", "head", "c"), zip(*found, strict=True), strict=True)}

        each = series.by_chunk(parts, counts, "k long, head long, c long").groupBy("k", "head").agg(F.sum("c").alias("c"))
        # Ranks that share their leading bits share these counts: 18 times 2 ** DIGIT a config at most.
        order = Window.partitionBy("k", F.shiftright("head", above - shift) if above < 64 else F.lit(0)).orderBy("head")
        upto = each.withColumn("upto", F.sum("c").over(order))
        ranks = spark.createDataFrame([(k, r, v, own) for (k, r), (v, own) in known.items()], "k long, r long, v long, own long")
        same = (F.shiftright("head", above - shift) if above < 64 else F.lit(0).cast("long")) == F.col("v")
        hit = upto.join(F.broadcast(ranks), "k").where(same & (F.col("own") < F.col("upto")) & (F.col("own") >= F.col("upto") - F.col("c")))
        known = {(x["k"], x["r"]): (x["head"], x["own"] - (x["upto"] - x["c"])) for x in hit.select("k", "r", "head", "own", "upto", "c").collect()}
    value = {key: float(np.int64(v).view(np.float64)) for key, (v, _) in known.items()}
    edges = {}
    for k, found in places.items():
        ends = [(x, value[k, int(np.floor(x))], value[k, int(np.ceil(x))]) for x in found]
        edges[k] = np.unique([a if a == b else (np.ceil(x) - x) * a + (x - np.floor(x)) * b for x, a, b in ends])

    def binned(chunk: series.Chunk) -> dict[str, np.ndarray]:
        here = chunk.t > after
        y, out = chunk.y[here].ravel(), {c: [] for c in ("config", "bin", "n", "p", "y", "min_p", "max_p")}
        for k, (config, every) in enumerate(_chances(chunk, configs)):
            p = every[here].ravel()
            if not len(p):
                continue
            place = np.searchsorted(edges[k], p, side="right")
            for b in np.unique(place):
                own = place == b
                for c, v in zip(out, (config, b, own.sum(), p[own].sum(), y[own].sum(), p[own].min(), p[own].max()), strict=True):
                    out[c].append(v)
        kinds = (str, np.int64, np.int64, np.float64, np.int64, np.float64, np.float64)
        return {c: np.array(v, kind) for (c, v), kind in zip(out.items(), kinds, strict=True)}

    bins = series.by_chunk(parts, binned, "config string, bin long, n long, p double, y long, min_p double, max_p double").groupBy("config", "bin")
    return bins.agg(F.sum("n").alias("n"), (F.sum("p") / F.sum("n")).alias("mean_p"), (F.sum("y") / F.sum("n")).alias("mean_y"), F.min("min_p").alias("min_p"), F.max("max_p").alias("max_p"))


def folds(n: int, initial: int = INITIAL, step: int = STEP, validation: int = VALIDATION) -> list[dict[str, int]]:
    """Return expanding folds: fitted on 1..fit_last, scored on first..last; the last one may be short.

    The inner validation is the last hundred draws of what is fitted.
    """
    out = []
    for k, a in enumerate(range(initial + 1, n + 1, step), 1):
        out.append({"fold": k, "fit_last": a - 1, "inner_first": a - 100, "inner_last": a - 1, "first": a, "last": min(a + step - 1, n)})
    return out


def periods(draws: DataFrame, n: int) -> DataFrame:
    """Return t and period: its fold, dev_pooled (all scored draws), and validation (the last of them); one row for each."""
    return in_periods(draws.select("t"), n)


def in_periods(per_draw: DataFrame, n: int) -> DataFrame:
    """Give each row of ``per_draw`` (with t) once for each of its ``periods``: they follow from t, so nothing is joined."""
    t = F.col("t")
    fold = F.floor((t - INITIAL - 1) / STEP) + 1
    names = F.array_compact(F.array(F.format_string("fold_%02d", fold.cast("int")), F.lit("dev_pooled"), F.when(t > n - VALIDATION, F.lit("validation"))))
    return per_draw.where((t > INITIAL) & (t <= n)).withColumn("period", F.explode(names))


def period_metrics(per_draw: DataFrame, membership: DataFrame | None = None) -> DataFrame:
    """Return per config and period: mean log loss and Brier, MAE and RMSE of the sum forecast, clipped cells, draws.

    Without ``membership``, ``per_draw`` has a period (see ``in_periods``).
    """
    e = F.col("sum_forecast") - F.col("sum_actual")
    both = per_draw if membership is None else per_draw.join(membership, "t")
    return both.groupBy("config", "period").agg(
        F.count(F.lit(1)).alias("draws"), F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.sum("n_clipped").alias("n_clipped"),
    )


def deltas(per_draw: DataFrame, membership: DataFrame | None = None, base: str = "B0") -> DataFrame:
    """Return differences to the base config over paired draws, by config and period: of the mean losses, and of the RMSE of the sum forecast.

    A draw's configs meet once, by t. Without ``membership``, ``per_draw`` has a period (see ``in_periods``).
    """
    error = F.col("sum_forecast") - F.col("sum_actual")
    both = per_draw if membership is None else per_draw.join(membership, "t")
    own = both.select("config", "t", "period", "log_loss", "brier", (error * error).alias("square"))
    draw = Window.partitionBy("t", "period")
    paired = own.withColumns({f"b_{c}": F.max(F.when(F.col("config") == base, F.col(c))).over(draw) for c in ("log_loss", "brier", "square")})
    return paired.where((F.col("config") != base) & F.col("b_square").isNotNull()).groupBy("config", "period").agg(
        *[F.avg(F.col(c) - F.col(f"b_{c}")).alias(f"delta_{c}") for c in ("log_loss", "brier")],
        (F.sqrt(F.avg("square")) - F.sqrt(F.avg("b_square"))).alias("delta_rmse"),
    )


def reliability(scored: DataFrame, group: list[str]) -> DataFrame:
    """Return calibration bins of p by deciles (equal edges are one; bin = edges not above p): n, mean p, mean y, least and largest p.

    p has few distinct values per draw, so rows are counted by (group, p) first; the quantiles use these counts.
    """
    counted = scored.groupBy(*group, "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    levels = F.array(*[F.lit(k / 10) for k in range(1, 10)])
    edges = counted.groupBy(*group).agg(F.array_distinct(F.percentile("p", levels, F.col("n"))).alias("edges"))
    found = counted.join(F.broadcast(edges), group) if group else counted.crossJoin(F.broadcast(edges))
    binned = found.withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("p"))).cast("long"))
    return binned.groupBy(*group, "bin").agg(
        F.sum("n").alias("n"), (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_p"), (F.sum("y") / F.sum("n")).alias("mean_y"), F.min("p").alias("min_p"), F.max("p").alias("max_p")
    )


def ece(bins: DataFrame, group: list[str]) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))
    return bins.groupBy(*group).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def select_width(losses: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Return the largest width whose loss (columns width, loss) is within ``tolerance`` of the least."""
    least = losses.agg(F.min("loss").alias("least"))
    return losses.crossJoin(F.broadcast(least)).where(F.col("loss") <= F.col("least") + tolerance).agg(F.max("width").alias("width"))


def null_excess(m: int) -> tuple[float, float]:
    """Return the exact expected excess of log loss and Brier score over B0, of smoothed counts from m draws of chance.

    A number's count is Binomial(m, K / N), and does not depend on the draw that is scored.
    """
    import math

    from subsetlab.functions.nulls import _log_binomial

    p0 = K / N
    loss = brier = 0.0
    for c in range(m + 1):
        w = math.exp(_log_binomial(m, p0, c)) if m else 1.0
        p = K * (c + 1) / (K * m + N)
        loss += w * (p0 * math.log(p0 / p) + (1 - p0) * math.log((1 - p0) / (1 - p)))
        brier += w * (p - p0) ** 2
    return loss, brier


def sanity(per_draw: DataFrame, bins: DataFrame, membership: DataFrame, sizes: dict[str, int] | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Return (check, broken): how many rows break what must hold for scores, whatever the draws.

    B0's log loss and Brier score are constants; each draw's chances add up to K; none is clipped; all lie inside (0, 1); B0 has one
    calibration bin (``bins``, with config); periods have the sizes given.
    """
    import math

    p = K / N
    loss, brier = -(p * math.log(p) + (1 - p) * math.log(1 - p)), p * (1 - p)
    base = F.col("config") == "B0"
    one = per_draw.agg(
        F.count_if(base & (F.abs(F.col("log_loss") - loss) > 1e-12)).alias("b0_log_loss"), F.count_if(base & (F.abs(F.col("brier") - brier) > 1e-12)).alias("b0_brier"),
        F.count_if(F.abs(F.col("sum_p") - K) > tolerance).alias("sum_p"), F.count_if(F.col("n_clipped") != 0).alias("clipped"),
    )
    two = bins.agg(
        F.count_if((F.col("min_p") <= 0) | (F.col("max_p") >= 1)).alias("open_interval"), F.greatest(F.count_if(base) - 1, F.lit(0)).alias("b0_bins"),
        F.count_if(base & (F.abs(F.col("mean_p") - p) > 1e-12)).alias("b0_mean_p"),
    )
    names = ["b0_log_loss", "b0_brier", "sum_p", "clipped", "open_interval", "b0_bins", "b0_mean_p"]
    out = one.crossJoin(two).select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("broken")) for c in names])).alias("x")).select("x.*")
    if sizes:
        wanted = per_draw.sparkSession.createDataFrame(list(sizes.items()), "period string, wanted long")
        counts = membership.groupBy("period").agg(F.count(F.lit(1)).alias("n"))
        wrong = F.broadcast(wanted).join(counts, "period", "left").agg(F.count_if(F.coalesce("n", F.lit(0)) != F.col("wanted")).alias("broken"))
        out = out.unionByName(wrong.select(F.lit("period_sizes").alias("check"), "broken"))
    return out
