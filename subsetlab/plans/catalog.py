"""The library's queries by name, on draws derived from the test tables, and the same in DuckDB SQL.

Doubles are rounded in both, as the engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsetlab.functions import nulls
from subsetlab.model import MAIN, chunked_version, content_version, derive_draws, dim_number, fact_draw_number
from subsetlab.operators import baselines, describe, infer, rules
from subsetlab.plans import montecarlo, null_sql, quality_queries, stream_queries
from subsetlab.session import cut, ship

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 8
#: Widths of rolling windows, and numbers of blocks.
WIDTHS, BLOCKS = (50, 100, 200), (2, 4)
AS_OF = "1998-09-01 12:00:00"
LOCAL_TODAY = "1998-01-01"
#: End of the shortened series whose missed dates are looked for.
EARLY = "1998-06-01"


def draws_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = ship(spark).read
    return derive_draws(read.parquet(f"{sf_dir}/lineitem.parquet"), read.parquet(f"{sf_dir}/orders.parquet"))


def mirror_of(draws: DataFrame) -> DataFrame:
    """A second source that differs in known ways: every 97th draw is missing, every 101st has another special number, some are new."""
    special = F.when(F.col("t") % 101 == 0, F.col("special_number") + 1).otherwise(F.col("special_number"))
    kept = draws.where("t % 97 <> 0").withColumn("special_number", special)
    extra = draws.where("t % 500 = 0").withColumn("draw_id", F.concat(F.lit("9"), F.substring("draw_id", 2, 4)))
    return kept.unionByName(extra)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, DIGITS).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def on_draws(work: Callable[..., DataFrame], *args, **kwargs) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(work(draws_of(spark, sf_dir), *args, **kwargs))

    return run


def _records(draws: DataFrame) -> DataFrame:
    """Records with known faults, from draws."""
    t = F.col("t")
    main = F.array(*MAIN)
    main = F.when(t % 50 == 7, F.reverse(main)).when(t % 60 == 11, F.slice(main, 1, 5)).when(t % 70 == 13, F.concat(F.slice(main, 1, 5), F.array(F.lit(60).cast("long")))).when(t % 80 == 17, F.concat(F.slice(main, 2, 5), F.slice(main, 2, 1))).otherwise(main)
    special = F.when(t % 90 == 19, F.element_at(main, 1)).when(t % 90 == 20, F.lit(0)).otherwise(F.col("special_number"))
    ident = F.when(t % 40 == 3, F.concat(F.lit("x"), "draw_id")).otherwise(F.col("draw_id"))
    return draws.select(ident.alias("draw_id"), F.when(t % 100 == 23, F.lit(None)).otherwise(F.col("draw_date")).alias("draw_date"), main.alias("main"), special.cast("long").alias("special"))


def _record_findings(draws: DataFrame) -> DataFrame:
    return rules.record_findings(_records(draws), F.lit(LOCAL_TODAY).cast("date"))


def _runs_log(draws: DataFrame) -> DataFrame:
    """A log of runs from draws: source by t, run by date."""
    return draws.select(F.concat(F.lit("s"), (F.col("t") % 3).cast("string")).alias("source"), F.col("draw_id").alias("run_id"), F.when(F.col("t") % 7 == 0, "failed").otherwise("success").alias("status"))


def _widths(draws: DataFrame) -> DataFrame:
    per = baselines.scored_draws(draws, tuple(f"B2_w{w}" for w in WIDTHS)).where("t > 500")
    losses = per.groupBy("config").agg(F.avg("log_loss").alias("loss"))
    return baselines.select_width(losses.select(F.regexp_extract("config", "[0-9]+$", 0).cast("long").alias("width"), "loss"))


def _scores(draws: DataFrame, config: str) -> DataFrame:
    return baselines.scored_draws(draws, (config,)).drop("config")


def _folded(draws: DataFrame, what: str) -> DataFrame:
    draws = cut(draws)
    per = baselines.scored_draws(draws)
    n = draws.count()
    return baselines.period_metrics(baselines.in_periods(per, n)) if what == "metrics" else baselines.deltas(baselines.in_periods(per, n))


def _calibration(draws: DataFrame, what: str) -> DataFrame:
    bins = baselines.calibration(draws, tuple(c for c in baselines.CONFIGS if c != "B0"))
    return bins if what == "bins" else baselines.ece(bins, ["config"])


def _holm(draws: DataFrame) -> DataFrame:
    """Adjust a p-value for each number: the normal upper tail of its squared z, by a logistic approximation."""
    z = describe.number_frequency(draws, band=False).select("number", "z")
    p = 2 / (1 + F.exp(F.abs("z") * 1.702))
    return infer.holm(z.select("number", F.round(p, 6).alias("p")), "p")


def _conflicts(draws: DataFrame) -> DataFrame:
    return rules.id_conflicts(draws.unionByName(mirror_of(draws)))


def _recast(draws: DataFrame) -> DataFrame:
    """Draws, and every 40th again under a later id."""
    again = draws.where("t % 40 = 0").withColumn("draw_id", (F.col("draw_id").cast("long") + 50_000).cast("string"))
    return draws.unionByName(again)


def _early(draws: DataFrame) -> DataFrame:
    return draws.where(F.col("draw_date") < F.lit(EARLY).cast("date"))


def _last(draws: DataFrame) -> DataFrame:
    both = draws.withColumn("arrival", F.col("t")).unionByName(mirror_of(draws).withColumn("arrival", F.col("t") + 1_000_000))
    return rules.last_by_id(both, "arrival").select("draw_id", "special_number", "arrival")


def _dedupe(draws: DataFrame) -> DataFrame:
    twice = draws.withColumn("arrival", F.col("t")).unionByName(draws.where("t % 5 = 0").withColumn("arrival", F.col("t") + 1_000_000))
    return rules.exact_duplicates_removed(twice, "arrival").select("draw_id", "arrival")


def _merge(draws: DataFrame) -> DataFrame:
    bad = _record_findings(draws).where("severity = 'error'").select("draw_id")
    return rules.merge_new(draws.where("t % 3 = 0"), draws, bad).select("draw_id", *MAIN)


def _sanity(draws: DataFrame) -> DataFrame:
    draws = cut(draws)
    per = baselines.scored_draws(draws).where("t > 500")
    return baselines.sanity(per, baselines.calibration(draws), baselines.periods(draws, draws.count()), {"fold_01": 50, "fold_02": 49})


def _null_pmfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(describe.null_pmfs(spark))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "number_frequency": on_draws(describe.number_frequency, band=False),
        "number_frequency_band": on_draws(describe.number_frequency),
        "draws": on_draws(lambda d: d),
        "fact_draw_number": on_draws(fact_draw_number),
        "dim_number": on_draws(dim_number),
        "content_version": on_draws(content_version),
        "draw_metrics": on_draws(describe.draw_metrics),
        "draw_metric_summary": on_draws(lambda d: describe.metric_summary(d).select("metric", "n", "mean", "sd", "q05", "q25", "q50", "q75", "q95")),
        "metric_summary_null": on_draws(describe.metric_summary),
        "metric_distribution": on_draws(describe.metric_distribution),
        "null_pmfs": _null_pmfs,
        "special_frequency": on_draws(describe.special_frequency, band=False),
        "frequency_by_year": on_draws(describe.frequency_by_period, "year"),
        "frequency_by_quarter": on_draws(describe.frequency_by_period, "quarter"),
        "cumulative_counts": on_draws(describe.cumulative_counts),
        "interarrival_gaps": on_draws(describe.gaps),
        "interarrival_expected": on_draws(describe.interarrival),
        "appearance_summary": on_draws(describe.appearance_summary),
        "pair_cooccurrence": on_draws(describe.pair_counts),
        "pair_count_distribution": on_draws(describe.pair_count_distribution),
        "pair_bands": on_draws(describe.pair_bands),
        "cumulative_bands": on_draws(describe.bands_by_draw),
        "outside_bands": on_draws(describe.outside_bands),
        "special_frequency_band": on_draws(describe.special_frequency),
        "cells_outside_band": on_draws(lambda d: describe.cells_outside(describe.number_frequency(d))),
        "chi2_main": on_draws(infer.chi2_main),
        "chi2_special": on_draws(infer.chi2_special),
        "lag_overlap": on_draws(infer.lag_overlap),
        "ljung_box": on_draws(infer.autocorrelation),
        "runs": on_draws(infer.runs),
        "year_homogeneity": on_draws(infer.year_chi2),
        "rolling_chi2": on_draws(infer.window_chi2),
        "ks_sum": on_draws(infer.ks_distance, "sum"),
        "ks_range": on_draws(infer.ks_distance, "range"),
        "holm": on_draws(_holm),
        "rule_records": on_draws(_record_findings),
        "rule_duplicate_content": on_draws(lambda d: rules.duplicate_content(_recast(d))),
        "last_by_id": on_draws(_last),
        "rule_chronology": on_draws(rules.chronology),
        "rule_continuity": on_draws(lambda d: rules.continuity(d.where("t % 97 <> 0"))),
        "rule_id_conflict": on_draws(_conflicts),
        "dedupe_exact": on_draws(_dedupe),
        "merge_incremental": on_draws(_merge),
        "cadence_gaps": on_draws(rules.cadence_gaps),
        "missed_dates": on_draws(lambda d: rules.missed_dates(_early(d), F.lit(AS_OF).cast("timestamp"))),
        "expected_latest": lambda spark, sf_dir: rules.expected_latest(spark, F.lit(AS_OF).cast("timestamp")),
        "chunked_version": on_draws(chunked_version),
        "reconcile_fields": on_draws(lambda d: rules.reconcile_fields(d, mirror_of(d))),
        "reconcile_only_left": on_draws(lambda d: rules.only_in(d, mirror_of(d))),
        "reconcile_only_right": on_draws(lambda d: rules.only_in(mirror_of(d), d)),
        "reconcile_assessment": on_draws(lambda d: rules.assess_reconcile(d, mirror_of(d), d.where("t % 2 = 0"))),
        "lineage_anti": on_draws(lambda d: rules.lineage_missing(d, mirror_of(d)).select("draw_id")),
        "latest_runs": on_draws(lambda d: rules.latest_runs(_runs_log(d))),
        "fold_metrics": on_draws(_folded, "metrics"),
        "delta_vs_b0": on_draws(_folded, "deltas"),
        "reliability": on_draws(_calibration, "bins"),
        "ece": on_draws(_calibration, "ece"),
        "w_selection": on_draws(_widths),
        "sanity_checks": on_draws(_sanity),
        "mean_interval": on_draws(infer.mean_interval),
        "effects": on_draws(lambda d: infer.effects(cut(d))),
        "special_ranks": on_draws(infer.special_ranks),
        "exploratory": on_draws(lambda d: infer.exploratory(cut(d)).drop("p")),
        "exploratory_p": on_draws(lambda d: montecarlo.exploratory(cut(d), 200)),
        "confirmatory_family": on_draws(lambda d: montecarlo.family(d.where("t <= 1190"), 200)),
        "baseline_experiment": on_draws(lambda d: montecarlo.experiment(d.where("t <= 700"), 50)),
        "mc_reference": lambda spark, sf_dir: rounded(montecarlo.mc_reference(spark, 1190, 999, (50, 100), 100)),
    }
    for w in WIDTHS:
        out[f"rolling_counts_w{w}"] = on_draws(describe.rolling_counts, w)
        out[f"rolling_extremes_w{w}"] = on_draws(describe.rolling_extremes, w)
    for b in BLOCKS:
        out[f"block_stability_number_{b}"] = on_draws(describe.block_stability, b)
        out[f"block_stability_pair_{b}"] = on_draws(describe.block_stability, b, pairs=True)
    for m in describe.METRICS:
        out[f"metric_histogram_{m}"] = on_draws(lambda d, m=m: describe.metric_histogram(d).where(F.col("metric") == m))
    for m in ("odd", "low", "consecutive"):
        out[f"cells_{m}"] = on_draws(infer.cells_chi2, m)
    for c in ("B0", "B1", *(f"B2_w{w}" for w in WIDTHS)):
        out[f"scores_{c.lower()}"] = on_draws(partial(_scores, config=c))
    out |= stream_queries.queries(on_draws)
    return out | {k: on_draws(f) for k, f in quality_queries.queries(mirror_of).items()}


_N = [f"n{i}" for i in range(1, 7)]
_LIST = "[" + ", ".join(_N) + "]"
#: Common table expressions: draws, their long and grid forms, running counts, scores, a second source.
CTE = f"""
e AS (SELECT l_orderkey, (l_partkey % 55) + 1 AS num, min(l_linenumber * CAST(1000000000 AS BIGINT) + l_partkey) AS f FROM lineitem GROUP BY 1, 2),
r AS (SELECT l_orderkey, num, row_number() OVER (PARTITION BY l_orderkey ORDER BY f) AS rn FROM e),
k AS (SELECT l_orderkey FROM r GROUP BY 1 HAVING max(rn) >= 6),
m AS (SELECT r.l_orderkey, num, row_number() OVER (PARTITION BY r.l_orderkey ORDER BY num) AS pos FROM r JOIN k USING (l_orderkey) WHERE rn <= 6),
w AS (SELECT l_orderkey, {", ".join(f"max(CASE WHEN pos = {i} THEN num END) AS n{i}" for i in range(1, 7))} FROM m GROUP BY 1),
draws AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS BIGINT) AS t,
  CASE WHEN length(CAST(row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS VARCHAR)) < 5 THEN lpad(CAST(row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS VARCHAR), 5, '0') ELSE CAST(row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS VARCHAR) END AS draw_id,
  CAST(o_orderdate AS DATE) AS draw_date, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _N)}, CAST(s.num AS BIGINT) AS special_number
  FROM w JOIN orders ON o_orderkey = w.l_orderkey LEFT JOIN (SELECT l_orderkey, num FROM r WHERE rn = 7) s ON s.l_orderkey = w.l_orderkey),
nums AS (SELECT CAST(unnest(range(1, 56)) AS BIGINT) AS num),
total AS (SELECT count(*) AS n FROM draws),
long AS (SELECT t, draw_id, draw_date, unnest({_LIST}) AS num FROM draws),
grid AS (SELECT t, num, CAST(list_contains({_LIST}, num) AS BIGINT) AS y FROM draws, nums),
run AS (SELECT t, num, y, CAST(sum(y) OVER (PARTITION BY num ORDER BY t) AS BIGINT) AS c FROM grid),
mirror AS (SELECT t, draw_id, draw_date, {", ".join(_N)}, CASE WHEN t % 101 = 0 THEN special_number + 1 ELSE special_number END AS special_number FROM draws WHERE t % 97 <> 0
  UNION ALL SELECT t, '9' || substr(draw_id, 2, 4), draw_date, {", ".join(_N)}, special_number FROM draws WHERE t % 500 = 0),
metrics AS (SELECT t, draw_id, {" + ".join(_N)} AS "sum", n1 AS "min", n6 AS "max", n6 - n1 AS "range",
  {" + ".join(f"{c} % 2" for c in _N)} AS odd, {" + ".join(f"CAST({c} <= 27 AS BIGINT)" for c in _N)} AS low,
  {", ".join(f"n{i + 1} - n{i} AS gap_{i}" for i in range(1, 6))}, {" + ".join(f"CAST(n{i + 1} - n{i} = 1 AS BIGINT)" for i in range(1, 6))} AS consecutive,
  least({", ".join(f"n{i + 1} - n{i}" for i in range(1, 6))}) AS min_gap, greatest({", ".join(f"n{i + 1} - n{i}" for i in range(1, 6))}) AS max_gap FROM draws),
vals AS ({" UNION ALL ".join(f"SELECT t, '{m}' AS metric, {chr(34)}{m}{chr(34)} AS value FROM metrics" for m in describe.METRICS if m != "gap")}
  {"".join(f" UNION ALL SELECT t, 'gap' AS metric, gap_{i} AS value FROM metrics" for i in range(1, 6))}),
sc AS (SELECT 'B0' AS config, t, num, y, 6.0e0 / 55 AS p FROM run
  UNION ALL SELECT 'B1', t, num, y, 6 * (c - y + 1.0e0) / (6 * (t - 1) + 55) FROM run
  {"".join(f" UNION ALL SELECT 'B2_w{x}', a.t, a.num, a.y, 6 * (a.c - a.y - coalesce(b.c - b.y, 0) + 1.0e0) / (6 * least({x}, a.t - 1) + 55) FROM run a LEFT JOIN run b ON b.t = a.t - {x} AND b.num = a.num" for x in WIDTHS)}),
clip AS (SELECT *, greatest(1.0e-6, least(1 - 1.0e-6, p)) AS q FROM sc),
ds AS (SELECT config, t, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS log_loss, avg((p - y) * (p - y)) AS brier, sum(p) AS sum_p, sum(num * p) AS sum_forecast,
  CAST(sum(num * y) AS BIGINT) AS sum_actual, CAST(count(*) FILTER (WHERE p < 1.0e-6 OR p > 1 - 1.0e-6) AS BIGINT) AS n_clipped FROM clip GROUP BY 1, 2),
per AS (SELECT t, printf('fold_%02d', CAST((t - 501) // 50 + 1 AS INT)) AS period FROM draws WHERE t > 500
  UNION ALL SELECT t, 'dev_pooled' FROM draws WHERE t > 500 UNION ALL SELECT t, 'validation' FROM draws, total WHERE t > 500 AND t > n - 210),
prev AS (SELECT *, lag(draw_id) OVER (ORDER BY t) AS prev_draw_id, lag(draw_date) OVER (ORDER BY t) AS prev_draw_date FROM draws),
rec AS (SELECT CASE WHEN t % 40 = 3 THEN 'x' || draw_id ELSE draw_id END AS draw_id, CASE WHEN t % 100 = 23 THEN NULL ELSE draw_date END AS draw_date,
  CASE WHEN t % 50 = 7 THEN list_reverse({_LIST}) WHEN t % 60 = 11 THEN {_LIST}[1:5] WHEN t % 70 = 13 THEN list_concat({_LIST}[1:5], [60]) WHEN t % 80 = 17 THEN list_concat({_LIST}[2:6], [n2]) ELSE {_LIST} END AS main, t, special_number FROM draws),
rec2 AS (SELECT draw_id, draw_date, main, CASE WHEN t % 90 = 19 THEN main[1] WHEN t % 90 = 20 THEN 0 ELSE special_number END AS special, array_to_string(main, ',') AS txt FROM rec),
finds AS ({" UNION ALL ".join(f"SELECT draw_id, '{name}' AS rule, '{sev}' AS severity, coalesce(CAST({detail} AS VARCHAR), '') AS detail FROM rec2 WHERE {cond}" for name, sev, detail, cond in (
    ("draw_id_format", "error", "draw_id", "NOT regexp_full_match(draw_id, '[0-9]{5}')"), ("draw_date_parseable", "error", "''", "draw_date IS NULL"),
    ("not_future_dated", "error", "draw_date", f"draw_date > DATE '{LOCAL_TODAY}'"), ("draw_weekday", "warning", "draw_date", f"draw_date <= DATE '{LOCAL_TODAY}' AND isodow(draw_date) NOT IN (2, 4, 6)"),
    ("main_count", "error", "txt", "len(main) <> 6"), ("main_range", "error", "txt", "len(list_filter(main, lambda x: x < 1 OR x > 55)) > 0"),
    ("main_unique", "error", "txt", "len(list_distinct(main)) <> len(main)"), ("main_sorted", "warning", "txt", "len(list_distinct(main)) = len(main) AND list_sort(main) <> main"),
    ("special_present", "warning", "''", "special IS NULL"), ("special_range", "error", "special", "special < 1 OR special > 55"),
    ("special_not_in_main", "error", "special", "list_contains(main, special)")))})
"""


def _sql(body: str) -> str:
    return f"WITH {CTE.strip()}\n{body}"


def _r(expr: str, name: str) -> str:
    return f"round({expr}, {DIGITS}) AS {name}"


def _zs(observed: str, trials: str, p: str) -> str:
    return f"CASE WHEN {trials} > 0 THEN ({observed} - {trials} * {p}) / sqrt({trials} * ({p} * (1 - {p}))) ELSE 0 END"


def _freq(counts: str, n: str, p: str, more: str = "") -> str:
    z, z2 = nulls.Z95, nulls.Z95**2
    centre, half = f"(s + {z2}e0 / (2 * n)) / (1 + {z2}e0 / n)", f"{z}e0 * sqrt(s * (1 - s) / n + {z2}e0 / (4.0e0 * n * n)) / (1 + {z2}e0 / n)"
    return _sql(f"""SELECT num AS number, o AS observed, {_r("s", "rel_freq")}, {_r(f"greatest({centre} - {half}, 0)", "wilson_lo")}, {_r(f"least({centre} + {half}, 1)", "wilson_hi")},
      {_r(f"n * {p}", "expected")}, {_r(_zs("o", "n", p), "z")}{more} FROM (SELECT num, coalesce(c, 0) AS o, CAST(coalesce(c, 0) AS DOUBLE) / n AS s, n FROM nums LEFT JOIN ({counts}) USING (num), ({n}))""")


def _period(label: str, start: str, months: int) -> str:
    p = "(6.0e0 / 55)"
    return _sql(f"""SELECT period, num AS number, d AS draws, coalesce(o, 0) AS observed, {_r(f"d * {p}", "expected")}, {_r(_zs("coalesce(o, 0)", "d", p), "z")},
      (start < first OR CAST(start + INTERVAL {months} MONTH - INTERVAL 1 DAY AS DATE) > last) AS partial
      FROM (SELECT {label} AS period, CAST(date_trunc('{start}', draw_date) AS DATE) AS start, count(*) AS d FROM draws GROUP BY 1, 2) CROSS JOIN nums
      LEFT JOIN (SELECT {label} AS period, num, count(*) AS o FROM long GROUP BY 1, 2) USING (period, num), (SELECT min(draw_date) AS first, max(draw_date) AS last FROM draws)""")


def _blocks(key: str, source: str, cells: str, b: int) -> str:
    return _sql(f""", v AS (SELECT block, {key}, CAST(coalesce(c, 0) AS DOUBLE) AS x FROM (SELECT CAST(unnest(range({b})) AS BIGINT) AS block) CROSS JOIN ({cells})
      LEFT JOIN (SELECT block, {key}, count(*) AS c FROM ({source}) JOIN (SELECT t, CAST(ntile({b}) OVER (ORDER BY t) - 1 AS BIGINT) AS block FROM draws) USING (t) GROUP BY ALL) USING (block, {key}))
      SELECT a.block AS a, b.block AS b, {_r("corr(a.x, b.x)", "r")} FROM v a JOIN v b USING ({key}) WHERE a.block < b.block GROUP BY 1, 2""".replace("\n      SELECT a.block", " SELECT a.block", 1)).replace(CTE.strip() + "\n,", CTE.strip() + ",")


def _null_oracles(frequency: str, p: str) -> dict[str, str]:
    """SQL for what needs exact null distributions."""
    more = f"WITH {CTE.strip()},\n{null_sql.PMF.strip()}"
    bands = f"WITH {CTE.strip()}, band AS ({null_sql.band(f'SELECT 1 AS one, n, {p} AS p FROM total', 'one')})"
    plain = frequency.split("\nSELECT", 1)[1]
    out = {
        "null_pmfs": f"WITH total AS (SELECT 1 AS n), {null_sql.PMF.strip()} SELECT metric, value, {_r('prob', 'prob')} FROM pmf",
        "number_frequency_band": f"{bands} SELECT f.*, lo AS band_lo, hi AS band_hi FROM (SELECT{plain}) f, band",
        "cells_outside_band": f"{bands} SELECT count(*) AS cells, count(*) FILTER (WHERE observed < lo OR observed > hi) AS outside FROM (SELECT{plain}) f, band",
    }
    for m in ("odd", "low", "consecutive"):
        out[f"cells_{m}"] = f"""{more} SELECT cell, lo, {_r('expected', 'expected')}, CAST(coalesce(sum(c), 0) AS BIGINT) AS observed, {_r('(coalesce(sum(c), 0) - expected) ** 2 / expected', 'part')}
          FROM ({null_sql.test_cells(m)}) LEFT JOIN (SELECT {m} AS value, count(*) AS c FROM metrics GROUP BY 1) ON value BETWEEN lo AND hi GROUP BY cell, lo, expected"""
    quantiles = ((0.05, "q05"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.95, "q95"))
    own = ", ".join(_r(f"quantile_cont(CAST(value AS DOUBLE), {q}e0)", x) for q, x in quantiles)
    null = ", ".join(f"min(value) FILTER (WHERE f >= {q}e0 - 1.0e-12) AS null_{x}" for q, x in quantiles)
    spread = "sqrt(sum(prob * value * value) - sum(prob * value) ** 2)"
    out["metric_summary_null"] = f"""{more} SELECT * FROM (SELECT metric, count(*) AS n, {_r('avg(value)', 'mean')}, {_r('coalesce(stddev_samp(value), 0)', 'sd')}, {own} FROM vals GROUP BY 1)
      JOIN (SELECT metric, {_r('sum(prob * value)', 'null_mean')}, {_r(spread, 'null_sd')}, {null} FROM cum GROUP BY 1) USING (metric)"""
    cells, key = null_sql.band("SELECT key, trials AS n, prob AS p FROM placed", "key"), "metric, place, cell, placed.lo, placed.hi, prob, trials, key, band.lo, band.hi"
    out["metric_distribution"] = f"""{more}, {null_sql.TABLE_CELLS.strip()}, band AS ({cells}) SELECT metric, CAST(place AS INTEGER) AS place, cell, placed.lo AS lo, placed.hi AS hi, {_r('prob', 'null_prob')}, {_r('prob * trials', 'expected')},
      band.lo AS band_lo, band.hi AS band_hi, CAST(coalesce(sum(c), 0) AS BIGINT) AS observed, {_r('coalesce(sum(c), 0) / CAST(trials AS DOUBLE)', 'share')}
      FROM placed JOIN band USING (key) LEFT JOIN (SELECT metric AS m, value, count(*) AS c FROM vals GROUP BY 1, 2) ON m = metric AND value BETWEEN placed.lo AND placed.hi GROUP BY {key}"""
    gap = f"SELECT gap, count(*) AS c FROM (SELECT t - lag(t) OVER (PARTITION BY num ORDER BY t) AS gap FROM long) WHERE gap IS NOT NULL GROUP BY 1"
    out["interarrival_expected"] = f"""WITH {CTE.strip()}, ee AS (SELECT g, 55.0e0 * (n - g) * {p} * {p} * (1 - {p}) ** (g - 1) AS x FROM (SELECT n, unnest(range(1, n)) AS g FROM total)),
      ends AS (SELECT coalesce(max(g) FILTER (WHERE x >= 5), 0) AS last, sum(x) AS whole FROM ee), tail AS (SELECT last, whole, coalesce(sum(x) FILTER (WHERE g > last), 0) AS rest FROM ee, ends GROUP BY 1, 2),
      cut AS (SELECT whole, CASE WHEN rest > 0 AND rest < 5 THEN last - 1 ELSE last END AS single FROM tail),
      cells AS (SELECT least(g, single + 1) AS lo, max(g) AS most, sum(x) AS expected, any_value(whole) AS whole, any_value(single) AS single FROM ee, cut GROUP BY 1)
      SELECT CAST(lo - 1 AS INTEGER) AS place, CASE WHEN lo > single THEN '>=' || lo ELSE CAST(lo AS VARCHAR) END AS cell, {_r('expected', 'expected')}, {_r('expected / whole', 'null_share')}, CAST(coalesce(sum(c), 0) AS BIGINT) AS observed
      FROM cells LEFT JOIN ({gap}) ON least(gap, single + 1) = lo GROUP BY lo, single, expected, whole"""
    return out


def _effect_oracles(known: dict[str, str]) -> dict[str, str]:
    """SQL for effects, intervals of means and exploratory statistics, on top of the tests' own."""

    def body(name: str) -> str:
        return "(" + known[name].split(CTE.strip(), 1)[1].replace(f", {DIGITS})", ", 14)") + ")"

    names = ("sum", "range", "odd", "low", "consecutive")
    means = f"""(SELECT metric, m - null_mean AS difference, m - 1.96e0 * se AS lo, m + 1.96e0 * se AS hi FROM (SELECT metric, avg(value) AS m, stddev_samp(value) / sqrt(count(*)) AS se FROM vals
      WHERE metric IN ({", ".join(map(repr, names))}) GROUP BY 1) JOIN (SELECT metric, sum(prob * value) AS null_mean FROM pmf GROUP BY 1) USING (metric))"""
    pmf = f"WITH {CTE.strip()},\n{null_sql.PMF.strip()}"
    out = {"mean_interval": f"{pmf} SELECT metric, {_r('difference', 'difference')}, {_r('lo', 'lo')}, {_r('hi', 'hi')} FROM {means}"}
    rows = [
        f"SELECT 'C1' AS test, 'dispersion_ratio' AS effect, statistic / 49 AS value FROM {body('chi2_main')}", f"SELECT 'C1', 'max_abs_z', max(abs(z)) FROM {body('number_frequency')}",
        f"SELECT 'C2', 'ratio', statistic / 54 FROM {body('chi2_special')}", f"SELECT 'C3', 'overlap_minus_null_' || lag, overlap - 36.0e0 / 55 FROM {body('lag_overlap')}",
        f"SELECT 'C3', 'ci_halfwidth_' || lag, 1.96e0 * sqrt({infer.OVERLAP_VARIANCE!r} / (n - lag)) FROM {body('lag_overlap')}, total",
        f"SELECT 'C5', 'r_' || lag, r FROM {body('ljung_box').replace('(,', '(WITH', 1)}", f"SELECT 'C5', 'max_abs_r', max(abs(r)) FROM {body('ljung_box').replace('(,', '(WITH', 1)}",
        "SELECT 'C5', 'ci_halfwidth', 1.96e0 / sqrt(n) FROM total", *[f"SELECT 'C6', '{'n_ties' if c == 'ties' else c}', {c} FROM {body('runs')}" for c in ("runs", "mu", "n_plus", "n_minus", "ties")],
        f"SELECT 'C7', 'cramers_v', sqrt(statistic / (6 * n * ((SELECT count(DISTINCT year(draw_date)) FROM draws) - 1))) FROM {body('year_homogeneity')}, total",
        f"SELECT 'C8', 'v_roll', sqrt(max(x2) / 1020) FROM {body('rolling_chi2')} HAVING count(*) >= 3",
    ]
    for test, metric in zip(("C9", "C10", "C11", "C12", "C13"), names, strict=True):
        rows.append(f"SELECT '{test}', 'mean_minus_null', difference FROM {means} WHERE metric = '{metric}'")
        if test in ("C9", "C10"):
            rows += [f"SELECT '{test}', 'ci_{c}', {c} FROM {means} WHERE metric = '{metric}'" for c in ("lo", "hi")]
        else:
            rows.append(f"SELECT '{test}', 'w', sqrt(sum((coalesce(c, 0) - expected) ** 2 / expected) / any_value(n)) FROM (SELECT cell, expected, sum(c) AS c FROM ({null_sql.test_cells(metric)}) LEFT JOIN (SELECT {metric} AS value, count(*) AS c FROM metrics GROUP BY 1) ON value BETWEEN lo AND hi GROUP BY 1, 2), total")
    out["effects"] = f"{pmf} SELECT test, effect, {_r('CAST(value AS DOUBLE)', 'value')} FROM ({' UNION ALL '.join(rows)})"
    ranks = "SELECT special_number - len(list_filter([n1, n2, n3, n4, n5, n6], lambda x: x < special_number)) AS rank FROM draws WHERE special_number IS NOT NULL"
    seen = f"(SELECT rank, coalesce(c, 0) AS observed FROM (SELECT CAST(unnest(range(1, 50)) AS BIGINT) AS rank) LEFT JOIN (SELECT rank, count(*) AS c FROM ({ranks}) GROUP BY 1) USING (rank))"
    out["special_ranks"] = f"WITH {CTE.strip()} SELECT rank, observed FROM {seen}"
    bins = "SELECT (value - 21) // 10 * 10 + 21 AS v, sum(prob) AS p FROM pmf WHERE metric = 'sum' GROUP BY 1"
    ends = "SELECT v, p, n, sum(p) OVER (ORDER BY v) AS f, sum(p) OVER (ORDER BY v DESC) AS g FROM bins, total"
    pooled = "SELECT least(greatest(v, a), b) AS k, sum(p) AS p FROM bins, (SELECT min(v) FILTER (WHERE n * f >= 5) AS a, max(v) FILTER (WHERE n * g >= 5) AS b FROM ends) GROUP BY 1"
    held = "SELECT least(greatest((\"sum\" - 21) // 10 * 10 + 21, a), b) AS k, count(*) AS c FROM metrics, (SELECT min(v) FILTER (WHERE n * f >= 5) AS a, max(v) FILTER (WHERE n * g >= 5) AS b FROM ends) GROUP BY 1"
    lags = f"""(WITH y AS (SELECT t, "sum" - avg("sum") OVER () AS c, count(*) OVER () AS n FROM metrics), h AS (SELECT CAST(unnest(range(1, 21)) AS BIGINT) AS lag)
      SELECT lag, n * (n + 2.0e0) * r * r / (n - lag) AS q FROM (SELECT h.lag, any_value(a.n) AS n, sum(a.c * b.c) / (SELECT sum(c * c) FROM y) AS r FROM h, y a, y b WHERE b.t = a.t - h.lag GROUP BY 1))"""
    out["exploratory"] = f"""{pmf}, bins AS ({bins}), ends AS ({ends}), lags AS {lags}, x AS (SELECT 'c1_scaled' AS name, statistic * 54 / 49 AS statistic, 54 AS df FROM {body('chi2_main')}
      {"".join(f" UNION ALL SELECT 'ljung_box_{h}', sum(q), {h} FROM lags WHERE lag <= {h}" for h in (5, 10, 20))}
      UNION ALL SELECT 'special_rank', sum((observed - e) ** 2 / e), 48 FROM {seen}, (SELECT avg(observed) AS e FROM {seen})
      UNION ALL SELECT 'sum_bins', sum((coalesce(c, 0) - n * p) ** 2 / (n * p)), count(*) - 1 FROM ({pooled}) LEFT JOIN ({held}) USING (k), total)
      SELECT name, {_r('statistic', 'statistic')}, CAST(df AS BIGINT) AS df FROM x"""
    sizes = "(SELECT count(*) FILTER (WHERE period = 'fold_01') AS a, count(*) FILTER (WHERE period = 'fold_02') AS b FROM per)"
    checks = [("b0_log_loss", "count(*) FILTER (WHERE config = 'B0' AND abs(log_loss + (6.0e0 / 55 * ln(6.0e0 / 55) + 49.0e0 / 55 * ln(49.0e0 / 55))) > 1.0e-12)"), ("b0_brier", "count(*) FILTER (WHERE config = 'B0' AND abs(brier - 294.0e0 / 3025) > 1.0e-12)"),
              ("sum_p", "count(*) FILTER (WHERE abs(sum_p - 6) > 1.0e-9)"), ("clipped", "count(*) FILTER (WHERE n_clipped <> 0)")]
    parts = [f"SELECT '{k}' AS \"check\", {v} AS broken FROM ds WHERE t > 500" for k, v in checks]
    parts.append("SELECT 'open_interval', count(*) FILTER (WHERE p <= 0 OR p >= 1) FROM sc WHERE t > 500")
    parts += ["SELECT 'b0_bins', greatest(count(DISTINCT p) - 1, 0) FROM sc WHERE config = 'B0' AND t > 500", "SELECT 'b0_mean_p', count(DISTINCT p) FILTER (WHERE abs(p - 6.0e0 / 55) > 1.0e-12) FROM sc WHERE config = 'B0' AND t > 500"]
    parts.append(f"SELECT 'period_sizes', CAST(a <> 50 AS BIGINT) + CAST(b <> 49 AS BIGINT) FROM {sizes}")
    out["sanity_checks"] = _sql(" UNION ALL ".join(parts))
    return out


def _band_oracles(known: dict[str, str]) -> dict[str, str]:
    """SQL for bands of pairs, special numbers and running counts, and for what lies outside."""

    def body(name: str) -> str:
        return "(" + known[name].split(CTE.strip(), 1)[1] + ")"

    trials = "SELECT 'main' AS scope, n, 6.0e0 / 55 AS p FROM total UNION ALL SELECT 'special', count(special_number), 1.0e0 / 55 FROM draws UNION ALL SELECT 'pairs', n, 1.0e0 / 99 FROM total"
    bands = f"WITH {CTE.strip()}, trials AS ({trials}), band AS ({null_sql.band('SELECT scope, n, p FROM trials', 'scope')})"
    inside = f"(SELECT scope, 1 - sum(chance) AS away FROM (SELECT scope, {null_sql.binomial('x', 'n', 'p')} AS chance FROM (SELECT scope, n, p, unnest(range(lo, hi + 1)) AS x FROM trials JOIN band USING (scope))) GROUP BY 1)"
    counts = [f"SELECT '{s}' AS scope, observed FROM {body(q)}" for s, q in (("main", "number_frequency"), ("special", "special_frequency"), ("pairs", "pair_cooccurrence"))]
    by_draw = null_sql.band("SELECT t, t AS n, 6.0e0 / 55 AS p FROM draws", "t")
    return {
        "pair_bands": f"{bands} SELECT f.*, lo AS band_lo, hi AS band_hi FROM {body('pair_cooccurrence')} f, band WHERE scope = 'pairs'",
        "special_frequency_band": f"{bands} SELECT f.*, lo AS band_lo, hi AS band_hi FROM {body('special_frequency')} f, band WHERE scope = 'special'",
        "outside_bands": f"{bands} SELECT scope, count(*) AS cells, count(*) FILTER (WHERE observed < lo OR observed > hi) AS outside, {_r('count(*) * any_value(away)', 'expected')} FROM ({' UNION ALL '.join(counts)}) JOIN band USING (scope) JOIN {inside} USING (scope) GROUP BY 1",
        "cumulative_bands": _sql(f"SELECT t, {_r('t * (6.0e0 / 55)', 'expected')}, lo AS band_lo, hi AS band_hi FROM ({by_draw})"),
    }


def oracle_sql() -> dict[str, str]:
    p = "(6.0e0 / 55)"
    year, quarter = "CAST(year(draw_date) AS VARCHAR)", "CAST(year(draw_date) AS VARCHAR) || '-Q' || CAST(quarter(draw_date) AS VARCHAR)"
    pairs = "SELECT a.t, a.num AS num, b.num AS other FROM long a JOIN long b ON a.t = b.t AND a.num < b.num"
    pair_grid = "SELECT a.num AS num, b.num AS other FROM nums a, nums b WHERE a.num < b.num"
    pair_counts = f"SELECT num AS a, other AS b, coalesce(c, 0) AS observed FROM ({pair_grid}) LEFT JOIN (SELECT num, other, count(*) AS c FROM ({pairs}) GROUP BY 1, 2) USING (num, other)"
    ident = ", ".join(_N)
    fields = " UNION ALL ".join(
        f"SELECT a.draw_id, '{c}' AS field, coalesce(CAST(a.{c} AS VARCHAR), '<NA>') AS left_value, coalesce(CAST(b.{c} AS VARCHAR), '<NA>') AS right_value FROM draws a JOIN mirror b USING (draw_id) WHERE a.{c} IS DISTINCT FROM b.{c}"
        for c in ("draw_date", *_N, "special_number")
    )
    line = "draw_id || ',' || strftime(draw_date, '%Y-%m-%d') || ',' || " + " || ',' || ".join(f"CAST({c} AS VARCHAR)" for c in _N) + " || ',' || coalesce(CAST(special_number AS VARCHAR), '')"
    header = ",".join(["draw_id", "draw_date", *_N, "special_number"])
    gap = "SELECT num, t, t - lag(t) OVER (PARTITION BY num ORDER BY t) AS gap FROM long"
    out = {
        "number_frequency": _freq("SELECT num, count(*) AS c FROM long GROUP BY 1", "SELECT n FROM total", p),
        "special_frequency": _freq("SELECT special_number AS num, count(*) AS c FROM draws WHERE special_number IS NOT NULL GROUP BY 1", "SELECT count(special_number) AS n, count(*) - count(special_number) AS miss FROM draws", "(1.0e0 / 55)", ", miss AS n_missing").replace("/ n AS s, n FROM", "/ n AS s, n, miss FROM"),
        "draws": _sql(f"SELECT t, draw_id, draw_date, {ident}, special_number FROM draws"),
        "fact_draw_number": _sql(f"SELECT draw_id, draw_date, CAST(pos AS BIGINT) AS position, ({_LIST})[pos] AS number, false AS is_special FROM draws, (SELECT unnest(range(1, 7)) AS pos) UNION ALL SELECT draw_id, draw_date, 7, special_number, true FROM draws WHERE special_number IS NOT NULL"),
        "dim_number": _sql("SELECT num AS number, CASE WHEN num % 2 = 1 THEN 'odd' ELSE 'even' END AS parity, CASE WHEN num <= 27 THEN 'low' ELSE 'high' END AS band, printf('%02d-%02d', CAST(num - num % 10 AS INT), CAST(num - num % 10 + 9 AS INT)) AS decade_group FROM nums"),
        "content_version": _sql(f"SELECT count(*) AS draws, 'ds_' || substr(sha256('{header}' || chr(10) || string_agg({line}, chr(10) ORDER BY draw_id) || chr(10)), 1, 12) AS dataset_version FROM draws"),
        "draw_metrics": _sql("SELECT *, 6 - odd AS even, 6 - low AS high FROM metrics"),
        "draw_metric_summary": _sql(f"SELECT metric, count(*) AS n, {_r('avg(value)', 'mean')}, {_r('coalesce(stddev_samp(value), 0)', 'sd')}, " + ", ".join(_r(f"quantile_cont(CAST(value AS DOUBLE), {q}e0)", x) for q, x in ((0.05, "q05"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.95, "q95"))) + " FROM vals GROUP BY 1"),
        "frequency_by_year": _period(year, "year", 12),
        "frequency_by_quarter": _period(quarter, "quarter", 3),
        "cumulative_counts": _sql(f"SELECT t, num AS number, c AS observed, {_r(f't * {p}', 'expected')} FROM run"),
        "interarrival_gaps": _sql(f"SELECT num, t, gap FROM ({gap}) WHERE gap IS NOT NULL"),
        "appearance_summary": _sql(f"SELECT num AS number, first_id, last_id, coalesce(n_gaps, 0) AS n_gaps, mean_gap, sd_gap FROM nums LEFT JOIN (SELECT num, min_by(draw_id, t) AS first_id, max_by(draw_id, t) AS last_id FROM long GROUP BY 1) USING (num) LEFT JOIN (SELECT num, count(gap) AS n_gaps, {_r('avg(gap)', 'mean_gap')}, {_r('stddev_samp(gap)', 'sd_gap')} FROM ({gap}) WHERE gap IS NOT NULL GROUP BY 1) USING (num)"),
        "pair_cooccurrence": _sql(f"SELECT a, b, observed, {_r('n * 30.0e0 / 2970', 'expected')}, {_r(_zs('observed', 'n', '(30.0e0 / 2970)'), 'z')} FROM ({pair_counts}), total"),
        "pair_count_distribution": _sql(f"SELECT cnt AS \"count\", coalesce(p, 0) AS pairs, {_r(null_sql.binomial('cnt', 'n', '(1.0e0 / 99)'), 'null_prob')}, {_r('1485 * ' + null_sql.binomial('cnt', 'n', '(1.0e0 / 99)'), 'expected')} FROM (SELECT unnest(range(min(observed), max(observed) + 1)) AS cnt FROM ({pair_counts})) LEFT JOIN (SELECT observed, count(*) AS p FROM ({pair_counts}) GROUP BY 1) ON observed = cnt, total"),
        "chi2_main": _sql(f"SELECT {_r('sum((coalesce(c, 0) - n * 6.0e0 / 55) ** 2 / (n * 6.0e0 / 55))', 'statistic')} FROM nums LEFT JOIN (SELECT num, count(*) AS c FROM long GROUP BY 1) USING (num), total"),
        "chi2_special": _sql(f"SELECT {_r('sum((coalesce(c, 0) - n / 55.0e0) ** 2 / (n / 55.0e0))', 'statistic')} FROM nums LEFT JOIN (SELECT special_number AS num, count(*) AS c FROM draws GROUP BY 1) USING (num), (SELECT count(special_number) AS n FROM draws)"),
        "lag_overlap": _sql(f"SELECT lag, {_r('o', 'overlap')}, {_r(f'(o - 36.0e0 / 55) / sqrt({infer.OVERLAP_VARIANCE!r} / (n - lag))', 'z')} FROM (SELECT lag, coalesce(c, 0) / (n - lag) AS o, n FROM (SELECT CAST(unnest(range(1, 11)) AS BIGINT) AS lag) LEFT JOIN (SELECT a.t - b.t AS lag, CAST(count(*) AS DOUBLE) AS c FROM long a JOIN long b ON a.num = b.num AND a.t - b.t BETWEEN 1 AND 10 GROUP BY 1) USING (lag), total WHERE lag < n)"),
        "ljung_box": _sql(f", y AS (SELECT t, \"sum\" - avg(\"sum\") OVER () AS c, count(*) OVER () AS n FROM metrics), h AS (SELECT CAST(unnest(range(1, 11)) AS BIGINT) AS lag) SELECT lag, {_r('r', 'r')}, {_r('n * (n + 2.0e0) * r * r / (n - lag)', 'q_part')} FROM (SELECT h.lag, any_value(a.n) AS n, sum(a.c * b.c) / (SELECT sum(c * c) FROM y) AS r FROM h, y a, y b WHERE b.t = a.t - h.lag GROUP BY 1)").replace(CTE.strip() + "\n,", CTE.strip() + ","),
        "runs": _sql(f"SELECT ties, np AS n_plus, nm AS n_minus, ch + 1 AS runs, {_r('mu', 'mu')}, {_r('abs(ch + 1 - mu)', 'statistic')} FROM (SELECT *, 1 + 2.0e0 * np * nm / (np + nm) AS mu FROM (SELECT count(*) FILTER (WHERE up) AS np, count(*) FILTER (WHERE NOT up) AS nm, count(*) FILTER (WHERE up <> before) AS ch FROM (SELECT up, lag(up) OVER (ORDER BY t) AS before FROM (SELECT t, \"sum\" > 168 AS up FROM metrics WHERE \"sum\" <> 168))), (SELECT count(*) FILTER (WHERE \"sum\" = 168) AS ties FROM metrics))"),
        "year_homogeneity": _sql(f"SELECT {_r('sum((coalesce(o, 0) - s * f / n) ** 2 / (s * f / n))', 'statistic')} FROM (SELECT year(draw_date) AS y, CAST(count(*) AS DOUBLE) AS s FROM draws GROUP BY 1) CROSS JOIN (SELECT num, count(*) AS f FROM long GROUP BY 1) LEFT JOIN (SELECT year(draw_date) AS y, num, count(*) AS o FROM long GROUP BY 1, 2) USING (y, num), total"),
        "rolling_chi2": _sql(f"SELECT win, {_r('sum((coalesce(o, 0) - 170.0e0 * f / n) ** 2 / (170.0e0 * f / n))', 'x2')} FROM (SELECT CAST(unnest(range(0, (n - 170) // 85 + 1)) AS BIGINT) AS win FROM total) CROSS JOIN (SELECT num, count(*) AS f FROM long GROUP BY 1) LEFT JOIN (SELECT win, num, count(*) AS o FROM long JOIN (SELECT CAST(unnest(range(0, (n - 170) // 85 + 1)) AS BIGINT) AS win FROM total) ON t > win * 85 AND t <= win * 85 + 170 GROUP BY 1, 2) USING (win, num), total GROUP BY 1"),
        "holm": _sql(f"SELECT number, p, round(max(step) OVER (ORDER BY i), {DIGITS}) AS p_holm FROM (SELECT number, p, row_number() OVER (ORDER BY p) AS i, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p) AS step FROM (SELECT num AS number, round(2 / (1 + exp(abs({_zs('coalesce(c, 0)', 'n', p)}) * 1.702e0)), 6) AS p FROM nums LEFT JOIN (SELECT num, count(*) AS c FROM long GROUP BY 1) USING (num), total))"),
        "rule_records": _sql("SELECT draw_id, rule, severity, detail FROM finds"),
        "rule_duplicate_content": _sql(f"SELECT draw_id, first_id FROM (SELECT draw_id, first_value(draw_id) OVER (PARTITION BY {ident}, special_number ORDER BY CAST(draw_id AS BIGINT)) AS first_id FROM (SELECT draw_id, {ident}, special_number FROM draws UNION ALL SELECT CAST(CAST(draw_id AS BIGINT) + 50000 AS VARCHAR), {ident}, special_number FROM draws WHERE t % 40 = 0)) WHERE first_id <> draw_id"),
        "last_by_id": _sql("SELECT draw_id, list(special_number ORDER BY arrival DESC)[1] AS special_number, max(arrival) AS arrival FROM (SELECT draw_id, special_number, t AS arrival FROM draws UNION ALL SELECT draw_id, special_number, t + 1000000 FROM mirror) GROUP BY 1"),
        "expected_latest": f"SELECT CAST(max(day) AS DATE) AS day FROM (SELECT unnest(range(CAST(TIMESTAMP '{AS_OF}' + INTERVAL 7 HOUR AS DATE) - 14, CAST(TIMESTAMP '{AS_OF}' + INTERVAL 7 HOUR AS DATE) + 1, INTERVAL 1 DAY)) AS day) WHERE isodow(day) IN (2, 4, 6) AND day + INTERVAL 14 HOUR <= TIMESTAMP '{AS_OF}'",
        "chunked_version": _sql(f"SELECT CAST(sum(n) AS BIGINT) AS draws, 'dc_' || substr(sha256(string_agg(digest, chr(10) ORDER BY chunk)), 1, 12) AS chunk_version FROM (SELECT (t - 1) // 100000 AS chunk, count(*) AS n, sha256(string_agg({line}, chr(10) ORDER BY t)) AS digest FROM draws GROUP BY 1)"),
        "rule_chronology": _sql("SELECT draw_id, draw_date, prev_draw_id, prev_draw_date FROM prev WHERE draw_date <= prev_draw_date"),
        "rule_continuity": _sql("SELECT draw_id, prev_no FROM (SELECT draw_id, CAST(draw_id AS BIGINT) AS no, lag(CAST(draw_id AS BIGINT)) OVER (ORDER BY CAST(draw_id AS BIGINT)) AS prev_no FROM draws WHERE t % 97 <> 0) WHERE no <> prev_no + 1"),
        "rule_id_conflict": _sql(f"SELECT draw_id, count(*) AS contents FROM (SELECT DISTINCT draw_id, draw_date, {ident}, special_number FROM (SELECT * FROM draws UNION ALL SELECT * FROM mirror)) GROUP BY 1 HAVING count(*) > 1"),
        "dedupe_exact": _sql(f"SELECT draw_id, arrival FROM (SELECT draw_id, arrival, row_number() OVER (PARTITION BY draw_id, draw_date, {ident}, special_number ORDER BY arrival) AS i FROM (SELECT *, t AS arrival FROM draws UNION ALL SELECT *, t + 1000000 FROM draws WHERE t % 5 = 0)) WHERE i = 1"),
        "merge_incremental": _sql(f"SELECT draw_id, {ident} FROM draws WHERE t % 3 = 0 OR draw_id NOT IN (SELECT draw_id FROM finds WHERE severity = 'error')"),
        "cadence_gaps": _sql("SELECT draw_id, CAST(day AS DATE) AS day FROM (SELECT draw_id, unnest(range(prev_draw_date + 1, draw_date, INTERVAL 1 DAY)) AS day FROM prev WHERE draw_date - prev_draw_date > 1) WHERE isodow(day) IN (2, 4, 6)"),
        "missed_dates": _sql(f"SELECT CAST(day AS DATE) AS day FROM (SELECT unnest(range(max(draw_date) + 1, DATE '1998-12-31', INTERVAL 1 DAY)) AS day FROM draws WHERE draw_date < DATE '{EARLY}') WHERE isodow(day) IN (2, 4, 6) AND day + INTERVAL 14 HOUR <= TIMESTAMP '{AS_OF}'"),
        "reconcile_fields": _sql(fields),
        "reconcile_only_left": _sql("SELECT draw_id FROM draws WHERE draw_id NOT IN (SELECT draw_id FROM mirror)"),
        "reconcile_only_right": _sql("SELECT draw_id FROM mirror WHERE draw_id NOT IN (SELECT draw_id FROM draws)"),
        "reconcile_assessment": _sql(f"SELECT DISTINCT draw_id, 'mismatch' AS rule, 'FAIL' AS level, draw_id NOT IN (SELECT draw_id FROM draws WHERE t % 2 = 0) AS blocking FROM ({fields}) UNION ALL SELECT draw_id, CASE WHEN late THEN 'mirror_lag' ELSE 'only_left' END, CASE WHEN late AND i <= 3 THEN 'INFO' ELSE 'WARN' END, false FROM (SELECT draw_id, late, row_number() OVER (PARTITION BY late ORDER BY CAST(draw_id AS BIGINT)) AS i FROM (SELECT draw_id, CAST(draw_id AS BIGINT) > (SELECT max(CAST(draw_id AS BIGINT)) FROM mirror) AS late FROM draws WHERE draw_id NOT IN (SELECT draw_id FROM mirror))) UNION ALL SELECT draw_id, 'only_right', 'WARN', false FROM mirror WHERE draw_id NOT IN (SELECT draw_id FROM draws)"),
        "lineage_anti": _sql(f"SELECT draw_id FROM (SELECT draw_id, draw_date, {ident}, special_number FROM draws EXCEPT ALL SELECT draw_id, draw_date, {ident}, special_number FROM mirror)"),
        "latest_runs": _sql("SELECT source, max(run_id) AS run_id, max_by(status, run_id) AS status FROM (SELECT 's' || CAST(t % 3 AS VARCHAR) AS source, draw_id AS run_id, CASE WHEN t % 7 = 0 THEN 'failed' ELSE 'success' END AS status FROM draws) GROUP BY 1"),
        "fold_metrics": _sql(f"SELECT config, period, count(*) AS draws, {_r('avg(log_loss)', 'log_loss')}, {_r('avg(brier)', 'brier')}, {_r('avg(abs(sum_forecast - sum_actual))', 'mae')}, {_r('sqrt(avg((sum_forecast - sum_actual) ** 2))', 'rmse')}, CAST(sum(n_clipped) AS BIGINT) AS n_clipped FROM ds JOIN per USING (t) GROUP BY 1, 2"),
        "delta_vs_b0": _sql(f"SELECT a.config, period, {_r('avg(a.log_loss - b.log_loss)', 'delta_log_loss')}, {_r('avg(a.brier - b.brier)', 'delta_brier')}, {_r('sqrt(avg((a.sum_forecast - a.sum_actual) ** 2)) - sqrt(avg((b.sum_forecast - b.sum_actual) ** 2))', 'delta_rmse')} FROM ds a JOIN ds b ON a.t = b.t AND b.config = 'B0' JOIN per ON per.t = a.t WHERE a.config <> 'B0' GROUP BY 1, 2"),
        "w_selection": _sql("SELECT max(width) AS width FROM (SELECT width, loss, min(loss) OVER () AS least FROM (SELECT CAST(regexp_extract(config, '[0-9]+$') AS BIGINT) AS width, avg(log_loss) AS loss FROM ds WHERE t > 500 AND config LIKE 'B2%' GROUP BY 1)) WHERE loss <= least + 1.0e-12"),
    }
    levels = ", ".join(f"{k / 10}e0" for k in range(1, 10))
    bins = f"SELECT config, CAST(len(list_filter(list_distinct(edges), lambda e: e <= p)) AS BIGINT) AS bin, p, y FROM (SELECT config, p, y FROM sc WHERE t > 500 AND config <> 'B0') JOIN (SELECT config, quantile_cont(p, [{levels}]) AS edges FROM sc WHERE t > 500 AND config <> 'B0' GROUP BY 1) USING (config)"
    out["reliability"] = _sql(f"SELECT config, bin, count(*) AS n, {_r('avg(p)', 'mean_p')}, {_r('avg(y)', 'mean_y')}, {_r('min(p)', 'min_p')}, {_r('max(p)', 'max_p')} FROM ({bins}) GROUP BY 1, 2")
    out["ece"] = _sql(f"SELECT config, {_r('sum(n * abs(mp - my)) / sum(n)', 'ece')} FROM (SELECT config, bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM ({bins}) GROUP BY 1, 2) GROUP BY 1")
    for w in WIDTHS:
        roll = f"SELECT t, num AS number, observed, {_zs('observed', str(w), p)} AS z FROM (SELECT t, num, CAST(sum(y) OVER (PARTITION BY num ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS observed FROM grid) WHERE t >= {w}"
        out[f"rolling_counts_w{w}"] = _sql(f"SELECT t, number, observed, {_r('z', 'z')} FROM ({roll})")
        out[f"rolling_extremes_w{w}"] = _sql(f"SELECT t, {_r('max(z)', 'max_z')}, {_r('min(z)', 'min_z')} FROM ({roll}) GROUP BY 1")
    out |= _null_oracles(out["number_frequency"], p)
    out |= _effect_oracles(out)
    out |= _band_oracles(out)
    everywhere = out["reconcile_assessment"].split(CTE.strip(), 1)[1].replace("draw_id NOT IN (SELECT draw_id FROM draws WHERE t % 2 = 0)", "false")
    out |= quality_queries.oracle_sql(CTE.strip(), everywhere)
    out |= stream_queries.oracle_sql(CTE.strip())
    for b in BLOCKS:
        out[f"block_stability_number_{b}"] = _blocks("num", "SELECT t, num FROM long", "SELECT num FROM nums", b)
        out[f"block_stability_pair_{b}"] = _blocks("num, other", pairs, pair_grid, b)
    for m in describe.METRICS:
        out[f"metric_histogram_{m}"] = _sql(f"SELECT metric, value, count(*) AS observed FROM vals WHERE metric = '{m}' GROUP BY 1, 2")
    for c in ("B0", "B1", *(f"B2_w{w}" for w in WIDTHS)):
        out[f"scores_{c.lower()}"] = _sql(f"SELECT t, {_r('log_loss', 'log_loss')}, {_r('brier', 'brier')}, {_r('sum_p', 'sum_p')}, {_r('sum_forecast', 'sum_forecast')}, sum_actual, n_clipped FROM ds WHERE config = '{c}'")
    for m in ("sum", "range"):
        rows, total = [], 0.0
        for v, q in nulls.PMFS[m]().items():
            total += q
            rows.append(f"({v}, CAST({total!r} AS DOUBLE))")
        out[f"ks_{m}"] = _sql(f"SELECT {_r('max(abs(f - f0))', 'statistic')} FROM (SELECT f0, sum(coalesce(c, 0)) OVER (ORDER BY value) / CAST(n AS DOUBLE) AS f FROM (VALUES {', '.join(rows)}) s(value, f0) LEFT JOIN (SELECT \"{m}\" AS value, count(*) AS c FROM metrics GROUP BY 1) USING (value), total)")
    return out
