"""Summaries of the three analyses as text: what was observed, how it stands against chance, and what it can't say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.operators import baselines, describe

LIMITS = (
    "Bands and envelopes hold for each cell by itself; across many cells some lie outside by chance.",
    "Nothing here says anything about draws to come, and no number is singled out.",
)


def _text(title: str, about: dict, parts: dict[str, list[str]], limits: tuple[str, ...] = LIMITS) -> str:
    lines = [f"# {title}", "", *[f"{k}: {v}" for k, v in about.items()], ""]
    for name, own in (parts | {"Limits": [f"- {x}" for x in limits]}).items():
        lines += [f"## {name}", "", *own, ""]
    return "\n".join(lines)


def described(draws: DataFrame, bounds: DataFrame, widths: list[int], blocks: int, about: dict) -> str:
    """Summarise the descriptive tables: counts outside pointwise bands, simultaneous bounds and envelopes. ``bounds`` is ``mc_reference``."""
    lo_hi = {r["name"]: r for r in bounds.collect()}
    cells = describe.metric_distribution(draws)
    out = (F.col("observed") < F.col("band_lo")) | (F.col("observed") > F.col("band_hi"))
    by_metric = cells.groupBy("metric").agg(F.count(F.lit(1)).alias("cells"), F.count_if(out).alias("outside"))
    means = describe.metric_summary(draws).select("metric", "mean", "null_mean")
    rows = sorted(by_metric.join(means, "metric").collect(), key=lambda r: describe.METRICS.index(r["metric"]))
    metrics = [f"{r['metric']}: mean {r['mean']:.4f} (chance {r['null_mean']:.4f}); {r['outside']} of {r['cells']} cells outside the band." for r in rows]

    def simultaneous(df: DataFrame, least: str, most: str) -> int:
        a, b = lo_hi[least]["lo"], lo_hi[most]["hi"]
        return df.where((F.col("observed") < a) | (F.col("observed") > b)).count() if a is not None and b is not None else 0

    beyond = {
        "main": simultaneous(describe.number_frequency(draws), "min_count", "max_count"), "special": simultaneous(describe.special_frequency(draws), "min_special", "max_special"),
        "pairs": simultaneous(describe.pair_counts(draws), "min_pair", "max_pair"),
    }
    bands = {r["scope"]: r for r in describe.outside_bands(draws).collect()}
    counts = [f"{s}: {bands[s]['outside']} of {bands[s]['cells']} outside the band ({bands[s]['expected']:.2f} expected); {beyond[s]} outside the simultaneous bounds." for s in ("main", "special", "pairs")]
    rolling = []
    for w in widths:
        if f"max_z_w{w}" in lo_hi:
            r = describe.rolling_extremes(draws, w).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("max_z") > lo_hi[f"max_z_w{w}"]["hi"]).alias("above"), F.count_if(F.col("min_z") < lo_hi[f"min_z_w{w}"]["lo"]).alias("below")).first()
            rolling.append(f"Window of {w}: {r['above']} of {r['n']} above and {r['below']} below the pointwise envelope (windows overlap).")
    stable = []
    for kind, pairs in (("number", False), ("pair", True)):
        rows = describe.block_stability(draws, blocks, pairs=pairs).collect()
        far = sum(not lo_hi[f"stability_{kind}_{r['a']}-{r['b']}"]["lo"] <= r["r"] <= lo_hi[f"stability_{kind}_{r['a']}-{r['b']}"]["hi"] for r in rows if r["r"] is not None)
        stable.append(f"{kind}s between blocks: {far} of {len(rows)} correlations outside their interval ({0.05 * len(rows):.2f} expected).")
    return _text("Description", about, {"Draws": metrics, "Numbers and pairs": counts + rolling + stable})


def inferred(family: DataFrame, effects: DataFrame, exploratory: DataFrame, about: dict) -> str:
    """Summarise the confirmatory family: effects, decisions, rows that were superseded, and what is exploratory."""
    sizes: dict[str, list[str]] = {}
    for r in effects.orderBy("test", "effect").collect():
        sizes.setdefault(r["test"], []).append(f"{r['effect']} {r['value']:.4f}" if r["value"] is not None else f"{r['effect']} undefined")
    rows = sorted(family.collect(), key=lambda r: (r["replicates"], int(r["test"][1:])))
    last = [r for r in rows if r["decision"] != "superseded"]
    seen = [f"{r['test']}: {'; '.join(sizes.get(r['test'], ['no effect size']))}." for r in last]
    table = ["| test | statistic | p | adjusted | replicates | decision |", "|-|-|-|-|-|-|"]
    table += [f"| {r['test']} | {r['statistic']:.4f} | {r['p']:.5f} | {r['p_holm']:.5f} | {r['replicates']} | {r['decision']} |" for r in rows]
    n = sum(r["decision"] == "reject" for r in last)
    says = [f"{n} of {len(last)} tests are rejected at 5 % after adjustment." if n else "No test is rejected at 5 % after adjustment. That isn't evidence that draws can be foreseen."]
    more = [f"{r['name']}: statistic {r['statistic']:.4f}, {r['df']} degrees of freedom, p {r['p']:.5f}." for r in exploratory.orderBy("name").collect()]
    limits = (*LIMITS, "Parts of a test are to be interpreted only if the test itself is rejected.", "Exploratory statistics are unadjusted.")
    return _text("Confirmatory family", about, {"Observed": seen, "Evidence": table, "Interpretation": says, "Exploratory": more}, limits)


def evaluated(intervals: DataFrame, selected: int, draws: int, about: dict) -> str:
    """Summarise the baseline experiment: scores by fold, differences to B0 with their intervals, the selected width."""
    rows = {(r["period"], r["config"], r["metric"]): r for r in intervals.collect()}
    periods, configs = sorted({k[0] for k in rows}), sorted({k[1] for k in rows})
    folds = [
        f"{p} ({rows[p, 'B0', 'log_loss']['draws']} draws): " + "; ".join(f"{c} {rows[p, c, 'log_loss']['value']:.5f} / {rows[p, c, 'brier']['value']:.5f}" for c in configs)
        for p in periods if p.startswith("fold")
    ]
    deltas = []
    for p in ("dev_pooled", "validation"):
        for c in ("B1", f"B2_w{selected}"):
            if r := rows.get((p, c, "delta_log_loss")):
                deltas.append(f"{p} {c}: log loss less B0's {r['value']:.5f} (95 % interval {r['lo']:.5f} to {r['hi']:.5f}).")
    excess = [f"{c}: by chance alone, log loss above B0's by {x:.5f} and Brier score by {y:.5f}." for c, m in (("B1", draws), (f"B2_w{selected}", selected)) for x, y in (baselines.null_excess(m),)]
    limits = (*LIMITS, "Scores judge numbers one by one; what numbers do together isn't scored.", "Folds come from one series, and their intervals rest on few blocks.", "The validation period chose the width, so its scores flatter it.")
    return _text("Baseline experiment", about | {"selected width": selected}, {"Log loss / Brier score by fold": folds, "Differences": deltas, "Chance": excess}, limits)
