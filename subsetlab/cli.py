"""Command line: ``python -m subsetlab.cli <command> --root FOLDER``. Exit codes are those of ``plans.refresh``; 2 is a refusal."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from subsetlab import logs
from subsetlab.operators import baselines, describe, infer
from subsetlab.plans import known_issues, montecarlo, publish, refresh, summaries


def _files(path: str) -> refresh.Fetch:
    """Fetch one local file as a single page: a source without a network."""
    def fetch(last: str | None):
        with open(path, encoding="utf-8") as f:
            yield 0, f.read()

    return fetch


def describe_run(spark: SparkSession, root: str, out: str, through: str | None, widths: list[int], blocks: int, reps: int, ceiling: str | None = None, override: str | None = None) -> dict:
    """Write the descriptive tables and the Monte Carlo bounds of draws up to ``through``.

    ``override`` names the decision (as REVIEW-12) that allows draws above the ceiling.
    """
    if override is not None and not known_issues.REFERENCE.fullmatch(override):
        raise PermissionError(f"{override!r} doesn't name a decision")
    draws = refresh.loaded(spark, root, through, ceiling).cache()
    n, special = draws.count(), draws.where("special_number is not null").count()
    tables = {
        "number_frequency": (describe.number_frequency(draws), ["number"]), "special_frequency": (describe.special_frequency(draws), ["number"]),
        "draw_metrics": (describe.draw_metrics(draws), ["t"]), "metric_distribution": (describe.metric_distribution(draws), ["metric", "place"]),
        "metric_summary": (describe.metric_summary(draws), ["metric"]), "frequency_by_year": (describe.frequency_by_period(draws, "year"), ["period", "number"]),
        "frequency_by_quarter": (describe.frequency_by_period(draws, "quarter"), ["period", "number"]), "cumulative_counts": (describe.cumulative_counts(draws), ["t", "number"]),
        "interarrival": (describe.interarrival(draws), ["place"]), "appearance_summary": (describe.appearance_summary(draws), ["number"]), "pairs": (describe.pair_counts(draws), ["a", "b"]),
        "pair_count_distribution": (describe.pair_count_distribution(draws), ["count"]), "block_stability_number": (describe.block_stability(draws, blocks), ["a", "b"]),
        "block_stability_pair": (describe.block_stability(draws, blocks, pairs=True), ["a", "b"]),
        "mc_reference": (montecarlo.mc_reference(spark, n, special, tuple(w for w in widths if w <= n), reps, blocks=blocks), ["name"]),
    }
    for w in widths:
        tables[f"rolling_counts_w{w}"] = (describe.rolling_counts(draws, w), ["t", "number"])
        tables[f"rolling_extremes_w{w}"] = (describe.rolling_extremes(draws, w), ["t"])
    small = {k: publish.is_small(df) for k, (df, _) in tables.items()}
    files = {f"{k}.csv": publish.to_csv(df, order) for k, (df, order) in tables.items() if small[k]}
    about = {"draws": n, "with a special number": special, "through": through, "tables": len(files), "replicates": reps, "override": override}
    files["summary.md"] = summaries.described(draws, tables["mc_reference"][0], widths, blocks, about)
    large = {f"{k}.csv": x for k, x in tables.items() if not small[k]}
    return publish.publish(out, files, {"draws": n, "through": through, "replicates": reps}, large=large)


def infer_run(spark: SparkSession, root: str, out: str, through: str | None, reps: int, ceiling: str | None = None) -> dict:
    draws = refresh.loaded(spark, root, through, ceiling).cache()
    family, effects, more = montecarlo.family(draws, reps), infer.effects(draws), montecarlo.exploratory(draws, reps)
    files = {"family.csv": publish.to_csv(family, ["replicates", "test"]), "effects.csv": publish.to_csv(effects, ["test", "effect"]), "exploratory.csv": publish.to_csv(more, ["name"])}
    for test in ("C1", "C2", "C3", "C4", "C5", "C7", "C8", "C11", "C12", "C13"):
        files[f"followup_{test}.csv"] = publish.to_csv(montecarlo.interpreted(montecarlo.follow_up(draws, test, reps), test, family), ["part"])
    files["summary.md"] = summaries.inferred(family, effects, more, {"through": through, "replicates": reps})
    return publish.publish(out, files, {"through": through, "replicates": reps})


def evaluate_run(spark: SparkSession, root: str, out: str, through: str | None, reps: int, ceiling: str | None = None) -> dict:
    """Score the baselines and write their metrics; a run's folder is written once."""
    draws = refresh.loaded(spark, root, through, ceiling).cache()
    n = draws.count()
    scored = baselines.scores(draws).cache()
    per = baselines.draw_scores(scored).where(f"t > {baselines.INITIAL}").cache()
    membership = baselines.periods(draws, n)
    bins = baselines.reliability(scored.where(f"t > {baselines.INITIAL}"), ["config"])
    intervals = montecarlo.experiment(draws, reps).cache()
    files = {
        "draw_scores.csv": publish.to_csv(per, ["config", "t"]), "metrics.csv": publish.to_csv(baselines.period_metrics(per, membership), ["config", "period"]),
        "deltas.csv": publish.to_csv(baselines.deltas(per, membership), ["config", "period"]), "reliability.csv": publish.to_csv(bins, ["config", "bin"]),
        "sanity.csv": publish.to_csv(baselines.sanity(per, bins, membership), ["check"]),
        "ece.csv": publish.to_csv(baselines.ece(bins, ["config"]), ["config"]),
        "intervals.csv": publish.to_csv(intervals, ["period", "config", "metric"]),
    }
    losses = intervals.where("period = 'validation' and metric = 'log_loss' and config like 'B2%'").select(F.regexp_extract("config", "[0-9]+$", 0).cast("long").alias("width"), F.col("value").alias("loss"))
    selected = baselines.select_width(losses).first()["width"]
    files["summary.md"] = summaries.evaluated(intervals, selected, n, {"draws": n, "through": through, "resamples": reps})
    return publish.publish(out, files, {"through": through, "resamples": reps}, replace=False)


log = logging.getLogger("subsetlab.cli")
#: Problems that are written out; their number is given as well.
SHOWN = 1000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="subsetlab")
    p.add_argument("--root", required=True)
    p.add_argument("--log-level", default="WARNING")
    p.add_argument("--log-file")
    sub = p.add_subparsers(dest="command", required=True)
    now = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
    a = sub.add_parser("ingest")
    a.add_argument("--source", required=True)
    a.add_argument("--file", required=True)
    a.add_argument("--full", action="store_true")
    a.add_argument("--start")
    a.add_argument("--end")
    a = sub.add_parser("curate")
    a.add_argument("--source", default="official")
    a = sub.add_parser("reconcile")
    a.add_argument("--left", default="official")
    a.add_argument("--right", default="mirror")
    sub.add_parser("verify-raw")
    for name in ("quality-report", "refresh", "status"):
        a = sub.add_parser(name)
        a.add_argument("--as-of", default=now)
        a.add_argument("--known-issues")
        a.add_argument("--official")
        a.add_argument("--mirror")
        a.add_argument("--out-dir")
        a.add_argument("--lock-timeout-minutes", type=int, default=120)
    for name, reps in (("eda", 10_000), ("m4", 10_000), ("m5-exp001", 10_000)):
        a = sub.add_parser(name)
        a.add_argument("--through-draw")
        a.add_argument("--ceiling", help="the largest draw that is open to this analysis")
        a.add_argument("--override-ceiling", help="a reference for looking at draws above the ceiling (eda only)")
        a.add_argument("--out-dir", required=True)
        a.add_argument("--reps", type=int, default=reps)
        a.add_argument("--windows", default="50,100,200")
        a.add_argument("--n-blocks", type=int, default=4)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    logs.configure(a.log_level, a.log_file)
    spark = spark or SparkSession.builder.appName("subsetlab").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if a.command == "ingest":
            with publish.Lock(f"{a.root}/refresh.lock"):
                r = refresh.ingest(spark, a.root, a.source, _files(a.file), "full" if a.full else "incremental", a.start, a.end)
            code = 1 if r["status"] == "partial" else 0
        elif a.command == "curate":
            with publish.Lock(f"{a.root}/refresh.lock"):
                r = refresh.curate(spark, a.root, a.source)
            code = 30 if r["status"] == "blocked" else 0
        elif a.command == "reconcile":
            r = refresh.reconcile(spark, a.root, a.left, a.right)
            code = 1 if r["mismatches"] else 0
        elif a.command == "verify-raw":
            found = refresh.verify_raw(spark, a.root).persist()
            r = {"count": found.count(), "problems": [x.asDict() for x in found.orderBy("path").limit(SHOWN).collect()]}
            code = 1 if r["count"] else 0
        elif a.command == "quality-report":
            try:
                r = refresh.quality_report(spark, a.root, a.as_of, issues_path=a.known_issues, out=a.out_dir)
                code = r["exit_code"]
            except (FileNotFoundError, ValueError):
                raise
            except Exception as e:
                log.exception("quality report failed")
                r, code = {"error": str(e)[:500]}, 50
        elif a.command == "refresh":
            r = refresh.refresh(spark, a.root, {k: _files(v) for k, v in (("official", a.official), ("mirror", a.mirror)) if v}, a.as_of, issues_path=a.known_issues, stale=60.0 * a.lock_timeout_minutes)
            code = r["exit_code"]
        elif a.command == "status":
            r = refresh.status(spark, a.root, a.as_of)
            code = r["exit_code"]
        elif a.command == "eda":
            r, code = describe_run(spark, a.root, a.out_dir, a.through_draw, [int(x) for x in a.windows.split(",")], a.n_blocks, a.reps, None if a.override_ceiling else a.ceiling, a.override_ceiling), 0
        elif a.command == "m4":
            r, code = infer_run(spark, a.root, a.out_dir, a.through_draw, a.reps, a.ceiling), 0
        else:
            r, code = evaluate_run(spark, a.root, a.out_dir, a.through_draw, a.reps, a.ceiling), 0
    except BlockingIOError:
        r, code = {"locked": True}, 40
    except (PermissionError, ValueError, FileExistsError, FileNotFoundError) as e:
        r, code = {"refused": str(e)}, 2
    print(json.dumps(r, sort_keys=True, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main())
