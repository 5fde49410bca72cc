"""The data path: ingest, curate, reconcile, quality report, refresh and status, over one root folder.

Folders: raw/<source>/<run>, staging/<source>, curated/fact_draw, curated/fact_draw_number, curated/dim_number,
curated/dataset_manifest.json (written last), logs/*, reports/. Every step's tables are Spark jobs; logs are rows
appended to Parquet folders.
"""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable, Iterable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsetlab.model import CONTENT, K, MAIN, content_version, dim_number, fact_draw_number
from subsetlab.operators import rules
from subsetlab.plans import known_issues, publish, quality
from subsetlab.session import cut, ship
from subsetlab.sources import archive

logger = logging.getLogger("subsetlab.refresh")
RUNS = "run_id string, source string, mode string, started_at string, finished_at string, rows_received long, rows_inserted long, rows_skipped long, status string, error_message string"
LOGGED = "check_id string, run_id string, draw_id string, rule string, status string, detail string"
REFRESHES = "run_id string, started_at string, as_of string, exit_code int, steps string, version_before string, version_after string, report_sha256 string"
STAGED = "draw_id string, draw_date date, " + ", ".join(f"{c} long" for c in MAIN) + ", special_number long, source string, raw_run_id string"
#: Ids up to here never change once they are published; None switches the check off.
Frozen = tuple[str, int, str] | None
#: A fetch gives pages in turn: (index, content).
Fetch = Callable[[str | None], Iterable[tuple[int, str]]]


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="microseconds")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not os.path.isdir(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def append(spark: SparkSession, path: str, schema: str, rows: list[tuple]) -> None:
    if rows:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def staging(spark: SparkSession, root: str, source: str) -> DataFrame:
    return publish.read_ranges(spark, f"{root}/staging/{source}", STAGED)


def to_staged(records: DataFrame, run_id: str) -> DataFrame:
    cells = [F.get("main", F.lit(i)).cast("long").alias(c) for i, c in enumerate(MAIN)]
    return records.select("draw_id", "draw_date", *cells, F.col("special").cast("long").alias("special_number"), "source", F.lit(run_id).alias("raw_run_id"))


def data_set_findings(draws: DataFrame) -> DataFrame:
    """Return findings (draw_id, rule, severity, detail) of the rules that look at a draw and others: content, dates, numbers in turn."""
    found = (
        (rules.duplicate_content(draws), "duplicate_content", "warning", "first_id"), (rules.chronology(draws), "chronological_order", "error", "prev_draw_id"),
        (rules.continuity(draws), "draw_id_continuity", "warning", "prev_no"),
    )
    out = [df.select("draw_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(c).cast("string").alias("detail")) for df, rule, severity, c in found]
    return out[0].unionByName(out[1]).unionByName(out[2])


def ingest(spark: SparkSession, root: str, source: str, fetch: Fetch, mode: str = "incremental", start: str | None = None, end: str | None = None) -> dict:
    """Fetch pages, archive and parse them, check the records, and add new ones to staging; history isn't rewritten.

    Status is success, partial (some records were refused) or failed (nothing could be read; the error is raised again).
    """
    from subsetlab.sources.pages import between

    ship(spark)
    if (start or end) and mode != "full":
        raise ValueError("dates need a full load")
    run_id = datetime.now(UTC).strftime("%Y%m%dT%H%M%S%fZ")
    started = _now()
    stored = staging(spark, root, source)
    last = stored.agg(F.max("draw_id").alias("x")).first()["x"] if mode == "incremental" else None
    received = inserted = 0
    logger.info("ingestion started", extra={"run": run_id, "source": source, "mode": mode, "stop_at": last})
    try:
        for index, content in fetch(last):
            archive.write_page(f"{root}/raw", run_id, source, index, content)
        if not os.path.isdir(f"{root}/raw/{source}/{run_id}"):
            append(spark, f"{root}/logs/ingestion", RUNS, [(run_id, source, mode, started, _now(), 0, 0, 0, "success", None)])
            return {"run_id": run_id, "status": "success", "received": 0, "inserted": 0}
        pages = archive.pages(spark, f"{root}/raw").where(F.col("run_id") == run_id)
        parsed = between(archive.parse(source, pages), start, end).persist()
        received = parsed.count()
        today = F.to_date(F.from_utc_timestamp(F.current_timestamp(), rules.ZONE))
        good = parsed.where("error is null")
        unreadable = parsed.where("error is not null").select(F.col("file").alias("draw_id"), F.lit("parse").alias("rule"), F.lit("error").alias("severity"), F.col("error").alias("detail"))
        staged = rules.exact_duplicates_removed(to_staged(good, run_id).withColumn("_arrival", F.monotonically_increasing_id()), "_arrival").drop("_arrival")
        # Stored rows that can matter to the records: those of their ranges of ids.
        near = publish.read_ranges(spark, f"{root}/staging/{source}", STAGED, staged)
        conflicts = rules.id_conflicts(staged).select("draw_id", F.lit("draw_id_unique").alias("rule"), F.lit("error").alias("severity"), F.col("contents").cast("string").alias("detail"))
        changed = rules.stored_conflicts(staged, near).select("draw_id", F.lit("stored_row_conflict").alias("rule"), F.lit("error").alias("severity"), F.col("field").alias("detail"))
        alone = rules.record_findings(good, today).unionByName(unreadable).unionByName(conflicts).unionByName(changed)
        bad = alone.where("severity = 'error'").select("draw_id")
        # Rules of the data set look at what would be stored; only new rows can be refused.
        fresh = staged.select("draw_id").distinct().join(near.select("draw_id"), "draw_id", "left_anti")
        together = data_set_findings(with_t(rules.merge_new(stored, staged, bad))).join(fresh, "draw_id", "left_semi")
        # Written out, as the merge replaces files that these rows come from.
        every = cut(alone.unionByName(together))
        bad = every.where("severity = 'error'").select("draw_id")
        added = cut(staged.join(near.select("draw_id"), "draw_id", "left_anti").join(bad.distinct(), "draw_id", "left_anti"))
        inserted = added.count()
        if inserted:
            publish.merge_ranges(added, f"{root}/staging/{source}", STAGED)
        log = every.select(F.concat_ws("-", F.lit(run_id), "rule", "draw_id").alias("check_id"), F.lit(run_id).alias("run_id"), "draw_id", "rule", F.col("severity").alias("status"), "detail")
        log.write.mode("append").parquet(f"{root}/logs/quality")
        status = "partial" if every.where("severity = 'error'").limit(1).count() else "success"
        append(spark, f"{root}/logs/ingestion", RUNS, [(run_id, source, mode, started, _now(), received, inserted, received - inserted, status, None)])
        parsed.unpersist()
    except Exception as e:
        append(spark, f"{root}/logs/ingestion", RUNS, [(run_id, source, mode, started, _now(), received, 0, received, "failed", str(e)[:500])])
        raise
    logger.info("ingestion finished", extra={"run": run_id, "source": source, "status": status, "received": received, "inserted": inserted})
    return {"run_id": run_id, "status": status, "received": received, "inserted": inserted}


def with_t(staged: DataFrame) -> DataFrame:
    from subsetlab.model import with_ordinal

    # Ids share long prefixes, so the prefix without the last two digits makes coarse groups in the same order.
    no = F.col("draw_id").cast("long")
    return with_ordinal(staged.withColumns({"_coarse": F.floor(no / 1000), "_fine": no}), "_coarse", "_fine").drop("_coarse", "_fine")


def manifest(root: str) -> dict | None:
    path = f"{root}/curated/dataset_manifest.json"
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def frozen_problem(draws: DataFrame, frozen: Frozen) -> str | None:
    """Tell what is wrong with the frozen prefix (last id, rows, version), or None."""
    if frozen is None:
        return None
    last, rows, version = frozen
    r = content_version(draws.where(F.col("draw_id") <= last)).first()
    return None if (r["draws"], r["dataset_version"]) == (rows, version) else f"frozen prefix has {r['draws']} rows and version {r['dataset_version']}"


def curate(spark: SparkSession, root: str, source: str = "official", frozen: Frozen = None) -> dict:
    """Build the star schema from staging: facts, the number dimension, and the manifest last."""
    draws = with_t(staging(spark, root, source)).persist()
    broken = rules.record_findings(draws.select("draw_id", "draw_date", F.array(*MAIN).alias("main"), F.col("special_number").alias("special")), F.current_date()).where("severity = 'error'").limit(1).count()
    problem = frozen_problem(draws, frozen) or ("staging has records with errors" if broken else None)
    if problem:
        return {"status": "blocked", "reason": problem}
    r = content_version(draws).first()
    before = manifest(root)
    if before and before["dataset_version"] == r["dataset_version"]:
        return {"status": "unchanged", "dataset_version": r["dataset_version"]}
    fact = draws.withColumn("dataset_version", F.lit(r["dataset_version"]))
    long = fact_draw_number(draws).withColumn("dataset_version", F.lit(r["dataset_version"]))
    ends = draws.agg(F.min("draw_id").alias("a"), F.max("draw_id").alias("b"), F.count("special_number").alias("s")).first()
    for name, df in (("fact_draw", fact), ("fact_draw_number", long), ("dim_number", dim_number(draws))):
        publish.swap_table(df, f"{root}/curated/{name}")
    about = {
        "dataset_version": r["dataset_version"], "source": source, "built_at": _now(), "draws": r["draws"], "first_draw": ends["a"], "last_draw": ends["b"],
        "files": {"fact_draw": r["draws"], "fact_draw_number": r["draws"] * K + ends["s"], "dim_number": 55},
    }
    publish.write_text(f"{root}/curated/dataset_manifest.json", json.dumps(about, sort_keys=True, indent=1) + "\n")
    draws.unpersist()
    return {"status": "rebuilt", "dataset_version": r["dataset_version"]}


def reconcile(spark: SparkSession, root: str, left: str = "official", right: str = "mirror") -> dict:
    a, b = staging(spark, root, left), staging(spark, root, right)
    rows = rules.reconcile_fields(a, b)
    return {"mismatches": rows.count(), "only_left": rules.only_in(a, b).count(), "only_right": rules.only_in(b, a).count()}


def blocking(spark: SparkSession, root: str, as_of: str, left: str, right: str, issues: DataFrame | None = None) -> int:
    """Return how many draws that aren't published yet differ between two sources, without a known issue that accepts it."""
    a, b = staging(spark, root, left), staging(spark, root, right)
    x = quality.Inputs(a, a, as_of, left, right, mirror=b, issues=issues)
    open_ones = quality.findings(x, ("reconcile.sources",)).where("rule = 'reconcile.field_mismatch' and not accepted").select("draw_id")
    if manifest(root) is not None:
        open_ones = open_ones.join(spark.read.parquet(f"{root}/curated/fact_draw").select("draw_id"), "draw_id", "left_anti")
    return open_ones.count()


def verify_raw(spark: SparkSession, root: str) -> DataFrame:
    return archive.verify(spark, f"{root}/raw")


def issues_at(spark: SparkSession, path: str | None, as_of: str) -> DataFrame | None:
    return known_issues.table(spark, known_issues.load(path), as_of[:10]) if path and os.path.exists(path) else None


def received(spark: SparkSession, root: str) -> DataFrame:
    """Return source, run_id and the content of all records that the stored raw pages hold."""
    stored = archive.pages(spark, f"{root}/raw")
    out = None
    for source in archive.registry():
        if os.path.isdir(f"{root}/raw/{source}"):
            good = archive.parse(source, stored).where("error is null")
            cells = [F.get("main", F.lit(i)).cast("long").alias(c) for i, c in enumerate(MAIN)]
            rows = good.select("draw_id", "draw_date", *cells, F.col("special").cast("long").alias("special_number"), F.lit(source).alias("source"), F.split("file", "/")[1].alias("run_id"))
            out = rows if out is None else out.unionByName(rows)
    return out


def quality_report(spark: SparkSession, root: str, as_of: str, source: str = "official", mirror: str | None = "mirror", issues_path: str | None = None, frozen: Frozen = None, out: str | None = None) -> dict:
    """Build and store the report of ``as_of`` (UTC), as JSON and Markdown, and as latest; or in the folder ``out``."""
    if manifest(root) is None:
        raise FileNotFoundError("nothing is curated yet")
    # A run's id says when it fetched.
    fetched = F.to_timestamp(F.substring("raw_run_id", 1, 15), "yyyyMMdd'T'HHmmss")
    curated = spark.read.parquet(f"{root}/curated/fact_draw").withColumn("retrieved_at", fetched).select(*quality.FACT, "retrieved_at")
    other = staging(spark, root, mirror) if mirror and os.path.isdir(f"{root}/staging/{mirror}") else None
    issues = issues_at(spark, issues_path, as_of)
    raw = received(spark, root) if os.path.isdir(f"{root}/raw") else None
    x = quality.Inputs(
        curated, staging(spark, root, source), as_of, source, long=quality.long_of(curated), dim=dim_number(curated), manifest=manifest(root), mirror=other, parsed=raw, received=raw,
        runs=read(spark, f"{root}/logs/ingestion", RUNS), logged=read(spark, f"{root}/logs/quality", LOGGED), checksums=verify_raw(spark, root) if raw is not None else None,
        refreshes=read(spark, f"{root}/logs/refresh", REFRESHES), issues=issues, frozen=frozen_problem(curated, frozen),
    )
    r = quality.report(x)
    files = {"report.json": json.dumps(r, sort_keys=True, indent=1, default=str) + "\n", "report.md": quality.rendered(r)}
    name = as_of.replace(":", "").replace(" ", "T")
    about = publish.publish(out or f"{root}/reports/{name}", files, {"as_of": as_of})
    if not out:
        publish.publish(f"{root}/reports/latest", files, {"as_of": as_of})
    return r | {"sha256": about["files"]["report.json"]["sha256"]}


def refresh(spark: SparkSession, root: str, fetches: dict[str, Fetch], as_of: str, frozen: Frozen = None, issues_path: str | None = None, stale: float = 3600.0) -> dict:
    """Ingest all sources, reconcile, curate and report. A step that fails doesn't stop the others.

    Exit codes: 50 error, 30 a check fails, 10 a check warns, 0 all passes; 40 if another refresh is running.
    """
    age = datetime.now(UTC) - datetime.fromisoformat(as_of).replace(tzinfo=UTC)
    if age > timedelta(hours=1) and not os.environ.get("SUBSETLAB_REPLAY"):
        raise ValueError("a refresh can't be for an instant more than an hour ago")
    run_id, started = datetime.now(UTC).strftime("%Y%m%dT%H%M%S%fZ"), _now()
    try:
        with publish.Lock(f"{root}/refresh.lock", stale):
            before, steps, code, digest = (manifest(root) or {}).get("dataset_version"), {}, 0, None

            def step(name: str, work: Callable[[], dict]) -> dict:
                nonlocal code
                try:
                    steps[name] = "ok"
                    return work()
                except Exception as e:
                    logger.exception("step failed", extra={"step": name, "refresh": run_id})
                    steps[name], code = f"error: {str(e)[:200]}", 50
                    return {}

            for source, fetch in fetches.items():
                step(f"ingest {source}", lambda s=source, f=fetch: ingest(spark, root, s, f))
            differ = {}
            if len(fetches) > 1:
                pair = list(fetches)[:2]
                step("reconcile", lambda: reconcile(spark, root, *pair))
                differ = step("assess", lambda: {"n": blocking(spark, root, as_of, *pair, issues_at(spark, issues_path, as_of))})
            made = {"status": "blocked", "reason": f"{differ['n']} new draws differ"} if differ.get("n") else step("curate", lambda: curate(spark, root, next(iter(fetches)), frozen))
            if made.get("status") == "blocked":
                steps["curate"], code = f"blocked: {made['reason']}", max(code, 30)
            r = step("report", lambda: quality_report(spark, root, as_of, next(iter(fetches)), issues_path=issues_path, frozen=frozen))
            code, digest = max(code, r.get("exit_code", 0)), r.get("sha256")
            after = (manifest(root) or {}).get("dataset_version")
            append(spark, f"{root}/logs/refresh", REFRESHES, [(run_id, started, as_of, code, json.dumps(steps, sort_keys=True), before, after, digest)])
            alert = f"{root}/ALERT"
            if code >= 30:
                publish.write_text(alert, json.dumps({"run_id": run_id, "exit_code": code, "steps": steps}, sort_keys=True) + "\n")
            elif os.path.exists(alert):
                os.remove(alert)
            return {"run_id": run_id, "exit_code": code, "steps": steps, "version": after}
    except BlockingIOError:
        return {"exit_code": 40, "steps": {}}


def status(spark: SparkSession, root: str, now: str) -> dict:
    """Return the last refresh, its age in days, failures in a row, the next draw day and whether an alert stands; alarm after four days."""
    runs = [r.asDict() for r in read(spark, f"{root}/logs/refresh", REFRESHES).orderBy(F.desc("run_id")).limit(20).collect()]
    failures = next((i for i, r in enumerate(runs) if r["exit_code"] < 30), len(runs))
    instant = F.lit(now).cast("timestamp")
    today = F.to_date(F.from_utc_timestamp(instant, rules.ZONE))
    following = rules.scheduled(spark, today, F.date_add(today, 7)).where(rules.deadline(F.col("day")) > instant).agg(F.min("day").alias("d")).first()["d"]
    age = (datetime.fromisoformat(now).replace(tzinfo=UTC) - datetime.fromisoformat(runs[0]["started_at"])).total_seconds() / 86400 if runs else None
    alarm = age is None or age > 4 or failures > 0 or os.path.exists(f"{root}/ALERT")
    return {"last": runs[0] if runs else None, "age_days": age, "failures": failures, "next_draw": str(following), "exit_code": 10 if alarm else 0}


def loaded(spark: SparkSession, root: str, through: str | None = None, ceiling: str | None = None) -> DataFrame:
    """Return the analysis frame: curated draws up to ``through`` (compared as text), validated.

    Rows after the cutoff are never looked at. ``ceiling`` is the largest cutoff that is allowed. Raises for bad rows.
    """
    if ceiling is not None and (through is None or through > ceiling):
        raise PermissionError(f"data after {ceiling} are not open to this analysis")
    draws = spark.read.parquet(f"{root}/curated/fact_draw")
    if through is not None:
        draws = draws.where(F.col("draw_id") <= through)
    numbers = F.array(*MAIN)
    rising = [F.col(b) > F.col(a) for a, b in zip(MAIN[:-1], MAIN[1:], strict=True)]
    ascending = rising[0]
    for x in rising[1:]:
        ascending = ascending & x
    special = F.col("special_number")
    r = draws.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("draw_id").alias("ids"), F.count_distinct("dataset_version").alias("versions"),
        F.count_if(~F.coalesce(ascending, F.lit(False))).alias("not rising"), F.count_if(F.exists(numbers, lambda x: x.isNull() | (x < 1) | (x > 55))).alias("out of range"),
        F.count_if(F.coalesce((special < 1) | (special > 55) | F.array_contains(numbers, special), F.lit(False))).alias("bad special numbers"),
        (F.max(F.col("draw_id").cast("long")) - F.min(F.col("draw_id").cast("long")) + 1).alias("span"),
    ).first()
    if not r["n"]:
        raise ValueError("no draws")
    if r["ids"] != r["n"] or r["span"] != r["n"]:
        raise ValueError("ids are repeated or not contiguous")
    if r["versions"] != 1:
        raise ValueError("more than one version")
    for k in ("not rising", "out of range", "bad special numbers"):
        if r[k]:
            raise ValueError(f"{r[k]} draws are {k}" if k != "bad special numbers" else f"{r[k]} bad special numbers")
    return draws.select("t", *CONTENT)
