"""The quality report: checks as queries that give findings, and their statuses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subsetlab.model import CONTENT, K, MAIN, fact_draw_number
from subsetlab.operators import rules
from subsetlab.plans import known_issues

FINDING = "check string, source string, draw_id string, day date, rule string, level string, detail string, observed string"
#: The report's checks in their order: fixed values.
CHECKS = (
    "known_issues.file", "curated.schema", "curated.lineage", "curated.missing", "curated.duplicates", "curated.ranges", "coverage.gaps", "coverage.freshness",
    "staging.schema", "ingestion.runs", "quality_log.open", "reconcile.sources", "raw.checksums", "refresh.history",
)
#: Columns of tables and keys of the manifest: fixed values.
STAGED = [*CONTENT, "source", "raw_run_id"]
FACT, LONG, DIM = [*CONTENT, "source", "t", "dataset_version"], ["draw_id", "draw_date", "position", "number", "is_special"], ["number", "parity", "band", "decade_group"]
MANIFEST = ["dataset_version", "source", "built_at", "draws", "first_draw", "last_draw", "files"]
#: Missed dates up to here are warnings.
TOLERATED_MISSES = 6
#: Hours after midnight at which a draw takes place, and refreshes that the history shows.
DRAW_HOUR, SHOWN = rules.DRAW_HOUR, 10


@dataclass
class Inputs:
    """What a report looks at. ``curated`` has draws with t, dataset_version and more; others may be None.

    ``received`` has source, run_id and draw_id of what stored raw pages hold, ``parsed`` a source and its content too.
    """

    curated: DataFrame
    staging: DataFrame | None
    as_of: str
    source: str = "official"
    other: str = "mirror"
    long: DataFrame | None = None
    dim: DataFrame | None = None
    manifest: dict | None = None
    mirror: DataFrame | None = None
    parsed: DataFrame | None = None
    received: DataFrame | None = None
    runs: DataFrame | None = None
    logged: DataFrame | None = None
    checksums: DataFrame | None = None
    refreshes: DataFrame | None = None
    issues: DataFrame | None = None
    first: tuple[str, str] | None = None
    frozen: str | None = None

    @property
    def spark(self) -> SparkSession:
        return self.curated.sparkSession

    @property
    def now(self) -> Column:
        return F.lit(self.as_of).cast("timestamp")

    @property
    def today(self) -> Column:
        return F.to_date(F.from_utc_timestamp(self.now, rules.ZONE))


def _finding(df: DataFrame, check: str, rule: Column | str, level: Column | str, source: Column | str, detail: Column | str = "", draw_id: Column | None = None, day: Column | None = None, observed: Column | None = None) -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    empty = F.lit(None).cast("string")
    return df.select(
        F.lit(check).alias("check"), as_column(source).alias("source"), (draw_id if draw_id is not None else empty).cast("string").alias("draw_id"),
        (day if day is not None else empty).cast("date").alias("day"), as_column(rule).alias("rule"), as_column(level).alias("level"),
        F.coalesce(as_column(detail).cast("string"), F.lit("")).alias("detail"), (observed if observed is not None else empty).cast("string").alias("observed"),
    )


def _told(x: Inputs, check: str, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """Return findings that need no table: (source, rule, level, detail)."""
    return x.spark.createDataFrame([(check, s, None, None, r, lv, d, None) for s, r, lv, d in rows], FINDING)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def _graver(x: Inputs, grave: str = "FAIL", light: str = "WARN", source: Column | None = None) -> Column:
    """Return the level: ``grave`` for the leading source, ``light`` for the other."""
    return F.when((F.col("source") if source is None else source) == x.source, grave).otherwise(light)


def schema_of_staging(x: Inputs) -> DataFrame:
    rows = []
    for name, level, df in ((x.source, "FAIL", x.staging), (x.other, "WARN", x.mirror)):
        if df is None:
            rows.append((name, "input_missing", level, "no staging"))
        elif df.columns != STAGED:
            rows.append((name, "staging_schema", level, ",".join(df.columns)))
    return _told(x, "staging.schema", rows)


def schema_of_curated(x: Inputs) -> DataFrame:
    tables = (("fact_draw", x.curated, FACT), ("fact_draw_number", x.long, LONG), ("dim_number", x.dim, DIM))
    rows = [(x.source, "curated_schema", "FAIL", f"{name}: {','.join(df.columns)}") for name, df, wanted in tables if df is not None and [c for c in df.columns if c not in ("retrieved_at",)] != wanted]
    if x.manifest is not None and sorted(x.manifest) != sorted(MANIFEST):
        rows.append((x.source, "curated_schema", "FAIL", f"manifest: {','.join(sorted(x.manifest))}"))
    return _told(x, "curated.schema", rows)


def lineage(x: Inputs) -> DataFrame:
    """Curated rows and staged ones are the same, files hold what the manifest says, and staged rows come from raw pages."""
    c, s, check, ident = x.curated, x.source, "curated.lineage", F.col("draw_id")
    sizes = c.agg(F.count_distinct("dataset_version").alias("n"), F.count(F.lit(1)).alias("rows"), F.count("special_number").alias("special"))
    out = [_finding(sizes.where("n > 1"), check, "manifest_consistency", "FAIL", s, "more than one dataset_version")]
    if x.staging is not None:
        out.append(_finding(rules.lineage_missing(x.staging, c), check, "curated_matches_staging", "FAIL", s, "not curated", ident))
        out.append(_finding(rules.lineage_missing(c, x.staging), check, "curated_matches_staging", "FAIL", s, "not staged", ident))
    if x.long is not None:
        both = sizes.crossJoin(x.long.agg(F.count(F.lit(1)).alias("long")))
        out.append(_finding(both.where(F.col("long") != F.col("rows") * K + F.col("special")), check, "manifest_consistency", "FAIL", s, F.concat(F.lit("fact_draw_number has "), F.col("long").cast("string"))))
    if x.manifest is not None:
        files = x.manifest.get("files", {})
        for name, df in (("fact_draw", c), ("fact_draw_number", x.long), ("dim_number", x.dim)):
            if df is not None:
                wrong = df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != F.lit(files.get(name, -1)))
                out.append(_finding(wrong, check, "manifest_consistency", "FAIL", s, F.concat(F.lit(f"{name} has "), F.col("n").cast("string"))))
        other = c.where(~F.col("source").eqNullSafe(F.lit(x.manifest.get("source")))) if "source" in c.columns else None
        if other is not None:
            out.append(_finding(other.limit(1), check, "manifest_consistency", "FAIL", s, "source differs from the manifest"))
    if x.frozen:
        out.append(_told(x, check, [(s, "frozen_prefix", "FAIL", x.frozen)]))
    if x.parsed is not None:
        for name, df, level in ((s, x.staging, "FAIL"), (x.other, x.mirror, "WARN")):
            if df is not None:
                own = x.parsed.where(F.col("source") == name) if "source" in x.parsed.columns else x.parsed
                out.append(_finding(rules.lineage_missing(df, own), check, "raw_lineage", level, name, draw_id=ident))
    return _all(out)


def missing(x: Inputs) -> DataFrame:
    needed = F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in CONTENT[:-1]])
    holes = x.curated.select(F.explode(F.array_compact(needed)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return _all([
        _finding(holes, "curated.missing", "null_required", "FAIL", x.source, F.concat_ws(" ", "k", F.col("n").cast("string"))),
        _finding(x.curated.where("special_number is null"), "curated.missing", "special_present", "WARN", x.source, draw_id=F.col("draw_id"), day=F.col("draw_date")),
    ])


def duplicates(x: Inputs) -> DataFrame:
    check, s, c = "curated.duplicates", x.source, x.curated
    count = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Rows alike in id and numbers are one; rows that share an id only are other draws, whose numbers count too.
    contents = c.select("draw_id", *MAIN, "special_number").distinct()
    out = [
        _finding(count(c, "draw_id"), check, "draw_id_unique", "FAIL", s, F.col("n"), F.col("draw_id")),
        _finding(count(c, "draw_date"), check, "draw_date_unique", "FAIL", s, F.col("n"), day=F.col("draw_date")),
        _finding(rules.duplicate_content(contents), check, "duplicate_content", "WARN", s, F.col("first_id"), F.col("draw_id")),
    ]
    if x.long is not None:
        twice = count(x.long, "draw_id", "position")
        out.append(_finding(twice, check, "position_unique", "FAIL", s, F.concat_ws(" ", F.col("position").cast("string"), F.col("n").cast("string")), F.col("draw_id")))
    return _all(out)


def ranges(x: Inputs) -> DataFrame:
    check, s, c, ident = "curated.ranges", x.source, x.curated, F.col("draw_id")
    records = c.select("draw_id", "draw_date", F.array(*MAIN).alias("main"), F.col("special_number").alias("special"))
    level = F.when(F.col("severity") == "error", "FAIL").otherwise("WARN")
    # A curated id has five digits at least (``model.padded_id``); only a source's own record is held to exactly five.
    own = rules.record_findings(records, x.today).where((F.col("rule") != "draw_id_format") | ~F.coalesce(ident.rlike("^[1-9][0-9]{5,}$"), F.lit(False)))
    out = [
        _finding(own, check, F.col("rule"), level, s, F.col("detail"), ident),
        _finding(rules.chronology(c), check, "chronological_order", "FAIL", s, F.col("prev_draw_id"), ident),
        _finding(rules.continuity(c), check, "draw_id_continuity", "WARN", s, F.col("prev_no"), ident),
    ]
    if "retrieved_at" in c.columns:
        drawn = F.to_utc_timestamp(F.to_timestamp("draw_date") + F.expr(f"interval {DRAW_HOUR} hours"), rules.ZONE)
        out.append(_finding(c.where(F.col("retrieved_at") < drawn), check, "retrieved_after_draw", "FAIL", s, draw_id=ident, day=F.col("draw_date")))
    return _all(out)


def gaps(x: Inputs) -> DataFrame:
    after = rules.cadence_gaps(x.curated).select("draw_id").distinct().join(x.curated.select("draw_id", "draw_date"), "draw_id")
    out = [_finding(after, "coverage.gaps", "draw_cadence", "INFO", x.source, day=F.col("draw_date"))]
    if x.first:
        start = x.curated.agg(F.min_by(F.struct("draw_id", "draw_date"), "t").alias("r")).select("r.*")
        other = start.where((F.col("draw_id") != x.first[0]) | (F.col("draw_date") != F.lit(x.first[1]).cast("date")))
        out.append(_finding(other, "coverage.gaps", "first_draw", "FAIL", x.source, draw_id=F.col("draw_id"), day=F.col("draw_date")))
    return _all(out)


def freshness(x: Inputs) -> DataFrame:
    """Dates that were missed are warnings here; ``findings`` raises them if too many aren't accepted."""
    missed = rules.missed_dates(x.curated, x.now)
    last = x.curated.agg(F.max("draw_date").alias("last"))
    ahead = last.select(F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", 14))).alias("day")).where(F.weekday("day").isin(*rules.WEEKDAYS))
    following = ahead.join(missed, "day", "left_anti").agg(F.min("day").alias("day")).where(rules.deadline(F.col("day")) > x.now)
    return _all([
        _finding(missed, "coverage.freshness", "freshness", "WARN", x.source, day=F.col("day")),
        _finding(following, "coverage.freshness", "freshness_pending", "INFO", x.source, day=F.col("day")),
    ])


def ingestion(x: Inputs) -> DataFrame:
    check = "ingestion.runs"
    if x.runs is None:
        return _told(x, check, [("system", "input_missing", "FAIL", "no log of runs")])
    last = rules.latest_runs(x.runs)
    out = [
        _finding(last.where("status = 'failed'"), check, "run_failed", _graver(x), F.col("source"), F.col("run_id")),
        _finding(last.where("status = 'partial'"), check, "run_partial", _graver(x, "WARN", "INFO"), F.col("source"), F.col("run_id")),
    ]
    if "rows_received" in x.runs.columns:
        stored = x.runs.where("rows_inserted > 0").join(last.select("source", F.col("run_id").alias("last")), "source").where("run_id <> last").select("source").distinct()
        empty = last.where("mode = 'incremental' and rows_received = 0").join(stored, "source", "left_semi")
        out.append(_finding(empty, check, "incremental_empty_fetch", _graver(x), F.col("source"), F.col("run_id")))
    if x.received is not None and x.mirror is not None:
        own = x.received.where(F.col("source") == x.other)
        top = own.agg(F.max("run_id").alias("last"))
        now = own.join(F.broadcast(top), F.col("run_id") == F.col("last")).select("draw_id").distinct()
        lost = x.mirror.select("draw_id").join(now, "draw_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).crossJoin(now.agg(F.count(F.lit(1)).alias("received")))
        out.append(_finding(lost.where("n > 0 and received > 0"), check, "mirror_shrink", "WARN", x.other, F.col("n")))
    return _all(out)


def quality_log(x: Inputs) -> DataFrame:
    """Errors that were logged: resolved ones are information. A conflict with a stored row is, once a later run of its source had the id without one."""
    check = "quality_log.open"
    if x.runs is None:
        source = F.lit(None).cast("string")
        known = x.spark.createDataFrame([], "run_id string, source string")
    else:
        known = x.runs.select("run_id", "source").distinct()
    if x.logged is None:
        partial = known.limit(0) if x.runs is None else x.runs.where("status = 'partial'").agg(F.max_by("source", "run_id").alias("source"))
        source = F.col("source")
        absent = partial.agg(F.max("source").alias("source"))
        rule = F.when(source.isNull(), "input_missing").otherwise("log_integrity")
        level = F.when(source.isNull(), "INFO").otherwise(_graver(x))
        return _finding(absent, check, rule, level, "system", "no quality log")
    errors = x.logged.where("status = 'error'").join(known, "run_id", "left")
    out = [_finding(errors.where("source is null"), check, "log_integrity", "WARN", "system", draw_id=F.col("run_id"))]
    staged = [df.select(F.lit(name).alias("source"), "draw_id") for name, df in ((x.source, x.staging), (x.other, x.mirror)) if df is not None]
    there = _all(staged).distinct().withColumn("there", F.lit(True)) if staged else x.spark.createDataFrame([], "source string, draw_id string, there boolean")
    own = errors.where("source is not null")
    plain = own.where("rule <> 'stored_row_conflict'").join(there, ["source", "draw_id"], "left").withColumn("resolved", F.col("there").isNotNull()).drop("there")
    conflicts = own.where("rule = 'stored_row_conflict'")
    if x.received is None:
        done = conflicts.withColumn("resolved", F.lit(False))
    else:
        # The last conflict of an id, and the last run that had it: a run after it had none.
        last = conflicts.groupBy("source", "draw_id").agg(F.max("run_id").alias("_conflict"))
        seen = x.received.groupBy("source", "draw_id").agg(F.max("run_id").alias("_seen"))
        done = conflicts.join(last, ["source", "draw_id"]).join(seen, ["source", "draw_id"], "left")
        resolved = (F.col("run_id") == F.col("_conflict")) & F.coalesce(F.col("_seen") > F.col("run_id"), F.lit(False))
        done = done.withColumn("resolved", resolved).drop("_conflict", "_seen")
    level = F.when(F.col("resolved"), "INFO").otherwise(_graver(x))
    state = F.concat(F.when(F.col("resolved"), "resolved ").otherwise("open "), F.coalesce("detail", F.lit("")))
    out.append(_finding(plain.unionByName(done), check, F.col("rule"), level, F.col("source"), state, F.col("draw_id")))
    return _all(out)


def sources(x: Inputs) -> DataFrame:
    check = "reconcile.sources"
    if x.mirror is None:
        return _told(x, check, [(x.other, "reconcile.not_run", "WARN", "no mirror")])
    left = x.staging if x.staging is not None else x.curated
    seen = rules.assess_reconcile(left, x.mirror, x.curated)
    fields = rules.reconcile_fields(left, x.mirror).groupBy("draw_id").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.concat_ws("|", "left_value", "right_value").alias("v")))))).alias("observed"),
    )
    seen = seen.join(fields, "draw_id", "left")
    mismatch = F.col("rule") == "mismatch"
    rule = F.concat(F.lit("reconcile."), F.when(mismatch, "field_mismatch").otherwise(F.col("rule")))
    whose = F.when(F.col("rule") == "only_right", x.source).otherwise(x.other)
    return _finding(seen, check, rule, F.col("level"), whose, draw_id=F.col("draw_id"), observed=F.when(mismatch, F.col("observed")))


def checksums(x: Inputs) -> DataFrame:
    if x.checksums is None:
        return _told(x, "raw.checksums", [])
    gone = F.col("problem") == "missing"
    return _finding(x.checksums, "raw.checksums", F.when(gone, "raw_manifest_missing").otherwise("raw_checksum"), F.when(gone, "WARN").otherwise("FAIL"), F.split("path", "/")[0], F.col("path"))


def history(x: Inputs) -> DataFrame:
    if x.refreshes is None:
        return _told(x, "refresh.history", [("system", "input_missing", "INFO", "no log of refreshes")])
    tail = x.refreshes.orderBy(F.desc("run_id")).limit(SHOWN)
    return _finding(tail, "refresh.history", "refresh_history", "INFO", "system", F.concat_ws(" ", "run_id", F.col("exit_code").cast("string")))


#: Checks that look at tables, by name.
FINDERS: dict[str, Callable[[Inputs], DataFrame]] = {
    "curated.schema": schema_of_curated, "curated.lineage": lineage, "curated.missing": missing, "curated.duplicates": duplicates, "curated.ranges": ranges, "coverage.gaps": gaps,
    "coverage.freshness": freshness, "staging.schema": schema_of_staging, "ingestion.runs": ingestion, "quality_log.open": quality_log, "reconcile.sources": sources,
    "raw.checksums": checksums, "refresh.history": history,
}


def about_issues(x: Inputs, found: DataFrame) -> DataFrame:
    """Return what is to be said of known issues: proposed and expired ones, and those that no finding matches."""
    check = "known_issues.file"
    if x.issues is None:
        return _told(x, check, [("system", "known_issues_absent", "INFO", "no known issues")])
    used = found.where("issue_id is not null").groupBy("issue_id", "rule").agg(F.count(F.lit(1)).alias("n"))
    every = x.issues.join(used, ["issue_id", "rule"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    issues = every.groupBy("issue_id", "state", "date_to").agg(F.sum("n").alias("n"))
    level = F.when(F.coalesce(F.col("date_to").cast("date") < x.today, F.lit(False)), "INFO").otherwise("WARN")
    state = F.col("state")
    return _all([
        _finding(issues.where(state.isin("proposed", "expired")), check, F.concat(F.lit("known_issue_"), state), level, "system", F.col("issue_id")),
        _finding(issues.where("n = 0"), check, "known_issue_unused", level, "system", F.col("issue_id")),
        _finding(every.where("n = 0"), check, "known_issue_rule_unused", "INFO", "system", F.concat_ws(" ", "issue_id", "rule")),
    ])


def registered(rule: Column, check: Column) -> Column:
    """Return ``rule``, or raise if the registry doesn't have it for ``check``.

    Logged findings keep the rule they were logged with; the range check runs all rules of records, a missing special number too.
    """
    known = F.element_at(F.create_map(*[F.lit(v) for pair in known_issues.CHECK_OF.items() for v in pair]), rule)
    fits = (known == check) | (rule == "input_missing") | (check == "quality_log.open") | ((check == "curated.ranges") & (rule == "special_present"))
    return F.when(F.coalesce(fits, F.lit(False)), rule).otherwise(F.raise_error(F.concat(F.lit("no rule of this check: "), F.coalesce(rule, F.lit("null")))))


def findings(x: Inputs, checks: tuple[str, ...] = CHECKS) -> DataFrame:
    """Return the findings of ``checks``, with issue_id, issue_state and accepted."""
    every = _all([FINDERS[c](x) for c in checks if c in FINDERS] or [_told(x, checks[0], [])])
    every = every.withColumn("rule", registered(F.col("rule"), F.col("check")))
    empty = F.lit(None).cast("string")
    if x.issues is not None:
        every = known_issues.apply(every, x.issues)
    else:
        every = every.withColumns({"issue_id": empty, "issue_state": empty, "accepted": F.lit(False)})
    if "coverage.freshness" in checks:
        late = (F.col("rule") == "freshness") & ~F.col("accepted")
        many = F.broadcast(every.where(late).agg((F.count(F.lit(1)) > TOLERATED_MISSES).alias("_many")))
        every = every.crossJoin(many).withColumn("level", F.when(late & F.col("_many"), "FAIL").otherwise(F.col("level"))).drop("_many")
    if "known_issues.file" in checks:
        told = about_issues(x, every).withColumns({"issue_id": empty, "issue_state": empty, "accepted": F.lit(False)})
        every = every.unionByName(told)
    return every


def statuses(found: DataFrame) -> DataFrame:
    """Return check, place, status (the worst level that isn't accepted), and counts, for all checks in their order."""
    names = found.sparkSession.createDataFrame([(c, i) for i, c in enumerate(CHECKS)], "check string, place int")
    rank = F.when(F.col("accepted"), 0).when(F.col("level") == "FAIL", 2).when(F.col("level") == "WARN", 1).otherwise(0)
    own = found.groupBy("check").agg(
        F.max(rank).alias("rank"), F.count(F.lit(1)).alias("findings"), F.count_if("accepted").alias("accepted"), F.count_if(rank > 0).alias("open"),
        F.count_if(F.col("issue_state").isin("proposed", "expired")).alias("proposed"),
    )
    status = F.when(F.col("rank") == 2, "FAIL").when(F.col("rank") == 1, "WARN").otherwise("PASS")
    zero = F.lit(0).cast("long")
    return F.broadcast(names).join(own, "check", "left").select("check", "place", status.alias("status"), *[F.coalesce(c, zero).alias(c) for c in ("findings", "accepted", "open", "proposed")])


#: Counts of the summary, and the checks whose open findings they add up.
SUMMARY = {"missing": ("curated.missing",), "duplicate": ("curated.duplicates",), "invalid_ranges": ("curated.ranges",), "schema_errors": ("curated.schema", "staging.schema")}


def exit_code(status: list[str]) -> int:
    return 30 if "FAIL" in status else 10 if "WARN" in status else 0


def report(x: Inputs, shown: int = 20) -> dict:
    """Return the report: checks, the first findings of each in a fixed order, and the version."""
    found = findings(x).persist()
    checks = [r.asDict() for r in statuses(found).orderBy("place").collect()]
    order = ["check", "rule", "draw_id", "day", "detail"]
    first = found.withColumn("_rn", F.row_number().over(Window.partitionBy("check").orderBy(*order[1:]))).where(F.col("_rn") <= shown).drop("_rn")
    rows = [{k: (str(v) if k == "day" and v else v) for k, v in r.asDict().items()} for r in first.orderBy(*order).collect()]
    version = x.curated.agg(F.max("dataset_version").alias("v"), F.count(F.lit(1)).alias("n"), F.min("draw_id").alias("a"), F.max("draw_id").alias("b")).first()
    failures = x.runs.where("status = 'failed'").count() if x.runs is not None else 0
    found.unpersist()
    status = [c["status"] for c in checks]
    return {
        "as_of": x.as_of, "dataset": {"version": version["v"], "draws": version["n"], "first": version["a"], "last": version["b"]},
        "checks": [{k: c[k] for k in ("check", "status", "findings", "accepted")} for c in checks], "findings": rows, "exit_code": exit_code(status),
        "summary": {k: sum(c["open"] for c in checks if c["check"] in names) for k, names in SUMMARY.items()}
        | {"accepted": sum(c["accepted"] for c in checks), "proposed": sum(c["proposed"] for c in checks), "ingestion_failures": failures},
    }


def rendered(r: dict) -> str:
    """Write a report as Markdown."""
    d = r["dataset"]
    lines = ["# Data quality", "", f"As of {r['as_of']}: {d['draws']} draws, {d['first']} to {d['last']}, version {d['version']}.", "", "| check | status | findings | accepted |", "|-|-|-|-|"]
    lines += [f"| {c['check']} | {c['status']} | {c['findings']} | {c['accepted']} |" for c in r["checks"]]
    lines += ["", *[f"- {f['check']} {f['rule']} {f['level']} {f['draw_id'] or f['day'] or ''} {f['detail'] or ''}".rstrip() for f in r["findings"]]]
    return "\n".join(lines) + "\n"


def long_of(curated: DataFrame) -> DataFrame:
    return fact_draw_number(curated)
