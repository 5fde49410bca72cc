"""Known issues: approved waivers that let a finding pass, from a strict document."""

from __future__ import annotations

import json
import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sources whose findings can be waived, by rule; what isn't listed never can. Fixed values.
BOTH, OFFICIAL, MIRROR = ("official", "mirror"), ("official",), ("mirror",)
RULES = {
    "special_present": BOTH, "duplicate_content": BOTH, "draw_weekday": BOTH, "main_sorted": BOTH, "draw_id_continuity": BOTH,
    "draw_id_unique": MIRROR, "draw_date_unique": MIRROR, "draw_id_format": MIRROR, "draw_date_parseable": MIRROR, "not_future_dated": MIRROR, "main_count": MIRROR,
    "main_integer": MIRROR, "main_range": MIRROR, "main_unique": MIRROR, "special_range": MIRROR, "special_not_in_main": MIRROR, "chronological_order": MIRROR,
    "stored_row_conflict": MIRROR, "reconcile.field_mismatch": MIRROR, "reconcile.only_left": MIRROR, "reconcile.only_right": OFFICIAL, "freshness": OFFICIAL,
}
#: Rules by the check that tells of them; input_missing can come from any. Fixed values.
CHECK_RULES = {
    "known_issues.file": ["known_issues_file", "known_issue_proposed", "known_issue_expired", "known_issue_unused", "known_issue_rule_unused", "known_issues_absent"],
    "input_missing": ["input_missing"],
    "curated.schema": ["curated_schema"],
    "curated.lineage": ["curated_matches_staging", "manifest_consistency", "frozen_prefix", "raw_lineage"],
    "curated.missing": ["null_required", "special_present"],
    "curated.duplicates": ["draw_id_unique", "draw_date_unique", "position_unique", "duplicate_content"],
    "curated.ranges": [
        "draw_id_format", "draw_date_parseable", "not_future_dated", "main_count", "main_integer", "main_range", "main_unique", "special_range", "special_not_in_main",
        "chronological_order", "draw_weekday", "main_sorted", "draw_id_continuity", "retrieved_after_draw",
    ],
    "coverage.gaps": ["first_draw", "draw_cadence"],
    "coverage.freshness": ["freshness", "freshness_pending"],
    "staging.schema": ["staging_schema"],
    "ingestion.runs": ["run_failed", "run_partial", "incremental_empty_fetch", "mirror_shrink", "log_integrity"],
    "quality_log.open": ["stored_row_conflict"],
    "reconcile.sources": ["reconcile.field_mismatch", "reconcile.only_left", "reconcile.only_right", "reconcile.mirror_lag", "reconcile.not_run"],
    "raw.checksums": ["raw_checksum", "raw_manifest_missing"],
    "refresh.history": ["refresh_history"],
}
CHECK_OF = {rule: check for check, rules in CHECK_RULES.items() for rule in rules}
#: Rules whose findings no waiver can accept.
NEVER = set(CHECK_OF) - set(RULES)
#: Rules that name dates instead of ids, and rules whose waiver pins what was observed.
DATED, PINNED = {"freshness"}, {"reconcile.field_mismatch"}
KEYS = {"id", "source", "rules", "draw_id", "date_from", "date_to", "pins", "reason", "evidence", "approved_by", "approved_on", "review_by"}
LONGEST_DAYS = 60
#: How issues, draws, and the decisions that allow something are named. Fixed values.
ISSUE, DRAW, REFERENCE = re.compile(r"KI-[0-9]{3}"), re.compile(r"[0-9]{5}"), re.compile(r"[A-Z]+-[0-9]+")


def load(path: str) -> list[dict]:
    """Read and check the document; anything unexpected is an error."""
    with open(path, encoding="utf-8") as f:
        document = json.load(f)
    if document.get("schema_version") != "1.0" or set(document) != {"schema_version", "issues"}:
        raise ValueError("the document needs schema_version 1.0 and issues, and nothing else")
    seen = set()
    for x in document["issues"]:
        name = x.get("id")
        if not isinstance(name, str) or not ISSUE.fullmatch(name) or name in seen:
            raise ValueError(f"bad or repeated id {name!r}")
        seen.add(name)
        if "draw_id" in x and not (isinstance(x["draw_id"], str) and DRAW.fullmatch(x["draw_id"])):
            raise ValueError(f"{name}: a draw_id has five digits")
        if extra := set(x) - KEYS:
            raise ValueError(f"{name}: unknown keys {sorted(extra)}")
        if not x.get("rules") or any(r not in RULES for r in x["rules"]):
            raise ValueError(f"{name}: rules must be among {sorted(RULES)}")
        dated = "date_from" in x or "date_to" in x
        if dated == ("draw_id" in x):
            raise ValueError(f"{name}: either a draw_id or a range of dates")
        if dated:
            if not all(r in DATED for r in x["rules"]):
                raise ValueError(f"{name}: these rules name draws, not dates")
            if not 0 <= (date.fromisoformat(x["date_to"]) - date.fromisoformat(x["date_from"])).days <= LONGEST_DAYS:
                raise ValueError(f"{name}: the range is too long or reversed")
        elif any(r in DATED for r in x["rules"]):
            raise ValueError(f"{name}: these rules name dates, not draws")
        if any(x.get("source") not in RULES[r] for r in x["rules"]):
            raise ValueError(f"{name}: findings of this source can't be waived for these rules")
        if any(r in PINNED for r in x["rules"]) and not x.get("pins"):
            raise ValueError(f"{name}: a mismatch needs pins")
        if not all(isinstance(v, str) for v in x.get("pins", {}).values()):
            raise ValueError(f"{name}: pins must be text")
    return document["issues"]


def table(spark: SparkSession, issues: list[dict], as_of: str) -> DataFrame:
    """Return a row an issue and rule, with its state at ``as_of``: proposed, expired or active."""
    rows = []
    for place, x in enumerate(issues):
        state = "proposed" if not x.get("approved_by") else "expired" if x.get("review_by", "9999") < as_of else "active"
        # As Spark writes a map in JSON: pins are compared as text.
        pins = json.dumps(x["pins"], sort_keys=True, separators=(",", ":"), ensure_ascii=False) if x.get("pins") else None
        rows += [(place, x["id"], x["source"], r, x.get("draw_id"), x.get("date_from"), x.get("date_to"), pins, state) for r in x["rules"]]
    schema = "place int, issue_id string, source string, rule string, draw_id string, date_from string, date_to string, pins string, state string"
    return spark.createDataFrame(rows, schema)


def apply(findings: DataFrame, issues: DataFrame) -> DataFrame:
    """Add issue_id, issue_state and accepted to findings (source, rule, draw_id, day, observed).

    The first issue that fits counts: the same source and rule, and the id or a range of dates. Only an active one whose
    pins, if any, equal what was observed accepts. Issues are few, so they go to every task.
    """
    numbered = findings.withColumn("_row", F.monotonically_increasing_id())
    i = F.broadcast(issues.toDF(*[f"i_{c}" for c in issues.columns]))
    day = F.col("day").cast("string")
    fits = (F.col("source") == F.col("i_source")) & (F.col("rule") == F.col("i_rule")) & ((F.col("draw_id") == F.col("i_draw_id")) | day.between(F.col("i_date_from"), F.col("i_date_to")))
    first = F.row_number().over(Window.partitionBy("_row").orderBy("i_place"))
    joined = numbered.join(i, fits, "left").withColumn("_first", first).where("_first = 1")
    pinned = F.col("i_pins").isNull() | F.coalesce(F.col("i_pins") == F.col("observed"), F.lit(False))
    accepted = F.coalesce((F.col("i_state") == "active") & pinned, F.lit(False))
    return joined.select(*findings.columns, F.col("i_issue_id").alias("issue_id"), F.col("i_state").alias("issue_state"), accepted.alias("accepted"))
