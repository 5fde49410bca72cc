"""Rules of the data set in an ingestion, sources that differ before publication, waivers with pins, checks without inputs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from subsetlab.plans import known_issues, quality, refresh
from tests.test_runs import lines, made_draws, official, once


@pytest.fixture
def replay(monkeypatch):
    monkeypatch.setitem(os.environ, "SUBSETLAB_REPLAY", "1")


def test_rules_of_the_data_set_refuse_new_rows(spark, tmp_path):
    root, draws = str(tmp_path), made_draws(12)
    assert refresh.ingest(spark, root, "mirror", once(lines(draws[:8])), "full")["inserted"] == 8
    late = dict(draws[8], date=draws[3]["date"])
    again = dict(draws[10], result=draws[1]["result"])
    r = refresh.ingest(spark, root, "mirror", once(lines([late, again])), "full")
    assert (r["status"], r["inserted"]) == ("partial", 1)
    got = refresh.staging(spark, root, "mirror").select("draw_id").collect()
    assert sorted(x["draw_id"] for x in got) == [d["id"] for d in draws[:8]] + [draws[10]["id"]]
    log = {(x["draw_id"], x["rule"], x["status"]) for x in refresh.read(spark, f"{root}/logs/quality", refresh.LOGGED).collect()}
    assert (draws[8]["id"], "chronological_order", "error") in log and (draws[10]["id"], "duplicate_content", "warning") in log


def test_new_draws_that_differ_are_not_published(spark, tmp_path, replay):
    root, draws = str(tmp_path / "root"), made_draws(10)
    as_of = f"{draws[-1]['date']} 14:30:00"
    other = sorted(set(range(1, 56)) - set(draws[9]["result"]))[:6] + draws[9]["result"][6:]
    changed = [*draws[:9], dict(draws[9], result=other)]
    r = refresh.refresh(spark, root, {"official": once(official(draws)), "mirror": once(lines(changed))}, as_of)
    assert r["exit_code"] == 50 and r["steps"]["curate"] == "blocked: 1 new draws differ" and refresh.manifest(root) is None
    fields = {f"n{i + 1}": f"{a}|{b}" for i, (a, b) in enumerate(zip(sorted(draws[9]["result"][:6]), other[:6], strict=True)) if a != b}
    issue = {"id": "KI-009", "source": "mirror", "rules": ["reconcile.field_mismatch"], "draw_id": draws[9]["id"], "pins": fields, "reason": "r", "evidence": "e", "approved_by": "a", "approved_on": "2020-01-01", "review_by": "2099-01-01"}
    path = str(tmp_path / "known.json")
    for pins, left in ((fields, 0), (fields | {"n1": "1|1"}, 1)):
        with open(path, "w") as f:
            json.dump({"schema_version": "1.0", "issues": [issue | {"pins": pins}]}, f)
        assert refresh.blocking(spark, root, as_of, "official", "mirror", known_issues.table(spark, known_issues.load(path), as_of[:10])) == left


def test_checks_without_inputs(spark):
    rows = [(1, "00001", "s", "v1", *range(1, 7), 8)]
    curated = spark.createDataFrame(rows, "t long, draw_id string, source string, dataset_version string, n1 long, n2 long, n3 long, n4 long, n5 long, n6 long, special_number long").withColumn("draw_date", F.lit("2024-01-02").cast("date"))
    found = quality.findings(quality.Inputs(curated, None, "2024-01-03 00:00:00")).select("check", "rule", "level").collect()
    got = {(r["check"], r["rule"], r["level"]) for r in found}
    assert {
        ("known_issues.file", "known_issues_absent", "INFO"), ("staging.schema", "input_missing", "FAIL"), ("staging.schema", "input_missing", "WARN"), ("ingestion.runs", "input_missing", "FAIL"),
        ("quality_log.open", "input_missing", "INFO"), ("reconcile.sources", "reconcile.not_run", "WARN"), ("refresh.history", "input_missing", "INFO"), ("curated.schema", "curated_schema", "FAIL"),
    } <= got
    assert {r["check"] for r in quality.statuses(quality.findings(quality.Inputs(curated, None, "2024-01-03 00:00:00"))).collect()} == set(quality.CHECKS)


def test_source_that_calls_back(spark, tmp_path):
    from subsetlab.sources import live

    draws = made_draws(9)
    asked = []

    class Fake:
        def get(self, url, data=None, headers=None):
            asked.append((url, json.loads(data) if data else None, (headers or {}).get("X-AjaxPro-Method")))
            if url.endswith("/page"):
                return b"<script>Result(Info, 'ab12')</script>"
            if url.endswith("/session"):
                return json.dumps({"value": {"id": 7}}).encode()
            at = 3 * asked[-1][1]["PageIndex"]
            return official(draws[::-1][at : at + 3]).encode()

    def rows(content):
        import re

        return [{"draw_id": x, "draw_date": ""} for x in re.findall(r'href=\\\\?"/x\\\\?">([0-9]+)<', content)]

    def source(pattern):
        return live.CallbackSource("http://h", "/page", "/session", "/result", pattern, "00ff", {"SiteId": "s"}, "Create", "Result", lambda session, key, i: {"Info": session, "Key": key, "PageIndex": i}, rows, Fake())

    got = list(source(r"Result\(Info, '([0-9a-f]+)'").fetch("00005"))
    assert [i for i, _ in got] == [0, 1] and asked[-1][1] == {"Info": {"id": 7}, "Key": "ab12", "PageIndex": 1} and asked[-1][2] == "Result"
    assert len(list(source("nothing").fetch(None))) == 3 and asked[-1][1]["Key"] == "00ff"
    root = str(tmp_path)
    assert refresh.ingest(spark, root, "official", lambda last: source("nothing").fetch(last))["inserted"] == 9
    assert refresh.ingest(spark, root, "official", lambda last: source("nothing").fetch(last))["inserted"] == 0


def test_rules_are_registered(spark):
    assert len(known_issues.CHECK_OF) == 51 and set(known_issues.RULES) | known_issues.NEVER == set(known_issues.CHECK_OF)
    assert known_issues.CHECK_OF["draw_weekday"] == "curated.ranges" and "frozen_prefix" in known_issues.NEVER
    rows = [("draw_cadence", "coverage.gaps"), ("input_missing", "staging.schema"), ("anything", "quality_log.open")]
    df = spark.createDataFrame(rows, "rule string, check string")
    assert [r[0] for r in df.select(quality.registered(F.col("rule"), F.col("check"))).collect()] == [r for r, _ in rows]
    for bad in (("draw_cadence", "curated.ranges"), ("unknown", "coverage.gaps"), (None, "coverage.gaps")):
        with pytest.raises(Exception, match="no rule of this check"):
            spark.createDataFrame([bad], "rule string, check string").select(quality.registered(F.col("rule"), F.col("check"))).collect()
