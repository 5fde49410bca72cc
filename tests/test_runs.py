"""Simulation, ingestion, curation, reports and the stream, on small made-up sources."""

import json
import os
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsetlab import cli
from subsetlab.model import CONTENT, content_version
from subsetlab.operators import baselines, describe, infer, rules
from subsetlab.plans import known_issues, montecarlo, publish, quality, refresh
from subsetlab.sources import archive, http, pages
from subsetlab.streaming import ingest as stream


def made_draws(n, seed=1, special=True):
    rng = random.Random(seed)
    day, out = date(2017, 8, 1), []
    while len(out) < n:
        if day.weekday() in rules.WEEKDAYS:
            own = rng.sample(range(1, 56), 7)
            out.append({"date": day.isoformat(), "id": f"{len(out) + 1:05d}", "result": sorted(own[:6]) + (own[6:] if special else [])})
        day += timedelta(days=1)
    return out


def lines(draws):
    return "\n".join(json.dumps(d) for d in draws) + "\n\n"


def official(draws):
    rows = "".join(
        f'<tr><td>{date.fromisoformat(d["date"]):%d/%m/%Y}</td><td><a href="/x">{d["id"]}</a></td><td><div>{"".join(f"<span class=\"ball\">{x:02d}</span>" for x in d["result"][:6])}'
        f'<i></i><span class="separator">|</span><span class="ball">{d["result"][6]:02d}</span></div></td></tr>'
        for d in draws
    )
    return json.dumps({"value": {"Error": False, "HtmlContent": f"<table><tr><th>head</th></tr>{rows}</table>"}})


def once(content):
    return lambda last: [(0, content)]


@pytest.fixture
def frame(spark):
    rows = [(i + 1, d["id"], date.fromisoformat(d["date"]), *d["result"]) for i, d in enumerate(made_draws(260))]
    return spark.createDataFrame(rows, "t long, draw_id string, draw_date date, n1 long, n2 long, n3 long, n4 long, n5 long, n6 long, special_number long")


def test_published_replicate_means(spark):
    r = montecarlo.fresh(spark, 1190, 1190, 1000).agg(*[F.avg(c).alias(c) for c in ("C1", "C2", "C5")]).first()
    main, special = montecarlo.simulate(montecarlo.generator(montecarlo.SEED, montecarlo.FRESH), 3, 1190)
    again, _ = montecarlo.simulate(montecarlo.generator(montecarlo.SEED, montecarlo.FRESH, 2 * 1190 * 55), 1, 1190)
    assert (main[2] == again[0]).all() and special.min() >= 1
    assert abs(r["C1"] - 48.949) < 1 and abs(r["C2"] - 53.991) < 1.2 and abs(r["C5"] - 10.013) < 0.5


def test_statistics_are_the_same_as_queries(frame):
    main, special, years = montecarlo.series(frame)
    own = montecarlo.fresh_statistics(main, special) | montecarlo.order_statistics(montecarlo.indicator(main), years)
    one = lambda df: df.first()["statistic"]
    assert own["C1"] == pytest.approx(one(infer.chi2_main(frame))) and own["C2"] == pytest.approx(one(infer.chi2_special(frame)))
    assert own["C3"] == pytest.approx(infer.lag_overlap(frame).agg(F.sum(F.col("z") * F.col("z")).alias("statistic")).first()["statistic"])
    assert own["C5"] == pytest.approx(infer.autocorrelation(frame).agg(F.sum("q_part").alias("statistic")).first()["statistic"])
    assert own["C6"] == pytest.approx(one(infer.runs(frame))) and own["C7"] == pytest.approx(one(infer.year_chi2(frame)))
    assert own["C8"] == pytest.approx(infer.window_chi2(frame).agg(F.max("x2").alias("statistic")).first()["statistic"])
    assert own["C9"] == pytest.approx(one(infer.ks_distance(frame, "sum"))) and own["C10"] == pytest.approx(one(infer.ks_distance(frame, "range")))
    for test, metric in (("C11", "odd"), ("C12", "low"), ("C13", "consecutive")):
        assert own[test] == pytest.approx(infer.cells_chi2(frame, metric).agg(F.sum("part").alias("statistic")).first()["statistic"])


def test_family(frame):
    rows = {r["test"]: r for r in montecarlo.family(frame, 60).collect()}
    assert set(rows) == {f"C{i}" for i in range(1, 14)} - {"C8"}
    assert all(0 < r["p"] <= r["p_holm"] <= 1 for r in rows.values())
    assert rows["C4"]["replicate_mean"] == pytest.approx(10)
    for test in ("C1", "C3", "C7", "C11"):
        assert all(0 < r["p"] <= 1 for r in montecarlo.follow_up(frame, test, 30).collect())


def test_permutations_do_not_depend_on_parts(spark, frame):
    main, _, years = montecarlo.series(frame)
    got = montecarlo.permuted(spark, main, years, 9).orderBy("replicate").collect()
    rng = montecarlo.generator(montecarlo.SEED, montecarlo.PERMUTED)
    y = montecarlo.indicator(main)
    assert [r["C7"] for r in got] == [montecarlo.order_statistics(y[rng.permutation(len(y))], years)["C7"] for _ in range(9)]


def test_reference_bounds(spark):
    rows = {r["name"]: r for r in montecarlo.mc_reference(spark, 300, 300, (50,), 40).collect()}
    assert rows["min_count"]["lo"] < 300 * 6 / 55 < rows["max_count"]["hi"] and rows["min_z_w50"]["least"] < 0 < rows["max_z_w50"]["most"]


def test_bootstrap(spark, frame):
    scored = baselines.scores(frame, (50,)).where("t > 100")
    per = baselines.draw_scores(scored)
    for r in montecarlo.bootstrap(per, "log_loss", resamples=200).collect():
        assert r["lo"] - 1e-9 <= r["mean"] <= r["hi"] + 1e-9
    assert {r["config"] for r in montecarlo.bootstrap_ece(scored, resamples=20).collect()} == {"B0", "B1", "B2_w50"}
    few = spark.createDataFrame([("a", t, float(t)) for t in range(1, 8)], "config string, t long, x double")
    r = montecarlo.bootstrap(few, "x", resamples=50).first()
    assert 1 <= r["lo"] <= r["hi"] <= 7


def test_hand_examples(spark):
    cols = "t long, draw_id string, draw_date date, n1 long, n2 long, n3 long, n4 long, n5 long, n6 long, special_number long"
    rows = [(1, "00001", date(2020, 1, 2), 1, 2, 3, 53, 54, 55, None), (2, "00002", date(2020, 1, 4), 5, 10, 14, 23, 24, 38, 7)]
    df = spark.createDataFrame(rows, cols)
    a, b = describe.draw_metrics(df).orderBy("t").collect()
    assert (a["sum"], a["range"], a["odd"], a["low"], a["consecutive"], a["max_gap"]) == (168, 54, 4, 3, 4, 50)
    assert (b["sum"], b["range"], b["odd"], b["low"], b["consecutive"], b["gap_5"]) == (114, 33, 2, 5, 1, 14)
    p = {r["num"]: r["p"] for r in baselines.scores(df, (2,)).where("config = 'B1' and t = 2").collect()}
    assert p[1] == pytest.approx(12 / 61) and p[4] == pytest.approx(6 / 61)
    tests = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.005,)], "p double")
    assert {r["p"]: round(r["p_holm"], 6) for r in infer.holm(tests).collect()} == {0.01: 0.03, 0.04: 0.06, 0.03: 0.06, 0.005: 0.02}
    losses = spark.createDataFrame([(50, 1.0), (100, 1.0 + 0.6e-12), (200, 1.0 + 1.2e-12)], "width long, loss double")
    assert baselines.select_width(losses).first()["width"] == 100
    at = lambda s: rules.expected_latest(spark, F.lit(s).cast("timestamp")).first()["day"]
    assert at("2026-09-22 13:59:00") == date(2026, 9, 19) and at("2026-09-22 14:00:00") == date(2026, 9, 22)


def test_parsers(spark):
    draws = made_draws(3)
    page = spark.createDataFrame([("f", official(draws)), ("g", json.dumps({"value": {"Error": True}})), ("h", "{}"), ("i", json.dumps({"value": {"Error": False, "HtmlContent": "<table><tr><td>01/08/2017</td></tr></table>"}}))], "file string, content string")
    got = pages.parse_official(page).collect()
    good = sorted((r["draw_id"], r["draw_date"].isoformat(), r["main"] + [r["special"]]) for r in got if r["error"] is None)
    assert good == [(d["id"], d["date"], d["result"]) for d in draws]
    assert sorted(r["error"] for r in got if r["error"]) == ["no id in the row", "no table in the page", "the page reports an error"]
    raw = spark.createDataFrame([("f", x) for x in (*map(json.dumps, draws), "", "nonsense", '{"id": "7", "date": "bad", "result": [1]}', '{"id": "123456", "date": "2020-01-02", "result": [6,5,4,3,2,1]}')], "file string, value string")
    rows = pages.parse_jsonl(raw).collect()
    assert sum(r["error"] is None for r in rows) == 4 and len(rows) == 6
    assert {r["draw_id"]: r["main"] for r in rows if r["error"] is None}["123456"] == [1, 2, 3, 4, 5, 6]
    assert pages.between(pages.parse_jsonl(raw).where("error is null"), "2017-08-03", "2017-12-31").count() == 2


def test_archive(spark, tmp_path):
    root = str(tmp_path)
    for i in range(3):
        archive.write_page(root, "r1", "mirror", i, f"page {i} é")
    with pytest.raises(FileExistsError):
        archive.write_page(root, "r1", "mirror", 0, "again")
    assert sorted(r["content"] for r in archive.pages(spark, root).collect()) == [f"page {i} é" for i in range(3)]
    assert archive.verify(spark, root).count() == 0
    spark.dataSource.register(archive.ReplaySource)
    assert spark.read.format("page_replay").load(root).count() == 3
    with open(f"{root}/mirror/r1/page_0001.raw", "w") as f:
        f.write("other")
    os.remove(f"{root}/mirror/r1/page_0002.raw")
    assert sorted(r["problem"] for r in archive.verify(spark, root).collect()) == ["changed", "missing"]
    with pytest.raises(KeyError, match="mirror, official"):
        archive.parse("nowhere", archive.pages(spark, root))
    stop = list(archive.paged(lambda i: (str(i), [{"draw_id": f"{9 - i}", "draw_date": "2020"}] if i < 9 else []), stop_at="6"))
    assert [x[0] for x in stop] == [0, 1, 2, 3]


def test_client_waits():
    from email.message import Message
    from urllib.error import HTTPError

    slept, answers = [], []
    client = http.Client(interval=0, sleep=slept.append, opener=lambda r, timeout: answers.pop(0)())

    def refuse(code, wait=None):
        def run():
            m = Message()
            if wait:
                m["Retry-After"] = wait
            raise HTTPError("u", code, "x", m, None)

        return run

    class Good:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def read(self):
            return b"ok"

    answers[:] = [refuse(429, "7"), refuse(500), Good]
    assert client.get("http://x") == b"ok" and 7.0 in slept
    answers[:] = [refuse(404)]
    with pytest.raises(HTTPError):
        client.get("http://x")


def test_whole_path(spark, tmp_path):
    root = str(tmp_path / "root")
    draws = made_draws(40)
    last = draws[-1]["date"]
    as_of = f"{last} 14:30:00"
    os.environ["SUBSETLAB_REPLAY"] = "1"
    r = refresh.refresh(spark, root, {"official": once(official(draws[:39])), "mirror": once(lines(draws[:38]))}, as_of)
    assert r["exit_code"] in (0, 10) and all(v == "ok" for v in r["steps"].values()), r
    r = refresh.refresh(spark, root, {"official": once(official(draws)), "mirror": once(lines(draws))}, as_of)
    assert r["exit_code"] == 0, (r, refresh.quality_report(spark, root, as_of)["findings"])
    about = refresh.manifest(root)
    assert about["draws"] == 40 and about["files"]["fact_draw_number"] == 280
    curated = spark.read.parquet(f"{root}/curated/fact_draw")
    assert content_version(curated).first()["dataset_version"] == about["dataset_version"]
    assert refresh.curate(spark, root)["status"] == "unchanged"
    assert refresh.curate(spark, root, frozen=("00010", 10, "ds_000000000000"))["status"] == "blocked"
    assert refresh.reconcile(spark, root) == {"mismatches": 0, "only_left": 0, "only_right": 0}
    # History isn't rewritten: a changed record is refused.
    changed = [dict(draws[0], result=[1, 2, 3, 4, 5, 6, 7])]
    assert refresh.ingest(spark, root, "mirror", once(lines(changed)), "full")["status"] == "partial"
    assert refresh.staging(spark, root, "mirror").count() == 40
    assert cli.main(["--root", root, "verify-raw"], spark) == 0
    assert cli.main(["--root", root, "reconcile"], spark) == 0
    assert cli.main(["--root", root, "status", "--as-of", as_of], spark) in (0, 10)
    late = quality.findings(quality.Inputs(curated.withColumn("t", F.col("t")), refresh.staging(spark, root, "official"), f"{date.fromisoformat(last) + timedelta(days=30)} 14:30:00"))
    levels = {r["level"] for r in late.where("rule = 'freshness'").collect()}
    assert levels == {"FAIL"}
    with publish.Lock(f"{root}/refresh.lock"):
        assert refresh.refresh(spark, root, {}, as_of)["exit_code"] == 40
    assert refresh.loaded(spark, root, "00020").count() == 20
    with pytest.raises(PermissionError):
        refresh.loaded(spark, root, "00030", ceiling="00020")
    out = str(tmp_path / "eda")
    assert cli.main(["--root", root, "eda", "--out-dir", out, "--reps", "20", "--windows", "10", "--n-blocks", "2"], spark) == 0
    first = open(f"{out}/manifest.json").read()
    assert cli.main(["--root", root, "eda", "--out-dir", out, "--reps", "20", "--windows", "10", "--n-blocks", "2"], spark) == 0
    assert open(f"{out}/manifest.json").read() == first


def test_known_issues(spark, tmp_path):
    issue = {"id": "KI-001", "source": "official", "rules": ["special_present"], "draw_id": "00001", "reason": "r", "evidence": "e", "approved_by": "a", "approved_on": "2020-01-01", "review_by": "2030-01-01"}
    path = tmp_path / "k.json"
    path.write_text(json.dumps({"schema_version": "1.0", "issues": [issue]}))
    table = known_issues.table(spark, known_issues.load(str(path)), "2025-01-01")
    rows = [("c", "official", "00001", None, "special_present", "WARN", "", None), ("c", "official", "00002", None, "special_present", "WARN", "", None)]
    got = known_issues.apply(spark.createDataFrame(rows, quality.FINDING), table).orderBy("draw_id").collect()
    assert [(r["issue_id"], r["accepted"]) for r in got] == [("KI-001", True), (None, False)]
    for bad in ({"rules": ["unknown"]}, {"id": "X"}, {"id": "KI-"}, {"id": "KI-1"}, {"draw_id": "1"}, {"date_from": "2020-01-01"}, {"extra": 1}, {"rules": ["freshness"]}, {"rules": ["reconcile.field_mismatch"], "source": "mirror"}, {"rules": ["main_range"]}):
        path.write_text(json.dumps({"schema_version": "1.0", "issues": [issue | bad]}))
        with pytest.raises(ValueError):
            known_issues.load(str(path))


def test_stream(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    os.makedirs(folder)
    draws = made_draws(12)

    def add(name, rows):
        with open(f"{folder}/{name}", "w") as f:
            f.write(lines(rows))
        stream.start(spark, folder, out, check, "2026-01-01").awaitTermination()

    add("a.jsonl", draws[:5])
    add("b.jsonl", [dict(draws[0], result=[1, 2, 3, 4, 5, 6, 7]), *draws[5:], dict(draws[3], id="00099", result=[1, 1, 2, 3, 4, 5])])
    got = spark.read.schema(refresh.STAGED).parquet(out)
    assert got.count() == 12 and got.select("draw_id").distinct().count() == 12
    assert got.where("draw_id = '00001'").first()["n1"] == draws[0]["result"][0]
    assert set(CONTENT) <= set(got.columns)


def test_publication(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.1 + 0.2, None), (1, 1e-12, True)], "a int, b double, c boolean")
    assert publish.to_csv(df, ["a"]) == "a,b,c\n1,1e-12,true\n2,0.3,\n"
    folder = str(tmp_path / "p")
    publish.publish(folder, {"x.txt": "text"}, {"k": 1})
    with pytest.raises(FileExistsError):
        publish.publish(folder, {"x.txt": "text"}, {}, replace=False)
    with pytest.raises(ValueError, match="lucky"):
        publish.publish(folder, {"x.txt": "a lucky one"}, {})
    assert json.load(open(f"{folder}/manifest.json"))["k"] == 1 and np.isfinite(publish.Lock(folder).stale)
