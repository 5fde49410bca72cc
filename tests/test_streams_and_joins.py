"""Stream rules, merges, bundles, ordered joins, quantiles and version trees on small tables, against plain Python."""

import json
import os
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsetlab.model import MAIN
from subsetlab.operators import infer, joins, quantiles, version_tree
from subsetlab.plans import publish
from subsetlab.sources import bundle
from subsetlab.streaming import rules as stream_rules

RECORD = "source string, draw_id string, draw_date date, " + ", ".join(f"{c} long" for c in MAIN) + ", special_number long, received_at timestamp"


def record(source, draw_id, day, special, received_at, first=1):
    return (source, draw_id, day, first, 2, 3, 4, 5, 6, special, received_at)


def streamed(spark, folder, portions, rule):
    os.makedirs(f"{folder}/in", exist_ok=True)
    stream = spark.readStream.schema(RECORD).parquet(f"{folder}/in")
    for k, rows in enumerate(portions):
        spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        assert stream_rules.run(rule(stream), f"{folder}/out", f"{folder}/check").exception() is None, k
    return sorted((tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()), key=str)


def test_first_versions_whatever_the_batches(spark, tmp_path):
    at = datetime(2024, 1, 2, 10)
    rows = [
        record("a", "00001", date(2024, 1, 2), 9, at), record("a", "00001", date(2024, 1, 2), 9, at + timedelta(hours=1)), record("b", "00001", date(2024, 1, 2), 8, at),
        record("a", "00002", None, None, at), record(None, None, None, 1, at), record("a", "00001", date(2024, 1, 2), 7, at + timedelta(hours=2)),
        record("a", "00002", date(2024, 1, 4), None, at + timedelta(hours=3)), record("a", "00001", date(2024, 1, 3), 7, at + timedelta(hours=4), 0),
        record("a", "00001", date(2024, 1, 2), 7, at + timedelta(hours=5)), record("a", "00001", date(2024, 1, 2), 9, at + timedelta(hours=6)),
    ]
    one = streamed(spark, str(tmp_path / "one"), [rows], stream_rules.first_versions)
    many = streamed(spark, str(tmp_path / "many"), [rows[:5], rows[5:7], rows[7:]], stream_rules.first_versions)
    assert one == many
    found = [(r[1], r[2], r[4]) for r in one if r[2]]
    assert sorted(found) == sorted([("00001", "stored_row_conflict", "special_number: 9 > 7"), ("00001", "stored_row_conflict", "draw_date: 2024-01-02 > 2024-01-03, n1: 1 > 0, special_number: 9 > 7"), ("00002", "stored_row_conflict", "draw_date: <NA> > 2024-01-04")])
    assert len([r for r in one if r[2] is None]) == 4


def test_overdue_results(spark, tmp_path):
    # 2 January 2024 is a Tuesday; results are due at 14:00 UTC.
    day = lambda k: date(2024, 1, k)
    at = lambda k, h=13: datetime(2024, 1, k, h)
    rows = [
        record("a", "1", day(2), 1, at(2)), record("a", "2", day(6), 1, at(6)), record("a", "2", day(6), 1, at(6)),
        record("a", "3", day(4), 1, at(8)), record("a", "4", day(9), 1, at(9, 20)), record("b", "1", day(11), 1, at(11)), record(None, "1", day(2), 1, at(11)), record("a", "9", None, 1, at(11)),
    ]
    expected = {("a", day(4), "missed_deadline", at(4, 14)), ("a", day(4), "late_result", at(8)), ("a", day(9), "missed_deadline", at(9, 14)), ("a", day(9), "late_result", at(9, 20))}
    expected.add(("b", day(13), "missed_deadline", at(13, 14)))
    expected |= {("a", day(k), "missed_deadline", at(k, 14)) for k in (11, 13)}
    # Days that have a result already, on time or late, get another one.
    last = [record("c", "1", day(3), 1, at(14)), record("a", "2", day(6), 2, at(14)), record("a", "3", day(4), 2, at(14)), record("a", "4", day(9), 2, at(14))]
    for name, portions in {"one": [rows, last], "many": [rows[:3], rows[3:4], rows[4:], last]}.items():
        got = streamed(spark, str(tmp_path / name), portions, stream_rules.overdue)
        assert {(r[0], r[1], r[2], r[4]) for r in got} == expected and len(got) == len(expected)


def test_a_stream_goes_on_after_a_failure(spark, tmp_path):
    flag = str(tmp_path / "flag")

    @F.udf("string")
    def checked(x):
        if os.path.exists(flag):
            raise RuntimeError("stopped")
        return x

    rule = lambda df: stream_rules.first_versions(df.withColumn("source", checked("source")))
    at = datetime(2024, 1, 2, 10)
    portions = [[record("a", f"{i:05d}", date(2024, 1, 2), k, at + timedelta(hours=k)) for i in range(20)] for k in range(3)]
    expected = streamed(spark, str(tmp_path / "whole"), portions, stream_rules.first_versions)
    folder = str(tmp_path / "stopped")
    streamed(spark, folder, portions[:1], rule)
    open(flag, "w").close()
    with pytest.raises(Exception, match="stopped"):
        streamed(spark, folder, portions[1:2], rule)
    os.remove(flag)
    assert streamed(spark, folder, portions[2:], rule) == expected
    assert spark.conf.get(stream_rules.STORE, None) != stream_rules.ROCKS


STAGED = "draw_id string, n long"


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_merge_touches_its_ranges_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda ids: spark.createDataFrame([(f"{i:05d}", i) for i in ids], STAGED)
    publish.merge_ranges(rows(range(1, 5000, 3)), path, STAGED)
    before = files(path)
    publish.merge_ranges(rows([2001, 2003]), path, STAGED)
    after = files(path)
    changed = {f for f in set(before) | set(after) if before.get(f) != after.get(f)}
    assert changed and all("id_range=2/" in f for f in changed) and len(after) == len(before)
    near = publish.read_ranges(spark, path, STAGED, rows([4001, 4002, 70001]))
    read = [r[0] for r in near.select(F.input_file_name()).distinct().collect()]
    assert read and all("id_range=4/" in f for f in read)
    # Once more, as after a failure: the same rows.
    publish.merge_ranges(rows([2001, 2003]), path, STAGED)
    publish.merge_ranges(spark.createDataFrame([("x1", -1), (None, -2)], STAGED), path, STAGED)
    got = sorted(r["n"] for r in publish.read_ranges(spark, path, STAGED).collect())
    assert got == sorted([*range(1, 5000, 3), 2001, 2003, -1, -2])
    publish.NAMED, kept = 1, publish.NAMED
    try:
        assert publish.read_ranges(spark, path, STAGED, rows([1, 1001, 2001])).count() == len([i for i in [*range(1, 3000, 3), 2001, 2003] if i < 3000])
    finally:
        publish.NAMED = kept
    assert publish.read_ranges(spark, str(tmp_path / "none"), STAGED).count() == 0


def test_bundles(spark, tmp_path):
    uri = str(tmp_path / "bundle")
    df = spark.createDataFrame([(i, i / 3, None if i % 2 else f"x,{i}") for i in range(50)], "i long, x double, s string").repartition(3)
    first = bundle.publish_table(df, uri, "a", {"spec": "1"})
    assert first["number"] == 1 and sum(f["rows"] for f in first["files"].values()) == 50 and bundle.verify(uri) == []
    second = bundle.publish_table(df.limit(0), uri, "b")
    assert {f["table"] for f in second["files"].values()} == {"a", "b"} and second["about"] == {"spec": "1"}
    assert bundle.read_table(spark, uri, "a", "i long, x double, s string").agg(F.sum("i")).first()[0] == sum(range(50))
    assert bundle.read_table(spark, uri, "b", "i long").count() == bundle.read_table(spark, uri, "none", "i long").count() == 0

    # A task that fails: nothing is published, and what it wrote goes.
    folders = set(os.listdir(f"{uri}/data"))
    with pytest.raises(Exception, match="divide|DIVIDE|zero"):
        bundle.publish_table(df.withColumn("x", F.expr("CASE WHEN i = 49 THEN raise_error('divide') ELSE x END")), uri, "a")
    assert bundle.current(uri) == second and set(os.listdir(f"{uri}/data")) == folders
    with pytest.raises(Exception, match="lucky"):
        bundle.publish_table(spark.createDataFrame([("a lucky one",)], "s string"), uri, "c")
    # A driver that was killed between the files and the pointer, or in the middle of the pointer.
    os.makedirs(f"{uri}/data/left")
    with open(f"{uri}/_current/000000000003", "w") as f:
        f.write(json.dumps({"number": 3, "files": {}})[:-1])
    assert bundle.current(uri) == second
    third = bundle.publish_table(df.limit(5), uri, "a", replace=True)
    assert third["number"] == 4 and bundle.current(uri) == third and {f["table"] for f in third["files"].values()} == {"a"}
    os.remove(os.path.join(uri, next(iter(third["files"]))))
    assert bundle.verify(uri) == [next(iter(third["files"]))]
    assert bundle.current(str(tmp_path / "nothing")) is None


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_join(spark, direction, strict):
    rng = random.Random(strict)
    key = lambda: rng.choice([0, 0, 0, 1, 2, None])
    left = [(i, key(), rng.choice([None, *range(30)]), "l") for i in range(200)] + [(7, 0, 5, "l")] * 2
    right = [(key(), rng.choice([None, *range(30)]), i, "m") for i in range(60)]
    a = spark.createDataFrame(left, "id long, k long, at long, match string").withColumnRenamed("match", "_on")
    b = spark.createDataFrame(right, "k long, at long, v long, _row string")
    got = joins.asof_join(a, b, "at", ["k"], ["v"], direction, strict)
    assert got.columns == ["id", "k", "at", "_on", "match"]

    def nearest(k, at):
        fits = [(x, v) for j, x, v, _ in right if None not in (k, at, x) and j == k and ((x < at or x == at and not strict) if direction == "backward" else (x > at or x == at and not strict))]
        return (max if direction == "backward" else min)(fits, default=None)

    expected = sorted((str((i, k, at)), str(nearest(k, at))) for i, k, at, _ in left)
    assert sorted((str((r["id"], r["k"], r["at"])), str(tuple(r["match"]) if r["match"] else None)) for r in got.collect()) == expected
    assert joins.asof_join(a, b.limit(0), "at", ["k"], ["v"], direction, strict).where("match is not null").count() == 0
    assert joins.asof_join(a.limit(0), b, "at", [], ["v"], direction, strict).count() == 0


@pytest.mark.parametrize("rows", [5, 10**6])
def test_interval_join(spark, monkeypatch, rows):
    monkeypatch.setattr(joins, "ROWS", rows)
    rng = random.Random(rows)
    points = [(i, rng.choice([0, 0, 1, None]), rng.choice([None, 77, *range(-50, 400)])) for i in range(150)] + [(1, 0, 77)] * 20
    spans = [(i, rng.choice([0, 0, 1, None]), a, a + rng.choice([-1, 0, 0, 1, 3, 8, 100, 5000])) for i in range(80) for a in [rng.randrange(-60, 300)]] + [(99, 0, 70, 80)] * 15 + [(5, 0, None, 4), (6, 0, 4, None)]
    p = spark.createDataFrame(points, "id long, _bits long, at long")
    s = spark.createDataFrame(spans, "id long, _bits long, lo long, hi long")
    for by in (["_bits"], []):
        got = sorted((r["point"]["id"], r["interval"]["id"], r["point"]["at"]) for r in joins.interval_join(p, s, "at", "lo", "hi", by).collect())
        expected = sorted((i, j, at) for i, k, at in points for j, m, lo, hi in spans if None not in (at, lo, hi) and lo <= at <= hi and (not by or k is not None and k == m))
        assert got == expected
    days = spark.createDataFrame([(date(2024, 1, k),) for k in range(1, 20)], "d date")
    weeks = spark.createDataFrame([(date(2024, 1, 3), date(2024, 1, 9))], "a date, b date")
    assert joins.interval_join(days, weeks, "d", "a", "b").count() == 7
    with pytest.raises(TypeError):
        joins.interval_join(p.withColumn("at", F.col("at").cast("double")), s, "at", "lo", "hi")


@pytest.mark.parametrize("buckets", [2, 4096])
def test_quantiles(spark, buckets):
    rng = np.random.default_rng(buckets)
    groups = {"a": rng.normal(size=500), "b": rng.integers(0, 4, 300) / 7, "c": np.array([3.5]), None: rng.choice([1e-300, 1.0, 2.0, 1e300], 50), "e": np.array([-1.7e308, 1.7e308, 0.0, 5e-324])}
    rows = [(k, float(x)) for k, own in groups.items() for x in own] + [("a", None), ("a", float("nan")), ("a", float("inf")), ("d", None)]
    df = spark.createDataFrame(rows, "k string, _x double").repartition(3)
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["k"], r["q"]): r for r in quantiles.quantiles(df, "_x", ["k"], qs, buckets).collect()}
    assert set(got) == {(k, q) for k in groups for q in qs}
    for (k, q), r in got.items():
        own = np.sort(groups[k])
        assert r["n"] == len(own)
        assert r["lower"] == own[int(np.floor(q * (len(own) - 1)))] and r["higher"] == own[int(np.ceil(q * (len(own) - 1)))]
        if k != "e":
            assert r["linear"] == pytest.approx(np.quantile(own, q), rel=1e-12, abs=1e-300)
    whole = quantiles.quantiles(df.where("k = 'b'"), "_x", [], [0.5], buckets).collect()
    assert [r["lower"] for r in whole] == [np.sort(groups["b"])[149]]
    assert quantiles.quantiles(df.limit(0), "_x", ["k"], qs).collect() == []


def draws(spark, n, change=()):
    rows = [(t, f"{t:05d}", date(2024, 1, 1) + timedelta(days=t), *(((t * k) % 9) * 6 + k for k in range(1, 7)), None if t % 5 else t % 50) for t in range(1, n + 1)]
    rows = [(*r[:9], 55) if r[0] in change else r for r in rows]
    return spark.createDataFrame(rows, "t long, draw_id string, draw_date date, " + ", ".join(f"n{i} long" for i in range(1, 7)) + ", special_number long")


def test_version_tree(spark, monkeypatch):
    monkeypatch.setattr(version_tree, "LEAF", 10)
    monkeypatch.setattr(version_tree, "FANOUT", 4)
    old, new = draws(spark, 500), draws(spark, 500, {77, 301}).where("t <> 78")
    a, b = version_tree.tree(old), version_tree.tree(new)
    assert version_tree.differing_leaves(a, version_tree.tree(old.orderBy(F.desc("t")))).count() == 0
    assert sorted(r["node"] for r in version_tree.differing_leaves(a, b).collect()) == [7, 30]
    extra = new.where("t = 5").withColumn("draw_id", F.lit("x9")).unionByName(new.where("t = 6").withColumn("draw_id", F.lit("99999")))
    got = {r["draw_id"]: r["change"] for r in version_tree.differences(old, new.unionByName(extra)).collect()}
    assert got == {"00077": "changed", "00301": "changed", "00078": "removed", "x9": "added", "99999": "added"}
    assert version_tree.differences(old, new, a, b).count() == 3
    assert {r["change"] for r in version_tree.differences(old.limit(0), old).collect()} == {"added"}


@pytest.mark.parametrize("size", [10, 13, 100_000])
def test_overlaps_across_chunks(spark, size):
    df = draws(spark, 60)
    sets = [set(r[m] for m in MAIN) for r in df.orderBy("t").collect()]
    got = {r["lag"]: r["overlap"] for r in infer.lag_overlap(df, 10, size).collect()}
    assert got == {h: pytest.approx(sum(len(a & b) for a, b in zip(sets, sets[h:], strict=False)) / (60 - h)) for h in range(1, 11)}
    assert {r["lag"] for r in infer.lag_overlap(df.where("t <= 4"), 10, size).collect()} == {1, 2, 3}
