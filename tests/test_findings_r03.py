"""Long series, dense intervals and joins of what Python makes: what fell over or differed on larger tables."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsetlab.functions import nulls
from subsetlab.model import MAIN, P_MAIN
from subsetlab.operators import describe, joins
from subsetlab.plans import quality, resampling

SCHEMA = "t long, draw_id string, draw_date date, " + ", ".join(f"{c} long" for c in MAIN) + ", special_number long, source string, dataset_version string"


def curated(spark, rows):
    return spark.createDataFrame([(t, i, dt.date(1995, 1, 3) + dt.timedelta(days=t), *main, 50, "official", "v1") for t, i, main in rows], SCHEMA)


def found(spark, rows, check):
    x = quality.Inputs(curated(spark, rows), None, "1998-09-01 12:00:00")
    return {(r["rule"], r["draw_id"], r["detail"]) for r in quality.findings(x, (check,)).collect()}


def test_ids_of_six_digits_are_curated_ids(spark):
    rows = [(1, "100001", (1, 2, 3, 4, 5, 6)), (2, "00012", (1, 2, 3, 4, 5, 7)), (3, "0123", (1, 2, 3, 4, 5, 8)), (4, "012345", (1, 2, 3, 4, 5, 9))]
    bad = {d for rule, d, _ in found(spark, rows, "curated.ranges") if rule == "draw_id_format"}
    assert bad == {"0123", "012345"}


def test_contents_of_rows_that_share_an_id_all_count(spark):
    a, b = (1, 2, 3, 4, 5, 6), (1, 2, 3, 4, 5, 7)
    got = found(spark, [(1, "00001", a), (2, "50001", a), (3, "50001", b), (4, "50002", b), (5, "50002", b)], "curated.duplicates")
    assert {x for x in got if x[0] == "duplicate_content"} == {("duplicate_content", "50001", "00001"), ("duplicate_content", "50002", "50001")}


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_interval_totals_as_by_pairs(spark, rows):
    rng = random.Random(rows)
    points = [(rng.randint(-40, 40) if k % 9 else None, rng.randint(-9, 9) if k % 5 else None) for k in range(120)]
    spans = [(k, a, a + rng.randint(-2, 50)) for k in range(60) for a in [rng.randint(-50, 45)]] + [(99, None, 4), (98, 60, 70), (97, 0, 0), (97, 0, 0)]
    got = joins.interval_totals(spark.createDataFrame(points, "at long, v long"), spark.createDataFrame(spans, "k long, a long, b long"), "at", "a", "b", "v", rows=rows)
    want = []
    for k, a, b in spans:
        if a is not None and a <= b:
            held = [v for x, v in points if x is not None and a <= x <= b]
            known = [v for v in held if v is not None]
            want.append((k, a, b, len(held), min(known, default=None), sum(known) if known else None))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_interval_totals_make_no_pairs(spark):
    n = 20_000
    points = spark.range(n).select((F.col("id") % 3).alias("at"), F.col("id").alias("v"))
    spans = spark.range(n).select("id", F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    got = joins.interval_totals(points, spans, "at", "a", "b", "v").agg(F.min("n"), F.max("n"), F.sum("least"), F.count("total")).first()
    # 270 million pairs.
    assert tuple(got) == (13_334, 13_334, 0, n)


def test_sums_past_64_bits_raise(spark):
    points = spark.createDataFrame([(1, 2**62), (2, 2**62)], "at long, v long")
    with pytest.raises(OverflowError):
        joins.interval_totals(points, spark.createDataFrame([(1, 2)], "a long, b long"), "at", "a", "b", "v")


def test_bands_follow_from_the_draw_before(spark, monkeypatch):
    calls = []
    exact = describe._band_ends
    for t in (*range(1, 400), *range(50_000, 50_300)):
        ends = exact(t, P_MAIN, (0.025, 0.975)) if t in (1, 50_000) else [describe._next_end(t - 1, P_MAIN, level, e) for level, e in zip((0.025, 0.975), ends, strict=True)]
        calls.append((t, ends))
    for t, ends in calls:
        assert tuple(e[0] for e in ends) == tuple(x[0] for x in exact(t, P_MAIN, (0.025, 0.975)))
    ts = [*range(1, 60), 300, 301, 900_000, 900_001]
    got = {r["t"]: (r["band_lo"], r["band_hi"]) for r in describe.bands_by_draw(spark.createDataFrame([(t,) for t in ts], "t long")).collect()}
    assert all(got[t] == nulls.binomial_band(t, P_MAIN) for t in ts)


def test_places_of_resamples_are_not_broadcast(spark):
    rng = np.random.default_rng(2)
    series = spark.createDataFrame([(c, t, float(rng.random())) for c in "ab" for t in range(1, 60)], "config string, t long, x double")
    plan = resampling.bootstrap_series(series, "x", resamples=20)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [start" in plan
