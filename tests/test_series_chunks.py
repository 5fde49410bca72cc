"""Counts and scores in chunks: the same as from one row for each draw and number, whatever the chunks."""

import numpy as np
import pytest

from subsetlab.model import MAIN, N
from subsetlab.operators import baselines, describe, series

SCHEMA = "t long, draw_id string, draw_date date, " + ", ".join(f"{c} long" for c in MAIN) + ", special_number long"


def made(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(t, f"{t:05d}", None, *sorted((rng.choice(N, 6, replace=False) + 1).tolist()), None) for t in range(1, n + 1)]
    return spark.createDataFrame(rows, SCHEMA), np.array([r[3:9] for r in rows])


def rows_of(df, *keys):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[: len(keys)])


def test_correlations_of_large_counts(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(60_000_000, 60_090_000, (2, 1485))
    rows = [(b, k, int(x[b, k])) for b in range(2) for k in range(1485)]
    got = describe.correlations(spark.createDataFrame(rows, "block long, num long, x long"), ["num"]).collect()
    assert got[0]["r"] == pytest.approx(np.corrcoef(x)[0, 1], abs=1e-9)


def test_counts_cross_the_borders_of_chunks(spark, monkeypatch):
    draws, main = made(spark, 47)
    monkeypatch.setattr(series, "BLOCK", 10)
    y = np.zeros((47, N + 1), int)
    y[np.arange(47)[:, None], main] = 1
    c = y.cumsum(axis=0)
    got = {(r["t"], r["num"]): r for r in describe.counts_and_before(draws, (3, 7)).collect()}
    assert len(got) == 47 * N
    for t in range(1, 48):
        for k in range(1, N + 1):
            r = got[t, k]
            assert (r["y"], r["c"]) == (y[t - 1, k], c[t - 1, k])
            assert (r["before_3"], r["before_7"]) == tuple(c[t - w - 1, k] if t > w else 0 for w in (3, 7))


def test_scores_added_up_in_chunks(spark, monkeypatch):
    draws, _ = made(spark, 620)
    monkeypatch.setattr(series, "BLOCK", 211)
    scored = baselines.scores(draws).cache()
    want, got = rows_of(baselines.draw_scores(scored), "config", "t"), rows_of(baselines.scored_draws(draws), "config", "t")
    assert len(want) == len(got) == 5 * 620
    for a, b in zip(want, got, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-11)
    # Few bits a pass, so that there are many.
    monkeypatch.setattr(baselines, "DIGIT", 9)
    want = rows_of(baselines.reliability(scored.where("t > 500"), ["config"]), "config", "bin")
    got = rows_of(baselines.calibration(draws), "config", "bin")
    assert [r[:3] for r in want] == [r[:3] for r in got]
    for a, b in zip(want, got, strict=True):
        assert a[3:5] == pytest.approx(b[3:5], abs=1e-12) and a[5:] == b[5:]
    assert baselines.calibration(draws.where("t <= 500")).collect() == []


def test_periods_without_a_join(spark):
    draws, _ = made(spark, 720)
    per = baselines.scored_draws(draws).cache()
    member, own = baselines.periods(draws, 720), baselines.in_periods(per, 720)
    for f in (baselines.period_metrics, baselines.deltas):
        want, got = rows_of(f(per, member), "config", "period"), rows_of(f(own), "config", "period")
        assert len(want) == len(got) and [r[:2] for r in want] == [r[:2] for r in got]
        assert all(a[2:] == pytest.approx(b[2:], abs=1e-12) for a, b in zip(want, got, strict=True))
