"""Runs that collect a series refuse a longer one; none keeps a part of it."""

import pytest

from subsetlab.plans import montecarlo


def scored(spark, rows):
    return spark.createDataFrame([(c, t, k, 0.1 * k + 0.001 * t, int((t + k) % 3 == 0)) for c, t in rows for k in (1, 2, 3)], "config string, t long, num int, p double, y int")


def test_bootstrap_ece_takes_all_draws_or_none(spark, monkeypatch):
    every = scored(spark, [(c, t) for c in ("A", "B") for t in range(1, 41)])
    whole = {r["config"]: r["ece"] for r in montecarlo.bootstrap_ece(every, resamples=5).collect()}
    monkeypatch.setattr(montecarlo, "SERIES", 40)
    assert {r["config"]: r["ece"] for r in montecarlo.bootstrap_ece(every, resamples=5).collect()} == whole
    monkeypatch.setattr(montecarlo, "SERIES", 39)
    with pytest.raises(ValueError, match="39 draws"):
        montecarlo.bootstrap_ece(every, resamples=5)


def test_bootstrap_ece_needs_the_same_draws(spark):
    with pytest.raises(ValueError, match="differ"):
        montecarlo.bootstrap_ece(scored(spark, [("A", 1), ("A", 2), ("B", 1)]), resamples=5)
