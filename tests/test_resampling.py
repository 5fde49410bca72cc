"""The bootstrap from sums of blocks against that of a collected series."""

import numpy as np
import pytest

from subsetlab.plans import montecarlo, resampling


@pytest.mark.parametrize(("n", "block", "size"), [(1190, 10, None), (97, 10, 20), (30, 7, 6), (12, 12, None), (9, 1, None)])
def test_same_as_the_collected_series(spark, n, block, size):
    rng = np.random.default_rng(n)
    rows = [(c, int(t), float(x)) for c in ("a", "b") for t, x in zip(range(501, 501 + n), rng.normal(size=n), strict=True)]
    df = spark.createDataFrame(rows, "config string, t long, v double").repartition(3)
    got = {r["config"]: r for r in resampling.bootstrap_series(df, "v", block, 60, size=size).collect()}
    expected = {r["config"]: r for r in montecarlo.bootstrap(df, "v", block, 60).collect()}
    assert set(got) == set(expected) == {"a", "b"}
    for c, r in got.items():
        assert (r["mean"], r["lo"], r["hi"]) == pytest.approx((expected[c]["mean"], expected[c]["lo"], expected[c]["hi"]), rel=1e-9, abs=1e-12)


def test_what_cannot_be_resampled(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 1.0)], "config string, t long, v double")
    assert resampling.bootstrap_series(df.limit(0), "v").collect() == []
    with pytest.raises(ValueError, match="differ"):
        resampling.bootstrap_series(df, "v", 1, 5)
    with pytest.raises(ValueError, match="fewer"):
        resampling.bootstrap_series(df.where("config = 'a'"), "v", 10, 5)
