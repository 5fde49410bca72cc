"""Null distributions against enumeration of all subsets, and published values."""

import math
from itertools import combinations

import pytest

from subsetlab.functions import nulls
from subsetlab.operators import baselines

SIZES = [(10, 3), (12, 4), (11, 6)]


def enumerated(n, k, f):
    counts, total = {}, 0
    for s in combinations(range(1, n + 1), k):
        for v in f(s):
            counts[v] = counts.get(v, 0) + 1
            total += 1
    return {v: c / total for v, c in sorted(counts.items())}


def gaps(s):
    return [b - a for a, b in zip(s, s[1:], strict=False)]


CASES = {
    "sum": lambda s: [sum(s)], "min": lambda s: [s[0]], "max": lambda s: [s[-1]], "range": lambda s: [s[-1] - s[0]], "odd": lambda s: [sum(x % 2 for x in s)],
    "consecutive": lambda s: [sum(g == 1 for g in gaps(s))], "gap": gaps, "min_gap": lambda s: [min(gaps(s))], "max_gap": lambda s: [max(gaps(s))],
}


@pytest.mark.parametrize(("n", "k"), SIZES)
@pytest.mark.parametrize("metric", CASES)
def test_pmfs(metric, n, k):
    expected, got = enumerated(n, k, CASES[metric]), nulls.PMFS[metric](n, k)
    assert set(expected) <= set(got)
    assert all(abs(p - expected.get(v, 0)) < 1e-12 for v, p in got.items())


def test_moments_and_bands():
    assert nulls.moments(nulls.sum_pmf()) == pytest.approx((168, math.sqrt(1372)))
    assert [nulls.moments(nulls.PMFS[m]())[0] for m in ("min", "max", "range", "consecutive", "gap")] == pytest.approx([8, 48, 40, 6 / 11, 8])
    assert nulls.binomial_band(1190, 6 / 55) == (109, 151) and nulls.binomial_band(1190, 1 / 55) == (13, 31)
    assert nulls.binomial_test(139, 1190, 6 / 55) == pytest.approx(0.4024445873) and nulls.binomial_test(26, 1190, 1 / 55) == pytest.approx(0.3279077076)
    assert nulls.wilson(5, 10) == pytest.approx((0.2366, 0.7634), abs=1e-4) and nulls.wilson(0, 0) == (0, 0)


def test_chi2():
    assert nulls.chi2_sf(10, 5) == pytest.approx(0.0752352) and nulls.chi2_sf(10, 10) == pytest.approx(0.4404933) and nulls.chi2_sf(0, 4) == 1


def test_cells():
    cells = nulls.test_cells("consecutive", 1190)
    assert [c[0] for c in cells] == ["0", "1", "2", ">=3"]
    assert [c[3] for c in cells] == pytest.approx([0.548150, 0.365434, 0.079442, 0.006974], abs=1e-6)
    for metric in nulls.PMFS:
        for n in (1, 30, 500, 5000):
            for made in (nulls.metric_cells(metric, n), nulls.test_cells(metric, n)):
                assert sum(c[3] for c in made) == pytest.approx(1)
                assert all(a[2] + 1 == b[1] for a, b in zip(made, made[1:], strict=False))
                # Of few draws no single value may have enough expected: then the last one stands alone.
                if len(made) > 1 and metric != "consecutive" and n >= 500:
                    assert made[0][3] * n >= 5 and made[-1][3] * n >= 5


def test_null_excess():
    assert [round(baselines.null_excess(m)[0], 5) for m in (50, 100, 200, 500)] == [0.00788, 0.00445, 0.00236, 0.00098]
    assert len(baselines.folds(1190)) == 14 and baselines.folds(1190)[-1]["last"] - baselines.folds(1190)[-1]["first"] == 39
