"""The search finds the nearest whatever the vectors' place and scale, and inside tight clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsetlab.llm import ann

N, D = 3000, 32


@pytest.mark.parametrize("kind", ["tight clusters", "huge", "small", "many scales"])
def test_recall_on_other_rows(spark, kind):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(N, D))
    x = {
        "tight clusters": rng.normal(size=(3, D))[rng.integers(0, 3, N)] * 5 + base * 1e-3, "huge": base * 1e25, "small": base * 1e-25, "many scales": base * 10 ** rng.uniform(-3, 3, (N, 1)),
    }[kind].astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(rows, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    far = np.sqrt(((x[::100, None].astype(np.float64) - x[None]) ** 2).sum(axis=2))
    far[np.arange(len(far)), np.arange(0, N, 100)] = np.inf
    hit = sum(len(got[100 * i] & set(np.argsort(d, kind="stable")[:10].tolist())) for i, d in enumerate(far))
    assert hit >= 0.97 * 10 * len(far)
