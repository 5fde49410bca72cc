"""Tasks that derive draws hold a fixed number of order lines, however large the tables are."""

import datetime as dt
import random
import re

from subsetlab import model
from subsetlab.operators import describe, series


def tables(spark):
    rng = random.Random(5)
    orders = [(k, dt.date(1995, 1, 1) + dt.timedelta(days=k % 9)) for k in range(120)]
    lines = [(k, i, rng.randint(1, 2000)) for k, _ in orders for i in range(1, rng.randint(5, 9))]
    return spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long"), spark.createDataFrame(orders, "o_orderkey long, o_orderdate date"), len(lines)


def test_lines_of_a_task(spark, monkeypatch):
    lineitem, orders, n = tables(spark)
    want = sorted(map(tuple, model.derive_draws(lineitem, orders).collect()))
    monkeypatch.setattr(model, "PART_LINES", 50, raising=False)
    draws = model.derive_draws(lineitem, orders)
    assert sorted(map(tuple, draws.collect())) == want and want
    # Lines go to parts by their order before anything is counted, and are not grouped again elsewhere.
    plan = draws._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = [x.split(",")[-1].strip() for x in plan if "RepartitionByExpression [l_orderkey" in x]
    assert dealt and set(dealt) == {str(-(-n // 50))}
    executed = draws._jdf.queryExecution().executedPlan().toString().splitlines()
    by_order = [x for x in executed if "Exchange hashpartitioning(l_orderkey" in x]
    assert by_order and all("REPARTITION_BY_NUM" in x for x in by_order)


def test_draws_of_a_task_that_gathers_chunks(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK", 10)
    monkeypatch.setattr(series, "PART_DRAWS", 30, raising=False)
    lineitem, orders, _ = tables(spark)
    draws = model.derive_draws(lineitem, orders)
    n = draws.count()
    counts = describe.counts_and_before(draws, (7,))
    assert counts.count() == n * model.N
    plan = counts._jdf.queryExecution().executedPlan().toString()
    # Draws aren't derived again for each use, and chunks go to parts of fixed size, on both sides and once.
    assert "l_orderkey" not in plan
    for key in ("_chunk", "_of"):
        assert re.search(rf"Exchange hashpartitioning\({key}#\d+L?, {-(-n // 30)}\), REPARTITION_BY_NUM", plan)
