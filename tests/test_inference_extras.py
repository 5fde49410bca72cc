"""Permutations by ranges, the follow-up of C4, exploratory p-values, scores' sanity, JSON logging, the last arrival of an id."""

import hashlib
import json
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsetlab import logs
from subsetlab.model import MAIN
from subsetlab.operators import baselines, infer, rules
from subsetlab.plans import montecarlo, publish


@pytest.fixture(scope="module")
def draws(spark):
    main, special = montecarlo.simulate(montecarlo.generator(1, 2), 1, 400)
    rows = [(t + 1, f"{t + 1:05d}", *map(int, main[0, t]), int(special[0, t]) if t % 3 else None) for t in range(400)]
    schema = "t long, draw_id string, " + ", ".join(f"{c} long" for c in MAIN) + ", special_number long"
    return spark.createDataFrame(rows, schema).withColumn("draw_date", F.expr("date_add(date '2017-08-01', cast(t * 2 as int))")).cache()


def test_permutations_do_not_depend_on_how_they_are_dealt(spark, draws):
    main, _, years = montecarlo.series(draws)
    got = {r["replicate"]: r["C7"] for r in montecarlo.permuted(spark, main, years, 37).collect()}
    rng, y = montecarlo.generator(montecarlo.SEED, montecarlo.PERMUTED), montecarlo.indicator(main)
    expected = [montecarlo.order_statistics(y[rng.permutation(len(y))], years)["C7"] for _ in range(37)]
    assert sorted(got) == list(range(37)) and np.allclose([got[i] for i in range(37)], expected, rtol=0, atol=1e-12)


def test_lags_are_followed_up_against_permutations(draws):
    rows = montecarlo.follow_up(draws, "C4", 60).collect()
    assert sorted(int(r["part"]) for r in rows) == list(range(1, 11))
    assert all(0 < r["p"] <= r["p_holm"] <= 1 for r in rows)


def test_exploratory(draws):
    rows = {r["name"]: r for r in montecarlo.exploratory(draws, 80).collect()}
    assert set(rows) == {"c1_scaled", "ljung_box_5", "ljung_box_10", "ljung_box_20", "special_rank", "sum_bins"}
    assert all(0 < r["p"] <= 1 for r in rows.values()) and rows["special_rank"]["df"] == 48
    ranks = infer.special_ranks(draws).agg(F.sum("observed").alias("n"), F.count(F.lit(1)).alias("k")).first()
    assert (ranks["n"], ranks["k"]) == (draws.where("special_number is not null").count(), 49)


def test_sanity_finds_what_is_broken(draws):
    scored = baselines.scores(draws, (50,)).where("t > 100")
    bins = baselines.reliability(scored, ["config"])
    per = baselines.draw_scores(scored)
    membership = draws.where("t > 300").select("t", F.lit("last").alias("period"))
    good = {r["check"]: r["broken"] for r in baselines.sanity(per, bins, membership, {"last": 100}).collect()}
    assert set(good.values()) == {0}
    bad = per.withColumn("sum_p", F.when(F.col("t") == 200, F.lit(7.0)).otherwise(F.col("sum_p")))
    broken = {r["check"]: r["broken"] for r in baselines.sanity(bad, bins, membership, {"last": 99}).collect()}
    assert broken["sum_p"] == 3 and broken["period_sizes"] == 1


def test_last_arrival_of_an_id(spark):
    rows = [("1", "a", 1, None), ("1", "b", 3, 5), ("1", None, 2, 4), ("2", "c", 1, 1)]
    got = rules.last_by_id(spark.createDataFrame(rows, "draw_id string, x string, at int, y int"), "at").collect()
    assert sorted(tuple(r) for r in got) == [("1", "b", 3, 5), ("2", "c", 1, 1)]


def test_logging_in_json_lines(tmp_path):
    path = tmp_path / "log.jsonl"
    logger = logs.configure("INFO", str(path))
    logger.info("fetched é", extra={"page": 3})
    try:
        raise ValueError("no")
    except ValueError:
        logging.getLogger("subsetlab.http").exception("failed")
    logger.debug("not shown")
    for handler in logger.handlers[:]:
        handler.close()
        logger.removeHandler(handler)
    one, two = (json.loads(x) for x in path.read_text(encoding="utf-8").splitlines())
    assert (one["event"], one["level"], one["page"]) == ("fetched é", "INFO", 3)
    assert two["logger"] == "subsetlab.http" and "ValueError: no" in two["exc"]


def test_experiment_against_plain_numpy(spark):
    main, special = montecarlo.simulate(montecarlo.generator(5, 2), 1, 620)
    rows = [(t + 1, f"{t + 1:05d}", *map(int, main[0, t]), int(special[0, t])) for t in range(620)]
    draws = spark.createDataFrame(rows, "t long, draw_id string, " + ", ".join(f"{c} long" for c in MAIN) + ", special_number long")
    got = {(r["period"], r["config"], r["metric"]): r for r in montecarlo.experiment(draws, 40).collect()}
    assert {k[0] for k in got} == {"fold_01", "fold_02", "fold_03", "dev_pooled", "validation"} and len(got) == 5 * 5 * 10
    assert got["dev_pooled", "B1", "ece"]["draws"] == 120 and got["fold_03", "B0", "ece"]["draws"] == 20
    per = baselines.draw_scores(baselines.scores(draws)).where("t > 500 and t <= 550").toPandas()
    idx = montecarlo.np.random.default_rng(montecarlo.SEED).integers(0, 50, size=(40, 5))
    idx = ((idx[:, :, None] + np.arange(10)) % 50).reshape(40, 50)
    by = {c: x.sort_values("t") for c, x in per.groupby("config")}
    for c in ("B1", "B2_w50"):
        loss, zero = by[c]["log_loss"].to_numpy(), by["B0"]["log_loss"].to_numpy()
        error = {k: (by[k]["sum_actual"] - by[k]["sum_forecast"]).to_numpy() for k in (c, "B0")}
        rmse = {k: np.sqrt((v[idx] ** 2).mean(axis=1)) for k, v in error.items()}
        expected = {"log_loss": (loss.mean(), loss[idx].mean(axis=1)), "delta_log_loss": ((loss - zero).mean(), (loss - zero)[idx].mean(axis=1)), "mae": (np.abs(error[c]).mean(), np.abs(error[c])[idx].mean(axis=1)),
                    "delta_rmse": (np.sqrt((error[c] ** 2).mean()) - np.sqrt((error["B0"] ** 2).mean()), rmse[c] - rmse["B0"])}
        for metric, (value, reps) in expected.items():
            r = got["fold_01", c, metric]
            assert np.allclose([r["value"], r["lo"], r["hi"]], [value, *np.percentile(reps, [2.5, 97.5])], rtol=0, atol=1e-12), (c, metric)


def test_blocks_in_the_reference(spark):
    rows = {r["name"]: r for r in montecarlo.mc_reference(spark, 120, 60, (50, 200), 30, blocks=3).collect()}
    assert {"stability_number_0-1", "stability_pair_1-2", "max_z_w50", "min_special"} <= set(rows) and "max_z_w200" not in rows
    assert all(r["least"] <= r["lo"] <= r["hi"] <= r["most"] for r in rows.values())


def test_exploratory_p_values_do_not_follow_the_ranges(spark, draws, monkeypatch):
    def ranges(parts):
        def own(session, replicates):
            edges = sorted({replicates * k // parts for k in range(parts + 1)})
            return session.createDataFrame([(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], "first long, count long")

        return own

    found = []
    for parts in (1, 4, 32):
        monkeypatch.setattr(montecarlo, "_ranges", ranges(parts))
        found.append(sorted((r["name"], r["p"], r["replicates"]) for r in montecarlo.exploratory(draws, 70).collect() if r["replicates"]))
    assert found[0] == found[1] == found[2] and {r[2] for r in found[0]} == {70}
    # The published stream: one array of all replicates.
    n = draws.where("special_number is not null").count()
    ranks = montecarlo.generator(montecarlo.SEED, montecarlo.RANKS).integers(1, 50, size=(70, n))
    seen = {r["name"]: r["statistic"] for r in montecarlo.exploratory(draws, 70).collect()}["special_rank"]
    e = n / 49
    more = sum(float(((np.bincount(x, minlength=50)[1:] - e) ** 2 / e).sum()) >= seen for x in ranks)
    assert dict((a, b) for a, b, _ in found[0])["special_rank"] == (1 + more) / 71


def test_large_tables_of_a_publication(spark, tmp_path):
    df = spark.range(1000).selectExpr("id AS a", "id / 3 AS b").repartition(5)
    assert publish.is_small(df, 1000) and not publish.is_small(df, 999)
    about = publish.publish(str(tmp_path / "out"), {"x.md": "text"}, {"n": 1}, large={"t.csv": (df, ["a"])})
    parts = sorted(k for k in about["files"] if k.startswith("t.csv/"))
    assert parts and all(hashlib.sha256((tmp_path / "out" / k).read_bytes()).hexdigest() == about["files"][k]["sha256"] for k in parts)
    lines = [x for k in parts for x in (tmp_path / "out" / k).read_text().splitlines()[1:]]
    assert [int(x.split(",")[0]) for x in lines] == list(range(1000))
