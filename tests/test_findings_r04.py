"""What the fourth round found: a query that read a part of its table, rules on a stream that took a call a draw, texts that weren't compared."""

import os
from datetime import date, datetime, timedelta

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from subsetlab.llm import near_copies
from subsetlab.model import MAIN
from subsetlab.operators import infer
from subsetlab.plans import catalog, montecarlo
from subsetlab.streaming import rules
from tests.test_streams_and_joins import RECORD, record, streamed

SF = "/root/testdata/sf0.01"


def test_exploratory_p_reads_the_whole_table(spark):
    queries = catalog.queries()
    whole = {r["name"]: (r["statistic"], r["df"]) for r in queries["exploratory"](spark, SF).collect()}
    got = {r["name"]: r for r in queries["exploratory_p"](spark, SF).collect()}
    assert {k: (r["statistic"], r["df"]) for k, r in got.items()} == whole
    assert {r["replicates"] for r in got.values()} == {None, 200} and all(0 < r["p"] <= 1 for r in got.values())


def test_replicates_in_blocks_are_the_published_ones(spark, monkeypatch):
    monkeypatch.setattr(montecarlo, "BLOCK", 64)
    seed, n, special = montecarlo.SEED, 500, 333
    main, _ = montecarlo.simulate(montecarlo.generator(seed, montecarlo.BINS), 3, n)
    whole = montecarlo.generator(seed, montecarlo.RANKS).integers(1, 50, size=(3, special))
    rng = montecarlo.generator(seed, montecarlo.RANKS)
    for k in range(3):
        sums = montecarlo.sum_counts(seed, montecarlo.BINS, k, n)
        assert (sums == np.bincount(main[k].astype(int).sum(axis=1), minlength=len(sums))).all()
        assert (montecarlo.rank_counts(rng, special) == np.bincount(whole[k] - 1, minlength=49)).all()
    rows = [(t + 1, f"{t + 1:05d}", *map(int, main[0, t]), int(t % 55) + 1 if t < special else None) for t in range(n)]
    draws = spark.createDataFrame(rows, "t long, draw_id string, " + ", ".join(f"{c} long" for c in MAIN) + ", special_number long").withColumn("draw_date", F.lit("2020-01-01").cast("date"))
    seen = {r["name"]: r for r in montecarlo.exploratory(draws, 3).collect()}
    bins = infer.sum_bins(n)
    edges, expected = [a for a, _, _ in bins], n * np.array([p for *_, p in bins])
    found = [np.bincount(np.searchsorted(edges, main[k].astype(int).sum(axis=1), side="right") - 1, minlength=len(edges)) for k in range(3)]
    more = sum(((o - expected) ** 2 / expected).sum() >= seen["sum_bins"]["statistic"] - 1e-9 for o in found)
    assert seen["sum_bins"]["p"] == (1 + more) / 4


def test_equal_chances_are_ordered(monkeypatch):
    class Same:
        def random(self, shape):
            return np.tile(np.repeat(np.arange(11.0), 5), (shape[0], 1))

    monkeypatch.setattr(montecarlo, "generator", lambda *a: Same())
    counts = montecarlo.sum_counts(1, 2, 0, 3)
    assert counts.sum() == 3 and 21 <= counts.argmax() <= 315


def test_draws_share_their_state(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    at = datetime(2024, 1, 2, 10)
    rows = [record(source, f"{i:05d}", date(2024, 1, 2), 9, at) for source in ("a", "b") for i in range(3000)]
    spark.createDataFrame(rows, RECORD).write.mode("append").parquet(str(tmp_path / "in"))
    found = rules.first_versions(spark.readStream.schema(RECORD).parquet(str(tmp_path / "in")))
    query = rules.run(found, str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6000
    # A shelf holds a thousand ids; a value for each draw took a call for each.
    assert sum(s.numRowsTotal for s in query.lastProgress.stateOperators) == 6


def test_many_versions_and_odd_ids(spark, tmp_path):
    day, at = date(2024, 1, 2), datetime(2024, 1, 2, 10)
    ids = [None, "", "1", "ab", 'x",[\\', "a,b\nc", "00001", "000010", "\u00e9\u4e16\U0001f600z", "x" * 50]
    portions = [[record("a", k, day, v, at + timedelta(minutes=10 * p + v % 7)) for k in ids for v in range(10 * p, 10 * p + 25)] for p in range(4)]
    portions[2].append(record("a", "00001", day, None, None))
    got = streamed(spark, str(tmp_path / "many"), portions, rules.first_versions)
    # Versions 0 to 54 of each id, each once, and one without a receipt.
    assert len(got) == 55 * len(ids) + 1
    for k in ids:
        own = [r for r in got if r[1] == k]
        assert sorted(r[-1] for r in own if r[-1] is not None) == list(range(55))
        (first,) = (r for r in own if r[2] is None)
        assert (first[-1], first[3], first[4]) == (0, None, None) and first[6:13] == (day, 1, 2, 3, 4, 5, 6)
        assert {r[4] for r in own if r[2]} == {f"special_number: 0 > {v}" for v in range(1, 55)} | ({"special_number: 0 > <NA>"} if k == "00001" else set())
    assert [(r[1], r[5]) for r in got if r[-1] is None] == [("00001", None)]


@pytest.mark.parametrize("middle", [(" one two three four five", " six seven eight nine te"), ("onetwothreefourfivesixse", "veneightnineteneleventwe")])
def test_texts_that_share_a_hash_are_compared(spark, middle):
    """Built texts with one XXH64; those of the second kind are a single shingle each, so that shingles share it too."""
    a, b = middle
    texts = [f"mnty dvy{a}giwl vgk{b}", f"osor rwf{a}*+tj!.j;{b}"]
    assert xxhash.xxh64_intdigest(texts[0].encode(), 42) == xxhash.xxh64_intdigest(texts[1].encode(), 42)
    rows = list(enumerate([*texts, "another text", texts[1], texts[0].upper()]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, 5, 4, 3, 8).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 1, 4: 0}
