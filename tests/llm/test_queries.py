"""The registered queries with their production parameters on the small tables, against brute force or DuckDB."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from subsetlab.llm import queries
from tests.llm.test_filters_and_search import base_spans
from tests.llm.test_text_operators import fingerprint, groups

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def texts():
    rows = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = tokenizers.Tokenizer.from_file(queries.vocabulary())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in texts.items()}


def run(spark, name):
    return queries.queries()[name](spark, FOLDER).collect()


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4"))


def test_op1(spark, ids):
    got = run(spark, "op1_pack")
    expected = {(d, k // 2048, k, len(x[k : k + 2048]), crc(x[k : k + 2048])) for d, own in ids.items() for x in [[*own, 0]] for k in range(0, len(x), 2048)}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == expected and len(got) == len(expected)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [a for a, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist() and sum(n for _, n in own) <= 2048
    assert len(bins) <= 1.02 * sum(r["length"] for r in got) / 2048 + 1


def test_op2_and_op3(spark, ids):
    start = 0
    for r, d in zip(sorted(run(spark, "op2_token_files"), key=lambda r: r["doc_id"]), sorted(ids), strict=True):
        own = [*ids[d], 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(own), crc(own))
        start += len(own)
    tokenizer = tokenizers.Tokenizer.from_file(queries.vocabulary())
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op3_bpe")}
    assert got == {d: (len(x), digest(" ".join(map(str, x))), digest(tokenizer.decode(x, skip_special_tokens=False))) for d, x in ids.items()}


@pytest.mark.parametrize("name", ["op4_suffix_dedup", "op6_quality", "op8_substring_dedup", "op11_resample"])
def test_queries_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    answer = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    expected = {r[names.index("doc_id")]: dict(zip(names, r, strict=True)) for r in answer.fetchall()}
    got = {r["doc_id"]: r.asDict() for r in run(spark, name)}
    assert set(got) == set(expected)
    for d, own in got.items():
        assert set(own) == set(names)
        assert all(own[k] == pytest.approx(expected[d][k], abs=1e-12) for k in own), d


def test_op13(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    answer = con.execute(queries.oracle_sql()["op13_phrases"])
    names = [c[0] for c in answer.description]
    got = queries.queries()["op13_phrases"](spark, FOLDER)
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == sorted(answer.fetchall())


def test_op5(spark, texts):
    kinds = ("assign", "access", "hex")
    for r in run(spark, "op5_secret_scan"):
        base = base_spans(texts[r["doc_id"]])
        listed = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[1] == i for x in base) for i in range(3)]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == [s for s in listed.split(",") if s]


def test_op7(spark):
    pages = {r["page_id"]: r["url"] for r in pq.read_table(f"{FOLDER}/pages.parquet", columns=["page_id", "url"]).to_pylist()}
    got = run(spark, "op7_url_filter")
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", pages[r["page_id"]] or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [x for x in queries.URL_RULES for own, _, tail in [x.partition("/")] if (host == own or host.endswith("." + own)) and path.startswith("/" + tail)]
        rule = max(fits, key=len, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == queries.URL_RULES[rule] if rule else r["verdict"] in ("allow", "block")


def test_op9(spark):
    rows = pq.read_table(f"{FOLDER}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pylist()
    good = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64)) for r in rows if r["embedding"] and None not in r["embedding"]]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    x, names = np.stack([v for _, v in good]), np.array([i for i, _ in good])
    got = collections.defaultdict(list)
    for r in sorted(run(spark, "op9_nearest"), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == sorted(i for i in names.tolist() if i % 100 == 0)
    hits = 0
    for q, own in got.items():
        far = np.sqrt(((x - x[names == q][0]) ** 2).sum(axis=1))
        order = [i for i in names[np.lexsort((names, far))].tolist() if i != q][:10]
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(abs(far[names == i][0] - s) < 1e-12 for _, i, s in own)
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        hits += len(set(order) & {i for _, i, _ in own})
    assert hits >= 0.9 * 10 * len(got)


def test_op10(spark, texts):
    names = list(texts)
    prints = [fingerprint(texts[d], 4) for d in names]
    least = {}
    roots = groups(prints, 4)
    for d, r in zip(names, roots, strict=True):
        least[r] = min(least.get(r, d), d)
    expected = {d: (f"{p:016x}", least[r]) for d, p, r in zip(names, prints, roots, strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op10_simhash")} == expected
