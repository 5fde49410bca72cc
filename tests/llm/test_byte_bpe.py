"""Byte-level BPE against the tiktoken library with the same ranks."""

import base64
import hashlib
import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from subsetlab.llm import byte_bpe, queries

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
AWKWARD = [
    None, "", " ", "   \n\n \t x", "a  b   c    ", "don't WE'LL it's'", "x" * 30_000, " " * 5000 + "y", "日本語 テキスト。😀😀", "é a  b   c　d",
    "\u0085   x", "\x1c \x1d a\x00 b", "<|endoftext|> a", "1234567 89,10.11", "-" * 999 + "=" * 77, "à à    à", "﻿a ​ b", "٣٤ ⅷ ½",
]


@pytest.fixture(scope="module")
def expected():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_bpe.codec(RANKS, PATTERN)


def check(own, expected, texts):
    for text, ids in zip(texts, own.encode([x.encode() for x in texts]), strict=True):
        assert ids.tolist() == expected.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
        start, stop = own.offsets(text.encode(), ids)
        assert "".join(own.portions_of_text(ids.tolist())) == text
        joined, places = expected.decode_with_offsets(ids.tolist())
        assert joined == text and start.tolist() == places
        for i, a, b in zip(ids.tolist(), start.tolist(), stop.tolist(), strict=True):
            assert expected.decode_single_token_bytes(i) in text[a:b].encode()


def test_awkward_texts(own, expected):
    check(own, expected, [x or "" for x in AWKWARD])


def test_runs_of_one_character(own, expected):
    check(own, expected, [c * n + end for c in " -=_.*\n\tax0é─" for n in range(1, 140) for end in ("", "b", " ")])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(" ab'\n\t.  é1", max_size=40)), max_size=5))
def test_any_texts(texts):
    own, expected = byte_bpe.codec(RANKS, PATTERN), tiktoken_of()
    check(own, expected, texts)


_known = []


def tiktoken_of():
    if not _known:
        _known.append(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}))
    return _known[0]


def test_runs_of_mixed_letters(own, expected):
    rng = random.Random(11)
    check(own, expected, ["".join(rng.choices("abn-= ", [4, 3, 3, 2, 2, 1], k=rng.randrange(60))) for _ in range(3000)])


def test_split_characters(own):
    ids = own.encode(["a😀b".encode()])[0].tolist()
    parts = own.portions_of_text(ids)
    assert "".join(parts) == "a😀b" and "" in parts
    assert own.portions_of_text(ids[:2])[-1].endswith("�")
    with pytest.raises(ValueError):
        own.portions_of_text([10**6])
    with pytest.raises(ValueError):
        own.portions_of_text([None])


def test_tables(spark, expected):
    rows = [(i if i % 5 else None, x, 1, "n") for i, x in enumerate(AWKWARD)] + [(7, "same", 1, "n")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    got = byte_bpe.encode_decode(docs, RANKS, PATTERN, with_text=True)
    assert byte_bpe.encode_decode(docs.limit(0), RANKS, PATTERN).count() == 0
    found = got.collect()
    line = lambda d, ids, text: (d is None, d or 0, len(ids), tuple(ids), text)
    assert sorted(line(r["doc_id"], r["ids"], r["decoded"]) for r in found) == sorted(line(d, expected.encode_ordinary(t or ""), t or "") for d, t, *_ in rows)
    for r in found:
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
        assert len(r["starts"]) == len(r["ends"]) == r["n_tokens"] and (r["ends"] or [0])[-1] == len(r["decoded"])
    again = byte_bpe.decode_ids(got, RANKS, PATTERN).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["decoded"])
    assert sorted(map(key, again)) == sorted(map(key, found)) and all("".join(r["portions"]) == r["decoded"] for r in again)
    assert byte_bpe.decode_ids(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), RANKS, PATTERN).collect()[0]["decoded"] == ""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")
def test_the_query(spark, expected):
    rows = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {}
    for r in rows:
        ids = expected.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(expected.decode_bytes(ids)).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.queries()["op12_byte_bpe"](spark, FOLDER).collect()}
    assert got == want and np.sum([n for n, *_ in got.values()]) > 1000
