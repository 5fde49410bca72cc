"""Packing, token files, BPE, span removal, SimHash: against brute-force versions on small and awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from subsetlab.llm import anchors, bpe, packing, quality, queries, shared, simhash, substring_dedup, suffix_dedup, token_files
from subsetlab.llm.components import components
from subsetlab.llm.elias_fano import EliasFano
from subsetlab.llm.wordbpe import PieceEncoder, library_encoder
from subsetlab.llm.words import split_words

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, bucket string, row int, fp string, length int"
AWKWARD = [
    None, "", " \n\t", "a", "the " * 3000, "x" * 20000, "a<|endoftext|>b. X", "ΑΣ ΣΑΣ. İstanbul", "Don't I'LL we're,", "ab1,.2 .. !!!",
    "한국어 日本語。 😀😀, ﬁ", "x\x1cy z w q", "éa ́x", "\x00a \x00", "ªº. Æ, ÿ. ŸŽ. µ.",
]


@pytest.fixture(scope="module")
def path():
    return queries.vocabulary()


@pytest.fixture(scope="module")
def tokenizer(path):
    return tokenizers.Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward texts, repeated rows, ties in doc_id, a null doc_id, and further columns whose names clash with inner ones."""
    rng = random.Random(3)
    texts = AWKWARD + ["".join(rng.choice("abc de.F\n") for _ in range(rng.randint(0, 400))) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "a"), (3, "another"), (None, "no id at all")]
    return spark.createDataFrame([(d, t, "x", 1, "y", 2) for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def by_key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_pack(docs, empty, path, tokenizer):
    out = packing.pack(packing.token_pieces(docs, path, 64, end_id=0, with_ids=True), 64)
    got = out.collect()
    expected = []
    for d, t in rows_of(docs):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        expected += [(d, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64])) for k in range(0, len(ids), 64)]
    assert by_key([tuple(r)[:5] for r in got]) == by_key(expected)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 64
    total = sum(r["length"] for r in got)
    assert len(places) <= 1.1 * total / 64 + 2
    whole = packing.sequences(out).collect()
    assert sum(len(r["ids"]) for r in whole) == total and len(whole) == len(places)
    assert packing.pack(packing.token_pieces(empty, path, 64, end_id=0), 64).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 60))
    histogram = {int(k): int(rng.integers(1, 30)) for k in rng.integers(1, capacity + 1, rng.integers(1, 30))}
    bins, placed = {}, set()
    for length, rank, count, first, per_bin, offset in packing.plan(histogram, capacity).itertuples(index=False):
        for i in range(count):
            bins.setdefault(first + i // per_bin, []).append((offset + i % per_bin * length, length))
            placed.add((length, rank + i))
    assert placed == {(k, i) for k, n in histogram.items() for i in range(n)}
    for own in bins.values():
        own.sort()
        assert all(a == sum(n for _, n in own[:k]) for k, (a, _) in enumerate(own))
        assert sum(n for _, n in own) <= capacity
        assert sum(3 * n > capacity for _, n in own) <= 2
    assert packing.plan({}, capacity).empty
    with pytest.raises(ValueError):
        packing.plan({capacity + 1: 1}, capacity)


@pytest.mark.parametrize("seed", range(10))
def test_elias_fano(seed):
    rng = np.random.default_rng(seed)
    values = np.sort(rng.integers(0, 10 ** (seed + 1), rng.integers(0, 900)))
    coded = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
    assert coded.all().tolist() == values.tolist() == [coded.select(i) for i in range(len(values))]
    if len(values):
        bits = 8 * (len(coded.low) + len(coded.high))
        assert bits <= len(values) * (3 + max(0, np.log2(values[-1] / len(values) + 1))) + 16
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1]))
    with pytest.raises(IndexError):
        coded.select(len(values))


def test_token_files(spark, docs, empty, path, tokenizer):
    manifest = token_files.write_token_files(docs, shared.fresh_dir(spark, "t"), path, end_id=1)
    got = token_files.read_token_files(manifest, with_ids=True).orderBy("start").collect()
    source = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1]))
    start = 0
    for (d, t), r in zip(source, got, strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (d, start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4"))
        start += len(ids)
    one = manifest.orderBy("shard").first()
    shard = token_files.Shard(one["path"])
    assert len(shard) == one["n_docs"]
    assert [(shard.doc_id(i), shard.document(i).tolist()) for i in range(len(shard))] == [(r["doc_id"], r["ids"]) for r in got[: len(shard)]]
    none = token_files.write_token_files(empty, shared.fresh_dir(spark, "t"), path, end_id=1)
    assert token_files.read_token_files(none).collect() == []


def test_bpe(docs, empty, path, tokenizer):
    got = by_key([tuple(r)[:4] for r in bpe.encode_decode(docs, path, with_text=True).collect()])
    expected = []
    for d, t in rows_of(docs):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        expected.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == by_key(expected)
    assert bpe.encode_decode(empty, path).collect() == []


def test_backtracking_equals_merging(path, tokenizer):
    rng = random.Random(1)
    names = [x.replace("</w>", "") for x in sorted(tokenizer.get_vocab())]
    texts = ["".join(rng.choice(names) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    texts += ["".join(rng.choice("aaabcdeeeinstohr") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    for encoder in (bpe.codec(path).encoder, library_encoder(path)):
        ids, count = encoder.encode([x.encode() for x in texts])
        at = 0
        for text, n in zip(texts, count.tolist(), strict=True):
            assert ids[at : at + n].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
            at += n


def passages(seed, n=110):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 200))) for _ in range(6)]
    out = [(None, base[0] * 3), (None, None)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.2:
            text = rng.choice(base)
        elif kind < 0.5:
            text = "".join(rng.choice(base)[rng.randint(0, 50) : rng.randint(20, 200)] for _ in range(3))
        elif kind < 0.6:
            text = "ab " * rng.randint(0, 80)
        elif kind < 0.7:
            text = None if rng.random() < 0.5 else ""
        else:
            text = "".join(rng.choice("abcdefgh \n") for _ in range(rng.randint(0, 300)))
        out.append((i if rng.random() < 0.9 else rng.randint(0, n), text))
    return out + out[-5:]


def covered(rows, split, window):
    """Yield doc_id, units, and whether each unit goes, by looking at every window."""
    rows = [(d, split((t or "").encode())) for d, t in rows]
    first = {}
    for d, units in rows:
        for i in range(len(units) - window + 1 if d is not None else 0):
            key = tuple(units[i : i + window])
            first[key] = min(first.get(key, d), d)
    for d, units in rows:
        gone = [False] * len(units)
        for i in range(len(units) - window + 1 if d is not None else 0):
            if first[tuple(units[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        yield d, units, gone


@pytest.mark.parametrize(("window", "hot", "seed", "relay", "few"), [(50, 4096, 1, 256, 8), (50, 4096, 1, 2, 1), (50, 3, 2, 1, 8), (12, 2, 3, 256, 1), (12, 4096, 3, 2, 2)])
def test_suffix_dedup(spark, empty, monkeypatch, window, hot, seed, relay, few):
    monkeypatch.setattr(anchors, "HOT", hot)
    monkeypatch.setattr(anchors, "RELAY", relay)
    monkeypatch.setattr(anchors, "AT_ONCE", 1 << 11 if relay == 2 else 1 << 19)
    monkeypatch.setattr(anchors, "GATHERED", 50 if few == 1 else 1 << 18)
    monkeypatch.setattr(suffix_dedup, "FEW", few)
    rows = passages(seed)
    docs = spark.createDataFrame([(d, t, "b", 1, "f", 0) for d, t in rows], SCHEMA).repartition(3)
    got = suffix_dedup.remove_repeats(docs, window, with_text=True, carry=["bucket", "length"]).collect()
    expected = []
    for d, units, gone in covered(rows, list, window):
        kept = bytes(u for u, g in zip(units, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        expected.append((d, len(units), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    assert by_key([tuple(r)[:5] for r in got]) == by_key(expected)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and r["rest"]["bucket"] == "b" for r in got)
    assert suffix_dedup.remove_repeats(empty, window).collect() == []


@pytest.mark.parametrize(("window", "hot", "seed", "relay"), [(13, 4096, 4, 256), (13, 3, 5, 2), (5, 2, 6, 1)])
def test_substring_dedup(spark, empty, monkeypatch, window, hot, seed, relay):
    monkeypatch.setattr(anchors, "HOT", hot)
    monkeypatch.setattr(anchors, "RELAY", relay)
    monkeypatch.setattr(anchors, "AT_ONCE", 1 << 11 if relay == 2 else 1 << 19)
    monkeypatch.setattr(anchors, "GATHERED", 50 if relay == 2 else 1 << 18)
    rows = passages(seed)
    docs = spark.createDataFrame([(d, t, "b", 1, "f", 0) for d, t in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in substring_dedup.remove_repeats(docs, window).collect()]
    expected = []
    for d, units, gone in covered(rows, lambda b: re.findall(rb"[^\x20\x09-\x0D]+", b), window):
        kept = b" ".join(u for u, g in zip(units, gone, strict=True) if not g)
        expected.append((d, len(units), sum(gone), hashlib.sha256(kept).hexdigest()))
    assert by_key(got) == by_key(expected)
    assert substring_dedup.remove_repeats(empty, window).collect() == []


@pytest.mark.parametrize("relay", [256, 1])
def test_two_documents_that_share_a_passage(spark, monkeypatch, relay):
    """Each bucket has blocks to send, and none that is decided on the spot."""
    monkeypatch.setattr(anchors, "RELAY", relay)
    passage = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{chr(97 + i) * 30} {passage} {chr(107 + i) * 20}") for i in range(3)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {0: (0, 0), 1: (len(passage) + 2, 1), 2: (len(passage) + 2, 1)}
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()} == {0: 0, 1: 40, 2: 40}


def test_rows_of_the_exchange_do_not_grow_with_the_square(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "".join(rng.choice("abcdefgh ") for _ in range(9000))) for i in range(600)], "doc_id long, text string").repartition(4)
    counts = {}
    for n in (16, 64):
        rows = docs.withColumn("bucket", (F.col("doc_id") % n).cast("int"))
        for relay in (256, 4):
            routes = anchors.Routes(n)
            routes.width = 1 if relay == 256 else int(n**0.5)
            counts[n, relay] = anchors.offered(rows, suffix_dedup.ByteWindows(50), routes).count()
    assert counts[16, 256] == 16 * 16 and counts[64, 256] == 64 * 64
    assert counts[16, 4] == 16 * 4 and counts[64, 4] == 64 * 8
    assert anchors.Routes(4900).width == 70 and not anchors.Routes(4096).stops


def test_loser_tree():
    rng = random.Random(9)
    runs, everything = [], []
    for _ in range(7):
        own = sorted(bytes(rng.choice(b"ab") for _ in range(9)) for _ in range(rng.randint(0, 40)))
        shared_lengths = [next((k for k in range(9) if i == 0 or own[i][k] != own[i - 1][k]), 9) if i else 0 for i in range(len(own))]
        runs.append((bytes(shared_lengths), b"".join(x[k:] for x, k in zip(own, shared_lengths, strict=True))))
        everything += own
    out = list(suffix_dedup.merge_runs(runs, 9))
    assert [x[2] for x in out] == sorted(everything)
    for (_, _, a, _), (_, _, b, shared_bytes) in zip(out, out[1:], strict=False):
        assert a[:shared_bytes] == b[:shared_bytes] and (shared_bytes == 9 or a[shared_bytes] != b[shared_bytes])
    assert list(suffix_dedup.merge_runs([], 9)) == []


def hashes(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    return [xxhash.xxh64_intdigest(s, 42) for s in shingles]


def fingerprint(text, n):
    h = hashes(text, n)
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(items, radius):
    above = list(range(len(items)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, x in enumerate(items):
        for j in range(i):
            if (x ^ items[j]).bit_count() <= radius:
                above[root(i)] = root(j)
    return [root(i) for i in range(len(items))]


@pytest.mark.parametrize("shard", [20_000, 5])
def test_simhash(spark, docs, empty, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = random.Random(8)
    rows = rows_of(docs)
    rows += [(1000 + i, " ".join(rng.choice("a b c".split()) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    table = spark.createDataFrame([(d, t, "b", 1, "f", 0) for d, t in rows], SCHEMA).repartition(3)
    prints = [fingerprint(t, 4) for _, t in rows]
    roots = groups(prints, 4)
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    expected = [(d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(rows, prints, roots, strict=True)]
    got = [tuple(r) for r in simhash.near_duplicates(table, 4, 4).collect()]
    assert by_key(got) == by_key(expected)
    assert simhash.near_duplicates(empty, 4, 4).collect() == []


def mix(h, k):
    """A hash for the k-th print, by plain integers."""
    if k == 0:
        return h
    h = (h + k * 0x9E3779B97F4A7C15) % 2**64
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
    return h ^ h >> 31


@pytest.mark.parametrize("shard", [20_000, 5])
def test_simhash_with_more_prints(spark, empty, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = random.Random(12)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 50)) for _ in range(60)] for _ in range(8)]
    texts = ["", None, "a b", "a  B"]
    for _ in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = "new" + str(rng.randint(0, 99))
        texts.append(" ".join(words))
    rows = [(rng.randint(0, 10_000), t) for t in texts]

    prints = []
    for _, t in rows:
        h = hashes(t, 5)
        prints.append([sum(1 << b for b in range(64) if 2 * sum(mix(x, k) >> b & 1 for x in h) > len(h)) for k in range(3)])
    above = list(range(len(rows)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if any((x ^ y).bit_count() <= 4 for x, y in zip(prints[i], prints[j], strict=True)):
                above[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    alone = groups([p[0] for p in prints], 4)
    assert len(set(alone)) > len({root(i) for i in range(len(rows))})
    expected = [(d, f"{prints[i][0]:016x}", least[root(i)]) for i, (d, _) in enumerate(rows)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in simhash.near_duplicates(table, 5, 4, prints=3).collect()]
    assert by_key(got) == by_key(expected)
    assert simhash.near_duplicates(empty, 5, 4, prints=3).collect() == []


def test_links_in_clusters(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 50)
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(15)]
    fps = set()
    for _ in range(600):
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 8)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    table = spark.createDataFrame([(0, x - (1 << 64) if x >> 63 else x) for x in fps], "print int, fp long").withColumn("node", F.col("fp"))
    found = {r["node"] % (1 << 64): r["root"] for r in components(simhash.link_fingerprints(table, 4)).collect()}
    a, b = {}, {}
    for x, r in zip(fps, groups(fps, 4), strict=True):
        a.setdefault(r, set()).add(x)
        b.setdefault(found.get(x, f"alone {x}"), set()).add(x)
    assert sorted(map(sorted, a.values())) == sorted(map(sorted, b.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 40), (100, 41), (100, 100), (7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {i: 0 for i in range(31)} | {100: 40, 40: 40, 41: 40, 200: 200, 201: 200}
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def thue_morse(letters):
    """Two words that a polynomial hash modulo 2^64 can't tell apart, whatever its odd base."""
    a, b = "ab"
    while len(a) < letters:
        a, b = a + b, b + a
    return a, b


def test_hashes_of_words():
    a, b = thue_morse(4096)
    texts = [a, b, "x" + a, a[:8], a[:9], b[:8], "\x00", "\x00\x00", a]
    words = split_words([" ".join(texts).encode(), b"", f" {a[:8]}\n{b}".encode()])
    h = words.hashes().tolist()
    assert len(set(h)) == len(set(texts))
    assert h[-2:] == [h[3], h[1]] and h[0] == h[len(texts) - 1]


def test_words_that_share_a_hash(path, tokenizer):
    a, b = "internationalize", "ErZF4ZNfLqbDuNuu"
    assert len(set(split_words([f"{a} {b}".encode()]).hashes().tolist())) == 1
    texts = [a, b, f"{a} {b} {b} {a}", b + ".", a + "."]
    for encoder in (library_encoder(path), bpe.codec(path).encoder):
        ids, count = encoder.encode([x.encode() for x in texts])
        expected = [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
        assert ids.tolist() == sum(expected, []) and count.tolist() == list(map(len, expected))
    measured = quality.measure([" ".join([x, *"cdef", *"ghijk"]).encode() for x in (a, b)] + [" ".join([a, *"cdef", b, *"cdef", "x"]).encode()])
    assert measured["n_repeat_words"].tolist() == [0, 0, 0]


def test_ngrams_that_share_a_hash(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abc", k=rng.randrange(60))).encode() for _ in range(40)]
    expected = quality.measure(texts)
    monkeypatch.setattr(quality, "mixed", lambda h: h % np.uint64(3))
    got = quality.measure(texts)
    assert all((got[k] == expected[k]).all() for k in expected)


def test_a_full_table_of_pieces_is_emptied(path, tokenizer):
    encoder = PieceEncoder(library_encoder(path).encode_all, pieces=3)
    for text in ("one two three four", "five one", "six seven eight one"):
        assert encoder.encode([text.encode()])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("which", ["library", "backtracking"])
def test_very_long_pieces(path, tokenizer, which):
    encoder = (library_encoder(path) if which == "library" else bpe.codec(path).encoder)
    a, b = thue_morse(4096)
    texts = ["7" * 1_100_000, a, b, a + b, "word", "7" * 1_100_000]
    ids, count = encoder.encode([x.encode() for x in texts])
    at = 0
    for text, n in zip(texts, count.tolist(), strict=True):
        assert ids[at : at + n].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        at += n


def test_a_long_piece_through_the_queries(spark, path, tokenizer):
    a, b = thue_morse(4096)
    rows = [(1, "9" * 1_050_000), (2, f"{a} {b} {a}"), (3, f"{b} {a}"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids for d, t in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.encode_decode(docs, path).collect()} == {d: len(x) for d, x in ids.items()}
    sums = {r["doc_id"]: r["n"] for r in packing.pack(packing.token_pieces(docs, path, 2048, end_id=0), 2048).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sums == {d: len(x) + 1 for d, x in ids.items()}
    files = token_files.read_token_files(token_files.write_token_files(docs, shared.fresh_dir(spark, "t"), path, end_id=1)).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in files} == {d: zlib.crc32(np.array([*x, 1], dtype="<u4")) for d, x in ids.items()}


def test_one_doc_id_fills_several_shards(spark, path, monkeypatch):
    rows = [(None, f"text {i}") for i in range(60)] + [(i, "x") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(token_files, "GROUP", 2)
    manifest = token_files.write_token_files(docs, shared.fresh_dir(spark, "t"), path, end_id=1)
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 60 + list(range(20))
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]
    assert manifest.count() >= 3


def test_packing_keeps_columns_of_any_name(spark):
    names = ["length", "salt", "own", "base", "rank", "placed", "place", "row", "sequence_id"]
    pieces = spark.createDataFrame([(5, i, 1, 2, 3, 4, 5, 6, 7) for i in range(30)], ", ".join(f"{c} long" for c in names))
    got = packing.pack(pieces, 12)
    assert got.columns == [*names[:-1], "sequence_id", "offset"]
    assert sorted(r["salt"] for r in got.collect()) == list(range(30)) and got.select("sequence_id").distinct().count() == 15


@pytest.mark.parametrize("rows", [7, 150, 10**6])
def test_joins_with_hot_keys(spark, monkeypatch, rows):
    monkeypatch.setattr(shared, "ROWS", rows)
    monkeypatch.setattr(shared, "LEAST_ROWS", 1)
    monkeypatch.setattr(shared, "SHARE", 1)
    many = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(300)], "i long, k long")
    one = spark.createDataFrame([(k, f"v{k}") for k in range(300)], "k long, v string")
    got = shared.spread_join(many, one, ["k"])
    assert sorted(tuple(r) for r in got.select("i", "k", "v").collect()) == sorted((i, 0 if i % 3 else i, f"v{0 if i % 3 else i}") for i in range(300))
    assert shared.spread_join(many.limit(0), one, ["k"]).collect() == []


def test_parts_follow_the_rows_of_a_key():
    assert shared.part_rows(0) == shared.part_rows(1000) == shared.LEAST_ROWS
    assert shared.part_rows(10**6) == 1000 and shared.part_rows(10**10) == shared.ROWS
    assert all(total / shared.part_rows(total) <= shared.KEYS for total in (10**4, 10**8, 10**12, 10**14))
