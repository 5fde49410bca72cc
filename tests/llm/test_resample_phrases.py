"""Resampling and phrases against brute force on small and awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from subsetlab.llm import blocks, phrases, resample, shared

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = FEATURE.findall((text or "").translate(LETTERS))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def resampled(docs, target, buckets, percent, least, longest, seed):
    own = [(d, *features(t, longest)) for d, t in docs]
    source, wanted = collections.Counter(), collections.Counter()
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    for _, _, found in own:
        source.update(map(bucket, found))
    for t in target:
        wanted.update(map(bucket, features(t, longest)[1]))
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = lambda k: math.floor(1000 * math.log((wanted[k] + 1) * (s_all + buckets) / ((source[k] + 1) * (t_all + buckets))))
    rows = []
    for d, n, found in own:
        weight = sum(gain(bucket(x)) for x in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    rank = collections.defaultdict(list)
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        rank[r].append(k)
    return sorted([(*r, rank[r].pop(0) if rank[r] else None) for r in sorted(rows, key=str)], key=str)


def some_texts(rng, n):
    words = ["the", "The", "de", "naïve", "日本", "x1", "a", "b", "c", "O'Neil", "42"]
    return [" ".join(rng.choices(words, [9, 1, 5, 2, 1, 2, 3, 3, 3, 1, 1], k=rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize(("longest", "size"), [(1, 1 << 22), (3, 200)])
def test_resample(spark, monkeypatch, longest, size):
    monkeypatch.setattr(blocks.make_blocks, "__defaults__", (size,))
    rng = random.Random(longest)
    texts = [None, "", " .,;", "the " * 3000, "x" * 5000, "A\x00B", *some_texts(rng, 80), *["same words here " * 9] * 5]
    docs = [(None if i % 17 == 3 else i % 60, t) for i, t in enumerate(texts)]
    target = [*some_texts(rng, 9), None, "", "naïve naïve 日本"]
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in docs], "doc_id long, text string, feature string, weight int, n int").repartition(3)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resample.resample(df, wanted, 50, 30, 5, longest, 7)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == resampled(docs, target, 50, 30, 5, longest, 7)


def test_resample_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = docs.limit(0)
    assert resample.resample(none, docs, 10, 50, 1).collect() == []
    rows = resample.resample(docs, none.select("text"), 10, 100, 0).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2]
    bare = spark.createDataFrame([(1, " "), (2, None)], "doc_id long, text string")
    assert [r["weight"] for r in resample.resample(bare, docs, 10, 50, 1).collect()] == [0, 0]


def mined(docs, least, percent, most):
    counts, every = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LETTERS)):
            words = re.findall(r"[^\x20\x09]+", piece)
            every[lang] += len(words)
            counts.update((lang, *words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
    often = {g: f for g, f in counts.items() if f >= least}
    longer = collections.Counter()
    for (lang, *g), f in often.items():
        for n in range(2, len(g)):
            for i in range(len(g) - n + 1):
                key = (lang, *g[i : i + n])
                longer[key] = max(longer[key], f)
    out = collections.defaultdict(list)
    for (lang, *g), a in often.items():
        if len(g) > 1 and not (longer[(lang, *g)] and 100 * longer[(lang, *g)] >= percent * a):
            cuts = [(2_000_000 * a // (l + r), l, r) for k in range(1, len(g)) for l, r in [(often[(lang, *g[:k])], often[(lang, *g[k:])])]]
            score, l, r = min(cuts, key=lambda x: x[0])  # noqa: E741
            out[lang].append((-score, -a, " ".join(g).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, every[lang], -s) for lang, own in out.items() for k, (s, a, p, l, r) in enumerate(sorted(own)[:most], 1))


@pytest.mark.parametrize(("size", "rows", "at_once"), [(1 << 22, 10**6, 1 << 19), (300, 10, 5), (2000, 40, 64)])
def test_phrases(spark, monkeypatch, size, rows, at_once):
    monkeypatch.setattr(blocks.make_blocks, "__defaults__", (size,))
    monkeypatch.setattr(shared, "LEAST_ROWS", 1)
    monkeypatch.setattr(shared, "SHARE", 1)
    monkeypatch.setattr(shared, "ROWS", rows)
    monkeypatch.setattr(phrases, "AT_ONCE", at_once)
    rng = random.Random(size)
    make = lambda: " ".join(rng.choice(["of the", "New York", "new York city", "a", "a", "b.", "c,", "日本 語", "x\ny", "a a", "\x1c", "é!"]) for _ in range(rng.randrange(30)))
    docs = [(rng.choice(["en", "fr", None, "und"]), make()) for _ in range(200)] + [("en", None), ("en", ""), (None, " .\n"), ("fr", "a " * 2000), *[("de", "ein haus am see. der mond")] * 12]
    df = spark.createDataFrame([(lang, t, 1, "z", 3) for lang, t in docs], "lang string, text string, n int, word string, id int").repartition(3)
    for least, percent, most in ((4, 80, 2000), (6, 50, 3)):
        got = phrases.phrases(df, least, percent, most)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == mined(docs, least, percent, most)


def test_phrases_without_rows(spark):
    df = spark.createDataFrame([("en", None), (None, "")], "lang string, text string")
    assert phrases.phrases(df).collect() == phrases.phrases(df.limit(0)).collect() == []


def test_large_counts_are_exact(spark):
    top = 1 << 62
    rows = spark.createDataFrame([([1, 2], top), ([1], top), ([2], top + 12345)], "gram array<int>, f long")
    got = phrases.scored(rows.where("size(gram) = 2"), rows.where("size(gram) = 1")).collect()[0]
    assert got["score"] == 2_000_000 * top // (2 * top + 12345)
    held = spark.createDataFrame([([1, 2], top), ([1, 2, 3], -(-top * 4 // 5)), ([2, 4], top), ([2, 4, 5], -(-top * 4 // 5) - 1)], "gram array<int>, a long")
    assert sorted(r["gram"] for r in phrases.outermost(held, 80).collect()) == [[1, 2, 3], [2, 4], [2, 4, 5]]


@pytest.mark.parametrize("values", [[], [0], [5, -1, 7, 2**31 - 1, 0], list(range(0, 3000, 7))])
def test_packed_numbers(values):
    for rising in (False, True):
        assert blocks.unpacked(blocks.packed(values, rising), rising).tolist() == values
