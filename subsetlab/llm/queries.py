"""The queries of this subpackage: each applies its operator with production parameters to a whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsetlab.llm import (
    ann, bpe, byte_bpe, packing, phrases, quality, resample, secret_scan, shared, simhash, substring_dedup, suffix_dedup, token_files, url_filter,
)
from subsetlab.session import ship

Query = Callable[[SparkSession, str], DataFrame]
#: Tokens in a packed sequence.
CAPACITY = 2048


def vocabulary() -> str:
    """Return the path of the vocabulary file; SUBSETLAB_VOCABULARY names another one."""
    own = os.environ.get("SUBSETLAB_VOCABULARY")
    if own:
        return own
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_vocabulary() -> tuple[str, str]:
    """Return the path of the file of ranks, which SUBSETLAB_RANKS may name, and the pattern that splits texts."""
    import public_tokenizers

    return os.environ.get("SUBSETLAB_RANKS") or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.token_pieces(docs, vocabulary(), CAPACITY, end_id=0), CAPACITY)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.fresh_dir(spark, "tokens")
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary(), end_id=1)
    return token_files.read_token_files(manifest)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=50)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in range(3)]
    counts = [(F.size("found") - n).cast("long").alias(f"n_{x}") for n, x in zip(counts, secret_scan.KINDS, strict=False)]
    base = F.filter("found", lambda s: s["kind"] < 3)
    digest = F.sha2(secret_scan.listed(base), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secret_scan.listed(F.col("found")).alias("spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


#: Rules of host and path, by what they say.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled through the document of its number: bad if that is toxic or of low quality."""
    labels = table(spark, sf_dir, "labels")
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad")
    judged = url_filter.judge(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=13)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words_in_shingle=4, radius=4)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10_000, 10, 20, 1, 2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = byte_vocabulary()
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, pattern)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents"), least=30, percent=80, most=2000)


def queries() -> dict[str, Query]:
    return {
        "op1_pack": op1_pack,
        "op2_token_files": op2_token_files,
        "op3_bpe": op3_bpe,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_secret_scan": op5_secret_scan,
        "op6_quality": op6_quality,
        "op7_url_filter": op7_url_filter,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_nearest": op9_nearest,
        "op10_simhash": op10_simhash,
        "op11_resample": op11_resample,
        "op12_byte_bpe": op12_byte_bpe,
        "op13_phrases": op13_phrases,
    }


#: The bytes of every text in portions, the 50-byte strings that start in them, and what they cover.
OP4_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
c AS (SELECT r, doc_id, j * 512 AS base, hex(array_slice(b, j * 512 + 1, j * 512 + 561)) AS h, octet_length(b) AS n FROM (SELECT *, unnest(range(0, (octet_length(b) + 511) // 512)) AS j FROM d)),
o AS (SELECT r, doc_id, base + i AS i, substr(h, 2 * i + 1, 100) AS win, substr(h, 2 * i + 1, 2) AS x FROM (SELECT *, unnest(range(0, least(512, n - base))) AS i FROM c)),
f AS (SELECT r, x, i, CASE WHEN length(win) = 100 AND min(doc_id) OVER (PARTITION BY win) < doc_id THEN 1 ELSE 0 END AS dup FROM o),
g AS (SELECT r, x, i, max(dup) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS away FROM f),
e AS (SELECT r, x, i, away, lag(away, 1, 0) OVER (PARTITION BY r ORDER BY i) AS before FROM g),
s AS (SELECT r, sum(away) AS c, count(*) FILTER (WHERE away = 1 AND before = 0) AS spans, coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE away = 0), '') AS kept FROM e GROUP BY 1)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(c, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS_SQL} AS w FROM documents),
o AS (SELECT r, doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT r, doc_id, x, i, count(*) OVER ahead AS m, string_agg(x, ' ') OVER ahead AS win FROM o WINDOW ahead AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
f AS (SELECT r, x, i, CASE WHEN m = 13 AND min(doc_id) OVER (PARTITION BY win) < doc_id THEN 1 ELSE 0 END AS dup FROM k),
g AS (SELECT r, x, i, max(dup) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS away FROM f),
s AS (SELECT r, count(*) AS n, sum(away) AS c, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE away = 0), '') AS kept FROM g GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(c, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""


def op6_sql() -> str:
    """Return the quality rules in SQL: n-grams as joined words, repeats by their number in a text."""
    sizes = list(quality.SHARES)
    frame = "PARTITION BY r ORDER BY i ROWS BETWEEN"
    grams = ", ".join(f"CASE WHEN count(*) OVER ({frame} CURRENT ROW AND {n - 1} FOLLOWING) = {n} THEN string_agg(x, ' ') OVER ({frame} CURRENT ROW AND {n - 1} FOLLOWING) END AS g{n}" for n in sizes)
    again = ", ".join(f"CAST(g{n} IS NOT NULL AND row_number() OVER (PARTITION BY r, g{n} ORDER BY i) > 1 AS INT) AS a{n}" for n in sizes)
    cover = ", ".join(f"max(a{n}) OVER ({frame} {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in sizes)
    shares = ", ".join(f"coalesce(CAST(sum(length(x)) FILTER (WHERE c{n} = 1) AS DOUBLE), 0) / sum(length(x)) AS share_{n}" for n in sizes)
    out = ", ".join(f"coalesce(share_{n}, 0) AS share_{n}" for n in sizes)
    bad = " OR ".join(f"share_{n} > {most}e0" for n, most in quality.SHARES.items())
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
o AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT r, x, i, {grams} FROM o),
f AS (SELECT r, x, i, CAST(g5 IS NOT NULL AND count(*) OVER (PARTITION BY r, g5) > 1 AS INT) AS b5, {again} FROM k),
g AS (SELECT r, x, i, max(b5) OVER ({frame} 4 PRECEDING AND CURRENT ROW) AS repeat, {cover} FROM f),
s AS (SELECT r, count(*) AS n, CAST(sum(length(x)) AS BIGINT) AS chars, CAST(sum(repeat) AS BIGINT) AS repeats, {shares} FROM g GROUP BY 1),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
m AS (SELECT r, len(lines) - len(list_distinct(lines)) AS dup, CASE WHEN len(lines) > len(list_distinct(lines)) THEN 1 - CAST(list_sum(list_transform(list_distinct(lines), lambda x: length(x))) AS DOUBLE) / list_sum(list_transform(lines, lambda x: length(x))) ELSE 0 END AS line_share FROM l),
v AS (SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(chars, 0) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, coalesce(repeats, 0) AS n_repeat_words, CAST(line_share AS DOUBLE) AS line_share, {out} FROM d LEFT JOIN s USING (r) LEFT JOIN m USING (r))
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR line_share > {quality.LINE_SHARE}e0 OR {bad}) AS kept FROM v
"""


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of each feature by a table of 256 values, then buckets, gains, noise and ranks.
OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT r, unnest(w) AS x FROM d),
b AS (SELECT unnest(regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS x FROM benchmark),
u AS (SELECT x, sum(s) AS s, sum(t) AS t FROM (SELECT x, count(*) AS s, 0 AS t FROM o GROUP BY 1 UNION ALL SELECT x, 0, count(*) FROM b GROUP BY 1) GROUP BY 1),
y(v, c, i) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM y WHERE i < 8),
h(x, s, t, h, i, c) AS (SELECT x, s, t, hex(encode(x)), 0, 4294967295 FROM u UNION ALL SELECT x, s, t, h, h.i + 1, xor(h.c >> 8, y.c) FROM h JOIN y ON y.i = 8 AND y.v = xor(h.c, CAST('0x' || substr(h, 2 * h.i + 1, 2) AS BIGINT)) & 255 WHERE 2 * h.i < length(h)),
c AS (SELECT x, s, t, xor(c, 4294967295) % 10000 AS k FROM h WHERE 2 * i = length(h)),
k AS (SELECT k, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM c GROUP BY 1),
g AS (SELECT k, CAST(floor(1000 * ln((t + 1) * ((SELECT CAST(sum(s) AS DOUBLE) FROM u) + 10000) / ((s + 1) * ((SELECT CAST(sum(t) AS DOUBLE) FROM u) + 10000)))) AS BIGINT) AS gain FROM k),
m AS (SELECT r, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM o JOIN c USING (x) JOIN g USING (k) GROUP BY 1),
v AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (r)),
e AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM v),
f AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM e WHERE n_features >= 20) // 100 THEN place END AS rank FROM f
"""
#: All runs of one to four words of pieces, their cuts, and those inside longer ones.
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, string_split_regex({LOWER_SQL}, '[.,;:!?\\x0A-\\x0D]') AS p FROM documents),
q AS (SELECT r, lang, unnest(p) AS p, unnest(range(len(p))) AS j FROM d),
w AS (SELECT r, lang, j, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM q),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
a AS (SELECT lang, w[i : i + m - 1] AS g, count(*) AS f FROM s, (SELECT unnest(range(1, 5)) AS m) WHERE i + m - 1 <= len(w) GROUP BY 1, 2 HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
c AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM a WHERE len(g) > 1),
l AS (SELECT c.*, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score FROM c JOIN a x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN a y ON y.lang = c.lang AND y.g = c.g[k + 1 : len(c.g)]),
b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
z AS (SELECT lang, g[i : i + m - 1] AS g, max(f) AS longer FROM (SELECT lang, g, f, m, unnest(range(1, len(g) - m + 2)) AS i FROM a, (SELECT unnest([2, 3]) AS m) WHERE m < len(g)) GROUP BY 1, 2),
t AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN z ON z.lang = b.lang AND z.g = b.g WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
f AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
SELECT f.lang, rank, phrase, a, l, r, n, score FROM f JOIN n ON n.lang = f.lang WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express: it has no tokenizer, no XXH64, and none of the methods' own judgements."""
    return {"op4_suffix_dedup": OP4_SQL, "op6_quality": op6_sql(), "op8_substring_dedup": OP8_SQL, "op11_resample": OP11_SQL, "op13_phrases": OP13_SQL}
