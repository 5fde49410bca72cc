"""Importance resampling to a target distribution, by a dictionary of distinct features.

Features are runs of words. Their strings are counted over both corpora, each different string is hashed once, buckets
are summed up, and every string gets its bucket's gain; gains then come back to the documents' counts of features through
the dictionaries of blocks (``blocks``). A draw without replacement takes the highest scores, weight and Gumbel noise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subsetlab.llm.blocks import LOWER, answered, lists, make_blocks, packed, unpacked, with_entries
from subsetlab.llm.shared import cut, cut_table, give_back, text_bytes
from subsetlab.llm.words import split_words

#: Bytes that part words: ASCII but lower-case letters and digits.
PARTS = np.zeros(256, bool)
PARTS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

BLOCKS = (
    "block long, at int, feature binary, n long, doc_ids array<long>, n_words array<long>, n_features array<long>, different array<long>, "
    "codes binary, times binary"
)


def runs_of(texts: list[bytes], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Return the document and the feature of each run of 1 to ``longest`` words, the words by document, and the features."""
    words = split_words([x.translate(LOWER) for x in texts], PARTS)
    code, names = words.codes()
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(words.first))
    docs, codes = [doc], [code]
    for n in range(2, longest + 1):
        inside = np.flatnonzero(doc[n - 1 :] == doc[: max(0, len(doc) - n + 1)])
        rows = np.stack([code[inside + k] for k in range(n)])
        every, place = np.unique(rows, axis=1, return_inverse=True) if len(inside) else (rows, inside)
        docs.append(doc[inside])
        codes.append(np.asarray(place).reshape(-1) + len(names))
        names = names + [b" ".join(names[i] for i in own) for own in every.T.tolist()]
    return np.concatenate(docs), np.concatenate(codes), np.diff(words.first), names


def feature_blocks(docs: DataFrame, longest: int) -> DataFrame:
    """Return BLOCKS of ``docs`` (doc_id, text): by document the numbers of its different features and how often each is there."""

    def work(number: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, code, words, names = runs_of(text_bytes(batch.column(1)), longest)
        n, size = batch.num_rows, max(len(names), 1)
        both, times = np.unique(doc * np.int64(size) + code, return_counts=True)
        every = lambda x: pa.array([x], pa.list_(pa.int64()))
        block = {
            "doc_ids": every(batch.column(0).to_pylist()), "n_words": every(words), "n_features": every(np.bincount(doc, minlength=n)),
            "different": every(np.bincount(both // size, minlength=n)), "codes": pa.array([packed(both % size, rising=True)]), "times": pa.array([packed(times)]),
        }
        return with_entries(number, {"feature": pa.array(names, pa.binary()), "n": pa.array(np.bincount(code, minlength=len(names)))}, block)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return make_blocks(rows, work, BLOCKS, "features")


def entries(blocks: DataFrame) -> DataFrame:
    """Return block, at, feature and n of the dictionaries of ``blocks``."""
    return blocks.where("at >= 0").select("block", "at", "feature", "n")


def gains(features: DataFrame, buckets: int) -> DataFrame:
    """Return bucket and gain from ``features`` (bucket, s, t): at most ``buckets`` rows."""
    sums = features.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s_all"), F.coalesce(F.sum("t"), F.lit(0)).alias("t_all"))
    double = lambda c: F.col(c).cast("double")
    ratio = (double("t") + 1) * (double("s_all") + buckets) / ((double("s") + 1) * (double("t_all") + buckets))
    return sums.crossJoin(F.broadcast(every)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(blocks: DataFrame) -> DataFrame:
    """Return doc_id, n_words, n_features and weight (floored mean of gains) of blocks that were ``answered``."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                at, own, words, features, different = lists(batch, row, ["at", "gain", "n_words", "n_features", "different"])
                gain = np.zeros(int(at.max()) + 1, np.int64)
                gain[at] = own
                codes, times = unpacked(batch.column("codes")[row].as_py(), rising=True), unpacked(batch.column("times")[row].as_py())
                total = np.concatenate([[0], np.cumsum(gain[codes] * times)])
                stop = np.cumsum(different)
                total = total[stop] - total[stop - different]
                columns = [batch.column("doc_ids")[row].values, *map(pa.array, (words, features, total // np.maximum(features, 1)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])
            give_back()

    columns = ["doc_ids", "n_words", "n_features", "different", "codes", "times", "at", "gain"]
    return blocks.select(columns).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Return Gumbel noise of a document in thousandths, floored: from a digest of the seed and its doc_id (null: empty)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Add rank: from 1 for the highest scores among the rows of ``least_words`` or more, ``percent`` of them; else null.

    Scores are whole numbers between bounds that the noise and logarithms of counts set (some ten thousands), so the
    counts by score are few; rows are numbered within their score, by doc_id (null last).
    """
    fit = F.col("n_words") >= least_words
    counts = scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = counts.agg(F.sum("n").alias("every"))
    limit = F.expr(f"{percent} * every div 100")
    bases = counts.crossJoin(F.broadcast(every)).select("score", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"), limit.alias("most"))
    taken = F.broadcast(cut(bases.where("base < most")))
    # Stated in the reverse too, so that each row is in one of both parts.
    own = scored.join(taken, "score", "left")
    inside = F.col("base").isNotNull() & fit
    place = F.col("base") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features"))
    some = own.where(inside).withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= F.col("most"), F.col("rank")))
    rest = own.where(~inside).withColumn("rank", F.lit(None).cast("long"))
    return some.unionByName(rest).drop("base", "most")


def resample(
    docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 10, least_words: int = 20, longest: int = 1, seed: int = 2024
) -> DataFrame:
    """Weigh ``docs`` (doc_id, text) by how much likelier ``target`` (text) makes their features, and draw ``percent`` of them.

    Return doc_id, n_words, n_features, weight, score and rank (see ``drawn``), a row for each row of ``docs``. Words are
    lower-cased (A-Z only) runs of letters, digits and non-ASCII characters; features are runs of 1 to ``longest`` words.
    A null or empty text has no feature and weight 0. Equal rows are drawn each for itself; a null doc_id has the noise
    of an empty one. An empty target has no features, an empty ``docs`` gives no rows. Texts of any length are taken
    whole; a worker holds a block, or one longer text. Further columns are left out.
    """
    rows = feature_blocks(docs, longest)
    blocks, own = rows.where("at < 0").drop("at", "feature", "n"), entries(rows)
    wanted = entries(feature_blocks(target.select(F.lit(0).alias("doc_id"), "text"), longest))
    nothing = F.lit(0).cast("long")
    both = own.select("feature", F.col("n").alias("s"), nothing.alias("t"), (nothing + 1).alias("n"))
    both = both.unionByName(wanted.select("feature", nothing.alias("s"), F.col("n").alias("t"), nothing.alias("n")))
    features = both.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("s", "t", "n")])
    features = cut_table(features.withColumn("bucket", F.crc32("feature") % buckets), "dictionary")
    # A row a bucket at most: its size doesn't follow the data.
    gained = features.where("n > 0").join(F.broadcast(gains(features, buckets)), "bucket").select("feature", "gain", "n")
    weighed = weights(answered(blocks, own, gained, ["feature"], features.where("n > 0"), ["gain"]))
    # Blocks without any word have no answer.
    bare = blocks.where(~F.exists("n_features", lambda n: n > 0)).select(F.explode(F.arrays_zip("doc_ids", "n_words", "n_features")).alias("x"))
    bare = bare.select(F.col("x.doc_ids").alias("doc_id"), F.col("x.n_words").alias("n_words"), F.col("x.n_features").alias("n_features"), nothing.alias("weight"))
    scored = weighed.unionByName(bare).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(cut(scored), percent, least_words).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
