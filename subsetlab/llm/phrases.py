"""Phrase collocations by pivot partitioning, as in MG-FSM.

Words are ordered by falling frequency. The rarest word of an n-gram (the first of them, if it stands there more than
once) is its pivot. Each occurrence of a word sends the text around it, rewritten: as far as words go that don't come
after it in the order, and as far as an n-gram can reach. Equal fragments of a block are one row with a count. A pivot's
fragments meet in one place, where the n-grams that hold the pivot itself are counted; all others are another pivot's.
So every occurrence of an n-gram is counted once, and no n-gram with an infrequent word is ever made.

Fragments of a frequent pivot are dealt over parts, whose counts are summed up afterwards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subsetlab.llm.blocks import LOWER, answered, counted, lists, make_blocks, packed, unpacked, with_entries
from subsetlab.llm.shared import cut, cut_table, give_back, part_rows, spread_join, text_bytes
from subsetlab.llm.words import split_words
from subsetlab.model import with_ordinal

#: Most words of a phrase: a fragment has REACH words on either side of its pivot.
LONGEST = 4
REACH = LONGEST - 1
#: Bytes that part pieces: . , ; : ! ? and U+000A to U+000D.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
#: Bytes that part words: those, space and tab.
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
#: Language of documents without one.
UNKNOWN = "und"
#: Fragments that a task counts at once, at least.
AT_ONCE = 1 << 19

BLOCKS = "block long, at int, lang string, word binary, n long, codes binary"
FRAGMENTS = "pivot int, part int, a long, b long, c long, n long"
GRAMS = "a long, b long, n long"


def word_blocks(docs: DataFrame) -> DataFrame:
    """Return BLOCKS of ``docs`` (lang, text): codes, the numbers of words in turn and -1 where a piece ends, and the dictionary."""

    def work(number: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words([x.translate(LOWER) for x in text_bytes(batch.column(1))], GAP)
        code, names = words.dictionary()
        langs = batch.column(0).dictionary_encode()
        lang = np.repeat(langs.indices.to_numpy(), np.diff(words.first))
        # A word of two languages is two entries.
        both = lang.astype(np.int64) * len(names) + code
        every, place, times = np.unique(both, return_inverse=True, return_counts=True)
        breaks = np.concatenate([[0], np.cumsum(BREAK[words.data])])[words.start]
        ends = np.flatnonzero(breaks[1:] != breaks[:-1]) + 1
        ends = np.union1d(ends, words.first[(words.first > 0) & (words.first < len(code))])
        n = max(len(names), 1)
        entries = {"lang": langs.dictionary.take(pa.array(every // n)).cast(pa.string()), "word": names.take(pa.array(every % n)).cast(pa.binary()), "n": pa.array(times)}
        return with_entries(number, entries, {"codes": pa.array([packed(np.insert(place.reshape(-1), ends, -1))])})

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    return make_blocks(rows, work, BLOCKS, "words")


def fragments_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return the different fragments of ``ids`` (words by falling frequency from 1; 0 where no n-gram goes on), and their counts.

    A fragment is the pivot, then REACH words before it, nearest first, and REACH after it, with 0 from where it ends.
    """
    padded = np.concatenate([np.zeros(REACH, np.int32), ids, np.zeros(REACH, np.int32)])
    at = np.flatnonzero(ids)
    pivot = ids[at]
    rows = np.zeros((1 + 2 * REACH, len(at)), np.int32)
    rows[0] = pivot
    # The pivot is the first of equal ones: words before it come earlier in the order, those after it not later.
    for side, (step, most) in enumerate(((-1, pivot - 1), (1, pivot))):
        goes_on = np.ones(len(at), bool)
        for k in range(1, REACH + 1):
            near = padded[at + REACH + step * k]
            goes_on &= (near > 0) & (near <= most)
            rows[side * REACH + k] = np.where(goes_on, near, 0)
    rows = rows[:, (rows[1] > 0) | (rows[1 + REACH] > 0)]
    packs = np.stack([rows[0].astype(np.int64), *(rows[1 + 2 * k].astype(np.int64) << 32 | rows[2 + 2 * k] for k in range(REACH))])
    return counted(packs, np.ones(packs.shape[1], np.int64))


def fragments(blocks: DataFrame) -> DataFrame:
    """Return FRAGMENTS of blocks that were ``answered`` with id and parts."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                at, ids, dealt = lists(batch, row, ["at", "id", "parts"])
                codes = unpacked(batch.column("codes")[row].as_py())
                known = np.zeros(int(max(codes.max(initial=0), at.max())) + 2, np.int32)
                # The last place stands for the end of a piece: no id.
                known[at] = ids
                rows, times = fragments_of(known[codes])
                order = np.argsort(ids)
                most = dealt[order][np.searchsorted(ids, rows[0], sorter=order)].astype(np.int64)
                part = (batch.column("block")[row].as_py() + np.arange(rows.shape[1])) % most
                # A part below 0: the pivot's fragments are all in one place.
                part = np.where(most > 1, part, -1)
                columns = [pa.array(rows[0], pa.int32()), pa.array(part, pa.int32()), *map(pa.array, rows[1:]), pa.array(times)]
                whole = pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FRAGMENTS.split(", ")])
                yield from (whole.slice(k, 1 << 16) for k in range(0, whole.num_rows, 1 << 16))
            give_back()

    return blocks.select("block", "codes", "at", "id", "parts").mapInArrow(run, FRAGMENTS)


def grams_of(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count the n-grams around the pivots of fragments (pivot, a, b, c): return them in two numbers each, and their counts."""
    flat = [half for x in rows[1:] for half in (x >> 32, x & 0xFFFFFFFF)]
    before, after = flat[:REACH], flat[REACH:]
    found, weight = [], []
    for left in range(REACH + 1):
        for right in range(LONGEST - left):
            if left + right == 0:
                continue
            fits = np.ones(rows.shape[1], bool)
            if left:
                fits &= before[left - 1] > 0
            if right:
                fits &= after[right - 1] > 0
            words = [*(before[k] for k in reversed(range(left))), rows[0], *after[:right]]
            words = [x[fits] for x in words] + [np.zeros(int(fits.sum()), np.int64)] * (LONGEST - 1 - left - right)
            found.append(np.stack([words[0] << 32 | words[1], words[2] << 32 | words[3]]))
            weight.append(times[fits])
    return counted(np.concatenate(found, axis=1), np.concatenate(weight))


def mine(sent: DataFrame, least: int) -> DataFrame:
    """Count n-grams by pivot: GRAMS of ``sent`` (FRAGMENTS), without those below ``least`` of a pivot in one part."""

    def run(batches):
        held: list[np.ndarray] = []
        rows = 0

        def count(own: np.ndarray) -> pa.RecordBatch:
            whole = own[1] < 0
            found = []
            for pick, fewest in ((own[:, whole], least), (own[:, ~whole], 0)):
                grams, times = grams_of(pick[[0, 2, 3, 4]], pick[5])
                found.append([*grams[:, times >= fewest], times[times >= fewest]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b", "n"])

        # Rows come by pivot and part; a pivot's rows that aren't dealt are counted together.
        for batch in batches:
            own = np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.columns])
            held.append(own)
            rows += own.shape[1]
            if rows < AT_ONCE or not own.shape[1]:
                continue
            every = np.concatenate(held, axis=1)
            last = np.flatnonzero((every[:2] != every[:2, -1:]).any(axis=0))
            edge = int(last[-1]) + 1 if len(last) else 0
            if not edge and every[1, -1] < 0:
                held = [every]
                continue
            edge = edge or every.shape[1]
            yield count(every[:, :edge])
            held, rows = [every[:, edge:]], every.shape[1] - edge
        if held:
            yield count(np.concatenate(held, axis=1))
        give_back()

    dealt = sent.repartition("pivot", "part").sortWithinPartitions("pivot", "part")
    return dealt.mapInArrow(run, GRAMS)


#: The score of a cut, exactly: the product may pass 64 bits.
SCORE = "(cast(a AS decimal(20,0)) * cast(2000000 AS decimal(7,0))) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))"


def scored(grams: DataFrame, single: DataFrame) -> DataFrame:
    """Return gram, a, l, r and score of ``grams`` (gram, f) by their lowest cut; ``single`` has the words' f."""
    size = F.size("gram")
    cuts = grams.select("gram", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    key = {True: "slice(gram, 1, k)", False: "slice(gram, k + 1, size(gram))"}
    parts = F.array(*[F.struct(F.lit(left).alias("left"), F.expr(x).alias("key")) for left, x in key.items()])
    asked = cuts.select("gram", "a", "k", F.explode(parts).alias("x")).select("gram", "a", "k", "x.left", "x.key")
    known = grams.select(F.col("gram").alias("key"), "f").unionByName(single.select(F.col("gram").alias("key"), "f"))
    found = spread_join(asked, known, ["key"], salt=F.xxhash64("gram", "k", "left"))
    of = lambda left: F.max(F.when(F.col("left") == left, F.col("f")))
    both = found.groupBy("gram", "a", "k").agg(of(True).alias("l"), of(False).alias("r"))
    best = F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r")).alias("best")
    return both.groupBy("gram", "a").agg(best).select("gram", "a", "best.l", "best.r", "best.score")


def outermost(rows: DataFrame, percent: int) -> DataFrame:
    """Drop ``rows`` (gram, a) inside a longer one that is found ``percent`` % as often or more."""
    spans = [(size, start, n) for size in range(3, LONGEST + 1) for n in range(2, size) for start in range(1, size - n + 2)]
    inner = F.array(*[F.when(F.size("gram") == size, F.slice("gram", start, n)) for size, start, n in spans])
    inside = rows.select("a", F.explode(inner).alias("gram")).where(F.col("gram").isNotNull()).groupBy("gram").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    stays = F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * percent)
    return rows.join(inside, "gram", "left").where(stays).drop("longer")


def best_of(rows: DataFrame, most: int) -> DataFrame:
    """Rank ``rows`` by lang (score, a, then phrase) and keep the first ``most`` of each: first by parts of a language, then of all."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    parts = max(1, math.isqrt(sizes // most))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    few = rows.withColumn("_part", part).withColumn("_own", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_own") <= most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return few.withColumn("rank", rank).where(F.col("rank") <= most).drop("_part", "_own")


def phrases(docs: DataFrame, least: int = 30, percent: int = 80, most: int = 2000) -> DataFrame:
    """Return the best phrases of 2 to LONGEST words by language: lang, rank, phrase, a, l, r, n, score.

    Texts of ``docs`` (lang, text) are lower-cased (A-Z only), cut into pieces and words; a null lang is UNKNOWN, a null
    or empty text has no words, repeated rows count each, further columns play no part, an empty table gives no rows.
    Phrases are found ``least`` times or more (a) and scored by their parts' counts (l, r), see ``scored``; those inside a
    longer phrase that is found ``percent`` % as often go. n counts the language's words. Texts of any length are taken
    whole: a worker holds a block, or one longer text. Words below ``least`` are never sent; there may be 2^31 - 1 others.
    """
    rows = word_blocks(docs)
    blocks, own = rows.where("at < 0").select("block", "codes"), rows.where("at >= 0").select("block", "at", "lang", "word", "n")
    words = cut(own.groupBy("lang", "word").agg(F.sum("n").alias("f"), F.count(F.lit(1)).alias("n")))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.where(F.col("f") >= least).withColumn("_fall", -F.col("f")).withColumn("_name", F.struct("lang", "word"))
    size = part_rows(words.agg(F.sum("f").alias("n")).first()["n"] or 0)
    numbered = with_ordinal(often, "_fall", "_name", "id").select("lang", "word", "f", "n", F.col("id").cast("int").alias("id"), F.ceil(F.col("f") / size).cast("int").alias("parts"))
    numbered = cut(numbered)
    if (numbered.agg(F.max("id").alias("n")).first()["n"] or 0) != numbered.count():
        raise ValueError("more than 2^31 - 1 frequent words")
    asked = answered(blocks, own, numbered, ["lang", "word"], numbered, ["id", "parts"])
    # N-grams of a pivot in one part are counted; those of others are summed up.
    kept = mine(fragments(asked), least).groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    halves = F.array(*[x.cast("int") for c in ("a", "b") for x in (F.shiftright(c, 32), F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))])
    grams = cut(kept.select(F.array_remove(halves, 0).alias("gram"), F.col("n").alias("f")))
    rows = cut(outermost(scored(grams, numbered.select(F.array("id").alias("gram"), "f")), percent))
    spelled = rows.select("gram", F.posexplode("gram").alias("at", "id"))
    spelled = spread_join(spelled, numbered.select("id", "lang", "word"), ["id"], salt=F.xxhash64("gram", "at"))
    spelled = spelled.groupBy("gram").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("own"))
    named = spelled.select("gram", "lang", F.array_join(F.transform("own", lambda x: x["word"]), " ").alias("phrase"))
    best = best_of(cut(rows.join(named, "gram").drop("gram")), most)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
