"""Quality rules by repetition: how much of a text lies inside n-grams and lines that it holds more than once.

Words of many texts are numbered by a dictionary, and rolled into hashes of n-grams: the hash of n + 1 words is that
of n words plus the next word's share. Sorting them by text brings equal n-grams together; neighbours that share a hash
are compared word by word, and if two of them differ the n-grams are sorted by their words. Only texts that repeat some
n-gram of the shortest length are looked at for longer ones, as the others can't repeat those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm.shared import give_back, map_batches, slices, text_bytes
from subsetlab.llm.words import mixed, split_words
from subsetlab.session import ship

#: Largest share of a text's word characters inside n-grams that repeat an earlier one, by n. Fixed values of
#: published web-corpus rules.
SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of the characters of lines inside lines equal to an earlier one (same source).
LINE_SHARE = 0.20
#: The base rule: fewest words, and largest percentage of words in repeated 5-word windows.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_rng = np.random.Generator(np.random.PCG64(20240609))
FACTOR = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

COLUMNS = {
    "doc_id": "long", "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
    "n_repeat_words": "long", "line_share": "double", **{f"share_{n}": "double" for n in SHARES}, "base_failed": "boolean", "kept": "boolean",
}


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Return the sums of ``values`` between the places in ``first``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


class Ngrams:
    """N-grams of the words of several texts, by rising n."""

    def __init__(self, codes: np.ndarray, first: np.ndarray) -> None:
        self.codes, self.first = codes, first
        self.h = mixed(codes.astype(np.uint64) + np.uint64(1))
        self.text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.n, self.rolled = 0, np.zeros(len(codes), np.uint64)

    def roll(self, n: int) -> None:
        while self.n < n:
            self.rolled = self.rolled[: max(0, len(self.h) - self.n)] + self.h[self.n :] * FACTOR[self.n]
            self.n += 1

    def _same(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Tell whether the n-grams at places ``a`` and ``b`` are equal and in one text."""
        same = self.text[a] == self.text[b]
        for i in range(n):
            same &= self.codes[a + i] == self.codes[b + i]
        return same

    def covered(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Tell for each word whether an n-gram found twice covers it: counting first ones, and not counting them."""
        self.roll(n)
        count = len(self.h) - n + 1
        marks = np.zeros((2, len(self.h) + 1), np.int64)
        if count > 0:
            inside = np.flatnonzero(self.text[:count] == self.text[n - 1 :])
            key = mixed(self.rolled[inside] + self.text[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(key, kind="stable")
            key, place = key[order], inside[order]
            again = np.append(False, key[1:] == key[:-1]) if len(key) else np.zeros(0, bool)
            hit = np.flatnonzero(again)
            if not self._same(place[hit], place[hit - 1], n).all():
                place = inside[np.lexsort((inside, *(self.codes[inside + i] for i in reversed(range(n))), self.text[inside]))]
                again = np.append(False, self._same(place[1:], place[:-1], n))
            both = again | np.append(again[1:], False) if len(key) else again
            for row, hit in enumerate((both, again)):
                np.add.at(marks[row], place[hit], 1)
                np.add.at(marks[row], place[hit] + n, -1)
        cover = np.cumsum(marks, axis=1)[:, :-1] > 0
        return cover[0], cover[1]


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Return the measures of texts (UTF-8), a value for each text."""
    w = split_words(texts)
    data = w.data
    starts = np.append(w.text_start, len(data))
    letter = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    size = letter[w.end] - letter[w.start]
    out = {"n_words": np.diff(w.first), "word_chars": sums(size, w.first), "n_symbols": sums(SYMBOL[data], starts)}
    dup, share = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for i, text in enumerate(texts):
        lines = [x for x in text.split(b"\n") if x.strip()]
        seen = set(lines)
        if len(seen) < len(lines):
            dup[i] = len(lines) - len(seen)
            chars = sum(len(x.decode()) for x in lines)
            share[i] = 1 - sum(len(x.decode()) for x in seen) / chars
    out |= {"n_dup_lines": dup, "line_share": share}
    codes, _ = w.codes()
    both, again = Ngrams(codes, w.first).covered(WINDOW)
    out["n_repeat_words"] = sums(both, w.first)
    chars = np.maximum(out["word_chars"], 1)
    some = np.flatnonzero(out["n_repeat_words"])
    pick = np.repeat(np.isin(np.arange(len(texts)), some), np.diff(w.first))
    first = np.append(0, np.cumsum(np.diff(w.first)[some]))
    grams, own = Ngrams(codes[pick], first), size[pick]
    for n in SHARES:
        value = np.zeros(len(texts))
        if len(some):
            value[some] = sums(own * (again[pick] if n == WINDOW else grams.covered(n)[1]), first)
        out[f"share_{n}"] = value / chars
    words, repeat = out["n_words"], out["n_repeat_words"]
    out["base_failed"] = (words < LEAST_WORDS) | (100 * repeat > REPEAT_PERCENT * words)
    bad = out["line_share"] > LINE_SHARE
    for n, most in SHARES.items():
        bad |= out[f"share_{n}"] > most
    out["kept"] = ~(out["base_failed"] | bad)
    return out


def quality(docs: DataFrame) -> DataFrame:
    """Measure every row of ``docs`` (doc_id, text) and judge it; see COLUMNS.

    word_chars counts characters in words, n_dup_lines lines with a word equal to an earlier line, n_repeat_words
    words in 5-word windows found twice or more. line_share and share_n are shares of characters in repeats, first
    ones not counted. A null or empty text has no words, so it fails. Null doc_ids and repeated rows stay. Further
    columns are left out. Texts of any length are taken whole: memory grows with the longest one. An empty table gives no rows.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = measure(text_bytes(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[c]) for c in list(COLUMNS)[1:])], names=list(COLUMNS))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, work, ", ".join(f"{k} {v}" for k, v in COLUMNS.items()))


def verdicts(text: pa.Array) -> pa.Array:
    """Tell of each text whether the rules keep it, few texts at once: a batch of Spark has thousands."""
    kept = [np.zeros(0, bool)]
    for part in slices([pa.RecordBatch.from_arrays([text], names=["text"])]):
        kept.append(measure(text_bytes(part.column(0)))["kept"])
    return give_back(pa.array(np.concatenate(kept)))


def keep_good(docs: DataFrame) -> DataFrame:
    """Return the rows of ``docs`` whose text the rules keep, with all their columns, without a shuffle.

    The measures run over the text column of a row in place, so equal or null doc_ids make no difference.
    """

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        return verdicts(text)

    ship(docs.sparkSession)
    return docs.where(good(F.col("text")))
