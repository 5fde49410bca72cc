"""Secret scans in DataFrame functions: fixed patterns, and tokens that look random.

The base patterns find assignments, access keys and long hexadecimal strings. The method looks at the other long
tokens that mix kinds of characters. It infers each token's encoding (the smallest alphabet that holds it) and
applies a battery of tests to its symbols:

* uniformity: the chi-squared statistic of symbol counts against the alphabet, with its exact mean and variance
  for a uniform source,
* runs: the number of runs of symbols in the upper and lower half of the alphabet,
* serial correlation: that of each symbol with the next one.

``p_random`` is the battery's: three times the least of the tests' p-values (Bonferroni). ``p_ordinary`` is the chance
that an ordinary token over the same alphabet would look so random: a chain of kinds of characters (``STAY``,
``TURNS``) and of letters, by the counts of neighbouring letters in the texts' words. It is the token's likelihood under this
chain over that under a uniform source: by Markov's inequality, an ordinary token has a ratio of p or less with a chance of
p at most. Marks join words in ordinary names, so pairs with one are no evidence.

False discoveries are controlled twice (Benjamini-Hochberg), each time over all tested tokens of the corpus in a range of
lengths, as short tokens are many and say little: of the tokens dismissed by ``p_random``, a share of ``REJECT`` at most is
random; of those found by ``p_ordinary`` (1 if dismissed), a share of ``RATE`` at most is ordinary. p-values are counted in
bins, so the driver only gets tables whose size the bins bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subsetlab.llm.shared import cut, cut_table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of 24 characters or more: the same as all runs, the shorter ones dropped.
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters of two kinds side by side, without which no long token mixes kinds closely.
BLEND = r"[A-Za-z][0-9]|[0-9][A-Za-z]|[a-z][A-Z]"
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")
#: Alphabets by rising size, and the pattern of a token that each one holds.
ALPHABETS = (
    ("0123456789", r"^[0-9]+$"),
    ("0123456789abcdef", r"^[0-9a-f]+$"),
    ("0123456789ABCDEF", r"^[0-9A-F]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^[A-Z2-7]+=*$"),
    ("0123456789abcdefghijklmnopqrstuvwxyz", r"^[0-9a-z]+$"),
    ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"^[0-9A-Z]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", r"^[0-9A-Za-z]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^[0-9A-Za-z+/]+=*$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", r"^[0-9A-Za-z_-]+=*$"),
)
REJECT = 0.01
#: Ordinary chances that a kind of character stays, in alphabets of two kinds, and by kind (digit, a-z, A-Z) and next kind in those of three.
STAY = 0.85
TURNS = ((0.85, 0.075, 0.075), (0.075, 0.85, 0.075), (0.05, 0.5, 0.45))
#: Share of a letter's chance that is even, and pairs that a letter's counts are filled up with evenly.
SMOOTH, FILL = 0.2, 500
#: Words whose neighbouring letters are counted: shorter than any token that is tested.
WORD = r"\b[a-z]{2,19}\b"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
RATE = 0.01
#: First lengths of the ranges in which false discoveries are controlled.
LENGTHS = (20, 24, 32, 40, 64, 128)
#: Bins of p-values: tenths of powers of ten.
BINS = 400
MASK = "[SECRET]"


SPAN = "array<struct<start:int,kind:int,end:int,match:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Return ``use`` of a value that is computed once, wherever and however often it is used."""
    return F.transform(F.array(value), use)[0]


def chunks(rows: Column) -> Column:
    """Cut an array into as many parts as a part has elements, so that what grows by copying does so in parts."""
    width = F.ceil(F.sqrt(F.size(rows))).cast("int")
    return F.when(F.size(rows) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / width).cast("int")), lambda i: F.slice(rows, i * width + 1, width)))


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def spans(text: Column, pattern: str, least: int, group: int = 0, kind: int = 0) -> Column:
    """Return the matches of ``pattern`` as an array of (start, kind, end, match), in characters.

    Only matches whose ``group`` has at least ``least`` characters stay. Places follow from the lengths of what lies
    between matches, summed up in chunks and over them.
    """
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else every
    rows = F.arrays_zip(every.alias("m"), own.alias("g"), F.split(text, pattern, -1).alias("b"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(x["b"])
        last = first + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.struct(first.alias("start"), F.lit(kind).alias("kind"), last.alias("end"), x["m"].alias("match"))
        fits = x["m"].isNotNull() & (F.length(x["g"]) >= least)
        return F.struct(last.alias("at"), F.when(fits, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def base(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def moved(x: Column, by: Column) -> Column:
        return F.transform(x["out"], lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["match"].alias("match")))

    def placed(parts: Column) -> Column:
        bases = F.aggregate(parts, F.struct(F.lit(0).alias("at"), _empty("array<int>").alias("out")), base)["out"]
        return F.flatten(F.zip_with(parts, bases, moved))

    start = F.struct(F.lit(0).alias("at"), _empty(SPAN).alias("out"))
    return let(rows, lambda r: let(F.transform(chunks(r), lambda c: F.aggregate(c, start, step)), placed))


def _upper(z: Column) -> Column:
    """Return the chance that a normal variable lies above ``z`` (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.greatest(F.exp(-x * x / 2) * 0.3989422804014327 * poly, F.lit(1e-200))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def letter_pairs(docs: DataFrame) -> list[list[int]]:
    """Count neighbouring letters in the words of all texts: 26 rows by first letter, of 26 by second.

    Words are counted first, so that the letters of each different word are looked at once.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(WORD), F.lit(0))).alias("word"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("pair")
    pairs = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("n", pair).groupBy("pair").agg(F.sum("n").alias("n"))
    found = {r["pair"]: r["n"] for r in pairs.toLocalIterator()}
    return [[found.get(a + b, 0) for b in LETTERS] for a in LETTERS]


def _letter_chances(pairs: list[list[int]], letters: int) -> Column:
    """Return log chances of the first ``letters`` letters after a letter (27 rows; the last one: after something else)."""
    rows = [r[:letters] for r in pairs[:letters]]
    rows = [*rows, *[[0] * letters] * (26 - letters), [sum(r[j] for r in rows) for j in range(letters)]]
    out = []
    for row in rows:
        total = sum(row) + FILL
        out += [math.log((1 - SMOOTH) * (row[j] + FILL / letters) / total + SMOOTH / letters) if j < letters else 0.0 for j in range(26)]
    return F.split(F.lit(",".join(map(repr, out))), ",").cast("array<double>")


def _ordinary(marks: Column, code: Column, pairs: list[list[int]]) -> Column:
    """Return the log of the likelihood of a token's symbols as an ordinary token's, over that of a uniform source.

    ``marks`` is an array of (kind, letter), ``code`` the place of the token's alphabet.
    """
    turns = F.split(F.lit(",".join(repr(math.log(x)) for row in TURNS for x in row)), ",").cast("array<double>")

    def chain(hexes: bool, three: bool) -> Column:
        table = _letter_chances(pairs, 6 if hexes else 26)
        digits = F.when(code == 3, math.log(6.0)).otherwise(math.log(10.0))
        even = F.when(code == 0, math.log(10.0)).when(code.isin(1, 2), math.log(16.0)).when(code == 3, math.log(32.0)).when(code >= 6, math.log(62.0)).otherwise(math.log(36.0))

        def step(acc: Column, b: Column) -> Column:
            a = acc["before"]
            kind = F.get(turns, a["kind"] * 3 + b["kind"]) if three else F.when(a["kind"] == b["kind"], math.log(STAY)).otherwise(math.log(1 - STAY))
            symbol = F.when(b["kind"] == 0, -acc["digits"]).otherwise(F.get(table, F.when(a["letter"] < 0, 26).otherwise(a["letter"]) * 26 + b["letter"]))
            own = F.when((a["kind"] < 3) & (b["kind"] < 3), kind + symbol + acc["even"]).otherwise(F.lit(0.0))
            return F.struct(b.alias("before"), acc["digits"].alias("digits"), acc["even"].alias("even"), (acc["sum"] + own).alias("sum"))

        none = F.struct(F.lit(3).alias("kind"), F.lit(-1).alias("letter"))
        return F.aggregate(marks, F.struct(none.alias("before"), digits.alias("digits"), even.alias("even"), F.lit(0.0).alias("sum")), step)["sum"]

    return F.when(code.isin(1, 2), chain(True, False)).when(code >= 6, chain(False, True)).otherwise(chain(False, False))


def assess(tokens: DataFrame, pairs: list[list[int]]) -> DataFrame:
    """Add p_random (of the battery, for a uniform source) and p_ordinary to tokens (column match; long enough, mixed).

    ``pairs`` counts neighbouring letters of ordinary words (see ``letter_pairs``). The symbols are passed over twice, in
    order and sorted.
    """
    code = F.coalesce(*[F.when(F.col("match").rlike(p), F.lit(i)) for i, (_, p) in enumerate(ALPHABETS)], F.lit(len(ALPHABETS)))
    df = tokens.withColumn("code", code).withColumn("body", F.regexp_replace("match", "=+$", ""))
    alphabet = F.get(F.array(*[F.lit(a) for a, _ in ALPHABETS], F.lit(ALPHABETS[-1][0] + "+/")), F.col("code"))
    df = df.withColumn("alphabet", alphabet).withColumn("k", F.length("alphabet").cast("double"))
    x = let(F.col("alphabet"), lambda a: F.transform(F.split("body", ""), lambda c: F.greatest(F.instr(a, c) - 1, F.lit(0)).cast("double")))
    df = df.withColumn("x", x).withColumn("n", F.size("x").cast("double"))

    def pass_over(acc: Column, v: Column) -> Column:
        high = (2 * v >= acc["k"]).cast("int")
        first = acc["high"] < 0
        return F.struct(
            acc["k"].alias("k"), v.alias("last"), F.when(first, v).otherwise(acc["first"]).alias("first"), (acc["sum"] + v).alias("sum"), (acc["square"] + v * v).alias("square"),
            (acc["product"] + F.when(first, 0.0).otherwise(acc["last"] * v)).alias("product"), high.alias("high"),
            (acc["ones"] + high).alias("ones"), (acc["runs"] + (acc["high"] != high).cast("double")).alias("runs"),
        )

    zeros = [F.lit(0.0).alias(c) for c in ("last", "first", "sum", "square", "product")]
    seen = F.aggregate("x", F.struct(F.col("k"), *zeros, F.lit(-1).alias("high"), F.lit(0.0).alias("ones"), F.lit(0.0).alias("runs")), pass_over)

    def count(acc: Column, v: Column) -> Column:
        run = F.when(acc["last"] == v, acc["run"] + 1).otherwise(F.lit(0.0))
        return F.struct(v.alias("last"), run.alias("run"), (acc["pairs"] + run).alias("pairs"))

    pairs_alike = F.aggregate(F.array_sort("x"), F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("pairs")), count)["pairs"]
    kind = lambda c: F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3)
    marks = F.transform(F.split("body", ""), lambda c: F.struct(kind(c).alias("kind"), (F.instr(F.lit(LETTERS), F.lower(c)) - 1).alias("letter")))
    p_ordinary = let(marks, lambda m: F.exp(F.least(_ordinary(m, F.col("code"), pairs), F.lit(0.0))))
    df = df.select(*tokens.columns, "n", "k", seen.alias("seen"), pairs_alike.alias("alike"), p_ordinary.alias("p_ordinary"))
    n, k, one = F.col("n"), F.col("k"), F.col("seen")
    mean = one["sum"] / n
    ends = one["first"] + one["last"]
    square = one["square"] - n * mean * mean
    serial = (one["product"] - mean * (2 * one["sum"] - ends) + (n - 1) * mean * mean) / F.greatest(square, F.lit(1e-9))
    chi = k / n * (2 * F.col("alike") + n) - n
    z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    both = 2 * one["ones"] * (n - one["ones"])
    spread = F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9))
    z_runs = F.abs(one["runs"] - (both / n + 1)) / F.sqrt(spread)
    z_serial = F.abs(serial + 1 / n) * F.sqrt(n)
    least = F.least(_upper(z_chi), 2 * _upper(z_runs), 2 * _upper(z_serial))
    flat = (one["ones"] == 0) | (one["ones"] == n)
    # Symbols of one half alone: no runs to count, and a chance of 2 ^ (1 - n).
    p_random = F.least(3 * F.when(flat, F.least(least, F.pow(F.lit(2.0), 1 - n))).otherwise(least), F.lit(1.0))
    return df.select(*tokens.columns, p_random.alias("p_random"), "p_ordinary")


def _bin(p: Column) -> Column:
    return F.least(F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300)))), F.lit(BINS)).cast("int")


def _range(length: Column) -> Column:
    return sum(((length >= a).cast("int") for a in LENGTHS[1:]), F.lit(0))


def thresholds(counts: list[tuple[int, int, int]], rate: float = RATE) -> list[int]:
    """Return for each range of lengths the smallest bin that is accepted, from (range, bin, tokens).

    A bin counts at its largest p-value. Without any discovery the smallest bin is BINS + 1.
    """
    out = []
    for r in range(len(LENGTHS)):
        own = sorted(((b, n) for x, b, n in counts if x == r), reverse=True)
        total, seen, least = sum(n for _, n in own), 0, BINS + 1
        for b, n in own:
            seen += n
            if 10 ** (-b / 10) <= rate * seen / total:
                least = b
        out.append(least)
    return out


def _by_range(judged: DataFrame, p: Column, rate: float) -> Column:
    """Return whether ``p`` is among the discoveries at ``rate`` in its range of lengths, over all rows of ``judged``."""
    # At most len(LENGTHS) * (BINS + 1) rows.
    table = judged.groupBy("range", _bin(p).alias("bin")).agg(F.count(F.lit(1)).alias("n")).toLocalIterator()
    least = F.array(*[F.lit(x) for x in thresholds([tuple(r) for r in table], rate)])
    return _bin(p) >= F.get(least, F.col("range"))


def scan(docs: DataFrame, keep: list[str] | None = None, pairs: list[list[int]] | None = None) -> DataFrame:
    """Find secrets in the text of every row of ``docs`` and return its columns (or those in ``keep``) and found.

    found is an array of (start, kind, end), in characters, end exclusive, by start and then kind (a place in KINDS).
    The base kinds follow their patterns alone. Random tokens don't overlap base spans. A null text holds nothing.
    Rows need no key: null doc_ids, repeated rows and any further columns are allowed; one named found is replaced.
    ``pairs`` counts neighbouring letters of ordinary words; else those of all texts are counted. Work on a text grows
    with its length, and with its matches to the power of 1.5 at most; one text's spans are one group of a window. An empty
    table gives no rows.
    """
    columns = [c for c in keep or docs.columns if c != "found"]
    pairs = letter_pairs(docs) if pairs is None else pairs
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Most texts hold nothing: a first look at each pattern is cheaper than taking the text apart.
    none = _empty(SPAN)
    assign = F.when(text.rlike(ASSIGN), spans(text, ASSIGN, 6, 2, 0)).otherwise(none)
    access = F.when(text.contains("AKIA"), spans(text, ACCESS, 20, 0, 1)).otherwise(none)
    hexes = F.when(text.rlike(HEX), spans(text, HEX, 24, 0, 2)).otherwise(none)
    tokens = F.when(text.rlike(BLEND), spans(text, TOKEN, 20, 0, 3)).otherwise(none)
    base = F.transform(F.array_sort(F.concat(assign, access, hexes)), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    # Ordinary long words have one kind of character.
    blend = lambda s: (s["match"].rlike("[0-9]") & s["match"].rlike("[A-Za-z]")) | s["match"].rlike("[a-z][A-Z].*[a-z][A-Z]")
    df = docs.select(F.struct(*columns).alias("row"), base.alias("base"), F.filter(tokens, blend).alias("tokens")).withColumn("key", F.monotonically_increasing_id())
    # The texts are read once: both the counts and the result go on from what is written here.
    df = cut_table(df, "secrets")
    some = df.where(F.size("tokens") > 0)
    known = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit("").alias("match")))
    every = some.select("key", F.explode(F.concat(known, "tokens")).alias("s")).select("key", "s.*")
    # A token is left out if a base span that starts before its end ends after its start. One text's spans are a group.
    order, fixed = Window.partitionBy("key").orderBy("start"), F.col("kind") < 3
    before = F.max(F.when(fixed, F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # Backwards, so that both frames grow by a row at a time.
    back = Window.partitionBy("key").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.min(F.when(fixed, F.col("start"))).over(back)
    every = every.withColumn("before", before).withColumn("after", after).where(~fixed)
    free = (F.coalesce("before", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True))
    # One text's tokens are dealt to many tasks.
    dealt = every.where(free).select("key", "start", "end", "match").repartition("key", "start")
    judged = cut(assess(dealt, pairs).drop("match").withColumn("range", _range(F.col("end") - F.col("start"))))
    dismissed = _by_range(judged, F.col("p_random"), REJECT)
    judged = judged.withColumn("p", F.when(dismissed, F.lit(1.0)).otherwise(F.col("p_ordinary")))
    own = F.struct("start", F.lit(KINDS.index("random")).alias("kind"), "end")
    found = judged.where(_by_range(judged, F.col("p"), RATE)).groupBy("key").agg(F.collect_list(own).alias("more"))
    bare = df.where(F.size("tokens") == 0).select("row.*", F.col("base").alias("found"))
    rest = some.join(found, "key", "left")
    with_more = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return bare.unionByName(rest.select("row.*", with_more.alias("found")))


def listed(found: Column) -> Column:
    """Write spans as kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def masked(text: Column, found: Column) -> Column:
    """Replace the spans (in order, possibly overlapping) by MASK. A null text stays null."""

    def step(acc: Column, s: Column) -> Column:
        between = F.substr(acc["own"], acc["at"] - acc["from"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(between, F.lit(MASK)))).otherwise(acc["out"])
        return F.struct(acc["own"].alias("own"), acc["from"].alias("from"), F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def join(t: Column) -> Callable[[Column, Column], Column]:
        """Take the piece of text that a chunk of spans lies in, and mask them there."""

        def one(acc: Column, chunk: Column) -> Column:
            last = F.greatest(acc["at"], F.array_max(F.transform(chunk, lambda s: s["end"])))
            piece = F.substr(t, acc["at"] + 1, last - acc["at"])
            start = F.struct(piece.alias("own"), acc["at"].alias("from"), acc["at"].alias("at"), _empty("array<string>").alias("out"))
            return F.struct(last.alias("at"), F.concat(acc["out"], F.array(F.array_join(F.aggregate(chunk, start, step)["out"], ""))).alias("out"))

        return one

    def whole(t: Column) -> Column:
        parts = let(found, lambda f: F.aggregate(chunks(f), F.struct(F.lit(0).alias("at"), _empty("array<string>").alias("out")), join(t)))
        return let(parts, lambda p: F.concat(F.array_join(p["out"], ""), F.substr(t, p["at"] + 1, F.greatest(F.length(t) - p["at"], F.lit(0)))))

    return F.when(F.size(found) > 0, let(text, whole)).otherwise(text)
