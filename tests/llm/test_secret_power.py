"""Recall of random tokens by encoding and length, and tokens made of ordinary words."""

import collections
import math
import random
import re

from pyspark.sql import functions as F

from subsetlab.llm import secret_scan

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = {"upper hex": "0123456789ABCDEF", "base32": UPPER + "234567", "base36": LOWER + "0123456789", "base62": UPPER + LOWER + "0123456789", "base64": UPPER + LOWER + "0123456789+/"}
WORDS = "report final summary user account service manager index result value input output parse request handler version build data table column record order invoice customer address message event stream cache buffer thread number string update delete insert select filter group".split()


#: Counts of neighbouring letters in the words that ordinary tokens are made of.
PAIRS = [[1000 * sum(w[i : i + 2] == a + b for w in WORDS for i in range(len(w))) for b in LOWER] for a in LOWER]


def mixed(token):
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def drawn(each, seed=4):
    """Tokens by (encoding, length), and ordinary ones by shape."""
    rng = random.Random(seed)
    out = []
    for name, alphabet in ENCODINGS.items():
        for n in (20, 24, 32):
            made = ("".join(rng.choice(alphabet) for _ in range(n)) for _ in range(2 * each))
            out += [(name, n, t) for t in [t for t in made if mixed(t)][:each]]
    for _ in range(each):
        w = [rng.choice(WORDS) for _ in range(rng.randint(3, 6))]
        year = f"{rng.randint(1990, 2030)}"
        out += [("camel", 0, "".join(x.title() for x in w) + year), ("snake", 0, "_".join(w) + f"_v{rng.randint(1, 99)}"), ("joined", 0, "".join(w) + year), ("upper", 0, "".join(w).upper() + year)]
        out.append(("path", 0, "/".join(w[:2]) + "/" + year + "-0" + str(rng.randint(1, 9)) + "/" + w[2] + str(rng.randint(1, 999))))
    return [r for r in out if len(r[2]) >= 20]


def shares(spark, each, cut):
    rows = secret_scan.assess(spark.createDataFrame(drawn(each), "name string, length int, match string"), PAIRS)
    good = F.col("p_random") > secret_scan.REJECT / 10
    got = rows.groupBy("name", "length").agg(F.count(F.lit(1)).alias("all"), *[F.count_if(good & (F.col("p_ordinary") <= c)).alias(str(c)) for c in cut])
    return {(r["name"], r["length"]): tuple(r[str(c)] / r["all"] for c in cut) for r in got.collect()}


def test_power_by_encoding(spark):
    got = shares(spark, 300, [secret_scan.RATE])
    print(got)
    for (name, n), (share,) in got.items():
        if n == 0:
            assert share <= 0.01, name
        elif name != "upper hex":
            assert share >= 0.9, (name, n)
        else:
            assert share >= {20: 0.5, 24: 0.6, 32: 0.75}[n], n


def test_small_alphabets_are_found_in_texts(spark):
    rng = random.Random(9)
    rows = [(i, "see " + "".join(rng.choice(ENCODINGS["base32"]) for _ in range(20)) + " there") for i in range(60)]
    rows += [(100 + i, f"{a}{b}{i:04d}-of-{a}-{b}") for i, (a, b) in enumerate(zip(WORDS, WORDS[1:], strict=False))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = collections.Counter(r["doc_id"] < 100 for r in secret_scan.scan(docs, pairs=PAIRS).collect() if r["found"])
    assert found[True] >= 48 and found[False] == 0


def brute(token):
    """Return the battery's p and the ordinary p of a token, by plain Python."""
    code = next((i for i, (_, p) in enumerate(secret_scan.ALPHABETS) if re.fullmatch(p.strip("^$"), token)), len(secret_scan.ALPHABETS))
    alphabet = secret_scan.ALPHABETS[code][0] if code < len(secret_scan.ALPHABETS) else secret_scan.ALPHABETS[-1][0] + "+/"
    body = token.rstrip("=")
    x, n, k = [max(alphabet.find(c), 0) for c in body], len(body), len(alphabet)
    upper = lambda z: max(math.erfc(z / math.sqrt(2)) / 2, 1e-200)
    counts = collections.Counter(x)
    chi = sum((counts[i] - n / k) ** 2 / (n / k) for i in range(k))
    z = [(chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)]
    high = [2 * v >= k for v in x]
    ones = sum(high)
    both = 2 * ones * (n - ones)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    z.append(abs(runs - (both / n + 1)) / math.sqrt(max(both * (both - n) / (n * n * (n - 1)), 1e-9)))
    mean = sum(x) / n
    square = max(sum((v - mean) ** 2 for v in x), 1e-9)
    z.append(abs(sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False)) / square + 1 / n) * math.sqrt(n))
    ps = [upper(z[0]), 2 * upper(z[1]), 2 * upper(z[2])]
    if ones in (0, n):
        ps.append(2.0 ** (1 - n))
    kind = lambda c: 0 if c in "0123456789" else 1 if c in LOWER else 2 if c in UPPER else 3
    size = 6 if code in (1, 2) else 26
    log = 0.0
    for a, b in zip(body, body[1:], strict=False):
        if kind(a) == 3 or kind(b) == 3:
            continue
        turn = secret_scan.TURNS[kind(a)][kind(b)] if code >= 6 else secret_scan.STAY if kind(a) == kind(b) else 1 - secret_scan.STAY
        if kind(b) == 0:
            symbol = 1 / (6 if code == 3 else 10)
        else:
            i = LOWER.find(a.lower())
            row = PAIRS[i][:size] if 0 <= i < size else [0] * size if i >= 0 else [sum(PAIRS[r][j] for r in range(size)) for j in range(size)]
            j = LOWER.find(b.lower())
            symbol = (1 - secret_scan.SMOOTH) * (row[j] + secret_scan.FILL / size) / (sum(row) + secret_scan.FILL) + secret_scan.SMOOTH / size
        even = {0: 10, 1: 16, 2: 16, 3: 32, 4: 36, 5: 36}.get(code, 62)
        log += math.log(turn * symbol * even)
    return min(1.0, 3 * min(ps)), math.exp(min(0.0, log))


def test_battery_against_plain_python(spark):
    tokens = [t for _, _, t in drawn(40, seed=8)] + ["a1" * 15, "Zz9" * 20, "0123456789abcdef" * 2, "ABCDEFGH234567" * 2 + "==", "a-b_c+d/e=f" * 3, "q1" + "A" * 3000]
    got = {r["match"]: (r["p_random"], r["p_ordinary"]) for r in secret_scan.assess(spark.createDataFrame([(t,) for t in tokens], "match string"), PAIRS).collect()}
    assert set(got) == set(tokens)
    for token in tokens:
        for own, expected in zip(got[token], brute(token), strict=True):
            assert abs(own - expected) <= 1e-6 + 1e-4 * expected, token


def test_findings_against_plain_python(spark):
    """Both false-discovery controls, on all tokens of a corpus, with p-values in the same bins."""
    made = [t for _, _, t in drawn(30, seed=5)]
    rows = [(i, f"é see {t} there") for i, t in enumerate(made)]
    ps = {t: brute(t) for t in made}
    place = lambda p: min(math.floor(-10 * math.log10(max(p, 1e-300))), secret_scan.BINS)
    group = lambda t: sum(len(t) >= a for a in secret_scan.LENGTHS[1:])
    # What the scan looks at: tokens that mix kinds, and no base spans.
    some = [t for t in made if (re.search("[0-9]", t) and re.search("[A-Za-z]", t)) or re.search("[a-z][A-Z].*[a-z][A-Z]", t)]
    some = [t for t in some if not re.search("[0-9a-f]{24}", t) and re.search(secret_scan.BLEND, t)]

    def accepted(value, rate):
        out = set()
        for g in range(len(secret_scan.LENGTHS)):
            own = [t for t in some if group(t) == g]
            bins = sorted({place(value[t]) for t in own})
            fits = [b for b in bins if 10 ** (-b / 10) <= rate * sum(place(value[t]) >= b for t in own) / len(own)]
            out |= {t for t in own if fits and place(value[t]) >= min(fits)}
        return out

    dismissed = accepted({t: ps[t][0] for t in some}, secret_scan.REJECT)
    expected = accepted({t: 1.0 if t in dismissed else ps[t][1] for t in some}, secret_scan.RATE)
    found = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), pairs=PAIRS).collect()
    got = {r["text"][s["start"] : s["end"]] for r in found for s in r["found"] if s["kind"] == 3}
    assert got == expected and 0 < len(got) < len(some)


def test_letters_are_counted_in_words(spark):
    docs = spark.createDataFrame([("The the x9z abc-ab " + "z" * 30,), (None,), ("",)], "text string")
    pairs = secret_scan.letter_pairs(docs)
    count = lambda a, b: pairs[ord(a) - 97][ord(b) - 97]
    assert (count("t", "h"), count("h", "e"), count("a", "b"), count("b", "c"), count("z", "z")) == (2, 2, 2, 1, 0)


def test_many_tokens_in_one_text(spark):
    rng = random.Random(3)
    tokens = ["".join(rng.choice(ENCODINGS["base62"]) for _ in range(24)) for _ in range(4000)]
    text = " ".join(tokens) + " token = abcdefgh" * 4000
    r = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), pairs=PAIRS).withColumn("m", secret_scan.masked(F.col("text"), F.col("found"))).first()
    spans = [tuple(s) for s in r["found"]]
    assert sum(k == 0 for _, k, _ in spans) == 4000 and sum(k == 3 for _, k, _ in spans) > 3400
    at, out = 0, []
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], secret_scan.MASK]
        at = max(at, b)
    assert r["m"] == "".join(out) + text[at:]
