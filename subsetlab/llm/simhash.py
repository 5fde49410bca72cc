"""SimHash near-duplicates with BK-trees.

Fingerprints are compared where they can be close: if two differ in at most ``radius`` bits and the bits are dealt
into ``radius`` + 2 parts, then two parts at least are equal. So a fingerprint goes, once for every pair of parts,
to the bucket of these parts' bits. Equal fingerprints are one before that. A bucket's fingerprints go into a
BK-tree, whose children hang at their distance from the parent, and a search follows only edges within the radius
of its own distance. A bucket answers with links to the least fingerprint of each of its components, never with
pairs. A subtree known to lie in one component that the searcher belongs to is not entered again.

A bucket above ``SHARD`` fingerprints is dealt into shards, and each pair of shards is searched on its own.

A text may have several prints: majorities over the same shingles, whose hashes are mixed anew for each. Texts link
if any print of theirs is close. More prints find more near copies than a larger radius does, let in fewer others,
and keep the buckets' keys long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm.components import components
from subsetlab.llm.shared import cut, map_batches, spread_join, text_bytes

#: Fingerprints in one BK-tree.
SHARD = 20_000
SEED = 42
#: The increment, shifts and factors of the SplitMix64 generator.
GOLDEN = 0x9E3779B97F4A7C15
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
#: Shingles that fit a 16-bit counter.
COUNTED = 60_000
_nibble = np.arange(16, dtype=np.uint64)
#: By four bits: four counters of 16 bits each in one number.
SPREAD = sum(((_nibble >> np.uint64(k)) & np.uint64(1)) << np.uint64(16 * k) for k in range(4))


def bit_majority(hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Return a 64-bit number for each group of ``hashes`` (groups begin at ``start``): bits set in over half of them.

    An empty group gives zero.
    """
    size = np.diff(np.append(start, len(hashes)))
    counts = np.zeros((len(start), 64), np.int64)
    group = np.repeat(np.arange(len(start)), size)
    # Long groups are counted in portions that the counters can hold.
    inside = np.arange(len(hashes)) - np.repeat(start, size)
    edge = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (inside % COUNTED == 0))
    if len(edge):
        for k in range(16):
            part = np.add.reduceat(SPREAD[(hashes >> np.uint64(4 * k)) & np.uint64(15)], edge)
            for j in range(4):
                own = ((part >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.int64)
                np.add.at(counts[:, 4 * k + j], group[edge], own)
    bits = 2 * counts > size[:, None]
    return (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Return other hashes for the ``k``-th print, by a bijection on 64 bits; the first print has them as they are."""
    if not k:
        return hashes
    h = hashes + np.uint64(k * GOLDEN % (1 << 64))
    for shift, factor in MIX:
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(texts: list[bytes], words_in_shingle: int, digest: Callable[[bytes, int], int] = xxhash.xxh64_intdigest, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Return the hashes of the texts' (UTF-8) shingles, and where each text's begin: A-Z lower-cased, with repeats, XXH64 with seed 42 by default."""
    n = words_in_shingle
    hashes: list[int] = []
    start: list[int] = []
    for text in texts:
        start.append(len(hashes))
        words = text.lower().split()
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= n:
            hashes.append(digest(line, seed))
            continue
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size + 1) - 1
        a, z = (stop - size)[: len(words) - n + 1].tolist(), stop[n - 1 :].tolist()
        hashes += [digest(line[x:y], seed) for x, y in zip(a, z, strict=True)]
    return np.array(hashes, dtype=np.uint64), np.array(start, dtype=np.int64)


def fingerprint_texts(texts: list[bytes], words_in_shingle: int, prints: int = 1) -> list[np.ndarray]:
    """Return the texts' fingerprints by print."""
    # reduceat needs non-empty groups; bit_majority takes care of that.
    hashes, starts = shingle_hashes(texts, words_in_shingle)
    return [bit_majority(mixed(hashes, k), starts) for k in range(prints)]


def fingerprints(docs: DataFrame, words_in_shingle: int, prints: int = 1) -> DataFrame:
    """Return doc_id and fp, fp_1, ... (long, a print's bits each) of every row of ``docs`` (doc_id, text).

    A null text, or one without words, has zeros.
    """
    names = ["fp"] + [f"fp_{k}" for k in range(1, prints)]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = fingerprint_texts(text_bytes(batch.column(1)), words_in_shingle, prints)
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(fp.view(np.int64)) for fp in found]], names=["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, work, ", ".join(f"{x} long" for x in ["doc_id", *names]))


class Groups:
    """Union-find in which the root of a set is its least member."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        r = x
        while (up := above.setdefault(r, r)) != r:
            r = up
        while above[x] != r:
            above[x], x = r, above[x]
        return r

    def join(self, x: int, y: int) -> int:
        x, y = self.root(x), self.root(y)
        if x == y:
            return x
        x, y = min(x, y), max(x, y)
        self.above[y] = x
        return x


class BKTree:
    """Children by Hamming distance to their parent. ``whole`` names a member of the one component of a subtree."""

    def __init__(self, groups: Groups) -> None:
        self.groups = groups
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.whole: list[int | None] = []

    def link(self, x: int, radius: int) -> None:
        """Join ``x`` with everything in the tree within ``radius``."""
        if not self.values:
            return
        root, values = self.groups.root, self.values
        stack = [0]
        while stack:
            at = stack.pop()
            whole = self.whole[at]
            if whole is not None and root(whole) == root(x):
                continue
            distance = (values[at] ^ x).bit_count()
            if distance <= radius:
                self.groups.join(x, values[at])
            stack += [child for d, child in self.children[at].items() if abs(d - distance) <= radius]

    def add(self, x: int) -> None:
        """Insert ``x``, which is linked already."""
        root, mine = self.groups.root, self.groups.root(x)
        self.values.append(x)
        self.children.append({})
        self.whole.append(x)
        new = len(self.values) - 1
        at, path = 0, []
        while at != new:
            path.append(at)
            distance = (self.values[at] ^ x).bit_count()
            at = self.children[at].setdefault(distance, new)
        for at in reversed(path):
            whole = self.whole[at]
            if whole is None:
                # Components may have met since: the subtree is whole again if its parts are one.
                parts = [self.whole[c] for c in self.children[at].values()]
                if all(p is not None and root(p) == mine for p in parts) and root(self.values[at]) == mine:
                    self.whole[at] = x
            elif root(whole) != mine:
                self.whole[at] = None


def link_bucket(fps: list[int], shards: list[int] | None, radius: int) -> Iterator[tuple[int, int]]:
    """Yield (fingerprint, root) for those of a bucket (unsigned) that are linked to another one.

    With ``shards`` (of two shards, first and second), links inside the second are not looked for.
    """
    groups = Groups()
    tree = BKTree(groups)
    first = [x for x, s in zip(fps, shards, strict=True) if s == 0] if shards else fps
    for x in first:
        tree.link(x, radius)
        tree.add(x)
    if shards:
        for x, s in zip(fps, shards, strict=True):
            if s:
                tree.link(x, radius)
    for x in fps:
        if (r := groups.root(x)) != x:
            yield x, r


def parts_of(radius: int) -> list[tuple[int, int]]:
    """Deal 64 bits into radius + 2 parts: (lowest bit, number of bits)."""
    n = radius + 2
    cut = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def link_fingerprints(distinct: DataFrame, radius: int) -> DataFrame:
    """Return links (a, b) between nodes that connect all prints that differ in at most ``radius`` bits.

    ``distinct`` has rows (print, fp, node) with each pair of print (int, which one) and fp once.
    """
    masks = [sum(((1 << n) - 1) << at for at, n in pair) for pair in combinations(parts_of(radius), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    bucket = F.array(*[
        F.struct((F.col("print") * len(masks) + i).cast("int").alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
        for i, m in enumerate(signed)
    ])
    keyed = distinct.select("fp", "node", F.explode(bucket).alias("k")).select("fp", "node", "k.part", "k.bits")
    large = keyed.groupBy("part", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD)
    large = large.select("part", "bits", F.ceil(F.col("n") / SHARD).cast("int").alias("shards"))
    keyed = keyed.join(large, ["part", "bits"], "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    dealt = keyed.withColumn("own", own).withColumn("other", other)
    dealt = dealt.select(
        "fp", "node", "part", "bits", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
        (F.col("own") > F.col("other")).cast("int").alias("second"),
    )
    ordered = dealt.repartition("part", "bits", "x", "y").sortWithinPartitions("part", "bits", "x", "y", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Collect runs of rows with the same key across batches; lone rows cost nothing."""
        names = ["part", "bits", "x", "y"]
        rest: dict[str, np.ndarray] | None = None

        def flush(c: dict[str, np.ndarray]) -> pa.RecordBatch:
            n = len(c["fp"])
            new = np.append(True, np.any([c[k][1:] != c[k][:-1] for k in names], axis=0)) if n else np.zeros(0, bool)
            cut = np.append(np.flatnonzero(new), n)
            many = np.flatnonzero(np.diff(cut) > 1)
            links: list[tuple[int, int]] = []
            for a, b in zip(cut[many].tolist(), cut[many + 1].tolist(), strict=True):
                halves = c["x"][a] != c["y"][a]
                fps = c["fp"][a:b].view(np.uint64).tolist()
                node = dict(zip(fps, c["node"][a:b].tolist(), strict=True))
                links += [(node[x], node[r]) for x, r in link_bucket(fps, c["second"][a:b].tolist() if halves else None, radius)]
            got = np.array(links, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ["fp", "node", *names, "second"]}
            if rest is not None:
                c = {k: np.concatenate([rest[k], c[k]]) for k in c}
            same = np.all([c[k] == c[k][-1] for k in names], axis=0)
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = {k: v[last:] for k, v in c.items()}
            if last:
                yield flush({k: v[:last] for k, v in c.items()})
        if rest is not None:
            yield flush(rest)

    return ordered.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words_in_shingle: int = 5, radius: int = 3, prints: int = 1) -> DataFrame:
    """Return doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text).

    Documents are linked whose fingerprints, or any of whose ``prints`` prints, differ in at most ``radius`` bits;
    component_id is the smallest doc_id that links lead to. The fingerprint is the first print. Texts that are null
    or have no words have fingerprint zero and are linked like any other. Null doc_ids stay, and count only where a
    component has no other (component_id is null then). Repeated rows stay. Further columns are left out. Texts of any
    length are hashed whole.
    """
    rows = cut(fingerprints(docs, words_in_shingle, prints))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    # A node is a first print; another print stands for the least node that has it.
    nodes = distinct.select(F.lit(0).alias("print"), "fp", F.col("fp").alias("node"))
    links = None
    if prints > 1:
        more = F.posexplode(F.array(*[f"fp_{k}" for k in range(1, prints)])).alias("at", "value")
        own = rows.select(F.col("fp").alias("node"), more).select((F.col("at") + 1).alias("print"), F.col("value").alias("fp"), "node").distinct()
        least = own.groupBy("print", "fp").agg(F.min("node").alias("first"))
        nodes = nodes.unionByName(least.withColumnRenamed("first", "node"))
        links = own.join(least, ["print", "fp"]).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = link_fingerprints(nodes, radius)
    roots = components(near.unionByName(links) if links else near)
    named = cut(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    # One component, or one fingerprint, may hold a large share of all rows.
    by_fp = spread_join(named.select("fp", "root"), ids.drop("n"), ["root"], ids).select("fp", "component_id")
    out = spread_join(rows.select("doc_id", "fp"), by_fp, ["fp"], distinct, F.monotonically_increasing_id())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
