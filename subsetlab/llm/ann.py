"""Approximate nearest neighbours by additive quantisation.

A vector is written as the sum of one full-length codeword from each of several codebooks. Each codebook is fitted
to what the ones before leave over of a bounded sample, by k-means. Encoding is a beam search: it keeps the best few
sums at every step. For a query q and a sum x of codewords c, |q - x|^2 = |q|^2 - 2 sum(q.c) + |x|^2, so with the
norm |x|^2 known, a table of q's products with all codewords gives a score by as many look-ups as there are
codebooks. The best scores are ranked again by exact distances. A vector is no nearer than the score of its sum less its
own error, so ranking goes on until no vector left in the part can be among the nearest: codes save work there, but lose nothing.
Vectors are coded less the sample's mean and in units of its typical distance from it, so that neither place nor scale matters.

The first codewords also name a vector's cell: the first one alone, or the first two or three, so that the number of
cells grows with the table (up to WORDS ** LEVELS). A query visits its own cell and those nearest to it. How many is
measured on the sample: as many as hold COVER of the true neighbours there. Cells are dealt into parts of bounded size,
so one that holds a large share of all rows is many tasks' work. Rows travel to their part once; queries are sent to the
parts of the cells that they visit and stream past the part's rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subsetlab.llm.shared import cut, slices
from subsetlab.session import ship

#: Rows that the codebooks are fitted on at most: a documented bound, whatever the size of the table.
SAMPLE = 8192
BOOKS, WORDS, ROUNDS, BEAM = 24, 32, 6, 4
#: Codes are looked for within this many units; what lies further out has a large error.
FAR = 1e6
#: Rows in a cell, roughly, until there are WORDS ** LEVELS cells.
CELL, LEVELS = 4096, 3
#: Share of true neighbours whose cells queries should visit, and queries of the sample that this is measured on.
COVER, TRIED = 0.995, 512
#: Candidates that are ranked again by exact distance first, in each part of a cell, and rounding of scores against the norms.
RERANK, ROUNDING = 400, 2e-7
#: Vectors in one part of a cell, and rows sent at once.
PART, SENT = 16_384, 8_192


def usable(vector: Column) -> Column:
    """Tell whether a vector is there, isn't zero, and holds neither null nor non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Return codebooks (books x words x dimensions) for the rows of ``sample``, the same for the same rows."""
    rng = np.random.Generator(np.random.PCG64(7))
    rest, out = sample.astype(np.float64), []
    for _ in range(books):
        centre = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            near = _nearest(rest, centre)
            count = np.bincount(near, minlength=words)
            total = np.zeros_like(centre)
            np.add.at(total, near, rest)
            centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
            empty = np.flatnonzero(count == 0)
            centre[empty] = rest[rng.choice(len(rest), len(empty))]
        rest = rest - centre[_nearest(rest, centre)]
        out.append(centre)
    return np.stack(out).astype(np.float32)


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre * centre).sum(axis=1) - 2 * x @ centre.T).argmin(axis=1)


def unit_of(sample: np.ndarray) -> tuple[np.ndarray, float]:
    """Return the mean of the sample's rows and their median distance from it (1 if that is 0)."""
    centre = sample.mean(axis=0)
    unit = float(np.median(np.sqrt(((sample - centre) ** 2).sum(axis=1))))
    return centre, unit if np.isfinite(unit) and unit > 0 else 1.0


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Return codes (rows x books) of the rows of ``x`` by beam search, and the squared norms of what they stand for."""
    n, (m, k, _) = len(x), books.shape
    norms = (books * books).sum(axis=2)
    rest = np.clip(x, -FAR, FAR).astype(np.float32)[:, None, :]
    codes = np.zeros((n, 1, 0), np.int16)
    error = np.zeros((n, 1), np.float32)
    for j in range(m):
        cost = error[:, :, None] + norms[j] - 2 * rest @ books[j].T
        flat = cost.reshape(n, -1)
        width = min(beam, flat.shape[1]) if j < m - 1 else 1
        best = np.argpartition(flat, width - 1, axis=1)[:, :width] if width < flat.shape[1] else np.arange(flat.shape[1])[None].repeat(n, 0)
        parent, word = best // k, (best % k).astype(np.int16)
        error = np.take_along_axis(flat, best, axis=1)
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None]], axis=2)
        rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - books[j][word]
    found = codes[:, 0, :]
    whole = sum(books[j][found[:, j]] for j in range(m))
    return found.astype(np.uint8 if k <= 256 else np.int16), (whole * whole).sum(axis=1)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Return a column of equally long lists as a matrix of doubles."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def cell_numbers(codes: np.ndarray, words: int) -> list[np.ndarray]:
    """Return the cells of codes (rows x books) by one, two, ... codewords."""
    return [sum(codes[:, j].astype(np.int32) * words**j for j in range(n)) for n in range(1, min(LEVELS, codes.shape[1]) + 1)]


def cell_centres(cells: np.ndarray, books: np.ndarray, level: int) -> np.ndarray:
    """Return what the first ``level`` codewords of cells add up to."""
    words = books.shape[1]
    return sum(books[j][cells // words**j % words] for j in range(level)).astype(np.float64)


def visiting_order(q: np.ndarray, own: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Return the places of all cells in the order in which queries visit them; ``own`` is the place of a query's own."""
    far = (centres * centres).sum(axis=1) - 2 * q @ centres.T
    far[np.arange(len(q)), own] = -np.inf
    return np.argsort(far, axis=1, kind="stable")


def visits_needed(sample: np.ndarray, books: np.ndarray, level: int, cells: np.ndarray, k: int) -> int:
    """Return how many cells (of ``cells``, sorted) queries must visit to meet COVER of their ``k`` nearest in the sample."""
    words = books.shape[1]
    own = np.searchsorted(cells, cell_numbers(encode(sample, books)[0], words)[level - 1])
    ranks = []
    for a in range(0, min(TRIED, len(sample)), 64):
        q = sample[a : a + 64]
        place = np.argsort(visiting_order(q, own[a : a + 64], cell_centres(cells, books, level)), axis=1)
        far = ((q * q).sum(axis=1)[:, None] - 2 * q @ sample.T) + (sample * sample).sum(axis=1)
        far[np.arange(len(q)), a + np.arange(len(q))] = np.inf
        near = np.argsort(far, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        ranks.append(np.take_along_axis(place, own[near], axis=1).ravel())
    every = np.sort(np.concatenate(ranks))
    return int(every[math.ceil(COVER * len(every)) - 1]) + 1 if len(every) else 1


class Part:
    """Vectors of one part of a cell, that queries are scored against."""

    def __init__(self, held: list[pa.RecordBatch], books: np.ndarray, centre: np.ndarray | float = 0.0, unit: float = 1.0) -> None:
        rows = pa.Table.from_batches(held)
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        kind = np.uint8 if books.shape[1] <= 256 else np.int16
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), kind).reshape(len(ids), -1)
        self.books, self.ids, self.x = books.astype(np.float64), ids[order], matrix(rows.column("vector"))[order]
        self.codes, self.centre, self.unit = codes[order].astype(np.int64), centre, unit
        whole = sum(self.books[j][self.codes[:, j]] for j in range(len(books)))
        self.norms = (whole * whole).sum(axis=1)
        self.errors = np.sqrt((((self.x - centre) / unit - whole) ** 2).sum(axis=1))

    def answer(self, asks: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
        """Score queries by tables of products, and rank by exact distance until no other row can be among the nearest."""
        ids = self.ids
        step = max(1, (1 << 22) // len(ids))
        for a in range(0, len(q_ids), step):
            found = []
            own = (q[a : a + step] - self.centre) / self.unit
            length = (own * own).sum(axis=1)
            table = np.einsum("qd,jkd->jqk", own, self.books)
            value = np.repeat(self.norms[None], len(table[0]), axis=0)
            for j in range(len(self.books)):
                value -= 2 * table[j][:, self.codes[:, j]]
            for i, v in enumerate(value):
                others = ids != q_ids[a + i]
                pick = np.flatnonzero(others)
                if len(ids) > RERANK:
                    first = np.argpartition(v, RERANK - 1)[:RERANK]
                    first = first[others[first]]
                    distance = np.sqrt(((self.x[first] - q[a + i]) ** 2).sum(axis=1))
                    if len(first) >= k:
                        most = np.partition(distance, k - 1)[k - 1] / self.unit
                        slack = ROUNDING * (np.sqrt(length[i]) + np.sqrt(self.norms) + self.errors)
                        pick = np.flatnonzero(others & (np.sqrt(np.maximum(v + length[i], 0)) - self.errors - slack <= most))
                distance = np.sqrt(((self.x[pick] - q[a + i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[pick], distance))[:k]
                found.append((np.full(len(best), asks[a + i]), np.full(len(best), q_ids[a + i]), ids[pick][best], distance[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["ask", "query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """Return the ``k`` nearest vectors found for each query: query_id, rank (from 1), vec_id, score.

    ``vectors`` has vec_id and embedding (arrays of one length); the rows where ``queries`` holds are the queries, and
    every other row is a candidate for each. score is the Euclidean distance of the original vectors in doubles, ties
    go to the smaller vec_id. Rows with a null vec_id, and vectors that are null, empty, zero, or hold null or
    non-finite components take no part, nor do vectors of another length than most of the sample. A row is no candidate
    for queries of its own vec_id. Repeated rows are candidates each, but one query; rows of one vec_id with different
    vectors are queries each. An empty table, or one without a usable query, gives no rows. Further columns are left out.
    """
    spark = ship(vectors.sparkSession)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    vector = "array<float>" if single else "array<double>"
    good = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(vector).alias("embedding"), queries.alias("asks"))
    # A bounded sample, the same for the same rows: those with the smallest hashes.
    chosen = rows.select("embedding", F.xxhash64("vec_id", "embedding").alias("h")).orderBy("h", "embedding").limit(SAMPLE).toPandas()
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(chosen):
        return spark.createDataFrame([], schema)
    size = int(chosen["embedding"].map(len).mode()[0])
    sample = np.stack(chosen["embedding"][chosen["embedding"].map(len) == size].to_numpy()).astype(np.float64)
    rows = rows.where(F.size("embedding") == size)
    centre, unit = unit_of(sample)
    sample = (sample - centre) / unit
    shared = spark.sparkContext.broadcast(fit(sample))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            codes, _ = encode((matrix(b.column(1)) - centre) / unit, shared.value)
            cells = [pa.array(x, pa.int32()) for x in cell_numbers(codes, shared.value.shape[1])]
            columns = [b.column(0), b.column(1), b.column(2), *cells, pa.array([c.tobytes() for c in codes], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "embedding", "asks", *[f"cell_{n}" for n in range(1, len(cells) + 1)], "codes"])

    names = [f"cell_{n}" for n in range(1, min(LEVELS, BOOKS) + 1)]
    coded = cut(rows.mapInArrow(index, f"vec_id long, embedding {vector}, asks boolean, {', '.join(f'{x} int' for x in names)}, codes binary"))
    level = next((n for n in range(1, len(names)) if WORDS**n * CELL >= coded.count()), len(names))
    coded = coded.withColumn("cell", F.col(f"cell_{level}"))
    # A row a cell: WORDS ** LEVELS bounds them.
    sizes = {r["cell"]: r["n"] for r in coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    cells = np.array(sorted(sizes), dtype=np.int64)
    parts = np.array([math.ceil(sizes[c] / PART) for c in cells.tolist()])
    visits = min(len(cells), visits_needed(sample, shared.value, level, cells, k))
    held_by = spark.sparkContext.broadcast((cells, parts))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Send each query to the parts of the cells that it visits."""
        cells, parts = held_by.value
        for b in slices(batches):
            own = np.searchsorted(cells, b.column(3).to_numpy())
            near = visiting_order((matrix(b.column(2)) - centre) / unit, own, cell_centres(cells, shared.value, level))[:, :visits].ravel()
            times = parts[near]
            take = np.repeat(np.repeat(np.arange(b.num_rows), visits), times)
            cell, part = np.repeat(cells[near], times), np.arange(len(take)) - np.repeat(np.cumsum(times) - times, times)
            for at in range(0, len(take), SENT):
                here = slice(at, at + SENT)
                rows = pa.array(take[here])
                columns = [pa.array(cell[here], pa.int32()), pa.array(part[here], pa.int32()), *(b.column(c).take(rows) for c in range(3))]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "part", "ask", "id", "vector"])

    asked = coded.where("asks").select(F.xxhash64("vec_id", "embedding").alias("ask"), "vec_id", "embedding", "cell").dropDuplicates(["vec_id", "embedding"])
    asked = asked.mapInArrow(go, f"cell int, part int, ask long, id long, vector {vector}")
    part_of = spark.createDataFrame([(int(c), int(p)) for c, p in zip(cells, parts, strict=True)], "cell int, parts int")
    part = F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int").alias("part")
    held = coded.join(F.broadcast(part_of), "cell").select("cell", part, F.lit(None).cast("long").alias("ask"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "codes")
    both = held.unionByName(asked, allowMissingColumns=True).withColumn("asking", F.col("ask").isNotNull().cast("int"))
    both = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "asking")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each part, the rows come first, and then the queries."""
        now, held, ready = None, [], None
        for batch in slices(batches):
            place = np.stack([batch.column(c).to_numpy() for c in ("cell", "part", "asking")])
            edge = np.append(np.flatnonzero(np.append(True, (place[:, 1:] != place[:, :-1]).any(axis=0))), batch.num_rows)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                own, key = batch.slice(a, b - a), tuple(place[:2, a])
                if key != now:
                    now, held, ready = key, [], None
                if not place[2, a]:
                    held.append(own)
                elif held:
                    ready = ready or Part(held, shared.value, centre, unit)
                    yield from ready.answer(own.column("ask").to_numpy(), own.column("id").to_numpy(), matrix(own.column("vector")), k)

    near = both.mapInArrow(score, "ask long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "ask").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
