"""Blocks of documents as numbers of words, with a dictionary a block.

A corpus-wide value of each word (its number, its gain) comes to the texts without a broadcast and without a row a word
that stands in a text: a block of some MB of text asks for each of its different words once. The answers are joined by
word, with frequent words dealt over parts, gathered by block, and meet the block's numbers there. What one task holds
is bounded by a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm.shared import cut_table, give_back, slices, spread_join
from subsetlab.session import ship

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 4 << 20
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def make_blocks(df: DataFrame, work: Callable[[int, pa.RecordBatch], pa.RecordBatch], schema: str, name: str, size: int = BLOCK) -> DataFrame:
    """Gather the rows of ``df`` (text last) to blocks, and write what ``work`` makes of a block's number and rows.

    A block is a row with ``at`` -1, and a row for each entry of its dictionary with the entry's place.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        filled = 0
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            held.append(batch)
            filled += batch.column(batch.num_columns - 1).nbytes
            if filled >= size:
                yield work(number, pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, filled, number = [], 0, number + 1
        if filled or any(b.num_rows for b in held):
            yield work(number, pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        give_back()

    return cut_table(df.mapInArrow(run, schema), name)


def answered(blocks: DataFrame, entries: DataFrame, answers: DataFrame, keys: list[str], counts: DataFrame, values: list[str]) -> DataFrame:
    """Join to ``blocks`` (a row each) what ``answers`` (a row for ``keys``) say on its dictionary: arrays ``at`` and ``values``.

    ``entries`` has block, at (a place in its dictionary) and the keys; ``counts`` has the keys and n, the blocks that
    ask for them. A block that gets no answer is left out.
    """
    found = spread_join(entries.select("block", "at", *keys), answers.select(*keys, *values), keys, counts, F.xxhash64("block"))
    own = found.groupBy("block").agg(F.collect_list(F.struct("at", *values)).alias("_own"))
    own = own.select("block", *[F.col(f"_own.{c}").alias(c) for c in ["at", *values]])
    return blocks.join(own, "block")


def lists(batch: pa.RecordBatch, row: int, names: list[str]) -> list[np.ndarray]:
    """Return the arrays in a row of ``batch``."""
    return [batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in names]


def with_entries(number: int, entries: dict[str, pa.Array], block: dict[str, pa.Array]) -> pa.RecordBatch:
    """Return a block's row and those of its dictionary's ``entries``; each has the columns of ``block`` or of entries, else null."""
    n = len(next(iter(entries.values())))
    columns = {"block": pa.array(np.full(n + 1, number)), "at": pa.array(np.arange(-1, n, dtype=np.int32))}
    columns |= {k: pa.concat_arrays([pa.nulls(1, x.type), x]) for k, x in entries.items()}
    columns |= {k: pa.concat_arrays([x, pa.nulls(n, x.type)]) for k, x in block.items()}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Return whole numbers compressed, bytes of one weight side by side; of ``rising`` ones the steps."""
    own = np.asarray(values, np.int64)
    own = np.diff(own, prepend=0) if rising else own
    parts = np.ascontiguousarray(own, "<i4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(parts.tobytes())


def unpacked(data: bytes, rising: bool = False) -> np.ndarray:
    parts = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T
    own = np.ascontiguousarray(parts).view("<i4").ravel()
    return np.cumsum(own, dtype=np.int64) if rising else own


def first_of(rows: np.ndarray) -> np.ndarray:
    """Tell which of sorted ``rows`` (columns first) differ from the row before."""
    n = rows.shape[1]
    new = np.ones(n, bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
    return new


def counted(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return the different rows (columns first; sorted by the first column, then the next) and the sums of ``times``."""
    if not rows.shape[1]:
        return rows, times
    order = np.lexsort(rows[::-1])
    rows = rows[:, order]
    edge = np.flatnonzero(first_of(rows))
    return rows[:, edge], np.add.reduceat(times[order], edge)
