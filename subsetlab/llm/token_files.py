"""Token-ID files: the ids of documents in one array, document boundaries in Elias-Fano code.

A data set is a folder of shards that hold ascending ranges of doc_id. A shard, all integers little-endian::

    8 bytes   magic "EFTOKEN1"
    ids       uint16 each, all documents in turn
    bounds    Elias-Fano: the end of each document in the array
    doc ids   Elias-Fano: doc_id less the smallest one
    32 bytes  footer: bytes of bounds, bytes of doc ids, smallest doc_id, number of null doc_ids (they come first)

Tasks write a shard under another name and then move it, so a repeated task leaves the same file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subsetlab.llm.elias_fano import EliasFano
from subsetlab.llm.shared import bucket_count, cut, slices, text_bytes
from subsetlab.llm.wordbpe import library_encoder
from subsetlab.session import ship

MAGIC = b"EFTOKEN1"
FOOT = "<QQqQ"
FOOT_SIZE = struct.calcsize(FOOT)
MANIFEST = "shard int, path string, n_docs long, n_tokens long"
#: MB of text in one shard, and shards in a group whose sums are taken together.
SHARD_MB, GROUP = 16, 4096


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each and write shards to ``folder``, which tasks can reach.

    Return the manifest, one row a shard: shard (in doc_id order), path, n_docs, n_tokens. A null text is empty.
    Null doc_ids come first; equal doc_ids lie side by side, in the order of their texts' XXH64, and may fill several
    shards. An empty table has no shards. Further columns are left out. A text of any length lies in one shard.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = bucket_count(rows, "text", SHARD_MB)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, doc_ids, counts, n_tokens, sink = TaskContext.get().partitionId(), [], [], 0, None
        fs, base = _filesystem(folder)
        own = f"{base}/.{shard}-{uuid.uuid4().hex}"
        for batch in slices(batches):
            if sink is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(own)
                sink.write(MAGIC)
            ids, count = library_encoder(tokenizer).encode(text_bytes(batch.column(1)))
            ids = np.insert(ids, np.cumsum(count), np.uint16(end_id))
            sink.write(ids.astype("<u2").tobytes())
            counts.append(count + 1)
            doc_ids += batch.column(0).to_pylist()
            n_tokens += len(ids)
        if sink is None:
            return
        known = np.array([x for x in doc_ids if x is not None], dtype=np.int64)
        least = int(known[0]) if len(known) else 0
        bounds = EliasFano.of(np.cumsum(np.concatenate(counts))).to_bytes()
        names = EliasFano.of(known - least).to_bytes()
        sink.write(bounds + names + struct.pack(FOOT, len(bounds), len(names), least, len(doc_ids) - len(known)))
        sink.close()
        path = f"{base}/shard-{shard:06d}.eft"
        fs.move(own, path)
        table = [[shard], [f"{folder.rstrip('/')}/shard-{shard:06d}.eft"], [len(doc_ids)], [n_tokens]]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(table, types, strict=True)], names=["shard", "path", "n_docs", "n_tokens"])

    keys = ["doc_id", F.xxhash64("text")]
    manifest = cut(rows.repartitionByRange(shards, *keys).sortWithinPartitions(*keys).mapInArrow(write, MANIFEST))
    # Tasks that failed leave files under other names.
    fs, base = _filesystem(folder)
    for left in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if left.base_name.startswith("."):
            fs.delete_file(left.path)
    return manifest


class Shard:
    """One file, open for reading: ``document(i)`` reads its ids alone."""

    def __init__(self, path: str) -> None:
        fs, place = _filesystem(path)
        self.file = fs.open_input_file(place)
        size = self.file.size()
        n_bounds, n_names, self.least, self.n_null = struct.unpack(FOOT, self.file.read_at(FOOT_SIZE, size - FOOT_SIZE))
        tail = self.file.read_at(n_bounds + n_names, size - FOOT_SIZE - n_bounds - n_names)
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.bounds, self.names = EliasFano.from_bytes(tail[:n_bounds]), EliasFano.from_bytes(tail[n_bounds:])

    def __len__(self) -> int:
        return self.bounds.n

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.least + self.names.select(i - self.n_null)

    def ids(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(2 * (stop - start), len(MAGIC) + 2 * start), "<u2")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds.select(i - 1) if i else 0, self.bounds.select(i))

    def close(self) -> None:
        self.file.close()


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read back the shards of ``manifest``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The checksum is of all ids as little-endian uint32. With ``with_ids`` also the ids (array of int).
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source = Shard(path)
                stop = source.bounds.all()
                start = np.concatenate([[0], stop[:-1]])
                doc_ids = [None] * source.n_null + (source.least + source.names.all()).tolist()
                for k in range(0, len(stop), 1024):
                    a, b = start[k : k + 1024], stop[k : k + 1024]
                    wide = source.ids(int(a[0]), int(b[-1])).astype("<u4")
                    own = [wide[x:y] for x, y in zip((a - a[0]).tolist(), (b - a[0]).tolist(), strict=True)]
                    columns = [pa.array(doc_ids[k : k + 1024], pa.int64()), pa.array(base + a), pa.array(b - a), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
                source.close()

    # Ids before a shard: those of earlier groups of shards, and those of earlier shards of its group.
    ship(manifest.sparkSession)
    grouped = manifest.withColumn("group", F.floor(F.col("shard") / GROUP))
    before = (Window.unboundedPreceding, -1)
    groups = grouped.groupBy("group").agg(F.sum("n_tokens").alias("n"))
    # One row for GROUP shards of SHARD_MB, so this order is over few rows.
    groups = groups.select("group", F.coalesce(F.sum("n").over(Window.orderBy("group").rowsBetween(*before)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("group").orderBy("shard").rowsBetween(*before)), F.lit(0))
    placed = grouped.withColumn("inside", inside).join(groups, "group")
    return placed.select("path", (F.col("base") + F.col("inside")).alias("base")).repartition("path").mapInArrow(read, schema)
