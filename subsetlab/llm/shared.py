"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subsetlab.session import ship

#: White space as the contracts of this subpackage define it: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that are worked on at once. Texts can be long, so they are few; Spark bounds the bytes of a batch.
ARROW_ROWS = 512
#: Slices after which a worker gives freed memory back: what libraries keep of it adds up over a task.
GIVE = 4
#: Bytes of a row group of intermediate tables.
ROW_GROUP = 16 << 20
#: A key with more rows than one part holds is hot (``part_rows``): ROWS, or a SHARE-th of all rows where they are few,
#: at least LEAST_ROWS; less than KEYS keys are hot.
ROWS, SHARE, LEAST_ROWS, KEYS = 1_000_000, 1000, 64, 100_000


def shared_dir(spark: SparkSession) -> str:
    """Return the folder that the driver and all executors share, as a URI or path.

    It is the cluster's ``spark.checkpoint.dir``. Only where the session names none and runs on one machine (tests) a
    fresh temporary folder is set; on a cluster without one this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="subsetlab-"))
    return spark.sparkContext.getCheckpointDir()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """Return a path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: its lineage ends and it is computed once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut``, by a Parquet table: for rows with texts, of which later steps read only some columns."""
    return written(df, fresh_dir(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it again; the folder goes when the driver ends."""
    # Small row groups: a task holds one of them in memory.
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.parquet(path)


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Yield Arrow batches in slices of few rows; what work on them has freed goes back to the system on the way."""
    done = 0
    for batch in batches:
        for at in range(0, batch.num_rows, ARROW_ROWS):
            yield batch.slice(at, ARROW_ROWS)
            done += 1
            if done % GIVE == 0:
                give_back()


def part_rows(total: int) -> int:
    """Return how many of ``total`` rows with one key go to one part: a fixed number, or a SHARE-th of few rows.

    Less than KEYS keys have more, whatever the total.
    """
    return max(min(ROWS, total // SHARE), total // KEYS, LEAST_ROWS)


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], counts: DataFrame | None = None, salt: Column | None = None) -> DataFrame:
    """Join ``many`` to ``one`` (a row a key), with hot keys dealt over as many parts as their rows need.

    ``counts`` (keys and n, the rows of ``many`` with a key) saves counting them. Less than KEYS keys are hot, whatever
    the size, so their broadcast is bounded. Keys aren't null. Rows are dealt by ``salt``, else by the hash of their
    columns; it must be the same if a task runs again.
    """
    counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts.select(*keys, "n")
    most = part_rows(counts.agg(F.sum("n").alias("n")).first()["n"] or 0)
    hot = F.broadcast(counts.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("_salts")))
    part = F.pmod(F.xxhash64(*many.columns) if salt is None else salt, F.col("_salts"))
    dealt = many.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(part).cast("int")).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)).alias("_salt")
    return dealt.join(one.join(hot, keys, "left").select(*one.columns, copies), [*keys, "_salt"]).drop("_salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(docs: DataFrame, column: str, mb: int = 16) -> int:
    """Return how many buckets hold about ``mb`` MB of ``column`` each, and no fewer than the shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(F.col(column))).alias("n")).first()["n"] or 0
    return max(shuffle_partitions(docs.sparkSession), math.ceil(total / (mb << 20)), 1)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Return a string column's values as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def give_back(result=None):
    """Return memory that this worker has freed to the system, and ``result``: a worker waits for long between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    return result


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``work`` to the Arrow batches of ``df``, few rows at once; the package is sent to the executors."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = work(batch)
            if out is not None and out.num_rows:
                yield out
        give_back()

    return df.mapInArrow(run, schema)
