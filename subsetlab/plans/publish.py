"""Publication: small results as deterministic text, tables by Spark, and a manifest that is written last."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import re
import shutil
import uuid
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subsetlab.session import cut

#: Words that published text must not hold, as numbers have no merit of their own: fixed values.
BANNED = ("hot number", "cold number", "due number", "lucky", "best bet", "guaranteed")


def formatted(value) -> str:
    """Write a cell: floats to ten significant digits, null as an empty string."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:.10g}"
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return json.dumps(value, sort_keys=True) if isinstance(value, (dict, list)) else str(value)


#: Rows of a table that is one text.
TEXT_ROWS = 200_000


def is_small(df: DataFrame, most: int | None = None) -> bool:
    return df.limit((most or TEXT_ROWS) + 1).count() <= (most or TEXT_ROWS)


def to_csv(df: DataFrame, order: list[str], most: int | None = None) -> str:
    """Return a small table as CSV with line feeds, in the order of ``order``. Larger tables are for ``publish``."""
    most = most or TEXT_ROWS
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the table with Spark")
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows([[formatted(v) for v in r] for r in rows])
    return out.getvalue()


def guard(text: str) -> str:
    """Return ``text``, or raise if it holds a banned word."""
    for word in BANNED:
        if re.search(rf"\b{re.escape(word)}\b", text, re.IGNORECASE):
            raise ValueError(f"published text must not say {word!r}")
    return text


def write_large(df: DataFrame, order: list[str], folder: str) -> dict[str, dict]:
    """Write a table of any size as CSV parts, sorted over all of them, and return the digest and size of each part by name.

    Doubles are written in full here. Parts are named by their order, so equal tables in equal parts have equal digests.
    """
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("header", True).csv(folder)
    parts = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*.csv").load(folder)
    rows = parts.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).collect()
    return {r["name"]: {"sha256": r["sha256"], "bytes": r["bytes"]} for r in sorted(rows, key=lambda r: r["name"])}


def publish(folder: str, files: dict[str, str], about: dict, replace: bool = True, large: dict[str, tuple[DataFrame, list[str]]] | None = None) -> dict:
    """Write ``files`` and then manifest.json (their digests and ``about``) to a new folder, and move it into place at once.

    ``large`` has tables, with their order, that Spark writes as folders of parts.
    """
    if os.path.exists(folder) and not replace:
        raise FileExistsError(folder)
    own = f"{folder}.{uuid.uuid4().hex}.tmp"
    os.makedirs(own)
    try:
        digests = {}
        for name, text in sorted(files.items()):
            data = guard(text).encode()
            with open(os.path.join(own, name), "wb") as f:
                f.write(data)
            digests[name] = {"sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data)}
        for name, (df, order) in (large or {}).items():
            digests |= {f"{name}/{k}": x for k, x in write_large(df, order, os.path.abspath(os.path.join(own, name))).items()}
        manifest = about | {"files": digests}
        with open(os.path.join(own, "manifest.json"), "w", encoding="utf-8") as f:
            f.write(json.dumps(manifest, sort_keys=True, indent=1) + "\n")
        old = f"{own}.old"
        if os.path.exists(folder):
            os.rename(folder, old)
        os.rename(own, folder)
        shutil.rmtree(old, ignore_errors=True)
    finally:
        shutil.rmtree(own, ignore_errors=True)
    return manifest


def swap_table(df: DataFrame, path: str) -> None:
    """Write a table beside its place and swap it in, so that readers see the old or the new one."""
    own, old = f"{path}.{uuid.uuid4().hex}.tmp", f"{path}.old"
    df.write.parquet(own)
    shutil.rmtree(old, ignore_errors=True)
    if os.path.exists(path):
        os.rename(path, old)
    else:
        os.makedirs(os.path.dirname(path), exist_ok=True)
    os.rename(own, path)
    shutil.rmtree(old, ignore_errors=True)


#: Ids in a partition of a staged table, and partitions that a read may name one by one.
RANGE, NAMED = 1000, 10_000


def id_range(draw_id: str = "draw_id") -> Column:
    """Return the partition of a draw: its number by RANGE; -1 for an id that is no number."""
    return F.coalesce(F.floor(F.col(draw_id).try_cast("long") / RANGE), F.lit(-1)).cast("long")


def read_ranges(spark: SparkSession, path: str, schema: str, wanted: DataFrame | None = None) -> DataFrame:
    """Return a table that ``merge_ranges`` wrote, or only the partitions that ``wanted`` (rows with draw_id) touches.

    Few partitions are named in the scan's partition filter; many are joined, which leaves the choice to Spark.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    if not os.path.isdir(path):
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(f"{schema}, id_range long").parquet(path)
    if wanted is not None:
        touched = wanted.select(id_range().alias("id_range")).distinct()
        some = [r["id_range"] for r in touched.limit(NAMED + 1).collect()]
        stored = stored.where(F.col("id_range").isin(some)) if len(some) <= NAMED else stored.join(touched, "id_range", "left_semi")
    return stored.select(*names)


def merge_ranges(fresh: DataFrame, path: str, schema: str) -> None:
    """Add ``fresh`` (new ids) to the table at ``path``, partitioned by ranges of ids; only partitions they touch are read and written.

    The touched partitions are replaced by Spark's dynamic partition overwrite, so a merge that is done again after a
    failure gives the same rows. Each partition is one file in the order of draw_id, unless it is very large.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    fresh = cut(fresh.select(*names))
    stored = read_ranges(fresh.sparkSession, path, schema, fresh)
    known = stored.join(fresh.select("draw_id"), "draw_id", "left_anti")
    # What is overwritten is read before: the rows go through the shared folder.
    merged = cut(known.unionByName(fresh)).withColumn("id_range", id_range())
    dealt = merged.repartition("id_range").sortWithinPartitions("id_range", "draw_id")
    dealt.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("id_range").parquet(path)


def write_text(path: str, text: str) -> None:
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(own, "w", encoding="utf-8", newline="\n") as f:
        f.write(text)
    os.replace(own, path)


class Lock:
    """A lock file that one process holds; one older than ``stale`` seconds is taken over."""

    def __init__(self, path: str, stale: float = 3600.0) -> None:
        self.path, self.stale = path, stale

    def __enter__(self) -> Lock:
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        for _ in range(2):
            try:
                with open(self.path, "x", encoding="utf-8") as f:
                    f.write(json.dumps({"pid": os.getpid(), "at": datetime.now().timestamp()}))
                return self
            except FileExistsError:
                if datetime.now().timestamp() - os.path.getmtime(self.path) < self.stale:
                    break
                os.remove(self.path)
        raise BlockingIOError(self.path)

    def __exit__(self, *_) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)
