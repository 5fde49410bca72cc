"""The raw archive: what a source gave, page by page, never changed; and replaying it as a data source.

A run is a folder with one file a page and ``manifest.jsonl``, a line a page. Pages are few and fetched one after the
other, so writing is driver work; reading and checking are Spark jobs over the files.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MANIFEST = "run_id string, source string, page_index int, file string, url string, request_params map<string,string>, status_code int, content_type string, retrieved_at string, bytes long, sha256 string"


def write_page(root: str, run_id: str, source: str, index: int, content: str, url: str = "", params: dict | None = None, status: int = 200, kind: str = "text/plain") -> str:
    """Store a page and add its line to the run's manifest. A page that is there already is an error."""
    folder = os.path.join(root, source, run_id)
    os.makedirs(folder, exist_ok=True)
    name = f"page_{index:04d}.raw"
    data = content.encode()
    with open(os.path.join(folder, name), "xb") as f:
        f.write(data)
    entry = {
        "run_id": run_id, "source": source, "page_index": index, "file": name, "url": url, "request_params": {k: str(v) for k, v in (params or {}).items()}, "status_code": status,
        "content_type": kind, "retrieved_at": datetime.now(UTC).isoformat(), "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(),
    }
    with open(os.path.join(folder, "manifest.jsonl"), "a", encoding="utf-8") as f:
        f.write(json.dumps(entry, sort_keys=True) + "\n")
    return os.path.join(folder, name)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    lines = spark.read.schema(MANIFEST).json(f"{root}/*/*/manifest.jsonl")
    return lines.withColumn("path", F.concat_ws("/", "source", "run_id", "file"))


def files(spark: SparkSession, root: str) -> DataFrame:
    """Return path (source/run/file) and content (binary) of every stored page."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.raw").load(f"{root}/*/*")
    return raw.select(F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1).alias("path"), "content")


def pages(spark: SparkSession, root: str) -> DataFrame:
    """Return the manifest's entries with their content as text."""
    return manifest(spark, root).join(files(spark, root), "path").withColumn("content", F.col("content").cast("string"))


def verify(spark: SparkSession, root: str) -> DataFrame:
    """Return entries whose file is missing or has another digest: run_id, path, problem."""
    found = files(spark, root).select("path", F.sha2("content", 256).alias("own"))
    both = manifest(spark, root).join(found, "path", "left")
    problem = F.when(F.col("own").isNull(), "missing").when(F.col("own") != F.col("sha256"), "changed")
    return both.withColumn("problem", problem).where("problem is not null").select("run_id", "path", "problem")


def paged(fetch, start_index: int = 0, stop_at: str | None = None, oldest: str | None = None, most: int = 2000) -> Iterable[tuple[int, str, list[dict]]]:
    """Yield (index, content, rows) of pages, newest first, from ``fetch(index) -> (content, rows)``.

    Stops at an empty page, at a page that holds the id ``stop_at`` (which is still yielded), or at one whose rows are all
    older than ``oldest`` (an ISO date).
    """
    for index in range(start_index, start_index + most):
        content, rows = fetch(index)
        if not rows:
            return
        yield index, content, rows
        if stop_at is not None and any(r["draw_id"] <= stop_at for r in rows):
            return
        if oldest is not None and all(r["draw_date"] < oldest for r in rows):
            return


class _Run(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Replay(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[InputPartition]:
        runs = [os.path.join(self.root, s, r) for s in sorted(os.listdir(self.root)) for r in sorted(os.listdir(os.path.join(self.root, s)))]
        return [_Run(x) for x in runs if os.path.exists(os.path.join(x, "manifest.jsonl"))]

    def read(self, partition: _Run):
        with open(os.path.join(partition.path, "manifest.jsonl"), encoding="utf-8") as f:
            for line in f:
                e = json.loads(line)
                with open(os.path.join(partition.path, e["file"]), encoding="utf-8") as page:
                    yield e["source"], e["run_id"], e["page_index"], page.read()


class ReplaySource(DataSource):
    """``spark.read.format("page_replay").load(root)``: a run is a partition, a row a page."""

    @classmethod
    def name(cls) -> str:
        return "page_replay"

    def schema(self) -> str:
        return "source string, run_id string, page_index int, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Replay(self.options["path"])


#: Sources by name: how their stored pages are parsed.
def registry() -> dict:
    from subsetlab.sources.pages import parse_jsonl, parse_official

    def lines(p: DataFrame) -> DataFrame:
        return parse_jsonl(p.select(F.col("path").alias("file"), F.explode(F.split("content", "\n")).alias("value")))

    return {"official": lambda p: parse_official(p.select(F.col("path").alias("file"), "content")), "mirror": lines}


def parse(source: str, stored: DataFrame) -> DataFrame:
    """Parse the stored pages of a source; the error for an unknown one names those there are."""
    known = registry()
    if source not in known:
        raise KeyError(f"unknown source {source!r}; there are {', '.join(sorted(known))}")
    return known[source](stored.where(F.col("source") == source))
