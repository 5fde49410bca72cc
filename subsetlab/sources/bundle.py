"""A sink that publishes a result as a bundle: files, a manifest with their digests, and a pointer to the current bundle.

    df.write.format("bundle").option("path", uri).option("table", "metrics").mode("append").save()

Every task writes its rows as one CSV file to a folder that this write alone has; ``commit`` writes the manifest and only
then the pointer, a file with a number of its own, which nothing renames or overwrites. Readers take the pointer with
the largest number that is whole (it ends in its own digest). So a task or driver that is killed leaves the earlier
bundle, ``abort`` takes away what a failed write left, and a task that runs twice is counted once. Works where pyarrow has
the file system (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from subsetlab.plans.publish import formatted, guard
from subsetlab.session import ship

#: Digits of a pointer's number, so that names sort as numbers do.
DIGITS = 12


def _system(uri: str):
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def _put(system, path: str, data: bytes) -> None:
    system.create_dir(posixpath.dirname(path), recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def _sealed(content: dict) -> bytes:
    body = json.dumps(content, sort_keys=True, indent=1)
    return f"{body}\n{hashlib.sha256(body.encode()).hexdigest()}\n".encode()


def _opened(data: bytes) -> dict | None:
    """Return a pointer's content, or None if it isn't whole."""
    body, _, seal = data.decode("utf-8", "replace").rstrip("\n").rpartition("\n")
    return json.loads(body) if hashlib.sha256(body.encode()).hexdigest() == seal else None


def _pointers(system, root: str) -> list[tuple[int, str]]:
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(posixpath.join(root, "_current"), allow_not_found=True))
    return sorted((int(i.base_name), i.path) for i in found if i.is_file and i.base_name.isdigit())


def current(uri: str) -> dict | None:
    """Return the manifest of the bundle that readers see, or None."""
    system, root = _system(uri)
    for _, path in reversed(_pointers(system, root)):
        with system.open_input_stream(path) as f:
            content = _opened(f.read())
        if content is not None:
            return content
    return None


def verify(uri: str) -> list[str]:
    """Return the names of the current bundle's files that are missing or differ from their digests."""
    system, root = _system(uri)
    bad = []
    for name, about in (current(uri) or {"files": {}})["files"].items():
        try:
            with system.open_input_stream(posixpath.join(root, name)) as f:
                if hashlib.sha256(f.read()).hexdigest() != about["sha256"]:
                    bad.append(name)
        except FileNotFoundError:
            bad.append(name)
    return sorted(bad)


@dataclass
class Written(WriterCommitMessage):
    """A task's file."""

    name: str
    rows: int
    bytes: int
    sha256: str


class BundleWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, replace: bool) -> None:
        self.uri, self.table, self.replace = options["path"], options.get("table", "table"), replace
        self.about = json.loads(options.get("about", "{}"))
        self.columns = schema.names
        self.folder = f"data/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = _system(self.uri)
        # A task that runs again writes another file; only the one that commits is named in the manifest.
        name = f"{self.folder}/{self.table}-{uuid.uuid4().hex}.csv"
        path = posixpath.join(root, name)
        system.create_dir(posixpath.dirname(path), recursive=True)
        digest, rows, size = hashlib.sha256(), 0, 0
        with system.open_output_stream(path) as out:
            for line in self._lines(iterator):
                rows += 1
                size += len(line)
                digest.update(line)
                out.write(line)
        return Written(name, rows - 1, size, digest.hexdigest())

    def _lines(self, rows: Iterator[Row]) -> Iterator[bytes]:
        buffer = io.StringIO()
        writer = csv.writer(buffer, lineterminator="\n")

        def line(cells: list) -> bytes:
            buffer.seek(0)
            buffer.truncate()
            writer.writerow(cells)
            return guard(buffer.getvalue()).encode()

        yield line(self.columns)
        for r in rows:
            yield line([formatted(v) for v in r])

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.uri)
        known = _pointers(system, root)
        before = (current(self.uri) or {}) if not self.replace else {}
        files = {k: v for k, v in before.get("files", {}).items() if v.get("table") != self.table}
        files |= {m.name: {"table": self.table, "rows": m.rows, "bytes": m.bytes, "sha256": m.sha256} for m in messages if m is not None}
        number = known[-1][0] + 1 if known else 1
        content = {"number": number, "about": before.get("about", {}) | self.about, "files": files}
        path = posixpath.join(root, "_current", f"{number:0{DIGITS}d}")
        _put(system, path, _sealed(content))

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _system(self.uri)
        try:
            system.delete_dir(posixpath.join(root, self.folder))
        except FileNotFoundError:
            pass


class BundleSink(DataSource):
    """Mode append replaces the table of the same name in the bundle and keeps its others; overwrite starts a new bundle."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BundleWriter(dict(self.options), schema, overwrite)


def publish_table(df: DataFrame, uri: str, table: str, about: dict | None = None, replace: bool = False) -> dict:
    """Publish ``df`` as ``table`` of the bundle at ``uri``, a file a partition, and return the bundle's manifest."""
    spark = ship(df.sparkSession)
    spark.dataSource.register(BundleSink)
    writer = df.write.format("bundle").option("path", uri).option("table", table).option("about", json.dumps(about or {}))
    writer.mode("overwrite" if replace else "append").save()
    return current(uri)


def read_table(spark: SparkSession, uri: str, table: str, schema: str) -> DataFrame:
    """Read a table of the current bundle with Spark's CSV source."""
    names = [n for n, about in (current(uri) or {"files": {}})["files"].items() if about["table"] == table]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv([posixpath.join(uri, n) for n in names])
