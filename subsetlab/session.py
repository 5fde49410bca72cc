"""Sessions: what a job of this package needs from Spark."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors of ``spark``, once a session; Spark distributes the archive."""
    context = spark.sparkContext
    if getattr(context, "_subsetlab_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    # Executors fetch the archive when their first task runs, so it stays until the driver ends.
    folder = tempfile.mkdtemp(prefix="subsetlab-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "subsetlab.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(str(archive))
    context._subsetlab_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Return the folder that the driver and all executors share: ``spark.checkpoint.dir``; one of its own on one machine only."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="subsetlab-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def fresh_folder(spark: SparkSession, name: str) -> str:
    """Return a path in the shared folder that nothing else uses; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: its rows stay the same if a task runs again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
