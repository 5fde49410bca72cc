"""Ingestion as a stream: files of records come in, the first version of each id stays.

The source is a folder of JSON lines. Each micro-batch is checked and merged by id into a Parquet table; a batch that is
given again after a failure adds nothing, as its ids are there already.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from subsetlab.operators import rules
from subsetlab.plans.refresh import STAGED, read, to_staged
from subsetlab.sources.pages import parse_jsonl


def merge_batch(batch: DataFrame, path: str, today: str) -> None:
    """Add the good records of a batch whose ids the table at ``path`` doesn't have."""
    spark = batch.sparkSession
    good = batch.where("error is null")
    bad = rules.record_findings(good, F.lit(today).cast("date")).where("severity = 'error'").select("draw_id")
    staged = to_staged(good, "stream").withColumn("_arrival", F.monotonically_increasing_id())
    one = staged.groupBy("draw_id").agg(F.min_by(F.struct(*[c for c in staged.columns if c != "draw_id"]), "_arrival").alias("r")).select("draw_id", "r.*").drop("_arrival")
    stored = read(spark, path, STAGED)
    fresh = one.join(bad.distinct(), "draw_id", "left_anti").join(stored.select("draw_id"), "draw_id", "left_anti")
    fresh.write.mode("append").parquet(path)


def start(spark: SparkSession, incoming: str, path: str, checkpoint: str, today: str, source: str = "mirror") -> StreamingQuery:
    """Ingest all files that are in ``incoming`` and end; called again it goes on with new ones."""
    os.makedirs(incoming, exist_ok=True)
    lines = spark.readStream.schema("value string").text(incoming).withColumn("file", F.col("_metadata.file_name"))
    records = parse_jsonl(lines, source)
    writer = records.writeStream.foreachBatch(lambda batch, _: merge_batch(batch, path, today))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count an event stream (ts, event_type, value) by calendar window and type; events later than ``late`` are left out."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
