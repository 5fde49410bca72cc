"""Parsers of raw content: DataFrames of (file, content) to records and parse errors.

A record has draw_id, draw_date, main (array of numbers), special, source and file. Content that doesn't parse gives a
row with ``error`` instead; nothing is dropped silently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.model import K, padded_id
from subsetlab.session import ship
from subsetlab.sources.result_pages import ParsePage

def parse_jsonl(raw: DataFrame, source: str = "mirror") -> DataFrame:
    """Parse JSON lines (columns file, value): date, id, result of 6 or 7 numbers, the seventh being the special one.

    Blank lines are skipped.
    """
    line = F.from_json("value", "date string, id string, result array<long>", {"mode": "PERMISSIVE"})
    rows = raw.where(F.trim("value") != "").select("file", line.alias("r"))
    day = F.try_to_date(F.col("r.date"), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.expr("try_to_date(r.date, 'yyyy-MM-dd')")
    number = F.col("r.id").try_cast("long")
    size = F.coalesce(F.size("r.result"), F.lit(-1))
    error = (
        F.when(F.col("r").isNull() | F.col("r.id").isNull(), "no object with an id").when(number.isNull(), "id is no number")
        .when(day.isNull(), "date is no date").when(~size.isin(K, K + 1), "result has no 6 or 7 numbers")
    )
    return rows.select(
        padded_id(number).alias("draw_id"), day.alias("draw_date"), F.array_sort(F.slice("r.result", 1, K)).alias("main"),
        F.try_element_at("r.result", F.lit(K + 1)).alias("special"), F.lit(source).alias("source"), "file", error.alias("error"),
    )


def parse_official(raw: DataFrame, source: str = "official") -> DataFrame:
    """Parse pages (columns file, content): JSON whose ``value`` holds ``Error`` and ``HtmlContent``, a table of draws.

    A row has a date, an id and balls; what follows a separator is the special number (``result_pages``).
    """
    ship(raw.sparkSession)
    parse = F.udtf(ParsePage, returnType="draw_id string, draw_date date, main array<bigint>, special bigint, error string")
    rows = raw.select("file", "content").lateralJoin(parse(F.col("content").outer()))
    return rows.select("draw_id", "draw_date", "main", "special", F.lit(source).alias("source"), "file", "error")


def between(records: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Keep records from start to end, both included; an open end is None."""
    if start:
        records = records.where(F.col("draw_date") >= F.lit(start).cast("date"))
    return records.where(F.col("draw_date") <= F.lit(end).cast("date")) if end else records
