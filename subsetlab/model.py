"""The data model: an ordered series of draws of K distinct numbers out of 1..N, and a special one from the rest.

A table of draws has ``t`` (ordinal from 1), ``draw_id`` (text, five digits at least), ``draw_date``, ``n1`` to ``n6``
(rising) and ``special_number`` (may be null). ``long`` has a row a main number, ``grid`` a row for each draw and number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N, K = 55, 6
#: Order lines in a task that derives draws.
PART_LINES = 200_000
#: Largest number of the low band.
LOW = 27
MAIN = [f"n{i}" for i in range(1, K + 1)]
CONTENT = ["draw_id", "draw_date", *MAIN, "special_number"]
#: The chance of a number in a draw, and of a special number.
P_MAIN, P_SPECIAL = K / N, 1 / N
#: First and last possible sum of a draw.
SUMS = (sum(range(1, K + 1)), sum(range(N - K + 1, N + 1)))


def padded_id(number: Column) -> Column:
    """Write a number with at least five digits; longer ones stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text)


def with_ordinal(df: DataFrame, coarse: str, fine: str, name: str = "t") -> DataFrame:
    """Number rows from 1 by (coarse, fine) without sorting all rows in one task.

    Rows are counted by ``coarse``; the counts, far fewer than the rows, are summed up in order; rows are numbered
    within their coarse value.
    """
    before = Window.orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(coarse).agg(F.count(F.lit(1)).alias("_n"))
    bases = counts.select(coarse, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(coarse).orderBy(fine))
    return df.withColumn("_own", own).join(bases, coarse).withColumn(name, (F.col("_base") + F.col("_own")).cast("long")).drop("_own", "_base")


def derive_draws(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Derive a series of draws from order lines: an order's first six distinct numbers, and a seventh as the special one.

    A line's number is ``l_partkey % N + 1``; lines go by line number and part. Orders with fewer than six distinct
    numbers are left out. Tasks get about ``PART_LINES`` lines each, so that a task's memory doesn't grow with the tables;
    counting the lines reads no rows of a Parquet table.
    """
    parts = max(1, math.ceil(lineitem.count() / PART_LINES))
    place = F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")
    lines = lineitem.select("l_orderkey", (F.col("l_partkey") % N + 1).cast("long").alias("num"), place.alias("place"))
    # An order's lines meet once; both groupings keep this partitioning.
    lines = lines.repartition(parts, "l_orderkey")
    numbers = lines.groupBy("l_orderkey", "num").agg(F.min("place").alias("first"))
    numbers = numbers.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("first", "num"))).alias("found"))
    numbers = numbers.where(F.size("found") >= K)
    main = F.array_sort(F.transform(F.slice("found", 1, K), lambda x: x["num"]))
    special = F.try_element_at("found", F.lit(K + 1))["num"]
    made = numbers.select("l_orderkey", main.alias("main"), special.alias("special_number"))
    days = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("draw_date"))
    dated = made.join(days.repartition(parts, "l_orderkey"), "l_orderkey")
    # An order has a few lines, so days need fewer parts.
    numbered = with_ordinal(dated.repartition(math.ceil(parts / 4), "draw_date"), "draw_date", "l_orderkey")
    # A filter above may be evaluated before the one on the size, so short arrays must not raise.
    cells = [F.get("main", F.lit(i)).alias(c) for i, c in enumerate(MAIN)]
    return numbered.select("t", padded_id(F.col("t")).alias("draw_id"), "draw_date", *cells, "special_number")


def main_array() -> Column:
    return F.array(*MAIN)


def long(draws: DataFrame) -> DataFrame:
    """Return t, draw_date and num: a row for each main number."""
    return draws.select("t", "draw_date", F.explode(main_array()).alias("num"))


def numbers(df: DataFrame) -> DataFrame:
    """Return all numbers 1..N as ``num``."""
    return df.sparkSession.range(1, N + 1).select(F.col("id").alias("num"))


def grid(draws: DataFrame) -> DataFrame:
    """Return t, num and y: whether each number is in each draw (1 or 0), without a join."""
    cell = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(N).cast("long"))).alias("num")
    rows = draws.select("t", main_array().alias("_main"), cell)
    return rows.select("t", "num", F.array_contains("_main", F.col("num")).cast("long").alias("y"))


def fact_draw_number(draws: DataFrame) -> DataFrame:
    """Return draw_id, draw_date, position (1 to 6, 7 for a special number), number and is_special."""
    special = F.when(F.col("special_number").isNotNull(), F.array("special_number")).otherwise(F.array().cast("array<bigint>"))
    every = F.posexplode(F.concat(main_array(), special)).alias("position", "number")
    out = draws.select("draw_id", "draw_date", every)
    return out.select("draw_id", "draw_date", (F.col("position") + 1).cast("long").alias("position"), "number", (F.col("position") == K).alias("is_special"))


def dim_number(df: DataFrame) -> DataFrame:
    """Return number, parity, band and decade_group of 1..N."""
    n = F.col("num")
    tens = (n - n % 10).cast("int")
    return numbers(df).select(
        n.alias("number"), F.when(n % 2 == 1, "odd").otherwise("even").alias("parity"), F.when(n <= LOW, "low").otherwise("high").alias("band"),
        F.format_string("%02d-%02d", tens, tens + 9).alias("decade_group"),
    )


def content_version(draws: DataFrame) -> DataFrame:
    """Return draws and dataset_version: "ds_" and 12 hex digits of a digest over the content columns in the order of draw_id.

    The text is a header and a line a draw, with a line end each. One value over all rows needs them in one place, so
    this is for tables that fit there; see ``chunked_version`` for larger ones.
    """
    cells = [F.col(c) if c != "draw_date" else F.date_format(c, "yyyy-MM-dd") for c in CONTENT[:-1]]
    line = F.concat_ws(",", *cells, F.coalesce(F.col("special_number").cast("string"), F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("draw_id", line.alias("line")))), lambda x: x["line"])
    text = F.concat(F.lit(",".join(CONTENT) + "\n"), F.when(F.count(F.lit(1)) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(""))
    return draws.agg(F.count(F.lit(1)).alias("draws"), F.concat(F.lit("ds_"), F.substring(F.sha2(text, 256), 1, 12)).alias("dataset_version"))


def chunked_version(draws: DataFrame, rows: int = 100_000) -> DataFrame:
    """Return draws and chunk_version: a digest over the digests of chunks of ``rows`` draws by t, for tables of any size."""
    chunk = ((F.col("t") - 1) / rows).cast("long")
    parts = draws.withColumn("_chunk", chunk).groupBy("_chunk").agg(F.count(F.lit(1)).alias("n"), F.sha2(_lines(), 256).alias("digest"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "digest"))), lambda x: x["digest"])
    return parts.agg(F.sum("n").alias("draws"), F.concat(F.lit("dc_"), F.substring(F.sha2(F.array_join(every, "\n"), 256), 1, 12)).alias("chunk_version"))


def _lines() -> Column:
    cells = [F.col(c) if c != "draw_date" else F.date_format(c, "yyyy-MM-dd") for c in CONTENT[:-1]]
    line = F.concat_ws(",", *cells, F.coalesce(F.col("special_number").cast("string"), F.lit("")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", line.alias("line")))), lambda x: x["line"]), "\n")
