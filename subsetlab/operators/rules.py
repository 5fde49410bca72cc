"""Rules for records, data sets and pairs of sources. Every rule gives rows: findings with rule, severity and detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subsetlab.model import CONTENT, K, MAIN, N

#: Weekdays of draws, Monday being 0: fixed values.
WEEKDAYS = (1, 3, 5)
#: Local hour of the draw, and hour by which its result is expected.
DRAW_HOUR, RESULT_HOUR, LOOK_BACK_DAYS = 18, 21, 14
ZONE = "Asia/Ho_Chi_Minh"
FINDING = "array<struct<rule:string,severity:string,detail:string>>"


def record_findings(records: DataFrame, today: Column) -> DataFrame:
    """Check records (draw_id, draw_date, main: array of numbers, special) one by one: draw_id, rule, severity, detail.

    All rules are columns of one projection; a record's findings leave it as an array. Some rules apply only if an
    earlier one holds: weekday if the date isn't in the future, order if numbers are distinct.
    """
    main, special, day = F.col("main"), F.col("special"), F.col("draw_date")
    distinct = F.size(F.array_distinct(main)) == F.size(main)

    def rule(broken: Column, name: str, severity: str, detail: Column) -> Column:
        found = F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))
        return F.when(F.coalesce(broken, F.lit(False)), found)

    text = F.concat_ws(",", F.transform(main, lambda x: x.cast("string")))
    future = day > today
    rules = [
        rule(~F.coalesce(F.col("draw_id").rlike(r"^[0-9]{5}$"), F.lit(False)), "draw_id_format", "error", F.col("draw_id")),
        rule(day.isNull(), "draw_date_parseable", "error", F.lit("")),
        rule(future, "not_future_dated", "error", day),
        rule(~future & ~F.weekday(day).isin(*WEEKDAYS), "draw_weekday", "warning", day),
        rule(F.coalesce(F.size(main), F.lit(-1)) != K, "main_count", "error", text),
        rule(F.exists(main, lambda x: x.isNull()), "main_integer", "error", text),
        rule(F.exists(main, lambda x: (x < 1) | (x > N)), "main_range", "error", text),
        rule(~distinct, "main_unique", "error", text),
        rule(distinct & (F.array_sort(main) != main), "main_sorted", "warning", text),
        rule(special.isNull(), "special_present", "warning", F.lit("")),
        rule((special < 1) | (special > N), "special_range", "error", special),
        rule(F.array_contains(main, special), "special_not_in_main", "error", special),
    ]
    out = records.select("draw_id", F.explode(F.array_compact(F.array(*rules))).alias("f"))
    return out.select("draw_id", "f.rule", "f.severity", "f.detail")


def exact_duplicates_removed(records: DataFrame, arrival: str) -> DataFrame:
    """Keep the first arrival of records alike in id and content."""
    w = Window.partitionBy(*CONTENT).orderBy(arrival)
    return records.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def id_conflicts(records: DataFrame) -> DataFrame:
    """Return ids with more than one content, and how many. Nulls are a value of their own."""
    return records.groupBy("draw_id").agg(F.count_distinct(F.struct(*CONTENT[1:])).alias("contents")).where("contents > 1")


def last_by_id(records: DataFrame, arrival: str) -> DataFrame:
    """Keep the last arrival of each id."""
    others = [c for c in records.columns if c != "draw_id"]
    return records.groupBy("draw_id").agg(F.max_by(F.struct(*others), arrival).alias("_r")).select("draw_id", "_r.*").select(*records.columns)


def duplicate_content(draws: DataFrame) -> DataFrame:
    """Return draws with the numbers of an earlier one (whatever the date), and the first that had them."""
    w = Window.partitionBy(*MAIN, "special_number").orderBy(F.col("draw_id").cast("long"))
    return draws.withColumn("first_id", F.first("draw_id").over(w)).where("first_id <> draw_id").select("draw_id", "first_id")


def with_previous(draws: DataFrame, columns: list[str], order: str = "t") -> DataFrame:
    """Add prev_<column> of the row before by ``order`` (whole numbers, a step of one apart or more).

    Rows are chunked by order; each chunk hands its last row on. So no task holds all rows, as it would with one
    window over the table.
    """
    chunk = F.floor(F.col(order) / 100_000)
    rows = draws.withColumn("_chunk", chunk)
    last = rows.groupBy("_chunk").agg(*[F.max_by(c, order).alias(f"_last_{c}") for c in columns])
    w = Window.orderBy("_chunk")
    handed = last.select("_chunk", *[F.lag(f"_last_{c}").over(w).alias(f"_last_{c}") for c in columns])
    own = Window.partitionBy("_chunk").orderBy(order)
    out = rows.withColumns({f"prev_{c}": F.lag(c).over(own) for c in columns} | {"_rn": F.row_number().over(own)}).join(handed, "_chunk")
    for c in columns:
        out = out.withColumn(f"prev_{c}", F.when(F.col("_rn") == 1, F.col(f"_last_{c}")).otherwise(F.col(f"prev_{c}")))
    return out.drop("_chunk", "_rn", *[f"_last_{c}" for c in columns])


def chronology(draws: DataFrame) -> DataFrame:
    """Return draws dated on or before the draw before them."""
    return with_previous(draws, ["draw_id", "draw_date"]).where("draw_date <= prev_draw_date").select("draw_id", "draw_date", "prev_draw_id", "prev_draw_date")


def continuity(draws: DataFrame) -> DataFrame:
    """Return draws whose number does not follow the one before."""
    no = draws.withColumn("no", F.col("draw_id").cast("long"))
    return with_previous(no, ["no"], "no").where("no <> prev_no + 1").select("draw_id", "prev_no")


def scheduled(spark, first: Column, last: Column) -> DataFrame:
    """Return all draw days (day) from first to last."""
    days = spark.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("day"))
    return days.where(F.weekday("day").isin(*WEEKDAYS))


def deadline(day: Column) -> Column:
    """Return the instant by which a day's result is expected."""
    return F.to_utc_timestamp(F.to_timestamp(day) + F.expr(f"interval {RESULT_HOUR} hours"), ZONE)


def expected_latest(spark, as_of: Column) -> DataFrame:
    """Return the latest draw day whose result is due at ``as_of`` (an instant in UTC)."""
    today = F.to_date(F.from_utc_timestamp(as_of, ZONE))
    return scheduled(spark, F.date_sub(today, LOOK_BACK_DAYS), today).where(deadline(F.col("day")) <= as_of).agg(F.max("day").alias("day"))


def missed_dates(draws: DataFrame, as_of: Column) -> DataFrame:
    """Return draw days after the last draw whose result is due but not there."""
    last = draws.agg(F.max("draw_date").alias("last"))
    today = F.to_date(F.from_utc_timestamp(as_of, ZONE))
    days = last.select(F.explode(F.sequence(F.col("last"), F.greatest(F.col("last"), today), F.expr("interval 1 day"))).alias("day"), "last")
    due = days.where((F.col("day") > F.col("last")) & F.weekday("day").isin(*WEEKDAYS) & (deadline(F.col("day")) <= as_of))
    return due.select("day").join(draws.select(F.col("draw_date").alias("day")), "day", "left_anti")


def cadence_gaps(draws: DataFrame) -> DataFrame:
    """Return draw days that lie between two consecutive draws, with the draw after them."""
    between = with_previous(draws, ["draw_date"]).where(F.datediff("draw_date", "prev_draw_date") > 1)
    inner = F.sequence(F.date_add("prev_draw_date", 1), F.date_sub("draw_date", 1), F.expr("interval 1 day"))
    return between.select("draw_id", F.explode(inner).alias("day")).where(F.weekday("day").isin(*WEEKDAYS))


def _texts(df: DataFrame) -> DataFrame:
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("<NA>")).alias(c) for c in CONTENT[1:]]
    return df.select("draw_id", F.array(*[F.struct(F.lit(c).alias("field"), x.alias("value")) for c, x in zip(CONTENT[1:], cells, strict=True)]).alias("cells"))


def reconcile_fields(left: DataFrame, right: DataFrame) -> DataFrame:
    """Return (draw_id, field, left_value, right_value) for each differing field of ids that both sides have."""
    both = _texts(left).join(_texts(right).withColumnRenamed("cells", "others"), "draw_id")
    pairs = both.select("draw_id", F.explode(F.arrays_zip("cells", "others")).alias("x"))
    return pairs.where("x.cells.value <> x.others.value").select("draw_id", "x.cells.field", F.col("x.cells.value").alias("left_value"), F.col("x.others.value").alias("right_value"))


def only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("draw_id").join(right.select("draw_id"), "draw_id", "left_anti")


def assess_reconcile(left: DataFrame, right: DataFrame, published: DataFrame, tolerated: int = 3) -> DataFrame:
    """Return draw_id, rule, level and whether it blocks publication.

    A differing field fails, and blocks ids that aren't published. An id on the left alone lags if it is above the
    right's largest (the first ``tolerated`` are information), else it is a warning, as is one on the right alone.
    """
    rows = reconcile_fields(left, right).select("draw_id").distinct()
    blocked = rows.join(published.select("draw_id", F.lit(True).alias("known")), "draw_id", "left")
    fails = blocked.select("draw_id", F.lit("mismatch").alias("rule"), F.lit("FAIL").alias("level"), F.col("known").isNull().alias("blocking"))
    top = right.agg(F.max(F.col("draw_id").cast("long")).alias("top"))
    lone = only_in(left, right).crossJoin(F.broadcast(top)).withColumn("late", F.coalesce(F.col("draw_id").cast("long") > F.col("top"), F.lit(True)))
    # What lags behind the right's end: few, or the mirror is out of date as a whole.
    late = lone.where("late").select("draw_id")
    # A top-k of few rows, not an order of all.
    first = F.broadcast(late.orderBy(F.col("draw_id").cast("long")).limit(tolerated).withColumn("few", F.lit(True)))
    lag = late.join(first, "draw_id", "left").select("draw_id", F.lit("mirror_lag").alias("rule"), F.when(F.col("few"), "INFO").otherwise("WARN").alias("level"), F.lit(False).alias("blocking"))
    old = lone.where("not late").select("draw_id", F.lit("only_left").alias("rule"), F.lit("WARN").alias("level"), F.lit(False).alias("blocking"))
    other = only_in(right, left).select("draw_id", F.lit("only_right").alias("rule"), F.lit("WARN").alias("level"), F.lit(False).alias("blocking"))
    return fails.unionByName(lag).unionByName(old).unionByName(other)


def stored_conflicts(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Return fields in which an incoming record differs from the stored one; history isn't rewritten."""
    return reconcile_fields(stored, incoming)


def merge_new(stored: DataFrame, incoming: DataFrame, bad_ids: DataFrame) -> DataFrame:
    """Append-only merge: stored rows, and incoming ones with new ids that no error names."""
    fresh = incoming.join(stored.select("draw_id"), "draw_id", "left_anti").join(bad_ids.select("draw_id").distinct(), "draw_id", "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def lineage_missing(staged: DataFrame, parsed: DataFrame) -> DataFrame:
    """Return staged rows that no parsed raw row equals in all content (nulls equal)."""
    same = [staged[c].eqNullSafe(parsed[c]) for c in CONTENT]
    condition = same[0]
    for x in same[1:]:
        condition = condition & x
    return staged.join(parsed, condition, "left_anti")


def latest_runs(log: DataFrame) -> DataFrame:
    """Return each source's last run (columns source, run_id and more), in one pass."""
    others = [c for c in log.columns if c != "source"]
    return log.groupBy("source").agg(F.max_by(F.struct(*others), "run_id").alias("r")).select("source", "r.*")
