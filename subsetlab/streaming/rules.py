"""Rules with memory on a stream of records: the first version of a draw stays, and results that come late or never.

Records have source, draw_id, the content columns and received_at. Both rules are keyed state with findings as output, so a
restart from the checkpoint goes on where it ended, and nothing that was stored is read again.

* ``first_versions``: a key is a shelf, the source's draws whose ids differ in the last characters only. State: for each of them the
  first content, and the other ones already reported, as one value: a call to the state costs far more than a row.
* ``overdue``: a key is a source's day, so that a source with very many rows is many keys. A record says by itself that its
  own day has a result, and that the draw days of the next fortnight are expected; expected days have a timer at
  their deadline.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from subsetlab.model import CONTENT
from subsetlab.operators import rules
from subsetlab.session import ship

FIELDS = CONTENT[1:]
FOUND = "source string, draw_id string, rule string, severity string, detail string, received_at timestamp, " + ", ".join(f"{c} {'date' if c == 'draw_date' else 'long'}" for c in FIELDS)
OVERDUE = "source string, day date, rule string, severity string, at timestamp"
#: The same as they leave the state: instants are microseconds, which no session's time zone touches; versions of a shelf are one row.
RAW_FOUND = "source string, draw_id array<string>, received_us array<long>, content array<string>, stays array<string>"
RAW_TOLD = OVERDUE.replace("at timestamp", "at long")
Found, Told = (Row(*[x.split()[0] for x in schema.split(", ")]) for schema in (RAW_FOUND, OVERDUE))
#: Last characters of an id that a shelf leaves open, and versions of a draw that it holds besides the first.
OPEN, HELD = 3, 16
#: How a null is written in a content, and what stands between its fields: no field has it, and it sorts before all that fields have.
NULL, BETWEEN = "<NA>", ","
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Later than any receipt: that of a record without one.
NEVER = 1 << 62


def _instant(micros: int) -> int | None:
    return None if micros == NEVER else micros


class FirstVersion(StatefulProcessor):
    """Keep the first content of each draw of a shelf; a later, different one is a finding, once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # In JSON: a list of lists of a draw_id, its first content and HELD others. Draws with more have them as keys of their own.
        self.shelf = handle.getValueState("shelf", "draws string")
        self.more = handle.getMapState("more", "version string", "received_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # A batch may hold several versions; each different one is held once, with its first receipt.
        batch: dict[str | None, dict[str, int]] = {}
        for r in rows:
            for draw_id, at, content in zip(r["draw_id"], r["received_us"], r["content"], strict=True):
                at = NEVER if at is None else at
                versions = batch.setdefault(draw_id, {})
                versions[content] = min(versions.get(content, at), at)
        stored = self.shelf.get() if self.shelf.exists() else None
        draws = {x[0]: x[1:] for x in json.loads(stored[0])} if stored else {}
        out, changed = [], False
        for draw_id, versions in batch.items():
            known = draws.setdefault(draw_id, [])
            for content in sorted(versions, key=lambda c: (versions[c], c)):
                if content in known:
                    continue
                if len(known) <= HELD:
                    known.append(content)
                    changed = True
                else:
                    name = (json.dumps([draw_id, content]),)
                    if self.more.containsKey(name):
                        continue
                    self.more.updateValue(name, (versions[content],))
                out.append((draw_id, _instant(versions[content]), content, known[0] if content != known[0] else None))
        if changed:
            self.shelf.update((json.dumps([[k, *v] for k, v in draws.items()]),))
        if out:
            yield Found(key[0], *map(list, zip(*out, strict=True)))

    def close(self) -> None:
        pass


class Overdue(StatefulProcessor):
    """Tell of a day whose result was expected and didn't come by its deadline, and of one that came after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "arrived_at long, expected boolean, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived, expected, told = self.state.get() if self.state.exists() else (None, False, False)
        before, due = arrived, None
        for r in rows:
            due = r["due_us"]
            if r["arrived"]:
                arrived = r["received_us"] if arrived is None else min(arrived, r["received_us"])
            elif not expected:
                expected = True
                if arrived is None:
                    self.handle.registerTimer(due // 1000)
        late = arrived is not None and due is not None and arrived > due
        if late and expected and not told:
            told = True
            yield Told(*key, "missed_deadline", "error", due)
        if late and before is None:
            yield Told(*key, "late_result", "warning", arrived)
        self.state.update((arrived, expected, told))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        arrived, expected, told = self.state.get()
        if arrived is None and expected and not told:
            self.state.update((arrived, expected, True))
            yield Told(*key, "missed_deadline", "error", expiredTimerInfo.getExpiryTimeInMs() * 1000)

    def close(self) -> None:
        pass


def first_versions(records: DataFrame) -> DataFrame:
    """Return FOUND: a row without a rule for each draw's first version, and a finding for each other version.

    Of versions in one batch the one received first counts (then the smaller one as text). Equal versions are one.
    Records without a source or draw_id are keys of their own (null); those without a receipt count as received last. What is output doesn't depend on how the
    records fall into batches, as long as batches come in the order of receipt.
    """
    content = F.concat_ws(BETWEEN, *[F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in FIELDS])
    shelf = F.left("draw_id", F.length("draw_id") - OPEN)
    own = records.select("source", shelf.alias("shelf"), "draw_id", F.unix_micros("received_at").alias("received_us"), content.alias("content"))
    ship(own.sparkSession)
    parts = ["draw_id", "received_us", "content"]

    def shelved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pa.Table.from_batches([b]).group_by(["source", "shelf"], use_threads=False).aggregate([(c, "list") for c in parts])
            yield from lists.rename_columns([x.removesuffix("_list") for x in lists.schema.names]).select(["source", "shelf", *parts]).to_batches()

    # What one read gives of a shelf travels as one row: Spark hands rows with state to Python value by value.
    own = own.mapInArrow(shelved, "source string, shelf string, draw_id array<string>, received_us array<long>, content array<string>")
    found = own.groupBy("source", "shelf").transformWithState(FirstVersion(), RAW_FOUND, "append", "none")
    each = found.select("source", F.inline(F.arrays_zip(*parts, "stays")))
    after, before = F.split("content", BETWEEN), F.split("stays", BETWEEN)
    fields = [F.nullif(after[i], F.lit(NULL)).cast("date" if c == "draw_date" else "long").alias(c) for i, c in enumerate(FIELDS)]
    changed = [F.when(before[i] != after[i], F.concat(F.lit(f"{c}: "), before[i], F.lit(" > "), after[i])) for i, c in enumerate(FIELDS)]
    late = F.col("stays").isNotNull()
    about = [F.when(late, F.lit(x)).alias(name) for name, x in (("rule", "stored_row_conflict"), ("severity", "error"))]
    detail = F.when(late, F.concat_ws(", ", *changed)).alias("detail")
    return each.select("source", "draw_id", *about, detail, F.timestamp_micros("received_us").alias("received_at"), *fields)


def overdue(records: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Return OVERDUE for the draw days of ``records`` (source, draw_date, received_at), each finding once.

    missed_deadline: a record of an earlier day (of LOOK_BACK_DAYS) was there by the day's deadline, none of the day was,
    and the stream's clock (the latest receipt less ``delay``) has passed it. late_result: the day's first record came
    after the deadline. Records received earlier than the clock are left out, as Spark does; those without a source,
    date or receipt too. A day that no draw is due on has no findings.
    """
    usable = records.where("source is not null and draw_date is not null and received_at is not null").select("source", "draw_date", "received_at")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from pa.Table.from_batches([b]).group_by(b.schema.names).aggregate([]).select(b.schema.names).to_batches()

    # A day's records that came at one instant say the same: a batch gives one of them, before each becomes a row for every day ahead.
    usable = usable.mapInArrow(distinct, "source string, draw_date date, received_at timestamp").withWatermark("received_at", delay)
    own = F.array(F.struct(F.col("draw_date").alias("day"), F.lit(True).alias("arrived")))
    ahead = F.transform(F.sequence(F.lit(1), F.lit(rules.LOOK_BACK_DAYS)), lambda k: F.struct(F.date_add("draw_date", k).alias("day"), F.lit(False).alias("arrived")))
    every = usable.select("source", "received_at", F.explode(F.concat(own, ahead)).alias("x")).select("source", "received_at", "x.day", "x.arrived")
    every = every.where(F.weekday("day").isin(*rules.WEEKDAYS)).withColumn("due", rules.deadline(F.col("day")))
    # What is expected only after its deadline is history, not overdue.
    every = every.where(F.col("arrived") | (F.col("received_at") <= F.col("due")))
    every = every.withColumns({"received_us": F.unix_micros("received_at"), "due_us": F.unix_micros("due")}).drop("due")
    ship(every.sparkSession)
    told = every.groupBy("source", "day").transformWithState(Overdue(), RAW_TOLD, "append", "eventTime")
    return told.withColumn("at", F.timestamp_micros("at"))


@contextmanager
def rocks(spark: SparkSession):
    """Start queries with state in RocksDB, which keyed state needs; the session's own setting comes back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def run(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream's findings to the Parquet folder ``path`` until all that is there has been read, and stop.

    Called again with the same folders it goes on with what has come since, after a failure as well.
    """
    with rocks(found.sparkSession):
        query = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
