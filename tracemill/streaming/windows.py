"""Reports that a stream of events keeps current.

Rows are stored once each, and every batch computes anew the parts of the report that it touches, from all stored
rows of these parts. So nothing is late, nothing counts twice, and at any time the report equals the batch report
over what has arrived. There is no state but the store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.operators.store import append_new
from tracemill.operators.topics import GAP_SECONDS, session_topics
from tracemill.operators.usage import usage
from tracemill.streaming.ingest import POLL, start

#: Sessions of one number are computed together and stored in one folder.
SESSION_PARTS = 64


def keep_current(
    stream: DataFrame,
    folder: str,
    key: str,
    report: Callable[[DataFrame, DataFrame], DataFrame],
    poll: str | None = POLL,
    part: Column | None = None,
) -> StreamingQuery:
    """Keep `report(stored rows, batch)` current below folder.

    The report's rows have a column `part`; the parts a batch returns replace those stored. A batch that is run
    again after a failure stores nothing twice and computes the same parts. Where rows know their part (a small
    number), they are stored by it, and a batch reads the parts of its rows and no others.
    """

    def work(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        if part is None:
            append_new(batch, f"{folder}/store", key)
            stored = batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/store")
        else:
            batch = batch.withColumn("part", part)
            append_new(batch, f"{folder}/store", key, ("part",))
            numbers = [r.part for r in batch.select("part").distinct().collect()]
            stored = batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/store").where(F.col("part").isin(numbers))
        rows = report(stored, batch)
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("part").parquet(f"{folder}/report")

    return start(stream, work, f"{folder}/checkpoint", poll)


def _message() -> list[Column]:
    message = F.coalesce(F.nullif("message_id", F.lit("")), F.col("event_id"))
    return [F.col("source_id").alias("source_id"), message.alias("message")]


def _days(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Token sums and cost of the days that have events of the batch's messages.

    The events of one message may lie on several days and the first of them decides, so all events of all messages
    of these days are looked at. A day whose messages have moved to another keeps a row of zeros.
    """
    keys = ["source_id", "message"]
    keyed = stored.withColumns({c: m for c, m in zip(keys, _message(), strict=True)})
    arrived = batch.select(*_message()).distinct()
    day = F.split_part("event_ts", F.lit("T"), F.lit(1)).alias("day")
    days = keyed.join(arrived, keys, "left_semi").select(day).distinct()
    there = keyed.withColumn("day", day).join(days, "day", "left_semi").select(*keys).distinct()
    sums = usage(keyed.join(there, keys, "left_semi").drop("message"), "day")
    counted = [c for c in sums.columns if c != "day"]
    return days.join(sums, "day", "left").select(
        "day", *(F.coalesce(c, F.lit(0).cast(sums.schema[c].dataType)).alias(c) for c in counted), F.col("day").alias("part")
    )


def usage_by_day(events: DataFrame, folder: str, poll: str | None = POLL) -> StreamingQuery:
    return keep_current(events, folder, "event_id", _days, poll)


def _part() -> Column:
    return F.pmod(F.xxhash64("session_id"), F.lit(SESSION_PARTS)).cast("int")


def session_activity(
    messages: DataFrame, folder: str, poll: str | None = POLL, gap_seconds: int = GAP_SECONDS
) -> StreamingQuery:
    """Runs of messages of a session without a gap longer than two hours."""

    def report(stored: DataFrame, batch: DataFrame) -> DataFrame:
        return session_topics(stored.drop("part"), gap_seconds).withColumn("part", _part())

    return keep_current(messages, folder, "event_id", report, poll, _part())


def read_report(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/report").drop("part")
