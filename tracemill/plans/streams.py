"""Streaming jobs over the driver tables, run until all present data is read."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.plans import views as V
from tracemill.plans.activity import EV, MSG
from tracemill.plans import usage  # noqa: F401
from tracemill.plans.registry import REGISTRY, register
from tracemill.session import run_folder
from tracemill.streaming import ingest as G
from tracemill.streaming import windows as X


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = V.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _in_pieces(rows: DataFrame, order: Column, folder: str, pieces: int = 4) -> Iterator[DataFrame]:
    """Rows as a stream that gains a quarter of them, out of order, before each look; some rows come twice."""
    piece = F.pmod(F.xxhash64(order), F.lit(pieces))
    again = rows.where(F.pmod(F.xxhash64(order, F.lit(1)), F.lit(5)) == 0).withColumn("_piece", F.pmod(piece + 1, F.lit(pieces)))
    landed = rows.withColumn("_piece", piece).unionByName(again)
    for i in range(pieces):
        landed.where(F.col("_piece") == i).drop("_piece").write.mode("append").parquet(f"{folder}/in")
        yield rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/in")


@register(
    "stream_append",
    EV + "SELECT event_id, source_kind, event_date, event_type FROM ev",
)
def stream_append(spark, sf):
    folder = run_folder(spark, "stream-append")
    columns = ("event_id", "source_kind", "event_date", "event_type")
    events = V.events_of(spark, _stream(spark, sf, "events")).select(*columns)
    # The second run meets a store that holds everything already.
    for run in ("first", "second"):
        query = G.append_stream(events, f"{folder}/store", f"{folder}/{run}", poll=None)
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/store").select(
        "event_id", "source_kind", F.col("event_date").cast("string").alias("event_date"), "event_type"
    )


@register(
    "stream_daily_tokens",
    REGISTRY["usage_by_day"].sql,
)
def stream_daily_tokens(spark, sf):
    folder = run_folder(spark, "stream-tokens")
    for events in _in_pieces(V.agent_events(spark, sf, False), F.col("event_id"), folder):
        X.usage_by_day(events, folder, poll=None).awaitTermination()
    return X.read_report(spark, folder)


@register(
    "stream_session_activity",
    MSG
    + """, lagged AS (SELECT *, lag(event_time) OVER (PARTITION BY session_id ORDER BY event_time) AS prev
        FROM msg),
      numbered AS (SELECT *, sum(CASE WHEN prev IS NULL OR event_time - prev > INTERVAL 2 HOUR
        THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY event_time) AS topic FROM lagged)
    SELECT session_id, count(*) AS "count", epoch_ms(min(event_time)) AS first_ms,
      epoch_ms(max(event_time)) AS last_ms FROM numbered GROUP BY session_id, topic""",
)
def stream_session_activity(spark, sf):
    folder = run_folder(spark, "stream-sessions")
    for messages in _in_pieces(V.messages_of(spark, V.table(spark, sf, "conversations")), F.col("event_id"), folder):
        X.session_activity(messages, folder, poll=None).awaitTermination()
    return X.read_report(spark, folder).select(
        "session_id", "count", F.col("start_ms").alias("first_ms"), F.col("end_ms").alias("last_ms")
    )
