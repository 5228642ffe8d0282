"""Clustering of messages into topics by session and time gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.functions.text import flatten_newlines
from tracemill.schema import event_time

# A gap over two hours starts a new topic; samples longer than fifteen
# characters are kept.
GAP_SECONDS = 2 * 60 * 60
_SAMPLE_MIN = 15


def _sample(text: Column, chars: int | None = None) -> Column:
    """Text as one line, its first characters only if a number is given."""
    flat = flatten_newlines(text)
    return F.when(F.length(flat) > _SAMPLE_MIN, F.left(flat, F.lit(chars)) if chars else flat)


def topics(
    hits: DataFrame, limit: int | None = None, gap_seconds: int = GAP_SECONDS, sample_chars: int | None = None
) -> DataFrame:
    """Topics among all hits, or among the best `limit`.

    The hits, ordered by time, are cut wherever the session changes or the gap is too long, so two interleaved
    sessions give alternating topics. A hit is compared with the one before it in its hour, or with the last one of
    the hour that has hits before; topics are counted within hours first, and hours are one row each.
    """
    best = hits.orderBy(F.desc("score"), "event_id").limit(limit) if limit is not None else hits
    rows = best.select(
        F.coalesce(F.nullif("session_id", F.lit("")), F.lit("unknown")).alias("session_id"),
        "event_id",
        "event_ts",
        F.unix_millis(event_time(F.col("event_ts"))).alias("ms"),
        _sample(F.col("text_redacted"), sample_chars).alias("sample"),
    ).withColumn("hour", F.floor(F.col("ms") / 3_600_000))
    place = F.struct("ms", "event_id", "session_id")
    hours = rows.groupBy("hour").agg(F.max(place).alias("last"))
    by_hour = W.orderBy("hour")
    hours = hours.select(F.col("hour").alias("_hour"), F.lag("last").over(by_hour).alias("_before"))
    within = W.partitionBy("hour").orderBy("ms", "event_id")
    before = F.coalesce(F.lag(place).over(within), F.col("_before"))
    starts = (
        before.isNull() | (before["session_id"] != F.col("session_id")) | (F.col("ms") - before["ms"] > gap_seconds * 1000)
    )
    marked = rows.join(hours, F.col("hour").eqNullSafe(F.col("_hour"))).withColumn("starts", starts.cast("int")).drop("_before", "_hour")
    sums = marked.groupBy("hour").agg(F.sum("starts").alias("n"))
    earlier = by_hour.rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("hour").alias("_hour"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_earlier"))
    numbered = (
        marked.withColumn("topic", F.sum("starts").over(within))
        .join(sums, F.col("hour").eqNullSafe(F.col("_hour")))
        .withColumn("topic", F.col("topic") + F.col("_earlier"))
    )
    order = F.struct("ms", "event_id")
    # the two earliest samples of each topic and hour, then of each topic: no topic is gathered
    early = W.partitionBy("topic", "hour").orderBy(F.col("sample").isNull(), "ms", "event_id")
    nth = F.row_number().over(early)
    shown = F.when((F.col("nth") <= 2) & F.col("sample").isNotNull(), F.struct("ms", "event_id", "sample"))
    numbered = numbered.withColumn("nth", nth)
    samples = F.transform(F.slice(F.array_sort(F.collect_list(shown)), 1, 2), lambda s: s["sample"])
    return numbered.groupBy("topic").agg(
        F.first("session_id").alias("session_id"),
        F.min_by("event_ts", order).alias("start"),
        F.max_by("event_ts", order).alias("end"),
        F.count("*").alias("count"),
        samples.alias("samples"),
    )


def session_topics(messages: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Topics of every session over any number of messages.

    Messages of a session that fall into one bucket as wide as the gap always belong
    together, so they are aggregated first. Only buckets are then walked in order: their
    number depends on the time a session spans, not on its messages.
    """
    rows = messages.where(F.col("event_time").isNotNull()).select(
        F.coalesce(F.nullif("session_id", F.lit("")), F.lit("unknown")).alias("session_id"),
        F.unix_millis("event_time").alias("ms"),
        _sample(F.col("text_redacted")).alias("sample"),
        "event_id",
    )
    width = gap_seconds * 1000
    buckets = (
        rows.withColumn("bucket", F.floor(F.col("ms") / width))
        .groupBy("session_id", "bucket")
        .agg(
            F.min("ms").alias("first_ms"),
            F.max("ms").alias("last_ms"),
            F.count("*").alias("n"),
            F.min(F.when(F.col("sample").isNotNull(), F.struct("ms", "event_id", "sample"))).alias("first"),
        )
    )
    by_bucket = W.partitionBy("session_id").orderBy("bucket")
    gap = F.col("first_ms") - F.lag("last_ms").over(by_bucket)
    numbered = buckets.withColumn(
        "starts", F.when(gap.isNull() | (gap > width), 1).otherwise(0)
    ).withColumn("topic", F.sum("starts").over(by_bucket))
    return numbered.groupBy("session_id", "topic").agg(
        F.min("first_ms").alias("start_ms"),
        F.max("last_ms").alias("end_ms"),
        F.sum("n").alias("count"),
        F.min("first")["sample"].alias("preview"),
    )
