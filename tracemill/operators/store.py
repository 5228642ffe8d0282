"""Writes: append without duplicates, upsert, delete, registration."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.schema import EVENTS
from tracemill.session import discard, written

PARTITIONS = ("event_date", "source_kind")
#: Buckets of the key table; an append reads those that its keys fall into.
BUCKETS = 64


def _first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def new_rows(new: DataFrame, old: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows of `new` whose key is in neither `old` nor an earlier row of `new`.

    Of rows with one key the first in its source counts. The key alone decides, whatever day or kind a row has.
    Stored keys are first reduced to those that occur in `new`; the rest is an anti-join.
    """
    order = [c for c in ("source_id", "source_seq", "event_ts") if c in new.columns]
    incoming = _first_of_each(new, [key], [F.col(c).asc_nulls_last() for c in order] or [F.col(key)])
    clash = old.select(key).join(new.select(key).distinct(), key, "left_semi").distinct()
    return incoming.join(clash, key, "left_anti")


def _read(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """A stored table, or None where nothing is."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table; only a path that isn't there is an empty one."""
    found = _read(spark, path, schema)
    return spark.createDataFrame([], schema) if found is None else found


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Stored rows; only a path that isn't there is an empty store."""
    found = _read(spark, path, like.schema)
    return spark.createDataFrame([], like.schema) if found is None else found


def key_folder(path: str) -> str:
    """Where the keys of a store are kept, beside it."""
    return path.rstrip("/") + "_keys"


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


def append_new(
    new: DataFrame, path: str, key: str = "event_id", partitions: tuple[str, ...] = PARTITIONS
) -> None:
    """Append the rows whose key is not stored yet, partitioned by day and source kind unless told otherwise.

    The keys of a store are a narrow table of their own in buckets, of which those of the new keys are read. Rows are
    written before their keys. What a broken run left without keys is found when it is repeated, by a look at the
    stored rows of the same days and kinds; a store without a key table gives its keys once. The new rows are read
    several times, so they are a table for the time of the write. The rebalance hint splits a partition that holds
    most of the rows.
    """
    spark = new.sparkSession
    parts = [c for c in partitions if c in new.columns]
    batch = written(new, "append")
    stored = _stored(spark, path, new)
    ids = batch.select(key, *parts).distinct()
    kept = _read(spark, key_folder(path), f"{key} string, bucket int")
    if kept is None:
        known = stored.select(key)
    else:
        buckets = [r.bucket for r in ids.select(_bucket(key)).distinct().collect()]  # at most BUCKETS numbers
        near = stored.select(key, *parts).join(ids, [key, *parts], "left_semi").select(key)
        known = kept.where(F.col("bucket").isin(buckets)).select(key).unionAll(near)
    known = written(known.join(ids.select(key).distinct(), key, "left_semi").distinct(), "append-known")
    fresh = new_rows(batch, known, key)
    if parts:
        fresh = fresh.hint("rebalance", *parts)
    unkeyed = ids.select(key).distinct()
    if kept is None:
        unkeyed = unkeyed.unionAll(stored.select(key)).distinct()
    else:
        unkeyed = unkeyed.join(kept.where(F.col("bucket").isin(buckets)).select(key), key, "left_anti")
    unkeyed = written(unkeyed.select(key, _bucket(key)), "append-keys")
    fresh.write.mode("append").partitionBy(*parts).parquet(path)
    unkeyed.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(key_folder(path))
    discard(batch, known, unkeyed)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` with the rows of `new` replacing or joining it; the last row of a key wins.

    Rows of `new` need an `upsert_seq` column when a key may occur twice in it. Stored rows meet keys only; what
    stays isn't shuffled when the keys of `new` are few.
    """
    latest = new
    if "upsert_seq" in new.columns:
        latest = _first_of_each(new, keys, [F.desc("upsert_seq")]).drop("upsert_seq")
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(latest)


def delete(table: DataFrame, condition: Column | None = None) -> DataFrame:
    """Rows that stay; without a condition none do. NULL conditions keep the row."""
    if condition is None:
        return table.where(F.lit(False))
    return table.where(~F.coalesce(condition, F.lit(False)))


def purge(
    source_id: str, sources: DataFrame, progress: DataFrame, events: DataFrame, purge_events: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables after a source is removed; its events go only when asked for."""
    gone = F.col("source_id") == source_id
    return (
        delete(sources, gone),
        delete(progress, gone),
        delete(events, gone) if purge_events else events,
    )


def register(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Get-or-create: `existing` plus the wanted rows whose keys are not in it."""
    rest = [F.col(c) for c in wanted.columns if c not in keys]
    first = _first_of_each(wanted, keys, rest or [F.col(keys[0])])
    fresh = first.join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh)


def source_rows(files: DataFrame, device_id: str, now: str) -> DataFrame:
    """Source rows of `(locator, kind)`; the id is a hash of locator and device."""
    identity = F.concat_ws(":", F.lit(device_id), "locator")
    return files.select(
        F.concat(F.lit("src_"), F.left(F.sha2(identity, 256), F.lit(32))).alias("source_id"),
        "kind",
        "locator",
        F.lit(device_id).alias("device_id"),
        F.lit("active").alias("status"),
        F.lit(now).alias("last_seen_at"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(now).alias("created_at"),
    )


def set_status(
    sources: DataFrame, updates: DataFrame, now: str
) -> DataFrame:
    """Sources with the status and error of `updates` where there is one."""
    news = updates.select(
        "source_id", F.col("status").alias("new_status"), F.col("error_message").alias("new_error")
    )
    changed = F.col("new_status").isNotNull()
    return (
        sources.join(news, "source_id", "left")
        .withColumns(
            {
                "error_message": F.when(changed, F.col("new_error")).otherwise(F.col("error_message")),
                "last_seen_at": F.when(changed, F.lit(now)).otherwise(F.col("last_seen_at")),
                "status": F.coalesce("new_status", "status"),
            }
        )
        .drop("new_status", "new_error")
    )


def ingest_report(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Per source: lines read, events created, lines that could not be read.

    `lines` holds `source_id` and a boolean `failed`; `events` holds `source_id`.
    """
    read = lines.groupBy("source_id").agg(
        F.count("*").alias("lines_processed"), F.count_if("failed").alias("errors")
    )
    made = events.groupBy("source_id").agg(F.count("*").alias("events_created"))
    return read.join(made, "source_id", "left").select(
        "source_id",
        "lines_processed",
        F.coalesce("events_created", F.lit(0)).alias("events_created"),
        "errors",
    )
