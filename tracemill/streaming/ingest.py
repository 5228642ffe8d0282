"""Ingestion of growing files, in runs or continuously: new lines in, new events appended to the store.

Both take the lines that were added since the place recorded in the progress table beside the store, append their
events, and record how far they came. Events are written before progress, and ids depend on place and content alone,
so a run that broke off is repeated without loss or repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.operators.store import append_new, read_table
from tracemill.session import discard, written
from tracemill.sources import jsonl, tail, transcript

# Fixed value: how often sources are looked at.
POLL = "5 seconds"


def progress_folder(store: str) -> str:
    """Where the progress of a store is kept, beside it."""
    return store.rstrip("/") + "_progress"


def progress(spark: SparkSession, store: str) -> DataFrame:
    return read_table(spark, progress_folder(store), tail.PROGRESS)


def _record(lines: DataFrame, store: str, run: str, taken: DataFrame | None = None) -> DataFrame:
    """Append and return how far the lines go: a row for every path."""
    done = lines.groupBy("path", "start").agg(
        F.max(F.col("pos") + F.col("bytes")).alias("offset"),
        F.max("modified").alias("modified"),
        F.count(F.lit(1)).alias("lines"),
        F.sum("bytes").alias("bytes"),
    )
    if taken is None:
        done = done.withColumn("next_seq", F.lit(0))
    else:
        done = done.join(taken, "path", "left").withColumn("next_seq", F.coalesce("next_seq", F.lit(0)))
    done = written(
        done.select("path", "start", "offset", "modified", F.col("next_seq").cast("long").alias("next_seq"), "lines", "bytes", F.lit(run).alias("run")),
        "progress",
    )
    done.write.mode("append").parquet(progress_folder(store))
    return done


def take_sessions(
    lines: DataFrame, store: str, device_id: str, ingest_ts: str, run: str | None = None, redact_secrets: bool = True
) -> DataFrame:
    """Events of added lines into the store; the rows of progress of this run.

    The positions of a file go on where its lines before ended, which is looked up by the place at which these begin:
    a batch that is repeated finds the same.
    """
    lines = written(lines, "session-lines")
    starts = lines.select("path", "start").distinct()
    known = progress(lines.sparkSession, store).select("path", F.col("offset").alias("start"), "next_seq")
    first = known.join(starts, ["path", "start"]).where("start > 0").groupBy("path").agg(F.max("next_seq").alias("next_seq"))
    first = written(first, "session-starts")
    rows = written(jsonl.numbered(lines), "session-pieces")
    append_new(jsonl.events_of(rows, device_id, ingest_ts, redact_secrets, first), store)
    taken = rows.groupBy("path").agg(F.sum("taken").alias("_n")).join(first, "path", "left")
    taken = taken.select("path", (F.col("_n") + F.coalesce("next_seq", F.lit(0))).alias("next_seq"))
    done = _record(lines, store, run or ingest_ts, taken)
    discard(lines, first, rows)
    return done


def take_transcripts(
    lines: DataFrame, store: str, device_id: str, ingest_ts: str, run: str | None = None, redact_secrets: bool = True
) -> DataFrame:
    """Events of whole transcripts into the store; those that it holds stay as they were first stored."""
    lines = written(lines, "transcript-lines")
    append_new(transcript.normalize(lines, device_id, ingest_ts, redact_secrets), store)
    done = _record(lines, store, run or ingest_ts)
    discard(lines)
    return done


#: For every kind of source: the names of its files, whether changed files are read whole, and what takes them in.
KINDS = {
    "sessions": ("*.jsonl", False, take_sessions),
    "transcripts": ("*.txt", True, take_transcripts),
}


def ingest_grown(
    spark: SparkSession, path: str, store: str, kind: str, device_id: str, ingest_ts: str, redact_secrets: bool = True
) -> DataFrame:
    """Read what was added to the files below a folder since the last run, and nothing else; progress of this run.

    ingest_ts names the run and must not decrease from run to run.
    """
    glob, whole, take = KINDS[kind]
    found = tail.grown(spark, path, glob, progress(spark, store), whole)
    found = written(found, "grown")
    done = take(tail.lines(found), store, device_id, ingest_ts, None, redact_secrets)
    discard(found)
    return done


def start(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, poll: str | None
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    trigger = writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)
    return trigger.start()


def _follow(
    spark: SparkSession, kind: str, path: str, store: str, checkpoint: str, device_id: str, ingest_ts: str, poll: str | None, max_files: int | None
) -> StreamingQuery:
    """Stream of the lines that files gain. Rows are never dropped for being late.

    Without `poll` the query ends when all that is there is read, in one batch; `max_files` bounds the batches of a
    query that goes on.
    """
    glob, whole, take = KINDS[kind]
    lines = tail.stream(spark, path, glob, whole, max_files if poll else None)

    def work(batch: DataFrame, number: int) -> None:
        take(batch, store, device_id, ingest_ts, f"{ingest_ts}#{number:09}")

    return start(lines, work, checkpoint, poll)


def ingest_sessions(
    spark: SparkSession,
    path: str,
    store: str,
    checkpoint: str,
    device_id: str,
    ingest_ts: str,
    poll: str | None = POLL,
    max_files: int | None = None,
) -> StreamingQuery:
    return _follow(spark, "sessions", path, store, checkpoint, device_id, ingest_ts, poll, max_files)


def ingest_transcripts(
    spark: SparkSession,
    path: str,
    store: str,
    checkpoint: str,
    device_id: str,
    ingest_ts: str,
    poll: str | None = POLL,
    max_files: int | None = None,
) -> StreamingQuery:
    """A transcript's lines mean something by what stands before them: a changed file is read from its start."""
    return _follow(spark, "transcripts", path, store, checkpoint, device_id, ingest_ts, poll, max_files)


def append_stream(
    events: DataFrame, store: str, checkpoint: str, poll: str | None = POLL
) -> StreamingQuery:
    """Append a stream of canonical events, ignoring ids that are stored already."""
    return start(events, lambda batch, _: append_new(batch, store), checkpoint, poll)


def without_repeats(events: DataFrame, delay: str) -> DataFrame:
    """Live feeds only: drops repeated ids within `delay`, and rows later than that.

    Back-filled files may be older than the watermark, so ingestion does not use this.
    """
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])
