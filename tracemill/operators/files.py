"""File snapshots, edit history, reconstruction."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.functions.text import glob_to_like, like, line_count
from tracemill.operators.filters import (
    EventFilter,
    in_time_range,
    path_contains,
    path_equals,
    path_like,
)
from tracemill.schema import EDIT_TOOLS, FILE_TOOLS, SNAPSHOT_TOOLS, event_time

# Fixed value: a Read result belongs to a call less than five seconds away.
_READ_BAND_MS = 4999
_BUCKET_MS = 60000

_REPLAYED = pa.schema(
    [("file_path", pa.string()), ("edits", pa.int32()), ("applied", pa.int32()), ("failed", pa.int32())]
    + [("content", pa.string())]
)


def _restrict(events: DataFrame, flt: EventFilter) -> DataFrame:
    """Time range, exact project and exact session: file views take no wildcards."""
    in_range = in_time_range(flt.since, flt.until)
    if in_range is not None:
        events = events.where(in_range)
    if flt.project:
        events = events.where(F.col("project_id") == flt.project)
    if flt.session:
        events = events.where(F.col("session_id") == flt.session)
    return events


def _pair_keys(events: DataFrame, pairing: str) -> tuple[DataFrame, list[str]]:
    """Rows with the columns that tie a result to its call.

    `compat` pairs on the call id alone, also across sessions; `strict` pairs within a
    session on the call id or, without one, the use id.
    """
    if pairing == "strict":
        key = F.coalesce("call_id", "use_id")
        return events.withColumn("pair_key", key).where("pair_key is not null"), ["session_id", "pair_key"]
    return events.withColumn("pair_key", F.col("call_id")).where("pair_key is not null"), ["pair_key"]


def _snapshots(events: DataFrame) -> DataFrame:
    return events.where(
        (F.col("event_type") == "tool_result") & F.col("tool_name").isin(*SNAPSHOT_TOOLS)
    )


def latest_content(
    events: DataFrame, path: str, at: str | None = None, pairing: str = "compat"
) -> DataFrame:
    """Latest Read or Write result of a file, as of a moment if one is given.

    A result counts when its paths hold the text of the path, or when a call for the
    path shares its call id.
    """
    results = _restrict(_snapshots(events), EventFilter(until=at))
    latest = [F.desc("event_ts"), F.desc("event_id")]
    columns = ["event_id", "event_ts", "tool_name", F.col("text_redacted").alias("content")]

    named = F.exists("file_paths", lambda p: like(p, f"%{path}%"))
    by_path = results.where(named).select(*columns).orderBy(*latest).limit(1)

    calls, keys = _pair_keys(events.where((F.col("event_type") == "tool_call") & path_equals(path)), pairing)
    paired, _ = _pair_keys(results, pairing)
    by_call = (
        paired.join(calls.select(*keys).distinct(), keys, "left_semi")
        .select(*columns)
        .orderBy(*latest)
        .limit(1)
    )
    return by_path.unionByName(by_call).orderBy(*latest).limit(1)


def latest_contents(events: DataFrame, at: str | None = None, pairing: str = "compat") -> DataFrame:
    """Latest content of every file, one row per path, in one job.

    Paths are compared as a whole. Results are reduced to the latest per call id before
    they meet the paths of that call id, so a call id that repeats in many sessions does
    not pair everything with everything.
    """
    results = _restrict(_snapshots(events), EventFilter(until=at))
    last = F.max(F.struct("event_ts", "event_id")).alias("last")
    by_path = (
        results.select(F.explode("file_paths").alias("path"), "event_ts", "event_id").groupBy("path").agg(last)
    )

    paired, keys = _pair_keys(results, pairing)
    per_call = paired.groupBy(*keys).agg(last)
    calls, _ = _pair_keys(events.where(F.col("event_type") == "tool_call"), pairing)
    spelled = F.array_compact(F.array("arg_file_path", "arg_path", "arg_filepath"))
    wanted = calls.select(F.explode(spelled).alias("path"), *keys).distinct()
    by_call = wanted.join(per_call, keys).select("path", "last")

    best = (
        by_path.unionByName(by_call)
        .groupBy("path")
        .agg(F.max("last").alias("last"))
        .select("path", F.col("last.event_id").alias("event_id"))
    )
    content = results.select(
        "event_id", "event_ts", "tool_name", F.col("text_redacted").alias("content")
    )
    return best.join(content, "event_id")


def file_history(
    events: DataFrame,
    path: str,
    flt: EventFilter = EventFilter(),
    limit: int = 50,
    pairing: str = "compat",
) -> DataFrame:
    """Snapshots of a file over time: results whose call, of the same tool, names it."""
    results, keys = _pair_keys(_restrict(_snapshots(events), flt), pairing)
    calls, _ = _pair_keys(events.where((F.col("event_type") == "tool_call") & path_equals(path)), pairing)
    keys = ["tool_name", *keys]
    matched = results.join(calls.select(*keys).distinct(), keys, "left_semi")
    content = F.col("text_redacted")
    return (
        matched.select(
            "event_id",
            "event_ts",
            "tool_name",
            content.alias("content"),
            F.when(content == "", 0).otherwise(line_count(content)).alias("line_count"),
            "session_id",
            "project_id",
        )
        .orderBy("event_ts", "event_id")
        .limit(limit)
    )


def _edit_rows(events: DataFrame, flt: EventFilter, file_path: str | None) -> DataFrame:
    rows = _restrict(events, flt).where(
        (F.col("event_type") == "tool_call")
        & F.col("tool_name").isin(*EDIT_TOOLS)
        & F.col("tool_args_json").isNotNull()
    )
    if file_path:
        rows = rows.where(path_contains(file_path))

    def truthy(column: str) -> Column:
        return F.nullif(F.col(column), F.lit(""))

    shown = F.coalesce(truthy("arg_filepath"), truthy("arg_file_path"), truthy("arg_path"), F.lit("unknown"))
    return rows.select(
        "event_id",
        "event_ts",
        shown.alias("file_path"),
        F.coalesce("arg_old", F.lit("")).alias("old_string"),
        F.coalesce("arg_new", F.lit("")).alias("new_string"),
        "session_id",
        "project_id",
    )


def edits(
    events: DataFrame, flt: EventFilter = EventFilter(), file_path: str | None = None, limit: int = 20
) -> DataFrame:
    """Edit calls with old and new text, newest first."""
    rows = _edit_rows(events, flt, file_path)
    return rows.orderBy(F.desc("event_ts"), F.desc("event_id")).limit(limit)


def file_versions(
    events: DataFrame, path: str, flt: EventFilter = EventFilter(), limit: int = 20
) -> DataFrame:
    """Snapshots and edits of a file in one chronological list."""
    reads = file_history(events, path, flt, limit).select(
        "event_ts", F.lit("read").alias("type"), "tool_name", "line_count", "event_id"
    )
    changes = edits(events, flt, path, limit).select(
        "event_ts",
        F.lit("edit").alias("type"),
        F.lit("Edit").alias("tool_name"),
        line_count(F.col("old_string")).alias("old_lines"),
        line_count(F.col("new_string")).alias("new_lines"),
        "event_id",
    )
    merged = reads.unionByName(changes, allowMissingColumns=True)
    return merged.withColumn("line_delta", F.col("new_lines") - F.col("old_lines")).orderBy(
        event_time(F.col("event_ts")), "event_id"
    )


def file_events(
    events: DataFrame,
    path: str,
    flt: EventFilter = EventFilter(),
    tools: tuple[str, ...] = (),
    limit: int = 10,
) -> DataFrame:
    """Tool results whose own arguments name the file, newest first."""
    rows = _restrict(events, flt).where(
        (F.col("event_type") == "tool_result")
        & F.col("tool_name").isin(*FILE_TOOLS, "Glob", "Grep")
        & path_equals(path)
    )
    if tools:
        rows = rows.where(F.col("tool_name").isin(*tools))
    return (
        rows.select(
            "event_id",
            "event_ts",
            "tool_name",
            F.col("text_redacted").alias("content"),
            "session_id",
            "project_id",
        )
        .orderBy(F.desc("event_ts"), F.desc("event_id"))
        .limit(limit)
    )


def accessed_files(
    events: DataFrame,
    flt: EventFilter = EventFilter(),
    pattern: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """Files named by Read, Write and Edit calls, last accessed first."""
    path = F.coalesce("arg_file_path", "arg_path", "arg_filepath")
    rows = _restrict(events, flt).where(
        (F.col("event_type") == "tool_call") & F.col("tool_name").isin(*FILE_TOOLS) & path.isNotNull()
    )
    if pattern:
        rows = rows.where(path_like(glob_to_like(pattern)))
    return (
        rows.groupBy(path.alias("file_path"))
        .agg(
            F.max("event_ts").alias("last_accessed"),
            F.count("*").alias("access_count"),
            F.array_sort(F.collect_set("tool_name")).alias("tools_used"),
        )
        .orderBy(F.desc("last_accessed"), "file_path")
        .limit(limit)
    )


def is_whole_snapshot(content: Column, min_chars: int = 1, ending: str | None = None) -> Column:
    """Whether a Read result stands for its file: any that isn't empty.

    A caller who knows that results may be cut off can ask for a length and for an ending of the last ten characters.
    """
    whole = F.length(content) >= min_chars
    return whole & F.trim(F.right(content, F.lit(10))).rlike(ending) if ending else whole


def _read_calls(events: DataFrame, at: str | None) -> DataFrame:
    calls = events.where((F.col("event_type") == "tool_call") & (F.col("tool_name") == "Read"))
    return _restrict(calls, EventFilter(until=at)).withColumn("ms", F.unix_millis("event_time"))


def _read_results(events: DataFrame) -> DataFrame:
    results = events.where((F.col("event_type") == "tool_result") & (F.col("tool_name") == "Read"))
    return results.withColumn("ms", F.unix_millis("event_time"))


def read_snapshot(events: DataFrame, path: str, at: str | None = None) -> DataFrame:
    """Content read by the latest Read call for a path, if it looks whole.

    Of the results in the band around the call, the earliest is taken.
    """
    call = (
        _read_calls(events, at)
        .where(like(F.col("arg_filepath"), f"%{path}%"))
        .agg(F.max(F.struct("event_ts", "event_id", "ms")).alias("call"))
    )
    near = F.abs(F.col("ms") - call.select("call.ms").scalar()) <= _READ_BAND_MS
    return (
        _read_results(events)
        .where(near)
        .orderBy("ms", "event_id")
        .limit(1)
        .select(call.select("call.event_ts").scalar().alias("event_ts"), F.col("text_redacted").alias("content"))
        .where(is_whole_snapshot(F.col("content")))
    )


def read_snapshots(events: DataFrame, at: str | None = None) -> DataFrame:
    """`read_snapshot` for every path at once: (path, event_ts, content).

    The band join works on distinct moments: calls and results are reduced to one row
    per millisecond, and a range window within one-minute buckets finds the earliest
    result in reach. A busy minute holds a bounded number of moments however many events
    fall into it.
    """
    calls = (
        _read_calls(events, at)
        .where(F.col("arg_filepath").isNotNull())
        .groupBy(F.col("arg_filepath").alias("path"))
        .agg(F.max(F.struct("event_ts", "event_id", "ms")).alias("call"))
        .select("path", "call.event_ts", "call.ms")
    )
    results = _read_results(events)
    moments = results.groupBy("ms").agg(F.min("event_id").alias("event_id"))

    bucket = lambda ms: F.floor(ms / _BUCKET_MS)
    probes = (
        calls.select("ms")
        .distinct()
        .select(bucket(F.col("ms")).alias("bucket"), "ms", F.lit(None).cast("bigint").alias("result_ms"))
    )
    reach = F.array_distinct(
        F.array(bucket(F.col("ms") - _READ_BAND_MS), bucket(F.col("ms") + _READ_BAND_MS))
    )
    offers = moments.select(F.explode(reach).alias("bucket"), "ms", F.col("ms").alias("result_ms"))
    band = W.partitionBy("bucket").orderBy("ms").rangeBetween(-_READ_BAND_MS, _READ_BAND_MS)
    found = (
        probes.unionByName(offers)
        .withColumn("near_ms", F.min("result_ms").over(band))
        .where(F.col("result_ms").isNull() & F.col("near_ms").isNotNull())
        .select("ms", "near_ms")
    )
    chosen = found.join(moments.withColumnRenamed("ms", "near_ms"), "near_ms").select("ms", "event_id")
    content = results.select("event_id", F.col("text_redacted").alias("content"))
    return (
        calls.join(chosen, "ms")
        .join(content, "event_id")
        .where(is_whole_snapshot(F.col("content")))
        .select("path", "event_ts", "content")
    )


def _replayed(batches):
    """Folds rows sorted by file and time; a task holds the current content of one file."""
    file, state = None, None

    def closed():
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip((file, *state), _REPLAYED.types, strict=True)], schema=_REPLAYED
        )

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("file_path", "old_string", "new_string"))
        for path, old, new in zip(*columns, strict=True):
            if state is None or path != file:
                if state is not None:
                    yield closed()
                file, state = path, (0, 0, 0, old or "")
            edits, applied, failed, content = state
            if old == "" or new == "":
                pass
            elif old is not None and new is not None and old in content:
                applied, content = applied + 1, content.replace(old, new, 1)
            else:
                failed += 1
            state = (edits + 1, applied, failed, content)
    if state is not None:
        yield closed()


def replay_edits(rows: DataFrame) -> DataFrame:
    """Content of every file after all its edits, oldest first.

    Edits of one file follow each other by nature, so a file is one task's work; its edits are sorted on disk and
    stream through, and no row holds them together.
    """
    order = F.unix_micros(event_time(F.col("event_ts"))).alias("_at")
    return (
        rows.select("file_path", order, "event_id", "old_string", "new_string")
        .repartition("file_path")
        .sortWithinPartitions("file_path", "_at", "event_id")
        .mapInArrow(_replayed, "file_path string, edits int, applied int, failed int, content string")
    )


def reconstruct(
    events: DataFrame, path: str, at: str | datetime, session: str | None = None
) -> DataFrame:
    """Best-effort content of a file at a moment: a whole Read result, else its edits."""
    at = at.isoformat() if isinstance(at, datetime) else at
    read = read_snapshot(events, path, at).select(
        F.lit(1).alias("preference"),
        F.lit("read").alias("method"),
        F.lit(None).cast("int").alias("edits"),
        F.lit(None).cast("int").alias("applied"),
        F.lit(None).cast("int").alias("failed"),
        "content",
    )
    rows = _edit_rows(events, EventFilter(until=at, session=session), path)
    replayed = replay_edits(rows.withColumn("file_path", F.lit(path))).select(
        F.lit(2).alias("preference"), F.lit("edits").alias("method"), "edits", "applied", "failed", "content"
    )
    return read.unionByName(replayed).orderBy("preference").limit(1).drop("preference")


def reconstruct_all(events: DataFrame, at: str) -> DataFrame:
    """Content of every file at a moment, one row per path."""
    read = read_snapshots(events, at).select("path", F.col("content").alias("read_content"))
    replayed = replay_edits(_edit_rows(events, EventFilter(until=at), None)).withColumnRenamed(
        "file_path", "path"
    )
    both = read.join(replayed, "path", "full")
    whole = F.col("read_content").isNotNull()
    return both.select(
        "path",
        F.when(whole, "read").otherwise("edits").alias("method"),
        F.when(~whole, F.col("edits")).alias("edits"),
        F.when(~whole, F.col("applied")).alias("applied"),
        F.when(~whole, F.col("failed")).alias("failed"),
        F.coalesce("read_content", "content").alias("content"),
    )
