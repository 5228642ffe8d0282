"""Canonical schemas and enumerations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source kinds.
SOURCE_KINDS = ("claude_code_jsonl", "opencode_storage", "cursor_transcript", "git")

# Event types that ingestion emits.
EMITTED_EVENT_TYPES = (
    "user_message",
    "assistant_message",
    "tool_call",
    "tool_result",
    "git_commit",
    "git_branch",
)

# Event types a timeline leaves out when git activity is excluded.
GIT_EVENT_TYPES = ("git_commit", "git_diff", "git_branch", "git_merge", "git_stash", "git_tag")

# Tools that touch one file, in both spellings.
FILE_TOOLS = ("Read", "read", "Write", "write", "Edit", "edit")
SNAPSHOT_TOOLS = ("Read", "read", "Write", "write")
EDIT_TOOLS = ("Edit", "edit")

REDACTION_SPAN = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("original_hash", T.StringType()),
    ]
)

GIT_META = T.StructType(
    [
        T.StructField("sha", T.StringType()),
        T.StructField("short_sha", T.StringType()),
        T.StructField("files_changed", T.LongType()),
        T.StructField("insertions", T.LongType()),
        T.StructField("deletions", T.LongType()),
        T.StructField("branch", T.StringType()),
        T.StructField("to_branch", T.StringType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("source_seq", T.DoubleType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("event_ts", T.StringType()),
        T.StructField("ingest_ts", T.StringType()),
        T.StructField("source_kind", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("text_redacted", T.StringType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("tool_args_json", T.StringType()),
        T.StructField("file_paths", T.ArrayType(T.StringType())),
        T.StructField("meta_json", T.StringType()),
        T.StructField("redaction_manifest", T.ArrayType(REDACTION_SPAN)),
        # Derived once at ingest, so that queries prune columns and partitions.
        T.StructField("event_time", T.TimestampType()),
        T.StructField("event_date", T.StringType()),
        T.StructField("arg_file_path", T.StringType()),
        T.StructField("arg_path", T.StringType()),
        T.StructField("arg_filepath", T.StringType()),
        T.StructField("arg_old", T.StringType()),
        T.StructField("arg_new", T.StringType()),
        T.StructField("call_id", T.StringType()),
        T.StructField("use_id", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("tok_input", T.LongType()),
        T.StructField("tok_output", T.LongType()),
        T.StructField("tok_reasoning", T.LongType()),
        T.StructField("tok_cache_read", T.LongType()),
        T.StructField("tok_cache_write", T.LongType()),
        T.StructField("git", GIT_META),
    ]
)

_BASE_COLUMNS = [f.name for f in EVENTS.fields[:16]]


def event_time(ts: Column) -> Column:
    """Instant of an ISO-8601 string; text without an offset is UTC, garbage is NULL."""
    has_time = ts.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    has_offset = ts.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    with_zone = F.when(has_time & ~has_offset, F.concat(ts, F.lit("Z"))).when(
        ~has_time & ts.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(ts, F.lit("T00:00:00Z"))
    )
    return F.coalesce(with_zone, ts).try_cast("timestamp")


def _truthy(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def _date(ts: Column) -> Column:
    """Day of a timestamp as text; all that isn't a day is one `unknown`, so that it makes one folder."""
    day = F.split_part(ts, F.lit("T"), F.lit(1))
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day).otherwise(F.when(ts.isNotNull(), F.lit("unknown")))


def promote(raw: DataFrame) -> DataFrame:
    """Add the derived columns to rows that hold the stored columns only."""
    args, meta = F.col("tool_args_json"), F.col("meta_json")

    def arg(name: str) -> Column:
        return F.get_json_object(args, f"$.{name}")

    def field(path: str) -> Column:
        return F.get_json_object(meta, f"$.{path}")

    has_tokens = field("tokens").isNotNull()

    def tokens(name: str) -> Column:
        value = F.coalesce(field(f"tokens.{name}").try_cast("bigint"), F.lit(0))
        return F.when(has_tokens, value)

    is_git = F.col("event_type").startswith("git_") & meta.isNotNull()
    git = F.when(
        is_git,
        F.struct(
            field("sha").alias("sha"),
            field("short_sha").alias("short_sha"),
            field("files_changed").cast("bigint").alias("files_changed"),
            field("insertions").cast("bigint").alias("insertions"),
            field("deletions").cast("bigint").alias("deletions"),
            field("branch").alias("branch"),
            field("to_branch").alias("to_branch"),
        ),
    )
    derived = {
        "event_time": event_time(F.col("event_ts")),
        "event_date": _date(F.col("event_ts")),
        "arg_file_path": arg("file_path"),
        "arg_path": arg("path"),
        "arg_filepath": arg("filePath"),
        "arg_old": F.coalesce(_truthy(arg("oldString")), _truthy(arg("old_string"))),
        "arg_new": F.coalesce(_truthy(arg("newString")), _truthy(arg("new_string"))),
        "call_id": field("tool_call_id"),
        "use_id": field("tool_use_id"),
        "message_id": field("message_id"),
        "model": field("model"),
        "tok_input": tokens("input"),
        "tok_output": tokens("output"),
        "tok_reasoning": tokens("reasoning"),
        "tok_cache_read": tokens("cache_read"),
        "tok_cache_write": tokens("cache_write"),
        "git": git,
    }
    return raw.select(*_BASE_COLUMNS).withColumns(derived)
