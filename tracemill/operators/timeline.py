"""Timelines and the views built on them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import flatten_newlines
from tracemill.functions.timeexpr import instant_literal, to_instant
from tracemill.operators.filters import EventFilter, apply_filter

CHRONOLOGICAL = ("event_ts", "event_id")


def timeline_rows(events: DataFrame) -> DataFrame:
    """Timeline projection; git fields only on git events."""
    git = F.when(F.col("event_type").startswith("git_"), F.col("git"))

    def truthy(column: str) -> Column:
        return F.nullif(F.col(column), F.lit(""))

    with_git = events.withColumn("g", git)
    return with_git.select(
        "event_id",
        "event_type",
        "event_ts",
        "text_redacted",
        truthy("tool_name").alias("tool_name"),
        truthy("tool_args_json").alias("tool_args_json"),
        "file_paths",
        F.when(
            truthy("g.sha").isNotNull(), F.coalesce(truthy("g.short_sha"), F.left("g.sha", F.lit(7)))
        ).alias("git_sha"),
        F.col("g.files_changed").alias("git_files_changed"),
        F.col("g.insertions").alias("git_insertions"),
        F.col("g.deletions").alias("git_deletions"),
        F.coalesce(truthy("g.to_branch"), truthy("g.branch")).alias("git_branch"),
        "session_id",
        "project_id",
        F.lit(False).alias("has_encrypted_original"),
    )


def page(df: DataFrame, order: tuple, limit: int, offset: int = 0) -> DataFrame:
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def timeline(
    events: DataFrame,
    flt: EventFilter = EventFilter(),
    limit: int = 100,
    offset: int = 0,
    projects: DataFrame | None = None,
) -> DataFrame:
    """Page of the filtered events in the order of their time text."""
    rows = timeline_rows(apply_filter(events, flt, projects))
    return page(rows, CHRONOLOGICAL, limit, offset)


def page_info(filtered: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One row about a page of `filtered`; it needs the count only, not the page."""
    total = F.col("total")
    returned = F.greatest(F.least(total - F.lit(offset), F.lit(limit)), F.lit(0))
    has_more = F.lit(offset) + returned < total
    return filtered.agg(F.count("*").alias("total")).select(
        F.lit(offset).cast("bigint").alias("offset"),
        F.lit(limit).cast("bigint").alias("limit"),
        returned.cast("bigint").alias("returned"),
        "total",
        has_more.alias("has_more"),
        F.when(has_more, F.lit(offset) + returned).cast("bigint").alias("next_offset"),
    )


def timeline_summary(page_rows: DataFrame) -> DataFrame:
    """Totals of one returned page; a zero count is reported as missing."""
    is_commit = F.col("event_type") == "git_commit"

    def positive(column: Column) -> Column:
        return F.when(column > 0, column)

    def lines(column: str) -> Column:
        return F.sum(F.when(is_commit, F.coalesce(F.col(column), F.lit(0))).otherwise(0))

    return page_rows.agg(
        F.count("*").alias("total_events"),
        positive(F.count_if(is_commit)).alias("commits_count"),
        positive(lines("git_insertions")).alias("lines_added"),
        positive(lines("git_deletions")).alias("lines_removed"),
        F.min("event_ts").alias("first_ts"),
        F.max("event_ts").alias("last_ts"),
    )


def timeline_by_type(page_rows: DataFrame) -> DataFrame:
    return page_rows.groupBy("event_type").agg(F.count("*").alias("n"))


def history(
    events: DataFrame,
    flt: EventFilter = EventFilter(),
    limit: int = 10,
    offset: int = 0,
    projects: DataFrame | None = None,
) -> DataFrame:
    """User messages over time."""
    only_user = EventFilter(**{**flt.__dict__, "event_types": ("user_message",)})
    return timeline(events, only_user, limit, offset, projects)


# Event types of each conversation mode.
_CONVERSATION = {
    "messages": ("user_message", "assistant_message"),
    "full": ("user_message", "assistant_message", "tool_call"),
    "tools": ("tool_call",),
}


def conversation(
    events: DataFrame,
    flt: EventFilter = EventFilter(),
    mode: str = "messages",
    limit: int = 20,
    offset: int = 0,
    projects: DataFrame | None = None,
) -> DataFrame:
    """Interleaved messages, with or without tool calls, in compact form.

    Arguments that are JSON appear as `tool_args`, others as `tool_args_json`.
    """
    chosen = EventFilter(**{**flt.__dict__, "event_types": _CONVERSATION[mode]})
    rows = timeline(events, chosen, limit, offset, projects)
    parsed = F.try_parse_json("tool_args_json").isNotNull()
    return rows.select(
        F.col("event_ts").alias("ts"),
        F.when(F.col("event_type") == "user_message", "user")
        .when(F.col("event_type") == "assistant_message", "assistant")
        .otherwise("tool")
        .alias("type"),
        F.col("text_redacted").alias("text"),
        F.col("tool_name").alias("tool"),
        F.when(parsed, F.col("tool_args_json")).alias("tool_args"),
        F.when(~parsed, F.col("tool_args_json")).alias("tool_args_json"),
        F.when(F.size("file_paths") > 0, F.col("file_paths")).alias("files"),
    )


def around(
    events: DataFrame,
    at: str,
    minutes: int = 30,
    flt: EventFilter = EventFilter(),
    limit: int = 50,
    offset: int = 0,
    projects: DataFrame | None = None,
) -> DataFrame:
    """Events within some minutes of a moment; `near_center` marks the closest minute."""
    center = to_instant(at)
    if center is None:
        raise ValueError(f"not a moment: {at!r}")
    window = timedelta(minutes=minutes)
    bounds = {"since": (center - window).isoformat(), "until": (center + window).isoformat()}
    rows = timeline(events, EventFilter(**{**flt.__dict__, **bounds}), limit, offset, projects)
    from tracemill.schema import event_time

    gap = F.unix_millis(event_time(F.col("event_ts"))) - F.unix_millis(instant_literal(center))
    return rows.withColumn("near_center", F.abs(gap) < 60000)


# Column lists of the CSV exports, by view.
CSV_COLUMNS = {
    "search": ("event_ts", "event_type", "text_redacted", "tool_name", "project_id", "session_id"),
    "timeline": (
        "event_ts",
        "event_type",
        "text_redacted",
        "tool_name",
        "git_sha",
        "git_insertions",
        "git_deletions",
    ),
}


def _csv_columns(rows: DataFrame, view: str) -> DataFrame:
    """Columns of a view as text: newlines of the text flattened, NULL and 0 empty."""

    def cell(column: str) -> Column:
        value = F.coalesce(F.col(column).cast("string"), F.lit(""))
        if column in ("git_insertions", "git_deletions"):
            value = F.when(value == "0", "").otherwise(value)
        return (flatten_newlines(value) if column == "text_redacted" else value).alias(column)

    return rows.select(*[cell(c) for c in CSV_COLUMNS[view]])


def csv_rows(rows: DataFrame, view: str) -> DataFrame:
    """One line per row: every field quoted, quotes of the text doubled."""
    cells = _csv_columns(rows, view)

    def quoted(column: str) -> Column:
        value = F.col(column)
        if column == "text_redacted":
            value = F.replace(value, F.lit('"'), F.lit('""'))
        return F.concat(F.lit('"'), value, F.lit('"'))

    return cells.select(F.concat_ws(",", *[quoted(c) for c in cells.columns]).alias("line"))


def export(rows: DataFrame, path: str, fmt: str, view: str = "search") -> None:
    """Write rows as JSON lines (`json`, `jsonl`) or as CSV with a header line.

    Tool arguments become JSON of their own within a JSON line; arguments that aren't JSON stay text.
    """
    if fmt == "csv":
        writer = _csv_columns(rows, view).write.mode("overwrite")
        writer.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
        return
    if "tool_args_json" in rows.columns:
        args = F.coalesce(F.try_parse_json("tool_args_json"), F.col("tool_args_json").cast("variant"))
        rows = rows.withColumn("tool_args_json", args)
    rows.write.mode("overwrite").json(path)
