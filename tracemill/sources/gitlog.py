"""Exported commit logs and reference logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.identity import event_id
from tracemill.functions.timeexpr import iso_from_seconds, instant_literal, to_instant
from tracemill.schema import event_time, promote
from tracemill.sources.lines import running_sum

# Fixed value: one line of the file statistics; binary files show dashes.
_STAT = r"^(\d+|-)\s+(\d+|-)\s+(.+)$"
# Fixed value: one line of the reference log that tells of a checkout.
_SWITCH = (
    r"^([a-f0-9]+) ([a-f0-9]+) .+ (\d+) [+-]\d+\tcheckout: moving from (.+) to (.+)$"
)


def commits(lines: DataFrame, since: str | None = None, author: str | None = None) -> DataFrame:
    """One row per commit of a log with headers `H|h|subject|name|mail|date|parents`.

    A subject may hold bars: the fields around it are counted from both ends. Files of
    a commit are the statistics lines up to the next header.
    """
    stripped = lines.where(F.trim("line") != "")
    is_stat = F.col("line").rlike(_STAT)
    parts = F.split("line", r"\|")
    is_header = F.col("line").contains("|") & ~is_stat & (F.size(parts) >= 6)
    marked = stripped.where(is_header | is_stat).withColumn("is_header", is_header)
    numbered = running_sum(
        marked, ["path"], "block", ["pos"], F.col("is_header").cast("int"), "commit_no", inclusive=True
    ).where("commit_no > 0")

    def count(group: int):
        text = F.regexp_extract("line", _STAT, group)
        return F.when(text == "-", 0).otherwise(text.try_cast("bigint"))

    inserted, deleted = count(1), count(2)
    status = (
        F.when((inserted > 0) & (deleted == 0), "A").when((inserted == 0) & (deleted > 0), "D").otherwise("M")
    )
    file = F.struct(
        F.col("pos"),
        F.regexp_extract("line", _STAT, 3).alias("path"),
        status.alias("status"),
        inserted.alias("insertions"),
        deleted.alias("deletions"),
    )
    grouped = numbered.groupBy("path", "commit_no").agg(
        F.max(F.when(F.col("is_header"), F.col("line"))).alias("header"),
        F.array_sort(F.collect_list(F.when(~F.col("is_header"), file))).alias("files"),
    )
    n, f = F.size("f"), F.col("f")
    shift = F.when(n >= 7, n - 7).otherwise(0)
    fields = grouped.withColumn("f", F.split("header", r"\|"))

    def at(index: int):
        return F.get(f, shift + index)

    files = F.transform(
        "files", lambda x: x.dropFields("pos")
    )
    result = fields.select(
        F.col("path").alias("log_path"),
        (F.col("commit_no") - 1).alias("commit_no"),
        F.get(f, F.lit(0)).alias("sha"),
        F.get(f, F.lit(1)).alias("short_sha"),
        F.array_join(F.slice(f, F.lit(3), shift + 1), "|").alias("message"),
        at(3).alias("author_name"),
        at(4).alias("author_email"),
        at(5).alias("commit_ts"),
        F.filter(F.split(F.trim(F.coalesce(at(6), F.lit(""))), " "), lambda p: p != "").alias("parents"),
        files.alias("files"),
        F.aggregate(files, F.lit(0).cast("bigint"), lambda a, x: a + x["insertions"]).alias("insertions"),
        F.aggregate(files, F.lit(0).cast("bigint"), lambda a, x: a + x["deletions"]).alias("deletions"),
    ).where("sha <> ''")
    if author:
        result = result.where(F.col("author_name").contains(author))
    if since:
        result = result.where(event_time(F.col("commit_ts")) >= instant_literal(to_instant(since)))
    return result


def switches(lines: DataFrame, since: str | None = None) -> DataFrame:
    """Branch changes of a reference log, in order."""
    found = lines.where(F.col("line").rlike(_SWITCH))
    seconds = F.regexp_extract("line", _SWITCH, 3).cast("bigint")
    rows = found.select(
        "path",
        "block",
        "pos",
        F.regexp_extract("line", _SWITCH, 1).alias("from_sha"),
        F.regexp_extract("line", _SWITCH, 2).alias("to_sha"),
        F.regexp_extract("line", _SWITCH, 4).alias("from_branch"),
        F.regexp_extract("line", _SWITCH, 5).alias("to_branch"),
        seconds.alias("seconds"),
    )
    if since:
        rows = rows.where(F.timestamp_seconds("seconds") >= instant_literal(to_instant(since)))
    numbered = running_sum(rows, ["path"], "block", ["pos"], F.lit(1), "switch_no")
    return numbered.select(
        F.col("path").alias("log_path"),
        "switch_no",
        "from_branch",
        "to_branch",
        "from_sha",
        "to_sha",
        iso_from_seconds(F.col("seconds")).alias("ts"),
    )


def commit_text(with_branch: bool = False):
    """Searchable text of a commit row."""
    summary = F.array_join(
        F.transform(
            "files",
            lambda x: F.concat(
                x["path"],
                F.lit(" (+"),
                x["insertions"].cast("string"),
                F.lit(" -"),
                x["deletions"].cast("string"),
                F.lit(")"),
            ),
        ),
        ", ",
    )
    text = F.concat(
        F.lit("git commit "), "short_sha", F.lit(': "'), "message", F.lit('"\nFiles: '), summary
    )
    if with_branch:
        branch = F.coalesce(F.concat(F.lit("\nBranch: "), F.nullif("branch", F.lit(""))), F.lit(""))
        text = F.concat(text, branch)
    return text


def _event(rows: DataFrame, seq, content, ts, kind: str, text, meta, paths, ctx: dict) -> DataFrame:
    source = F.lit(ctx["source_id"])
    null = F.lit(None).cast("string")
    return rows.select(
        event_id(source, seq, content).alias("event_id"),
        source.alias("source_id"),
        seq.cast("double").alias("source_seq"),
        F.lit(ctx["device_id"]).alias("device_id"),
        F.lit(ctx["project_id"]).alias("project_id"),
        null.alias("session_id"),
        ts.alias("event_ts"),
        F.lit(ctx["ingest_ts"]).alias("ingest_ts"),
        F.lit("git").alias("source_kind"),
        F.lit(kind).alias("event_type"),
        text.alias("text_redacted"),
        null.alias("tool_name"),
        null.alias("tool_args_json"),
        paths.alias("file_paths"),
        F.to_json(meta).alias("meta_json"),
        F.lit(None).cast("array<struct<type:string,start:int,end:int,original_hash:string>>").alias(
            "redaction_manifest"
        ),
    )


def normalize(
    commit_rows: DataFrame,
    switch_rows: DataFrame,
    source_id: str,
    device_id: str,
    project_id: str,
    ingest_ts: str,
    first_seq: int = 0,
) -> DataFrame:
    """Canonical events of one repository: commits in log order, then branch changes."""
    ctx = {
        "source_id": source_id,
        "device_id": device_id,
        "project_id": project_id,
        "ingest_ts": ingest_ts,
    }
    has_branch = "branch" in commit_rows.columns
    meta = F.struct(
        "sha",
        "short_sha",
        "message",
        "author_name",
        "author_email",
        "commit_ts",
        F.size("files").alias("files_changed"),
        "insertions",
        "deletions",
        "files",
        *(["branch"] if has_branch else []),
    )
    paths = F.transform("files", lambda x: x["path"])
    made = _event(
        commit_rows,
        F.col("commit_no") + first_seq,
        F.col("sha"),
        F.col("commit_ts"),
        "git_commit",
        commit_text(has_branch),
        meta,
        F.when(F.size("files") > 0, paths),
        ctx,
    )
    n_commits = commit_rows.agg(F.coalesce(F.max("commit_no") + 1, F.lit(0)).alias("n")).scalar()
    moved = _event(
        switch_rows.withColumn("seq", F.col("switch_no") + n_commits + first_seq),
        F.col("seq"),
        F.concat_ws(":", "from_branch", "to_branch", "ts"),
        F.col("ts"),
        "git_branch",
        F.concat(F.lit("git checkout: "), "from_branch", F.lit(" → "), "to_branch"),
        F.struct("from_branch", "to_branch", "from_sha", "to_sha"),
        F.lit(None).cast("array<string>"),
        ctx,
    )
    return promote(made.unionByName(moved))
