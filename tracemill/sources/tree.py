"""Session storage as a tree of small JSON files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.identity import event_id, project_id, source_id
from tracemill.functions.redaction import manifest, redact, redact_json
from tracemill.functions.timeexpr import iso_from_millis
from tracemill.schema import promote
from tracemill.sources.calls import TREE_PATH_KEYS, call_text, variant_paths
from tracemill.sources.lines import running_sum


_MINUTE_MS, _HOUR_MS = 60_000, 3_600_000

PROJECT = (
    "id string, worktree string, vcs string, time struct<created:bigint,updated:bigint>"
)
SESSION = (
    "id string, version string, projectID string, directory string, title string, "
    "time struct<created:bigint,updated:bigint>, "
    "summary struct<additions:bigint,deletions:bigint,files:bigint>"
)
MESSAGE = (
    "id string, sessionID string, role string, time struct<created:bigint,completed:bigint>, "
    "parentID string, modelID string, providerID string, mode string, agent string, cost double, "
    "tokens struct<input:bigint,output:bigint,reasoning:bigint,cache:struct<read:bigint,write:bigint>>, "
    "finish string"
)
PART = (
    "id string, sessionID string, messageID string, type string, text string, callID string, tool string, "
    "state struct<status:string,input:string,output:string,title:string,"
    "metadata:struct<output:string,exit:bigint,description:string>,time:struct<start:bigint,end:bigint>>, "
    "time struct<start:bigint,end:bigint>"
)
DIFF = "array<struct<file:string,before:string,after:string,additions:bigint,deletions:bigint>>"


@dataclass(frozen=True)
class Tree:
    """One table per level; diffs hold `(sessionID, idx, file, before, after, ...)`."""

    projects: DataFrame
    sessions: DataFrame
    messages: DataFrame
    parts: DataFrame
    diffs: DataFrame


def read_tree(spark: SparkSession, root: str) -> Tree:
    """Tables of a storage folder; unreadable files and records without keys are skipped."""

    def level(name: str, schema: str, required: list[str]) -> DataFrame:
        files = (
            spark.read.schema(schema)
            .option("multiLine", "true")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.json")
            .json(f"{root}/{name}")
        )
        for column in required:
            files = files.where(F.nullif(column, F.lit("")).isNotNull())
        return files

    texts = (
        spark.read.option("wholetext", "true")
        .option("pathGlobFilter", "*.json")
        .text(f"{root}/session_diff")
        .select(
            F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("sessionID"),
            F.from_json("value", DIFF).alias("diffs"),
        )
    )
    diffs = texts.select("sessionID", F.posexplode("diffs").alias("idx", "d")).select("sessionID", "idx", "d.*")
    projects = level("project", PROJECT, ["id", "worktree"]).where("id <> 'global'")
    return Tree(
        projects,
        level("session", SESSION, ["id", "projectID"]),
        level("message", MESSAGE, ["id", "sessionID"]),
        level("part", PART, ["id", "type", "messageID"]),
        diffs,
    )


def land(tree: Tree, folder: str) -> Tree:
    """The same tables, written once as Parquet below a shared folder and read from there.

    The later steps read parts and messages several times, and a few columns at a time,
    which many small JSON files would make expensive.
    """
    tables = {}
    for name, table in vars(tree).items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
        tables[name] = table.sparkSession.read.schema(table.schema).parquet(f"{folder}/{name}")
    return Tree(**tables)


def is_complete() -> Column:
    """User messages always are; assistant messages need a completion time."""
    return (F.col("role") != "assistant") | (F.coalesce("time.completed", F.lit(0)) != 0)


def _output(part: str = "state") -> Column:
    return F.coalesce(
        F.nullif(f"{part}.output", F.lit("")), F.nullif(f"{part}.metadata.output", F.lit(""))
    )


def _result_text() -> Column:
    written = F.nullif(F.get_json_object("state.input", "$.content"), F.lit(""))
    return (
        F.when((F.col("tool") == "write") & written.isNotNull(), written)
        .otherwise(_output())
    )


def _numbered_parts(tree: Tree, after: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Parts of complete new messages with the position of their first event, and the
    number of positions each session takes.

    `after` holds `(sessionID, last_created)`: messages up to that time are left out.
    """
    messages = tree.messages.where(is_complete())
    if after is not None:
        known = after.select("sessionID", "last_created")
        messages = messages.join(known, "sessionID", "left").where(
            F.col("last_created").isNull() | (F.col("time.created") > F.col("last_created"))
        )
    parts = tree.parts.select(
        F.col("id").alias("part_id"),
        F.col("messageID").alias("message_id"),
        "type",
        "text",
        "callID",
        "tool",
        "state",
        F.coalesce("time.start", F.lit(0)).alias("part_start"),
        _result_text().alias("result"),
    )
    n_events = (
        F.when(F.col("type") == "tool", F.when(F.col("result").isNotNull(), 2).otherwise(1))
        .when(F.col("type").isin("text", "reasoning"), 1)
        .otherwise(0)
    )
    parts = parts.withColumns(
        {"n_events": n_events, "part_block": F.floor(F.col("part_start") / _MINUTE_MS)}
    )
    parts = running_sum(
        parts, ["message_id"], "part_block", ["part_start", "part_id"], F.col("n_events"), "offset"
    )

    sizes = parts.groupBy("message_id").agg(F.sum("n_events").alias("n"))
    heads = messages.select(
        F.col("id").alias("message_id"),
        F.col("sessionID").alias("session_id"),
        "role",
        F.col("time.created").alias("created"),
        F.floor(F.col("time.created") / _HOUR_MS).alias("hour"),
        F.col("modelID").alias("model"),
        F.col("providerID").alias("provider"),
        "agent",
        "cost",
        "tokens",
    ).join(sizes, "message_id", "left")
    taken = F.greatest(F.lit(1), F.coalesce("n", F.lit(0)))
    totals = heads.groupBy("session_id").agg(F.sum(taken).alias("total"))
    heads = running_sum(heads, ["session_id"], "hour", ["created", "message_id"], taken, "base")
    placed = heads.join(parts.where("n_events > 0"), "message_id").withColumn(
        "seq", F.col("base") + F.col("offset")
    )
    return placed, totals


def _tokens() -> Column:
    def count(path: str) -> Column:
        return F.coalesce(path, F.lit(0))

    return F.when(
        F.col("tokens").isNotNull(),
        F.struct(
            count("tokens.input").alias("input"),
            count("tokens.output").alias("output"),
            count("tokens.reasoning").alias("reasoning"),
            count("tokens.cache.read").alias("cache_read"),
            count("tokens.cache.write").alias("cache_write"),
        ),
    )


def _part_events(parts: DataFrame) -> DataFrame:
    """Events of each part: a call and maybe its result, a message, or reasoning."""
    # Tokens and cost go to the first event of a message only.
    first = F.col("offset") == 0
    tokens, cost = F.when(first, _tokens()), F.when(first & (F.col("cost") != 0), F.col("cost"))
    call = F.coalesce(
        F.nullif("callID", F.lit("")),
        F.concat(F.lit("tool:"), "tool", F.lit(":"), F.col("seq").cast("string")),
    )
    tool_meta = F.struct(
        call.alias("tool_call_id"),
        "message_id",
        "agent",
        "model",
        "provider",
        tokens.alias("tokens"),
        cost.alias("cost"),
        (F.col("state.time.end") - F.col("state.time.start")).alias("duration_ms"),
        F.col("state.metadata.exit").alias("exit_code"),
    )
    said_meta = F.struct(
        F.when(F.col("type") == "reasoning", F.lit(True)).alias("reasoning"),
        "message_id",
        "model",
        "provider",
        "agent",
        tokens.alias("tokens"),
        cost.alias("cost"),
    )
    null = F.lit(None).cast("string")

    def event(kind, seq, content, text, tool, args, meta, redacted) -> Column:
        return F.struct(
            kind.alias("event_type"),
            seq.cast("double").alias("seq"),
            content.alias("content"),
            text.alias("text"),
            tool.alias("tool"),
            args.alias("args"),
            meta.alias("meta"),
            redacted.alias("redacted"),
        )

    described = call_text(
        F.col("tool"),
        lambda k: F.get_json_object("state.input", f"$.{k}"),
        ("filePath", "path", "file_path"),
    )
    called = event(
        F.lit("tool_call"),
        F.col("seq"),
        call,
        described,
        F.col("tool"),
        F.col("state.input"),
        F.to_json(tool_meta),
        F.lit(False),
    )
    returned = event(
        F.lit("tool_result"),
        F.col("seq") + 0.5,
        F.concat(F.lit("result:"), call),
        F.col("result"),
        F.col("tool"),
        null,
        F.to_json(F.struct(call.alias("tool_call_id"), "message_id")),
        F.lit(True),
    )
    by_user = (F.col("role") == "user") & (F.col("type") == "text")
    text = F.coalesce("text", F.lit(""))
    said = event(
        F.when(by_user, "user_message").otherwise(F.lit("assistant_message")),
        F.col("seq"),
        text,
        text,
        null,
        null,
        F.to_json(said_meta),
        by_user,
    )
    events = F.when(
        F.col("type") == "tool",
        F.when(F.col("result").isNotNull(), F.array(called, returned)).otherwise(F.array(called)),
    ).otherwise(F.array(said))
    paths = F.when(
        F.col("type") == "tool", variant_paths(F.try_parse_json("state.input"), TREE_PATH_KEYS)
    )
    return parts.select("session_id", "created", paths.alias("paths"), F.inline(events))


def _diff_events(tree: Tree, totals: DataFrame) -> DataFrame:
    """Session diffs as edit calls, at the time of the first complete message.

    Their ids depend on session, file and index only, so later runs repeat them.
    """
    first = (
        tree.messages.where(is_complete())
        .groupBy(F.col("sessionID").alias("session_id"))
        .agg(F.min(F.struct(F.col("time.created").alias("created"), F.col("id").alias("message_id"))).alias("m"))
        .select("session_id", "m.*")
    )
    return (
        tree.diffs.withColumnRenamed("sessionID", "session_id")
        .join(first, "session_id")
        .join(totals, "session_id", "left")
        .select(
            "session_id",
            "created",
            F.array("file").alias("paths"),
            F.lit("tool_call").alias("event_type"),
            (F.coalesce("total", F.lit(0)) + F.col("idx")).cast("double").alias("seq"),
            F.concat(F.lit("diff:"), "file", F.lit(":"), F.col("idx").cast("string")).alias("content"),
            F.concat(F.lit("Tool: edit "), "file").alias("text"),
            F.lit("edit").alias("tool"),
            F.to_json(
                F.struct(
                    F.col("file").alias("file_path"),
                    F.col("before").alias("oldString"),
                    F.col("after").alias("newString"),
                )
            ).alias("args"),
            F.to_json(F.struct("message_id", "additions", "deletions")).alias("meta"),
            F.lit(False).alias("redacted"),
        )
    )


def normalize(
    tree: Tree,
    device_id: str,
    ingest_ts: str,
    redact_secrets: bool = True,
    after: DataFrame | None = None,
) -> DataFrame:
    """Canonical events of every session of a tree."""
    parts, totals = _numbered_parts(tree, after)
    rows = _part_events(parts).withColumn("is_diff", F.lit(False)).unionByName(
        _diff_events(tree, totals).withColumn("is_diff", F.lit(True))
    )
    directories = tree.sessions.select(
        F.col("id").alias("session_id"), F.nullif("directory", F.lit("")).alias("directory")
    )
    source = source_id(F.concat(F.lit("opencode://"), F.col("session_id")), device_id)
    null = F.lit(None).cast("string")
    seq = F.when(F.col("is_diff"), 0).otherwise(F.col("seq"))
    text, args = F.col("text"), F.col("args")
    spans = F.lit(None).cast("array<struct<type:string,start:int,end:int,original_hash:string>>")
    if redact_secrets:
        text = F.when(F.col("redacted"), redact(F.col("text"))).otherwise(F.col("text"))
        spans = F.when(F.col("redacted"), manifest(F.col("text")))
        args = F.when(F.col("is_diff"), F.col("args")).otherwise(redact_json(F.col("args")))
    raw = rows.join(directories, "session_id", "left").select(
        event_id(source, seq, F.col("content")).alias("event_id"),
        source.alias("source_id"),
        F.col("seq").alias("source_seq"),
        F.lit(device_id).alias("device_id"),
        F.when(F.col("directory").isNotNull(), project_id(null, F.col("directory"))).alias("project_id"),
        "session_id",
        iso_from_millis(F.col("created")).alias("event_ts"),
        F.lit(ingest_ts).alias("ingest_ts"),
        F.lit("opencode_storage").alias("source_kind"),
        "event_type",
        text.alias("text_redacted"),
        F.col("tool").alias("tool_name"),
        args.alias("tool_args_json"),
        F.col("paths").alias("file_paths"),
        F.col("meta").alias("meta_json"),
        spans.alias("redaction_manifest"),
    )
    return promote(raw)


def session_sources(tree: Tree) -> DataFrame:
    """Sessions, newest first, with the directory they worked in."""
    projects = tree.projects.select(F.col("id").alias("projectID"), F.col("worktree"))
    joined = tree.sessions.join(projects, "projectID", "left")
    return joined.select(
        F.col("id").alias("session_id"),
        F.col("projectID").alias("project_id"),
        F.concat(F.lit("opencode://"), "id").alias("locator"),
        F.coalesce(
            F.nullif("worktree", F.lit("")), F.nullif("directory", F.lit("")), F.lit("")
        ).alias("working_directory"),
        "title",
        F.col("time.created").alias("created"),
    ).orderBy(F.desc("created"), "session_id")


def progress(tree: Tree) -> DataFrame:
    """(sessionID, last_created) of the last complete message, for the next run."""
    return (
        tree.messages.where(is_complete())
        .groupBy("sessionID")
        .agg(F.max("time.created").alias("last_created"))
    )


def usage_messages(tree: Tree) -> DataFrame:
    """Message records in the form the provider report takes."""
    return tree.messages.select(
        F.col("id").alias("message_id"),
        F.col("sessionID").alias("session_id"),
        F.col("providerID").alias("provider"),
        F.col("modelID").alias("model"),
        F.col("time.created").alias("created_ms"),
        F.col("tokens.input").alias("input"),
        F.col("tokens.output").alias("output"),
        F.col("tokens.reasoning").alias("reasoning"),
        F.col("tokens.cache.read").alias("cache_read"),
        F.col("tokens.cache.write").alias("cache_write"),
    )
