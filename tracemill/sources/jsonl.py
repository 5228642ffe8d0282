"""Session files with one JSON record per line."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from tracemill.functions.identity import (
    decoded_directory,
    event_id,
    project_hash_of_path,
    session_of_path,
    source_id,
)
from tracemill.functions.redaction import manifest, redact, redact_json
from tracemill.schema import promote
from tracemill.sources.calls import (
    CALLS,
    SESSION_PATH_KEYS,
    call_text,
    embedded_calls,
    is_string,
    map_paths,
    string_at,
    variant_paths,
    without_markup,
)
from tracemill.sources.lines import read_lines, running_sum

_PIECE = (
    "kind string, event_type string, text string, tool string, args string, "
    "paths array<string>, back int, use_id string, redacted boolean"
)
_PIECES = "array<struct<" + ",".join(c.strip().replace(" ", ":", 1) for c in _PIECE.split(", ")) + ">>"


def _nested_text(content) -> str | None:
    """Text of parsed content, however deep its blocks are nested; nesting is followed without recursion."""

    def own(part):
        if isinstance(part, str):
            return part
        return part["text"] if isinstance(part, dict) and isinstance(part.get("text"), str) else None

    if not isinstance(content, list):
        return own(content)
    texts, todo = [], [iter(content)]
    while todo:
        block = next(todo[-1], todo)
        if block is todo:
            todo.pop()
        elif own(block) is not None:
            texts.append(own(block))
        elif isinstance(block, dict):
            inner = block.get("content")
            if isinstance(inner, list):
                todo.append(iter(inner))
            else:
                texts.append(own(inner))
    return "\n".join(t for t in texts if t)


@F.pandas_udf(T.StringType())
def _deep_text(content: pd.Series) -> pd.Series:
    return content.map(lambda text: None if text is None else _nested_text(json.loads(text)))


def content_text(content: Column) -> Column:
    """Text of a string, of a list of blocks, or of an object with a text.

    Blocks within blocks are rare and nest to any depth: only such content leaves the JVM.
    """
    blocks = F.try_variant_get(content, "$", "array<variant>")
    deep = F.exists(blocks, lambda b: F.try_variant_get(b, "$.content", "variant").isNotNull())

    def block_text(block: Column) -> Column:
        return F.when(is_string(block), F.try_variant_get(block, "$", "string")).otherwise(string_at(block, "$.text"))

    filled = F.filter(F.transform(blocks, block_text), lambda t: F.nullif(t, F.lit("")).isNotNull())
    return F.coalesce(
        F.when(is_string(content), F.try_variant_get(content, "$", "string")),
        _deep_text(F.when(deep, F.to_json(content))),
        F.array_join(filled, "\n"),
        F.try_variant_get(content, "$.text", "string"),
        F.lit(""),
    )


def _piece(kind: str, event_type: str, text: Column, **given: Column) -> Column:
    empty = {
        "tool": F.lit(None).cast("string"),
        "args": F.lit(None).cast("string"),
        "paths": F.lit(None).cast("array<string>"),
        "back": F.lit(0),
        "use_id": F.lit(None).cast("string"),
        "redacted": F.lit(False),
    }
    fields = {"kind": F.lit(kind), "event_type": F.lit(event_type), "text": text, **empty, **given}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _none() -> Column:
    return F.array().cast(_PIECES)


def _markup_pieces(calls: Column) -> Column:
    """A call, its result and what it writes, for every embedded call."""

    def of_call(call: Column) -> Column:
        params = call["params"]
        paths = map_paths(params, SESSION_PATH_KEYS)
        shared = {"tool": call["name"], "paths": paths}
        text = call_text(
            call["name"], lambda k: F.try_element_at(params, F.lit(k)), ("file_path", "path", "filePath")
        )
        first = F.array(_piece("markup_call", "tool_call", text, args=F.to_json(params), **shared))
        result = F.when(
            call["result"].isNotNull(),
            F.array(
                _piece(
                    "markup_result",
                    "tool_result",
                    call["result"],
                    back=F.lit(1),
                    redacted=F.lit(True),
                    **shared,
                )
            ),
        ).otherwise(_none())
        content = F.nullif(F.try_element_at(params, F.lit("content")), F.lit(""))
        written = F.when(
            (call["name"] == "Write") & content.isNotNull(),
            F.array(
                _piece(
                    "markup_write",
                    "tool_result",
                    content,
                    back=F.when(call["result"].isNotNull(), 2).otherwise(1),
                    **shared,
                )
            ),
        ).otherwise(_none())
        return F.concat(first, result, written)

    return F.flatten(F.transform(calls, of_call))


def _contents(parsed: DataFrame) -> DataFrame:
    """One row per content block of a record, or one for a record without blocks.

    Every later step refers to these columns, so nothing is taken out of a record twice.
    """
    content = F.try_variant_get("entry", "$.message.content", "variant")
    kind = string_at(F.col("entry"), "$.type")
    timestamp = F.nullif(F.try_variant_get("entry", "$.timestamp", "string"), F.lit(""))
    heads = parsed.select(
        "path",
        "block",
        "pos",
        "line",
        kind.alias("record"),
        timestamp.alias("event_ts"),
        content.alias("content"),
        F.try_variant_get("entry", "$.message", "variant").alias("message"),
        F.when(kind == "assistant", token_meta(F.col("entry"))).alias("token_meta"),
    )
    blocks = F.when(F.col("record") == "assistant", F.try_variant_get("content", "$", "array<variant>"))
    rows = heads.withColumn("blocks", blocks).select(
        "*", F.posexplode_outer("blocks").alias("at", "b")
    )
    raw = F.get_json_object("line", "$.message")
    said = F.when(is_string(F.col("content")), F.try_variant_get("content", "$", "string"))
    # The raw text keeps the order of the keys.
    place = F.concat(F.lit("$.message.content["), F.col("at").cast("string"), F.lit("].input"))
    typed = rows.withColumn("btype", string_at(F.col("b"), "$.type"))
    is_use, is_result = F.col("btype") == "tool_use", F.col("btype") == "tool_result"
    block_text = F.nullif(string_at(F.col("b"), "$.text"), F.lit(""))
    return typed.select(
        "path",
        "block",
        "pos",
        F.coalesce("at", F.lit(0)).alias("at"),
        "event_ts",
        "token_meta",
        "record",
        "btype",
        F.when((F.col("record") == "user") & F.col("message").isNotNull(), content_text(F.col("content"))).alias(
            "user_text"
        ),
        F.when((F.col("record") == "result") & raw.isNotNull(), raw).alias("result_text"),
        F.when(F.col("record") == "assistant", said).alias("said"),
        F.when(F.col("record") == "assistant", F.coalesce(said, F.when(F.col("btype") == "text", block_text))).alias(
            "text"
        ),
        F.when(is_use, F.nullif(string_at(F.col("b"), "$.name"), F.lit(""))).alias("tool"),
        F.when(is_use, F.call_function("get_json_object", F.col("line"), place)).alias("args"),
        F.when(is_use, F.try_variant_get("b", "$.input", "variant")).alias("input"),
        F.nullif(
            F.when(is_use, F.try_variant_get("b", "$.id", "string")).otherwise(
                F.try_variant_get("b", "$.tool_use_id", "string")
            ),
            F.lit(""),
        ).alias("use_id"),
        F.when(is_result, content_text(F.try_variant_get("b", "$.content", "variant"))).alias("returned"),
    )


def _with_pieces(rows: DataFrame) -> DataFrame:
    """Adds what becomes of each row: an array of pieces in their order."""
    rows = rows.withColumns(
        {
            "calls": embedded_calls(F.col("text")),
            "paths": variant_paths(F.col("input"), SESSION_PATH_KEYS),
            "written": F.nullif(F.try_variant_get("input", "$.content", "string"), F.lit("")),
        }
    )
    has_calls = F.size(F.coalesce("calls", F.array().cast(CALLS))) > 0
    rows = rows.withColumn("clean", F.when(has_calls, without_markup(F.col("text"))))
    clean = F.array(_piece("message", "assistant_message", F.col("clean")))
    plain = F.array(
        _piece("message", "assistant_message", F.col("text"), redacted=F.col("said").isNotNull())
    )
    markup = F.concat(
        F.when(F.col("clean") != "", clean).otherwise(_none()), _markup_pieces(F.col("calls"))
    )
    call = _piece(
        "use_call",
        "tool_call",
        F.concat(F.lit("Tool call: "), "tool"),
        tool=F.col("tool"),
        args=F.col("args"),
        paths=F.col("paths"),
        use_id=F.col("use_id"),
    )
    write = _piece(
        "use_write",
        "tool_result",
        F.col("written"),
        tool=F.col("tool"),
        paths=F.col("paths"),
        back=F.lit(1),
        use_id=F.col("use_id"),
    )
    writes = (F.col("tool") == "Write") & F.col("written").isNotNull()
    returned = _piece(
        "block_result", "tool_result", F.col("returned"), use_id=F.col("use_id"), redacted=F.lit(True)
    )
    user = _piece("user", "user_message", F.col("user_text"), redacted=F.lit(True))
    result = _piece("result", "tool_result", F.col("result_text"), redacted=F.lit(True))
    pieces = (
        F.when(F.col("user_text").isNotNull(), F.array(user))
        .when(F.col("result_text").isNotNull(), F.array(result))
        .when(has_calls, markup)
        .when(F.col("text").isNotNull(), plain)
        .when(writes, F.array(call, write))
        .when(F.col("tool").isNotNull(), F.array(call))
        .when(F.col("returned").isNotNull(), F.array(returned))
        .otherwise(_none())
    )
    return rows.select("path", "block", "pos", "at", "event_ts", "token_meta", pieces.alias("pieces"))


def token_meta(entry: Column) -> Column:
    """(model, tokens) of a record, NULL when it has neither.

    Cache writes are the sum of the five-minute and the one-hour bucket.
    """
    usage = F.try_variant_get(entry, "$.message.usage", "variant")

    def count(path: str) -> Column:
        return F.coalesce(F.try_variant_get(usage, path, "bigint"), F.lit(0))

    tokens = F.struct(
        count("$.input_tokens").alias("input"),
        count("$.output_tokens").alias("output"),
        count("$.cache_read_input_tokens").alias("cache_read"),
        (
            count("$.cache_creation.ephemeral_5m_input_tokens")
            + count("$.cache_creation.ephemeral_1h_input_tokens")
        ).alias("cache_write"),
    )
    model = F.nullif(F.try_variant_get(entry, "$.message.model", "string"), F.lit(""))
    meta = F.struct(model.alias("model"), F.when(usage.isNotNull(), tokens).alias("tokens"))
    return F.when(model.isNotNull() | usage.isNotNull(), F.to_json(meta))


def records(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their parsed record, NULL where a line is not JSON."""
    trimmed = lines.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).where("line <> ''")
    return trimmed.withColumn("entry", F.try_parse_json("line"))


def numbered(lines: DataFrame) -> DataFrame:
    """Pieces of numbered lines `(path, block, pos, line)` with the positions they take in their file.

    A line counts at least one position, also when nothing comes of it. A last line
    still being written therefore gives the same events once it is complete.
    """
    # One shuffle by input split serves the windows over a line and over a split.
    rows = _with_pieces(_contents(records(lines.repartition("path", "block"))))
    line = W.partitionBy("path", "block", "pos")
    earlier = line.orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("n", F.size("pieces")).withColumns(
        {
            "taken": F.greatest(F.lit(1), F.sum("n").over(line)),
            "inside": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
        }
    )
    is_first = F.col("at") == 0
    placed = running_sum(
        rows, ["path"], "block", ["pos", "at"], F.when(is_first, F.col("taken")).otherwise(0), "before"
    )
    base = F.col("before") - F.when(is_first, 0).otherwise(F.col("taken"))
    return placed.select(
        "path", "event_ts", "token_meta", base.alias("base"), "inside", F.when(is_first, F.col("taken")).alias("taken"), "pieces"
    )


def events_of(
    rows: DataFrame, device_id: str, ingest_ts: str, redact_secrets: bool = True, first: DataFrame | None = None
) -> DataFrame:
    """Canonical events of numbered pieces; `first` has the position `next_seq` at which the lines of a path begin."""
    before = F.lit(0)
    if first is not None:
        rows = rows.join(first.select(F.col("path").alias("_path"), "next_seq"), F.col("path") == F.col("_path"), "left")
        before = F.coalesce("next_seq", F.lit(0))
    each = rows.select(
        source_id(F.col("path"), device_id).alias("source_id"),
        "path",
        F.coalesce("event_ts", F.lit(ingest_ts)).alias("event_ts"),
        "token_meta",
        (F.col("base") + before).alias("base"),
        "inside",
        F.posexplode("pieces").alias("i", "p"),
    ).withColumn("off", F.col("inside") + F.col("i"))
    each = each.select(
        "source_id", "path", "event_ts", "token_meta", (F.col("base") + F.col("off")).alias("seq"), "off", "p.*"
    )
    return promote(_finish(each, device_id, ingest_ts, redact_secrets))


def normalize(
    lines: DataFrame, device_id: str, ingest_ts: str, redact_secrets: bool = True
) -> DataFrame:
    """Canonical events of whole files, as numbered lines."""
    return events_of(numbered(lines), device_id, ingest_ts, redact_secrets)


def _finish(each: DataFrame, device_id: str, ingest_ts: str, redact_secrets: bool) -> DataFrame:
    kind = F.col("kind")
    call = F.concat(F.lit("tool:"), "tool", F.lit(":"), (F.col("off") - F.col("back")).cast("string"))
    use = F.coalesce("use_id", F.lit("undefined"))
    content = (
        F.when(kind == "markup_call", call)
        .when(kind == "markup_result", F.concat(F.lit("result:"), call))
        .when(kind == "markup_write", F.concat(F.lit("write_content:"), call))
        .when(kind == "use_call", F.concat(F.lit("tool_use:"), use))
        .when(kind == "use_write", F.concat(F.lit("write_content:"), use))
        .when(kind == "block_result", F.concat(F.lit("tool_result:"), use))
        .otherwise(F.col("text"))
    )
    is_write = kind.isin("markup_write", "use_write")
    link = F.struct(
        F.when(kind.startswith("markup"), call).alias("tool_call_id"),
        F.when(~kind.startswith("markup"), F.col("use_id")).alias("tool_use_id"),
        F.when(is_write, F.lit(True)).alias("is_write_content"),
    )
    linked = kind.startswith("markup") | F.col("use_id").isNotNull()
    meta = F.when(kind == "message", F.col("token_meta")).when(linked, F.to_json(link))
    text, spans = F.col("text"), F.lit(None).cast("array<struct<type:string,start:int,end:int,original_hash:string>>")
    args = F.col("args")
    if redact_secrets:
        text = F.when(F.col("redacted"), redact(F.col("text"))).otherwise(F.col("text"))
        spans = F.when(F.col("redacted"), manifest(F.col("text")))
        args = redact_json(args)
    return each.select(
        event_id(F.col("source_id"), F.col("seq"), content).alias("event_id"),
        "source_id",
        F.col("seq").cast("double").alias("source_seq"),
        F.lit(device_id).alias("device_id"),
        F.concat(F.lit("claude-"), project_hash_of_path(F.col("path"))).alias("project_id"),
        session_of_path(F.col("path")).alias("session_id"),
        "event_ts",
        F.lit(ingest_ts).alias("ingest_ts"),
        F.lit("claude_code_jsonl").alias("source_kind"),
        "event_type",
        text.alias("text_redacted"),
        F.col("tool").alias("tool_name"),
        args.alias("tool_args_json"),
        F.col("paths").alias("file_paths"),
        meta.alias("meta_json"),
        spans.alias("redaction_manifest"),
    )


def read(spark: SparkSession, path: str, device_id: str, ingest_ts: str, redact_secrets: bool = True) -> DataFrame:
    """Events of every session file below a folder."""
    return normalize(read_lines(spark, path, "*.jsonl"), device_id, ingest_ts, redact_secrets)


def line_status(lines: DataFrame, device_id: str) -> DataFrame:
    """(source_id, failed) per non-blank line, for the ingest report."""
    return records(lines).select(
        source_id(F.col("path"), device_id).alias("source_id"), F.col("entry").isNull().alias("failed")
    )


def working_directories(lines: DataFrame) -> DataFrame:
    """Distinct directories: the first one that a line of a file names, and the one its folder name spells."""
    cwd = F.nullif(F.try_variant_get("entry", "$.cwd", "string"), F.lit(""))
    named = (
        records(lines).withColumn("cwd", cwd)
        .where("cwd is not null")
        .groupBy("path")
        .agg(F.min_by("cwd", F.struct("block", "pos")).alias("directory"))
    )
    folder = F.regexp_extract("path", r"projects/(-[^/]+)/", 1)
    spelled = lines.select(folder.alias("folder")).distinct().where("folder <> ''")
    spelled = spelled.select(decoded_directory(F.col("folder")).alias("directory"))
    return named.select("directory").unionByName(spelled).distinct()
