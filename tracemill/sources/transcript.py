"""Plain-text transcripts of agent sessions.

What a line means depends on the lines before it, so each input block is first reduced to
the state it ends in for every state it may start in. Those small tables are chained per
file, and then every block is read from its known start. No task holds a whole file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.functions.identity import decoded_directory, project_id, sha_prefix, source_id
from tracemill.functions.redaction import redact, redact_json
from tracemill.functions.timeexpr import iso_from_time
from tracemill.schema import promote
from tracemill.sources.calls import TRANSCRIPT_PATH_KEYS, map_paths
from tracemill.sources.lines import read_lines

# States between two lines. An answer is told apart by whether it has text so far, also
# while a thought interrupts it.
_OUT, _USER_HEAD, _QUERY, _EMPTY, _FILLED, _EMPTY_THINK, _FILLED_THINK, _ARGS, _RESULT = range(9)
_STATES = 9

# Kinds of line, as told by the text of the line alone.
_KINDS = (
    "other",
    "user",  # `user:` at the start of the line and nothing else
    "user_inset",  # the same behind blanks
    "user_more",  # starts with `user:` but goes on
    "query",
    "query_end",
    "answer",  # `A:` at the start of the line and nothing else
    "answer_inset",
    "answer_more",
    "think",
    "think_end",
    "call",
    "result",
    "tool_other",  # any other line that starts with `[Tool`
)
_K = {name: i for i, name in enumerate(_KINDS)}
_TOOL = {_K["call"], _K["result"], _K["tool_other"]}
_USER_START = {_K["user"], _K["user_more"]}
_ANSWER_START = {_K["answer"], _K["answer_more"]}


@dataclass(frozen=True)
class _Step:
    """What one line does in one state.

    `ended` counts answers with text that end before the line. `opens` is 1 where the
    line opens a section of a kind other than an answer, `outer` where it opens one that
    is not a thought.
    """

    state: int
    section: str | None = None
    is_text: bool = False
    ended: int = 0
    opens: int = 0
    outer: int = 0


def _header(kind: int, ended: int) -> _Step:
    """A line seen outside of any section."""
    if kind in (_K["user"], _K["user_inset"]):
        return _Step(_USER_HEAD, ended=ended)
    if kind in (_K["answer"], _K["answer_inset"]):
        return _Step(_EMPTY, "assistant", ended=ended, outer=1)
    if kind == _K["call"]:
        return _Step(_ARGS, "tool_call", ended=ended, opens=1, outer=1)
    if kind == _K["result"]:
        return _Step(_RESULT, "tool_result", ended=ended, opens=1, outer=1)
    return _Step(_OUT, ended=ended)


def _step(state: int, kind: int, indented: bool, blank: bool) -> _Step:
    if state == _USER_HEAD and kind == _K["query"]:
        return _Step(_QUERY, "user", opens=1, outer=1)
    if state == _QUERY:
        return _Step(_OUT) if kind == _K["query_end"] else _Step(_QUERY, "user", True)
    if state in (_EMPTY_THINK, _FILLED_THINK):
        if kind != _K["think_end"]:
            return _Step(state, "thinking", True)
        return _Step(_EMPTY if state == _EMPTY_THINK else _FILLED, "assistant")
    if state in (_EMPTY, _FILLED) and kind not in _USER_START | _TOOL:
        if kind == _K["think"]:
            return _Step(_EMPTY_THINK if state == _EMPTY else _FILLED_THINK, "thinking", opens=1)
        return _Step(_EMPTY if state == _EMPTY and blank else _FILLED, "assistant", True)
    if state == _ARGS and indented:
        return _Step(_ARGS, "tool_call", True)
    if state == _RESULT and kind not in _USER_START | _TOOL | _ANSWER_START:
        return _Step(_RESULT, "tool_result", True)
    return _header(kind, 1 if state == _FILLED else 0)


_STEPS = {
    (state, kind, indented, blank): _step(state, kind, indented, blank)
    for state in range(_STATES)
    for kind in range(len(_KINDS))
    for indented in (False, True)
    for blank in (False, True)
}


def _line_kind(line: Column) -> Column:
    bare = F.regexp_replace(line, r"^\s+|\s+$", "")
    rules = [
        ((bare == "user:") & line.startswith("user:"), "user"),
        (bare == "user:", "user_inset"),
        (line.startswith("user:"), "user_more"),
        (bare == "<user_query>", "query"),
        (bare == "</user_query>", "query_end"),
        ((bare == "A:") & line.startswith("A:"), "answer"),
        (bare == "A:", "answer_inset"),
        (line.startswith("A:"), "answer_more"),
        (bare == "<think>", "think"),
        (bare == "</think>", "think_end"),
        (line.startswith("[Tool call] "), "call"),
        (line.startswith("[Tool result] "), "result"),
        (line.startswith("[Tool"), "tool_other"),
    ]
    kind = F.lit(_K["other"])
    for test, name in reversed(rules):
        kind = F.when(test, F.lit(_K[name])).otherwise(kind)
    return kind


def _classified(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    return lines.withColumns(
        {
            "kind": _line_kind(line),
            "indented": line.startswith("  "),
            "blank": ~line.rlike(r"\S"),
        }
    )


def _in_order(rows: pa.Table, columns: list[str]) -> Iterator[tuple]:
    """Rows by position, as tuples."""
    lists = rows.sort_by("pos").select(columns).to_pydict()
    return zip(*lists.values())


def _summary(rows: pa.Table) -> pa.Table:
    """For each start state: end state, sections counted, outer sections, thoughts."""
    runs = [[s, 0, 0, 0] for s in range(_STATES)]
    for key in _in_order(rows, ["kind", "indented", "blank"]):
        for run in runs:
            step = _STEPS[run[0], *key]
            run[0] = step.state
            run[1] += step.ended + step.opens
            run[2] += step.outer
            run[3] += step.section == "thinking" and step.opens
    first = rows.slice(0, 1)
    return pa.table({"path": first["path"], "block": first["block"], "runs": [runs]}, schema=_SUMMARY)


_SUMMARY = pa.schema(
    [("path", pa.string()), ("block", pa.int64()), ("runs", pa.list_(pa.list_(pa.int64())))]
)
_PARTS = pa.schema(
    [
        ("path", pa.string()),
        ("modified", pa.timestamp("us", "UTC")),
        ("section", pa.string()),
        ("outer_no", pa.int64()),
        ("inner_no", pa.int64()),
        ("block", pa.int64()),
        ("pos", pa.int64()),
        ("line", pa.string()),
        ("is_text", pa.bool_()),
        ("seq", pa.int64()),
    ]
)
_PARTS_DDL = (
    "path string, modified timestamp, section string, outer_no long, inner_no long, block long, pos long, "
    "line string, is_text boolean, seq long"
)


def _assign(rows: pa.Table) -> pa.Table:
    """Lines of sections, numbered from the known start of the block."""
    state, count, outer, inner = rows["start"][0].as_py()
    out = []
    columns = ["path", "modified", "block", "pos", "line", "kind", "indented", "blank"]
    for path, modified, block, pos, line, *key in _in_order(rows, columns):
        step = _STEPS[state, *key]
        state = step.state
        count += step.ended
        outer += step.outer
        thought = step.section == "thinking"
        inner += thought and step.opens
        if step.section:
            number = inner if thought else 0
            seq = count if step.opens or step.section == "assistant" else -1
            out.append((path, modified, step.section, outer, number, block, pos, line, step.is_text, seq))
        count += step.opens
        if thought and step.opens:
            # The answer comes after the thoughts inside it.
            out.append((path, modified, "assistant", outer, 0, block, pos, None, False, count))
    columns = zip(*out) if out else [[]] * len(_PARTS)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _PARTS)], schema=_PARTS)


def _sections(lines: DataFrame) -> DataFrame:
    """Lines that belong to a section, with the numbers of the section.

    Both passes read the same shuffle of the lines by input block.
    """
    typed = _classified(lines.select("path", "block", "pos", "line", "modified").repartition("path", "block"))
    runs = typed.groupBy("path", "block").applyInArrow(
        _summary, "path string, block long, runs array<array<long>>"
    )
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    zero = F.array(*[F.lit(v).cast("bigint") for v in (_OUT, 0, 0, 0)])

    def follow(at: Column, table: Column) -> Column:
        run = F.element_at(table, (at[0] + 1).cast("int"))
        return F.array(run[0], at[1] + run[1], at[2] + run[2], at[3] + run[3])

    starts = runs.select(
        "path", "block", F.aggregate(F.collect_list("runs").over(before), zero, follow).alias("start")
    )
    return typed.join(starts, ["path", "block"]).groupBy("path", "block").applyInArrow(_assign, _PARTS_DDL)


def _arguments(lines: Column) -> Column:
    """`key: value` lines as a map; a repeated key keeps its last value."""
    pairs = F.filter(
        F.transform(
            lines,
            lambda line: F.struct(
                F.trim(F.regexp_extract(line, r"^\s*([^:]+):", 1)).alias("k"),
                F.regexp_replace(F.regexp_replace(line, r"^[^:]*:", ""), r"^\s+|\s+$", "").alias("v"),
            ),
        ),
        lambda p: p["k"] != "",
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])
    return F.map_from_arrays(keys, values)


def blocks(lines: DataFrame) -> DataFrame:
    """(path, modified, seq, type, text, tool, args) of every section, in order.

    Thinking comes before the answer it belongs to; an answer without text is dropped.
    """
    text_line = F.when(F.col("is_text"), F.struct("block", "pos", "line"))
    body = F.transform(F.array_sort(F.collect_list(text_line)), lambda e: e["line"])
    grouped = _sections(lines).groupBy("path", "outer_no", "section", "inner_no").agg(
        F.max("modified").alias("modified"),
        F.max("seq").alias("seq"),
        F.max(F.when(~F.col("is_text"), F.col("line"))).alias("head"),
        body.alias("body"),
    )
    is_call = F.col("section") == "tool_call"
    text = F.regexp_replace(F.array_join("body", "\n"), r"^\s+|\s+$", "")
    args = _arguments(F.col("body"))
    tool = F.regexp_replace(
        F.regexp_replace("head", r"^\[Tool (?:call|result)\] ", ""), r"^\s+|\s+$", ""
    )
    return grouped.select(
        "path",
        "modified",
        "seq",
        F.col("section").alias("type"),
        F.when(is_call, "").otherwise(text).alias("text"),
        F.when(F.col("section").isin("tool_call", "tool_result"), tool).alias("tool"),
        F.when(is_call & (F.size(args) > 0), args).alias("args"),
    ).where((F.col("type") != "assistant") | (F.col("text") != ""))


def normalize(
    lines: DataFrame, device_id: str, ingest_ts: str, redact_secrets: bool = True
) -> DataFrame:
    """Canonical events of transcript lines `(path, block, pos, line, modified)`."""
    found = blocks(lines)
    source = source_id(F.col("path"), device_id)
    payload = F.to_json(
        F.struct("text", "type", F.col("tool").alias("toolName"))
    )
    key = F.concat(source, F.lit(":"), F.col("seq").cast("string"), F.lit(":"), sha_prefix(payload, 16))
    args = F.to_json("args")
    directory = decoded_directory(F.regexp_extract("path", r"([^/]+)/agent-transcripts/[^/]+$", 1))
    null = F.lit(None).cast("string")
    event_type = (
        F.when(F.col("type") == "user", "user_message")
        .when(F.col("type").isin("assistant", "thinking"), "assistant_message")
        .otherwise(F.col("type"))
    )
    raw = found.select(
        F.sha2(key, 256).alias("event_id"),
        source.alias("source_id"),
        F.col("seq").cast("double").alias("source_seq"),
        F.lit(device_id).alias("device_id"),
        project_id(null, directory).alias("project_id"),
        F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("session_id"),
        iso_from_time(F.col("modified")).alias("event_ts"),
        F.lit(ingest_ts).alias("ingest_ts"),
        F.lit("cursor_transcript").alias("source_kind"),
        event_type.alias("event_type"),
        (redact(F.col("text")) if redact_secrets else F.col("text")).alias("text_redacted"),
        F.col("tool").alias("tool_name"),
        (redact_json(args) if redact_secrets else args).alias("tool_args_json"),
        map_paths(F.col("args"), TRANSCRIPT_PATH_KEYS).alias("file_paths"),
        F.when(F.col("type") == "thinking", F.lit('{"reasoning":true}')).alias("meta_json"),
        F.lit(None).cast("array<struct<type:string,start:int,end:int,original_hash:string>>").alias(
            "redaction_manifest"
        ),
    )
    return promote(raw)


def read(
    spark: SparkSession, path: str, device_id: str, ingest_ts: str, redact_secrets: bool = True
) -> DataFrame:
    return normalize(read_lines(spark, path, "*.txt"), device_id, ingest_ts, redact_secrets)


def working_directories(files: DataFrame) -> DataFrame:
    """Distinct directories spelled by the folders of transcript files."""
    folder = F.regexp_extract("path", r"([^/]+)/agent-transcripts/[^/]+\.txt$", 1)
    named = files.select(folder.alias("folder")).where("folder <> ''")
    return named.select(decoded_directory(F.col("folder")).alias("directory")).distinct()
