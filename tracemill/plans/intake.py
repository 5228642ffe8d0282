"""Files that grow between two runs of ingestion, written from the driver tables."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.store import read_events
from tracemill.plans import views as V
from tracemill.plans.ingestion import _DEVICE, _SECRET_LIST, _SECRETS, _redacted_sql
from tracemill.plans.registry import register
from tracemill.session import run_folder
from tracemill.streaming import ingest as G

_FILES = 20
_RUNS = ("2024-06-01T00:00:00.000Z", "2024-06-03T00:00:00.000Z")
_HEAD, _FOOT = '","timestamp":"2024-01-01T00:00:00Z","message":{"content":', "}}"


def put(table: pa.Table) -> pa.Table:
    """Writes or continues one file; `anew` says which."""
    from pyarrow import fs

    path, text = table["path"][0].as_py(), "".join(table.sort_by("at")["text"].to_pylist())
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    before = b""
    if not table["anew"][0].as_py() and system.get_file_info(inner).type == fs.FileType.File:
        with system.open_input_stream(inner) as old:
            before = old.read()
    with system.open_output_stream(inner) as out:
        out.write(io.BytesIO(before + text.encode()).getbuffer())
    return table.select(["path"]).slice(0, 1)


def _session_files(spark, sf, folder: str) -> DataFrame:
    """(path, at, line, late): lines of session files; late ones come with the second run."""
    rows = V.table(spark, sf, "conversations")
    half = rows.agg(F.expr("max(conv_id) div 2")).first()[0]
    secret = F.element_at(F.array(*[F.lit(s) for s in (*_SECRETS, "none")]), ((F.col("conv_id") + F.col("turn")) % 33 + 1).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), secret, F.lit(" ."))
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    kind = F.when(F.col("role") == "system", "summary").otherwise(F.col("role"))
    number = F.lpad((F.col("conv_id") % _FILES).cast("string"), 6, "0")
    return rows.select(
        F.concat(F.lit(f"{folder}/projects/-w/"), number, F.lit(".jsonl")).alias("path"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("at"),
        F.concat(F.lit('{"type":"'), kind, F.lit(_HEAD), quoted, F.lit(_FOOT)).alias("line"),
        (F.col("conv_id") > half).alias("late"),
    )


def _run_twice(spark, sf, name: str) -> str:
    """Two runs over files that grow between them: most end in the middle of a line at first, and one is written anew."""
    home = run_folder(spark, name)
    files = _session_files(spark, sf, f"{home}/in")
    # the first late line of a file comes in two parts
    first = files.where("late").groupBy("path").agg(F.min("at").alias("at"), F.min_by("line", "at").alias("line"))
    last = F.col("path").endswith(f"{_FILES - 1:06}.jsonl")
    early = files.where("not late").select("path", "at", F.concat("line", F.lit("\n")).alias("text"))
    begun = first.where(~last).select("path", "at", F.left("line", F.lit(20)).alias("text"))
    early.unionAll(begun).withColumn("anew", F.lit(True)).groupBy("path").applyInArrow(put, "path string").write.format("noop").mode("overwrite").save()
    G.ingest_grown(spark, f"{home}/in", f"{home}/store", "sessions", _DEVICE, _RUNS[0])
    starts = first.select(F.col("path").alias("_path"), F.col("at").alias("_at"))
    late = files.where("late").join(starts, F.col("path") == F.col("_path")).withColumn("is_first", F.col("at") == F.col("_at"))
    rest = F.when(F.col("is_first") & ~last, F.substring("line", 21, 1 << 30)).otherwise(F.col("line"))
    late = late.where(~last | F.col("is_first")).select("path", "at", F.concat(rest, F.lit("\n")).alias("text"), last.alias("anew"))
    late.groupBy("path").applyInArrow(put, "path string").write.format("noop").mode("overwrite").save()
    for run in (_RUNS[1], _RUNS[1]):  # the third run finds nothing
        G.ingest_grown(spark, f"{home}/in", f"{home}/store", "sessions", _DEVICE, run)
    return f"{home}/store"


_TEXT = f"coalesce(text, '') || ' ' || [{_SECRET_LIST}][(conv_id + turn) % 33 + 1] || ' .'"
_LINES_SQL = f"""WITH c AS (SELECT conv_id % {_FILES} AS file, conv_id * 1000 + turn AS place, role, {_TEXT} AS text,
    conv_id > (SELECT max(conv_id) // 2 FROM conversations) AS late FROM conversations),
  l AS (SELECT *, strlen('{{"type":"' || CASE role WHEN 'system' THEN 'summary' ELSE role END || '{_HEAD}'
      || CAST(to_json(text) AS VARCHAR) || '{_FOOT}') + 1 AS bytes,
    row_number() OVER (PARTITION BY file, late ORDER BY place) AS nth FROM c),
  r AS (SELECT *, late AND file = {_FILES - 1} AS anew FROM l WHERE NOT (late AND file = {_FILES - 1} AND nth > 1)),
  s AS (SELECT *, CAST(CASE WHEN anew THEN 0 ELSE row_number() OVER (PARTITION BY file, anew ORDER BY place) - 1 END AS BIGINT)
    AS seq FROM r)"""


@register(
    "ingest_grown",
    _LINES_SQL
    + f""" SELECT lpad(CAST(file AS VARCHAR), 6, '0') AS session_id, CAST(seq AS DOUBLE) AS source_seq,
      CASE role WHEN 'user' THEN 'user_message' ELSE 'assistant_message' END AS event_type,
      {_redacted_sql("text")} AS text_redacted FROM s WHERE role <> 'system'""",
)
def ingest_grown(spark, sf):
    events = read_events(spark, _run_twice(spark, sf, "ingest-grown"))
    return events.select("session_id", "source_seq", "event_type", "text_redacted")


@register(
    "ingest_progress",
    _LINES_SQL
    + f""", p AS (SELECT lpad(CAST(file AS VARCHAR), 6, '0') AS session_id, file, late, count(*) AS lines,
      CAST(sum(bytes) AS BIGINT) AS bytes, max(seq) + 1 AS next_seq, bool_or(anew) AS anew FROM s GROUP BY file, late)
    SELECT session_id, CASE WHEN late THEN '{_RUNS[1]}' ELSE '{_RUNS[0]}' END AS run,
      CAST(CASE WHEN anew THEN 0 ELSE coalesce(lag(bytes) OVER (PARTITION BY file ORDER BY late), 0) END AS BIGINT) AS start,
      lines, bytes, next_seq FROM p""",
)
def ingest_progress(spark, sf):
    rows = G.progress(spark, _run_twice(spark, sf, "ingest-progress"))
    return rows.select(F.regexp_extract("path", r"([0-9]+)\.jsonl$", 1).alias("session_id"), "run", "start", "lines", "bytes", "next_seq")
