"""Derived views that present the driver tables as agent activity.

Each view exists twice: as a DataFrame here and as SQL text for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NARROW = """
SELECT
  event_id AS eid,
  concat('evt_', lpad(CAST(event_id AS STRING), 9, '0')) AS event_id,
  concat('src-', user_id) AS source_id,
  CAST(event_id AS DOUBLE) AS source_seq,
  concat('dev-', user_id % 3) AS device_id,
  concat('proj-', user_id % 7) AS project_id,
  concat('ses-', user_id, '-', date_format(ts, 'yyyy-MM-dd')) AS session_id,
  date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") AS event_ts,
  CASE WHEN user_id % 2 = 0 THEN 'opencode_storage' ELSE 'claude_code_jsonl' END AS source_kind,
  CASE event_type WHEN 'click' THEN 'user_message' WHEN 'view' THEN 'assistant_message'
    WHEN 'purchase' THEN 'tool_call' WHEN 'signup' THEN 'tool_result' ELSE 'git_commit' END AS event_type,
  CASE WHEN event_type IN ('purchase', 'signup')
    THEN CASE event_id % 5 WHEN 0 THEN 'Read' WHEN 1 THEN 'Write' WHEN 2 THEN 'Edit'
      WHEN 3 THEN 'Bash' ELSE 'read' END END AS tool_name,
  concat('/src/f', (event_id DIV 5) % 40, '.ts') AS path,
  event_type = 'purchase' AS is_call,
  event_type IN ('purchase', 'signup') AS is_tool,
  event_type = 'error' AS is_commit
FROM {events}
"""

_WIDE = """
SELECT
  event_id, source_id, source_seq, device_id, project_id, session_id, event_ts,
  source_kind, event_type, tool_name,
  try_cast(event_ts AS TIMESTAMP) AS event_time,
  split_part(event_ts, 'T', 1) AS event_date,
  CASE WHEN is_call AND eid % 5 <> 3 AND eid % 3 = 0 THEN path END AS arg_file_path,
  CASE WHEN is_call AND eid % 5 <> 3 AND eid % 3 = 1 THEN path END AS arg_path,
  CASE WHEN is_call AND eid % 5 <> 3 AND eid % 3 = 2 THEN path END AS arg_filepath,
  CASE WHEN is_call AND eid % 5 = 2 THEN concat('w', (eid DIV 200) % 3) END AS arg_old,
  CASE WHEN is_call AND eid % 5 = 2 AND eid % 11 <> 0
    THEN concat('w', (eid DIV 200 + 1) % 3, ' x', eid % 7) END AS arg_new,
  CASE WHEN is_call THEN CASE WHEN eid % 5 = 3 THEN concat('{{"command":"run ', eid % 9, '"}}')
    ELSE concat('{{"', CASE eid % 3 WHEN 0 THEN 'file_path' WHEN 1 THEN 'path' ELSE 'filePath' END,
      '":"', path, '"}}') END END AS tool_args_json,
  CASE WHEN is_tool AND eid % 5 <> 3 AND eid % 2 = 0 THEN array(path) END AS file_paths,
  CASE WHEN is_tool THEN concat('c-', eid % 300) END AS call_id,
  CAST(NULL AS STRING) AS use_id,
  concat('m-', eid DIV 2) AS message_id,
  CASE eid % 6 WHEN 0 THEN 'claude-sonnet-4-5' WHEN 1 THEN 'gpt-4o-2024-08-06'
    WHEN 2 THEN 'claude-opus-4.1' WHEN 3 THEN 'mystery-model-x' WHEN 4 THEN 'GPT-5_mini'
    ELSE 'claude-next' END AS model,
  CASE WHEN eid % 11 <> 0 THEN eid % 1000 END AS tok_input,
  CASE WHEN eid % 11 <> 0 THEN eid % 700 END AS tok_output,
  CASE WHEN eid % 11 <> 0 THEN eid % 50 END AS tok_reasoning,
  CASE WHEN eid % 11 <> 0 THEN eid % 5000 END AS tok_cache_read,
  CASE WHEN eid % 11 <> 0 THEN eid % 300 END AS tok_cache_write,
  CASE WHEN is_commit THEN named_struct(
    'sha', sha2(CAST(eid AS STRING), 256), 'short_sha', CAST(NULL AS STRING),
    'files_changed', eid % 6, 'insertions', eid % 90, 'deletions', eid % 40,
    'branch', concat('b', eid % 3), 'to_branch', CASE WHEN eid % 4 = 0 THEN 'main' END) END AS git,
  eid
FROM {narrow}
"""

_TEXT_TAIL = """CASE eid % 13 WHEN 0 THEN ' error' WHEN 1 THEN ' failed' WHEN 2 THEN ' TS12:'
    WHEN 3 THEN ' }}' WHEN 4 THEN ' )' ELSE '' END"""


def events_of(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Canonical events without text of rows like those of `events`, also of a stream."""
    return spark.sql(_WIDE, narrow=spark.sql(_NARROW, events=rows))


def agent_events(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """Canonical events from `events`, with texts from `documents`.

    Without text the documents are not read at all.
    """
    wide = events_of(spark, table(spark, sf_dir, "events"))
    if not with_text:
        return wide.drop("eid")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    number = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    tail = F.expr(_TEXT_TAIL.replace("}}", "}"))
    return (
        wide.withColumn("doc_id", F.col("eid") % number.scalar())
        .join(docs, "doc_id")
        .withColumn("text_redacted", F.concat("text", tail))
        .drop("eid", "doc_id", "text")
    )


AGENT_EVENTS_SQL = """
SELECT
  'evt_' || lpad(CAST(e.event_id AS VARCHAR), 9, '0') AS event_id,
  'src-' || e.user_id AS source_id,
  CAST(e.event_id AS DOUBLE) AS source_seq,
  'proj-' || (e.user_id % 7) AS project_id,
  'dev-' || (e.user_id % 3) AS device_id,
  'ses-' || e.user_id || '-' || strftime(e.ts, '%Y-%m-%d') AS session_id,
  strftime(e.ts, '%Y-%m-%dT%H:%M:%SZ') AS event_ts,
  date_trunc('second', e.ts) AS event_time,
  strftime(e.ts, '%Y-%m-%d') AS event_date,
  CASE WHEN e.user_id % 2 = 0 THEN 'opencode_storage' ELSE 'claude_code_jsonl' END AS source_kind,
  CASE e.event_type WHEN 'click' THEN 'user_message' WHEN 'view' THEN 'assistant_message'
    WHEN 'purchase' THEN 'tool_call' WHEN 'signup' THEN 'tool_result' ELSE 'git_commit' END AS event_type,
  CASE WHEN e.event_type IN ('purchase', 'signup')
    THEN CASE e.event_id % 5 WHEN 0 THEN 'Read' WHEN 1 THEN 'Write' WHEN 2 THEN 'Edit'
      WHEN 3 THEN 'Bash' ELSE 'read' END END AS tool_name,
  CASE WHEN e.event_type = 'purchase' AND e.event_id % 5 <> 3 AND e.event_id % 3 = 0
    THEN '/src/f' || ((e.event_id // 5) % 40) || '.ts' END AS arg_file_path,
  CASE WHEN e.event_type = 'purchase' AND e.event_id % 5 <> 3 AND e.event_id % 3 = 1
    THEN '/src/f' || ((e.event_id // 5) % 40) || '.ts' END AS arg_path,
  CASE WHEN e.event_type = 'purchase' AND e.event_id % 5 <> 3 AND e.event_id % 3 = 2
    THEN '/src/f' || ((e.event_id // 5) % 40) || '.ts' END AS arg_filepath,
  CASE WHEN e.event_type = 'purchase' AND e.event_id % 5 = 2
    THEN 'w' || ((e.event_id // 200) % 3) END AS arg_old,
  CASE WHEN e.event_type = 'purchase' AND e.event_id % 5 = 2 AND e.event_id % 11 <> 0
    THEN 'w' || ((e.event_id // 200 + 1) % 3) || ' x' || (e.event_id % 7) END AS arg_new,
  CASE WHEN e.event_type = 'purchase' THEN
    CASE WHEN e.event_id % 5 = 3 THEN '{"command":"run ' || (e.event_id % 9) || '"}'
    ELSE '{"' || CASE e.event_id % 3 WHEN 0 THEN 'file_path' WHEN 1 THEN 'path' ELSE 'filePath' END
      || '":"/src/f' || ((e.event_id // 5) % 40) || '.ts"}' END END AS tool_args_json,
  CASE WHEN e.event_type IN ('purchase', 'signup') AND e.event_id % 5 <> 3 AND e.event_id % 2 = 0
    THEN ['/src/f' || ((e.event_id // 5) % 40) || '.ts'] END AS file_paths,
  CASE WHEN e.event_type IN ('purchase', 'signup') THEN 'c-' || (e.event_id % 300) END AS call_id,
  'm-' || (e.event_id // 2) AS message_id,
  CASE e.event_id % 6 WHEN 0 THEN 'claude-sonnet-4-5' WHEN 1 THEN 'gpt-4o-2024-08-06'
    WHEN 2 THEN 'claude-opus-4.1' WHEN 3 THEN 'mystery-model-x' WHEN 4 THEN 'GPT-5_mini'
    ELSE 'claude-next' END AS model,
  CASE WHEN e.event_id % 11 <> 0 THEN e.event_id % 1000 END AS tok_input,
  CASE WHEN e.event_id % 11 <> 0 THEN e.event_id % 700 END AS tok_output,
  CASE WHEN e.event_id % 11 <> 0 THEN e.event_id % 50 END AS tok_reasoning,
  CASE WHEN e.event_id % 11 <> 0 THEN e.event_id % 5000 END AS tok_cache_read,
  CASE WHEN e.event_id % 11 <> 0 THEN e.event_id % 300 END AS tok_cache_write,
  CASE WHEN e.event_type = 'error' THEN sha256(CAST(e.event_id AS VARCHAR)) END AS git_sha,
  CASE WHEN e.event_type = 'error' THEN e.event_id % 6 END AS git_files,
  CASE WHEN e.event_type = 'error' THEN e.event_id % 90 END AS git_insertions,
  CASE WHEN e.event_type = 'error' THEN e.event_id % 40 END AS git_deletions,
  CASE WHEN e.event_type = 'error' THEN
    CASE WHEN e.event_id % 4 = 0 THEN 'main' ELSE 'b' || (e.event_id % 3) END END AS git_branch,
  d.text || CASE e.event_id % 13 WHEN 0 THEN ' error' WHEN 1 THEN ' failed' WHEN 2 THEN ' TS12:'
    WHEN 3 THEN ' }' WHEN 4 THEN ' )' ELSE '' END AS text_redacted
FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
"""


def agent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of `conversations`, spaced 50 or 130 minutes apart."""
    return messages_of(spark, table(spark, sf_dir, "conversations"))


def messages_of(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return spark.sql(
        """
        SELECT
          concat('msg_', lpad(CAST(conv_id AS STRING), 7, '0'), '_', lpad(CAST(turn AS STRING), 4, '0'))
            AS event_id,
          CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message'
            ELSE 'system' END AS event_type,
          concat('conv-', conv_id) AS session_id,
          concat('proj-', conv_id % 7) AS project_id,
          date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'") AS event_ts,
          try_cast(date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'") AS TIMESTAMP) AS event_time,
          date_format(t, 'yyyy-MM-dd') AS event_date,
          CAST(NULL AS STRING) AS tool_name,
          CAST(NULL AS STRING) AS tool_args_json,
          text AS text_redacted
        FROM (SELECT *, TIMESTAMP_NTZ '2024-01-01 00:00:00'
          + make_interval(0, 0, 0, 0, CAST(conv_id AS INT),
              CAST(turn * CASE WHEN conv_id % 2 = 0 THEN 50 ELSE 130 END AS INT), 0) AS t
          FROM {conversations})
        """,
        conversations=rows,
    )


AGENT_MESSAGES_SQL = """
SELECT
  'msg_' || lpad(CAST(conv_id AS VARCHAR), 7, '0') || '_' || lpad(CAST(turn AS VARCHAR), 4, '0') AS event_id,
  CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message' ELSE 'system' END
    AS event_type,
  'conv-' || conv_id AS session_id,
  'proj-' || (conv_id % 7) AS project_id,
  strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS event_ts,
  t AS event_time,
  text AS text_redacted
FROM (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS BIGINT))
  + to_minutes(CAST(turn * CASE WHEN conv_id % 2 = 0 THEN 50 ELSE 130 END AS BIGINT)) AS t
  FROM conversations)
"""

# Project roots: nested, and one that shares a prefix with another without a slash.
_ROOTS = ("/w/a", "/w/a/b", "/w/ab", "/w/c_d", "/w/c", "/x", "/x/y/z")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project per group of seven users, derived from `events`."""
    return spark.sql(
        """
        SELECT concat('proj-', k) AS project_id, concat('Name ', k) AS display_name,
          element_at(array({roots}), CAST(k + 1 AS INT)) AS root_path,
          concat('2024-01-0', k + 1, 'T00:00:00Z') AS created_at
        FROM (SELECT DISTINCT user_id % 7 AS k FROM {events})
        """.replace("{roots}", ", ".join(f"'{r}'" for r in _ROOTS)),
        events=table(spark, sf_dir, "events"),
    )


PROJECTS_SQL = f"""
SELECT 'proj-' || k AS project_id, 'Name ' || k AS display_name,
  [{", ".join(f"'{r}'" for r in _ROOTS)}][k + 1] AS root_path,
  '2024-01-0' || (k + 1) || 'T00:00:00Z' AS created_at
FROM (SELECT DISTINCT user_id % 7 AS k FROM events)
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents: id, content, metadata, created_at."""
    return spark.sql(
        """
        SELECT concat('doc-', lpad(CAST(doc_id AS STRING), 8, '0')) AS id, text AS content,
          concat('{{"source":"', source, '","tags":["', lang, '"]}}') AS metadata,
          CASE WHEN doc_id % 10 = 9 THEN 'unknown'
            ELSE concat('2024-', lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0'), '-15T00:00:00Z') END
            AS created_at
        FROM {documents}
        """,
        documents=table(spark, sf_dir, "documents"),
    )


DOCUMENTS_SQL = """
SELECT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id, text AS content, source, lang,
  CASE WHEN doc_id % 10 = 9 THEN 'unknown'
    ELSE '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-15T00:00:00Z' END AS created_at
FROM documents
"""
