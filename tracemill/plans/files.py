"""File views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.text import line_slice, snapshot_age
from tracemill.functions.timeexpr import instant_literal, to_instant
from tracemill.operators import files as H
from tracemill.operators.filters import EventFilter
from tracemill.plans import views as V
from tracemill.plans.activity import EV
from tracemill.plans.registry import register

_AT = "2024-01-20T00:00:00Z"
_AT_SQL = "event_time <= TIMESTAMP '2024-01-20 00:00:00'"
_PATH = "/src/f2.ts"
_NAMES = f"(arg_file_path = '{_PATH}' OR arg_path = '{_PATH}' OR arg_filepath = '{_PATH}')"
_SNAP = "event_type = 'tool_result' AND tool_name IN ('Read', 'read', 'Write', 'write')"

_LATEST_SQL = f"""SELECT event_id, event_ts, tool_name, text_redacted AS content FROM ev e
  WHERE {_SNAP} AND {_AT_SQL} AND (array_to_string(file_paths, ',') ILIKE '%{_PATH}%'
    OR EXISTS (SELECT 1 FROM ev c WHERE c.event_type = 'tool_call' AND c.call_id = e.call_id
      AND (c.arg_file_path = '{_PATH}' OR c.arg_path = '{_PATH}' OR c.arg_filepath = '{_PATH}')))
  ORDER BY event_ts DESC, event_id DESC LIMIT 1"""


@register("latest_content", EV + _LATEST_SQL)
def latest_content(spark, sf):
    return H.latest_content(V.agent_events(spark, sf), _PATH, _AT)


@register(
    "latest_contents",
    EV
    + f""", r AS (SELECT * FROM ev WHERE {_SNAP} AND {_AT_SQL}),
    c AS (SELECT DISTINCT unnest([arg_file_path, arg_path, arg_filepath]) AS path, call_id FROM ev
      WHERE event_type = 'tool_call'),
    both_ways AS (SELECT unnest(file_paths) AS path, event_id, event_ts FROM r
      UNION SELECT path, event_id, event_ts FROM c JOIN r USING (call_id) WHERE path IS NOT NULL),
    best AS (SELECT path, event_id, row_number() OVER (PARTITION BY path
      ORDER BY event_ts DESC, event_id DESC) AS rn FROM both_ways)
    SELECT best.path, r.event_id, r.event_ts, r.tool_name, r.text_redacted AS content
    FROM best JOIN r USING (event_id) WHERE rn = 1""",
)
def latest_contents(spark, sf):
    return H.latest_contents(V.agent_events(spark, sf), _AT)


@register(
    "line_range",
    EV
    + f"""SELECT event_id, len(string_split(content, chr(10))) AS total_lines,
      array_to_string(list_slice(string_split(content, chr(10)), 2, 5), chr(10)) AS content
    FROM ({_LATEST_SQL})""",
)
def line_range(spark, sf):
    latest = H.latest_content(V.agent_events(spark, sf), _PATH, _AT)
    return latest.select(
        "event_id",
        F.size(F.split("content", "\n", -1)).cast("bigint").alias("total_lines"),
        line_slice(F.col("content"), 2, 5).alias("content"),
    )


@register(
    "snapshot_age",
    EV
    + """, a AS (SELECT event_id, (epoch_ms(TIMESTAMP '2024-02-01 00:00:00') - epoch_ms(event_time))
        // 60000 AS m FROM ev WHERE event_type = 'tool_result')
    SELECT event_id, CASE WHEN m // 1440 > 0 THEN (m // 1440) || 'd ago'
      WHEN m // 60 > 0 THEN (m // 60) || 'h ago' ELSE m || 'm ago' END AS age,
      m // 1440 > 0 OR m // 60 > 1 AS is_stale FROM a""",
)
def snapshot_ages(spark, sf):
    ev = V.agent_events(spark, sf, False).where("event_type = 'tool_result'")
    as_of = instant_literal(to_instant("2024-02-01T00:00:00Z"))
    age, stale = snapshot_age(F.col("event_time"), as_of)
    return ev.select("event_id", age.alias("age"), stale.alias("is_stale"))


_HISTORY_SQL = f"""SELECT event_id, event_ts, tool_name, text_redacted AS content,
    CASE WHEN text_redacted = '' THEN 0 ELSE len(string_split(text_redacted, chr(10))) END AS line_count,
    session_id, project_id
  FROM ev r WHERE {_SNAP} AND EXISTS (SELECT 1 FROM ev c WHERE c.event_type = 'tool_call'
    AND c.tool_name = r.tool_name AND c.call_id = r.call_id
    AND (c.arg_file_path = '{_PATH}' OR c.arg_path = '{_PATH}' OR c.arg_filepath = '{_PATH}'))
  ORDER BY event_ts, event_id LIMIT {{limit}}"""


@register("file_history", EV + _HISTORY_SQL.format(limit=50))
def file_history(spark, sf):
    return H.file_history(V.agent_events(spark, sf), _PATH).withColumn(
        "line_count", F.col("line_count").cast("bigint")
    )


_EDIT_SQL = """SELECT event_id, event_ts, coalesce(arg_filepath, arg_file_path, arg_path, 'unknown')
    AS file_path, coalesce(arg_old, '') AS old_string, coalesce(arg_new, '') AS new_string,
    session_id, project_id FROM ev
  WHERE event_type = 'tool_call' AND tool_name IN ('Edit', 'edit') AND tool_args_json IS NOT NULL
    AND {where} ORDER BY event_ts DESC, event_id DESC LIMIT {limit}"""


@register(
    "edits",
    EV
    + _EDIT_SQL.format(
        where="project_id = 'proj-4' AND event_time >= TIMESTAMP '2024-01-02 00:00:00'", limit=20
    ),
)
def edits(spark, sf):
    return H.edits(V.agent_events(spark, sf, False), EventFilter(since="2024-01-02", project="proj-4"))


_PATH_LIKE = f"(arg_file_path ILIKE '%{_PATH}%' OR arg_path ILIKE '%{_PATH}%' OR arg_filepath ILIKE '%{_PATH}%')"


@register(
    "file_versions",
    EV
    + f""", h AS ({_HISTORY_SQL.format(limit=20)}), d AS ({_EDIT_SQL.format(where=_PATH_LIKE, limit=20)})
    SELECT event_ts, 'read' AS type, tool_name, CAST(line_count AS BIGINT) AS line_count, event_id,
      NULL::BIGINT AS old_lines, NULL::BIGINT AS new_lines, NULL::BIGINT AS line_delta FROM h
    UNION ALL SELECT event_ts, 'edit', 'Edit', NULL, event_id, len(string_split(old_string, chr(10))),
      len(string_split(new_string, chr(10))),
      len(string_split(new_string, chr(10))) - len(string_split(old_string, chr(10))) FROM d""",
)
def file_versions(spark, sf):
    rows = H.file_versions(V.agent_events(spark, sf), _PATH)
    counts = ("line_count", "old_lines", "new_lines", "line_delta")
    return rows.withColumns({c: F.col(c).cast("bigint") for c in counts})


@register(
    "file_events",
    EV
    + f"""SELECT event_id || '-r' AS event_id, event_ts, tool_name, text_redacted AS content, session_id, project_id FROM ev
    WHERE event_type = 'tool_call' AND tool_name IN ('Read', 'Write') AND {_NAMES}
    ORDER BY event_ts DESC, event_id DESC LIMIT 10""",
)
def file_events(spark, sf):
    # Results carry no arguments in the view, so every call gets a result that carries its own.
    ev = V.agent_events(spark, sf)
    calls = ev.where("event_type = 'tool_call'")
    results = calls.withColumns({"event_id": F.concat("event_id", F.lit("-r")), "event_type": F.lit("tool_result")})
    return H.file_events(ev.unionByName(results), _PATH, tools=("Read", "Write"))


@register(
    "accessed_files",
    EV
    + """SELECT coalesce(arg_file_path, arg_path, arg_filepath) AS file_path,
      max(event_ts) AS last_accessed, count(*) AS access_count,
      array_to_string(list_sort(list(DISTINCT tool_name)), ',') AS tools_used
    FROM ev WHERE event_type = 'tool_call' AND tool_name IN ('Read', 'read', 'Write', 'write', 'Edit', 'edit')
      AND coalesce(arg_file_path, arg_path, arg_filepath) IS NOT NULL
      AND (arg_file_path ILIKE '/src/f_%.ts' OR arg_path ILIKE '/src/f_%.ts' OR arg_filepath ILIKE '/src/f_%.ts')
    GROUP BY 1 ORDER BY last_accessed DESC, file_path LIMIT 30""",
)
def accessed_files(spark, sf):
    rows = H.accessed_files(V.agent_events(spark, sf, False), pattern="/src/f?*.ts", limit=30)
    return rows.withColumn("tools_used", F.array_join("tools_used", ","))


# In the view few Read results lie close to a call, so both sides are moved onto whole hours or days.
def _aligned(ev, unit="hour"):
    return ev.withColumn("event_time", F.date_trunc(unit, "event_time"))


def _aligned_sql(unit: str) -> str:
    return f"al AS (SELECT * REPLACE (date_trunc('{unit}', event_time) AS event_time) FROM ev)"


_WHOLE = "length(content) >= 1"
_READ_RESULTS = """SELECT event_id, epoch_ms(event_time) AS ms, text_redacted AS content FROM al
  WHERE event_type = 'tool_result' AND tool_name = 'Read'"""


@register(
    "read_snapshots",
    EV
    + f""", {_aligned_sql('hour')}, calls AS (SELECT arg_filepath AS path, event_ts, epoch_ms(event_time) AS ms,
        row_number() OVER (PARTITION BY arg_filepath ORDER BY event_ts DESC, event_id DESC) AS rn
        FROM al WHERE event_type = 'tool_call' AND tool_name = 'Read' AND arg_filepath IS NOT NULL),
      pairs AS (SELECT path, event_ts, content, row_number() OVER (PARTITION BY path
        ORDER BY r.ms, r.event_id) AS rn FROM calls c JOIN ({_READ_RESULTS}) r
        ON abs(r.ms - c.ms) < 5000 WHERE c.rn = 1)
    SELECT path, event_ts, content FROM pairs WHERE rn = 1 AND {_WHOLE}""",
)
def read_snapshots(spark, sf):
    return H.read_snapshots(_aligned(V.agent_events(spark, sf)))


@register(
    "read_snapshot",
    EV
    + f""", {_aligned_sql('day')}, c AS (SELECT event_ts, epoch_ms(event_time) AS ms FROM al
        WHERE event_type = 'tool_call' AND tool_name = 'Read' AND arg_filepath ILIKE '%/src/f%'
          AND event_time <= TIMESTAMP '2024-01-29 12:00:00' ORDER BY event_ts DESC, event_id DESC LIMIT 1),
      p AS (SELECT c.event_ts, content FROM c JOIN ({_READ_RESULTS}) r ON abs(r.ms - c.ms) < 5000
        ORDER BY r.ms, r.event_id LIMIT 1)
    SELECT event_ts, content FROM p WHERE {_WHOLE}""",
)
def read_snapshot(spark, sf):
    return H.read_snapshot(_aligned(V.agent_events(spark, sf), "day"), "/src/f", "2024-01-29T12:00:00Z")


_FOLD = """list_reduce(list_prepend({'old': '', 'new': '', 'c': e[1].old, 'a': 0, 'f': 0},
    list_transform(e, lambda x: {'old': x.old, 'new': x.new, 'c': '', 'a': 0, 'f': 0})),
  lambda acc, x: {'old': '', 'new': '',
    'c': CASE WHEN x.old <> '' AND x.new <> '' AND contains(acc.c, x.old)
      THEN left(acc.c, instr(acc.c, x.old) - 1) || x.new
        || substr(acc.c, instr(acc.c, x.old) + length(x.old)) ELSE acc.c END,
    'a': acc.a + CASE WHEN x.old <> '' AND x.new <> '' AND contains(acc.c, x.old) THEN 1 ELSE 0 END,
    'f': acc.f + CASE WHEN x.old <> '' AND x.new <> '' AND NOT contains(acc.c, x.old) THEN 1 ELSE 0 END})"""


@register(
    "replay_edits",
    EV
    + f""", d AS ({_EDIT_SQL.format(where=_AT_SQL, limit=1000000000)}),
    g AS (SELECT file_path, count(*) AS edits, list({{'old': old_string, 'new': new_string}}
      ORDER BY event_ts, event_id) AS e FROM d GROUP BY file_path),
    r AS (SELECT file_path, edits, {_FOLD} AS r FROM g)
    SELECT file_path, edits, CAST(r.a AS BIGINT) AS applied, CAST(r.f AS BIGINT) AS failed,
      r.c AS content FROM r""",
)
def replay_edits(spark, sf):
    ev = V.agent_events(spark, sf, False)
    rows = H.replay_edits(H._edit_rows(ev, EventFilter(until=_AT), None))
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("edits", "applied", "failed")})


_REPLAYED_SQL = f"""d AS ({_EDIT_SQL.format(where="{where}", limit=1000000000)}),
    g AS (SELECT file_path, count(*) AS edits, list({{{{'old': old_string, 'new': new_string}}}}
      ORDER BY event_ts, event_id) AS e FROM d GROUP BY file_path),
    r AS (SELECT file_path, edits, {_FOLD.replace("{", "{{").replace("}", "}}")} AS r FROM g)""".replace("FROM ev", "FROM al")


def _counted(rows):
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("edits", "applied", "failed")})


@register(
    "reconstruct",
    EV
    + f""", {_aligned_sql('day')}, c AS (SELECT event_ts, epoch_ms(event_time) AS ms FROM al
        WHERE event_type = 'tool_call' AND tool_name = 'Read' AND arg_filepath ILIKE '%{_PATH}%' AND {_AT_SQL}
        ORDER BY event_ts DESC, event_id DESC LIMIT 1),
      p AS (SELECT content FROM c JOIN ({_READ_RESULTS}) r ON abs(r.ms - c.ms) < 5000 ORDER BY r.ms, r.event_id LIMIT 1),
      s AS (SELECT content FROM p WHERE {_WHOLE}),
      {_REPLAYED_SQL.format(where=_AT_SQL + " AND " + _PATH_LIKE).replace("SELECT file_path, count(*)", "SELECT 'one' AS file_path, count(*)").replace("FROM d GROUP BY file_path", "FROM d HAVING count(*) > 0")}
    SELECT 'read' AS method, NULL::BIGINT AS edits, NULL::BIGINT AS applied, NULL::BIGINT AS failed, content FROM s
    UNION ALL SELECT 'edits', edits, CAST(r.a AS BIGINT), CAST(r.f AS BIGINT), r.c FROM r WHERE NOT EXISTS (SELECT 1 FROM s)""",
)
def reconstruct(spark, sf):
    return _counted(H.reconstruct(_aligned(V.agent_events(spark, sf), "day"), _PATH, _AT))


@register(
    "reconstruct_all",
    EV
    + f""", {_aligned_sql('hour')}, calls AS (SELECT arg_filepath AS path, epoch_ms(event_time) AS ms,
        row_number() OVER (PARTITION BY arg_filepath ORDER BY event_ts DESC, event_id DESC) AS rn FROM al
        WHERE event_type = 'tool_call' AND tool_name = 'Read' AND arg_filepath IS NOT NULL AND {_AT_SQL}),
      pairs AS (SELECT path, content, row_number() OVER (PARTITION BY path ORDER BY r.ms, r.event_id) AS rn
        FROM calls c JOIN ({_READ_RESULTS}) r ON abs(r.ms - c.ms) < 5000 WHERE c.rn = 1),
      s AS (SELECT path, content FROM pairs WHERE rn = 1 AND {_WHOLE}),
      {_REPLAYED_SQL.format(where=_AT_SQL)}
    SELECT coalesce(s.path, r.file_path) AS path, CASE WHEN s.path IS NULL THEN 'edits' ELSE 'read' END AS method,
      CASE WHEN s.path IS NULL THEN edits END AS edits, CASE WHEN s.path IS NULL THEN CAST(r.r.a AS BIGINT) END AS applied,
      CASE WHEN s.path IS NULL THEN CAST(r.r.f AS BIGINT) END AS failed,
      CASE WHEN s.path IS NULL THEN r.r.c ELSE s.content END AS content
    FROM s FULL JOIN r ON s.path = r.file_path""",
)
def reconstruct_all(spark, sf):
    return _counted(H.reconstruct_all(_aligned(V.agent_events(spark, sf)), _AT))
