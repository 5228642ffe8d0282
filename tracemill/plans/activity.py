"""Timelines, conversations, projects, sessions, topics."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tracemill.functions.text import error_preview, event_label, flatten_newlines, is_error_text, truncate
from tracemill.functions.timeexpr import parse_time_column
from tracemill.operators import projects as P
from tracemill.operators import timeline as T
from tracemill.operators import topics as C
from tracemill.operators.filters import EventFilter, apply_filter
from tracemill.plans import views as V
from tracemill.plans.registry import joined, register

EV = f"WITH ev AS ({V.AGENT_EVENTS_SQL}) "
MSG = f"WITH msg AS ({V.AGENT_MESSAGES_SQL}) "
PROJ = f"projects AS ({V.PROJECTS_SQL})"

_TIMELINE_SQL = """
  event_id, event_type, event_ts, text_redacted, tool_name, tool_args_json,
  array_to_string(file_paths, ',') AS file_paths, left(git_sha, 7) AS git_sha,
  git_files AS git_files_changed, git_insertions, git_deletions, git_branch,
  session_id, project_id, false AS has_encrypted_original
"""


def _flat(df):
    return df.withColumn("file_paths", F.array_join("file_paths", ","))


@register(
    "timeline_page",
    EV
    + f"""SELECT {_TIMELINE_SQL} FROM ev
    WHERE event_time >= TIMESTAMP '2024-01-05 00:00:00' AND event_time <= TIMESTAMP '2024-01-20 12:00:00'
      AND project_id = 'proj-3'
    ORDER BY event_ts, event_id LIMIT 100 OFFSET 20""",
)
def timeline_page(spark, sf):
    flt = EventFilter(since="2024-01-05", until="2024-01-20T12:00:00Z", project="proj-3")
    return _flat(T.timeline(V.agent_events(spark, sf), flt, 100, 20))


@register(
    "timeline_wildcard",
    EV
    + f"""SELECT {_TIMELINE_SQL} FROM ev
    WHERE project_id ILIKE 'proj-%' AND session_id ILIKE 'ses-1%-2024-01-0%'
      AND event_type IN ('tool_call', 'tool_result')
      AND (tool_name ILIKE 're%' OR tool_name ILIKE 'bash')
    ORDER BY event_ts, event_id LIMIT 200""",
)
def timeline_wildcard(spark, sf):
    flt = EventFilter(
        project="proj-*",
        session="ses-1*-2024-01-0%",
        event_types=("tool_call", "tool_result"),
        tool_names=("re*", "Bash"),
    )
    return _flat(T.timeline(V.agent_events(spark, sf), flt, 200))


@register(
    "timeline_nogit",
    EV
    + f"""SELECT {_TIMELINE_SQL} FROM ev
    WHERE event_type NOT IN ('git_commit', 'git_diff', 'git_branch', 'git_merge', 'git_stash', 'git_tag')
      AND session_id = 'ses-7-2024-01-01'
    ORDER BY event_ts, event_id LIMIT 100""",
)
def timeline_nogit(spark, sf):
    flt = EventFilter(include_git=False, session="ses-7-2024-01-01")
    return _flat(T.timeline(V.agent_events(spark, sf), flt))


@register(
    "timeline_role",
    EV
    + f"""SELECT {_TIMELINE_SQL} FROM ev WHERE event_type = 'assistant_message'
    ORDER BY event_ts, event_id LIMIT 100 OFFSET 300""",
)
def timeline_role(spark, sf):
    return _flat(T.timeline(V.agent_events(spark, sf), EventFilter(role="assistant"), 100, 300))


@register(
    "timeline_resolved_project",
    EV
    + f"""SELECT {_TIMELINE_SQL} FROM ev WHERE project_id = 'proj-3' AND tool_name IN ('Edit', 'Write')
    ORDER BY event_ts, event_id LIMIT 100""",
)
def timeline_resolved_project(spark, sf):
    flt = EventFilter(project="ame 3", tool_names=("Edit", "Write"))
    return _flat(T.timeline(V.agent_events(spark, sf), flt, projects=V.projects(spark, sf)))


_PAGE_500 = "SELECT * FROM ev ORDER BY event_ts, event_id LIMIT 500"


@register(
    "timeline_summary",
    EV
    + f"""SELECT count(*) AS total_events,
      nullif(count(*) FILTER (event_type = 'git_commit'), 0) AS commits_count,
      nullif(CAST(sum(git_insertions) AS BIGINT), 0) AS lines_added,
      nullif(CAST(sum(git_deletions) AS BIGINT), 0) AS lines_removed,
      min(event_ts) AS first_ts, max(event_ts) AS last_ts
    FROM ({_PAGE_500})""",
)
def timeline_summary(spark, sf):
    return T.timeline_summary(T.timeline(V.agent_events(spark, sf, False).withColumn("text_redacted", F.lit("")), limit=500))


@register(
    "timeline_by_type",
    EV + f"SELECT event_type, count(*) AS n FROM ({_PAGE_500}) GROUP BY event_type",
)
def timeline_by_type(spark, sf):
    return T.timeline_by_type(T.timeline(V.agent_events(spark, sf, False).withColumn("text_redacted", F.lit("")), limit=500))


@register(
    "page_info",
    EV
    + """, t AS (SELECT count(*) AS total FROM ev WHERE event_type = 'user_message' AND project_id = 'proj-2')
    SELECT CAST(40 AS BIGINT) AS "offset", CAST(25 AS BIGINT) AS "limit",
      CAST(greatest(least(total - 40, 25), 0) AS BIGINT) AS returned, total,
      40 + greatest(least(total - 40, 25), 0) < total AS has_more,
      CAST(CASE WHEN 40 + greatest(least(total - 40, 25), 0) < total
        THEN 40 + greatest(least(total - 40, 25), 0) END AS BIGINT) AS next_offset FROM t""",
)
def page_info(spark, sf):
    flt = EventFilter(event_types=("user_message",), project="proj-2")
    return T.page_info(apply_filter(V.agent_events(spark, sf, False), flt), 25, 40)


@register(
    "history",
    EV
    + f"""SELECT {_TIMELINE_SQL} FROM ev WHERE event_type = 'user_message'
      AND event_time >= TIMESTAMP '2024-01-10 00:00:00'
    ORDER BY event_ts, event_id LIMIT 10""",
)
def history(spark, sf):
    return _flat(T.history(V.agent_events(spark, sf), EventFilter(since="2024-01-10T00:00:00Z")))


_CONVERSATION_SQL = """SELECT event_ts AS ts,
  CASE event_type WHEN 'user_message' THEN 'user' WHEN 'assistant_message' THEN 'assistant' ELSE 'tool' END
    AS type,
  text_redacted AS text, tool_name AS tool, tool_args_json AS tool_args, NULL::VARCHAR AS tool_args_json,
  array_to_string(file_paths, ',') AS files
FROM ev WHERE event_type IN {types} AND event_time >= TIMESTAMP '2024-01-03 06:00:00'
ORDER BY event_ts, event_id LIMIT {limit} OFFSET 5"""


def _conversation(name, mode, types, limit):
    @register(name, EV + _CONVERSATION_SQL.format(types=types, limit=limit))
    def run(spark, sf):
        flt = EventFilter(since="2024-01-03T06:00:00Z")
        df = T.conversation(V.agent_events(spark, sf), flt, mode, limit, 5)
        return df.withColumn("files", F.array_join("files", ","))


_conversation("conversation", "messages", "('user_message', 'assistant_message')", 20)
_conversation("conversation_with_tools", "full", "('user_message', 'assistant_message', 'tool_call')", 60)
_conversation("conversation_tools_only", "tools", "('tool_call', 'none')", 40)


@register(
    "around",
    EV
    + f"""SELECT {_TIMELINE_SQL},
      abs(epoch_ms(event_time) - epoch_ms(TIMESTAMP '2024-01-15 12:00:00')) < 60000 AS near_center
    FROM ev WHERE event_time BETWEEN TIMESTAMP '2024-01-15 09:00:00' AND TIMESTAMP '2024-01-15 15:00:00'
    ORDER BY event_ts, event_id LIMIT 400""",
)
def around(spark, sf):
    return _flat(T.around(V.agent_events(spark, sf), "2024-01-15T12:00:00Z", 180, limit=400))


@register(
    "timeline_csv",
    EV
    + """SELECT '"' || event_ts || '","' || event_type || '","'
      || replace(replace(text_redacted, '"', '""'), chr(10), ' ') || '","' || coalesce(tool_name, '')
      || '","' || coalesce(left(git_sha, 7), '') || '","'
      || coalesce(CAST(nullif(git_insertions, 0) AS VARCHAR), '') || '","'
      || coalesce(CAST(nullif(git_deletions, 0) AS VARCHAR), '') || '"' AS line
    FROM (SELECT * FROM ev ORDER BY event_ts, event_id LIMIT 100)""",
)
def timeline_csv(spark, sf):
    return T.csv_rows(T.timeline(V.agent_events(spark, sf)), "timeline")


@register(
    "row_labels",
    EV
    + """SELECT event_id,
      CASE event_type WHEN 'user_message' THEN 'user      ' WHEN 'assistant_message' THEN 'assistant '
        WHEN 'tool_call' THEN 'tool_call ' WHEN 'tool_result' THEN 'result    '
        WHEN 'git_commit' THEN 'commit    ' END AS label,
      CASE WHEN length(text_redacted) > 60
        THEN left(replace(text_redacted, chr(10), ' '), 57) || '...'
        ELSE replace(text_redacted, chr(10), ' ') END AS preview FROM ev""",
)
def row_labels(spark, sf):
    ev = V.agent_events(spark, sf)
    return ev.select(
        "event_id",
        event_label(F.col("event_type")).alias("label"),
        truncate(flatten_newlines(F.col("text_redacted")), 60).alias("preview"),
    )


_ERROR_SQL = """
      contains(lower(text_redacted), 'error') OR contains(lower(text_redacted), 'failed')
      OR contains(lower(text_redacted), 'failure') OR contains(lower(text_redacted), 'cannot find')
      OR contains(lower(text_redacted), 'is not defined') OR contains(lower(text_redacted), 'exception')
      OR contains(lower(text_redacted), 'npm err') OR contains(lower(text_redacted), 'fail ')
      OR regexp_matches(text_redacted, 'TS\\d+:') OR regexp_matches(lower(text_redacted), 'error\\s*\\[')"""


@register(
    "error_texts",
    EV
    + f"SELECT event_id FROM ev WHERE event_type = 'tool_result' AND ({_ERROR_SQL})",
)
def error_texts(spark, sf):
    ev = V.agent_events(spark, sf).where("event_type = 'tool_result'")
    return ev.where(is_error_text(F.col("text_redacted"))).select("event_id")


@register(
    "error_previews",
    EV
    + f"""SELECT event_id, array_to_string(list_slice(l, coalesce(list_position(list_transform(l, lambda x:
        contains(lower(x), 'error') OR contains(lower(x), 'fail') OR contains(x, 'TS')
        OR starts_with(ltrim(x), 'at ')), true), 1), len(l)), chr(10)) AS preview
    FROM (SELECT event_id, string_split(text_redacted, chr(10)) AS l FROM ev
      WHERE event_type = 'tool_result' AND ({_ERROR_SQL}))""",
)
def error_previews(spark, sf):
    ev = V.agent_events(spark, sf).where("event_type = 'tool_result'")
    bad = ev.where(is_error_text(F.col("text_redacted")))
    return bad.select("event_id", error_preview(F.col("text_redacted")).alias("preview"))


@register(
    "parse_times",
    """WITH e AS (SELECT event_id, CASE event_id % 8
        WHEN 0 THEN CAST(946684801 + event_id AS VARCHAR) WHEN 1 THEN '5'
        WHEN 2 THEN (event_id % 90) || 'mo' WHEN 3 THEN (event_id % 90) || ' days ago'
        WHEN 4 THEN '2026-01-08' WHEN 5 THEN '2026-01-08T14:30:00-05:00'
        WHEN 6 THEN (event_id % 9) || 'h' ELSE '2h ago' END AS expr FROM events)
    SELECT event_id, expr, CASE event_id % 8
        WHEN 0 THEN 946684801 + event_id
        WHEN 2 THEN 1767225600 - (event_id % 90) * 2592000
        WHEN 3 THEN 1767225600 - (event_id % 90) * 86400
        WHEN 4 THEN 1767830400 WHEN 5 THEN 1767900600
        WHEN 6 THEN 1767225600 - (event_id % 9) * 3600 END AS seconds FROM e""",
)
def parse_times(spark, sf):
    exprs = V.table(spark, sf, "events").selectExpr(
        "event_id",
        """CASE event_id % 8
        WHEN 0 THEN CAST(946684801 + event_id AS STRING) WHEN 1 THEN '5'
        WHEN 2 THEN concat(event_id % 90, 'mo') WHEN 3 THEN concat(event_id % 90, ' days ago')
        WHEN 4 THEN '2026-01-08' WHEN 5 THEN '2026-01-08T14:30:00-05:00'
        WHEN 6 THEN concat(event_id % 9, 'h') ELSE '2h ago' END AS expr""",
    )
    now = datetime(2026, 1, 1, tzinfo=timezone.utc)
    return exprs.withColumn("seconds", F.unix_seconds(parse_time_column(F.col("expr"), now)))


# Topics use a substring hit list scored by text length, so that the score is exact.
_TOPIC_HITS = """hits AS (SELECT *, CAST(length(text_redacted) AS DOUBLE) AS score FROM msg
  WHERE event_type = 'user_message' AND text_redacted ILIKE '%the%'
  ORDER BY score DESC, event_id)"""


@register(
    "topics",
    MSG
    + f""", {_TOPIC_HITS}, lagged AS (SELECT *,
        lag(session_id) OVER w AS prev_session, lag(event_time) OVER w AS prev_time FROM hits
        WINDOW w AS (ORDER BY event_time, event_id)),
      numbered AS (SELECT *, sum(CASE WHEN prev_session IS NULL OR prev_session <> session_id
          OR event_time - prev_time > INTERVAL 2 HOUR THEN 1 ELSE 0 END)
          OVER (ORDER BY event_time, event_id) AS topic FROM lagged)
    SELECT CAST(topic AS BIGINT) AS topic, min(session_id) AS session_id, min(event_ts) AS "start",
      max(event_ts) AS "end", count(*) AS "count",
      array_to_string(list_slice(list(replace(text_redacted, chr(10), ' ')
        ORDER BY event_time, event_id) FILTER (length(text_redacted) > 15), 1, 2), '|') AS samples
    FROM numbered GROUP BY topic""",
)
def topics(spark, sf):
    msg = V.agent_messages(spark, sf)
    hits = msg.where((F.col("event_type") == "user_message") & F.ilike("text_redacted", F.lit("%the%")))
    hits = hits.withColumn("score", F.length("text_redacted").cast("double"))
    return C.topics(hits).withColumn("samples", F.array_join("samples", "|"))


@register(
    "session_topics",
    MSG
    + """, lagged AS (SELECT *, lag(event_time) OVER (PARTITION BY session_id ORDER BY event_time, event_id)
        AS prev FROM msg),
      numbered AS (SELECT *, sum(CASE WHEN prev IS NULL OR event_time - prev > INTERVAL 2 HOUR
        THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY event_time, event_id) AS topic
        FROM lagged)
    SELECT session_id, CAST(topic AS BIGINT) AS topic, epoch_ms(min(event_time)) AS start_ms,
      epoch_ms(max(event_time)) AS end_ms, count(*) AS "count",
      (list(replace(text_redacted, chr(10), ' ') ORDER BY event_time, event_id)
        FILTER (length(text_redacted) > 15))[1] AS preview
    FROM numbered GROUP BY session_id, topic""",
)
def session_topics(spark, sf):
    return C.session_topics(V.agent_messages(spark, sf))


_LATEST = """(SELECT {cols} FROM ev WHERE event_type = '{kind}' AND ev.project_id = p.project_id
  ORDER BY event_ts DESC, event_id DESC LIMIT 1)"""

_STATUS_SQL = f"""{PROJ}, last AS (SELECT *, row_number() OVER (PARTITION BY project_id, event_type
    ORDER BY event_ts DESC, event_id DESC) AS rn FROM ev
    WHERE event_type <> 'tool_call' OR tool_name IS NOT NULL),
  status AS (SELECT p.project_id, p.display_name, p.created_at,
    max(event_ts) FILTER (event_type = 'user_message') AS user_ts,
    max(text_redacted) FILTER (event_type = 'user_message') AS user_text,
    max(event_ts) FILTER (event_type = 'assistant_message') AS assistant_ts,
    max(text_redacted) FILTER (event_type = 'assistant_message') AS assistant_text,
    max(event_ts) FILTER (event_type = 'git_commit') AS commit_ts,
    max(text_redacted) FILTER (event_type = 'git_commit') AS commit_message,
    max(git_sha) FILTER (event_type = 'git_commit') AS commit_sha,
    max(event_ts) FILTER (event_type = 'tool_call') AS tool_ts,
    max(tool_name) FILTER (event_type = 'tool_call') AS tool_name,
    max(array_to_string(file_paths, ',')) FILTER (event_type = 'tool_call') AS tool_files
  FROM projects p LEFT JOIN last ON last.project_id = p.project_id AND rn = 1
  GROUP BY p.project_id, p.display_name, p.created_at)"""


@register("project_status", EV + f", {_STATUS_SQL} SELECT * FROM status")
def project_status(spark, sf):
    status = P.project_status(V.agent_events(spark, sf), V.projects(spark, sf))
    return status.withColumn("tool_files", F.array_join("tool_files", ","))


@register(
    "last_activity",
    EV
    + f""", {_STATUS_SQL},
    u AS (SELECT * FROM status WHERE user_ts IS NOT NULL
      ORDER BY user_ts DESC, created_at DESC, project_id DESC LIMIT 1),
    c AS (SELECT * FROM status WHERE commit_ts IS NOT NULL
      ORDER BY commit_ts DESC, created_at DESC, project_id DESC LIMIT 1),
    t AS (SELECT * FROM status WHERE tool_ts IS NOT NULL
      ORDER BY tool_ts DESC, created_at DESC, project_id DESC LIMIT 1)
    SELECT CASE greatest(u.user_ts, c.commit_ts, t.tool_ts) WHEN u.user_ts THEN u.display_name
        WHEN c.commit_ts THEN c.display_name ELSE t.display_name END AS active_project,
      u.display_name AS message_project, u.user_ts AS message_ts, u.user_text AS message_text,
      c.display_name AS commit_project, c.commit_ts AS commit_ts, left(c.commit_sha, 7) AS commit_sha,
      split_part(c.commit_message, chr(10), 1) AS commit_subject,
      t.display_name AS tool_project, t.tool_ts AS tool_ts, t.tool_name AS tool_name
    FROM u, c, t""",
)
def last_activity(spark, sf):
    return P.last_activity(P.project_status(V.agent_events(spark, sf), V.projects(spark, sf)))


@register(
    "recent_sessions",
    EV
    + """SELECT session_id, max(event_ts) AS last_event, count(*) AS event_count FROM ev
    WHERE session_id IS NOT NULL GROUP BY session_id ORDER BY last_event DESC, session_id LIMIT 5""",
)
def recent_sessions(spark, sf):
    return P.recent_sessions(V.agent_events(spark, sf, False))


@register(
    "find_session",
    EV
    + f""", {PROJ} SELECT session_id, ev.project_id, root_path AS working_directory,
      event_ts AS matched_at, text_redacted AS preview
    FROM ev LEFT JOIN projects USING (project_id) WHERE text_redacted ILIKE '%of the%'
    ORDER BY event_ts DESC, event_id DESC LIMIT 1""",
)
def find_session(spark, sf):
    return P.find_session(V.agent_events(spark, sf), V.projects(spark, sf), "of the")


_PATHS = """paths AS (SELECT DISTINCT CASE user_id % 6 WHEN 0 THEN '/w/a/b' WHEN 1 THEN '/w/abc/'
  WHEN 2 THEN '/W/a/x/' WHEN 3 THEN '/x/y' WHEN 4 THEN '/w/cxd/q' ELSE '/none/' END || user_id AS path
  FROM events)"""


@register(
    "project_by_path",
    f"""WITH {PROJ}, {_PATHS}
    SELECT path, project_id FROM (SELECT path, project_id, row_number() OVER (PARTITION BY path
      ORDER BY (path = root_path) DESC, length(root_path) DESC, project_id DESC) AS rn
      FROM paths JOIN projects ON path ILIKE root_path || '%') WHERE rn = 1""",
)
def project_by_path(spark, sf):
    paths = spark.sql(
        _PATHS.removeprefix("paths AS (").removesuffix(")").replace("events", "{events}").replace(
            " || user_id", " || CAST(user_id AS STRING)"
        ),
        events=V.table(spark, sf, "events"),
    )
    return P.project_by_path(paths, V.projects(spark, sf))


_IDENTS = """idents AS (SELECT DISTINCT CASE user_id % 9 WHEN 0 THEN 'proj-1' WHEN 1 THEN 'Name 2'
  WHEN 2 THEN '/w/ab' WHEN 3 THEN 'PROJ' WHEN 4 THEN 'ame_5' WHEN 5 THEN '/w/a/b/deep/x'
  WHEN 6 THEN 'proj-*' WHEN 7 THEN 'E 6' ELSE 'nobody' END AS ident FROM events)"""


@register(
    "resolve_projects",
    f"""WITH {PROJ}, {_IDENTS}, m AS (SELECT ident, project_id, root_path,
      CASE WHEN project_id = ident THEN 1 WHEN display_name = ident THEN 2 WHEN root_path = ident THEN 3
        WHEN project_id ILIKE ident || '%' THEN 4 WHEN display_name ILIKE '%' || ident || '%' THEN 5
        WHEN ident ILIKE root_path || '%' THEN 6 END AS rank
      FROM idents, projects WHERE ident NOT LIKE '%*%'),
    best AS (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY rank,
      CASE WHEN rank = 6 THEN -length(root_path) ELSE 0 END, project_id) AS rn FROM m WHERE rank IS NOT NULL)
    SELECT i.ident, CASE WHEN i.ident LIKE '%*%' THEN i.ident ELSE b.project_id END AS project_id
    FROM idents i LEFT JOIN best b ON b.ident = i.ident AND rn = 1""",
)
def resolve_projects(spark, sf):
    idents = spark.sql(
        _IDENTS.removeprefix("idents AS (").removesuffix(")").replace("events", "{events}"),
        events=V.table(spark, sf, "events"),
    )
    return P.resolve_projects(idents, V.projects(spark, sf))


@register(
    "list_projects",
    f"WITH {PROJ} SELECT * FROM projects",
)
def list_projects(spark, sf):
    return P.newest_first(V.projects(spark, sf), "created_at", "project_id")


@register(
    "lookup_event",
    EV + "SELECT event_id, event_type, text_redacted FROM ev WHERE event_id = 'evt_000000123'",
)
def lookup_event(spark, sf):
    ev = P.lookup(V.agent_events(spark, sf), event_id="evt_000000123")
    return ev.select("event_id", "event_type", "text_redacted")


@register(
    "store_stats",
    EV
    + f""", {PROJ} SELECT 'events' AS name, count(*) AS n FROM ev
    UNION ALL SELECT 'sources', count(DISTINCT source_id) FROM ev
    UNION ALL SELECT 'projects', count(*) FROM projects
    UNION ALL SELECT 'devices', count(DISTINCT device_id) FROM ev""",
)
def store_stats(spark, sf):
    ev = V.agent_events(spark, sf, False)
    return P.store_stats(
        ev, ev.select("source_id").distinct(), V.projects(spark, sf), ev.select("device_id").distinct()
    )


@register(
    "events_per_source", EV + "SELECT source_id, count(*) AS event_count FROM ev GROUP BY source_id"
)
def events_per_source(spark, sf):
    return P.events_per_source(V.agent_events(spark, sf, False))
