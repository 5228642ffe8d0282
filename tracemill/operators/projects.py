"""Project lookup, project status, recent sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import NO_ESCAPE, like
from tracemill.operators.patterns import pattern_hits


def resolve_project(projects: DataFrame, identifier: str) -> DataFrame:
    """One row with the project id an identifier stands for, or the identifier itself.

    Tried in this order: id, display name, root path, start of an id, part of a display
    name, longest root path the identifier starts with.
    """
    ident = F.lit(identifier)
    rank = (
        F.when(F.col("project_id") == identifier, 1)
        .when(F.col("display_name") == identifier, 2)
        .when(F.col("root_path") == identifier, 3)
        .when(like(F.col("project_id"), f"{identifier}%"), 4)
        .when(like(F.col("display_name"), f"%{identifier}%"), 5)
        .when(_under(ident, F.col("root_path")), 6)
    )
    best = F.min_by("project_id", _preference(rank))
    return projects.where(rank.isNotNull()).agg(F.coalesce(best, ident).alias("project_id"))


def _under(path: Column, root: Column) -> Column:
    """LIKE semantics on purpose: no boundary at a slash is required."""
    return F.ilike(path, F.concat(root, F.lit("%")), F.lit(NO_ESCAPE))


def _preference(rank: Column) -> Column:
    longest_root = F.when(rank == 6, -F.length("root_path")).otherwise(0)
    return F.struct(rank, longest_root, F.col("project_id"))


def _literal_head(pattern: Column) -> Column:
    """Folded text before the first LIKE wildcard: a key every match must start with."""
    return F.lower(F.regexp_extract(pattern, r"^([^_%]*)", 1))


def _lengths(keys: DataFrame) -> list[int]:
    """Lengths that the column `key` has: no more than a path has letters."""
    rows = keys.where("key IS NOT NULL").select(F.length("key").alias("n")).distinct().collect()
    return sorted(r.n for r in rows)


def _prefixes(text: Column, lengths: list[int]) -> Column:
    """Prefixes of the folded text, of the lengths at which something can meet them."""
    folded = F.lower(text)
    each = [F.when(F.length(folded) >= n, F.left(folded, F.lit(n))) for n in lengths]
    return F.array_compact(F.array(*each).cast("array<string>"))


def project_by_path(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, project_id) with the project of the longest root each path starts with.

    Each distinct path meets only the roots whose literal head is one of its prefixes,
    through an equi-join; the LIKE test then decides. Prefixes have the lengths that heads have.
    """
    roots = projects.select("project_id", "root_path", _literal_head(F.col("root_path")).alias("key"))
    lengths = _lengths(roots)
    probes = paths.select("path").distinct().select("path", F.explode(_prefixes(F.col("path"), lengths)).alias("key"))
    order = F.struct(
        F.col("path") == F.col("root_path"), F.length("root_path"), F.col("project_id")
    )
    return (
        probes.join(roots, "key")
        .where(_under(F.col("path"), F.col("root_path")))
        .groupBy("path")
        .agg(F.max_by("project_id", order).alias("project_id"))
    )


def resolve_projects(idents: DataFrame, projects: DataFrame) -> DataFrame:
    """(ident, project_id) for a whole table of identifiers, NULL where none fits.

    Every rule of the cascade is an equi-join on a blocking key, followed by the exact
    test. Identifiers that hold a wildcard resolve to themselves.
    """
    wild = F.col("ident").contains("*") | F.col("ident").contains("%")
    asked = idents.select("ident").distinct()
    plain = asked.where(~wild)
    known = projects.select("project_id", "display_name", "root_path")
    head = _literal_head(F.col("ident"))

    def equal(column: str, rank: int) -> DataFrame:
        return plain.join(known, F.col("ident") == F.col(column)).withColumn("rank", F.lit(rank))

    headed = plain.withColumn("key", head)
    by_id = headed.join(
        known.withColumn("key", F.explode(_prefixes(F.col("project_id"), _lengths(headed)))), "key"
    )
    by_id = by_id.where(
        F.ilike("project_id", F.concat("ident", F.lit("%")), F.lit(NO_ESCAPE))
    ).withColumn("rank", F.lit(4))

    names = known.select(F.col("display_name").alias("id"), F.col("display_name").alias("content")).distinct()
    named = pattern_hits(names, plain.select(F.col("ident").alias("text")), loose=False)
    by_name = (
        named.join(known, F.col("id") == F.col("display_name"))
        .select(F.col("text").alias("ident"), *known.columns)
        .withColumn("rank", F.lit(5))
    )

    rooted = known.withColumn("key", _literal_head(F.col("root_path")))
    by_root = plain.withColumn("key", F.explode(_prefixes(F.col("ident"), _lengths(rooted)))).join(rooted, "key")
    by_root = by_root.where(_under(F.col("ident"), F.col("root_path"))).withColumn("rank", F.lit(6))

    matches = [
        equal("project_id", 1),
        equal("display_name", 2),
        equal("root_path", 3),
        by_id.drop("key"),
        by_name,
        by_root.drop("key"),
    ]
    found = matches[0]
    for other in matches[1:]:
        found = found.unionByName(other)
    best = found.groupBy("ident").agg(
        F.min_by("project_id", _preference(F.col("rank"))).alias("found_id")
    )
    return asked.join(best, "ident", "left").select(
        "ident", F.when(wild, F.col("ident")).otherwise(F.col("found_id")).alias("project_id")
    )


# The kinds of event a project status reports.
_STATUS_KINDS = ("user_message", "assistant_message", "git_commit", "tool_call")


def project_status(events: DataFrame, projects: DataFrame) -> DataFrame:
    """Per project its latest user message, assistant message, commit and tool call.

    The latest row per project and kind is found over narrow columns only; texts are
    fetched for the winners by event id.
    """
    wanted = F.col("event_type").isin(*_STATUS_KINDS) & (
        (F.col("event_type") != "tool_call") | F.col("tool_name").isNotNull()
    )
    candidates = events.where(wanted)
    latest = (
        candidates.groupBy("project_id", "event_type")
        .agg(F.max(F.struct("event_ts", "event_id")).alias("last"))
        .select("project_id", "event_type", F.col("last.event_id").alias("event_id"))
    )
    winners = candidates.join(latest, ["project_id", "event_type", "event_id"], "left_semi")

    def of(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("event_type") == kind, F.col(column)))

    status = winners.groupBy("project_id").agg(
        of("user_message", "event_ts").alias("user_ts"),
        of("user_message", "text_redacted").alias("user_text"),
        of("assistant_message", "event_ts").alias("assistant_ts"),
        of("assistant_message", "text_redacted").alias("assistant_text"),
        of("git_commit", "event_ts").alias("commit_ts"),
        of("git_commit", "text_redacted").alias("commit_message"),
        F.max(
            F.when(
                F.col("event_type") == "git_commit",
                F.coalesce(F.nullif("git.sha", F.lit("")), F.lit("unknown")),
            )
        ).alias("commit_sha"),
        of("tool_call", "event_ts").alias("tool_ts"),
        of("tool_call", "tool_name").alias("tool_name"),
        of("tool_call", "file_paths").alias("tool_files"),
    )
    return projects.select("project_id", "display_name", "created_at").join(
        status, "project_id", "left"
    )


def last_activity(status: DataFrame) -> DataFrame:
    """One row: the latest user message, commit and tool call over all projects.

    The active project is that of the latest of the three; at equal times a message
    wins over a commit, and a commit over a tool call. Among projects with the same
    time, the one created last is taken.
    """
    from tracemill.schema import event_time

    instants = status.withColumns(
        {f"{k}_at": event_time(F.col(f"{k}_ts")) for k in ("user", "commit", "tool")}
    )

    def pick(kind: str, columns: list[str]) -> Column:
        fields = [F.col("display_name").alias("project"), F.col(f"{kind}_ts").alias("ts")]
        order = F.when(
            F.col(f"{kind}_at").isNotNull(),
            F.struct(F.col(f"{kind}_at"), F.col("created_at"), F.col("project_id")),
        )
        return F.max_by(F.struct(*fields, *columns), order).alias(kind)

    best = instants.agg(
        pick("user", ["user_text"]),
        pick("commit", ["commit_message", "commit_sha"]),
        pick("tool", ["tool_name"]),
        *[F.max(f"{k}_at").alias(f"{k}_at") for k in ("user", "commit", "tool")],
    )
    latest = F.greatest("user_at", "commit_at", "tool_at")
    active = (
        F.when(F.col("user_at") == latest, F.col("user.project"))
        .when(F.col("commit_at") == latest, F.col("commit.project"))
        .when(F.col("tool_at") == latest, F.col("tool.project"))
    )
    return best.select(
        active.alias("active_project"),
        F.col("user.project").alias("message_project"),
        F.col("user.ts").alias("message_ts"),
        F.col("user.user_text").alias("message_text"),
        F.col("commit.project").alias("commit_project"),
        F.col("commit.ts").alias("commit_ts"),
        F.left("commit.commit_sha", F.lit(7)).alias("commit_sha"),
        F.split_part("commit.commit_message", F.lit("\n"), F.lit(1)).alias("commit_subject"),
        F.col("tool.project").alias("tool_project"),
        F.col("tool.ts").alias("tool_ts"),
        F.col("tool.tool_name").alias("tool_name"),
    )


def recent_sessions(events: DataFrame, n: int = 5) -> DataFrame:
    """The n sessions with the latest activity."""
    return (
        events.where(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(F.max("event_ts").alias("last_event"), F.count("*").alias("event_count"))
        .orderBy(F.desc("last_event"), "session_id")
        .limit(n)
    )


def find_session(
    events: DataFrame, projects: DataFrame, phrase: str, preview_chars: int | None = None
) -> DataFrame:
    """Latest event that holds the phrase, with the root of its project and its text, or the beginning of it."""
    from tracemill.operators.filters import phrase_in_text

    text = F.col("text_redacted")
    preview = text if preview_chars is None else F.left(text, F.lit(preview_chars))
    match = (
        events.where(phrase_in_text(phrase))
        .orderBy(F.desc("event_ts"), F.desc("event_id"))
        .limit(1)
        .select(
            "session_id",
            "project_id",
            F.col("event_ts").alias("matched_at"),
            preview.alias("preview"),
        )
    )
    roots = projects.select("project_id", F.col("root_path").alias("working_directory"))
    return match.join(roots, "project_id", "left").select(
        "session_id", "project_id", "working_directory", "matched_at", "preview"
    )


def newest_first(table: DataFrame, column: str, key: str) -> DataFrame:
    """Listing of a dimension, newest first."""
    return table.orderBy(F.desc(column), key)


def lookup(table: DataFrame, **keys: str) -> DataFrame:
    """Rows with the given key values."""
    for column, value in keys.items():
        table = table.where(F.col(column) == value)
    return table


def store_stats(
    events: DataFrame, sources: DataFrame, projects: DataFrame, devices: DataFrame
) -> DataFrame:
    """Row counts of the store, one row per table."""
    counted = [("events", events), ("sources", sources), ("projects", projects), ("devices", devices)]
    frames = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in counted]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def events_per_source(events: DataFrame) -> DataFrame:
    return events.groupBy("source_id").agg(F.count("*").alias("event_count"))
