"""Event filters, written so that they reach the Parquet scan."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import has_wildcard, like, star_to_like
from tracemill.functions.timeexpr import instant_literal, to_instant
from tracemill.operators.projects import resolve_project
from tracemill.schema import GIT_EVENT_TYPES


@dataclass(frozen=True)
class EventFilter:
    """Arguments shared by search and timeline requests; None means no restriction."""

    since: str | None = None
    until: str | None = None
    project: str | None = None
    session: str | None = None
    event_types: tuple[str, ...] = ()
    role: str | None = None
    tool_names: tuple[str, ...] = ()
    include_git: bool = True


def in_time_range(since: str | None, until: str | None) -> Column | None:
    """Inclusive range at whole-second UTC resolution.

    Both ends are compared against the bare column, so the range is pushed down. The
    date bounds are a day wider because a local date may differ from the UTC one.
    """
    conditions = []
    for bound, is_start in ((since, True), (until, False)):
        if not bound:
            continue
        moment = to_instant(bound)
        if moment is None:
            return F.lit(False)
        moment = moment.replace(microsecond=0)
        if is_start:
            day = (moment - timedelta(days=1)).date().isoformat()
            conditions.append(F.col("event_time") >= instant_literal(moment))
            conditions.append(F.col("event_date") >= day)
        else:
            day = (moment + timedelta(days=1)).date().isoformat()
            conditions.append(F.col("event_time") < instant_literal(moment + timedelta(seconds=1)))
            conditions.append(F.col("event_date") <= day)
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def matches_id(column: Column, value: str) -> Column:
    """Equality, or LIKE when the value holds a wildcard."""
    return like(column, star_to_like(value)) if has_wildcard(value) else column == value


def matches_tools(column: Column, names: tuple[str, ...]) -> Column:
    """IN list, or LIKE on every name when any of them holds a wildcard."""
    if any(has_wildcard(n) for n in names):
        return reduce(or_, [like(column, star_to_like(n)) for n in names])
    return column.isin(*names)


def role_event_type(role: str) -> str:
    return "user_message" if role == "user" else "assistant_message"


def path_equals(path: str) -> Column:
    """Any of the three spellings of the path argument equals the path."""
    return reduce(or_, [F.col(c) == path for c in ("arg_file_path", "arg_path", "arg_filepath")])


def path_like(pattern: str) -> Column:
    return reduce(
        or_, [like(F.col(c), pattern) for c in ("arg_file_path", "arg_path", "arg_filepath")]
    )


def path_contains(fragment: str) -> Column:
    return path_like(f"%{fragment}%")


def phrase_in_text(phrase: str) -> Column:
    return like(F.col("text_redacted"), f"%{phrase}%")


def apply_filter(
    events: DataFrame, flt: EventFilter, projects: DataFrame | None = None
) -> DataFrame:
    """Rows that satisfy every part of the filter.

    With a `projects` table, a project identifier without wildcard is resolved first;
    one that resolves to nothing is compared as it stands.
    """
    in_range = in_time_range(flt.since, flt.until)
    if in_range is not None:
        events = events.where(in_range)
    if flt.project:
        if has_wildcard(flt.project) or projects is None:
            events = events.where(matches_id(F.col("project_id"), flt.project))
        else:
            resolved = resolve_project(projects, flt.project).scalar()
            events = events.where(F.col("project_id") == resolved)
    if flt.session:
        events = events.where(matches_id(F.col("session_id"), flt.session))
    if flt.event_types:
        events = events.where(F.col("event_type").isin(*flt.event_types))
    if flt.role:
        events = events.where(F.col("event_type") == role_event_type(flt.role))
    if flt.tool_names:
        events = events.where(matches_tools(F.col("tool_name"), flt.tool_names))
    if not flt.include_git:
        events = events.where(~F.col("event_type").isin(*GIT_EVENT_TYPES))
    return events
