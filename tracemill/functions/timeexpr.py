"""Time arguments: absolute, unix seconds, and relative to a given `now`."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per unit; a month is 30 days and a year 365.
_SHORT = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "mo": 2592000, "y": 31536000}
_LONG = {
    "second": 1,
    "minute": 60,
    "hour": 3600,
    "day": 86400,
    "week": 604800,
    "month": 2592000,
    "year": 31536000,
}
# Fixed value: digits up to this are not taken for unix seconds.
_MIN_UNIX_SECONDS = 946684800

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
# The accepted forms, a number and a short unit, or words that end in `ago`.
_SHORT_FORM = r"(mo|[smhdwy])"
_LONG_FORM = r"\s*(second|minute|hour|day|week|month|year)s?\s+ago"


def _iso(moment: datetime) -> str:
    moment = moment.astimezone(timezone.utc)
    return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"


def to_instant(text: str | None) -> datetime | None:
    """Instant of an ISO string, NULL-like None where it cannot be read."""
    if text is None:
        return None
    try:
        moment = datetime.fromisoformat(text.strip())
    except ValueError:
        return None
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def parse_time(expr: str, now: datetime) -> str:
    """ISO form of a time argument; an unreadable argument comes back unchanged."""
    if expr.isdecimal() and int(expr) > _MIN_UNIX_SECONDS:
        return _iso(_EPOCH + timedelta(seconds=int(expr)))
    short = re.fullmatch(rf"(\d+){_SHORT_FORM}", expr, re.IGNORECASE)
    if short:
        return _iso(now - timedelta(seconds=int(short[1]) * _SHORT[short[2].lower()]))
    words = re.fullmatch(rf"(\d+){_LONG_FORM}", expr, re.IGNORECASE)
    if words:
        return _iso(now - timedelta(seconds=int(words[1]) * _LONG[words[2].lower()]))
    moment = None if expr.isdecimal() else to_instant(expr)
    return _iso(moment) if moment else expr


def default_window(
    command: str, now: datetime, *, since=None, until=None, date=None, everything=False, session=None
) -> tuple[str | None, str | None]:
    """(since, until) a command uses when the caller leaves them out."""
    # Default look-back per command.
    look_back = {
        "timeline": "2 hours ago",
        "history": "7 days ago",
        "conversation": "1 day ago",
        "edits": "24 hours ago",
        "errors": "7 days ago",
        "stats": "7 days ago",
    }[command]
    end = parse_time(until, now) if until else None
    if everything or session:
        return None, end
    if date and command in ("timeline", "history", "conversation"):
        day_end = parse_time(f"{date} 23:59:59", now)
        keep_until = command == "conversation" and end is not None
        return parse_time(date, now), end if keep_until else day_end
    return parse_time(since or look_back, now), end


def instant_literal(moment: datetime) -> Column:
    micros = (moment - _EPOCH) // timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros).cast("bigint"))


def parse_time_column(expr: Column, now: datetime) -> Column:
    """Column form of `parse_time`: an instant per row, NULL where unreadable."""
    from tracemill.schema import event_time

    now_s = F.lit((now - _EPOCH) // timedelta(seconds=1)).cast("bigint")
    amount = F.regexp_extract(expr, r"^(\d+)", 1).try_cast("bigint")
    unit = F.lower(F.regexp_extract(expr, rf"(?i)^\d+{_SHORT_FORM}$", 1))
    word = F.lower(F.regexp_extract(expr, rf"(?i)^\d+{_LONG_FORM}$", 1))

    def seconds(key: Column, table: dict[str, int]) -> Column:
        pairs = [c for k, v in table.items() for c in (F.lit(k), F.lit(v).cast("bigint"))]
        return F.element_at(F.create_map(*pairs), key)

    unix = expr.rlike(r"^\d+$") & (expr.try_cast("bigint") > F.lit(_MIN_UNIX_SECONDS))
    return (
        F.when(unix, F.timestamp_seconds(expr.try_cast("bigint")))
        .when(unit != "", F.timestamp_seconds(now_s - amount * seconds(unit, _SHORT)))
        .when(word != "", F.timestamp_seconds(now_s - amount * seconds(word, _LONG)))
        .when(expr.rlike(r"^\d+$"), F.lit(None).cast("timestamp"))
        .otherwise(event_time(expr))
    )


def iso_from_millis(ms: Column) -> Column:
    return iso_from_time(F.timestamp_millis(ms))


def iso_from_seconds(seconds: Column) -> Column:
    return iso_from_time(F.timestamp_seconds(seconds))


def iso_from_time(moment: Column) -> Column:
    """Instant as UTC text with milliseconds, whatever the session time zone."""
    ms = F.unix_millis(moment)
    days = F.floor(ms / F.lit(86400000))
    of_day = F.pmod(ms, F.lit(86400000))
    date = F.date_format(F.date_from_unix_date(days.cast("int")), "yyyy-MM-dd")
    clock = F.format_string(
        "T%02d:%02d:%02d.%03dZ",
        F.floor(of_day / 3600000),
        F.floor(of_day / 60000) % 60,
        F.floor(of_day / 1000) % 60,
        of_day % 1000,
    )
    return F.concat(date, clock)
