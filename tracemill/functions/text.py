"""Text predicates and projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# LIKE has no default escape here, so a character that does not occur stands in for one.
NO_ESCAPE = "\u0001"


def like(column: Column, pattern: str) -> Column:
    """Case-folding LIKE in which a backslash is an ordinary character."""
    return F.ilike(column, F.lit(pattern), F.lit(NO_ESCAPE))


def has_wildcard(value: str) -> bool:
    return "*" in value or "%" in value


def star_to_like(value: str) -> str:
    return value.replace("*", "%")


def glob_to_like(glob: str) -> str:
    return glob.replace("*", "%").replace("?", "_")


def regex_to_like(pattern: str) -> str:
    """Loose regex as a LIKE pattern that may match anywhere."""
    body = pattern.replace(".*", "%").replace(".", "_").replace("?", "_")
    return f"%{body}%"


def regex_to_like_column(pattern: Column) -> Column:
    body = F.replace(pattern, F.lit(".*"), F.lit("%"))
    body = F.replace(body, F.lit("."), F.lit("_"))
    body = F.replace(body, F.lit("?"), F.lit("_"))
    return F.concat(F.lit("%"), body, F.lit("%"))


def flatten_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def truncate(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size - 3)), F.lit("..."))).otherwise(text)


def line_count(text: Column) -> Column:
    """Number of pieces between newlines: 0 for NULL, 1 for empty text."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.coalesce(newlines + 1, F.lit(0))


def line_slice(text: Column, start: int | None, end: int | None) -> Column:
    """Lines start..end, both 1-based and inclusive."""
    if start is None and end is None:
        return text
    first = max(start or 1, 1)
    lines = F.split(text, "\n", -1)
    length = F.size(lines) if end is None else F.lit(max(end - first + 1, 0))
    return F.array_join(F.slice(lines, F.lit(first), length), "\n")


# What marks a text as an error report.
_ERROR_WORDS = (
    "error",
    "failed",
    "failure",
    "cannot find",
    "is not defined",
    "exception",
    "npm err",
    "fail ",
)
_ERROR_CODE = r"TS\d+:"


def is_error_text(text: Column) -> Column:
    """Error predicate; a bracketed compiler error always holds the word `error`."""
    folded = F.lower(text)
    found = F.lit(False)
    for word in _ERROR_WORDS:
        found = found | F.contains(folded, F.lit(word))
    return found | text.rlike(_ERROR_CODE)


def error_preview(text: Column, lines: int | None = None) -> Column:
    """The text from the first line that looks like part of an error on, else the whole text.

    `lines` shows fewer.
    """
    every = F.split(text, "\n", -1)

    def looks_bad(line: Column) -> Column:
        low = F.lower(line)
        return (
            F.contains(low, F.lit("error"))
            | F.contains(low, F.lit("fail"))
            | F.contains(line, F.lit("TS"))
            | F.ltrim(line).startswith("at ")
        )

    first = F.array_position(F.transform(every, looks_bad), True).cast("int")
    shown = F.slice(every, F.greatest(first, F.lit(1)), F.size(every))
    return F.array_join(F.slice(shown, 1, lines) if lines else shown, "\n")


# Short labels of event types, padded to ten characters.
_LABELS = {
    "user_message": "user",
    "assistant_message": "assistant",
    "tool_call": "tool_call",
    "tool_result": "result",
    "git_commit": "commit",
    "git_branch": "branch",
    "git_merge": "merge",
}


def event_label(event_type: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, short in _LABELS.items():
        label = F.when(event_type == name, F.lit(short)).otherwise(label)
    label = F.coalesce(label, event_type)
    return F.when(F.length(label) < 10, F.rpad(label, 10, " ")).otherwise(label)


def snapshot_age(event_time: Column, as_of: Column) -> tuple[Column, Column]:
    """(label, is_stale): days, else hours, else minutes; stale beyond one hour."""
    minutes = F.floor((F.unix_millis(as_of) - F.unix_millis(event_time)) / 60000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)

    def label(count: Column, unit: str) -> Column:
        return F.concat(count.cast("string"), F.lit(f"{unit} ago"))

    text = (
        F.when(days > 0, label(days, "d"))
        .when(hours > 0, label(hours, "h"))
        .otherwise(label(minutes, "m"))
    )
    return text, (days > 0) | (hours > 1)
