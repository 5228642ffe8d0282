"""Signals of a document that do not come from the index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of a text that holds concrete values.
CONCRETE_MARKS = (
    r"(?i)https?:\/\/\S+",
    r"(?i)\/[A-Za-z0-9._-]+\/[A-Za-z0-9._-]+",
    r"[?&][A-Za-z0-9_-]+=\S+",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    r"\b[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    r"\b[A-Za-z0-9_]+=+[^\s]+",
    r"\b[A-Fa-f0-9]{16,}\b",
    r"\b[A-Za-z0-9]{20,}\b",
    r"\b\d{1,3}(\.\d{1,3}){3}\b",
    r"\b\d+\.\d+(\.\d+)?\b",
    r"\{[^}]{10,}\}",
    r"\[[^\]]{10,}\]",
    r"`[^`]{10,}`",
)


def concreteness(text: Column) -> Column:
    """How many of the marks occur."""
    total = F.lit(0)
    for mark in CONCRETE_MARKS:
        total = total + text.rlike(mark).cast("int")
    return total


def words(text: Column) -> Column:
    """Lower-case words of more than two ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))


def token_overlap(query: Column, content: Column) -> Column:
    """Share of the query words, repeats included, that occur in the content.

    Both are taken apart once: the words are elements of arrays of one, which lambdas refer to.
    """

    def share(asked: Column, present: Column) -> Column:
        hits = F.filter(asked, lambda w: F.array_contains(present, w))
        part = F.size(hits) / F.size(asked)
        return F.when((F.size(asked) > 0) & (F.size(present) > 0), part).otherwise(F.lit(0.0))

    of_query = F.array(words(query))
    shares = F.transform(of_query, lambda asked: F.transform(F.array(words(content)), lambda present: share(asked, present))[0])
    return shares[0]
