"""Text analysis for retrieval: tokens, accent folding, stemming, query phrases."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.stem import stem

TOKEN = r"[\p{L}\p{N}]+"
# The same set within ASCII text, where it runs much faster.
_ASCII_TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms; the default folds accents."""

    stemming: bool = False
    fold_accents: bool = True


PLAIN = Analyzer(stemming=False, fold_accents=False)


def _accent_map() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and their base letters, from Unicode data."""
    marked, bases = [], []
    for code in (*range(0x00E0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if letter == letter.lower() and len(parts) > 1 and parts[0].isascii():
            marked.append(letter)
            bases.append(parts[0])
    return "".join(marked), "".join(bases)


_MARKED, _BASES = _accent_map()


def _folded(text: Column, analyzer: Analyzer) -> Column:
    text = F.lower(text)
    if analyzer.fold_accents:
        text = F.translate(F.regexp_replace(text, r"\p{Mn}", ""), _MARKED, _BASES)
    return text


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem_arrays(terms: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def one(word: str) -> str:
        root = known.get(word)
        if root is None:
            root = known[word] = stem(word)
        return root

    return terms.map(lambda ws: None if ws is None else [one(w) for w in ws])


def _by_script(text: Column, found: Callable[[Column, Column], Column]) -> Column:
    """`found` with the token pattern that suits the text."""
    is_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(is_ascii, found(text, F.lit(_ASCII_TOKEN))).otherwise(found(text, F.lit(TOKEN)))


def terms(text: Column, analyzer: Analyzer) -> Column:
    """Terms of a text in order; an empty array for NULL."""
    split = _by_script(_folded(text, analyzer), lambda t, token: F.regexp_extract_all(t, token, 0))
    found = F.coalesce(split, F.array())
    return _stem_arrays(found) if analyzer.stemming else found


def term_count(text: Column) -> Column:
    """Number of terms of a folded text; stemming does not change it."""
    return F.coalesce(_by_script(text, F.regexp_count), F.lit(0))


def folded_text(text: Column, analyzer: Analyzer) -> Column:
    return _folded(text, analyzer)


def _collapse(text: Column) -> Column:
    text = F.replace(text, F.lit('""'), F.lit(""))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _alternatives(text: Column) -> Column:
    parts = F.transform(F.split(text, r"(?i)\s+OR\s+"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def event_alternatives(query: Column) -> Column:
    """OR parts of an event query, each an array of phrases that must all occur.

    `a\\|b`, `a|b` and `(a|b)` are alternatives; AND, slashes and regex signs are blanks.
    Several words make one phrase, unless they are quoted one by one.
    """
    text = F.regexp_replace(query, r"\\\|", "|")
    text = F.regexp_replace(text, r"\(([^)]+)\)", "$1")
    bars = F.filter(F.transform(F.split(text, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    text = F.when(text.contains("|"), F.array_join(bars, " OR ")).otherwise(text)
    text = F.regexp_replace(text, r"(?i)\bAND\b", " ")
    text = F.regexp_replace(text, r"/", " ")
    text = _collapse(F.regexp_replace(text, r"[\^$.*+?{}\[\]\\]", " "))
    quoted = r'"[^"]*"|[^\s"]+'
    return F.transform(
        _alternatives(text),
        lambda p: F.when(
            p.startswith('"') & p.endswith('"'), F.regexp_extract_all(p, F.lit(quoted), 0)
        ).otherwise(F.array(p)),
    )


def document_alternatives(query: Column) -> Column:
    """OR parts of a document query, each an array of one phrase."""
    text = F.regexp_replace(query, r"(?i)\bAND\b", " ")
    text = F.regexp_replace(text, r"\\\*", "*")
    text = _collapse(F.regexp_replace(text, r"/", " "))
    return F.transform(_alternatives(text), lambda p: F.array(p))
