from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.functions.stem import stem
from tracemill.functions.timeexpr import default_window, iso_from_millis, parse_time, parse_time_column
from tracemill.schema import event_time

NOW = datetime(2026, 1, 10, 12, 0, 0, tzinfo=timezone.utc)
CASES = {
    "1704672000": "2024-01-08T00:00:00.000Z",
    "5": "5",
    "30s": "2026-01-10T11:59:30.000Z",
    "10M": "2026-01-10T11:50:00.000Z",
    "1h": "2026-01-10T11:00:00.000Z",
    "3d": "2026-01-07T12:00:00.000Z",
    "2w": "2025-12-27T12:00:00.000Z",
    "6mo": "2025-07-14T12:00:00.000Z",
    "1y": "2025-01-10T12:00:00.000Z",
    "3 days ago": "2026-01-07T12:00:00.000Z",
    "1 hour ago": "2026-01-10T11:00:00.000Z",
    "2026-01-08": "2026-01-08T00:00:00.000Z",
    "2026-01-08T14:30:00": "2026-01-08T14:30:00.000Z",
    "2026-01-08T14:30:00-05:00": "2026-01-08T19:30:00.000Z",
    "2h ago": "2h ago",
    "garbage": "garbage",
}


@pytest.mark.parametrize("expr", CASES)
def test_parse_time(expr):
    assert parse_time(expr, NOW) == CASES[expr]


def test_column_form_agrees(spark):
    rows = spark.createDataFrame([(e,) for e in CASES], "e string")
    got = rows.withColumn("t", F.unix_millis(parse_time_column(F.col("e"), NOW))).withColumn(
        "iso", iso_from_millis(F.col("t"))
    )
    for row in got.collect():
        expected = CASES[row.e]
        assert row.iso == (expected if expected != row.e else None), row.e


def test_default_windows():
    assert default_window("timeline", NOW) == ("2026-01-10T10:00:00.000Z", None)
    assert default_window("edits", NOW, session="s") == (None, None)
    assert default_window("history", NOW, date="2026-01-02") == (
        "2026-01-02T00:00:00.000Z",
        "2026-01-02T23:59:59.000Z",
    )
    assert default_window("conversation", NOW, date="2026-01-02", until="2026-01-03")[1] == "2026-01-03T00:00:00.000Z"


def test_event_time(spark):
    texts = ["2026-01-03T10:00:00+02:00", "2026-01-03T10:00:00.250Z", "2026-01-03T10:00:00", "2026-01-03", "x", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.ms for r in rows.orderBy("i").select(F.unix_millis(event_time(F.col("t"))).alias("ms")).collect()]
    base = 1767398400000
    hour = 3600000
    assert got == [base + 8 * hour, base + 10 * hour + 250, base + 10 * hour, base, None, None]


def test_like_is_literal_about_backslashes(spark):
    row = spark.range(1).select(
        X.like(F.lit(r"A\b_c"), r"a\B_C").alias("a"),
        X.like(F.lit("a%c"), "%" + "A" + "%").alias("b"),
        X.like(F.lit("axc"), X.glob_to_like("a?*")).alias("c"),
        X.like(F.lit("foo.bar"), X.regex_to_like("o.b")).alias("d"),
    )
    assert list(row.collect()[0]) == [True, True, True, True]


def test_error_preview(spark):
    texts = {
        "plain\nTypeError: x\n  at y\nok": "TypeError: x\n  at y\nok",
        "a\nb\nc\nd": "a\nb\nc\nd",
        "\n".join(["fail"] + [f"l{i}" for i in range(15)]): "\n".join(["fail"] + [f"l{i}" for i in range(15)]),
        "TS1\n": "TS1\n",
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in rows.withColumn("p", X.error_preview(F.col("t"))).collect():
        assert row.p == texts[row.t]


def test_lines(spark):
    text = F.lit("a\nb\nc\n")
    row = spark.range(1).select(
        X.line_count(text).alias("n"),
        X.line_count(F.lit("")).alias("e"),
        X.line_slice(text, 2, 3).alias("s"),
        X.line_slice(text, 3, None).alias("t"),
        X.truncate(F.lit("abcdefgh"), 6).alias("u"),
        X.event_label(F.lit("git_stash")).alias("l"),
    )
    assert list(row.collect()[0]) == [4, 1, "b\nc", "c\n", "abc...", "git_stash "]


@pytest.mark.parametrize(
    "word,root",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"),
        ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
        ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"),
        ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"),
        ("hopefulness", "hope"), ("triplicate", "triplic"), ("formalize", "formal"), ("electrical", "electr"),
        ("goodness", "good"), ("revival", "reviv"), ("adoption", "adopt"), ("effective", "effect"),
        ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("is", "is"),
    ],
)
def test_published_stems(word, root):
    assert stem(word) == root
