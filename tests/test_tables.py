"""Changes of stored tables: touched parts alone are rewritten, and broken runs change nothing."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracemill.operators import tables
from tracemill.operators.tables import Table, purge_source


def rows(spark, *values):
    return spark.createDataFrame([*values], "id string, text string, source_id string")


def files(table):
    return {str(p): p.stat().st_mtime_ns for p in Path(table.path).rglob("data/**/*.parquet")}


def content(table):
    return sorted(tuple(r) for r in table.read().collect())


@pytest.fixture
def table(spark, tmp_path):
    made = Table(spark, str(tmp_path / "t"), rows(spark, ("a", "b", "c")).schema, ["id"], buckets=16)
    made.upsert(rows(spark, *[(f"k{i}", f"v{i}", f"s{i % 3}") for i in range(60)]))
    return made


def live_files(table):
    return set(table.read().inputFiles())


def test_upsert_rewrites_what_it_touches(spark, table):
    before, disk = live_files(table), files(table)
    table.upsert(rows(spark, ("k3", "new", "s0"), ("k99", "added", None)))
    assert ("k3", "new", "s0") in content(table) and len(content(table)) == 61
    assert len(before - live_files(table)) <= 2  # two keys, two buckets at most
    assert all(files(table)[f] == t for f, t in disk.items())  # nothing is written over
    gone = table.vacuum()
    assert 1 <= len(gone) <= 2 and len(content(table)) == 61 and table.vacuum() == []


def test_delete_register_and_change(spark, table):
    table.delete(F.col("id") == "k5")
    assert "k5" not in {r[0] for r in content(table)} and len(content(table)) == 59
    before = live_files(table)
    table.delete(F.col("id") == "nobody")
    table.register(rows(spark, ("k7", "other", "x")))
    assert live_files(table) == before
    table.register(rows(spark, ("k7", "other", "x"), ("k5", "back", "x"), ("k5", "twice", "x")))
    assert len([r for r in content(table) if r[0] == "k5"]) == 1 and ("k7", "v7", "s1") in content(table)
    table.change(rows(spark, ("k8", "", "")), lambda old: old.withColumn("text", F.when(F.col("id") == "k8", "changed").otherwise(F.col("text"))))
    assert ("k8", "changed", "s2") in content(table) and len(content(table)) == 60
    table.delete(F.col("id") == F.col("id"))
    assert content(table) == []


def test_a_broken_run_changes_nothing(spark, table, monkeypatch):
    before = content(table)

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(tables.Table, "_commit", stop)
        for work in (lambda: table.upsert(rows(spark, ("k1", "x", "y"))), lambda: table.delete(F.col("source_id") == "s1")):
            with pytest.raises(RuntimeError):
                work()
    assert content(table) == before
    table.vacuum()
    assert content(table) == before
    table.delete(F.col("source_id") == "s1")
    assert len(content(table)) == 40


def test_purge(spark, tmp_path):
    made = [Table(spark, str(tmp_path / n), rows(spark, ("a", "b", "c")).schema, ["id"], 4) for n in "spe"]
    for t in made:
        t.upsert(rows(spark, *[(f"k{i}", "v", f"s{i % 3}") for i in range(12)]))
    purge_source("s1", made[0], made[1])
    assert [len(content(t)) for t in made] == [8, 8, 12]
    purge_source("s1", *made)
    assert [len(content(t)) for t in made] == [8, 8, 8]
    empty = Table(spark, str(tmp_path / "none"), made[0].schema, ["id"])
    assert empty.read().count() == 0
    empty.delete(F.col("source_id") == "s1")
    assert empty.read().count() == 0
