"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import discard, written


def _least(edges: DataFrame) -> DataFrame:
    """(_a, m): the least b of every a; reduced before the shuffle, so a hub with many neighbours costs no more."""
    return edges.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.join(_least(both), F.col("a") == F.col("_a")).where("b > a")
    return low.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = _least(down)
    own = least.select(F.col("_a").alias("a"), F.col("m").alias("b"))
    others = down.join(least, F.col("a") == F.col("_a")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.unionAll(others).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the least node reachable from each node that has an edge (a, b).

    Every node hangs itself and its neighbours under the least of them, in turn, until nothing moves; rounds grow
    with the logarithm of the longest path. Each round is a table, so none is computed twice.
    """
    now = written(edges.where("a <> b").select("a", "b").distinct(), name)
    mark = None
    while True:
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark or not row.n:
            break
        mark = (row.n, row.h)
        now, before = written(_small_star(_large_star(now)), name), now
        discard(before)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
