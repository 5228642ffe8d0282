"""Ranked search against a loop over all items and documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, frame, prose
from tracemill.llm import dual_tree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or ""))


def slow(docs, items, k=20):
    rows = [(i, c) for i, t in docs if (c := terms(t))]
    n_docs, total = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for name, text in items:
        found = []
        for i, c in rows:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            score = 0
            for t, times in terms(text).items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(name, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return out


def check(spark, rows, items, docs=None, k=20):
    docs = spark.createDataFrame(rows, "doc_id long, text string") if docs is None else docs
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1)).withColumn("hs", F.lit("x"))
    got = [tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in dual_tree.search(docs, bench, k).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] is None, r[2] or 0)
    assert sorted(got, key=key) == sorted(slow(rows, items, k), key=key)


ITEMS = [(1, "The river, and GREEN walks!"), (2, None), (3, "nothing-of-this-is-there"), (4, "über élan the the slow"), (5, ""), (1, "The river, and GREEN walks!"), (None, "house 42")]


def test_against_all_pairs(spark):
    rows = [(r[0], r[1]) for r in documents()] + [(None, "the river"), (None, "a green house")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("batch", F.lit(0)).withColumn("m", F.lit("x"))
    check(spark, rows, ITEMS, docs)
    check(spark, rows, [(9, "the house")], k=3)
    for few, some in (([], ITEMS), (rows, []), ([(1, None), (2, " ")], ITEMS)):
        empty = dual_tree.search(spark.createDataFrame(few, "doc_id long, text string"), spark.createDataFrame(some, "item_id long, text string"))
        assert empty.count() == 0
    assert dual_tree.search(frame(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("seed", [1, 2])
def test_many_batches_and_blocks(spark, monkeypatch, seed):
    """Several batches, blocks and levels of both trees; ties across batches."""
    for name, value in (("BATCH_DOCS", 60), ("BLOCK_ITEMS", 7), ("LEAF_DOCS", 4), ("LEAF_ITEMS", 2), ("CHILDREN", 2), ("FIRST", 3)):
        monkeypatch.setattr(dual_tree, name, value)
    rng = random.Random(seed)
    rows = [(i, prose(rng.randint(0, 120), rng.randint(1, 60))) for i in range(500)]
    items = [(i, prose(1000 + i, rng.randint(1, 12))) for i in range(20)]
    check(spark, rows, items, spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), k=5)


def test_bounds_leave_out_whole_batches():
    """Pairs of leaves that survive are those whose bound reaches the floor; with high floors hardly any."""
    rng = np.random.default_rng(1)
    docs = dual_tree.Tree(rng.integers(0, 50, (200, 30)).astype(float))
    items = dual_tree.Tree(rng.integers(0, 9, (40, 30)).astype(float) * (rng.random((40, 30)) < 0.2))
    whole = items.levels[-1] @ docs.levels[-1].T
    for share in (0.0, 0.9, 0.999):
        floors = np.quantile(whole, share, axis=1)
        kept = dual_tree.surviving(items, docs, floors)
        got = {(i, int(d)) for i, nodes, _ in kept for d in nodes}
        assert got == {(int(i), int(d)) for i, d in zip(*np.nonzero((whole >= floors[:, None]) & (whole > 0)), strict=True)}
