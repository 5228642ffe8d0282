"""SimHash near-duplicates against loops over all pairs."""

import random

import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import SCHEMA, documents, edited, frame, prose
from tracemill.llm import simhash
from tracemill.llm.queries import LLM_REGISTRY


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def slow_components(prints, ids, distance):
    """Least id that each row reaches, by all pairs of distinct prints."""
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(distinct):
        for q in distinct[i + 1 :]:
            if (p ^ q).bit_count() <= distance:
                a, b = sorted((top(p), top(q)))
                root[b] = a
    least = {}
    for p, i in zip(prints, ids, strict=True):
        if i is not None:
            least[top(p)] = min(least.get(top(p), i), i)
    return [least.get(top(p)) for p in prints]


def check(docs, rows):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()))
    prints = [slow_fingerprint(t) for _, t in rows]
    groups = slow_components(prints, [i for i, _ in rows], 4)
    want = sorted((i is None, i or 0, f"{p:016x}", g) for (i, _), p, g in zip(rows, prints, groups, strict=True))
    assert got == want


def test_against_all_pairs(spark):
    rows = [(r[0], r[1]) for r in documents()]
    check(frame(spark), rows)
    # repeats of whole passages shift few bits; null ids never name a component
    more = [(100 + i, edited(prose(i % 7, 300), 40 + i)) for i in range(60)] + [(None, prose(3, 300)), (None, "alone here")]
    check(spark.createDataFrame(more, "doc_id long, text string"), more)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_query_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    got = LLM_REGISTRY["op12_simhash"].run(spark, sf_dir)
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == len(rows)


def test_many_near_prints_in_one_row(spark, monkeypatch):
    """A row of many nodes is cut into parts and loses no link; a forest has fewer pairs than nodes."""
    monkeypatch.setattr(simhash, "PART", 16)
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(400)}
    prints |= {rng.getrandbits(64) for _ in range(400)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    pairs = simhash.near_pairs(nodes, 4, 7).collect()
    masked = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in pairs]
    assert all((a ^ b).bit_count() <= 4 for a, b in masked)
    want = slow_components(list(prints), list(prints), 4)
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in masked:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    assert [top(p) for p in prints] == want


def test_tables_cover_every_choice():
    made = simhash.masks(4, 7)
    assert len(made) == 35 and all(20 < (m & (1 << 64) - 1).bit_count() < 35 for m in made)


def test_clashing_columns(spark):
    docs = frame(spark).withColumn("fp", F.lit(1)).withColumn("rep", F.lit(2)).withColumn("_id", F.lit(3))
    assert simhash.near_duplicates(docs).count() == len(documents())
    assert SCHEMA.startswith("doc_id")


def test_the_exploded_table_stays_off_the_driver(spark, tmp_path):
    # 35 rows a node: by its file's size Spark would broadcast what is 30 times larger
    spark.range(3000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "nodes"))
    pairs = simhash.near_pairs(spark.read.parquet(str(tmp_path / "nodes")), 4, 7)
    plan = pairs._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "SortMergeJoin" in plan
    assert "BroadcastExchange" not in plan
