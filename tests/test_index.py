"""The stored index through appends, replacements, deletions and merges; patterns by their rarest gram."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracemill import session
from tracemill.functions.analysis import PLAIN
from tracemill.functions.relevance import token_overlap
from tracemill.functions.text import regex_to_like
from tracemill.operators import fusion, patterns, search, segments

DOCS = {
    "a": "the quick brown fox of the north",
    "b": "the lazy dog of the south, of the south",
    "c": "no animals here",
    "d": "quick quick dog",
    "e": "",
    "f": None,
}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "id string, text string")


def scores(spark, index, query):
    return {r.doc_id: round(r.score, 9) for r in search.matches(index, query, spark).collect()}


QUERIES = ["quick", "of the", "dog OR quick", '"the" "south"', "absent"]


def same_as_fresh(spark, path, docs):
    stored = segments.open_index(spark, path, PLAIN)
    fresh = search.plain_index(frame(spark, docs), "id", ["text"])
    for q in QUERIES:
        assert scores(spark, stored, q) == scores(spark, fresh, q), q
    assert sorted(stored.lengths.collect()) == sorted(fresh.lengths.collect())


def test_index_follows_its_store(spark, tmp_path):
    path, docs = str(tmp_path / "index"), dict(DOCS)
    assert scores(spark, segments.open_index(spark, path, PLAIN), "quick") == {}
    parts = [{k: docs[k] for k in "ab"}, {k: docs[k] for k in "cdef"}]
    names = [segments.append(frame(spark, p), path, "id", ["text"], PLAIN) for p in parts]
    same_as_fresh(spark, path, docs)
    docs |= {"b": "the dog left", "g": "north of the fox"}  # b is replaced
    segments.append(frame(spark, {k: docs[k] for k in "bg"}), path, "id", ["text"], PLAIN)
    same_as_fresh(spark, path, docs)
    del docs["d"], docs["e"]
    segments.delete(spark, path, frame(spark, {"d": "", "e": "", "z": ""}).select("id"))
    same_as_fresh(spark, path, docs)
    segments.merge(spark, path, names)
    same_as_fresh(spark, path, docs)
    segments.merge(spark, path)
    same_as_fresh(spark, path, docs)
    terms = {r.term: r.docs for r in segments.frequencies(spark, path).collect()}
    assert terms["the"] == 3 and "lazy" not in terms
    # repeated rows are one document
    segments.append(frame(spark, {"h": "quick"}).unionAll(frame(spark, {"h": "quick"})), path, "id", ["text"], PLAIN)
    same_as_fresh(spark, path, docs | {"h": "quick"})


def test_a_broken_append_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    segments.append(frame(spark, DOCS), path, "id", ["text"], PLAIN)

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(segments, "_note", stop)
        with pytest.raises(RuntimeError):
            segments.append(frame(spark, {"a": "something else", "x": "quick"}), path, "id", ["text"], PLAIN)
        with pytest.raises(RuntimeError):
            segments.merge(spark, path)
    same_as_fresh(spark, path, DOCS)


def test_queries_read_no_lengths(spark, tmp_path):
    """Scoring reads postings of the queried terms, totals and marks."""
    path = str(tmp_path / "index")
    segments.append(frame(spark, DOCS), path, "id", ["text"], PLAIN)
    plan = search.matches(segments.open_index(spark, path, PLAIN), "quick", spark)._jdf.queryExecution().toString()
    assert f"{path}/documents" not in plan and re.search(r"PushedFilters: \[[^\]]*(In|EqualTo)\(term", plan)


def test_postings_are_not_shuffled(spark, tmp_path):
    """Neither marks that don't exist nor the few phrases of a table of queries make Spark shuffle postings."""
    path = str(tmp_path / "index")
    segments.append(frame(spark, DOCS), path, "id", ["text"], PLAIN)
    index = segments.open_index(spark, path, PLAIN)
    queries = spark.createDataFrame([("q1", "of the"), ("q2", "dog")], "query_id string, text string")
    wanted = session.written(queries.select(F.explode(F.split("text", " ")).alias("term")).distinct(), "wanted")
    for rows in (index.postings(None), index.postings(wanted)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    fresh = search.plain_index(frame(spark, DOCS), "id", ["text"])
    found = [sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in search.search_many(i, queries).collect()) for i in (index, fresh)]
    assert found[0] == found[1] and len(found[0]) == 4


def test_vocabulary_counts_documents_once(spark, tmp_path):
    path = str(tmp_path / "index")
    first = segments.append(frame(spark, DOCS), path, "id", ["text"], PLAIN)
    second = segments.append(frame(spark, {"b": "dog dog dog"}), path, "id", ["text"], PLAIN)
    segments.merge(spark, path, [first, second])
    terms = {r.term: r.docs for r in segments.frequencies(spark, path).collect()}
    assert terms["dog"] == 2 and terms["quick"] == 2 and terms["of"] == 1 and "south" not in terms


def test_few_grams_are_looked_for(spark, monkeypatch):
    """Texts are not taken apart for the grams of a few patterns."""
    monkeypatch.setattr(patterns, "text_grams", None)
    docs = spark.createDataFrame([("a", "One two"), ("b", None), ("c", "")], "id string, content string")
    asked = spark.createDataFrame([("ne.*tw",), (".*",), ("xyz",)], "text string")
    assert sorted(map(tuple, patterns.pattern_hits(docs, asked).collect())) == [(".*", "a"), (".*", "c"), ("ne.*tw", "a")]


def test_overlap_takes_a_text_apart_once(spark):
    docs = spark.createDataFrame([("From here, THAT-one",), ("",), (None,), ("a b",)], "content string")
    rows = docs.select(token_overlap(F.lit("From this, that thing!"), F.col("content")).alias("share"))
    assert [r.share for r in rows.collect()] == [0.5, 0.0, 0.0, 0.0]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(content") == 1


TEXTS = [
    "Abc def", "a_b 100% sure", "xx\\E yy\\Q", "line one\nline two", "ab", "b", "", None, "aXbXc " * 50 + "end", "the.dot?", "zzabczzdefzz", "d a c b",
]
PATTERNS = [
    "abc", "ab.", "a.*c", "d.*a", "b", "a_b", "100%", "\\E", "\\E yy.*\\q", "one.line", "..", ".*", "", "end", "x.*x.*x.*end", "dot?", "?", "zz.*zz.*zz",
    "nothing at all", "ab", "a.b.*d", "c.*b.*a",
]


def test_patterns_against_like(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(TEXTS)], "id string, content string")
    asked = spark.createDataFrame([(p,) for p in [*PATTERNS, *PATTERNS, None]], "text string")
    want = set()
    for p in PATTERNS:
        for i, t in enumerate(TEXTS):
            if t is None:
                continue
            if re.search("[.?%_]", p):
                rx = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in regex_to_like(p).lower())
                hit = re.fullmatch(rx, t.lower(), re.S)
            else:
                hit = p.lower() in t.lower()
            if hit:
                want.add((p, f"d{i}"))
    got = [tuple(r) for r in patterns.pattern_hits(docs, asked).collect()]
    assert sorted(got) == sorted(want)
    patterns.write_grams(docs, str(tmp_path / "grams"))
    stored = patterns.pattern_hits(docs, asked, spark.read.parquet(str(tmp_path / "grams"))).collect()
    assert sorted(map(tuple, stored)) == sorted(want)
    assert patterns.pattern_hits(docs, asked.where(F.lit(False))).count() == 0
    assert patterns.pattern_hits(docs.where(F.lit(False)), asked).count() == 0


def test_long_texts_are_passed_over_once(spark):
    docs = spark.createDataFrame([("d", "ab" * 100_000)], "id string, content string")
    asked = spark.createDataFrame([("a.*b.*a.*c",), ("a.*b.*ba",)], "text string")
    assert [r.text for r in patterns.pattern_hits(docs, asked).collect()] == ["a.*b.*ba"]


def test_postings_are_sorted_in_small_pieces_by_a_number(spark, tmp_path, monkeypatch):
    """A file is sorted by the hash of terms, which one caller's terms are looked up by, and a piece bounds what is sorted at once."""
    path = str(tmp_path / "index")
    hashes = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.sha2(F.concat_ws("-", F.col("id"), i), 256))
    docs = spark.range(6000).select(F.col("id").cast("string").alias("id"), F.array_join(hashes, " the ").alias("text"))
    for key in segments._PIECE:
        monkeypatch.setitem(segments._PIECE, key, "16k")
    changed = [*segments._PIECE, *segments._PARTS]
    settings = [spark.conf.get(key, None) for key in changed]
    segments.append(docs, path, "id", ["text"], PLAIN)
    assert [spark.conf.get(key, None) for key in changed] == settings
    stored = spark.read.parquet(f"{path}/postings")
    parts = stored.groupBy(F.input_file_name()).agg(F.collect_list("key").alias("keys"), F.count("*").alias("n")).collect()
    assert all(p["keys"] == sorted(p["keys"]) for p in parts) and sum(p["n"] for p in parts) == 6000 * 39
    assert len(parts) > 4  # more than shuffle partitions
    assert stored.where("key <> xxhash64(term)").isEmpty()
    plan = search.matches(segments.open_index(spark, path, PLAIN), "the", spark)._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*(In|EqualTo)\(key", plan)
    assert len(scores(spark, segments.open_index(spark, path, PLAIN), "the")) == 6000


def test_a_shared_phrase_is_counted_once(spark, monkeypatch):
    """Queries that share a phrase, or repeat it, are scored as if alone."""
    tables = {}

    def noted(rows, name, *args, **kwargs):
        tables[name] = session.written(rows, name, *args, **kwargs)
        return tables[name]

    monkeypatch.setattr(search, "written", noted)
    index = search.plain_index(frame(spark, DOCS), "id", ["text"])
    texts = {"q1": "dog", "q2": "dog OR quick", "q3": '"dog" "dog"', "q4": "of the OR of the", "q5": '"the" "south"', "q6": "absent"}
    queries = spark.createDataFrame(list(texts.items()), "query_id string, text string")
    rows = search.search_many(index, queries).collect()
    assert tables["search-frequencies"].count() == 2 + 2 + 2 + 2 + 1  # dog, quick, of the, the, south
    for q, text in texts.items():
        assert {r.doc_id: round(r.score, 9) for r in rows if r.query_id == q} == scores(spark, index, text), q


def test_pairs_carry_no_words(spark):
    """Of the words of a document only those that are asked for meet its queries."""
    docs = spark.createDataFrame([("a", "From here, THAT-one"), ("b", ""), ("c", None), ("d", "a b")], "id string, content string")
    queries = spark.createDataFrame([("q1", "from this, that thing"), ("q2", "?")], "query_id string, text string")
    pairs = queries.select("query_id").crossJoin(docs.select("id"))
    rows = fusion._features(docs, pairs, queries)
    got = {(r.query_id, r.id): r.overlap for r in rows.collect()}
    assert got == {(q, i): 0.5 if (q, i) == ("q1", "a") else 0.0 for q in ("q1", "q2") for i in "abcd"}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    read = re.findall(r"Relation \[[^\]]*words#\d+[^\]]*\]", plan)
    assert read and not re.search(r"Project \[[^\]]*\bwords#\d+[^\]]*marks|Project \[[^\]]*marks[^\]]*\bwords#", plan)


def test_many_patterns_are_looked_for_together(spark, monkeypatch):
    """Texts are neither taken apart into grams nor joined to each pattern that may match; repeated ids count as before."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdé \nX€") for _ in range(rng.choice([0, 3, 40, 400]))) for _ in range(80)]
    rows = [(f"d{i}", t) for i, t in enumerate(texts)] + [("none", None), (None, "abcd")]
    asked = {".*", "é.€", "...", "a.*é.*X", "ab", "€"} | {t[k : k + n].replace("c", s) for t in texts for k, n, s in [(2, 9, "."), (5, 14, ".*"), (0, 2, "c")]}
    frame = spark.createDataFrame([(p,) for p in sorted(asked)], "text string")
    want = set()
    for p in asked:
        rx = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in regex_to_like(p).lower())
        want |= {(p, i) for i, t in rows if i and t is not None and re.fullmatch(rx, t.lower(), re.S)}
    docs = spark.createDataFrame(rows, "id string, content string").repartition(3)
    repeated = docs.unionAll(docs.where("id = 'd7'"))
    old = sorted(map(tuple, patterns.pattern_hits(repeated, frame).collect()))
    assert set(old) == want
    assert all(old.count(hit) == (4 if hit[1] == "d7" else 1) for hit in want)
    monkeypatch.setattr(patterns, "text_grams", None)
    monkeypatch.setattr(patterns, "_PASS_BYTES", 4000)  # several passes
    monkeypatch.setattr(patterns, "SLICE", 300)
    monkeypatch.setattr(patterns, "_HITS", 10)
    hits = patterns.pattern_hits(docs, frame)
    assert sorted(map(tuple, hits.collect())) == sorted(want)
    assert "Join" not in hits._jdf.queryExecution().optimizedPlan().toString()
