"""Weighted fusion of several search actions per query, reranking, evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.functions.relevance import concreteness, words
from tracemill.functions.timeexpr import instant_literal, to_instant
from tracemill.operators.patterns import pattern_hits
from tracemill.operators.search import TextIndex, query_phrases, score
from tracemill.schema import event_time
from tracemill.session import written

# Fixed values of the fusion.
_STRICT_WEIGHT = 1.2
_TYPE_FACTOR = {"regex_like": 1.2, "fts": 0.95}
_DEFAULT_JUDGEMENT = 5.0


@dataclass(frozen=True)
class DocumentFilter:
    """Restrictions on document metadata; None or empty means none."""

    source: str | None = None
    tags: Sequence[str] = ()
    since: str | None = None
    until: str | None = None


def valid_documents(raw: DataFrame) -> DataFrame:
    """Records that have both an id and a content."""
    return raw.where(
        F.nullif(F.col("id").cast("string"), F.lit("")).isNotNull()
        & F.nullif(F.col("content").cast("string"), F.lit("")).isNotNull()
    )


def filter_documents(docs: DataFrame, flt: DocumentFilter) -> DataFrame:
    """Metadata filter; a creation time that cannot be read passes the range."""
    if flt.source:
        docs = docs.where(F.get_json_object("metadata", "$.source") == flt.source)
    if flt.tags:
        tags = F.from_json(F.get_json_object("metadata", "$.tags"), "array<string>")
        docs = docs.where(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in flt.tags])))
    created = event_time(F.col("created_at"))
    since, until = to_instant(flt.since), to_instant(flt.until)
    if since is not None:
        docs = docs.where(F.coalesce(created >= instant_literal(since), F.lit(True)))
    if until is not None:
        docs = docs.where(F.coalesce(created <= instant_literal(until), F.lit(True)))
    return docs


def validate_plan(plan: DataFrame, queries: DataFrame) -> DataFrame:
    """Usable actions of every query: (query_id, action_id, type, text, weight).

    Actions need a known type and a text, and weigh 1 by default. A query with an
    action outside the weight range, or without any action row, gets the plain query
    and the quoted query instead.
    """
    asked = queries.select("query_id", F.col("text").alias("query_text"))
    in_range = F.coalesce(F.col("weight").between(0, 2), F.lit(True))
    judged = plan.groupBy("query_id").agg(F.bool_and(in_range).alias("ok"))
    state = asked.join(judged, "query_id", "left")
    good = plan.join(state.where(F.col("ok")).select("query_id"), "query_id", "left_semi")
    usable = good.where(
        F.col("type").isin("fts", "regex_like") & F.nullif("text", F.lit("")).isNotNull()
    ).select(
        "query_id", "action_id", "type", "text", F.coalesce("weight", F.lit(1.0)).alias("weight")
    )
    quoted = F.concat(F.lit('"'), "query_text", F.lit('"'))
    replacement = F.array(
        F.struct(F.lit(1).alias("action_id"), F.col("query_text").alias("text"), F.lit(1.0).alias("weight")),
        F.struct(F.lit(2).alias("action_id"), quoted.alias("text"), F.lit(1.2).alias("weight")),
    )
    fallback = (
        state.where(~F.coalesce("ok", F.lit(False)))
        .select("query_id", F.inline(replacement))
        .select("query_id", "action_id", F.lit("fts").alias("type"), "text", "weight")
    )
    return usable.unionByName(fallback)


def query_keywords(queries: DataFrame) -> DataFrame:
    """(query_id, keywords): the words of a query longer than two characters."""
    words = F.filter(F.split("text", r"\s+"), lambda w: F.length(w) > 2)
    return queries.select("query_id", words.alias("keywords"))


def _with_strict_phrase(plan: DataFrame, queries: DataFrame) -> DataFrame:
    """Plan plus one exact-phrase action per query."""
    bare = F.trim(F.replace("text", F.lit('"'), F.lit("")))
    strict = queries.select(
        "query_id",
        F.lit(2**31 - 1).alias("action_id"),
        F.lit("fts").alias("type"),
        F.concat(F.lit('"'), bare, F.lit('"')).alias("text"),
        F.lit(_STRICT_WEIGHT).alias("weight"),
    ).where(F.length("text") > 2)
    return plan.select("query_id", "action_id", "type", "text", "weight").unionByName(strict)


def _text_hits(index: TextIndex, actions: DataFrame) -> DataFrame:
    """Scores of the full-text actions; an action is a query of its own."""
    keyed = actions.where(F.col("type") == "fts").select(
        F.struct("query_id", "action_id").alias("query_id"), "text"
    )
    hits = score(index, query_phrases(keyed, index.analyzer, "documents"))
    return hits.select("query_id.query_id", "query_id.action_id", F.col("doc_id").alias("id"), "score")


def _pattern_hits(docs: DataFrame, actions: DataFrame, grams: DataFrame | None) -> DataFrame:
    """Documents that match a pattern action; a pattern that several actions have is tried once."""
    asked = actions.where(F.col("type") == "regex_like").select("query_id", "action_id", "text")
    found = pattern_hits(docs, asked, grams)
    return found.join(asked, "text").select("query_id", "action_id", "id", F.lit(1.0).alias("score"))


def _features(content: DataFrame, pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, marks, size, overlap) of pairs: marks and words of a document are worked out once.

    Documents are dealt out by id first; what meets the queries are the words that some query asks for.
    """
    asked = queries.select("query_id", words(F.col("text")).alias("_asked"))
    each = asked.select("query_id", F.explode("_asked").alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("times"))
    each = written(each, "fused-words")  # its size is known then, and words of documents are not shuffled to meet it
    sizes = asked.select("query_id", F.size("_asked").alias("n_asked"))
    hit = content.join(pairs.select("id").distinct(), "id", "left_semi").repartition("id")
    present = words(F.col("content"))
    docs = written(
        hit.select(
            "id",
            concreteness(F.col("content")).alias("marks"),
            F.length("content").alias("size"),
            F.array_distinct(present).alias("words"),
            (F.size(present) > 0).alias("filled"),  # words themselves stay behind: pairs carry no arrays
        ),
        "fused-documents",
    )
    held = docs.select("id", F.explode("words").alias("word")).join(each.select("word").distinct(), "word", "left_semi")
    common = pairs.join(each, "query_id").join(held, ["id", "word"]).groupBy("query_id", "id").agg(F.sum("times").alias("common"))
    share = F.coalesce("common", F.lit(0)) / F.col("n_asked")
    overlap = F.when((F.col("n_asked") > 0) & F.col("filled"), share).otherwise(F.lit(0.0))
    joined = pairs.join(docs.drop("words"), "id").join(sizes, "query_id").join(common, ["query_id", "id"], "left")
    return joined.select("query_id", "id", "marks", "size", overlap.alias("overlap"))


def fused_search(
    docs: DataFrame,
    index: TextIndex,
    plan: DataFrame,
    queries: DataFrame,
    flt: DocumentFilter = DocumentFilter(),
    k: int = 20,
    grams: DataFrame | None = None,
) -> DataFrame:
    """(query_id, rank, id, score) of the best k documents of every query; `grams` may be stored ones.

    Every hit of an action counts; scores are normalized per action and averaged by
    weight, then adjusted for concrete values, agreement of actions and overlap with
    the query. Documents outside the filter are left out before anything is ranked.
    """
    actions = _with_strict_phrase(plan, queries)
    chosen = filter_documents(docs, flt)
    content = chosen.select("id", "content")
    text_hits = _text_hits(index, actions).join(content.select("id"), "id", "left_semi")
    hits = written(text_hits.unionByName(_pattern_hits(chosen, actions, grams)), "fused-hits")
    factor = F.when(F.col("type") == "regex_like", _TYPE_FACTOR["regex_like"]).otherwise(_TYPE_FACTOR["fts"])
    weights = actions.select(
        "query_id", "action_id", (F.coalesce("weight", F.lit(1.0)) * factor).alias("w")
    )
    weights = written(weights, "fused-weights")  # few rows for each query, like the best scores: hits stay where they are
    tops = hits.groupBy("query_id", "action_id").agg(F.greatest(F.max("score"), F.lit(1.0)).alias("top"))
    tops = written(tops, "fused-tops")
    merged = (
        hits.join(tops, ["query_id", "action_id"])
        .withColumn("s", F.col("score") / F.col("top"))
        .join(weights, ["query_id", "action_id"])
        .groupBy("query_id", "id")
        .agg(
            F.sum(F.col("s") * F.col("w")).alias("weighted"),
            F.sum("w").alias("total_weight"),
            F.count("*").alias("n_hits"),
        )
    )
    pairs = hits.select("query_id", "id").distinct().join(queries.select("query_id").distinct(), "query_id", "left_semi")
    judged = _features(content, pairs, queries).join(merged, ["query_id", "id"])
    base = F.when(F.col("total_weight") > 0, F.col("weighted") / F.col("total_weight")).otherwise(0.0)
    density = F.col("marks") / F.greatest(F.col("size") / 500, F.lit(1.0))
    final = (
        base
        + density * 0.2
        + F.least("n_hits", F.lit(6)) * 0.01
        + F.col("overlap") * 1.8
        - F.when(F.col("marks") == 0, 0.1).otherwise(0.0)
    )
    scored = judged.select("query_id", "id", final.alias("score"))
    return best_per_query(scored, k)


def best_per_query(scored: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def rerank(hits: DataFrame, judgements: DataFrame, k: int = 10, first_n: int | None = None) -> DataFrame:
    """Mix the hits of every query, or its first n, with judgements from 0 to 10.

    Seven tenths come from the judgement, five where there is none, and three tenths
    from the score relative to the best one.
    """
    first = hits.select("query_id", "id", "score")
    if first_n is not None:
        first = best_per_query(first, first_n).drop("rank")
    tops = first.groupBy("query_id").agg(F.greatest(F.max("score"), F.lit(1.0)).alias("top"))
    given = judgements.select("query_id", "id", F.col("score").alias("judged"))
    mixed = (
        first.join(tops, "query_id")
        .withColumn("relative", F.col("score") / F.col("top") * 10)
        .join(given, ["query_id", "id"], "left")
        .withColumn("judged", F.coalesce("judged", F.lit(_DEFAULT_JUDGEMENT)))
    )
    combined = F.col("judged") * 0.7 + F.col("relative") * 0.3
    return best_per_query(
        mixed.select(
            "query_id", "id", F.col("score").alias("original_score"), "judged", combined.alias("score")
        ),
        k,
    )


def answer_context(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, context): the ranked texts, numbered and joined, per query."""
    numbered = docs.select("id", "content").join(ranked.select("query_id", "rank", "id"), "id")
    entries = F.array_sort(F.collect_list(F.struct("rank", "content")))
    joined = F.array_join(
        F.transform(entries, lambda e: F.concat(F.lit("["), e["rank"].cast("string"), F.lit("] "), e["content"])),
        "\n\n---\n\n",
    )
    return numbered.groupBy("query_id").agg(joined.alias("context"))


def hit_at_1(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: tests, passes and accuracy in percent of the expected first hit."""
    first = ranked.where(F.col("rank") == 1).select("query_id", F.col("id").alias("found"))
    hit = F.coalesce(F.col("found") == F.col("expected_id"), F.lit(False))
    return (
        expected.join(first, "query_id", "left")
        .agg(F.count("*").alias("tests"), F.count_if(hit).alias("passes"))
        .withColumn("accuracy", F.round(F.col("passes") * 100 / F.col("tests"), 1))
    )


def log_plan(plan: DataFrame, queries: DataFrame, path: str, logged_at: str) -> None:
    """Append executed plans, one JSON record per query."""
    plan_records(plan, queries, logged_at).write.mode("append").json(path)


def plan_records(plan: DataFrame, queries: DataFrame, logged_at: str) -> DataFrame:
    actions = plan.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("action_id", "type", "text", "weight"))).alias("actions")
    )
    return (
        queries.select("query_id", F.col("text").alias("query"))
        .join(actions, "query_id")
        .join(query_keywords(queries), "query_id")
        .select(F.lit(logged_at).alias("logged_at"), "query_id", "query", "actions", "keywords")
    )


def plan_log_summary(log: DataFrame, n: int = 5) -> DataFrame:
    """The last n logged plans with their sizes."""
    return (
        log.orderBy(F.desc("logged_at"), F.desc("query_id"))
        .limit(n)
        .select("query", F.size("actions").alias("actions"), F.size("keywords").alias("keywords"))
    )
