"""Full-text retrieval: postings, phrase matching, BM25 ranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.functions.analysis import (
    PLAIN,
    Analyzer,
    document_alternatives,
    event_alternatives,
    folded_text,
    term_count,
    terms,
)
from tracemill.functions.text import is_error_text, like, regex_to_like
from tracemill.operators.filters import EventFilter, apply_filter
from tracemill.session import written

# Published constants of the ranking function, and the floor of the phrase weight.
_K1, _B, _MIN_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class TextIndex:
    """Postings `(doc_id, n_terms, col, pos, term)` and lengths `(doc_id, n_terms)`.

    `postings` takes the terms a caller needs, as a list or a table with a column `term`, or None for all of them. Every posting
    carries the length of its document, so that ranking does not join lengths. `totals` is
    one row (docs, terms), kept with a stored index and summed up from the lengths otherwise.
    """

    postings: Callable[[list[str] | DataFrame | None], DataFrame]
    lengths: DataFrame
    analyzer: Analyzer
    totals: DataFrame | None = None

    def corpus(self) -> Column:
        totals = self.totals
        if totals is None:
            totals = self.lengths.agg(F.count("*").alias("docs"), F.sum("n_terms").alias("terms"))
        return totals.select(F.struct("docs", (F.col("terms") / F.col("docs")).alias("mean")).alias("c")).scalar()


def of_terms(postings: DataFrame, wanted: list[str] | DataFrame | None) -> DataFrame:
    if wanted is None:
        return postings
    if isinstance(wanted, DataFrame):
        return postings.join(wanted, "term", "left_semi")
    return postings.where(F.col("term").isin(*wanted))


def split_texts(rows: DataFrame, doc_id: str, columns: list[str], analyzer: Analyzer) -> DataFrame:
    """(doc_id, n_terms, terms): the terms of each column in order."""
    split = F.array(*[terms(F.col(c), analyzer) for c in columns])
    rows = rows.select(F.col(doc_id).alias("doc_id"), split.alias("terms"))
    return rows.select("doc_id", F.size(F.flatten("terms")).alias("n_terms"), "terms")


def postings_of(tokens: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(doc_id, n_terms, col, pos, term) of texts taken apart."""
    columns = tokens.select("doc_id", "n_terms", F.posexplode("terms").alias("col", "_terms"))
    rows = columns.select("doc_id", "n_terms", "col", F.posexplode("_terms").alias("pos", "term"))
    return rows if wanted is None else rows.where(F.col("term").isin(*wanted))


def index_texts(
    docs: DataFrame, doc_id: str, columns: list[str], analyzer: Analyzer = Analyzer()
) -> TextIndex:
    """Index computed from the texts on demand.

    When the terms are known and not stemmed, documents without any of them are dropped
    by a substring test before their text is split.
    """

    def postings(wanted: list[str] | DataFrame | None = None) -> DataFrame:
        if isinstance(wanted, DataFrame):
            return of_terms(postings(None), wanted)
        rows = docs
        if wanted is not None and not analyzer.stemming:
            rows = rows.where(
                reduce(
                    or_,
                    [
                        F.contains(folded_text(F.col(c), analyzer), F.lit(t))
                        for c in columns
                        for t in wanted
                    ],
                    F.lit(False),
                )
            )
        return postings_of(split_texts(rows, doc_id, columns, analyzer), wanted)

    counts = [term_count(folded_text(F.col(c), analyzer)) for c in columns]
    total = sum(counts[1:], counts[0])
    lengths = docs.select(F.col(doc_id).alias("doc_id"), total.alias("n_terms"))
    return TextIndex(postings, lengths, analyzer)


def write_index(index: TextIndex, path: str, mode: str = "append") -> None:
    """Store an index: postings sorted by term within files, so that row groups prune.

    Terms are spread by range over term and document, which splits a very common term
    over many files.
    """
    rows = index.postings(None).repartitionByRange("term", "doc_id")
    rows.sortWithinPartitions("term", "doc_id").write.mode(mode).parquet(f"{path}/postings")
    index.lengths.write.mode(mode).parquet(f"{path}/lengths")


def read_index(spark: SparkSession, path: str, analyzer: Analyzer = Analyzer()) -> TextIndex:
    stored = spark.read.parquet(f"{path}/postings")

    def postings(wanted: list[str] | DataFrame | None = None) -> DataFrame:
        return of_terms(stored, wanted)

    return TextIndex(postings, spark.read.parquet(f"{path}/lengths"), analyzer)


def query_phrases(queries: DataFrame, analyzer: Analyzer, dialect: str = "events") -> DataFrame:
    """(query_id, alt, phrase, n_phrases, terms) of a table of `(query_id, text)`."""
    parse = event_alternatives if dialect == "events" else document_alternatives
    parts = queries.select("query_id", F.posexplode(parse(F.col("text"))).alias("alt", "phrases"))
    phrases = parts.select("query_id", "alt", F.posexplode("phrases").alias("phrase", "part"))
    split = phrases.select("query_id", "alt", "phrase", terms(F.col("part"), analyzer).alias("terms"))
    split = split.where(F.size("terms") > 0)
    needed = F.count("*").over(W.partitionBy("query_id", "alt"))
    return split.withColumn("n_phrases", needed)


def _literal_query(spark: SparkSession, text: str) -> DataFrame:
    return spark.range(1).select(F.lit("q").alias("query_id"), F.lit(text).alias("text"))


def _needed_terms(phrases: DataFrame) -> list[str]:
    """Terms of one caller's query text, to be pushed down to the postings."""
    rows = phrases.select(F.explode("terms").alias("term")).distinct().collect()
    return sorted(r["term"] for r in rows)


def score(index: TextIndex, phrases: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(query_id, doc_id, score) of every matching document, higher is better.

    One shuffle by document serves phrase matching and term frequencies; only postings of
    queried terms take part in it. With `wanted` terms the phrases are those of one query
    text, so the two small tables of phrases are broadcast. For a table of queries they are
    stored first, so that Spark knows their size and does not shuffle postings to meet few
    phrases; frequencies are stored as well, since weights are made from all of them. A phrase
    that several queries share is then counted once, and meets its queries after it is weighted.
    """
    one = wanted is not None
    small = F.broadcast if one else (lambda df: df)
    key = ["query_id", "alt", "phrase", "n_phrases"]
    if not one:
        key = ["same"]
        asked = written(phrases.where(F.col("query_id").isNotNull()), "search-phrases")
        phrases = written(asked.select("terms").distinct().withColumn("same", F.monotonically_increasing_id()), "search-distinct")
        uses = written(asked.join(phrases, "terms").select("same", "query_id", "alt", "n_phrases"), "search-uses")
    steps = phrases.select(*key, F.size("terms").alias("n"), F.posexplode("terms").alias("i", "term"))
    group = ["doc_id", "n_terms", *key]
    needed = wanted if one else written(steps.select("term").distinct(), "search-terms")
    hits = index.postings(needed).join(small(steps), "term").select(
        *group, "n", "col", (F.col("pos") - F.col("i")).alias("at")
    )
    found = hits.repartition("doc_id").groupBy(*group, "n", "col", "at").agg(F.count("*").alias("matched"))
    tf = found.where(F.col("matched") == F.col("n")).groupBy(*group).agg(F.count("*").alias("tf"))
    if not one:
        tf = written(tf, "search-frequencies")
    corpus = index.corpus()
    docs, mean = corpus["docs"], corpus["mean"]
    spread = tf.groupBy(*key).agg(F.count("*").alias("df"))
    weight = F.greatest(
        F.log((docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(_MIN_IDF)
    )
    idf = spread.select(*key, weight.alias("idf"))
    if not one:
        idf = written(idf, "search-weights")
    norm = F.col("tf") + _K1 * (1 - _B + _B * F.col("n_terms") / mean)
    part = F.col("idf") * (F.col("tf") * (_K1 + 1)) / norm
    parts = tf.join(small(idf), key).select("doc_id", *key, part.alias("part"))
    if not one:
        parts = parts.repartition("doc_id").join(uses, "same")
    satisfied = (
        parts.groupBy("doc_id", "query_id", "alt", "n_phrases")
        .agg(F.count("*").alias("present"), F.sum("part").alias("part"))
        .where(F.col("present") == F.col("n_phrases"))
    )
    return satisfied.groupBy("doc_id", "query_id").agg(F.sum("part").alias("score"))


def matches(index: TextIndex, query: str, spark: SparkSession, dialect: str = "events") -> DataFrame:
    """(doc_id, score) of one query text."""
    phrases = query_phrases(_literal_query(spark, query), index.analyzer, dialect)
    return score(index, phrases, _needed_terms(phrases)).drop("query_id")


def _filtered_hits(
    events: DataFrame, index: TextIndex, query: str, flt: EventFilter, projects: DataFrame | None
) -> DataFrame:
    hits = matches(index, query, events.sparkSession).withColumnRenamed("doc_id", "event_id")
    if flt == EventFilter():
        return hits
    kept = apply_filter(events, flt, projects).select("event_id")
    return hits.join(kept, "event_id", "left_semi")


def search(
    events: DataFrame,
    index: TextIndex,
    query: str,
    flt: EventFilter = EventFilter(),
    limit: int = 20,
    offset: int = 0,
    projects: DataFrame | None = None,
) -> DataFrame:
    """Ranked page of events; texts are read for the page only, which is broadcast so that they are not shuffled."""
    hits = _filtered_hits(events, index, query, flt, projects)
    ordered = hits.orderBy(F.desc("score"), "event_id")
    best = (ordered.offset(offset) if offset else ordered).limit(limit)
    fields = (
        "event_id",
        "event_type",
        "text_redacted",
        "tool_name",
        "tool_args_json",
        "session_id",
        "project_id",
        "event_ts",
    )
    return (
        events.select(*fields)
        .join(F.broadcast(best), "event_id")
        .withColumn("has_encrypted_original", F.lit(False))
        .orderBy(F.desc("score"), "event_id")
    )


def search_total(
    events: DataFrame,
    index: TextIndex,
    query: str,
    flt: EventFilter = EventFilter(),
    projects: DataFrame | None = None,
) -> DataFrame:
    """Number of matching events, regardless of paging."""
    return _filtered_hits(events, index, query, flt, projects).agg(F.count("*").alias("total"))


def search_many(index: TextIndex, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, rank, doc_id, score) for a whole table of queries in one job."""
    ranked = score(index, query_phrases(queries, index.analyzer))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


# What the error listing searches for, and in which tools by default.
_ERROR_QUERY = "error OR Error OR ERROR OR failed OR Failed"
_ERROR_TOOLS = ("Bash", "bash")


def errors(
    events: DataFrame,
    index: TextIndex,
    flt: EventFilter = EventFilter(),
    limit: int = 50,
    offset: int = 0,
    projects: DataFrame | None = None,
) -> DataFrame:
    """Error outputs of shell tools: best search hits whose text reads like an error."""
    chosen = EventFilter(
        **{
            **flt.__dict__,
            "event_types": ("tool_result",),
            "tool_names": flt.tool_names or _ERROR_TOOLS,
        }
    )
    page = search(events, index, _ERROR_QUERY, chosen, limit, offset, projects)
    return page.where(is_error_text(F.col("text_redacted")))


def doc_search(docs: DataFrame, index: TextIndex, query: str, limit: int = 20) -> DataFrame:
    """Best documents for one query text."""
    hits = matches(index, query, docs.sparkSession, "documents").withColumnRenamed("doc_id", "id")
    best = hits.orderBy(F.desc("score"), "id").limit(limit)
    return docs.join(F.broadcast(best), "id").orderBy(F.desc("score"), "id")


def doc_like(docs: DataFrame, pattern: str, limit: int = 20) -> DataFrame:
    """Documents that match a loose regex; all score the same, so ids decide."""
    found = docs.where(like(F.col("content"), regex_to_like(pattern)))
    return found.withColumn("score", F.lit(1.0)).orderBy("id").limit(limit)


def plain_index(docs: DataFrame, doc_id: str, columns: list[str]) -> TextIndex:
    """Index over whole words, without stemming or accent folding."""
    return index_texts(docs, doc_id, columns, PLAIN)
