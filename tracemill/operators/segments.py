"""A stored full-text index that follows its store: segments, totals, delete marks and merges.

Every append adds a segment. Below the folder of an index lie

    postings    (key, term, doc_id, n_terms, col, pos), sorted by key, the term's hash, within files
    documents   (doc_id, n_terms)
    vocabulary  (term, docs), in how many documents of the segment a term is
    totals      (docs, terms), one row
    deletes     (segment, doc_id, n_terms, by): documents that no longer count in a segment
    manifest    (segment, action): a segment counts once it is added here, and until it is retired

all but the last two partitioned by segment. Texts are shuffled once, by id, and postings not at all. The manifest is written last, so what a broken write leaves is never
seen. Marks made by a segment that replaces documents hold once that segment is added. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.analysis import Analyzer
from tracemill.operators.search import TextIndex, of_terms, postings_of, split_texts
from tracemill.operators.store import read_table
from tracemill.session import discard, stored, written

_SCHEMAS = {
    "postings": "key long, term string, doc_id string, n_terms int, col int, pos int, segment string",
    "documents": "doc_id string, n_terms int, segment string",
    "vocabulary": "term string, docs long, segment string",
    "totals": "docs long, terms long, segment string",
    "deletes": "segment string, doc_id string, n_terms int, by string",
    "manifest": "segment string, action string",
}


#: A join with marks too many to broadcast keeps a partition's marks in memory up to this size, and sorts no postings.
_HASHED_PARTS = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
#: Texts are dealt out in parts of so many bytes (shuffled, compressed), and postings are made and sorted for as many bytes
#: of terms at a time, however large the table: a few hundred MB of rows, which a task sorts in memory. Up to the number
#: of parts below; beyond it parts grow.
_PIECE = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.files.maxPartitionBytes": "8m"}
_PARTS = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000"}


def _read(spark: SparkSession, path: str, name: str, segments: list[str] | None = None) -> DataFrame:
    table = read_table(spark, f"{path}/{name}", _SCHEMAS[name])
    return table if segments is None else table.where(F.col("segment").isin(segments))


def _manifest(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(live, added) segments; their number is that of appends since the last merge, not of documents."""
    rows = _read(spark, path, "manifest").distinct().collect()
    added = {r.segment for r in rows if r.action == "add"}
    return sorted(added - {r.segment for r in rows if r.action == "retire"}), sorted(added)


def _note(spark: SparkSession, path: str, actions: list[tuple[str, str]]) -> None:
    """All actions in one file: they hold together or not at all."""
    spark.createDataFrame(actions, _SCHEMAS["manifest"]).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _deleted(spark: SparkSession, path: str, live: list[str], added: list[str]) -> DataFrame:
    marks = _read(spark, path, "deletes", live)
    return marks.where(F.col("by").isNull() | F.col("by").isin(added)).select("segment", "doc_id", "n_terms").distinct()


def _without(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    return rows.join(deleted.select("segment", "doc_id"), ["segment", "doc_id"], "left_anti")


def _put(rows: DataFrame, path: str, name: str, segment: str) -> DataFrame:
    """Rows as the part of a table that belongs to a segment. What was shuffled for it is given back."""
    folder = f"{path}/{name}/segment={segment}"
    stored(rows, folder, "append", own={_HASHED_PARTS: "64m"} | _PIECE)
    return rows.sparkSession.read.schema(_SCHEMAS[name].removesuffix(", segment string")).parquet(folder)


def _write_postings(postings: DataFrame, path: str, segment: str) -> DataFrame:
    """Postings stay where their documents are: files are sorted by the term's hash, and every file may hold any term.

    Nothing is shuffled by term, so a very common one is spread like the documents; row groups and pages prune. A sort
    by one number compares no rows.
    """
    rows = postings.select(F.xxhash64("term").alias("key"), "term", "doc_id", "n_terms", "col", "pos")
    return _put(rows.sortWithinPartitions("key"), path, "postings", segment)


def _keys(spark: SparkSession, wanted: list[str]) -> list[int]:
    """Hashes of one caller's terms."""
    return [r.key for r in spark.createDataFrame([(t,) for t in wanted], "term string").select(F.xxhash64("term").alias("key")).collect()]


def _write_counts(vocabulary: DataFrame, documents: DataFrame, path: str, segment: str) -> None:
    _put(vocabulary, path, "vocabulary", segment)
    totals = documents.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms"))
    _put(totals, path, "totals", segment)


def _marks_of(ids: DataFrame, spark: SparkSession, path: str, live: list[str], added: list[str]) -> DataFrame:
    """Where documents of these ids are still counted."""
    held = _without(_read(spark, path, "documents", live), _deleted(spark, path, live, added))
    return held.join(ids.distinct(), "doc_id", "left_semi").select("segment", "doc_id", "n_terms")


def _mark(marks: DataFrame, path: str) -> None:
    """Add delete marks; they are made from the table they go to, so they are a table of their own first."""
    made = written(marks, "segment-marks")
    made.write.mode("append").parquet(f"{path}/deletes")
    discard(made)


def append(docs: DataFrame, path: str, doc_id: str, columns: list[str], analyzer: Analyzer = Analyzer()) -> str:
    """Index documents as a new segment and return its name; documents of the same ids before it no longer count.

    Splitting texts is the dear part, so they are dealt out by id first. Rows whose id is null are not indexed; of
    repeated ids in `docs` one counts, the one whose texts come first in order.
    """
    spark = docs.sparkSession
    live, added = _manifest(spark, path)
    segment = uuid.uuid4().hex
    narrow = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("string").alias("doc_id"), *columns)
    chosen = narrow.repartition("doc_id").groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("_t")).select("doc_id", "_t.*")
    tokens = written(split_texts(chosen, "doc_id", columns, analyzer), "segment-tokens", own=_PIECE | _PARTS)
    _write_postings(postings_of(tokens), path, segment)
    documents = _put(tokens.select("doc_id", "n_terms"), path, "documents", segment)
    held = tokens.select(F.explode(F.array_distinct(F.flatten("terms"))).alias("term"))
    _write_counts(held.groupBy("term").agg(F.count(F.lit(1)).alias("docs")), documents, path, segment)
    discard(tokens)
    if live:
        _mark(_marks_of(documents.select("doc_id"), spark, path, live, added).withColumn("by", F.lit(segment)), path)
    _note(spark, path, [(segment, "add")])
    return segment


def delete(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Documents of these ids (one column) no longer count."""
    live, added = _manifest(spark, path)
    _mark(_marks_of(ids.toDF("doc_id"), spark, path, live, added).withColumn("by", F.lit(None).cast("string")), path)


def _left(spark: SparkSession, path: str, chosen: list[str], postings: DataFrame, deleted: DataFrame) -> DataFrame:
    """Vocabulary of segments without what was deleted; only the terms of deleted documents are counted again."""
    gone = postings.join(deleted.select("segment", "doc_id"), ["segment", "doc_id"], "left_semi")
    less = gone.select("segment", "doc_id", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    counted = _read(spark, path, "vocabulary", chosen).select("term", "docs").unionAll(less.select("term", -F.col("docs")))
    return counted.groupBy("term").agg(F.sum("docs").alias("docs")).where("docs > 0")


def merge(spark: SparkSession, path: str, segments: list[str] | None = None) -> str:
    """Write segments, all by default, as one, without what was deleted, and let it take their place."""
    live, added = _manifest(spark, path)
    chosen = live if segments is None else [s for s in segments if s in live]
    deleted = written(_deleted(spark, path, chosen, added), "merge-marks")
    postings = _read(spark, path, "postings", chosen)
    documents = _without(_read(spark, path, "documents", chosen), deleted).drop("segment")
    merged = uuid.uuid4().hex
    rows = _without(postings, deleted)
    _write_postings(rows, path, merged)
    _write_counts(_left(spark, path, chosen, postings, deleted), _put(documents, path, "documents", merged), path, merged)
    discard(deleted)
    _note(spark, path, [(merged, "add"), *((s, "retire") for s in chosen)])
    return merged


def open_index(spark: SparkSession, path: str, analyzer: Analyzer = Analyzer()) -> TextIndex:
    """The index as it is now. Queries read the postings of their terms, one row of totals a segment, and marks."""
    live, added = _manifest(spark, path)
    deleted = written(_deleted(spark, path, live, added), "index-marks")  # a table, so that Spark knows how small it is
    marked = not deleted.isEmpty()

    def postings(wanted: list[str] | DataFrame | None = None) -> DataFrame:
        rows = of_terms(_read(spark, path, "postings", live), wanted)
        if isinstance(wanted, list) and wanted:
            rows = rows.where(F.col("key").isin(*_keys(spark, wanted)))
        return (_without(rows, deleted) if marked else rows).drop("segment", "key")

    lengths = _without(_read(spark, path, "documents", live), deleted).drop("segment")
    gone = deleted.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms"))
    parts = _read(spark, path, "totals", live).select("docs", "terms").unionAll(gone.select(-F.col("docs"), -F.col("terms")))
    totals = parts.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms"))
    return TextIndex(postings, lengths, analyzer, totals)


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(term, docs): in how many documents a term is; what was deleted counts until its segment is merged."""
    live, _ = _manifest(spark, path)
    return _read(spark, path, "vocabulary", live).groupBy("term").agg(F.sum("docs").alias("docs"))
