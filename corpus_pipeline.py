"""Corpus pipeline: documents to token ids, five stages one after the other.

Every stage gets all that the one before kept, as a table, and its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import decontaminate, jaccard_join, mixing, quality, token_store
from tracemill.llm.common import discard, table, unused, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3.

    Null and empty texts are scored like any other; repeated rows and null ids are kept or go as their text does. An
    empty table gives no rows. Columns of any name stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that links of 0.8 over five words connect, one with the least id.

    Rows are told apart by id and text: of two rows with one id and different texts each is judged by its own text.
    Of rows equal in both, one stays, whatever their other columns. Null ids come last; texts without words, null
    among them, link with nothing, and of their equal rows one stays as well. An empty table gives no rows.
    """
    found = jaccard_join.linked(docs, width=5, share=80)
    row = F.struct(F.col("id").isNull(), "id", "text_hash")
    least = found.where("component IS NOT NULL").groupBy("component").agg(F.min(row).alias("least"))
    names = {c: unused(f"_kept_{c}", docs) for c in ("id", "hash", "n", "row")}
    kept = (
        found.groupBy("id", "text_hash", "component")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(least, "component", "left")
        .where(F.col("component").isNull() | (row == F.col("least")))
        .select(F.col("id").alias(names["id"]), F.col("text_hash").alias(names["hash"]), F.col("n").alias(names["n"]))
    )
    kept = written(kept, "pipeline-kept")
    discard(found)
    same = F.col("doc_id").eqNullSafe(F.col(names["id"])) & (F.xxhash64("text") == F.col(names["hash"]))
    rows = docs.join(kept, same)
    once = rows.where(F.col(names["n"]) == 1).select(*docs.columns)
    more = rows.where(F.col(names["n"]) > 1).dropDuplicates([names["id"], names["hash"]]).select(*docs.columns)
    return once.unionAll(more)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, however edited within a tenth of its length.

    Null and empty texts hold no item and stay, as do null ids; repeated rows stay or go together. An empty table gives
    no rows, an empty benchmark all of them. Columns of any name stay.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it; see mixing.repeat for odd rows."""
    return mixing.repeat(docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store; place, length and checksum of every document read back from it.

    Null and empty texts are the end id alone, null ids come first, repeated rows are documents of their own. An
    empty table gives no rows. Other columns are not looked at.
    """
    return token_store.stored_digests(spark, docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_a_kind),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("token ids", store_tokens),
]

#: SQL can't express a classifier, edit distances or a tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        docs = written(stage(spark, before, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if number:  # the next table is built from it and written
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
