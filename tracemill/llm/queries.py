"""The registered queries of the corpus operators, with SQL text where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import (
    alignment,
    decontaminate,
    dual_tree,
    fingerprints,
    jaccard_join,
    line_dedup,
    mixing,
    neural_lm,
    quality,
    quotations,
    secrets,
    simhash,
    token_store,
)
from tracemill.llm.common import LOWER, UPPER, table
from tracemill.plans.registry import Registered

LLM_REGISTRY: dict[str, Registered] = {}


def _register(name: str, sql: str | None = None):
    def enter(run):
        LLM_REGISTRY[name] = Registered(run, sql)
        return run

    return enter


_SPACES_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@_register(
    "op1_line_dedup",
    f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {_SPACES_SQL}), '{UPPER}', '{LOWER}') AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@_register("op7_mixing")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = mixing.mix(table(spark, sf_dir, "documents"))
    each = F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))
    return units.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), each.alias("_")
    ).drop("_")


@_register("op2_token_store")
def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_digests(spark, table(spark, sf_dir, "documents"))


@_register("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprints.hexed(F.col("sketch")).alias("fingerprint"),
        fingerprints.hexed(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


@_register("op6_secrets")
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("findings")


@_register("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_register("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_register("op9_neural_lm")
def op9_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural_lm.score(table(spark, sf_dir, "documents"))


@_register("op10_jaccard_join")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


@_register("op5_chat_formatting")
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link_quotations(table(spark, sf_dir, "conversations"))


_TERMS_SQL = f"""regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')"""


@_register(
    "op11_dual_tree",
    f"""
WITH docs AS (SELECT doc_id, {_TERMS_SQL} AS terms FROM documents WHERE len({_TERMS_SQL}) > 0),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs),
postings AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, corpus GROUP BY term, n_docs),
items AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN postings USING (term), corpus GROUP BY item_id, doc_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
""",
)
def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_register("op12_simhash")
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_register("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_level, pieces = alignment.public_paths()
    return alignment.align(table(spark, sf_dir, "documents"), byte_level, pieces)


@_register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
