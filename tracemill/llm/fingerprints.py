"""Threshold-scaled fingerprints: every shingle hash below a fixed fraction of the hash range.

Sketches of parts merge into the sketch of the whole, and two sketches estimate likeness and containment
however unequal the texts are, because both keep the same hashes of what they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import let, ordered_bucket, partitions

SHINGLE = 5
FRACTION = 0.25


def sketch(text: Column, fraction: float = FRACTION, words: int = SHINGLE) -> Column:
    """Sorted distinct hashes of the word shingles of a text that lie below the fraction.

    Words are lower-cased and split at white space; a text with fewer words is one shingle. The smallest hash is
    always kept, so only a text without words (or null) has an empty sketch.
    """
    below = int(-(1 << 63) + fraction * (1 << 64))
    split = F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), "[ \\t-\\r]+")

    def shingles(hashes: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - words),
            lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(words))),
        )
        return F.when(F.size(hashes) >= words, many).otherwise(F.array(F.xxhash64(hashes)))

    def kept(hashes: Column) -> Column:
        low = F.filter(hashes, lambda h: h < F.lit(below))
        return F.array_sort(F.array_distinct(F.array_append(low, F.array_min(hashes))))

    hashes = F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w))
    empty = F.expr("CAST(array() AS ARRAY<BIGINT>)")
    return let(hashes, lambda h: F.when(F.size(h) == 0, empty).otherwise(let(shingles(h), kept)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches; two empty ones are alike."""
    together = F.size(F.array_union(a, b))
    return F.when(together == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / together)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; an empty sketch is contained in any."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column) -> Column:
    """Sketch of two texts together."""
    return F.array_sort(F.array_union(a, b))


def hexed(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch): every row with the row that follows it, the last with the first.

    Order: id ascending, null first, equal ids by text. Rows are dealt by quantiles of the id; the last row of a
    range takes the first row of the next, and only these first rows, one a range, are gathered.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    n = partitions(docs.sparkSession)
    bucket = ordered_bucket(rows.select("_id"), "_id", 8 * n).alias("_bucket")
    rows = rows.select(bucket, "_id", "_text")
    key = F.struct(F.col("_id").isNotNull().alias("filled"), F.col("_id").alias("_id"))
    least = rows.groupBy("_bucket").agg(F.min(key).alias("_least")).select(F.col("_bucket").alias("_b"), "_least._id")
    least = least.withColumnRenamed("_id", "_first_id")
    texts = (
        rows.join(F.broadcast(least), (F.col("_bucket") == F.col("_b")) & F.col("_id").eqNullSafe(F.col("_first_id")))
        .groupBy("_b")
        .agg(F.min("_text").alias("_after_text"))
        .withColumn("_after", sketch(F.col("_after_text"), fraction))
        .withColumnRenamed("_b", "_target")
    )
    order = Window.orderBy("_b")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = least.select("_b", F.coalesce(F.lead("_b").over(order), F.first("_b").over(everything)).alias("_target"))
    after = follow.join(texts, "_target").drop("_target")

    within = Window.partitionBy("_bucket").orderBy(F.col("_id").asc_nulls_first(), "_text")
    return (
        rows.repartition(n, "_bucket")
        .withColumn("_sketch", sketch(F.col("_text"), fraction))
        .withColumn("_lead", F.lead(F.struct("_text", "_sketch")).over(within))
        .join(after, F.col("_bucket") == F.col("_b"), "left")
        .select(
            F.col("_id").alias(id_col),
            F.col("_text").alias("text"),
            F.col("_sketch").alias("sketch"),
            F.coalesce("_lead._text", "_after_text").alias("next_text"),
            F.coalesce("_lead._sketch", "_after").alias("next_sketch"),
        )
    )


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Each text beside its edited form, whose last quarter of code points is the start of the next text.

    Null text counts as empty; an empty text edits to itself. A null id comes first. Repeated rows follow one
    another. A single row is its own next. An empty table gives no rows. Other columns are not looked at.
    """
    rows = with_next(docs, id_col, text_col, fraction)
    chars = F.char_length("text")
    quarter = F.floor(chars / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), chars - quarter), F.substring("next_text", F.lit(1), quarter))
    return rows.select(
        id_col,
        chars.cast("long").alias("n_chars"),
        edited.alias("edited_text"),
        "sketch",
        "next_sketch",
    ).withColumn("edited_sketch", sketch(F.col("edited_text"), fraction))
