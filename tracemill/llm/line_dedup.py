"""Lines that many documents share: all but the last holder lose them.

Lines are exploded, hashed, and the documents of each hash counted; the positions that go are gathered per
document, and what stays is put together by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import SPACES, ascii_lower, hash_pair, let


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_shared_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_lines, n_dropped, kept) of every row of docs.

    A line's key is the line without surrounding white space and with A-Z lower-cased. A key of min_chars code
    points or more in min_docs documents or more loses its lines in all but the largest id that holds it.

    Null text is one empty line. A null id is one document, smaller than all others. Repeated rows are one
    document and each is returned. An empty table gives no rows. Other columns of docs are not looked at.
    A common line meets its few bytes in one group after partial counting; the join splits large partitions.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    ).withColumn("_row", F.xxhash64("_text"))

    line = F.btrim(F.col("_line"), F.lit(SPACES))
    h1, h2 = hash_pair(F.col("_key"))
    keyed = (
        rows.select("_id", "_row", F.posexplode(_lines(F.col("_text"))).alias("_pos", "_line"))
        .select("_id", "_row", "_pos", line.alias("_line"))
        .where(F.char_length("_line") >= min_chars)
        .select("_id", "_row", "_pos", ascii_lower(F.col("_line")).alias("_key"))
        .select("_id", "_row", "_pos", h1.alias("_h1"), h2.alias("_h2"))
    )
    shared = (
        keyed.select("_h1", "_h2", "_id")
        .distinct()
        .groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_docs"), F.max("_id").alias("_keeper"))
        .where(F.col("_docs") >= min_docs)
        .drop("_docs")
    )
    gone = (
        keyed.join(shared, ["_h1", "_h2"])
        .where(~F.col("_id").eqNullSafe(F.col("_keeper")))
        .groupBy(F.col("_id").alias("_gone_id"), F.col("_row").alias("_gone_row"))
        .agg(F.collect_set("_pos").alias("_gone"))
    )
    same = F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_row") == F.col("_gone_row"))
    n = F.char_length("_text") - F.char_length(F.replace(F.col("_text"), F.lit("\n"))) + 1
    kept = let(
        _lines(F.col("_text")),
        lambda lines: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")), lambda p: F.get(lines, p)
            ),
            "\n",
        ),
    )
    return rows.join(gone, same, "left").select(
        F.col("_id").alias(id_col),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept).alias("kept"),
    )
