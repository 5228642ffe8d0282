"""Text files as numbered lines, and running sums over them.

A file may be far larger than a task should hold, so order inside a file is kept as
(block, pos): the input split a line comes from and its place in that split. Running sums
add up blocks first and then lines within a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, block, pos, line, modified) of every line of the files."""
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.text(path).select(
        F.regexp_replace("_metadata.file_path", r"^file:(//)?", "").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def running_sum(
    rows: DataFrame,
    keys: list[str],
    block: str,
    order: list[str],
    value: Column,
    name: str,
    inclusive: bool = False,
) -> DataFrame:
    """Sum of `value` over the rows of the same keys before each row.

    Rows are ordered by block and then by `order`. No window holds more than one block
    of a key, or one row per block.
    """
    valued = rows.withColumn("_value", value.cast("bigint"))
    blocks = valued.groupBy(*keys, block).agg(F.sum("_value").alias("_total"))
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    bases = blocks.select(
        *[F.col(k).alias(f"_{k}") for k in (*keys, block)],
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"),
    )
    end = W.currentRow if inclusive else -1
    inside = W.partitionBy(*keys, block).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    local = valued.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, block)]
    return (
        local.join(bases, same)
        .withColumn(name, F.col("_base") + F.col("_local"))
        .drop("_value", "_local", "_base", *[f"_{k}" for k in (*keys, block)])
    )


def list_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, size, modified) of the files below a folder; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files.select(
        F.regexp_replace("path", r"^file:(//)?", "").alias("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )
