"""Helpers the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import threading
import time
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.session import discard, written

__all__ = ["discard", "written"]  # operators take them from here

#: The white space that separates words and surrounds lines.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and every other letter as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once a row: a lambda would compute an expression for each element."""
    return F.transform(F.array(value), use)[0]


def hash_pair(text: Column) -> tuple[Column, Column]:
    """128 bits of a text as two numbers."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


#: Module under which a worker keeps what outlives a task.
WORKER_STATE = "tracemill_worker_state"


def drop_worker_state(keeping: str | None = None) -> None:
    """Give back what an earlier operator's tasks kept in this worker, unless it has something of that name."""
    if keeping and hasattr(sys.modules.get(WORKER_STATE), keeping):
        return
    if sys.modules.pop(WORKER_STATE, None) is not None:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


#: Seconds after which a worker that has nothing to do gives back what it kept: longer than the pauses between stages.
IDLE_SECONDS = 20.0


def worker_state():
    """What this worker keeps from task to task; call it with every slice of work that uses it.

    Workers outlive stages, and many stand idle: a thread gives the state back once nothing has used it for a while.
    """
    home = sys.modules.get(WORKER_STATE)
    lock = getattr(home, "lock", None)
    if lock is not None:
        with lock:
            if sys.modules.get(WORKER_STATE) is home:
                home.used = time.monotonic()
                return home
    home = types.ModuleType(WORKER_STATE)
    home.lock = lock = threading.Lock()
    home.used = time.monotonic()
    sys.modules[WORKER_STATE] = home

    def watch() -> None:
        while sys.modules.get(WORKER_STATE) is home:
            time.sleep(1)
            with lock:
                if sys.modules.get(WORKER_STATE) is home and time.monotonic() - home.used > IDLE_SECONDS:
                    home.__dict__.clear()
                    drop_worker_state()

    threading.Thread(target=watch, daemon=True).start()
    return home


def bit_filter(slots: DataFrame, bits: int) -> np.ndarray:
    """Bits, a multiple of 32,768 of them, that are set at the numbers in the column `slot`: the same size for any table."""
    words = slots.select((F.col("slot") + 1).alias("_s")).groupBy(F.call_function("bitmap_bucket_number", F.col("_s")).alias("word"))
    words = words.agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("_s"))).alias("bits"))
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for r in words.collect():
        out[r.word - 1] |= np.frombuffer(bytes(r.bits), np.uint8)
    return out.reshape(-1)


def in_filter(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def unused(name: str, *tables: DataFrame) -> str:
    """The name, or one like it, that no column of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batch: pa.RecordBatch, size: int = 4 << 20):
    """Parts of a batch whose `_text` has about so many bytes each; a longer text is a part of its own."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("_text")), 0)))
    cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, size)[1:], "right")
    edges = sorted({0, *cuts.tolist(), batch.num_rows})
    return [batch.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def ranked(rows: DataFrame, name: str, *keys: Column) -> DataFrame:
    """Rows with their place `_rank` (from 0) in the order of keys, as a written table.

    Ranges are sorted apart; only one count per range, as many as there are partitions, meets in one task.
    """
    placed = written(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()),
        name,
    )
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("_rank", F.col("_start") + within)
        .drop("_part", "_start", "_at")
    )


def ordered_bucket(rows: DataFrame, key: str, buckets: int) -> Column:
    """Number of the key's range among at most `buckets` ranges of about as many rows, ascending, nulls first.

    The edges are quantiles over all rows, at most 10,000 numbers whatever the size of the table.
    """
    n = max(1, min(buckets, 10_000))
    at = [i / n for i in range(1, n)]
    edges = rows.agg(F.percentile_approx(key, at, 10_000)).first()[0] if at else None
    edges = sorted(set(edges or ()))
    if not edges:
        return F.lit(0)
    below = F.filter(F.lit(edges), lambda edge: edge <= F.col(key))
    return F.when(F.col(key).isNull(), 0).otherwise(F.size(below))
