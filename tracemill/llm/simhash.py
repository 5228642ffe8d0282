"""Texts whose SimHash fingerprints are near each other, by pigeonhole blocks.

A fingerprint has 64 bits: a bit is set where more than half of the hashes of a text's word shingles set it. It is
split into blocks of bits, more than the bits in which two may differ: near fingerprints agree in all but `distance`
of the blocks, so each choice of the other blocks is a table in which they share a row. Fingerprints are joined on
these rows and verified by the number of bits that differ.

Equal fingerprints are one node whatever their number. A row that many nodes share is cut into parts, every two of
which meet in a group of their own, so no task holds more than two parts. A group gives a forest of verified pairs,
which connects what is near in it, and never all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import drop_worker_state, partitions, written
from tracemill.llm.graph import components

#: Fixed value: seed of the shingle hash.
SEED = 42
#: Nodes in a part of a row, about.
PART = 2048
#: Hashes that are counted bit by bit; more are counted byte by byte.
FEW = 256

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, width: int = 4) -> int:
    """Signed 64-bit fingerprint of one text."""
    words = text.lower().split()  # of bytes: A-Z alone, and the six ASCII spaces
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    last = ends[-n:]
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], ">u8")
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    if n < FEW:
        ones = np.unpackbits(by_byte, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(by_byte[:, i], minlength=256) @ _BITS_OF_BYTE for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _fingerprints(width: int):
    def run(batches):
        drop_worker_state()
        for batch in batches:
            texts = batch.column("_text").cast(pa.large_binary())
            made = [fingerprint(t.as_py() or b"", width) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(made, pa.int64())], ["id", "fp"])

    return run


def masks(distance: int, blocks: int) -> list[int]:
    """For every choice of `blocks - distance` of the blocks, the bits of these blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    whole = [sum(chosen) for chosen in combinations(own, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def _find(parent: list, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _forest(fp: np.ndarray, end: np.ndarray, side: np.ndarray, crossed: np.ndarray, distance: int):
    """Places (i, j) of near pairs that connect all that is near within each run; end[i] is where the run of i stops.

    Rows of a crossed run are compared with those of its other side only.
    """
    label, out = np.arange(len(fp)), []
    parent = label.tolist()
    at, d = np.flatnonzero(np.arange(1, len(fp) + 1) < end), 1
    while len(at):
        to = at + d
        near = np.bitwise_count(fp[at] ^ fp[to]) <= distance
        near &= (label[at] != label[to]) & (~crossed[at] | (side[at] != side[to]))
        if near.any():
            for i, j in zip(at[near].tolist(), to[near].tolist(), strict=True):
                a, b = _find(parent, i), _find(parent, j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((i, j))
            label = np.array(parent)
            while (up := label[label]).tolist() != label.tolist():
                label = up
        d += 1
        at = at[at + d < end[at]]
    return np.array(out, np.int64).reshape(-1, 2)


def _near(distance: int):
    """Pairs (a, b) of rows sorted by their group; the last group of a batch waits for the next one."""
    keys = ("tab", "part", "low", "high")

    def run(batches):
        held = None
        for batch in _ended(batches):
            if batch is not None and not batch.num_rows:
                continue
            rows = held if batch is None else {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "side", "fp")}
            if rows is None:
                break
            if batch is not None and held is not None:
                rows = {c: np.r_[held[c], rows[c]] for c in rows}
            new = np.r_[True, np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in keys])]
            starts = np.flatnonzero(new)
            stop = len(new) if batch is None else int(starts[-1])
            held = {c: v[stop:] for c, v in rows.items()}
            if stop:
                starts = starts[starts < stop]
                ends = np.r_[starts[1:], stop]
                end = np.repeat(ends, ends - starts)
                fp = rows["fp"][:stop]
                crossed = (rows["low"] != rows["high"])[:stop]
                pairs = _forest(fp.view(np.uint64), end, rows["side"][:stop], crossed, distance)
                yield pa.RecordBatch.from_arrays([pa.array(fp[pairs[:, 0]]), pa.array(fp[pairs[:, 1]])], ["a", "b"])

    return run


def _ended(batches):
    yield from batches
    yield None


def near_pairs(nodes: DataFrame, distance: int, blocks: int) -> DataFrame:
    """Distinct pairs (a, b) of the fingerprints `fp` that connect all that differ in at most `distance` bits."""
    tables = F.array(*(F.struct(F.lit(i).alias("tab"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks(distance, blocks))))
    keyed = nodes.select("fp", F.explode(tables).alias("_t")).select("fp", "_t.tab", "_t.part")
    counts = keyed.groupBy("tab", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark sizes an exploded table by the file it is made of, tens of times too low, and would gather it on the driver
    members = keyed.hint("merge").join(counts, ["tab", "part"])
    parts = F.ceil(F.col("n") / PART).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    met = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    groups = met.select(
        "tab",
        "part",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "fp",
    )
    by = ["tab", "part", "low", "high"]
    return (
        groups.repartition(partitions(nodes.sparkSession), *by)
        .sortWithinPartitions(*by, "side", "fp")
        .mapInArrow(_near(distance), "a long, b long")
        .distinct()
    )


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(
    docs: DataFrame,
    width: int = 4,
    distance: int = 4,
    blocks: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, fingerprint, component_id) of every row of docs.

    Words are what lies between the six ASCII spaces, A-Z lower-cased. A fingerprint is made from the 64-bit hashes
    of the shingles of `width` words, repeats included. Two texts link when their fingerprints differ in at most
    `distance` bits; component_id is the least id that links reach. More `blocks` than `distance` are needed: with
    more of them rows are longer and fewer fingerprints share one by chance, but there are more tables. The choice
    changes work and never the result.

    Null text, and text without words, has the fingerprint zero and links like any other. A text of fewer words is one
    shingle. Null ids are never a component's id unless it has no other. Repeated rows are copies and each gives a
    row. An empty table gives no rows. Other columns are not looked at.
    """
    if not 0 <= distance < blocks <= 64:
        raise ValueError("blocks must be more than distance, and at most 64")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    made = written(rows.mapInArrow(_fingerprints(width), "id long, fp long"), "simhash-made")
    nodes = written(made.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-nodes")
    links = written(near_pairs(nodes, distance, blocks), "simhash-links")
    found = components(links, "simhash-components").withColumnRenamed("node", "fp")
    labelled = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = labelled.join(least, "component").select(F.col("fp").alias("_fp"), "component_id")
    return made.join(of_node, F.col("fp") == F.col("_fp")).select(
        F.col("id").alias(id_col), hexed(F.col("fp")).alias("fingerprint"), "component_id"
    )
