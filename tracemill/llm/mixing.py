"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies. The whole part is given, the fractional part
is a probability. Probabilities are paired and words move from one to the other, at random but without changing
their sum, until one of them is 0 or 1. Blocks of documents are folded side by side; each leaves one open
probability, and these meet in further blocks until one a source is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import ranked, unused, written

#: Probabilities that are folded one after the other in one block.
BLOCK = 128


def _uniform(*parts) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def source_targets(units: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target, rows) of units (source, size, n), as a written table.

    Sources in order of code points, null last, take the weights in turn; the targets share `share` times all
    sizes by weight. A target stops at `cap` times its source's size, and the excess is shared again.
    """
    sums = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("units"))
    order = (F.col("source").isNull().cast("int"), F.col("source"))
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights)).cast("int")).cast("double")
    sources = written(ranked(sums, "mix-ranks", *order).select("source", "source_size", "units", weight.alias("weight")), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, free = 0.0, None
    while True:  # the set of sources that stop only grows, so this ends
        stops = F.lit(cap) * F.col("source_size") <= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum(F.when(stops, cap * F.col("source_size"))).alias("held"),
            F.sum(F.when(~stops, F.col("weight"))).alias("weight"),
            F.count(F.when(~stops, 1)).alias("free"),
        ).first()
        if row.free == free or not row.weight:
            break
        free, level = row.free, (share * total - (row.held or 0.0)) / row.weight
    target = F.least(F.lit(cap) * F.col("source_size"), F.lit(float(level)) * F.col("weight"))
    if free is None or not row.weight:
        target = F.lit(cap) * F.col("source_size")
    return sources.select("source", "source_size", "units", target.alias("target"))


def _fold(seed: int) -> Column:
    """Block of items {u1, u2, size, p} -> {won: keys that got 1, open: the item that is left}."""

    def step(acc: Column, b: Column) -> Column:
        a = acc["open"]
        to_b = F.least(a["size"] * a["p"], b["size"] * (1.0 - b["p"]))
        to_a = F.least(b["size"] * b["p"], a["size"] * (1.0 - a["p"]))
        give = _uniform(a["u1"], b["u1"], a["u2"], b["u2"], F.lit(seed)) * (to_a + to_b) < to_a
        empty = a["size"] * a["p"] <= b["size"] * (1.0 - b["p"])  # giving leaves a with 0, else fills b
        filled = b["size"] * b["p"] >= a["size"] * (1.0 - a["p"])  # taking fills a, else leaves b with 0

        def item(of: Column, p: Column) -> Column:
            return F.struct(
                of["u1"].alias("u1"), of["u2"].alias("u2"), of["size"].alias("size"), p.alias("p")
            )

        def out(won, left) -> Column:
            return F.struct((F.array_append(acc["won"], won) if won is not None else acc["won"]).alias("won"), left.alias("open"))

        key = lambda x: F.struct(x["u1"].alias("u1"), x["u2"].alias("u2"))
        clip = lambda p: F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
        return (
            F.when(a["p"] <= 0.0, out(None, b))
            .when(b["p"] <= 0.0, out(None, a))
            .when(a["p"] >= 1.0, out(key(a), b))
            .when(b["p"] >= 1.0, out(key(b), a))
            .when(give & empty, out(None, item(b, clip(b["p"] + to_b / b["size"]))))
            .when(give, out(key(b), item(a, clip(a["p"] - to_b / a["size"]))))
            .when(filled, out(key(a), item(b, clip(b["p"] - to_a / b["size"]))))
            .otherwise(out(None, item(a, clip(a["p"] + to_a / a["size"]))))
        )

    start = F.struct(
        F.expr("CAST(array() AS ARRAY<STRUCT<u1: BIGINT, u2: BIGINT>>)").alias("won"),
        F.expr("named_struct('u1', 0L, 'u2', 0L, 'size', 0.0D, 'p', 0.0D)").alias("open"),
    )
    return F.aggregate(F.array_sort("items"), start, step)


def round_pivotal(items: DataFrame, seed: int = 0) -> DataFrame:
    """(u1, u2) of the items (source, u1, u2, size, p) whose probability became 1."""
    cells = items.groupBy("source").agg(F.count(F.lit(1)).alias("blocks"))
    largest = cells.agg(F.max("blocks")).first()[0] or 0
    won, level = [], 0
    while largest:
        cells = cells.withColumn("blocks", F.ceil(F.col("blocks") / BLOCK))
        largest = -(-largest // BLOCK)
        held = written(
            items.withColumnRenamed("source", "_source")
            .join(cells, F.col("_source").eqNullSafe(F.col("source")))
            .groupBy("source", F.pmod(F.xxhash64("u1", "u2", F.lit(level)), F.col("blocks")).alias("block"))
            .agg(F.collect_list(F.struct("u1", "u2", "size", "p")).alias("items"))
            .select("source", _fold(seed + level).alias("out")),
            f"mix-level{level}",
        )
        won.append(held.select(F.explode("out.won").alias("k")).select("k.u1", "k.u2"))
        items, level = held.select("source", "out.open.*"), level + 1
        if largest <= 1:
            # the one that is left goes to the nearer side, which keeps its source nearest to the target
            won.append(items.where(F.col("p") >= 0.5).select("u1", "u2"))
            break
    return reduce(DataFrame.unionAll, won) if won else items.select("u1", "u2")


def mix(
    docs: DataFrame,
    weights=(5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, text_hash, n, size, source_size, target, copies): one row for n equal documents.

    Size is the number of words. A document is taken a whole number of times, the whole part of target divided by
    source size or one more. The words a source gives differ from its target by less than one document's size.
    Reruns agree: chance comes from hashes of id, text and source.

    Null text has size 0 and is never taken. Null is a source like any other, last in order; null ids are ids.
    Repeated rows are one unit and are taken equally often. An empty table gives no rows.
    """
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit("[^ \\t-\\r]+"))
    units = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.xxhash64(text_col).alias("text_hash"),
            words.cast("long").alias("one"),
        )
        .groupBy("doc_id", "source", "text_hash", "one")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("size", F.col("one") * F.col("n")),
        "mix-units",
    )
    parts = [F.col(c) for c in ("doc_id", "source", "text_hash")]
    flags = F.col("doc_id").isNull().cast("int") + 2 * F.col("source").isNull().cast("int")
    targets = source_targets(units, weights, share, cap).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    placed = (
        units.join(targets.drop("units"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("rate", rate)
        .withColumn("u1", F.xxhash64(*parts, flags))
        .withColumn("u2", F.xxhash64(F.lit(1), *parts, flags))
    )
    open_part = F.col("rate") - F.floor("rate")
    items = placed.where((F.col("size") > 0) & (open_part > 0)).select(
        "source", "u1", "u2", F.col("size").cast("double").alias("size"), open_part.alias("p")
    )
    won = round_pivotal(items, seed).withColumn("won", F.lit(1))
    return placed.join(won, ["u1", "u2"], "left").select(
        "doc_id",
        "source",
        "text_hash",
        "n",
        F.col("one").alias("size"),
        "source_size",
        "target",
        F.when(F.col("size") > 0, F.floor("rate") + F.coalesce("won", F.lit(0))).otherwise(0).cast("long").alias("copies"),
    )


def repeat(docs: DataFrame, **settings) -> DataFrame:
    """Rows of docs, as they are, each as often as mix() takes it.

    Null text and text without words is never taken, so its rows go. Null sources and ids are values like any other.
    Repeated rows are taken equally often. An empty table gives no rows. Columns of any name stay.
    """
    text, source, doc = (settings.get(k, v) for k, v in (("text_col", "text"), ("source_col", "source"), ("id_col", "doc_id")))
    names = {c: unused(f"_mix_{c}", docs) for c in ("doc_id", "source", "text_hash", "copies", "each")}
    taken = mix(docs, **settings).where("copies > 0")
    taken = taken.select(*(F.col(c).alias(n) for c, n in names.items() if c != "each"))
    same = (
        F.col(doc).eqNullSafe(F.col(names["doc_id"]))
        & F.col(source).cast("string").eqNullSafe(F.col(names["source"]))
        & (F.xxhash64(text) == F.col(names["text_hash"]))
    )
    each = F.explode(F.array_repeat(F.lit(0), F.col(names["copies"]).cast("int"))).alias(names["each"])
    return docs.join(taken, same).select(*(docs[c] for c in docs.columns), each).drop(names["each"])
