"""The best documents for every item of a set of queries, by search over two trees.

A document is the impacts of its terms, an item the weights of its terms, and a score their product. Documents are
dealt into batches and items into blocks, each of bounded size, and every block meets every batch in a task of its own.
There, documents that share their strongest term lie side by side, and so do items; a tree over each holds for every
node and term the largest coordinate below it. The product of two nodes bounds every score between their documents
and items: where it is below the weakest k-th score of the node's items, all of them are left out at once, which
changes nothing of the result.

A sixteenth of the batches is searched first. The k-th scores found there are floors for all others.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import LOWER, UPPER, bit_filter, drop_worker_state, in_filter, ranked, text_slices, written

#: Documents and postings at which a batch is closed; items of a block.
BATCH_DOCS, BATCH_POSTINGS, BLOCK_ITEMS = 8192, 2_000_000, 256
#: Documents and items of a leaf; children of a node.
LEAF_DOCS, LEAF_ITEMS, CHILDREN = 32, 4, 8
#: One batch in so many is searched first.
FIRST = 16
#: Bits of the filter that tells which terms are in an item, the same 4 MB for any number of them.
FILTER_BITS = 1 << 25
#: No impact reaches this; sums of doubles below the other are exact.
IMPACT_TOP, EXACT = 10**6, 1 << 53

_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum()).encode()
#: Bytes of a text with A-Z lower-cased and a space for what separates terms; letters beyond ASCII are terms' own.
TERM_BYTES = bytes.maketrans(UPPER.encode() + _SEPARATORS, LOWER.encode() + b" " * len(_SEPARATORS))


def term_counts(text: bytes) -> Counter:
    return Counter(text.translate(TERM_BYTES).split())


def _hashes(terms) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(t) for t in terms), np.uint64, len(terms))


def _lists(values: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(values, kind))


def _item_terms(batches):
    """(item, name, hs, tfs) of every item; `item` is its own number."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        counts = [term_counts(t.as_py() or b"") for t in batch.column("_text").cast(pa.large_binary())]
        size = np.fromiter(map(len, counts), np.int64, len(counts))
        hs = np.concatenate([np.zeros(0, np.uint64), *map(_hashes, counts)]).view(np.int64)
        tfs = np.fromiter((n for c in counts for n in c.values()), np.int64, size.sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(number + np.arange(len(counts))),
                batch.column("_name"),
                _lists(hs, size, pa.int64()),
                _lists(tfs, size, pa.int64()),
            ],
            ["item", "name", "hs", "tfs"],
        )
        number += len(counts)


def _item_filter(items: DataFrame) -> np.ndarray:
    """Bits of the items' term hashes."""
    hashes = items.select(F.explode("hs").alias("h"))
    return bit_filter(hashes.select(F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("slot")), FILTER_BITS)


def _doc_terms(wanted: np.ndarray):
    """(batch, doc, n, hs, tfs) of every document with a term: all its terms counted, those of items listed."""

    def run(batches):
        drop_worker_state()
        number, docs, postings = TaskContext.get().partitionId() << 32, 0, 0
        for batch in (part for whole in batches for part in text_slices(whole)):
            counts = [term_counts(t.as_py() or b"") for t in batch.column("_text").cast(pa.large_binary())]
            some = np.fromiter(map(bool, counts), bool, len(counts))
            counts = [c for c in counts if c]
            if not counts:
                continue
            size = np.fromiter(map(len, counts), np.int64, len(counts))
            hs = np.concatenate(list(map(_hashes, counts)))
            tfs = np.fromiter((n for c in counts for n in c.values()), np.int64, len(hs))
            total = np.add.reduceat(tfs, np.cumsum(size) - size)
            keep = in_filter(wanted, hs & np.uint64(FILTER_BITS - 1))
            kept = np.add.reduceat(keep.astype(np.int64), np.cumsum(size) - size)
            # a batch ends with the document that fills it
            of_doc = np.zeros(len(kept), np.int64)
            for i, k in enumerate(kept.tolist()):
                of_doc[i] = number
                docs, postings = docs + 1, postings + k
                if docs >= BATCH_DOCS or postings >= BATCH_POSTINGS:
                    number, docs, postings = number + 1, 0, 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(of_doc),
                    batch.column("_id").filter(pa.array(some)),
                    pa.array(total),
                    _lists(hs[keep].view(np.int64), kept, pa.int64()),
                    _lists(tfs[keep], kept, pa.int64()),
                ],
                ["batch", "doc", "n", "hs", "tfs"],
            )

    return run


def _frequencies(batches):
    for batch in batches:
        h, n = np.unique(batch.column("hs").flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])


class Tree:
    """Coordinate maxima of rows in their order: levels from the root down to the leaves."""

    def __init__(self, leaves: np.ndarray):
        self.levels = [leaves]
        while len(self.levels[0]) > 1:
            below = self.levels[0]
            self.levels.insert(0, np.maximum.reduceat(below, np.arange(0, len(below), CHILDREN)))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the nodes, child) one level down; on the last level the nodes themselves."""
        if level + 1 >= len(self.levels):
            return np.arange(len(nodes)), nodes
        each = np.minimum(CHILDREN, len(self.levels[level + 1]) - nodes * CHILDREN)
        of = np.repeat(np.arange(len(nodes)), each)
        return of, nodes[of] * CHILDREN + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)

    def at(self, level: int) -> np.ndarray:
        return self.levels[min(level, len(self.levels) - 1)]


def surviving(items: Tree, docs: Tree, floors: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf of items, leaves of documents, bounds): pairs of leaves whose bound reaches the floor and is above 0.

    floors has a row's number for every leaf of items: the weakest k-th score of its items.
    """
    lows = [floors]
    for level in reversed(items.levels[:-1]):
        lows.insert(0, np.minimum.reduceat(lows[0], np.arange(0, len(lows[0]), CHILDREN)))
        assert len(lows[0]) == len(level)
    alive = {0: np.zeros(1, np.int64)}
    bounds: dict[int, np.ndarray] = {}
    for level in range(max(len(items.levels), len(docs.levels))):
        tops, doc_tops = items.at(level), docs.at(level)
        low = lows[min(level, len(lows) - 1)]
        kept = {}
        for i, nodes in alive.items():
            bound = doc_tops[nodes] @ tops[i]
            bound *= 1 + 1e-9  # rounding of sums beyond the exact range
            good = (bound >= low[i]) & (bound > 0)
            if good.any():
                kept[i], bounds[i] = nodes[good], bound[good]
        if level + 1 >= max(len(items.levels), len(docs.levels)):
            return [(i, nodes, bounds[i]) for i, nodes in kept.items()]
        alive = {}
        for i, nodes in kept.items():
            below = docs.children(level, nodes)[1]
            for j in items.children(level, np.array([i]))[1].tolist():
                alive[j] = below
    return []


def _best(docs: pa.Table, items: pa.Table, k: int) -> pa.Table:
    """(item, doc, score): for every item of a block its k best documents of a batch that reach its floor."""
    item_hs, weights, item_row = _flat(items, "hs", "qs")
    terms = np.unique(item_hs)
    doc_hs, tf, doc_row = _flat(docs, "hs", "tfs")
    at = np.minimum(np.searchsorted(terms, doc_hs), len(terms) - 1)
    known = terms[at] == doc_hs
    term, tf, doc_row = at[known], tf[known], doc_row[known]
    impact = 10**9 * tf // (1000 * tf + 12 * docs.column("m").to_numpy()[doc_row])
    n_docs, n_items = len(docs), len(items)
    item_term = np.searchsorted(terms, item_hs)
    top_weight = np.zeros(len(terms), np.int64)
    np.maximum.at(top_weight, item_term, weights)

    # documents with the same strongest term side by side, the strongest first
    strength = impact * top_weight[term]
    by = np.lexsort((-strength, doc_row))
    first = by[np.r_[True, doc_row[by][1:] != doc_row[by][:-1]][: len(by)]]
    lead, force = np.full(n_docs, -1), np.zeros(n_docs, np.int64)
    lead[doc_row[first]], force[doc_row[first]] = term[first], strength[first]
    order = np.lexsort((-force, lead))
    place = np.empty(n_docs, np.int64)
    place[order] = np.arange(n_docs)
    at_place = place[doc_row]
    by = np.argsort(at_place, kind="stable")
    term, impact, at_place = term[by], impact[by], at_place[by]

    vectors = np.zeros((n_items, len(terms)))
    vectors[item_row, item_term] = weights
    leaf_of = at_place // LEAF_DOCS
    leaves = np.zeros((-(-n_docs // LEAF_DOCS), len(terms)))
    np.maximum.at(leaves, (leaf_of, term), impact)
    item_tree = Tree(np.maximum.reduceat(vectors, np.arange(0, n_items, LEAF_ITEMS)))
    doc_tree = Tree(leaves)
    exact = vectors.sum(axis=1).max() * IMPACT_TOP < EXACT

    # ids in ascending order, null last: the smaller place wins a tie
    doc_ids = docs.column("doc").combine_chunks()
    by_id = pc.array_sort_indices(doc_ids).to_numpy()
    id_place = np.empty(n_docs, np.int64)
    id_place[by_id] = np.arange(n_docs)
    id_place = id_place[order]

    floor = items.column("floor").to_numpy().copy()
    heaps: list[list] = [[] for _ in range(n_items)]
    starts = np.searchsorted(leaf_of, np.arange(len(leaves) + 1))
    work: dict[int, list] = {}
    for i, nodes, bounds in surviving(item_tree, doc_tree, np.minimum.reduceat(floor, np.arange(0, n_items, LEAF_ITEMS))):
        for d, bound in zip(nodes.tolist(), bounds.tolist(), strict=True):
            work.setdefault(d, []).append((bound, i))
    for d in sorted(work, key=lambda leaf: -max(work[leaf])[0]):
        rows = [
            r
            for bound, i in work[d]
            for r in range(i * LEAF_ITEMS, min(n_items, (i + 1) * LEAF_ITEMS))
            if bound >= floor[r]
        ]
        if not rows:
            continue
        a, b = starts[d], starts[d + 1]
        columns, own = np.unique(term[a:b], return_inverse=True)
        block = np.zeros((len(columns), LEAF_DOCS))
        block[own, at_place[a:b] - d * LEAF_DOCS] = impact[a:b]
        part = vectors[np.ix_(rows, columns)]
        scores = part @ block if exact else part.astype(np.int64) @ block.astype(np.int64)
        hit = (scores >= floor[rows][:, None]) & (scores > 0)
        for r, c in zip(*np.nonzero(hit), strict=True):
            item, heap = rows[r], heaps[rows[r]]
            at = d * LEAF_DOCS + int(c)
            entry = (int(scores[r, c]), -int(id_place[at]), int(order[at]))
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == k:
                floor[item] = max(floor[item], heap[0][0])
    numbers = items.column("item").to_numpy()
    found = [(numbers[i], row, score) for i, heap in enumerate(heaps) for score, _, row in heap]
    item, row, score = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
    return pa.table({"item": pa.array(item), "doc": doc_ids.take(pa.array(row)), "score": pa.array(score)})


def _flat(table: pa.Table, *names: str):
    """Values of list columns, one after the other, and the row of each."""
    out = []
    for name in names:
        lists = table.column(name).combine_chunks()
        out.append(lists.flatten().to_numpy())
    size = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    return *out, np.repeat(np.arange(len(size)), size)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item, rank, doc, score): for every row of items its k best rows of docs with a score above 0.

    Terms are runs of ASCII letters and digits and of all that is not ASCII, A-Z lower-cased. With N documents that have a
    term, L terms in them, n in a document, tf of one of them and df documents that hold it, a term's weight is
    floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is 75 + 25 n N div L, and the score is the sum over an item's
    terms, repeats included, of weight * (10^9 tf div (1000 tf + 12 m)). Equal scores rank by ascending id, null ids
    last; ranks of an item are distinct. Terms are told apart by 64 bits of their hash.

    Texts without a term, and null, find nothing and are not found. Repeated rows of docs are documents of their own,
    repeated rows of items give their results as often. An empty table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_col).alias("_name"), F.col(item_text_col).cast("string").alias("_text"))
    kind = wanted.schema["_name"].dataType.simpleString()
    queries = written(wanted.mapInArrow(_item_terms, f"item long, name {kind}, hs array<long>, tfs array<long>"), "search-items")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    made = written(
        rows.mapInArrow(_doc_terms(_item_filter(queries)), "batch long, doc long, n long, hs array<long>, tfs array<long>"),
        "search-docs",
    )
    total = made.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = F.lit(total.docs), F.lit(total.terms or 1)
    frequencies = made.select("hs").mapInArrow(_frequencies, "h long, n long").groupBy("h").agg(F.sum("n").alias("df"))
    ratio = (2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    weighted = (
        queries.select("item", F.explode(F.arrays_zip("hs", "tfs")).alias("_t"))
        .select("item", F.col("_t.hs").alias("h"), F.col("_t.tfs").alias("times"))
        .join(frequencies, "h")
        .withColumn("q", F.floor(1000 * F.log(ratio)).cast("long") * F.col("times"))
        .where("q > 0")
        .groupBy("item")
        .agg(F.collect_list(F.struct("h", "q")).alias("_w"), F.max(F.struct("q", "h")).alias("_top"))
        .select("item", F.col("_top.h").alias("lead"), F.col("_w.h").alias("hs"), F.col("_w.q").alias("qs"))
    )
    # items that share their weightiest term are in one block
    placed = ranked(weighted, "search-placed", F.col("lead"), F.col("item"))
    blocks = written(placed.withColumn("block", F.floor(F.col("_rank") / BLOCK_ITEMS).cast("int")).drop("_rank", "lead"), "search-blocks")
    n_blocks = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    m = (75 + F.expr(f"(25 * n * {int(total.docs)}L) div {int(total.terms or 1)}L")).alias("m")
    vectors = made.where(F.size("hs") > 0).select("batch", "doc", "hs", "tfs", m, every)
    batches = written(made.select("batch").distinct(), "search-batches")

    def best(first: bool, floors: DataFrame | None) -> DataFrame:
        share = (F.pmod(F.xxhash64("batch"), F.lit(FIRST)) == 0) == F.lit(first)
        own = blocks.withColumn("floor", F.lit(0).cast("long"))
        if floors is not None:
            own = blocks.join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0)).cast("long"))
        met = batches.where(share).select("batch", every).join(own, "block")
        pairs = vectors.where(share).groupBy("batch", "block").cogroup(met.groupBy("batch", "block"))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return pa.table({c: pa.array([], pa.int64()) for c in ("item", "doc", "score")})
            return _best(left, right, k)

        return pairs.applyInArrow(run, "item long, doc long, score long")

    seeds = written(best(True, None), "search-seeds")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    kth = seeds.withColumn("_at", F.row_number().over(order)).where(F.col("_at") == k)
    floors = written(kth.select("item", F.col("score").alias("floor")), "search-floors")
    found = seeds.unionAll(best(False, floors)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.join(queries.select("item", "name"), "item").select(
        F.col("name").alias(item_col), "rank", F.col("doc").alias(id_col), "score"
    )
