"""Texts whose sets of word shingles are alike, by PartEnum signatures.

Sets are dealt into bands of size, so that two sets alike enough are in the same or in neighbouring bands, and in
a pair of bands they differ in at most k elements. The domain of the hashes is split into partitions, more than half
of k, so that one holds at most one of the differences, and each of these again in two, of which one is left out in
turn: two such sets agree on what is left of that partition. Hashes of these parts are the signatures.

Passages that many texts share would make groups of texts that are not alike. Shingles that are in about thirty texts
or more, by a sample that is a fixed part of all texts, are therefore left out of the domain; what is left of two sets
differs in no more than k elements either. They are kept as bits of their hashes, which takes the same room for any
number of them. Sets that keep too little for a guarantee give signatures of their whole as well. Which shingles count
as frequent changes the groups and never the result.

Equal sets are one node. Nodes that share a signature are compared block against block, by 16 bits of each hash and
then by their whole sets: once for a forest of pairs that connects what is near, and where a group still spans several
components once more for all pairs across them. Pairs within one component decide nothing and are not compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import bit_filter, discard, drop_worker_state, in_filter, partitions, text_slices, written
from tracemill.llm.graph import components

#: Texts that are split at a time, in bytes.
SLICE_BYTES = 4 << 20
#: Texts, or their sets, that pass to a task at a time.
TEXT_ROWS = 2000
#: Nodes of a group that are compared in one task.
BLOCK = 2048
#: Partitions beyond half the difference, which make up for empty halves; other partitionings where they don't.
SPARE, SEEDS = 2, 4
#: Part of the texts that is sampled; shingles in so many of its texts are frequent.
SAMPLE, FREQUENT = 1 / 8, 4
#: Bits of the filter that tells most texts without a partner before their sets are made again.
FILTER_BITS = 1 << 25


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int):
    """Sorted distinct 64-bit hashes of each text's word shingles, A-Z lower-cased.

    A text of fewer words is one shingle, one without words an empty set.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    size = np.cumsum(np.asarray(pc.binary_length(texts)))
    cuts = np.searchsorted(size, np.arange(0, size[-1] if len(size) else 0, SLICE_BYTES)[1:], "right")
    edges = sorted({0, *cuts.tolist(), len(texts)})
    for a, b in zip(edges, edges[1:], strict=False):
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(a, b - a)))
        flat, ends = words.flatten(), np.asarray(words.offsets)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
        filled = np.asarray(pc.binary_length(flat)) > 0  # splitting may leave empty words at the ends
        code = np.asarray(coded.indices)
        upto = np.concatenate(([0], np.cumsum(filled)))[ends - ends[0]]
        h = own[code[filled]] if len(code) else own
        mixed = _mix(h + np.uint64(width))
        for i in range(1, width):
            mixed = _mix(mixed[: len(h) - i] * np.uint64(3) + h[i:]) if len(h) > i else mixed[:0]
        for s, e in zip(upto, upto[1:], strict=False):
            if e - s >= width:
                yield np.unique(mixed[s : e - width + 1])
            elif e > s:
                one = np.full(1, 0x9E3779B97F4A7C15 + int(e - s), np.uint64)
                for x in h[s:e]:
                    one = _mix(one * np.uint64(3) + x)
                yield one
            else:
                yield mixed[:0]


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as signed numbers."""
    both = np.array([_mix(s).sum(dtype=np.uint64), _mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)])
    both = _mix(both + np.uint64(len(s))).view(np.int64)
    return int(both[0]), int(both[1])


class Bands:
    """Bands of set sizes for a likeness of share %; the largest difference k of sets in two neighbouring ones."""

    def __init__(self, share: int):
        self.share, self.tops = share, [0]

    def of(self, n: int) -> int:
        while self.tops[-1] < n:
            low = self.tops[-1] + 1
            self.tops.append(100 * low // self.share)
        return int(np.searchsorted(self.tops, n))

    def k(self, band: int) -> int:
        """100 i >= share u for sets of at most top elements: i + u = sum of sizes, u - i <= this."""
        self.of(self.tops[-1] + 1 if band >= len(self.tops) else 1)
        rest = 100 - self.share
        return rest * 2 * self.tops[band] // (200 - rest)


def _cells(s: np.ndarray, k: int, tag: int) -> np.ndarray:
    """Hashes of the filled halves of the partitions of a sorted set."""
    n = 2 * (k // 2 + SPARE + k // 40)  # large differences leave more halves empty
    edges = (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64)
    stops = np.concatenate(([0], np.searchsorted(s, edges), [len(s)]))
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(s ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)))
    half = upto[stops[1:]] - upto[stops[:-1]]
    some = stops[1:] > stops[:-1]
    tags = np.arange(n, dtype=np.uint64) + np.uint64(tag << 32)
    return _mix(half + _mix(tags))[some]


def signatures(s: np.ndarray, bands: Bands, rest: np.ndarray) -> np.ndarray:
    """Signatures of one set, `rest` being what of it is not frequent; sets that are alike but not equal share one.

    k differences touch at most k of the halves, so if one of two sets fills more than k, both share a filled one.
    """
    if not len(s):
        return np.zeros(0, np.int64)
    out, band = [], bands.of(len(s))
    for instance in (band, band + 1):
        k = bands.k(instance)
        if not k:  # only equal sets are alike
            continue
        tag = instance * (SEEDS + 1)
        out.append(_cells(rest, k, tag))
        if len(out[-1]) > k:
            continue
        for seed in range(1, SEEDS + 1):
            out.append(_cells(np.sort(_mix(s + np.uint64(seed))), k, tag + seed))
            if len(out[-1]) > k:
                break
        else:
            out.append(_mix(np.array([tag, 0xFF], np.uint64))[:1] + np.uint64(1))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _sets(width: int):
    def run(batches):
        drop_worker_state()
        for batch in (part for whole in batches for part in text_slices(whole)):
            out = [(len(s), *(set_hash(s) if len(s) else (None, None))) for s in shingle_sets(batch.column("_text"), width)]
            n, hi, lo = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_hash"), *(pa.array(x, pa.int64()) for x in (n, hi, lo))],
                ["id", "text_hash", "n", "hi", "lo"],
            )

    return run


def _sampled(width: int):
    def run(batches):
        for batch in (part for whole in batches for part in text_slices(whole)):
            sets = list(shingle_sets(batch.column("_text"), width))
            h, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), [])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    return run


def _signed(width: int, share: int, frequent: np.ndarray):
    def run(batches):
        drop_worker_state()
        bands, seen = Bands(share), set()
        for batch in (part for whole in batches for part in text_slices(whole)):
            sigs, los = [], []
            for s in shingle_sets(batch.column("_text"), width):
                if len(s):
                    key = set_hash(s)
                    if key in seen:  # equal sets give equal rows
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(key)
                    sigs.append(signatures(s, bands, s[~in_filter(frequent, s & np.uint64(FILTER_BITS - 1))]))
                    los.append(np.full(len(sigs[-1]), key[1], np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(los))], ["sig", "lo"])

    return run


def _shared(batches):
    """(gid, lo): the distinct rows of groups of several, of rows sorted by (sig, lo).

    Groups that begin and end within a batch and have the same members become one. A group's first rows may come
    with one batch and the rest with the next: then it keeps its signature as its name, and one row is held.
    """
    held, wanted, seen = None, False, set()
    for batch in batches:
        sig, lo = batch.column("sig").to_numpy(), batch.column("lo").to_numpy()
        if held is not None:
            sig, lo = np.r_[held[0], sig], np.r_[held[1], lo]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (lo[1:] != lo[:-1])]
        sig, lo = sig[new], lo[new]
        same = sig[1:] == sig[:-1]
        several = np.r_[wanted, same] | np.r_[same, False]
        held, wanted = (sig[-1], lo[-1]), bool(several[-1] and (len(sig) > 1 and same[-1] or wanted and len(sig) == 1))
        name, keep = sig.copy(), several
        keep[-1] = False  # the last row comes again
        starts = np.flatnonzero(np.r_[True, ~same])
        stops = np.r_[starts[1:], len(sig)]
        members = np.add.reduceat(_mix(lo.view(np.uint64) ^ np.uint64(0xE7037ED1A0B428DB)), starts)
        for a, b, m in zip(starts, stops, members, strict=True):
            if b - a > 1 and a > 0 and b < len(sig):
                if int(m) in seen:
                    keep[a:b] = False
                else:
                    seen.add(int(m))
                    name[a:b] = np.uint64(m).view(np.int64)
        if len(seen) > 200_000:
            seen.clear()
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(name[keep]), pa.array(lo[keep])], ["gid", "lo"])
    if held is not None and wanted:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]])], ["gid", "lo"])


def _id_filter(ids: DataFrame) -> np.ndarray:
    """Bits of the hashed ids, the same few MB for any number of them."""
    slot = F.pmod(F.xxhash64("_id"), F.lit(FILTER_BITS))
    words = (
        ids.select(slot.alias("slot"))
        .groupBy(F.call_function("bitmap_bucket_number", F.col("slot")).alias("bucket"))
        .agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("slot"))).alias("bits"))
    )
    size = 4096 * 8
    out = np.zeros((FILTER_BITS // size + 2, size // 8), np.uint8)
    for r in words.collect():
        out[r.bucket] |= np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _hit(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Which slots are set; buckets count from 1 and their bits from slot 1, slot 0 is in bucket 0."""
    at = np.maximum(slot - 1, 0)
    bucket, bit = np.where(slot == 0, 0, at // 32768 + 1), np.where(slot == 0, 0, at % 32768)
    return ((bits[bucket, bit // 8] >> (bit % 8).astype(np.uint8)) & 1).astype(bool)


def _hashes(width: int, wanted: np.ndarray):
    """Whole sets of the texts whose id the filter lets pass."""

    def run(batches):
        for batch in (part for whole in batches for part in text_slices(whole)):
            hit = _hit(wanted, batch.column("_slot").to_numpy(zero_copy_only=False))
            rows = list(shingle_sets(batch.filter(pa.array(hit)).column("_text"), width))
            hashes = pa.array([s.view(np.int64) for s in rows], pa.list_(pa.int64()))
            keys = [set_hash(s) if len(s) else (None, None) for s in rows]
            hi, lo = zip(*keys, strict=True) if keys else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), hashes], ["hi", "lo", "hashes"]
            )

    return run


def _passing(name: str, bits: np.ndarray):
    """Rows whose hashed number the filter lets pass."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_hit(bits, batch.column(name).to_numpy(zero_copy_only=False))))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike; only sets of these pairs travel."""
    bits = _id_filter(pairs.select(F.explode(F.array("a", "b")).alias("_id")))
    slot = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS)).alias("_slot")
    sets = sets.select("node", "hashes", slot).mapInArrow(_passing("_slot", bits), "node long, hashes array<long>, _slot long")
    one, two = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"_{c}")) for c in "ab")
    both = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - both
    return pairs.join(one, "a").join(two, "b").where(100 * both >= share * union).select("a", "b")


def _near_pairs(table: pa.Table, share: int, forest: bool) -> pa.Table:
    """Pairs of different components within a block, or across two, that may be alike by 16 bits of each hash.

    Common 16-bit values are at least as many as common elements, so no link is lost. A forest holds only pairs that
    connect what the pairs before them have not connected.
    """
    nodes, comps, side = (table.column(c).to_numpy() for c in ("node", "component", "side"))
    sets = table.column("bits").combine_chunks()
    flat = sets.flatten().to_numpy().view(np.uint16)
    size = np.asarray(pc.list_value_length(sets)).astype(np.int64)
    stop = np.cumsum(size)
    start = stop - size
    out_a, out_b = [], []
    there = np.zeros(1 << 16, np.int64)
    crossed = len(np.unique(side)) > 1
    for i in range(len(nodes)):
        if crossed and side[i]:
            continue
        there[:] = 0
        there[flat[start[i] : stop[i]]] = 1
        both = np.add.reduceat(there[flat], start)
        near = (100 * both >= share * (size[i] + size - both)) & (comps != comps[i])
        near &= side == 1 if crossed else np.arange(len(nodes)) > i
        if forest:
            at = np.flatnonzero(near)
            met, first = np.unique(comps[at], return_index=True)
            comps = np.where(np.isin(comps, met), comps[i], comps)
            near = np.zeros(len(nodes), bool)
            near[at[first]] = True
        out_a.append(np.full(near.sum(), nodes[i]))
        out_b.append(nodes[near])
    join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    return pa.table({"a": join(out_a), "b": join(out_b)})


def _pairs_in_blocks(members: DataFrame, sets: DataFrame, share: int, forest: bool) -> DataFrame:
    """Pairs (a, b) among the members (gid, node, component) of each group that may be alike.

    A group of up to BLOCK members is one block. A larger one is cut into blocks, each of which meets each other one
    in a task of its own; what travels is 16 bits an element.
    """
    group = Window.partitionBy("gid")
    place = F.row_number().over(group.orderBy("node")) - 1
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks"))).alias("_other")
    bits = sets.select("node", F.transform("hashes", lambda h: F.shiftright(h, 48).cast("short")).alias("bits"))
    spread = (
        members.withColumn("_own", F.floor(place / BLOCK).cast("int"))
        .withColumn("_blocks", F.max("_own").over(group))
        .select("gid", "node", "component", "_own", other)
        .select(
            "gid",
            "node",
            "component",
            F.least("_own", "_other").alias("_low"),
            F.greatest("_own", "_other").alias("_high"),
            (F.col("_own") > F.col("_other")).cast("int").alias("side"),
        )
        .join(bits, "node")
    )
    return spread.groupBy("gid", "_low", "_high").applyInArrow(lambda t: _near_pairs(t, share, forest), "a long, b long").distinct()


def linked(
    docs: DataFrame, width: int = 4, share: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, text_hash, n, component, component_id) of every row of docs, as a written table.

    `component` names a component apart from ids, which may repeat; it is null for texts without words. See classes().
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    sets = written(rows.mapInArrow(_sets(width), "id long, text_hash long, n long, hi long, lo long"), "join-sets", TEXT_ROWS)
    distinct = sets.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("rep"))
    often = rows.select("_text").sample(SAMPLE, 11).mapInArrow(_sampled(width), "h long, n long")
    often = written(often.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT), "join-frequent", TEXT_ROWS)
    frequent = bit_filter(often.select(F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("slot")), FILTER_BITS)
    discard(often)
    shared = written(
        rows.select("_text")
        .mapInArrow(_signed(width, share, frequent), "sig long, lo long")
        .repartition(partitions(spark), "sig")
        .sortWithinPartitions("sig", "lo")
        .mapInArrow(_shared, "gid long, lo long")
        .distinct(),
        "join-shared",
        2 * TEXT_ROWS,
    )
    nodes = written(
        distinct.join(shared.select("lo").distinct(), "lo", "left_semi").withColumn("node", F.monotonically_increasing_id()),
        "join-nodes",
    )
    members = written(shared.join(nodes.select("lo", "node"), "lo").select("gid", "node"), "join-members")
    discard(shared)
    wanted = _id_filter(nodes.select(F.coalesce("rep", F.lit(0)).alias("_id")))
    slot = F.pmod(F.xxhash64(F.coalesce("_id", F.lit(0))), F.lit(FILTER_BITS)).alias("_slot")
    whole = rows.select(slot, "_text").mapInArrow(_hashes(width, wanted), "hi long, lo long, hashes array<long>")
    whole = written(whole.join(nodes.select("hi", "lo", "node"), ["hi", "lo"]).select("node", "hashes"), "join-hashes", TEXT_ROWS)

    # groups with the same first node are one: most of their nodes are the same
    members_of_signatures = members
    firsts = members.groupBy(F.col("gid").alias("_gid")).agg(F.min("node").alias("first"))
    members = members.join(firsts, F.col("gid") == F.col("_gid")).select(F.col("first").alias("gid"), "node").distinct()
    members, ungrouped = written(members, "join-groups"), members_of_signatures
    discard(ungrouped)
    alone = members.withColumn("component", F.col("node"))
    near = written(_pairs_in_blocks(alone, whole, share, True), "join-near")
    links = written(_verified(near, whole, share), "join-links", TEXT_ROWS)
    discard(near)
    found = written(components(links, "join-components"), "join-found")
    group = Window.partitionBy("gid")
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = placed.withColumn("_min", F.min("component").over(group)).withColumn("_max", F.max("component").over(group))
    mixed = ends.where("_min <> _max").select("gid", "node", "component")
    near = written(_pairs_in_blocks(mixed, whole, share, False), "join-near")
    more = written(_verified(near, whole, share), "join-links", TEXT_ROWS)
    discard(near, whole, members, found)
    found = written(components(links.unionAll(more), "join-components"), "join-found")
    discard(links, more)
    labelled = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("least"))
    of_set = labelled.join(least, "component").select("hi", "lo", "least", F.col("component").cast("string").alias("component"))
    named = distinct.join(of_set, ["hi", "lo"], "left").select(
        F.col("hi").alias("_hi"),
        F.col("lo").alias("_lo"),
        F.coalesce("component", F.concat_ws(":", "hi", "lo")).alias("component"),
        F.coalesce("least", "rep").alias("component_id"),
    )
    out = sets.join(named, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")), "left").select(
        "id",
        "text_hash",
        "n",
        "component",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )
    result = written(out, "join-classes")
    discard(sets, nodes, found)
    return result


def classes(
    docs: DataFrame, width: int = 4, share: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) of every row of docs.

    A text's set is its distinct shingles of `width` words, A-Z lower-cased. Two texts link when 100 * common >=
    share * union; component_id is the least id that links reach. Equal texts are one node whatever their number.

    Null text, and text without words, has an empty set, links with nothing and is its own component. Null ids
    are never a component's id unless it has no other. Repeated rows are copies. An empty table gives no rows.
    Other columns are not looked at.
    """
    found = linked(docs, width, share, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
