"""Benchmark items in texts, whole but for some edits.

An item with an error budget of k edits is split into k + 1 pieces, so wherever it occurs within the budget at
least one piece occurs exactly. Pieces are found with one automaton; from an exact piece, ever larger runs of
neighbouring pieces (j pieces with j - 1 errors) are verified with Myers' bit-parallel distance up to the item.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import drop_worker_state

#: Edits allowed, as a share of an item's code points.
RATE = 0.10
#: Items of fewer code points are matched without edits, and as whole words.
SHORT = 20
#: Bytes of items that one pass over the documents looks for; more items take more passes.
BLOCK_BYTES = 8 << 20

_MATCH = "item_id long, distance int, start long, end long"


def normalise(text: str | None) -> str:
    """Lower case, and one blank between words."""
    return " ".join((text or "").lower().split())


def masks(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def myers(bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least distance of the pattern to a part of text, end of the first such part)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = bits.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, at
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
    return best, end


class Item:
    """One test item, its pieces, and for every piece the runs of pieces above it."""

    def __init__(self, item_id: int, text: str, rate: float):
        self.id, self.text, self.short = item_id, text, len(text) < SHORT
        rate = 0 if self.short else rate
        pieces = int(len(text) * rate) + 1
        self.cuts = [len(text) * j // pieces for j in range(pieces + 1)]
        self.runs: list[list[tuple[int, int, int]]] = [[] for _ in range(pieces)]
        self._halve(0, pieces)
        self.bits: dict[tuple[int, int], dict[str, int]] = {}
        self.backward = masks(text[::-1])

    def _halve(self, a: int, b: int) -> None:
        if b - a > 1:
            mid = (a + b) // 2
            self._halve(a, mid)
            self._halve(mid, b)
            for piece in range(a, b):
                self.runs[piece].append((self.cuts[a], self.cuts[b], b - a - 1))

    def at(self, piece: int, text: str, pos: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the item around an exact piece at pos of text, if within the budget."""
        best, left, stop = 0, pos, pos + self.cuts[piece + 1] - self.cuts[piece]
        if self.short and any(c.isalnum() for c in (text[max(0, pos - 1) : pos], text[stop : stop + 1])):
            return None
        for a, b, budget in self.runs[piece]:
            bits = self.bits.get((a, b))
            if bits is None:
                bits = self.bits[a, b] = masks(self.text[a:b])
            left = max(0, pos - (self.cuts[piece] - a) - budget)
            best, end = myers(bits, b - a, text[left : pos + (b - self.cuts[piece]) + budget])
            if best > budget:
                return None
            stop = left + end
        if not self.runs[piece]:
            return 0, pos, stop
        _, back = myers(self.backward, len(self.text), text[left:stop][::-1])
        return best, stop - back, stop


class Finder:
    """Automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items = [Item(i, t, rate) for i, t in ((i, normalise(t)) for i, t in items) if t]
        held: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for piece, (a, b) in enumerate(zip(item.cuts, item.cuts[1:], strict=False)):
                held.setdefault(item.text[a:b], []).append((n, piece))
        self.automaton = ahocorasick.Automaton()
        for piece, where in held.items():
            self.automaton.add_word(piece, (len(piece), where))
        if held:
            self.automaton.make_automaton()
        self.empty = not held

    def matches(self, text: str | None, first_only: bool = False) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the best place of each item in the normalised text."""
        if self.empty:
            return []
        text, best, done = normalise(text), {}, {}
        for last, (size, where) in self.automaton.iter(text):
            pos = last - size + 1
            for n, piece in where:
                if pos < done.get(n, 0):  # within a place that is known
                    continue
                got = self.items[n].at(piece, text, pos)
                if got:
                    if first_only:
                        return [(self.items[n].id, *got)]
                    done[n] = got[2]
                    if n not in best or got < best[n]:
                        best[n] = got
        return sorted((self.items[n].id, *got) for n, got in best.items())


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES):
    """Items in blocks whose size is known to be small; each is one pass over the documents."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    blocks = -(-size // block_bytes)
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)
        yield [(r.i, r.t) for r in part.collect()]


def find_leaks(
    docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, item_id, distance, start, end): every document and item that occurs in it within its budget.

    The best place is returned, in code points of the normalised text (lower case, single blanks), end exclusive. Items
    of fewer than 20 code points have no budget: they match as they are, where no letter or digit adjoins.
    Null or empty texts and items match nothing. Repeated rows and repeated items with other ids are each
    returned. An empty table gives no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    found = []
    for block in item_blocks(items):

        def run(batches, block=block):
            finder = Finder(block, rate)
            for batch in batches:
                ids, out = batch.column("_id").to_pylist(), []
                for doc, text in zip(ids, batch.column("_text"), strict=True):
                    out += [(doc, *m) for m in finder.matches(text.as_py())]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    ["_id", "item_id", "distance", "start", "end"],
                )

        found.append(rows.mapInArrow(run, f"_id long, {_MATCH}"))
    if not found:
        return rows.where("false").selectExpr("_id", "0L AS item_id", "0 AS distance", "0L AS start", "0L AS end").withColumnRenamed("_id", id_col)
    return reduce(DataFrame.unionAll, found).withColumnRenamed("_id", id_col)


def drop_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text") -> DataFrame:
    """Rows of docs, as they are, in which no item occurs; see find_leaks for what occurs.

    Null and empty texts stay, repeated rows stay or go together, null ids are not looked at. An empty table gives no
    rows, without items every row stays. Columns of any name stay.
    """
    at = docs.columns.index(text_col)
    for block in item_blocks(items):

        def run(batches, block=block):
            drop_worker_state()
            finder = Finder(block, rate)
            for batch in batches:
                clean = [not finder.matches(t.as_py(), first_only=True) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
