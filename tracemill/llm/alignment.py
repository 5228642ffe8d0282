"""Tokens of two tokenizers that stand for the same bytes, counted by inverted pair bitmaps.

A text is encoded twice. Where tokens of both end at the same byte it is cut into groups, and every token of one side
links with every token of the other in its group. A posting is one pair of ids in one chunk of documents: the places
of the documents that hold the pair, as a sorted list or as a bitmap, whichever is smaller, and the multiplicities of
its links as planes of bits over these documents. Bitmaps of parts of a chunk are OR-merged. The number of documents
of a pair is the sum of the set bits of its postings; with the counts, the postings of a chunk return its documents'
scores.

Neither tokenizer has a token across a visible character that is followed by a space or a line end, so a text is cut
there into units; what a unit gives is worked out once for all that have it.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import drop_worker_state, partitions, worker_state, written

#: Units whose alignment a worker keeps; beyond that it starts anew.
KEPT_UNITS = 400_000
#: Texts that are encoded at a time, in characters; units of a part of a chunk; postings and documents of a chunk.
SLICE_CHARS, PART_UNITS, CHUNK_POSTINGS, CHUNK_DOCS = 2 << 20, 300_000, 1_500_000, 32_768
#: Documents that are encoded at a time; places in a chunk have 16 bits.
SLICE_DOCS = 16_384

#: Bits of an id in a pair: vocabularies have at most a million entries.
ID_BITS = 20

ROWS = (
    "chunk long, pos int, id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "pair long, n int, docs binary, planes binary, top int"
)
_CUTS = re.compile(r"(?<=\S)(?=[ \n])")
_NO_IDS = np.zeros(0, np.int64)


def _byte_of_char() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: visible ones as they are, others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Bytes:
    """Bytes of the entries of a vocabulary, one after the other."""

    def __init__(self, entries: list[bytes]):
        self.size = np.fromiter(map(len, entries), np.int64, len(entries))
        self.start = np.cumsum(self.size) - self.size
        self.all = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.all[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Tokenizers:
    """A: a byte-level vocabulary; B: pieces with byte fallback, which put a space before the text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = _byte_of_char()
        names = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda entry: entry[1])
        entries = [b""] * (names[-1][1] + 1)
        for name, i in names:
            if all(c in letters for c in name):
                entries[i] = bytes(letters[c] for c in name)
        self.bytes_a = _Bytes(entries)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = _Bytes(
            [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        )
        self.lead = len(self.b.encode("a", num_threads=1))

    def encode_a(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(strings, add_special_tokens=False)]

    def encode_b(self, units: list[str]) -> list[list[int]]:
        """Ids of units as they stand in a text; one that doesn't begin with a space is read behind a letter."""
        plain = [u[1:] if u.startswith(" ") and len(u) > 1 else "a" + u for u in units]
        got = self.b.encode(plain, num_threads=1)
        return [ids if u.startswith(" ") and len(u) > 1 else ids[self.lead :] for u, ids in zip(units, got, strict=True)]


class Aligned:
    """What units give, each at its number: sizes, the groups as text, and the pairs with their multiplicities."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.number: dict[str | tuple[str], int] = {}
        self.groups: list[str] = []
        self.valid = np.zeros(0, bool)
        self.sizes = np.zeros((0, 4), np.int64)
        self.pair_start, self.pairs, self.times = np.zeros(1, np.int64), _NO_IDS, _NO_IDS

    def numbers(self, units: list) -> np.ndarray:
        """Number of every unit, -1 where a text has to be cut with care; see units_of."""
        new = []
        for u in set(units) - self.number.keys():
            if u and (isinstance(u, tuple) or not u[-1].isspace()):
                new.append(u)
            else:
                self.number[u] = -1
        for at in range(0, len(new), 50_000):
            self._add(new[at : at + 50_000])
        return np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))

    def _add(self, units: list) -> None:
        t = self.tokenizers
        whole = [u[0] if isinstance(u, tuple) else u if u[0] == "\n" else " " + u for u in units]
        a, b = t.encode_a(whole), t.encode_b(whole)
        raw = [w.encode() for w in whole]
        (ids_a, n_a), (ids_b, n_b) = _chained(a), _chained(b)
        ok = self._same(raw, ids_a, n_a, t.bytes_a) & self._same(raw, ids_b, n_b, t.bytes_b)
        first = len(self.groups)
        self.number.update((u, first + i) for i, u in enumerate(units))
        self.valid = np.r_[self.valid, ok]
        ids_a, ids_b = ids_a[np.repeat(ok, n_a)], ids_b[np.repeat(ok, n_b)]
        n_a, n_b = n_a * ok, n_b * ok
        # all units one after the other: both sides have the same bytes, so ends can be compared over all of them
        end_a, end_b = np.cumsum(t.bytes_a.size[ids_a]), np.cumsum(t.bytes_b.size[ids_b])
        cuts = end_a[end_b[np.searchsorted(end_b, end_a)] == end_a]
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        unit_of_group = np.zeros(len(cuts), np.int64)
        unit_of_group[group_a] = np.repeat(np.arange(len(units)), n_a)
        n_groups = np.bincount(unit_of_group, minlength=len(units))
        in_a, in_b = (np.bincount(g, minlength=len(cuts)) for g in (group_a, group_b))
        n_links = np.zeros(len(units), np.int64)
        np.add.at(n_links, unit_of_group, in_a * in_b)
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, n_groups, n_links], axis=1)])
        self._texts(ids_a, ids_b, group_a, group_b, n_groups)
        self._links(ids_a, ids_b, group_a, group_b, unit_of_group, len(units))

    @staticmethod
    def _same(raw: list[bytes], ids: np.ndarray, n: np.ndarray, entries: _Bytes) -> np.ndarray:
        """Which units' tokens join to their bytes."""
        unit = np.repeat(np.arange(len(n)), n)
        size = np.zeros(len(raw), np.int64)
        np.add.at(size, unit, entries.size[ids])
        want = np.fromiter(map(len, raw), np.int64, len(raw))
        ok = size == want
        own = np.frombuffer(b"".join(r for r, good in zip(raw, ok, strict=True) if good), np.uint8)
        differs = own != entries.joined(ids[ok[unit]])
        ok[np.repeat(np.flatnonzero(ok), want[ok])[differs]] = False
        return ok

    def _texts(self, ids_a, ids_b, group_a, group_b, n_groups) -> None:
        """`a1,a2|b1;a3|b2,b3` of every unit."""
        side = np.r_[np.zeros(len(ids_a), np.int64), np.ones(len(ids_b), np.int64)]
        order = np.lexsort((np.r_[np.arange(len(ids_a)), np.arange(len(ids_b))], side, np.r_[group_a, group_b]))
        ids, side, group = np.r_[ids_a, ids_b][order], side[order], np.r_[group_a, group_b][order]
        last = np.r_[group[1:] != group[:-1], True] if len(group) else np.zeros(0, bool)
        turn = np.r_[side[1:] != side[:-1], True] & ~last if len(group) else last
        marks = np.where(last, ";", np.where(turn, "|", ","))
        pieces = [f"{i}{m}" for i, m in zip(ids.tolist(), marks.tolist(), strict=True)]
        stops = np.flatnonzero(last) + 1  # of groups
        upto = np.r_[0, stops][np.r_[0, np.cumsum(n_groups)]].tolist()
        self.groups += ["".join(pieces[x:y])[:-1] for x, y in zip(upto, upto[1:], strict=False)]

    def _links(self, ids_a, ids_b, group_a, group_b, unit_of_group, n_units: int) -> None:
        """Distinct pairs of every unit: a << 20 | b, and how many links it has."""
        (ga, a, ca), (gb, b, cb) = _counted(group_a, ids_a), _counted(group_b, ids_b)
        first = np.searchsorted(gb, ga)
        each = np.searchsorted(gb, ga, "right") - first
        left = np.repeat(np.arange(len(ga)), each)
        right = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)
        unit, pair, times = _summed(unit_of_group[ga[left]], a[left] << ID_BITS | b[right], ca[left] * cb[right])
        self.pair_start = np.r_[self.pair_start, self.pair_start[-1] + np.cumsum(np.bincount(unit, minlength=n_units))]
        self.pairs, self.times = np.r_[self.pairs, pair], np.r_[self.times, times]


def _chained(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All values one after the other, and how many each list has."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, n.sum()), n


def _keys(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, int]:
    """one and two as a single number each, and the bits that two takes."""
    bits = int(two.max(initial=0)).bit_length()
    if int(one.max(initial=0)).bit_length() + bits > 63:
        raise OverflowError("numbers too large to be paired")
    return one << bits | two, bits


def _summed(one: np.ndarray, two: np.ndarray, n: np.ndarray):
    """Distinct (one, two) in order, with the sum of n."""
    key, bits = _keys(one, two)
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    key = key[starts]
    return key >> bits, key & ((1 << bits) - 1), np.add.reduceat(n[order], starts) if len(starts) else n


def _counted(one: np.ndarray, two: np.ndarray):
    """Distinct (one, two) in order, with their number."""
    key, bits = _keys(one, two)
    key, n = np.unique(key, return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), n


def units_of(text: str, careful: bool = False) -> list:
    """Units of the text with a space before it.

    Most texts fall apart at their spaces, and the space that begins a unit is left out. Where that gives an empty
    unit, or one that ends with white space, the text is cut with care: such units come with their space, as tuples.
    """
    if careful:
        return [(u,) for u in _CUTS.split(" " + text)]
    return text.replace("\n", " \n").split(" ")


# ---- postings ------------------------------------------------------------------------------------------------------


def encode_postings(pair: np.ndarray, pos: np.ndarray, times: np.ndarray, n_docs: int):
    """Batches of (pair, n, docs, planes) of rows sorted by (pair, pos), each pair with distinct places below n_docs."""
    new = np.r_[True, pair[1:] != pair[:-1]]
    starts = np.flatnonzero(new)
    n = np.diff(np.r_[starts, len(pair)])
    row = np.cumsum(new) - 1
    rank = np.arange(len(pair)) - starts[row]
    width = -(-n_docs // 8)
    # planes: of one link less than there are, for most pairs none
    more = times - 1
    tops = np.maximum.reduceat(more, starts)
    n_planes = np.zeros(len(starts), np.int64)
    while (tops > 0).any():
        n_planes += tops > 0
        tops = tops >> 1
    plane_size = n_planes * -(-n // 8)
    plane_start = np.cumsum(plane_size) - plane_size
    planes = np.zeros(plane_size.sum(), np.uint8)
    for p in range(int(n_planes.max())):
        at = np.flatnonzero((more >> p) & 1)
        byte = plane_start[row[at]] + p * -(-n[row[at]] // 8) + rank[at] // 8
        np.bitwise_or.at(planes, byte, (1 << (rank[at] % 8)).astype(np.uint8))
    dense = 2 * n > width
    for kind in (False, True):
        rows = np.flatnonzero(dense == kind)
        for part in np.array_split(rows, max(1, -(-len(rows) // 20_000))):
            if not len(part):
                continue
            mine = np.zeros(len(starts), bool)
            mine[part] = True
            at = np.flatnonzero(mine[row])
            if kind:
                bits = np.zeros((len(part), width * 8), np.uint8)
                bits[np.repeat(np.arange(len(part)), n[part]), pos[at]] = 1
                data, size = np.packbits(bits, axis=1, bitorder="little").reshape(-1), np.full(len(part), width)
            else:
                data, size = pos[at].astype("<u2").view(np.uint8), 2 * n[part]
            plane_at = np.repeat(plane_start[part] - np.cumsum(plane_size[part]) + plane_size[part], plane_size[part])
            yield (
                pair[starts[part]],
                n[part],
                _binary(data, size),
                _binary(planes[plane_at + np.arange(len(plane_at))], plane_size[part]),
            )


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and where its rows start in them."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, offsets


def decode_postings(n: np.ndarray, docs: pa.Array, planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pos, times) of postings: which row, the document's place, and how many links it has there."""
    data, offsets = _flat(docs)
    size = np.diff(offsets)
    sparse = size == 2 * n
    out = []
    rows = np.flatnonzero(sparse)
    at = np.repeat(offsets[:-1][rows] - np.cumsum(size[rows]) + size[rows], size[rows]) + np.arange(size[rows].sum())
    out.append((np.repeat(rows, n[rows]), np.ascontiguousarray(data[at]).view("<u2").astype(np.int64)))
    for r in np.flatnonzero(~sparse):
        found = np.flatnonzero(np.unpackbits(data[offsets[r] : offsets[r + 1]], bitorder="little"))
        out.append((np.full(len(found), r), found))
    row, pos = (np.concatenate([o[i] for o in out]) for i in (0, 1))
    order = np.argsort(row, kind="stable")
    row, pos = row[order], pos[order]
    rank = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    bits, starts = _flat(planes)
    stride = -(-n // 8)
    count = np.diff(starts) // np.maximum(stride, 1)
    times = np.ones(len(row), np.int64)
    for p in range(int(count.max()) if len(count) else 0):
        at = np.flatnonzero(count[row] > p)
        byte = bits[starts[:-1][row[at]] + p * stride[row[at]] + rank[at] // 8]
        times[at] += ((byte >> (rank[at] % 8).astype(np.uint8)) & 1).astype(np.int64) << p
    return row, pos, times


def _worker(path_a: str, path_b: str) -> Aligned:
    """The tokenizers and units of this worker, kept between tasks."""
    state = worker_state()
    if getattr(state, "alignment", None) != (path_a, path_b):
        state.alignment, state.aligned = (path_a, path_b), Aligned(Tokenizers(path_a, path_b))
    return state.aligned


class _Chunk:
    """Postings and documents of a part of a task's rows, at most CHUNK_DOCS."""

    def __init__(self):
        self.n_docs, self.n_postings, self.parts, self.doc, self.unit = 0, 0, [], [], []
        self.n_units = 0

    def close_part(self, known: Aligned) -> None:
        """Bitmaps of the pairs of this part: those of the units that hold a pair, with their links summed."""
        if self.doc:
            doc, unit, times = _counted(np.concatenate(self.doc), np.concatenate(self.unit))
            each = (known.pair_start[1:] - known.pair_start[:-1])[unit]
            at = np.repeat(known.pair_start[unit] - np.cumsum(each) + each, each) + np.arange(each.sum())
            pair, pos, times = _summed(known.pairs[at], np.repeat(doc, each), known.times[at] * np.repeat(times, each))
            if len(pair):
                self.parts.append((pair, pos.astype(np.int32), times.astype(np.int32)))
                self.n_postings += len(pair)
        self.doc, self.unit, self.n_units = [], [], 0

    def postings(self):
        """Parts are of different documents, one after the other: their bitmaps are merged pair by pair."""
        if self.parts:
            pair, pos, times = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
            order = np.argsort(pair, kind="stable")
            yield from encode_postings(pair[order], pos[order], times[order].astype(np.int64), self.n_docs)


def _aligned(path_a: str, path_b: str):
    """Rows of documents and of postings, told apart by `pos`."""
    schema = pa.schema(
        [(n, pa.int64()) for n in ("chunk", "id", "n_a", "n_b", "n_groups", "n_links", "pair")]
        + [("pos", pa.int32()), ("n", pa.int32()), ("top", pa.int32()), ("groups", pa.string())]
        + [("docs", pa.binary()), ("planes", pa.binary())]
    )
    names = [c.split(" ")[0] for c in ROWS.split(", ")]

    def batch_of(size: int, **columns) -> pa.RecordBatch:
        arrays = []
        for name in names:
            kind = schema.field(name).type
            value = columns.get(name)
            if value is None:
                arrays.append(pa.nulls(size, kind))
            else:
                arrays.append(value if isinstance(value, pa.Array) else pa.array(value, kind))
        return pa.RecordBatch.from_arrays(arrays, names)

    def close(chunk: _Chunk, number: int, known: Aligned):
        chunk.close_part(known)
        for pair, n, docs, planes in chunk.postings():
            yield batch_of(len(pair), chunk=np.full(len(pair), number), pair=pair, n=n, docs=docs, planes=planes, top=np.full(len(pair), chunk.n_docs))

    def digest(ids: list[int], known: Aligned) -> str:
        return hashlib.sha256(";".join(map(known.groups.__getitem__, ids)).encode()).hexdigest()

    def run(batches):
        drop_worker_state(keeping="alignment")
        known = _worker(path_a, path_b)
        number, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in batches:
            ids, texts = batch.column("_id"), batch.column("_text").to_pylist()
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < min(len(texts), at + SLICE_DOCS) and (stop == at or chars + len(texts[stop] or "") <= SLICE_CHARS):
                    chars += len(texts[stop] or "")
                    stop += 1
                if len(known.groups) > KEPT_UNITS:
                    chunk.close_part(known)
                    known.clear()
                worker_state()  # in use
                split = [units_of(t) if t else [] for t in texts[at:stop]]
                flat = known.numbers(list(chain.from_iterable(split)))
                each = np.fromiter(map(len, split), np.int64, len(split))
                doc = np.repeat(np.arange(len(split)), each)
                if (odd := np.unique(doc[flat < 0])).size:
                    for i in odd.tolist():
                        split[i] = units_of(texts[at + i], careful=True)
                    flat = known.numbers(list(chain.from_iterable(split)))
                    each = np.fromiter(map(len, split), np.int64, len(split))
                    doc = np.repeat(np.arange(len(split)), each)
                if not (good := known.valid[flat]).all():
                    each[doc[~good]] = 0
                    flat = flat[each[doc] > 0]
                    doc = np.repeat(np.arange(len(split)), each)
                ends = np.cumsum(each).tolist()
                coded = flat.tolist()
                coded = [coded[x:y] for x, y in zip([0, *ends], ends, strict=False)]
                sizes = np.zeros((len(coded), 4), np.int64)
                np.add.at(sizes, doc, known.sizes[flat])
                chunk.doc.append(doc + chunk.n_docs)
                chunk.unit.append(flat)
                yield batch_of(
                    len(coded),
                    chunk=np.full(len(coded), number),
                    pos=chunk.n_docs + np.arange(len(coded)),
                    id=ids.slice(at, stop - at),
                    groups=[digest(c, known) if c else "" for c in coded],
                    **dict(zip(("n_a", "n_b", "n_groups", "n_links"), sizes.T, strict=True)),
                )
                chunk.n_docs += len(coded)
                chunk.n_units += len(flat)
                if chunk.n_units >= PART_UNITS:
                    chunk.close_part(known)
                if chunk.n_postings >= CHUNK_POSTINGS or chunk.n_docs >= CHUNK_DOCS:
                    yield from close(chunk, number, known)
                    number, chunk = number + 1, _Chunk()
                at = stop
        yield from close(chunk, number, known)

    return run


def _scored(table: pa.Table) -> pa.Table:
    """Scores that the postings of one chunk return to its documents."""
    n = table.column("n").to_numpy().astype(np.int64)
    docs, planes = (pa.concat_arrays([c.cast(pa.large_binary()) for c in table.column(x).chunks]) for x in ("docs", "planes"))
    row, pos, times = decode_postings(n, docs, planes)
    count, best = table.column("count").to_numpy(), table.column("best").to_numpy()
    size = int(table.column("top")[0].as_py())
    total, n_best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    np.add.at(total, pos, times * count[row])
    np.add.at(n_best, pos, times * best[row])
    return pa.table(
        {
            "_chunk": pa.array(np.full(size, table.column("chunk")[0].as_py())),
            "_pos": pa.array(np.arange(size, dtype=np.int32)),
            "n_best": pa.array(n_best),
            "count_sum": pa.array(total),
        }
    )


def public_paths() -> tuple[str, str]:
    """Places of the public vocabularies of A and B."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def build(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents and postings of the corpus, as one written table; rows of documents have a `pos`."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return written(rows.mapInArrow(_aligned(path_a, path_b), ROWS), "aligned")


def pair_counts(built: DataFrame) -> DataFrame:
    """(pair, count): in how many documents every pair of ids is linked; a << 20 | b."""
    return built.where("pos IS NULL").groupBy("pair").agg(F.sum("n").alias("count"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs.

    A encodes a space and the text, B the text, before which it puts a space itself; strings of special tokens are
    plain text. A pair's count is the number of rows of docs that hold it linked; n_best counts the links whose count
    is the highest of their A id, ties included, count_sum adds the counts of all links.

    Text that is null, empty, or not what its tokens of either side join to has no tokens: zeros and ''. Repeated
    rows and ids are documents of their own. An empty table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    built = build(docs, path_a, path_b, id_col, text_col)
    counts = written(pair_counts(built).withColumn("a", F.shiftright("pair", ID_BITS)), "aligned-counts")
    # one row for each id of A's vocabulary at most
    highest = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("highest")))
    scored = counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
    postings = built.where("pos IS NULL").select("chunk", "pair", "n", "docs", "planes", "top")
    met = postings.join(scored, "pair").drop("pair").repartition(partitions(spark), "chunk")
    scores = met.groupBy("chunk").applyInArrow(_scored, "_chunk long, _pos int, n_best long, count_sum long")
    of_docs = built.where("pos IS NOT NULL").select("chunk", "pos", "id", "n_a", "n_b", "n_groups", "n_links", "groups")
    return of_docs.join(scores, (F.col("chunk") == F.col("_chunk")) & (F.col("pos") == F.col("_pos")), "left").select(
        F.col("id").alias(id_col),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
        F.col("groups").alias("groups_sha256"),
    )
