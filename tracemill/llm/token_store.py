"""Token ids of a corpus, bit-packed in blocks of whole documents.

A store is a Parquet folder, so any file system Spark reaches will do. One row is one block:

    shard, block   place of the block; shards follow one another in ascending document id
    first, n       number of ids before it within its shard, and in it
    bits           width of one id
    doc_ids        the documents of the block, in order
    offsets        where each of them starts within the block
    payload        groups of 64 ids, each as `bits` little-endian 64-bit words

Offsets and the fixed width give random access: an id's place follows from its index, and only the blocks that
hold it are read (columns shard and first prune row groups).
"""

from __future__ import annotations

import json
import os
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import ordered_bucket, partitions, worker_state
from tracemill.session import run_folder

#: A block is closed by the document with which it reaches so many ids.
BLOCK_IDS = 1 << 16
#: Characters that are encoded at a time.
SLICE_BYTES = 4 << 20
#: Words whose ids a worker keeps; beyond that it starts anew.
KEPT_WORDS = 800_000
#: Steps of a tokenizer that leave words of LETTERS as they are and part them from SIGNS after them.
NORMALIZED = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
END_OF_WORD = "</w>"
#: Lower-case letters that stand for themselves in NFC, and the printable ASCII that is no letter, digit or apostrophe.
LETTERS, SIGNS = "a-z\u00df-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"

STORE = (
    "shard int, block int, first long, n long, bits int, doc_ids array<long>, offsets array<long>, payload binary"
)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, in groups of 64."""
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[: len(ids)] = ids
    rows = padded.reshape(groups, 64)
    words = np.zeros((groups, bits), np.uint64)
    for j in range(64):
        word, low = divmod(j * bits, 64)
        words[:, word] |= rows[:, j] << np.uint64(low)
        if low + bits > 64:
            words[:, word + 1] |= rows[:, j] >> np.uint64(64 - low)
    return words.astype("<u8", copy=False).tobytes()


def unpack(payload: bytes, n: int, bits: int, start: int = 0) -> np.ndarray:
    """n ids from index start on; only the groups that hold them are touched."""
    skip, stop = start // 64, -(-(start + n) // 64)
    words = np.frombuffer(payload, "<u8", (stop - skip) * bits, skip * bits * 8).reshape(-1, bits)
    ids = np.empty((stop - skip, 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, low = divmod(j * bits, 64)
        value = words[:, word] >> np.uint64(low)
        if low + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - low))
        ids[:, j] = value & mask
    return ids.reshape(-1)[start - skip * 64 :][:n]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of pieces of a flat array, one piece after the other."""
    stops = np.cumsum(sizes)
    return np.repeat(starts - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)


class _Encoder:
    """Encodes texts by the pieces of their words.

    The tokenizer drops white space and lower-cases, so no token spans two words and the ids of a text are those of
    its words; a worker encodes each distinct piece once. A piece is a word, or its letters and the signs after them
    where the tokenizer is known to part them. A text with a special token's opening goes in whole.
    """

    def __init__(self, path: str, specials: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on every core already
        self.tokenizer, self.specials = Tokenizer.from_file(path), specials
        self.letters = self._of_letters(path)
        self._start_anew()

    def _start_anew(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _of_letters(self, path: str):
        """The tokenizer without the steps that leave words of LETTERS as they are, or None if it may have others."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

        own = json.loads(self.tokenizer.to_str())
        if (own["normalizer"], own["pre_tokenizer"]) != (NORMALIZED, SPLIT) or own["model"].get("end_of_word_suffix") != END_OF_WORD:
            return None
        out = Tokenizer.from_file(path)
        out.normalizer = None
        out.pre_tokenizer = Sequence([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = out.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids with which a word ends
        self.ends[[i for token, i in vocabulary.items() if token.endswith(END_OF_WORD)]] = True
        return out

    def _encode_each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Their ids one after the other, and the number of each one's."""
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for at in range(0, len(texts), 20_000):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32, sizes[-1].sum()))
        return np.concatenate(ids), np.concatenate(sizes)

    def _encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _encode_each for words of LETTERS: many of them as one text, parted by the ids that end a word."""
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for at in range(0, len(words), 1_000):
            part = words[at : at + 1_000]
            got = np.array(self.letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[got]) + 1
            if len(stops) != len(part):  # a vocabulary that lacks letters at the end of a word
                got, each = self._encode_each(part)
            else:
                each = np.diff(stops, prepend=0)
            sizes.append(each)
            ids.append(got)
        return np.concatenate(ids), np.concatenate(sizes)

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where each of distinct pieces is among those the worker has, the new ones encoded first."""
        names = pieces.to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(found < 0)
        if len(new) and len(self.place) + len(new) > KEPT_WORDS:
            self._start_anew()
            new = np.arange(len(names))
        if len(new):
            plain = np.zeros(len(new), bool)
            if self.letters:
                plain = np.asarray(pc.match_substring_regex(pieces.take(pa.array(new)), f"^[{LETTERS}]+$"))
            for part, encode in ((new[plain], self._encode_letters), (new[~plain], self._encode_each)):
                if not len(part):
                    continue
                words, first = [names[i] for i in part], len(self.place)
                ids, sizes = encode(words)
                self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
                self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
                self.place.update(zip(words, range(first, first + len(words)), strict=True))
                found[part] = np.arange(first, first + len(words))
        return found

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one after the other, and the number of each one's."""
        if self.letters:
            cut = pc.extract_regex(words, f"^(?P<letters>[{LETTERS}]+)(?P<signs>[{SIGNS}]+)$")
            letters = pc.coalesce(pc.struct_field(cut, [0]), words)
            signs = pc.fill_null(pc.struct_field(cut, [1]), "")
            pieces = pa.chunked_array([letters, signs]).combine_chunks().dictionary_encode()
        else:
            pieces = words.dictionary_encode()
        place = self._places(pieces.dictionary)[np.asarray(pieces.indices)]
        place = place.reshape(-1, len(words)).T  # letters and signs of a word side by side
        sizes = self.sizes[place]
        return self.ids[_spread(self.starts[place].ravel(), sizes.ravel())], sizes.sum(axis=1)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id after each text, and their number for each text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")  # splitting goes wrong on slices of large_string
        odd = pc.match_substring(texts, self.specials)
        plain = pc.if_else(odd, "", texts) if pc.any(odd).as_py() else texts
        words = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        stops = np.asarray(words.offsets)[1:]
        coded = words.flatten().dictionary_encode()
        store, sizes = np.array([end_id], np.uint32), np.ones(1, np.int64)  # the end is one more word
        if len(coded.dictionary):
            ids, own = self._of_words(coded.dictionary)
            store, sizes = np.concatenate([ids, store]), np.concatenate([own, sizes])
        code = np.insert(np.asarray(coded.indices), stops, len(sizes) - 1)
        each = sizes[code]
        ids = store[_spread((np.cumsum(sizes) - sizes)[code], each)]
        upto = np.concatenate(([0], np.cumsum(each)))
        counts = np.diff(upto[stops + np.arange(1, len(stops) + 1)], prepend=0)
        if plain is not texts:
            cut = np.split(ids, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(np.asarray(odd)):
                own = self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids
                cut[i] = np.array([*own, end_id], np.uint32)
            counts, ids = np.array([len(x) for x in cut]), np.concatenate(cut)
        return ids, counts


def _encoder(path: str, specials: str) -> _Encoder:
    """The worker's own encoder: it outlives a task."""
    home = worker_state()
    if getattr(home, "encoder_path", None) != path:
        home.encoder_path, home.encoder = path, _Encoder(path, specials)
    return home.encoder


def _slices(batch: pa.RecordBatch):
    texts = batch.column("_text")
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
    cuts = np.searchsorted(size, np.arange(0, size[-1] if len(size) else 0, SLICE_BYTES)[1:], "right")
    edges = sorted({0, *cuts.tolist(), batch.num_rows})
    return [batch.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _writer(path: str, bits: int, end_id: int, specials: str):
    schema = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("bits", pa.int32())]
        + [("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())]
    )

    def run(batches):
        shard, block, first, ids, docs, offsets, held = None, 0, 0, [], [], [], 0

        def close():
            nonlocal block, first, ids, docs, offsets, held
            row = [shard, block, first, held, bits, docs, offsets, pack(np.concatenate(ids), bits)]
            block, first = block + 1, first + held
            ids, docs, offsets, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for part in _slices(batch):
                encoder = _encoder(path, specials)
                flat, counts = encoder.encode(part.column("_text"), end_id)
                stop = np.cumsum(counts)
                rows = zip(part.column("_shard").to_pylist(), part.column("_id").to_pylist(), stop - counts, stop, strict=True)
                for at, doc, a, b in rows:
                    if at != shard:
                        if docs:
                            yield close()
                        shard, block, first = at, 0, 0
                    docs.append(doc)
                    offsets.append(held)
                    ids.append(flat[a:b])
                    held += int(b - a)
                    if held >= BLOCK_IDS:
                        yield close()
        if docs:
            yield close()

    return run


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    vocabulary: int,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    specials: str = "<|",
) -> None:
    """Encode every text and write the store, documents in ascending id (null first, equal ids by text).

    The ids take the fewest bits that hold vocabulary - 1. Null text counts as empty, that is, the end id alone.
    Repeated rows are repeated documents; an empty table gives an empty store. Other columns are not looked at.
    A task sorts its shards on disk and holds one slice of texts and one open block.
    """
    bits = max(1, int(max(vocabulary - 1, end_id)).bit_length())
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    n = partitions(docs.sparkSession)
    shard = ordered_bucket(rows.select("_id"), "_id", 4 * n).alias("_shard")
    (
        rows.select(shard, "_id", "_text")
        .repartition(n, "_shard")
        .sortWithinPartitions("_shard", "_id", "_text")
        .mapInArrow(_writer(tokenizer_path, bits, end_id, specials), STORE)
        .write.parquet(folder)
    )


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with `start`, the number of ids before them in the whole store; one row a shard meets in one task."""
    blocks = spark.read.schema(STORE).parquet(folder)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (
        blocks.groupBy("shard")
        .agg(F.max(F.col("first") + F.col("n")).alias("ids"))
        .select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("_before"))
    )
    return blocks.join(F.broadcast(shards), "shard").withColumn("start", F.col("_before") + F.col("first"))


def _digest(batches):
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            ids = unpack(r["payload"], r["n"], r["bits"]).astype("<u4", copy=False)
            edges = [*r["offsets"], r["n"]]
            for doc, a, b in zip(r["doc_ids"], edges, edges[1:], strict=False):
                rows.append((doc, r["start"] + a, b - a, zlib.crc32(ids[a:b].tobytes())))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the store."""
    fields = ["start", "n", "bits", "doc_ids", "offsets", "payload"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return _placed(spark, folder).select(*fields).mapInArrow(_digest, schema)


def read_ids(spark: SparkSession, folder: str, start: int, n: int) -> np.ndarray:
    """n ids from place start of the whole store on: a window that is given, not the store."""
    hit = _placed(spark, folder).where((F.col("start") < start + n) & (F.col("start") + F.col("n") > start))
    parts = []
    for r in hit.select("start", "n", "bits", "payload").orderBy("start").toLocalIterator():
        a, b = max(start, r.start) - r.start, min(start + n, r.start + r.n) - r.start
        parts.append(unpack(r.payload, b - a, r.bits, a))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def stored_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Digests of docs after writing them with the word-level tokenizer and reading the store back."""
    import public_tokenizers

    folder = run_folder(spark, "tokens")
    write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408, end_id=2)
    return digests(spark, folder)
