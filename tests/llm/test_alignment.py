"""Alignment of two tokenizers against whole texts encoded at once and counted in loops."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.fixtures import documents, frame, prose
from tracemill.llm import alignment
from tracemill.llm.queries import LLM_REGISTRY

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def slow(texts):
    """The contract's columns of every text, by encoding it whole."""
    path_a, path_b = alignment.public_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    name = {i: n for n, i in a.get_vocab().items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in shown}
    letters |= {chr(256 + i): c for i, c in enumerate(x for x in range(256) if x not in shown)}
    out, counts = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in name[i]) for i in ids_a]
        bytes_b = [bytes([i - 3]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append(None)
            continue
        ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (bytes_a, bytes_b)]
        groups, at_a, at_b, i, j = [], 0, 0, 0, 0
        for cut in sorted(ends[0] & ends[1]):
            left, right = [], []
            while at_a < cut:
                left.append(ids_a[i])
                at_a += len(bytes_a[i])
                i += 1
            while at_b < cut:
                right.append(ids_b[j])
                at_b += len(bytes_b[j])
                j += 1
            groups.append((left, right))
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        counts.update(links.keys())
        out.append((len(ids_a), len(ids_b), groups, links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    rows = []
    for one in out:
        if one is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = one
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        n_best = sum(t for p, t in links.items() if counts[p] == best[p[0]])
        total = sum(t * counts[p] for p, t in links.items())
        digest = hashlib.sha256(text.encode()).hexdigest()
        rows.append((n_a, n_b, len(groups), sum(links.values()), n_best, total, digest))
    return rows


ODD = [
    "a  b", "a\nb ", " x", "<s> hi </s>", "a\x00b", "▁", "x ▁ y", "  ", " ", "\n", "\n\n x\n", "x　y z", "<|endoftext|> is text",
    "<0x41>", "a ́b", "tab\there\x0b \n  more", "end.\x1c next", "é" * 50, "=" * 300, "日本語のテキスト", "🙂 🙃🙂", "x  y  z",
    "one\r\ntwo \r\n three", "don't we'll I'M", "a" * 5000, "don 't", "�", "  lead and trail  ",
]


def check(docs, rows):
    got = alignment.align(docs, *alignment.public_paths()).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = [(i, *r) for (i, _), r in zip(rows, slow([t for _, t in rows]), strict=True)]
    assert sorted((tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in got), key=key) == sorted(want, key=key)


def test_against_whole_encodings(spark):
    rows = [(r[0], r[1]) for r in documents()] + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, prose(5, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs.withColumn("chunk", F.lit(1)).withColumn("pos", F.lit(2)).withColumn("pair", F.lit("x")), rows)
    assert alignment.align(frame(spark, []), *alignment.public_paths()).count() == 0


def test_query_against_whole_encodings(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    check(docs, [tuple(r) for r in docs.collect()])
    got = LLM_REGISTRY["op13_alignment"].run(spark, sf_dir)
    assert set(got.columns) == {"doc_id", *COLUMNS}


def test_small_chunks_and_little_memory(spark, monkeypatch):
    """Chunks, parts and kept units end in the middle of a task; results stay."""
    for name, value in (("KEPT_UNITS", 40), ("SLICE_CHARS", 300), ("PART_UNITS", 60), ("CHUNK_DOCS", 5), ("CHUNK_POSTINGS", 2000)):
        monkeypatch.setattr(alignment, name, value)
    rows = [(i, prose(i % 9, 30 + i)) for i in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rows)


def test_postings_round_trip():
    rng = np.random.default_rng(3)
    n_docs = 3000
    rows = [(p, d, int(rng.geometric(0.4))) for p, n in ((7, 1), (9, 2900), (2**35, 40), (2**36, 400)) for d in sorted(rng.choice(n_docs, n, replace=False))]
    pair, pos, times = (np.array(x) for x in zip(*rows, strict=True))
    seen = []
    for pairs, n, docs, planes in alignment.encode_postings(pair, pos, times, n_docs):
        assert pa.compute.max(pa.compute.binary_length(docs)).as_py() <= 375
        row, at, many = alignment.decode_postings(n, docs, planes)
        seen += list(zip(pairs[row].tolist(), at.tolist(), many.tolist(), strict=True))
    assert sorted(seen) == sorted((int(a), int(b), c) for a, b, c in rows)


def test_pair_counts(spark):
    docs = spark.createDataFrame([(1, "the house"), (2, "the house the house"), (3, "green")], "doc_id long, text string")
    counts = {r.pair: r["count"] for r in alignment.pair_counts(alignment.build(docs, *alignment.public_paths())).collect()}
    assert max(counts.values()) == 2 and min(counts.values()) == 1
