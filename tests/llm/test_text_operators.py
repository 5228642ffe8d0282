"""Line dedup, token store, fingerprints, secrets and decontamination against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.fixtures import LINE, SCHEMA, documents, frame, prose, unique
from tracemill.llm import decontaminate, fingerprints, line_dedup, secrets, token_store
from tracemill.session import run_folder

WHITE = " \t\n\x0b\x0c\r"


def lower(text):
    return text.encode().lower().decode()


def test_lines(spark):
    holders = defaultdict(set)
    for i, text, *_ in documents():
        for line in (text or "").split("\n"):
            key = lower(line.strip(WHITE))
            if len(key) >= 40:
                holders[key].add(i)
    assert len(holders[lower(LINE)]) >= 5
    want = []
    for i, text, *_ in documents():
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(lower(x.strip(WHITE)), ())) < 5 or max(holders[lower(x.strip(WHITE))]) == i]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [tuple(r) for r in line_dedup.drop_shared_lines(frame(spark)).collect()]
    assert sorted(got) == sorted(want)


def test_lines_of_null_ids_and_no_rows(spark):
    rows = [(None if i == 0 else i, LINE, "en", "a", 1, 1, 1, "s", None) for i in range(6)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.drop_shared_lines(frame(spark, rows)).collect()}
    assert got == {None: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0}
    assert line_dedup.drop_shared_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = token_store.pack(ids, bits)
        assert len(data) == -(-n // 64) * bits * 8
        assert (token_store.unpack(data, n, bits) == ids).all()
        if n > 70:
            assert (token_store.unpack(data, 50, bits, 66) == ids[66:116]).all()


def test_token_store(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    folder = run_folder(spark, "test-tokens")
    token_store.write_tokens(frame(spark), folder, path, 49_408, 2)
    want, start, everything = [], 0, []
    for i, text, *_ in sorted(documents(), key=lambda r: (r[0], r[1] or "")):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        everything += ids
    assert sorted(tuple(r) for r in token_store.digests(spark, folder).collect()) == sorted(want)
    assert token_store.read_ids(spark, folder, 100, 5000).tolist() == everything[100:5100]
    empty = run_folder(spark, "test-tokens")
    token_store.write_tokens(frame(spark, []), empty, path, 49_408, 2)
    assert token_store.digests(spark, empty).count() == 0


def test_words_encode_as_texts_do():
    import pyarrow as pa

    rng = random.Random(5)
    letters = "aAbZzéÉßİıſK ǅ́ͅ  \t\n\x0b\x0c\r\x1c\x85  <|>'st'rexlL09 .,#ñ中\U0001f600ΣΣς"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["<|endoftext|>", "x<|ENDOFTEXT|>"]
    encoder = token_store._Encoder(public_tokenizers.path("word_bpe_49k.json"), "<|")
    ids, counts = encoder.encode(pa.array(texts), 2)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_letters_are_encoded_once():
    import pyarrow as pa

    encoder = token_store._Encoder(public_tokenizers.path("word_bpe_49k.json"), "<|")
    whole, sent = encoder.tokenizer, []

    class Watched:
        def __getattr__(self, name):
            return getattr(whole, name)

        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    encoder.tokenizer = Watched()
    texts = ["Gräßlich, gräßlich!!! gräßlich", "it's it,s <| it", "e\u0301a ea\u0301 \u0301ea éa. $$ $é 3a a3 \u00aa \u00f7", "", None, "gräßlich. it** ***it"]
    got = encoder.encode(pa.array(texts), 2)
    assert np.split(got[0], np.cumsum(got[1])[:-1])[-1].tolist() == [*whole.encode(texts[-1], add_special_tokens=False).ids, 2]
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert got[0].tolist() == [i for ids in want for i in ids] and got[1].tolist() == [len(ids) for ids in want]
    assert not any("gr" in t for t in sent) and "***it" in sent  # words with signs after them aren't encoded anew for each sign
    known = len(encoder.place)
    encoder.encode(pa.array(["gräßlich** gräßlich. it!!!"]), 2)
    assert len(encoder.place) == known
    ends = encoder.ends.copy()
    encoder.ends[:] = False  # as with a vocabulary that doesn't tell where words end
    encoder._start_anew()
    again = encoder.encode(pa.array(texts), 2)
    assert again[0].tolist() == got[0].tolist() and ends.any()


def test_words_are_dropped_and_encoded_anew(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_store, "KEPT_WORDS", 40)
    encoder = token_store._Encoder(public_tokenizers.path("word_bpe_49k.json"), "<|")
    rng = random.Random(3)
    for _ in range(20):
        texts = [" ".join(rng.choice(["ab", "ba.", "É", "x9", "c,"]) * rng.randint(1, 6) for _ in range(12)) for _ in range(4)]
        ids, counts = encoder.encode(pa.array(texts), 2)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def test_edited_pairs(spark):
    rows = sorted(documents(), key=lambda r: (r[0], r[1] or ""))
    want = []
    for (i, text, *_), (_, after, *_) in zip(rows, [*rows[1:], rows[0]], strict=True):
        text, after = text or "", after or ""
        q = len(text) // 4
        want.append((i, len(text), text[: len(text) - q] + after[:q]))
    pairs = fingerprints.edited_pairs(frame(spark))
    assert sorted((r.doc_id, r.n_chars, r.edited_text) for r in pairs.collect()) == sorted(want)
    assert fingerprints.edited_pairs(frame(spark, [])).count() == 0


def test_likeness(spark):
    a, b = prose(21, 3000), prose(22, 600)
    rows = [(1, a, b), (2, a, a + " " + b), (3, b, a + " " + b), (4, None, ""), (5, "x", None), (6, "x y", "X  y")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    sa, sb = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    got = df.select("i", fingerprints.likeness(sa, sb), fingerprints.containment(sa, sb), fingerprints.merge(sa, sb) == sa).collect()
    for (_, x, y), (_, like, inside, _) in zip(rows, got, strict=True):
        p, q = shingles(x), shingles(y)
        assert abs(like - (len(p & q) / len(p | q) if p | q else 1)) < 0.08
        assert abs(inside - (len(p & q) / len(p) if p else 1)) < 0.08
    whole, part = fingerprints.sketch(F.lit(a + " " + b)), fingerprints.merge(fingerprints.sketch(F.lit(a)), fingerprints.sketch(F.lit(b)))
    missing = df.select(F.size(F.array_except(part, whole)), F.size(F.array_except(whole, part))).first()
    assert missing[0] <= 2 and missing[1] <= 4  # smallest hashes, and shingles across the seam


def test_secrets(spark):
    got = secrets.find_secrets(frame(spark)).collect()
    assert len(got) == len(documents())
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in got:
        text = next(t for i, t, *_ in documents() if i == r.doc_id) or ""
        spans = [(0, *m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(1, *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(2, *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in spans) for k in range(3)]
    assert secrets.find_secrets(frame(spark, [])).count() == 0


def test_ownership(spark):
    example, live = "token = Copied0Example0Key0Aa99", "xY3" + "kQ7" * 8
    rows = [(i, f"{example} {live if i == 3 else ''}", "en", f"s{i % 4}", 1, 1, 1, "s", None) for i in range(8)]
    got = {r.doc_id: r for r in secrets.find_secrets(frame(spark, rows)).collect()}
    assert got[0].n_live == 0 and got[0].findings[0].owners == 4
    assert [got[3].findings[0].repositories, got[3].findings[1].repositories] == [8, 1]
    # one source that repeats a string in many documents shows an example, however few owners it has
    hot = [(i, f"{live} {'zT4' + 'Qm8' * 8 if i < 10 else ''}", "en", "one", 1, 1, 1, "s", None) for i in range(40)]
    found = {r.doc_id: r for r in secrets.find_secrets(frame(spark, hot + hot)).collect()}
    assert all(r.n_live == (1 if i < 10 else 0) for i, r in found.items())
    assert all(r.n_owned == 0 for r in secrets.find_secrets(frame(spark, hot), max_repositories=9).collect())
    assert got[3].n_owned == 1 and got[3].spans == f"assign:0:31,owned:32:{32 + len(live)}"


def distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = len(pattern)
    for c in text:
        last, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (p != c))
        best = min(best, row[-1])
    return best


def test_myers_and_pieces():
    rng = random.Random(1)
    for _ in range(150):
        pattern = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 120)))
        assert decontaminate.myers(decontaminate.masks(pattern), len(pattern), text)[0] == distance(pattern, text)
    items = [(k, prose(100 + k, rng.randint(8, 40))) for k in range(12)]
    finder = decontaminate.Finder(items)
    for _ in range(120):
        k, item = rng.choice(items)
        s = list(item)
        for _ in range(rng.randint(0, len(s) // 6)):
            at = rng.randrange(len(s))
            s[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
        text = prose(rng.randint(0, 9), 12) + " " + "".join(s) + " " + prose(rng.randint(0, 9), 12)
        found = {i: d for i, d, _, _ in finder.matches(text)}
        for j, other in items:
            pattern = decontaminate.normalise(other)
            least, budget = distance(pattern, decontaminate.normalise(text)), int(len(pattern) * decontaminate.RATE)
            assert (j in found) == (least <= budget), (j, k, least, budget)


def test_short_items_match_as_whole_words():
    finder = decontaminate.Finder([(1, "What is 2 plus 2?"), (2, "pi"), (3, "  "), (4, "c++")])
    found = lambda text: {i for i, *_ in finder.matches(text)}
    assert found("And then: what  is 2\nplus 2? Four.") == {1}
    assert found("What is 2 plus 3?") == found("pie and api") == found("") == set()
    assert found("The number Pi, in C++.") == {2, 4} and found("pi") == {2}
    assert [m[2:] for m in finder.matches("api pi")] == [(4, 6)]


def test_leaks(spark):
    item = prose(31, 30)
    rows = [*unique(), (50, f"{prose(32, 50)}\n{item.upper()} {prose(33, 9)}", "en", "a", 1, 1, 1, "s", None), (51, item[: len(item) // 2], "en", None, 1, 1, 1, "s", None)]
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "short"), (11, item)], "item_id long, text string")
    docs = frame(spark, rows)
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {(50, 7, 0), (50, 11, 0)}
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {50}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(docs, none).count() == 0 and decontaminate.drop_leaks(docs, none).count() == len(rows)
    assert decontaminate.find_leaks(spark.createDataFrame([], SCHEMA), items).count() == 0
    blocks = list(decontaminate.item_blocks(items, block_bytes=150))
    assert len(blocks) > 1 and sum(blocks, []).__len__() == 4
