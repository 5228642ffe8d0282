"""Quotations, mixing, quality, language model and Jaccard join, and the pipeline of five stages."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import compare, connect
from tests.llm.fixtures import SCHEMA, documents, edited, frame, prose, unique
from tracemill.llm import decontaminate, graph, jaccard_join, mixing, neural_lm, quality, quotations
from tracemill.llm.queries import LLM_REGISTRY


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n, q in LLM_REGISTRY.items() if q.sql])
def test_against_sql(spark, con, sf_dir, name):
    difference, _, _ = compare(spark, con, name, sf_dir, LLM_REGISTRY[name].run(spark, sf_dir))
    assert difference is None, difference


CONV = "conv_id long, turn long, role string, text string, position long, conv string"


def test_quotations(spark):
    first = "How large is the house that stands near the river?"
    rows = [
        (1, 0, "user", f"{first}\nIt has a green door and many windows.", 0, "x"),
        (1, 1, "user", "Something else altogether is being asked here.", 0, "x"),
        (1, 2, "assistant", f"On Monday someone wrote:\n> how large is  the house that stands near the river\n\nNine rooms.", 0, "x"),
        (1, 3, "user", f">> {first}\n> Nine rooms.\n> Nine rooms are what it has as far as we know\nThanks.", 0, "x"),
        (1, 4, "assistant", "> Something else altogether is being asked here.\nYes.", 0, "x"),
        (2, 0, None, None, 0, "x"),
        (2, 1, "user", f"> {first}", 0, "x"),
        (None, None, "user", "> quoted by nobody in particular at all", 0, "x"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotations.link_quotations(spark.createDataFrame(rows, CONV)).collect()}
    assert len(got) == len(rows)
    order = [t for _, t in sorted((got[1, t].position, t) for t in range(5))]
    assert order == [0, 2, 3, 1, 4]
    assert [got[1, t].reply_to for t in range(5)] == [None, None, 0, 2, 1]
    assert got[1, 2].body == "Nine rooms." and got[1, 3].body == "Thanks." and got[1, 3].n_quotes == 2
    assert got[2, 1].reply_to is None and got[2, 1].body == "" and got[2, 0].formatted == "<|user|>\n\n<|end|>\n"
    assert quotations.link_quotations(spark.createDataFrame([], CONV)).count() == 0
    twice = quotations.link_quotations(spark.createDataFrame(rows + rows, CONV))
    assert twice.count() == 2 * len(rows)


def test_attributions_of_any_length_and_language():
    long = "On a day that is long gone, " + "and in a place far away, " * 40 + "somebody wrote:"
    for line in (long, "Иван писал:", "Jemand schrieb am Montag:  "):
        assert quotations.parse(f"Hello.\n{line}\n> quoted\nYes.") == ("Hello.\nYes.", [(1, "quoted")])
    assert quotations.parse("As follows:\n\n> quoted")[0] == "As follows:"


def brute_replies(rows):
    """reply_to of (conv, turn, text) rows: the longest unit of a shallowest-level quotation that an earlier turn says."""
    out = {}
    for conv, turn, text in rows:
        own, passages = quotations.parse(text)
        best = {}
        for level, passage in passages:
            for unit in quotations.units(passage):
                said = [t for c, t, x in rows if c == conv and t < turn and unit in quotations.units(quotations.parse(x)[0])]
                if said:
                    best[level] = max(best.get(level, (0, -1)), (unit["size"], max(said)))
        out[conv, turn] = best[min(best)][1] if best else None
    return out


def test_replies_against_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text").collect()]
    rows = sorted(rows)[:400]
    docs = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    # every fifth turn quotes a part of one before it
    quoting = []
    for n, (c, t, x) in enumerate(rows):
        before = [y for d, u, y in rows if d == c and u < t and y]
        text = x or ""
        if before and n % 5 == 0:
            picked = before[n % len(before)]
            text = "> " + "\n> ".join(picked.split("\n")[: 1 + n % 3]) + "\n" + text
        quoting.append((c, t, text))
    docs = spark.createDataFrame([(c, t, "user", x) for c, t, x in quoting], docs.schema)
    got = {(r.conv_id, r.turn): r.reply_to for r in quotations.link_quotations(docs).collect()}
    assert got == brute_replies(quoting)
    assert sum(v is not None for v in got.values()) > 10


def test_short_quotations_and_sentences(spark, tmp_path):
    rows = [
        (1, 0, "user", "How large is the house that stands near the river? It has a green door. Who lives there?", 0, "x"),
        (1, 1, "assistant", "Nine rooms.", 0, "x"),
        (1, 2, "user", "Yes.", 0, "x"),
        (1, 3, "user", "> Nine rooms.\nThanks.", 0, "x"),
        (1, 4, "user", "> It has a green door.\n> Yes.\nReally?", 0, "x"),  # the longest match counts
        (1, 5, "user", "> ...\nWhat?", 0, "x"),
    ]
    spark.createDataFrame(rows, CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.reply_to for r in LLM_REGISTRY["op5_chat_formatting"].run(spark, str(tmp_path)).collect()}
    assert got == {0: None, 1: None, 2: None, 3: 1, 4: 0, 5: None}


def test_long_chain_of_replies(spark):
    said = [f"{prose(40 + k, 12)} number {k}" for k in range(40)]
    rows = [(1, k, "user", (f"> {said[k - 1]}\n" if k else "") + said[k], 0, "x") for k in range(40)]
    got = quotations.link_quotations(spark.createDataFrame(rows, CONV)).collect()
    assert all(r.thread == 0 and r.position == r.turn and r.reply_to == (r.turn - 1 if r.turn else None) for r in got)


def test_targets_and_copies(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 40)), "en", (None, "", "a", "b", "ß", "z")[int(rng.integers(0, 3)) if i % 3 else 3], 1, 1, 1, "s", None) for i in range(3000)]
    units = mixing.mix(frame(spark, rows)).collect()
    sizes = Counter()
    for r in units:
        sizes[r.source] += r.size * r.n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, held = 1.5 * sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in held}
        shares = {s: (total - sum(held.values())) * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: 2.0 * sizes[s] for s in rest if shares[s] > 2 * sizes[s]}
        if not over:
            break
        held |= over
    target = held | shares
    taken = Counter()
    for r in units:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * total
        assert r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1) or r.size == 0
        taken[r.source] += r.size * r.copies * r.n
    assert all(abs(taken[s] - target[s]) <= 40 for s in sizes)
    again = mixing.mix(frame(spark, rows[::-1]).repartition(7)).collect()
    assert {(r.doc_id, r.copies) for r in again} == {(r.doc_id, r.copies) for r in units}


def test_mix_of_odd_rows(spark):
    docs = frame(spark)
    units = mixing.mix(docs).collect()
    assert sum(r.n for r in units) == len(documents())
    assert all(r.copies == 0 for r in units if r.size == 0)
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    want = sum(r.copies * r.n for r in units)
    assert out.count() == want
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.repeat(frame(spark, [])).count() == 0


def auc(good, bad):
    return (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    good, bad = (np.array([r.score for r in rows if r.quality == q]) for q in (1, 0))
    assert auc(good, bad) > 0.97 and (good >= 0.3).mean() > 0.95


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(18)] + [(3, None, 0), (None, 1, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark)
    rows = quality.score(docs, labels).collect()
    assert len(rows) == len(documents()) and all(0 <= r.score <= 1 for r in rows)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    good = sorted(r.doc_id for r in rows if r.predicted)
    assert sorted(r.doc_id for r in kept.collect()) == good
    assert {r.score for r in quality.score(docs, labels.where("false")).collect()} == {0.5}
    assert {r.score for r in quality.score(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.score(frame(spark, []), labels).count() == 0


def test_discriminant_is_the_gaussian_one():
    rng = np.random.default_rng(3)
    x = [rng.normal(m, s, (5000, 3)) for m, s in ((0.0, 1.0), (1.0, 2.0))]
    sums = {k: np.hstack([np.ones((5000, 1)), v]).T @ np.hstack([np.ones((5000, 1)), v]) for k, v in enumerate(x)}
    got = quality.solve(sums, 0.0, 0.0, 0.0).score(np.zeros((1, 3)))[0]
    log = lambda m, s: -0.5 * 3 * (m / s) ** 2 - 3 * np.log(s)
    assert abs(got - 1 / (1 + np.exp(log(0, 1) - log(1, 2)))) < 0.02


def test_language_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id < 300").unionAll(
        frame(spark).selectExpr("doc_id + 1000 AS doc_id", "text")
    )
    texts = [(r.doc_id, [*(w.decode() for w in (r.text or "").encode().lower().split()), "\n"]) for r in docs.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    count = Counter(t for i, ts in texts if not held[i] for t in ts)
    total, distinct = sum(count.values()), len(count)
    want = Counter(
        (i, held[i], len(ts), sum(count[t] > 0 for t in ts), total, round(sum(np.log10((count[t] + 1) / (total + distinct + 1)) for t in ts), 4))
        for i, ts in texts
    )
    rows = neural_lm.score(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > 0.97 * sum(r.base_score for r in out)
    assert all(r.score < 0 for r in rows)
    assert neural_lm.score(docs.where("false")).count() == 0
    only = neural_lm.score(docs.where("crc32(cast(doc_id AS string)) % 7 = 2")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in only)


def test_size_of_the_language_model(spark):
    counts = spark.createDataFrame([(f"w{i:03}", 1000 - i) for i in range(600)], "token string, n long")
    v = neural_lm.vocabulary(counts)
    model = neural_lm.Model.start(v)
    assert v.classes() == 448 + 64 and v.class_of(np.array([447]))[0] == 447 and v.class_of(np.array([448]))[0] >= 448
    assert model.target.shape == (512, 32) and model.context.shape == (5, 32)
    assert (neural_lm.BATCH, neural_lm.NOISE) == (1024, 64)


def test_class_probabilities_are_normalised():
    v = neural_lm.Vocabulary({}, np.zeros(0), {}, np.zeros(0, np.int64), 10, 3, np.array([5, 3, 2]), np.array([1, 1, 1]))
    model = neural_lm.Model.start(v)
    before = neural_lm.contexts(np.array([0, 1, 2]), np.array([0, 1, 2]), 3)
    assert before[:, 0].tolist() == [3] * neural_lm.CONTEXT and before[:2, 2].tolist() == [1, 0]
    total = sum(np.exp(model.log_probability(before, np.full(3, c))) for c in range(3))
    assert np.allclose(total, 1)


def test_tokens_are_looked_up_in_tables():
    """Codes and suffix classes of a whole dictionary at once, by code points."""
    index, suffix = {"the": 0, "\n": 1, "é": 2}, {"ng": 2, "éa": 3, "x": 4}
    v = neural_lm.Vocabulary(index, np.array([5, 4, 3]), suffix, np.array([0, 1, 5]), 12, 3, np.ones(6, np.int64), np.ones(6, np.int64))
    words = ["thing", "the", "aéa", "x", "é", "yx", "g", "\n"]
    want = [index.get(w, -1 - suffix.get(w[-2:], 5)) for w in words]
    assert v.encode(pa.array(words)).tolist() == want
    assert v.class_of(v.encode(pa.array(words))).tolist() == [2, 0, 3, 4, 5, 5, 5, 1]
    none = neural_lm.Vocabulary({}, np.zeros(0), {}, np.zeros(0, np.int64), 0, 0, np.zeros(1, np.int64), np.zeros(1, np.int64))
    assert none.encode(pa.array(words)).tolist() == [-1] * len(words)


def test_tokens_are_counted_by_slice(monkeypatch):
    """Counts of slices are summed up and handed on in parts; the tables of a vocabulary are made once."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefghijkl") * rng.randint(1, 4) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", " É é\t"]
    want = Counter(w for t in texts for w in [*(t or "").lower().replace("É", "é").split(), "\n"])
    want["É"] = 1
    want["é"] -= 1
    monkeypatch.setattr(neural_lm, "SLICE_BYTES", 100)
    for rows, size in ((300_000, 64 << 20), (10, 64 << 20), (300_000, 200)):
        monkeypatch.setattr(neural_lm, "COUNTED", rows)
        monkeypatch.setattr(neural_lm, "COUNTED_BYTES", size)
        batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 20], pa.string())], ["_text"]) for i in range(0, len(texts), 20)]
        got, parts = Counter(), list(neural_lm._count(iter(batches)))
        for part in parts:
            assert part.schema.names == ["token", "n"] and len(set(part["token"].to_pylist())) == part.num_rows
            got.update(dict(zip(part["token"].to_pylist(), part["n"].to_pylist(), strict=True)))
        assert got == want and (len(parts) == 1) == (rows > 10 and size > 200)
    assert list(neural_lm._count(iter([]))) == []
    v = neural_lm.Vocabulary({"a": 0}, np.array([5]), {"b": 1}, np.array([0]), 5, 1, np.ones(3, np.int64), np.ones(3, np.int64))
    v.encode(pa.array(["a", "b"]))
    made = v.tables[pa.string()]
    v.encode(pa.array(["b"]))
    assert v.tables[pa.string()] is made


def test_shares_of_a_query_are_made_once():
    v = neural_lm.Vocabulary({}, np.zeros(0), {}, np.zeros(0, np.int64), 10, 3, np.array([5, 3, 2]), np.array([1, 1, 1]))
    model = neural_lm.Model.start(v)
    before = np.random.default_rng(4).integers(0, 4, (neural_lm.CONTEXT, 700))
    target = np.random.default_rng(5).integers(0, 3, 700)
    q = sum(model.context[i] * model.before[before[i]] for i in range(neural_lm.CONTEXT))
    s = q @ model.target.T + model.bias
    want = s[np.arange(700), target] - np.log(np.exp(s).sum(axis=1))
    assert np.allclose(model.query(before), q) and np.allclose(model.log_probability(before, target), want, atol=1e-5)
    model.bias += 200  # scores that exp can't take
    assert np.isfinite(model.log_probability(before, target)).all()


def test_a_step_takes_each_vector_once():
    """Neighbours in a line are the contexts of each token, and a step is the one over all contexts."""
    texts = pa.array(["a b c a b a", None, "", "c", "b a c c b a d e f g"])
    (run,) = neural_lm.runs(texts)
    target, none = run.codes % 4, 4
    line, want = run.line(target, none), neural_lm.contexts(target, run.place(), none)
    for a, b in ((0, len(target)), (3, 11), (12, 14), (len(target) - 2, len(target))):
        classes, at = line.stretch(a, b)
        assert [neural_lm._back(classes, i)[at].tolist() for i in range(neural_lm.CONTEXT)] == want[:, a:b].tolist()
    v = neural_lm.Vocabulary({}, np.zeros(0), {}, np.zeros(0, np.int64), 10, 4, np.array([5, 3, 2, 4]), np.ones(4, np.int64))
    trainer = neural_lm.Trainer(neural_lm.Model.start(v), neural_lm.noise(v), 1)
    m, before = trainer.m, want[:, 2:20]
    old, context, q = m.before.copy(), m.context.copy(), np.ones((18, neural_lm.SIZE + 1))
    q[:, :-1] = sum(context[i] * old[before[i]] for i in range(neural_lm.CONTEXT))
    other = np.minimum(np.searchsorted(trainer.upto, np.random.default_rng(1).random(neural_lm.NOISE)), 3)
    goal, rest, scale = trainer.target[target[2:20]], trainer.target[other], 1 / np.sqrt(18)
    good = scale / (1 + np.exp((q * goal).sum(axis=1) - trainer.log_noise[target[2:20]]))
    bad = -scale / (1 + np.exp(trainer.log_noise[other] - q @ rest.T))
    dq = (good[:, None] * goal + bad @ rest)[:, :-1]
    sums = np.zeros_like(old, np.float64)
    for i in range(neural_lm.CONTEXT):
        np.add.at(sums, before[i], dq * context[i])
    dc = np.stack([(dq * old[before[i]]).sum(axis=0) for i in range(neural_lm.CONTEXT)])
    trainer.step(line, target, 2, 20)
    near = lambda was, g: was + neural_lm.RATE * g / np.sqrt(1e-2 + g * g + 1e-6)
    assert np.allclose(m.before, near(old, sums), atol=1e-5) and np.allclose(m.context, near(context, dc), atol=1e-5)


def word_sets(rows, width=4):
    out = []
    for r in rows:
        words = (r[1] or "").encode().lower().split()
        out.append({tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set()))
    return out


def brute_classes(rows):
    sets, parent = word_sets(rows), list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                parent[a] = b
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted((r[0], len(s), least[top(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def row(i, text):
    return (i, text, "en", "a", 1, 1, 1, "s", None)


def test_classes_of_odd_rows(spark):
    got = jaccard_join.classes(frame(spark)).collect()
    assert sorted(tuple(r) for r in got) == brute_classes(documents())
    assert jaccard_join.classes(frame(spark, [])).count() == 0


def test_classes_of_a_chain_and_of_near_copies(spark):
    rng, words = np.random.default_rng(1), prose(60, 300).split()
    rows, now = [], list(words)
    for i in range(40):  # each a little further from the first
        now[int(rng.integers(0, 300))] = f"new{i}"
        rows.append(row(100 - i, " ".join(now)))
    for i in range(80):  # a group around one text, members further apart than the threshold
        own = list(prose(61, 200).split())
        for at in rng.choice(200, 4, replace=False):
            own[at] = f"own{i}x{at}"
        rows.append(row(200 + i, " ".join(own)))
    rows += [row(400 + n, " ".join(prose(70 + n // 8, 40).split()[: 5 + n % 8])) for n in range(80)]
    rows += [row(600 + i, f"{prose(62, 40)} {prose(500 + i, 25)}") for i in range(90)]  # one common passage, no links
    got = jaccard_join.classes(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == brute_classes(rows)


def test_blocks_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    rows = [row(i, edited(prose(80 + i % 3, 150), 9 + i)) for i in range(60)]
    got = jaccard_join.classes(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == brute_classes(rows)


def test_alike_sets_share_a_signature():
    rng, bands = np.random.default_rng(5), jaccard_join.Bands(85)
    for _ in range(3000):
        n = int(rng.integers(1, 160))
        one = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        gone = rng.integers(0, max(1, n // 9) + 1)
        two = np.unique(np.r_[rng.permutation(one)[gone:], rng.integers(0, 1 << 63, rng.integers(0, max(1, n // 9) + 1)).astype(np.uint64)])
        both = len(np.intersect1d(one, two))
        if 100 * both >= 85 * (len(one) + len(two) - both) and len(np.setxor1d(one, two)):
            for frequent in (one[:0], one[: n // 3], np.union1d(one, two), two[::2]):
                a, b = (jaccard_join.signatures(x, bands, x[~np.isin(x, frequent)]) for x in (one, two))
                assert len(np.intersect1d(a, b))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_shared_rows_of_any_batches(size):
    import pyarrow as pa

    rng = np.random.default_rng(size)
    rows = sorted({(int(s), int(x)) for s, x in zip(rng.integers(0, 60, 300), rng.integers(0, 9, 300), strict=True)} | {(70, i) for i in range(40)} | {(99, 1)})
    rows = sorted(rows + rows[::5])
    table = pa.table({"sig": [r[0] for r in rows], "lo": [r[1] for r in rows]})
    got = {}
    for batch in jaccard_join._shared(iter(table.to_batches(max_chunksize=size))):
        for gid, lo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got.setdefault(gid, set()).add(lo)
    want = {}
    for s, x in rows:
        want.setdefault(s, set()).add(x)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 199)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long"), "test").collect())
    want = {i: 1 for i in range(1, 61)} | {k: 100 for k in range(100, 130)} | {199: 199, 200: 199}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token ids"]
    good = {r.doc_id for r in quality.score(docs, labels).where("predicted = 1").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    kept = {i for i, _, c in brute_classes(rows) if i == c}
    finder = decontaminate.Finder(items)
    clean = [r for r in rows if r[0] in kept and not finder.matches(r[1])]
    results = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, results[-1], sf_dir).write.parquet(path)
        results.append(spark.read.parquet(path))
    ids = [sorted(r.doc_id for r in df.collect()) for df in results]
    assert ids[1] == sorted(good) and ids[2] == sorted(kept) and ids[3] == [i for i, _ in clean]
    assert all(df.columns == docs.columns for df in results[:-1])
    assert set(ids[4]) <= set(ids[3]) and ids[5] == ids[4] and len(ids[4]) > len(ids[3])
    ran = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(tuple, ran)) == sorted(map(tuple, results[-1].collect()))


def test_stages_take_odd_rows(spark, sf_dir):
    docs = frame(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() >= 0
        assert stage(spark, spark.createDataFrame([], SCHEMA), sf_dir).count() == 0
    assert len(unique()) == len(documents()) - 3


def test_near_copies_of_the_pipeline(spark, sf_dir):
    base, rows = prose(300, 200).split(), []
    for i in range(8):  # i words changed: likeness to the first from 1 to below 0.7, 0.81 over five words at i = 4
        every = 200 // max(i, 1)
        rows.append(row(i, " ".join(f"new{i}" if k % every == 9 and k // every < i else w for k, w in enumerate(base))))
    rows += [row(20, prose(301, 90)), row(20, prose(301, 90)), row(21, ""), row(21, ""), row(None, None)]
    sets = word_sets(rows, 5)
    near = [{j for j in range(8) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} for i in range(8)]
    reached = {0}
    for _ in near:
        reached |= {j for i in reached for j in near[i]}
    want = [0, *sorted(set(range(8)) - reached), 20, 21, None]
    assert 4 in reached and len(want) > 4 and all(near[i] == {i} for i in set(range(8)) - reached)
    # of two rows with one id each is judged by its text; columns may have any name
    base_text = " ".join(base)
    twice = frame(spark, [row(1, base_text), row(2, base_text), row(2, prose(302, 90)), row(None, base_text)])
    for name in ("_id", "_n", "_kept_id", "_mix_doc_id", "_mix_each", "text_hash", "component"):
        twice = twice.withColumn(name, F.lit(name))
    kept = corpus_pipeline.keep_one_of_a_kind(spark, twice, sf_dir)
    assert kept.columns == twice.columns
    assert sorted((r.doc_id, r.text == base_text, r._n) for r in kept.collect()) == [(1, True, "_n"), (2, False, "_n")]
    assert mixing.repeat(twice).columns == twice.columns and mixing.repeat(twice).where("_mix_each <> '_mix_each'").count() == 0
    got = corpus_pipeline.keep_one_of_a_kind(spark, frame(spark, rows), sf_dir)
    assert got.columns == frame(spark, []).columns
    assert sorted((r.doc_id for r in got.collect()), key=lambda i: (i is None, i)) == want
