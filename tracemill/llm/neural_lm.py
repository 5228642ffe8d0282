"""Log-bilinear language model in numpy, trained with noise-contrastive estimation.

Tokens are counted over all training documents. The most frequent ones are classes of their own, the others share
classes by their last two bytes. The model predicts a class from the classes before it,

    s(c, h) = Q[c] . sum_i C[i] * R[h_i] + b[c],

and a token within its class by its count. Every task trains on the documents it reads, from the same start, and
the weighted mean of the parameters is the model. For scores the class probabilities are normalised: one matrix
product over all classes for a batch of positions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import written

END = "\n"
#: Frequent tokens that are classes of their own, classes of the rest, vector length, tokens of context.
OWN, SHARED, SIZE, CONTEXT = 448, 64, 32, 5
#: Most frequent tokens whose counts travel with the tasks: a bound on what is broadcast. Others are joined.
CARRIED = 100_000
#: Tokens a task counts before it hands its counts on, and the bytes at which it sums up those of its slices.
COUNTED, COUNTED_BYTES = 300_000, 64 << 20
BATCH, NOISE, RATE = 1024, 64, 0.1
#: Positions that are scored at a time: few enough that the scores of all classes stay in a core's cache.
SCORED = 256
#: Texts that are split at a time, in bytes.
SLICE_BYTES = 4 << 20
#: Share of the documents of the first round, which gives the tasks of the second a common direction.
FIRST = 16


def held_out(id_col: Column) -> Column:
    """Documents the model doesn't learn from; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 == 2


@dataclass
class Run:
    """Tokens of some whole texts: distinct words, the code of each token, and where each text starts and ends."""

    words: pa.StringArray
    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def place(self) -> np.ndarray:
        """Each token's place in its text."""
        return np.arange(len(self.codes)) - np.repeat(self.starts, self.ends - self.starts)

    def line(self, target: np.ndarray, none: int) -> Line:
        """The texts' classes one after the other."""
        at = np.arange(len(target)) + np.repeat(np.arange(1, len(self.starts) + 1) * CONTEXT, self.ends - self.starts)
        classes = np.full(len(target) + CONTEXT * len(self.starts), none, np.int64)
        classes[at] = target
        return Line(classes, at)


@dataclass
class Line:
    """Classes of texts one after the other, `none` CONTEXT times before each, and the places of the tokens.

    What is before a token are its neighbours, so the vectors of a stretch are taken once and shifted.
    """

    classes: np.ndarray
    at: np.ndarray

    def stretch(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Classes from CONTEXT places before token a up to token b - 1, and the places of the tokens after the first ones."""
        first = self.at[a]
        return self.classes[first - CONTEXT : self.at[b - 1] + 1], self.at[a:b] - first


def _back(rows: np.ndarray, i: int) -> np.ndarray:
    """Of the rows of a stretch those i + 1 places before each of its places."""
    return rows[CONTEXT - 1 - i : len(rows) - 1 - i]


def runs(texts: pa.Array):
    """Words of each text, A-Z lower-cased, and one end after them; null is the end alone."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    size = np.cumsum(np.asarray(pc.binary_length(texts)))
    cuts = np.searchsorted(size, np.arange(0, size[-1] if len(size) else 0, SLICE_BYTES)[1:], "right")
    edges = sorted({0, *cuts.tolist(), len(texts)})
    for a, b in zip(edges, edges[1:], strict=False):
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(a, b - a)))
        flat, stops = split.flatten(), np.asarray(split.offsets)
        coded = flat.dictionary_encode()
        words = pa.concat_arrays([coded.dictionary, pa.array([END], coded.dictionary.type)])
        filled = np.asarray(pc.binary_length(flat)) > 0  # splitting may leave empty words at the ends
        upto = np.concatenate(([0], np.cumsum(filled)))[stops - stops[0]]
        codes = np.insert(np.asarray(coded.indices)[filled].astype(np.int64), upto[1:], len(words) - 1)
        ends = upto[1:] + np.arange(1, len(upto))
        yield Run(words, codes, np.r_[0, ends[:-1]], ends)


def _summed(tables: list[pa.Table]) -> pa.Table:
    """One row a token."""
    sums = pa.concat_tables(tables).group_by("token", use_threads=False).aggregate([("n", "sum")])
    return sums.select(["token", "n_sum"]).rename_columns(["token", "n"])


def _count(batches):
    held: list[pa.Table] = []  # counts of slices
    for batch in batches:
        for run in runs(batch.column("_text")):
            times = np.bincount(run.codes, minlength=len(run.words))
            there = np.flatnonzero(times)
            words = run.words.take(pa.array(there)).cast(pa.string())
            held.append(pa.table({"token": words, "n": pa.array(times[there], pa.int64())}))
            if sum(t.num_rows for t in held) > 2 * COUNTED or sum(t.nbytes for t in held) > COUNTED_BYTES:
                held = [_summed(held)]
                if held[0].num_rows > COUNTED or held[0].nbytes > COUNTED_BYTES // 2:
                    yield from held[0].to_batches()
                    held = []
    if held:
        yield from _summed(held).to_batches()


@dataclass
class Vocabulary:
    """Counts of the most frequent tokens and the classes of all tokens."""

    index: dict[str, int]
    count: np.ndarray
    suffix: dict[str, int]
    of: np.ndarray  # class of each carried token
    total: int  # training tokens
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray

    def classes(self) -> int:
        return len(self.class_total)

    def __post_init__(self):
        self.tables: dict = {}  # made once a task for the type of its words

    def encode(self, words: pa.StringArray) -> np.ndarray:
        """Index of each token, or -1 less its class where the token isn't carried."""
        if words.type not in self.tables:
            self.tables[words.type] = pa.array(list(self.index), words.type), pa.array(list(self.suffix), words.type)
        carried, suffixes = self.tables[words.type]
        place = lambda of, table: np.asarray(pc.fill_null(pc.index_in(of, table), -1))
        code = place(words, carried).astype(np.int64)  # both tables are numbered in their order
        rest = np.flatnonzero(code < 0)
        shared = place(pc.utf8_slice_codeunits(words.take(pa.array(rest)), -2), suffixes)
        classes = np.array([*self.suffix.values(), self.classes() - 1], np.int64)  # the last one where a suffix has none
        code[rest] = -1 - classes[shared]
        return code

    def class_of(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes >= 0, self.of[np.maximum(codes, 0)], -1 - codes) if len(self.of) else -1 - codes


def vocabulary(counts: DataFrame, own: int = OWN, shared: int = SHARED, carried: int = CARRIED) -> Vocabulary:
    """Of the counts (token, n) of all training documents; the driver gets a bounded number of rows."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("n"), "token").limit(carried).toArrow()
    words = top.column("token").to_pylist()
    index = {w: i for i, w in enumerate(words)}
    count = top.column("n").to_numpy().astype(np.int64)
    own = min(own, len(words))
    first = words[:own]
    rest = counts.where(~F.col("token").isin(first)) if first else counts
    ends = rest.groupBy(F.right("token", F.lit(2)).alias("s")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
    sums = ends.agg(F.sum("n"), F.sum("d")).first()
    best = ends.orderBy(F.desc("n"), "s").limit(shared - 1).collect()
    suffix = {r.s: own + i for i, r in enumerate(best)}
    size = own + shared
    class_total, class_distinct = np.zeros(size, np.int64), np.zeros(size, np.int64)
    class_total[:own], class_distinct[:own] = count[:own], 1
    for i, r in enumerate(best):
        class_total[own + i], class_distinct[own + i] = r.n, r.d
    class_total[-1] = (sums[0] or 0) - sum(r.n for r in best)
    class_distinct[-1] = (sums[1] or 0) - sum(r.d for r in best)
    of = np.array([i if i < own else suffix.get(w[-2:], size - 1) for w, i in index.items()], np.int64)
    return Vocabulary(index, count, suffix, of, int(total), int(distinct), class_total, class_distinct)


@dataclass
class Model:
    context: np.ndarray  # CONTEXT x SIZE
    before: np.ndarray  # vectors of the classes before, the last one for no token
    target: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, vocabulary: Vocabulary) -> Model:
        """Nearly the frequencies of the classes themselves."""
        rng, n = np.random.default_rng(7), vocabulary.classes()
        near = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(np.full((CONTEXT, SIZE), 1 / CONTEXT, np.float32), near(n + 1, SIZE), near(n, SIZE), np.log(noise(vocabulary)).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.before, self.target, self.bias)]).astype(np.float64)

    def like(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for x in (self.context, self.before, self.target, self.bias):
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(*out)

    def shares(self) -> np.ndarray:
        """What each class adds to a query from each place of the context: taken once, not for each position."""
        return self.before * self.context[:, None]

    def query(self, before: np.ndarray, shares: np.ndarray | None = None) -> np.ndarray:
        shares = self.shares() if shares is None else shares
        q = shares[0].take(before[0], axis=0)
        for i in range(1, CONTEXT):
            q += shares[i].take(before[i], axis=0)
        return q

    def log_probability(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm of each class's probability after the classes before it, normalised over all classes."""
        out, shares = np.empty(len(target)), self.shares()
        columns, ones = np.ascontiguousarray(np.c_[self.target, self.bias].T), np.ones(len(self.target), np.float32)
        longest = lambda rows: np.sqrt(np.square(rows).sum(axis=-1).max(axis=-1))
        # no score is above it, whatever classes are before
        highest = longest(shares).sum() * longest(self.target) + self.bias.max() if len(self.target) else 0.0
        q = np.ones((SCORED, SIZE + 1), np.float32)  # the bias is one more column
        scores = np.empty((SCORED, len(self.target)), np.float32)
        for a in range(0, len(target), SCORED):
            t = target[a : a + SCORED]
            n = len(t)
            q[:n, :-1] = self.query(before[:, a : a + SCORED], shares)
            s = np.matmul(q[:n], columns, out=scores[:n])
            if not highest < 80:
                np.minimum(s, 80.0, out=s)  # scores are near log-probabilities; exp can't overflow
            own = s[np.arange(n), t].astype(np.float64)
            np.exp(s, out=s)
            out[a : a + SCORED] = own - np.log((s @ ones).astype(np.float64))
        return out


def noise(vocabulary: Vocabulary) -> np.ndarray:
    weight = vocabulary.class_total + 1.0
    return weight / weight.sum()


def contexts(target: np.ndarray, first: np.ndarray, none: int) -> np.ndarray:
    """The classes 1, 2, .. before each token, `none` where its text has none; first: each token's place in its text."""
    out = np.full((CONTEXT, len(target)), none, np.int64)
    early = np.flatnonzero(first < CONTEXT)
    for i in range(CONTEXT):
        out[i, i + 1 :] = target[: -i - 1] if i + 1 <= len(target) else 0
        out[i, early[first[early] <= i]] = none
    return out


def _add_rows(into: np.ndarray, squares: np.ndarray, rows: np.ndarray, grads: np.ndarray) -> None:
    """Adaptive step: rows that occur several times are summed first."""
    rows = rows.astype(np.uint16)  # sorted by radix
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.concatenate(([0], np.flatnonzero(rows[1:] != rows[:-1]) + 1))
    sums, rows = np.add.reduceat(grads.take(order, axis=0), starts, axis=0), rows[starts]
    squared = squares[rows] + sums * sums
    squares[rows] = squared
    into[rows] += RATE * sums / np.sqrt(squared + 1e-6)


class Trainer:
    """Noise-contrastive steps; the noise of a batch is shared, which makes its scores a matrix product."""

    def __init__(self, model: Model, share: np.ndarray, seed: int):
        self.m = Model(*(x.copy() for x in (model.context, model.before, model.target, model.bias)))
        self.target = np.c_[self.m.target, self.m.bias]  # the bias is one more column
        self.squares = [np.full(x.shape, 1e-2, np.float32) for x in (self.m.context, self.m.before, self.target)]
        self.share, self.rng, self.seen = share, np.random.default_rng(seed), 0
        self.upto = np.cumsum(share)
        self.log_noise = np.log(NOISE * share).astype(np.float32)

    def step(self, line: Line, target: np.ndarray, a: int, b: int) -> None:
        """One step over the tokens a to b of a line, whose classes are `target`."""
        m, n, target = self.m, b - a, target[a:b]
        scale = np.float32(1 / np.sqrt(n))
        other = np.minimum(np.searchsorted(self.upto, self.rng.random(NOISE)), len(self.share) - 1)
        classes, at = line.stretch(a, b)
        vectors = m.before.take(classes, axis=0)
        places = len(classes) - CONTEXT  # as many as tokens, or more where texts begin
        sums, part = np.empty((places, SIZE), np.float32), np.empty((places, SIZE), np.float32)
        np.multiply(_back(vectors, 0), m.context[0], out=sums)
        for i in range(1, CONTEXT):
            sums += np.multiply(_back(vectors, i), m.context[i], out=part)
        q = np.ones((n, SIZE + 1), np.float32)
        q[:, :-1] = sums if places == n else sums.take(at, axis=0)
        goal, rest = self.target.take(target, axis=0), self.target.take(other, axis=0)
        good = scale / (1 + np.exp(np.einsum("jk,jk->j", q, goal) - self.log_noise[target]))
        bad = q @ rest.T
        np.exp(np.subtract(self.log_noise[other], bad, out=bad), out=bad)
        bad += 1
        np.divide(-scale, bad, out=bad)
        goal *= good[:, None]
        goal += bad @ rest
        dq = goal[:, :-1]
        if places > n:
            dq = np.zeros((places, SIZE), np.float32)
            dq[at] = goal[:, :-1]
        grads = np.empty((n + NOISE, SIZE + 1), np.float32)
        np.multiply(q, good[:, None], out=grads[:n])
        np.matmul(bad.T, q, out=grads[n:])
        dc, db = np.empty((CONTEXT, SIZE), np.float32), np.zeros((len(classes), SIZE), np.float32)
        ones = np.ones(places, np.float32)
        for i in range(CONTEXT):
            dc[i] = ones @ np.multiply(dq, _back(vectors, i), out=part)
            into = _back(db, i)
            into += np.multiply(dq, m.context[i], out=part)
        _add_rows(self.target, self.squares[2], np.concatenate([target, other]), grads)
        _add_rows(m.before, self.squares[1], classes, db)
        self.squares[0] += dc * dc
        m.context += RATE * dc / np.sqrt(self.squares[0] + 1e-6)
        self.seen += n

    def model(self) -> Model:
        self.m.target, self.m.bias = self.target[:, :-1].copy(), self.target[:, -1].copy()
        return self.m


def train(docs: DataFrame, vocabulary: Vocabulary, start: Model, name: str) -> Model:
    """Mean of the models that the tasks make of their documents, weighted by tokens."""
    share = noise(vocabulary)

    def run(batches):
        trainer = None
        for batch in batches:
            for part in runs(batch.column("_text")):
                trainer = trainer or Trainer(start, share, int(part.codes.sum() & 0xFFFF))
                target = vocabulary.class_of(vocabulary.encode(part.words))[part.codes]
                line = part.line(target, vocabulary.classes())
                for a in range(0, len(target), BATCH):
                    trainer.step(line, target, a, min(a + BATCH, len(target)))
        if trainer:
            flat = trainer.model().flat() * trainer.seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat) + 1), pa.int32()), pa.array(np.r_[flat, trainer.seen])], ["i", "value"]
            )

    sums = docs.mapInArrow(run, "i int, value double").groupBy("i").agg(F.sum("value").alias("value"))
    rows = written(sums, name).toArrow()  # as many as the model has numbers
    if not rows.num_rows:
        return start
    flat = np.zeros(rows.num_rows)
    flat[rows.column("i").to_numpy()] = rows.column("value").to_numpy()
    return start.like(flat[:-1] / flat[-1])


_SCORED = (
    "id long, held_out boolean, n_tokens long, known long, base double, score double, "
    "rare array<struct<token: string, n: long>>"
)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    A token is known if a training document has it. base_score is the add-one unigram model's log10 probability of
    the whole text and its end; score the log-bilinear model's: log10 of the class's normalised probability and of
    the token within its class, by add-one counts, so a token never seen is the rarest of its class.

    Null text is its end alone. Repeated rows are each counted and scored. Without training documents all tokens
    are unknown. An empty table gives no rows. Other columns are not looked at.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), held_out(F.col(id_col)).alias("_held")
    )
    seen = rows.where(~F.col("_held"))
    counts = written(
        seen.select("_text").mapInArrow(_count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")), "lm-counts"
    )
    known = vocabulary(counts)
    model = Model.start(known)
    first = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(FIRST)) == 0
    model = train(seen.where(first).select("_text"), known, model, "lm-first")
    model = train(seen.select("_text"), known, model, "lm-model")
    logs = np.log10(known.count + 1.0) if len(known.count) else np.zeros(0)
    base_least = np.log10(known.total + known.distinct + 1.0)
    in_class = np.log10(known.class_total + known.class_distinct + 1.0)
    own = len(known.class_total) - SHARED

    def run(batches):
        for batch in batches:
            at = 0
            for part in runs(batch.column("_text")):
                coded, n = known.encode(part.words), len(part.starts)
                carried = coded >= 0
                log_count = np.where(carried, logs[np.maximum(coded, 0)], 0.0) if len(logs) else np.zeros(len(coded))
                classes = known.class_of(coded)
                inside = np.where(classes >= own, log_count - in_class[classes], 0.0)
                target = classes[part.codes]
                lm = model.log_probability(contexts(target, part.place(), known.classes()), target) / np.log(10)
                each = (carried.astype(np.int64)[part.codes], (log_count - base_least)[part.codes], lm + inside[part.codes])
                sums = [np.add.reduceat(x, part.starts) for x in each]
                rare_at = np.flatnonzero(~carried[part.codes])
                doc = np.searchsorted(part.ends, rare_at, "right")
                key, times = np.unique(doc * len(part.words) + part.codes[rare_at], return_counts=True)
                stops = np.searchsorted(key, np.arange(n + 1) * len(part.words)).astype(np.int32)
                word = part.words.cast(pa.string()).take(pa.array(key % len(part.words)))
                rare = pa.StructArray.from_arrays([word, pa.array(times, pa.int64())], ["token", "n"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(at, n),
                        batch.column("_held").slice(at, n),
                        pa.array(part.ends - part.starts, pa.int64()),
                        *map(pa.array, sums),
                        pa.ListArray.from_arrays(pa.array(stops), rare),
                    ],
                    ["id", "held_out", "n_tokens", "known", "base", "score", "rare"],
                )
                at += n

    scored = written(rows.mapInArrow(run, _SCORED).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rest = (
        scored.select("row", F.explode("rare").alias("r"))
        .select("row", "r.*")
        .join(counts.withColumnRenamed("n", "c"), "token")
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum("n").alias("found"))
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare").join(rest, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
