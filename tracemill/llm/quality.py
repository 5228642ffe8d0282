"""Quality by regularised quadratic discriminant over document statistics.

The class sums that means and covariances need are added up over all labelled training rows; the model is a few
hundred numbers. Covariances shrink towards their pooled form and its diagonal; a score is the difference of the
two log-densities, each a Mahalanobis distance through its class's Cholesky factor, factored once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import drop_worker_state, written

FEATURES = (
    "words word_length upper digit symbol mark non_ascii space line distinct top_word short_word repeated_line "
    "word_symbol letter_entropy"
).split()
_CLASSES = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "symbol": list(b"#$%&*+<=>@\\^_`{|}~!"),
    "mark": list(b".,;:?-'\"()"),
    "non_ascii": range(128, 256),
    "space": (9, 11, 12, 13, 32),
    "line": (10,),
}
_SYMBOLS = bytes(_CLASSES["symbol"])


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of one whole text: logarithms of counts and of smoothed shares."""
    raw = (text or "").encode()
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    words = raw.lower().split()
    total = len(words)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    share = lambda part, whole: np.log((part + 0.5) / (whole + 1.0))
    of = {name: counts[list(codes)].sum() for name, codes in _CLASSES.items()}
    lines = raw.split(b"\n")
    letters = counts[97:123] + counts[65:91]
    p = letters[letters > 0] / max(1, letters.sum())
    marked = sum(c for w, c in tally.items() if w[-1] in _SYMBOLS) if total else 0
    return np.array([
        np.log1p(total),
        np.log((n + 1.0) / (total + 1.0)),
        *(share(of[k], n) for k in ("upper", "digit", "symbol", "mark", "non_ascii", "space", "line")),
        np.log(len(tally) + 1.0) - 0.9 * np.log(total + 1.0),
        share(max(tally.values(), default=0), total),
        share(sum(c for w, c in tally.items() if len(w) <= 2), total),
        share(len(lines) - len(set(lines)), len(lines)),
        share(marked, total),
        -(p * np.log(p)).sum() if len(p) else 0.0,
    ])


def _features(batches):
    drop_worker_state()
    for batch in batches:
        rows = [statistics(t.as_py()).tolist() for t in batch.column("_text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(rows, pa.list_(pa.float64()))], ["_id", "_x"]
        )


def _sums(batches):
    """Per label: number, sums and products of the rows of a task."""
    d, held = len(FEATURES), {}
    for batch in batches:
        labels = batch.column("_label").to_numpy()
        x = batch.column("_x").flatten().to_numpy().reshape(-1, d)
        for label in np.unique(labels):
            own = np.hstack([np.ones(((labels == label).sum(), 1)), x[labels == label]])
            held[int(label)] = held.get(int(label), 0.0) + own.T @ own
    for label, m in held.items():
        i, j = np.triu_indices(d + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(i), label), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j])],
            ["label", "i", "j", "value"],
        )


@dataclass(frozen=True)
class Model:
    means: np.ndarray  # by class
    factors: np.ndarray  # inverse Cholesky factors
    offsets: np.ndarray  # log prior less half the log determinant
    classes: tuple[int, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        if self.classes != (0, 1):
            return np.full(len(x), 0.5 if not self.classes else float(self.classes[0]))
        logs = [
            o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1)
            for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)
        ]
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def solve(sums: dict[int, np.ndarray], pooled: float = 0.1, diagonal: float = 0.05, floor: float = 1e-4) -> Model:
    """Model of the classes' moment matrices [[n, sum], [sum, products]].

    pooled and diagonal: shares of the pooled covariance and of its diagonal in each class's; floor: least variance.
    """
    classes = tuple(sorted(k for k, m in sums.items() if m[0, 0] > 0))
    if not classes:
        return Model(np.zeros((0, 0)), np.zeros((0, 0, 0)), np.zeros(0), ())
    n = np.array([sums[k][0, 0] for k in classes])
    means = np.stack([sums[k][0, 1:] / sums[k][0, 0] for k in classes])
    scatter = [sums[k][1:, 1:] - sums[k][0, 0] * np.outer(m, m) for k, m in zip(classes, means, strict=True)]
    together = sum(scatter) / n.sum()
    spread = np.diag(np.maximum(np.diag(together), floor))
    factors, offsets = [], []
    for s, size in zip(scatter, n, strict=True):
        own = (1 - pooled - diagonal) * s / size + pooled * together + diagonal * spread
        own += floor * np.eye(len(own))
        low = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(low))
        offsets.append(np.log(size / n.sum()) - np.log(np.diag(low)).sum())
    return Model(means, np.stack(factors), np.array(offsets), classes)


def held_out(id_col: Column) -> Column:
    """Rows no label is learned from; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_features, "_id long, _x array<double>")


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """Model learned from all labelled rows of stats that are not held out.

    Null labels and labels other than 0 and 1 are left out; an id with several label rows counts once for each.
    """
    marked = labels.select(F.col("doc_id").alias("_of"), F.col(label_col).cast("int").alias("_label"))
    train = (
        stats.where(~held_out(F.col("_id")))
        .join(marked.where(F.col("_label").isin(0, 1)), F.col("_id") == F.col("_of"))
        .select("_label", "_x")
    )
    sums = train.mapInArrow(_sums, "label int, i int, j int, value double").groupBy("label", "i", "j").agg(F.sum("value").alias("value"))
    d, out = len(FEATURES) + 1, {}
    for r in sums.collect():  # two symmetric matrices
        m = out.setdefault(r.label, np.zeros((d, d)))
        m[r.i, r.j] = m[r.j, r.i] = r.value
    return solve(out)


def score(docs: DataFrame, labels: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row of docs.

    Null text counts as empty and is scored. Repeated rows are each scored. Without labels of both classes every
    score is that of the only class, or 0.5. An empty table gives no rows. Other columns are not looked at.
    """
    stats = written(features(docs, id_col, text_col), "quality", 2000)
    model = fit(stats, labels)

    def run(batches):
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(model.score(x))], ["_id", "score"])

    scored = stats.mapInArrow(run, "_id long, score double")
    return scored.select(
        F.col("_id").alias(id_col),
        held_out(F.col("_id")).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, as they are, whose score is at least `least`."""
    model = fit(written(features(docs, id_col, text_col), "quality", 2000), labels)
    at = docs.columns.index(text_col)

    def run(batches):
        drop_worker_state()
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(at)]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
