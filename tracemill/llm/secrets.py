"""Secrets in texts, judged by who else holds the same string.

Patterns give candidates. Their hashes are counted over the whole corpus by distinct repositories and owners: a
string that many owners or many repositories hold is a copied example, one that few of both hold looks live. The
counts also admit candidates that no pattern names: random-looking live strings become spans of kind `owned`.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import written

#: Kinds in their order; the first three are the base patterns.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a shorter run fails from any of its starts
HEX = re.compile(r"[0-9a-f]{24,}")
#: Strings of 20 characters or more with lower case, upper case and digits.
RANDOM = re.compile(r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z0-9_/+=-]*[a-z])(?=[A-Za-z0-9_/+=-]*[A-Z])(?=[A-Za-z0-9_/+=-]*[0-9])[A-Za-z0-9_/+=-]{20,}")

_CANDIDATE = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())])
_SCHEMA = (
    "id long, repository string, owner string, "
    "candidates array<struct<kind: int, start: long, end: long, hash: string>>"
)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, secret) of the base patterns, by start and then kind."""
    found = [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """Base spans, and random-looking strings that overlap none of them."""
    found = base_spans(text)
    taken = [(a, b) for _, a, b, _ in found]
    for m in RANDOM.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in taken):
            found.append((3, *m.span(), m[0]))
    return sorted(found, key=lambda x: (x[1], x[0]))


def _scan(batches):
    for batch in batches:
        rows = []
        for text in batch.column("_text"):
            text = text.as_py() or ""
            rows.append([
                {"kind": k, "start": a, "end": b, "hash": hashlib.sha256(s.encode()).hexdigest()}
                for k, a, b, s in candidates(text)
            ])
        columns = [batch.column(c) for c in ("id", "repository", "owner")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(rows, pa.list_(_CANDIDATE))], ["id", "repository", "owner", "candidates"]
        )


def _joined(spans):
    label = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(label, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def find_secrets(
    docs: DataFrame,
    max_owners: int = 1,
    max_repositories: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository_col: str = "doc_id",
    owner_col: str = "source",
) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_owned, n_live, base_sha256, spans, findings) of every row of docs.

    findings: kind, start, end, hash of the secret, distinct repositories and owners that hold it, live (held by
    max_owners owners and max_repositories repositories at most). Where a table knows no repositories, a document stands
    for one, and its source for the owner: a string that one source repeats in many documents is a copied example. Secrets themselves are not returned. Positions are code points, ends exclusive.

    Null text has no spans. A null repository or owner counts as one more holder; a null id stays null. Repeated
    rows are each returned and don't add holders. An empty table gives no rows. Other columns are not looked at.
    A string that a third of all rows hold is counted partially before the shuffle; the join back splits it.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(repository_col).cast("string").alias("repository"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(text_col).alias("_text"),
    )
    scanned = written(rows.mapInArrow(_scan, _SCHEMA).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = scanned.where(F.size("candidates") > 0).select("row", "repository", "owner", F.explode("candidates").alias("c"))
    holders = (
        each.select("c.hash", F.struct("repository").alias("r"), F.struct("owner").alias("o"))
        .distinct()
        .groupBy("hash")
        .agg(F.count_distinct("r").alias("repositories"), F.count_distinct("o").alias("owners"))
    )
    judged = (
        each.select("row", "c.*")
        .join(holders, "hash")
        .withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))
        .where((F.col("kind") < 3) | F.col("live"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "repositories", "owners", "live"))).alias("findings"))
    )
    findings = F.coalesce(
        "findings",
        F.expr(
            "CAST(array() AS ARRAY<STRUCT<start: BIGINT, kind: INT, end: BIGINT, hash: STRING, "
            "repositories: BIGINT, owners: BIGINT, live: BOOLEAN>>)"
        ),
    )

    def number(kind: int):
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")

    return (
        scanned.select("row", "id")
        .join(judged, "row", "left")
        .select("id", findings.alias("findings"))
        .select(
            F.col("id").alias(id_col),
            *(number(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS)),
            F.size(F.filter("findings", lambda s: s["live"])).cast("long").alias("n_live"),
            F.sha2(_joined(F.filter("findings", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
            _joined(F.col("findings")).alias("spans"),
            "findings",
        )
    )
