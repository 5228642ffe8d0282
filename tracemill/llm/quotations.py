"""Conversations without their quotations, every message after the one it replies to.

Quoted lines are parsed by nesting level. Quoted passages, their paragraphs, lines and sentences are hashed after
normalising, and meet the hashes of what earlier messages of the conversation said themselves; of those that said the
longest match the last one before the quotation is what the message replies to. Threads follow one another by their first message, messages within a thread by turn.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import ranked, written

#: Least length of what is matched, unless the caller gives one.
MIN_CHARS = 1
_QUOTED = re.compile(r"^[ \t]*((?:>[ \t]?)+)(.*)$", re.S)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
#: A line that says whose words follow, in any language: it stands right before a quotation and ends in a colon.
_NAMED = re.compile(r"^.*\S.*:[ \t]*$")


def normalised(passage: str) -> str:
    return " ".join(re.findall(r"\w+", passage.lower()))


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(own words, quoted passages with their levels) of a message.

    A passage is a run of lines of one level; a line right before a quotation that ends in a colon, like `On .. wrote:`, goes with it.
    """
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        m = _QUOTED.match(line)
        level = m[1].count(">") if m else 0
        if level:
            if not last and own and _NAMED.match(own[-1]):
                own.pop()
            if level != last:
                passages.append((level, []))
            passages[-1][1].append(m[2])
        else:
            own.append(line)
        last = level
    return "\n".join(own).strip("\n"), [(level, "\n".join(lines)) for level, lines in passages]


def units(passage: str, min_chars: int = MIN_CHARS) -> list[dict]:
    """Hashes and lengths of a passage as a whole, its paragraphs, lines and sentences, as far as they are long enough."""
    blocks = [passage, *re.split(r"\n\s*\n", passage), *passage.split("\n")]
    parts = {normalised(p) for block in blocks for p in (block, *_SENTENCE.split(block))}
    return [
        {"hash": hashlib.sha256(p.encode()).hexdigest()[:32], "size": len(p)} for p in sorted(parts) if len(p) >= max(1, min_chars)
    ]


_UNIT = pa.struct([("hash", pa.string()), ("size", pa.int32())])
_SAID = "array<struct<hash: string, size: int>>"
_UNITS = f"conv string, turn long, role string, key long, said {_SAID}, quoted array<struct<level: int, units: {_SAID}>>"


def _units(min_chars: int):
    kind = pa.list_(pa.struct([("level", pa.int32()), ("units", pa.list_(_UNIT))]))

    def run(batches):
        for batch in batches:
            said, quoted = [], []
            for text in batch.column("_text"):
                own, passages = parse(text.as_py())
                said.append(units(own, min_chars))
                quoted.append([{"level": level, "units": units(p, min_chars)} for level, p in passages])
            columns = [batch.column(c) for c in ("conv", "turn", "role", "key")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(said, pa.list_(_UNIT)), pa.array(quoted, kind)],
                ["conv", "turn", "role", "key", "said", "quoted"],
            )

    return run


def _bodies(at: int):
    def run(batches):
        for batch in batches:
            bodies = pa.array([parse(t.as_py())[0] for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, bodies], [*batch.schema.names, "_body"])

    return run


def _last_said(units_: DataFrame) -> DataFrame:
    """(conv, turn, level, original): for each message and level, the last earlier message that said the longest of its matches."""
    quoted = (
        units_.where(F.size("quoted") > 0)
        .select("conv", "turn", F.explode("quoted").alias("q"))
        .select("conv", "turn", "q.level", F.explode("q.units").alias("u"))
        .select("conv", "turn", "level", "u.hash", "u.size")
        .distinct()
    )
    wanted = quoted.select(F.col("conv").alias("_c"), F.col("hash").alias("_h")).distinct()
    said = units_.select("conv", "turn", F.explode("said").alias("u")).select("conv", "turn", "u.hash")
    said = said.join(wanted, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("hash") == F.col("_h")), "left_semi").distinct()
    none = F.lit(None).cast("int")
    both = said.select("conv", "hash", "turn", none.alias("level"), none.alias("size"), F.lit(1).alias("order")).unionAll(
        quoted.select("conv", "hash", "turn", "level", "size", F.lit(0).alias("order"))
    )
    # in the order of turns, quotations before what the same turn says: one pass, however often a line is said
    before = Window.partitionBy("conv", "hash").orderBy("turn", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    said_turn = F.when(F.col("order") == 1, F.col("turn"))
    return (
        both.withColumn("original", F.last(said_turn, ignorenulls=True).over(before))
        .where("order = 0 AND original IS NOT NULL")
        .groupBy("conv", "turn", "level")
        .agg(F.max(F.struct("size", "original"))["original"].alias("original"))
    )


def _roots(replies: DataFrame) -> DataFrame:
    """(conv, turn, root) of the messages (conv, turn, parent): each step doubles the way to the root."""
    now = written(replies.withColumnRenamed("parent", "root"), "quotes-roots")
    while True:
        up = now.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), F.col("root").alias("_up"))
        step = now.join(up, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("root") == F.col("_t")), "left")
        if step.where("_up IS NOT NULL").isEmpty():
            return now
        now = written(step.select("conv", "turn", F.coalesce("_up", "root").alias("root")), "quotes-roots")


def link_quotations(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """(conv, turn, role, position, reply_to, thread, n_quotes, n_linked, body, formatted) of every message.

    reply_to is the turn whose words the outermost linked quotation repeats, null without one; thread the first turn
    of the chain of replies; position the place in the reply-ordered conversation, from 0. body is the message
    without quotations, formatted the same with its role's marks; the conversation is these texts by position. Words
    of fewer than min_chars normalised characters are not matched; 1 matches all that has any.

    Null text is an empty body, a null role is `user`; null conversations are one, null turns come first and neither
    quote nor are quoted. Repeated rows share a position. An empty table gives no rows. Other columns are not looked
    at. No conversation is gathered: its messages stay rows, and a hot one is ordered in ranges like all others.
    """
    rows = messages.select(
        F.col(conv_col).cast("string").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("user")).alias("role"),
        F.xxhash64(text_col).alias("key"),
        F.col(text_col).alias("_text"),
    )
    parsed = written(rows.mapInArrow(_units(min_chars), _UNITS), "quotes-units")
    linked = written(_last_said(parsed.where("turn IS NOT NULL")), "quotes-links")
    parents = linked.groupBy("conv", "turn").agg(
        F.min_by("original", "level").alias("parent"), F.count(F.lit(1)).alias("levels_linked")
    )
    roots = _roots(parents.select("conv", "turn", "parent"))
    facts = parents.join(roots.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), "root"), F.col("conv").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("_t"))).select(
        F.col("conv").alias("_conv"), F.col("turn").alias("_turn"), "parent", "levels_linked", "root"
    )

    def same(*names: str) -> Column:
        out = F.lit(True)
        for n in names:
            out &= F.col(n).eqNullSafe(F.col(f"_{n}"))
        return out

    narrow = (
        parsed.select("conv", "turn", "role", "key", F.size("quoted").alias("n_quotes"))
        .join(facts, same("conv", "turn"), "left")
        .withColumn("thread", F.coalesce("root", "turn"))
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv", "thread", "turn", "role", "key")]
    placed = ranked(narrow.drop("_conv", "_turn"), "quotes-order", *order)
    starts = placed.groupBy(F.col("conv").alias("_conv")).agg(F.min("_rank").alias("_first"))
    placed = (
        placed.join(starts, same("conv"))
        .groupBy("conv", "turn", "role", "key")
        .agg(
            F.min(F.col("_rank") - F.col("_first")).alias("position"),
            *(F.first(c).alias(c) for c in ("parent", "levels_linked", "thread", "n_quotes")),
        )
        .select(*(F.col(c).alias(f"_{c}") for c in ("conv", "turn", "role", "key")), "position", "parent", "levels_linked", "thread", "n_quotes")
    )
    kinds = "conv string, turn long, role string, key long, _text string, _body string"
    bodies = rows.mapInArrow(_bodies(4), kinds).drop("_text")
    return bodies.join(placed, same("conv", "turn", "role", "key")).select(
        F.col("conv").cast(messages.schema[conv_col].dataType).alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        "position",
        F.col("parent").alias("reply_to"),
        "thread",
        F.col("n_quotes").cast("long").alias("n_quotes"),
        F.coalesce("levels_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("_body").alias("body"),
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), "_body", F.lit("\n<|end|>\n")).alias("formatted"),
    )
