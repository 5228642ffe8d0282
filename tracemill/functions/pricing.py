"""Token prices and the choice of a price for a model name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# USD per million tokens as input, output, cache read, cache write. The
# order of the rows matters, because the first name that contains or is contained wins.
STANDARD = """
claude-opus-4-5 5 25 0.50 6.25
claude-opus-4-1 15 75 1.50 18.75
claude-opus-4 15 75 1.50 18.75
claude-sonnet-4-5 3 15 0.30 3.75
claude-sonnet-4-5-20250929 3 15 0.30 3.75
claude-sonnet-4 3 15 0.30 3.75
claude-sonnet-3-7 3 15 0.30 3.75
claude-haiku-4-5 1 5 0.10 1.25
claude-haiku-3-5 0.80 4 0.08 1
claude-3-5-sonnet 3 15 0.30 3.75
claude-3-5-sonnet-20241022 3 15 0.30 3.75
claude-3-5-haiku 0.80 4 0.08 1
claude-3-opus 15 75 1.50 18.75
claude-3-sonnet 3 15 0.30 3.75
claude-3-haiku 0.25 1.25 0.03 0.30
gpt-5.2 1.75 14.00 0.175 1.75
gpt-5.2-chat-latest 1.75 14.00 0.175 1.75
gpt-5.2-codex 1.75 14.00 0.175 1.75
gpt-5.1 1.25 10.00 0.125 1.25
gpt-5.1-chat-latest 1.25 10.00 0.125 1.25
gpt-5.1-codex 1.25 10.00 0.125 1.25
gpt-5.1-codex-max 1.25 10.00 0.125 1.25
gpt-5 1.25 10.00 0.125 1.25
gpt-5-chat-latest 1.25 10.00 0.125 1.25
gpt-5-codex 1.25 10.00 0.125 1.25
gpt-5-mini 0.25 2.00 0.025 0.25
gpt-5.1-codex-mini 0.25 2.00 0.025 0.25
gpt-5-nano 0.05 0.40 0.005 0.05
gpt-4o 2.50 10.00 1.25 2.50
gpt-4o-mini 0.15 0.60 0.075 0.15
gpt-4.1 2.00 8.00 0.50 2.00
gpt-4.1-mini 0.40 1.60 0.10 0.40
gpt-4.1-nano 0.10 0.40 0.025 0.10
o4-mini 1.10 4.40 0.275 1.10
o4-mini-deep-research 2.00 8.00 0.50 2.00
o3 2.00 8.00 0.50 2.00
o3-deep-research 10.00 40.00 2.50 10.00
o3-mini 1.10 4.40 0.55 1.10
o1-mini 1.10 4.40 0.55 1.10
codex-mini-latest 1.50 6.00 0.375 1.50
unknown 0 0 0 0
"""

PRIORITY = """
gpt-5.2 3.50 28.00 0.35 3.50
gpt-5.2-codex 3.50 28.00 0.35 3.50
gpt-5.1 2.50 20.00 0.25 2.50
gpt-5.1-codex 2.50 20.00 0.25 2.50
gpt-5.1-codex-max 2.50 20.00 0.25 2.50
gpt-5 2.50 20.00 0.25 2.50
gpt-5-codex 2.50 20.00 0.25 2.50
gpt-5-mini 0.45 3.60 0.045 0.45
gpt-4.1 3.50 14.00 0.875 3.50
gpt-4.1-mini 0.70 2.80 0.175 0.70
gpt-4.1-nano 0.20 0.80 0.05 0.20
gpt-4o 4.25 17.00 2.125 4.25
gpt-4o-mini 0.25 1.00 0.125 0.25
o3 3.50 14.00 0.875 3.50
o4-mini 2.00 8.00 0.50 2.00
"""

# The provider report knows these models and prices all others by default.
REPORT_MODELS = (
    "claude-opus-4-5",
    "claude-opus-4-1",
    "claude-opus-4",
    "claude-sonnet-4-5",
    "claude-sonnet-4-5-20250929",
    "claude-sonnet-4",
    "claude-haiku-4-5",
    "claude-haiku-3-5",
)
REPORT_DEFAULT = "claude-sonnet-4-5"

# Family of a name without a price of its own, and the price it takes.
FAMILIES = (
    ("claude", "claude-sonnet-4"),
    ("gpt-4o-mini", "gpt-4o-mini"),
    ("gpt-4o", "gpt-4o"),
    ("gpt", "gpt-4o"),
)

FIELDS = ("input", "output", "cache_read", "cache_write")


def price_rows(tier: str) -> list[tuple[str, float, float, float, float]]:
    text = PRIORITY if tier == "priority" else STANDARD
    split = [line.split() for line in text.strip().splitlines()]
    return [(name, *map(float, prices)) for name, *prices in split]


def _normal(name: str) -> str:
    return name.lower().replace(".", "-").replace("_", "-")


def _normal_column(model: Column) -> Column:
    return F.translate(F.lower(model), "._", "--")


def _price_sql(row: tuple) -> str:
    fields = ", ".join(f"'{f}', {v!r}D" for f, v in zip(FIELDS, row[1:]))
    return f"named_struct({fields})"


def _prices_by_name(rows: list[tuple]) -> Column:
    """Literal map from model name to price."""
    return F.expr("map(" + ", ".join(f"'{r[0]}', {_price_sql(r)}" for r in rows) + ")")


def with_price(rows: DataFrame, tier: str = "standard") -> DataFrame:
    """Adds the price struct of the `model` column, NULL where nothing fits.

    In order: the name, its normal form, both in the standard tier, the first table row
    whose normal name contains or is contained in it, the family. The last two are one
    CASE over literals that yields a model name, so that it compiles to plain code.
    """
    named = rows.withColumn("_normal", _normal_column(F.col("model")))
    standard = price_rows("standard")
    cases = [
        f"WHEN contains(_normal, '{_normal(r[0])}') OR contains('{_normal(r[0])}', _normal) THEN '{r[0]}'"
        for r in standard
    ]
    cases += [f"WHEN contains(_normal, '{part}') THEN '{name}'" for part, name in FAMILIES]
    similar = F.expr("CASE " + " ".join(cases) + " END")
    direct = []
    for table in {tier: price_rows(tier), "standard": standard}.values():
        prices = _prices_by_name(table)
        direct += [F.try_element_at(prices, F.col("model")), F.try_element_at(prices, F.col("_normal"))]
    fallback = F.try_element_at(_prices_by_name(standard), F.col("_similar"))
    found = F.coalesce(*direct)
    return (
        named.withColumn("_direct", found)
        .withColumn("_similar", F.when(F.col("_direct").isNull(), similar))
        .withColumn("price", F.coalesce("_direct", fallback))
        .drop("_normal", "_direct", "_similar")
    )


def report_price(model: Column) -> Column:
    """Price struct in the provider report: exact name, else the default."""
    by_name = {r[0]: r for r in price_rows("standard")}
    known = _prices_by_name([by_name[m] for m in REPORT_MODELS])
    return F.coalesce(F.try_element_at(known, model), F.expr(_price_sql(by_name[REPORT_DEFAULT])))


def cost(price: Column, tokens: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for field in FIELDS:
        total = total + tokens[field] * price[field] / F.lit(1_000_000)
    return total


def cents(value: Column) -> Column:
    """Half-up rounding to cents."""
    return F.floor(value * 100 + 0.5) / 100
