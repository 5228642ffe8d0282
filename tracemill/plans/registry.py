"""Registered queries: a job over the driver tables and, where possible, its SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Registered:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def register(name: str, sql: str | None = None):
    """Decorator that enters a job, and its SQL text if it has one, under a name."""

    def enter(run):
        if name in REGISTRY:
            raise ValueError(f"registered twice: {name}")
        REGISTRY[name] = Registered(run, sql)
        return run

    return enter


def joined(column: str, alias: str | None = None) -> Column:
    """Array as text, for comparison."""
    return F.array_join(column, ",").alias(alias or column)


def rounded(column: str, digits: int = 6) -> Column:
    return F.round(column, digits).alias(column)
