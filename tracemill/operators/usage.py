"""Token usage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.pricing import cents, cost, report_price, with_price
from tracemill.operators.filters import in_time_range

_TOKENS = ("input", "output", "reasoning", "cache_read", "cache_write")
# The source kind that repeats the tokens of a message on several events.
_REPEATING_KIND = "opencode_storage"


def counted_events(
    events: DataFrame,
    since: str | None = None,
    until: str | None = None,
    project: str | None = None,
    session: str | None = None,
) -> DataFrame:
    """Events whose tokens count: once per message, the earliest event of it.

    Other source kinds count their assistant messages only. The earliest event comes
    from an aggregate, so that one much repeated message is reduced before the shuffle.
    """
    in_range = in_time_range(since, until)
    if in_range is not None:
        events = events.where(in_range)
    if project:
        events = events.where(F.col("project_id") == project)
    if session:
        events = events.where(F.col("session_id") == session)
    with_tokens = events.where(F.col("tok_input").isNotNull())

    columns = ["event_ts", "event_id", "session_id", "model", *[f"tok_{t}" for t in _TOKENS]]
    message = F.coalesce(F.nullif("message_id", F.lit("")), F.col("event_id"))
    repeated = (
        with_tokens.where(F.col("source_kind") == _REPEATING_KIND)
        .groupBy("source_id", message.alias("message"))
        .agg(F.min(F.struct(*columns)).alias("first"))
        .select("first.*")
    )
    single = with_tokens.where(
        (F.col("source_kind") != _REPEATING_KIND) & (F.col("event_type") == "assistant_message")
    ).select(*columns)
    return repeated.unionByName(single)


def _priced(counted: DataFrame, tier: str) -> DataFrame:
    """Exact token sums per day, session and model, with the cost of each."""
    known = F.nullif("model", F.lit(""))
    sums = [F.sum(F.coalesce(f"tok_{t}", F.lit(0))).alias(t) for t in _TOKENS]
    grouped = counted.groupBy(
        F.split_part("event_ts", F.lit("T"), F.lit(1)).alias("day"),
        "session_id",
        F.coalesce(known, F.lit("unknown")).alias("model"),
    ).agg(
        *sums,
        F.max(F.when(known.isNotNull(), F.struct("event_ts", "event_id", known.alias("model")))).alias(
            "last_model"
        ),
    )
    # Reasoning tokens are billed as output.
    billed = grouped.withColumn("output", F.col("output") + F.col("reasoning"))
    tokens = {t: F.col(t) for t in ("input", "output", "cache_read", "cache_write")}
    return (
        with_price(billed, tier)
        .withColumn("cost", F.coalesce(cost(F.col("price"), tokens), F.lit(0.0)))
        .drop("price")
    )


def _totals() -> list[Column]:
    return [F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in _TOKENS] + [
        cents(F.coalesce(F.sum("cost"), F.lit(0.0))).alias("cost_usd")
    ]


def usage(events: DataFrame, by: str | None = None, tier: str = "standard", **restrict) -> DataFrame:
    """Token sums and cost in total (`by=None`) or by `day`, `session` or `model`."""
    priced = _priced(counted_events(events, **restrict), tier)
    if by is None:
        return priced.agg(*_totals())
    if by == "session":
        return (
            priced.where(F.nullif("session_id", F.lit("")).isNotNull())
            .groupBy("session_id")
            .agg(*_totals(), F.max("last_model")["model"].alias("model"))
        )
    return priced.groupBy(by).agg(*_totals())


def usage_report(events: DataFrame, tier: str = "standard", **restrict) -> DataFrame:
    """Total, by day, by session and by model in one pass: (level, key, sums, cost)."""
    priced = _priced(counted_events(events, **restrict), tier)
    sets = priced.groupingSets([[], ["day"], ["session_id"], ["model"]], "day", "session_id", "model")
    level = F.grouping_id()
    # Bits of the grouping id from left to right: day, session, model absent.
    name = (
        F.when(level == 7, "total").when(level == 3, "day").when(level == 5, "session").otherwise("model")
    )
    rows = sets.agg(
        name.alias("level"),
        F.when(level == 3, F.col("day"))
        .when(level == 5, F.col("session_id"))
        .when(level == 6, F.col("model"))
        .alias("key"),
        *_totals(),
    ).drop("day", "session_id", "model")
    return rows.where((F.col("level") != "session") | F.nullif("key", F.lit("")).isNotNull())


def price_models(models: DataFrame, tier: str = "standard") -> DataFrame:
    """(model, price fields) for each distinct model name; NULL without a price."""
    return with_price(models.select("model").distinct(), tier).select("model", "price.*")


def provider_usage(
    messages: DataFrame, by: str = "model", provider: str = "anthropic", since_ms: int = 0, limit: int = 10
) -> DataFrame:
    """Usage of one provider since a cutoff, from message records.

    `messages` holds provider, model, session_id, message_id, created_ms and token
    columns. `by` is `model`, `session` (the `limit` dearest sessions, priced by their
    latest model) or `total` (sum over models).
    """
    columns = ("input", "output", "cache_read", "cache_write")
    rows = messages.where((F.col("provider") == provider) & (F.col("created_ms") > since_ms))
    rows = rows.withColumn("model", F.coalesce("model", F.lit("unknown")))
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in columns]
    tokens = {c: F.col(c) for c in columns}
    price = report_price(F.col("model"))
    if by == "session":
        latest = F.max(F.struct("created_ms", "message_id", "model"))["model"]
        grouped = rows.groupBy("session_id").agg(*sums, F.count("*").alias("messages"), latest.alias("model"))
        return (
            grouped.withColumn("cost_usd", cents(cost(price, tokens)))
            .orderBy(F.desc("cost_usd"), "session_id")
            .limit(limit)
        )
    per_model = (
        rows.groupBy("model")
        .agg(*sums, F.count("*").alias("messages"))
        .withColumn("cost", cost(price, tokens))
    )
    if by == "model":
        return per_model.withColumn("cost_usd", cents(F.col("cost"))).drop("cost")
    return per_model.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*columns, "messages")],
        cents(F.coalesce(F.sum("cost"), F.lit(0.0))).alias("cost_usd"),
    )


def provider_totals(messages: DataFrame, provider: str = "anthropic", since_ms: int = 0) -> DataFrame:
    """Grand totals at the default price, reasoning included in the token total.

    Sessions without any input, output or cache token do not count. The cost is cut,
    not rounded, to cents.
    """
    columns = ("input", "output", "cache_read", "cache_write", "reasoning")
    rows = messages.where((F.col("provider") == provider) & (F.col("created_ms") > since_ms))
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in columns]
    sessions = rows.groupBy("session_id").agg(*sums, F.count("*").alias("messages"))
    raw = F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")
    totals = sessions.where(raw > 0).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*columns, "messages")]
    )
    tokens = {c: F.col(c) for c in ("input", "output", "cache_read", "cache_write")}
    default = report_price(F.lit(""))
    return totals.select(
        *columns,
        "messages",
        (raw + F.col("reasoning")).alias("total"),
        (F.floor(F.round(cost(default, tokens) * 100, 6)) / 100).alias("cost_usd"),
    )
