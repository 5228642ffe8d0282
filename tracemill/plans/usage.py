"""Token usage and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.pricing import PRIORITY, STANDARD
from tracemill.operators import usage as U
from tracemill.plans import views as V
from tracemill.plans.activity import EV
from tracemill.plans.registry import register


def _values(tier: str, text: str) -> str:
    rows = []
    for i, line in enumerate(text.strip().splitlines()):
        name, *prices = line.split()
        rows.append(f"('{tier}', {i + 1}, '{name}', {', '.join(f'{p}::DOUBLE' for p in prices)})")
    return ", ".join(rows)


_PRICES = f"""prices(tier, ord, model, input, output, cache_read, cache_write) AS
  (VALUES {_values("standard", STANDARD)}, {_values("priority", PRIORITY)}),
  norm AS (SELECT *, replace(replace(lower(model), '.', '-'), '_', '-') AS nm FROM prices)"""


def _price_of(models: str, tier: str) -> str:
    """Prices of the `model` column of a relation, by ranked lookups."""
    return f"""SELECT model, input, output, cache_read, cache_write FROM (
      SELECT m.model, p.input, p.output, p.cache_read, p.cache_write,
        row_number() OVER (PARTITION BY m.model ORDER BY CASE
          WHEN p.tier = '{tier}' AND p.model = m.model THEN 1
          WHEN p.tier = '{tier}' AND p.model = m.nm THEN 2
          WHEN p.tier = 'standard' AND p.model = m.model THEN 3
          WHEN p.tier = 'standard' AND p.model = m.nm THEN 4
          WHEN p.tier = 'standard' AND (contains(m.nm, p.nm) OR contains(p.nm, m.nm)) THEN 5
          WHEN p.tier = 'standard' AND p.model = CASE WHEN contains(m.nm, 'claude') THEN 'claude-sonnet-4'
            WHEN contains(m.nm, 'gpt-4o-mini') THEN 'gpt-4o-mini' WHEN contains(m.nm, 'gpt-4o') THEN 'gpt-4o'
            WHEN contains(m.nm, 'gpt') THEN 'gpt-4o' END THEN 6 END, p.ord) AS rn,
        (p.tier = '{tier}' AND p.model IN (m.model, m.nm)) OR (p.tier = 'standard' AND
          (p.model IN (m.model, m.nm) OR contains(m.nm, p.nm) OR contains(p.nm, m.nm)
           OR p.model = CASE WHEN contains(m.nm, 'claude') THEN 'claude-sonnet-4'
            WHEN contains(m.nm, 'gpt') THEN 'gpt-4o' END)) AS fits
      FROM (SELECT DISTINCT model, replace(replace(lower(model), '.', '-'), '_', '-') AS nm
        FROM {models}) m JOIN norm p ON (p.tier = '{tier}' AND p.model IN (m.model, m.nm))
          OR (p.tier = 'standard' AND (p.model IN (m.model, m.nm) OR contains(m.nm, p.nm)
            OR contains(p.nm, m.nm) OR p.model = CASE WHEN contains(m.nm, 'claude') THEN 'claude-sonnet-4'
              WHEN contains(m.nm, 'gpt') THEN 'gpt-4o' END))) WHERE rn = 1"""


def _priced(tier: str = "standard", where: str = "true") -> str:
    return (
        EV
        + f""", {_PRICES}, counted AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, coalesce(message_id, event_id)
          ORDER BY event_ts, event_id) AS rn FROM ev
        WHERE tok_input IS NOT NULL AND source_kind = 'opencode_storage' AND {where}) WHERE rn = 1
      UNION ALL SELECT *, 1 FROM ev WHERE tok_input IS NOT NULL
        AND source_kind <> 'opencode_storage' AND event_type = 'assistant_message' AND {where}),
    price AS ({_price_of("counted", tier)}),
    rows_ AS (SELECT c.event_date AS day, session_id, c.model, event_ts, event_id, tok_input,
        tok_output + tok_reasoning AS billed, tok_reasoning, tok_cache_read, tok_cache_write,
        coalesce(tok_input * p.input / 1e6 + (tok_output + tok_reasoning) * p.output / 1e6
          + tok_cache_read * p.cache_read / 1e6 + tok_cache_write * p.cache_write / 1e6, 0) AS cost
      FROM counted c LEFT JOIN price p ON p.model = c.model)
    """
    )


_SUMS = """CAST(coalesce(sum(tok_input), 0) AS BIGINT) AS input,
  CAST(coalesce(sum(billed), 0) AS BIGINT) AS output,
  CAST(coalesce(sum(tok_reasoning), 0) AS BIGINT) AS reasoning,
  CAST(coalesce(sum(tok_cache_read), 0) AS BIGINT) AS cache_read,
  CAST(coalesce(sum(tok_cache_write), 0) AS BIGINT) AS cache_write,
  floor(coalesce(sum(cost), 0) * 100 + 0.5) / 100 AS cost_usd"""


@register("usage_total", _priced() + f"SELECT {_SUMS} FROM rows_")
def usage_total(spark, sf):
    return U.usage(V.agent_events(spark, sf, False))


@register("usage_by_day", _priced() + f"SELECT day, {_SUMS} FROM rows_ GROUP BY day")
def usage_by_day(spark, sf):
    return U.usage(V.agent_events(spark, sf, False), "day")


@register(
    "usage_by_session",
    _priced() + f"SELECT session_id, {_SUMS}, max_by(model, event_ts || event_id) AS model FROM rows_ GROUP BY session_id",
)
def usage_by_session(spark, sf):
    return U.usage(V.agent_events(spark, sf, False), "session")


@register("usage_by_model", _priced() + f"SELECT model, {_SUMS} FROM rows_ GROUP BY model")
def usage_by_model(spark, sf):
    return U.usage(V.agent_events(spark, sf, False), "model")


@register(
    "usage_by_model_priority",
    _priced("priority", "project_id = 'proj-1' AND event_time >= TIMESTAMP '2024-01-04 00:00:00'")
    + f"SELECT model, {_SUMS} FROM rows_ GROUP BY model",
)
def usage_by_model_priority(spark, sf):
    ev = V.agent_events(spark, sf, False)
    return U.usage(ev, "model", "priority", project="proj-1", since="2024-01-04T00:00:00Z")


@register(
    "usage_report",
    _priced()
    + f"""SELECT CASE grouping_id(day, session_id, model) WHEN 7 THEN 'total' WHEN 3 THEN 'day'
        WHEN 5 THEN 'session' ELSE 'model' END AS level,
      coalesce(day, session_id, model) AS key, {_SUMS}
    FROM rows_ GROUP BY GROUPING SETS ((), (day), (session_id), (model))""",
)
def usage_report(spark, sf):
    return U.usage_report(V.agent_events(spark, sf, False))


_NAMES_SQL = """names AS (SELECT DISTINCT CASE p_partkey % 12 WHEN 0 THEN 'claude-opus-4.1' WHEN 1 THEN 'GPT-5.2'
  WHEN 2 THEN 'gpt-5_nano' WHEN 3 THEN 'o3' WHEN 4 THEN 'claude-' || lower(p_brand)
  WHEN 5 THEN 'my-gpt-' || p_size WHEN 6 THEN 'gpt-4o-2024-' || p_size WHEN 7 THEN 'unknown'
  WHEN 8 THEN 'opus' WHEN 9 THEN 'gpt-4.1-mini' WHEN 10 THEN 'o' ELSE p_type END AS model FROM part)"""


def _names(spark, sf):
    text = _NAMES_SQL.removeprefix("names AS (").removesuffix(")")
    return spark.sql(text.replace("FROM part", "FROM {part}"), part=V.table(spark, sf, "part"))


def _price_models(name, tier):
    @register(
        name,
        f"""WITH {_NAMES_SQL}, {_PRICES}, price AS ({_price_of("names", tier)})
        SELECT n.model, p.input, p.output, p.cache_read, p.cache_write FROM names n
        LEFT JOIN price p ON p.model = n.model""",
    )
    def run(spark, sf):
        return U.price_models(_names(spark, sf), tier)


_price_models("price_models", "standard")
_price_models("price_models_priority", "priority")


# One message record per event pair; the provider follows from the model.
_MESSAGES_SQL = """messages AS (SELECT message_id, session_id, model,
    CASE WHEN model LIKE 'claude%' OR model LIKE 'mystery%' THEN 'anthropic' ELSE 'openai' END AS provider,
    epoch_ms(event_time) AS created_ms, tok_input AS input, tok_output AS output,
    tok_reasoning AS reasoning, tok_cache_read AS cache_read, tok_cache_write AS cache_write
  FROM ev WHERE event_type = 'assistant_message')"""


def _messages(spark, sf):
    ev = V.agent_events(spark, sf, False).where("event_type = 'assistant_message'")
    claude = F.col("model").startswith("claude") | F.col("model").startswith("mystery")
    return ev.select(
        "message_id",
        "session_id",
        "model",
        F.when(claude, "anthropic").otherwise("openai").alias("provider"),
        F.unix_millis("event_time").alias("created_ms"),
        *[F.col(f"tok_{t}").alias(t) for t in ("input", "output", "reasoning", "cache_read", "cache_write")],
    )


_SINCE = 1704412800000
_REPORT_PRICE = """CASE model WHEN 'claude-opus-4-5' THEN {0} WHEN 'claude-opus-4-1' THEN {1}
  WHEN 'claude-opus-4' THEN {1} WHEN 'claude-haiku-4-5' THEN {2} WHEN 'claude-haiku-3-5' THEN {3} ELSE {4} END"""
_REPORT_COST = " + ".join(
    f"{col} * {_REPORT_PRICE.format(*prices)} / 1e6"
    for col, prices in (
        ("input", (5, 15, 1, 0.8, 3)),
        ("output", (25, 75, 5, 4, 15)),
        ("cache_read", (0.5, 1.5, 0.1, 0.08, 0.3)),
        ("cache_write", (6.25, 18.75, 1.25, 1, 3.75)),
    )
)
_PROVIDER = (
    EV
    + f""", {_MESSAGES_SQL}, sel AS (SELECT * FROM messages
  WHERE provider = 'anthropic' AND created_ms > {_SINCE}), """
)
_REPORT_SUMS = """CAST(sum(coalesce(input, 0)) AS BIGINT) AS input,
  CAST(sum(coalesce(output, 0)) AS BIGINT) AS output,
  CAST(sum(coalesce(cache_read, 0)) AS BIGINT) AS cache_read,
  CAST(sum(coalesce(cache_write, 0)) AS BIGINT) AS cache_write, count(*) AS messages"""


@register(
    "provider_usage_by_model",
    _PROVIDER
    + f"""m AS (SELECT model, {_REPORT_SUMS} FROM sel GROUP BY model)
    SELECT *, floor(({_REPORT_COST}) * 100 + 0.5) / 100 AS cost_usd FROM m""",
)
def provider_usage_by_model(spark, sf):
    return U.provider_usage(_messages(spark, sf), "model", since_ms=_SINCE)


@register(
    "provider_usage_by_session",
    _PROVIDER
    + f"""m AS (SELECT session_id, {_REPORT_SUMS}, max_by(model, (created_ms, message_id, model)) AS model
      FROM sel GROUP BY session_id)
    SELECT *, floor(({_REPORT_COST}) * 100 + 0.5) / 100 AS cost_usd FROM m
    ORDER BY cost_usd DESC, session_id LIMIT 10""",
)
def provider_usage_by_session(spark, sf):
    return U.provider_usage(_messages(spark, sf), "session", since_ms=_SINCE)


@register(
    "provider_usage_total",
    _PROVIDER
    + f"""m AS (SELECT model, {_REPORT_SUMS} FROM sel GROUP BY model),
      c AS (SELECT *, {_REPORT_COST} AS cost FROM m)
    SELECT CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output,
      CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write,
      CAST(sum(messages) AS BIGINT) AS messages, floor(sum(cost) * 100 + 0.5) / 100 AS cost_usd FROM c""",
)
def provider_usage_total(spark, sf):
    return U.provider_usage(_messages(spark, sf), "total", since_ms=_SINCE)


@register(
    "provider_totals",
    _PROVIDER
    + f"""m AS (SELECT session_id, {_REPORT_SUMS}, CAST(sum(coalesce(reasoning, 0)) AS BIGINT) AS reasoning
      FROM sel GROUP BY session_id HAVING sum(input + output + cache_read + cache_write) > 0),
    t AS (SELECT CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output,
      CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write,
      CAST(sum(reasoning) AS BIGINT) AS reasoning, CAST(sum(messages) AS BIGINT) AS messages FROM m)
    SELECT *, input + output + cache_read + cache_write + reasoning AS total,
      floor(round((input * 3 + output * 15 + cache_read * 0.3 + cache_write * 3.75) / 1e6 * 100, 6)) / 100
        AS cost_usd FROM t""",
)
def provider_totals(spark, sf):
    return U.provider_totals(_messages(spark, sf), since_ms=_SINCE)
