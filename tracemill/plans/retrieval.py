"""Full-text search, fusion, reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.analysis import PLAIN, Analyzer
from tracemill.functions.relevance import CONCRETE_MARKS, concreteness, token_overlap
from tracemill.operators import fusion as X
from tracemill.operators import patterns as P
from tracemill.operators import search as S
from tracemill.operators import segments as G
from tracemill.operators.filters import EventFilter
from tracemill.plans import views as V
from tracemill.plans.activity import _ERROR_SQL, EV, MSG
from tracemill.plans.registry import register, rounded
from tracemill.session import run_folder

DOCS = f"WITH docs AS ({V.DOCUMENTS_SQL}) "
_TOKEN = r"[\p{L}\p{N}]+"


def _tokens(column: str) -> str:
    return f"coalesce(regexp_extract_all(lower({column}), '{_TOKEN}'), [])"


def _phrase_count(tokens: str, phrase: list[str]) -> str:
    test = " AND ".join(f"{tokens}[i + {k}] = '{w}'" for k, w in enumerate(phrase))
    return f"len(list_filter(range(1, len({tokens}) + 1), lambda i: {test}))"


def _bm25(corpus: str, doc_id: str, columns: list[str], phrases: list[list[str]], prefix: str = "") -> str:
    """CTEs that end in `{prefix}scored(doc_id, score)` for an OR of phrases."""
    p = prefix
    tokens = ", ".join(f"{_tokens(c)} AS t{i}" for i, c in enumerate(columns))
    length = " + ".join(f"len(t{i})" for i in range(len(columns)))
    counts = " UNION ALL ".join(
        f"SELECT doc_id, n, {k} AS phrase, "
        + " + ".join(_phrase_count(f"t{i}", phrase) for i in range(len(columns)))
        + f" AS tf FROM {p}tok"
        for k, phrase in enumerate(phrases)
    )
    return f"""{p}tok AS (SELECT doc_id, {length} AS n, {", ".join(f"t{i}" for i in range(len(columns)))}
        FROM (SELECT {doc_id} AS doc_id, {tokens} FROM {corpus})),
      {p}corpus AS (SELECT count(*) AS docs, avg(n) AS mean FROM {p}tok),
      {p}tf AS (SELECT * FROM ({counts}) WHERE tf > 0),
      {p}idf AS (SELECT phrase, greatest(ln((docs - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf
        FROM {p}tf, {p}corpus GROUP BY phrase, docs),
      {p}scored AS (SELECT doc_id, sum(idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score
        FROM {p}tf JOIN {p}idf USING (phrase), {p}corpus GROUP BY doc_id)"""


_HIT = """m.event_id, m.event_type, m.text_redacted, m.session_id, m.project_id, m.event_ts,
  round(score, 6) AS score"""


def _hits(rows):
    return rows.select(
        "event_id", "event_type", "text_redacted", "session_id", "project_id", "event_ts", rounded("score")
    )


#: Indexes that this session has stored, by table and analyzer.
_STORED: dict[tuple, str] = {}


def _index(spark, sf, name, docs, doc_id, columns, analyzer=PLAIN):
    """The stored index of a view; the first query of a session that asks for it writes it."""
    key = (spark.sparkContext.applicationId, sf, name, analyzer)
    if key not in _STORED:
        folder = run_folder(spark, f"index-{name}")
        G.append(docs, folder, doc_id, columns, analyzer)
        _STORED[key] = folder
    return G.open_index(spark, _STORED[key], analyzer)


def _message_index(spark, sf, analyzer=PLAIN):
    msg = V.agent_messages(spark, sf)
    return msg, _index(spark, sf, "messages", msg, "event_id", ["text_redacted", "tool_name"], analyzer)


def _document_index(spark, sf):
    docs = V.documents(spark, sf)
    return docs, _index(spark, sf, "documents", docs, "id", ["content"])


def _search(name, query, phrases, flt=EventFilter(), where="true", limit=20, offset=0):
    sql = (
        MSG
        + f""", {_bm25("msg", "event_id", ["text_redacted"], phrases)}
        SELECT {_HIT} FROM scored s JOIN msg m ON m.event_id = s.doc_id WHERE {where}
        ORDER BY s.score DESC, event_id LIMIT {limit} OFFSET {offset}"""
    )

    @register(name, sql)
    def run(spark, sf):
        msg, index = _message_index(spark, sf)
        return _hits(S.search(msg, index, query, flt, limit, offset))


_search("search_term", "that", [["that"]])
_search("search_phrase", "of the", [["of", "the"]], offset=10)
_search("search_or", r"(tion\|thing)|from this", [["tion"], ["thing"], ["from", "this"]], limit=50)
_search(
    "search_filtered",
    "/with/ OR that",
    [["with"], ["that"]],
    EventFilter(role="user", since="2024-01-01T12:00:00Z", until="2024-01-04", project="proj-*"),
    "event_type = 'user_message' AND event_time >= TIMESTAMP '2024-01-01 12:00:00'"
    " AND event_time <= TIMESTAMP '2024-01-04 00:00:00'",
)


@register(
    "search_total",
    MSG
    + f""", {_bm25("msg", "event_id", ["text_redacted"], [["that"], ["with"]])}
    SELECT count(*) AS total FROM scored JOIN msg ON event_id = doc_id
    WHERE event_type = 'assistant_message'""",
)
def search_total(spark, sf):
    msg, index = _message_index(spark, sf)
    return S.search_total(msg, index, "that|with", EventFilter(event_types=("assistant_message",)))


@register(
    "search_all_of",
    MSG
    + f""", {_bm25("msg", "event_id", ["text_redacted"], [["that"], ["of", "the"]])}, full_ AS (
      SELECT doc_id FROM tf GROUP BY doc_id HAVING count(DISTINCT phrase) = 2)
    SELECT {_HIT} FROM scored s JOIN full_ USING (doc_id) JOIN msg m ON m.event_id = doc_id
    ORDER BY s.score DESC, event_id LIMIT 20""",
)
def search_all_of(spark, sf):
    msg, index = _message_index(spark, sf)
    return _hits(S.search(msg, index, '"that" "of the"'))


# Queries derived from the data: one per customer segment, plus a phrase each.
_QUERIES_SQL = """queries AS (SELECT DISTINCT 'q' || (c_nationkey % 5) AS query_id,
  CASE c_nationkey % 5 WHEN 0 THEN 'that thing' WHEN 1 THEN 'of the' WHEN 2 THEN 'tion from'
    WHEN 3 THEN 'with' ELSE 'the and' END AS text FROM customer)"""
_QUERY_PHRASES = {
    "q0": [["that", "thing"]],
    "q1": [["of", "the"]],
    "q2": [["tion", "from"]],
    "q3": [["with"]],
    "q4": [["the"]],
}


def _queries(spark, sf):
    text = _QUERIES_SQL.removeprefix("queries AS (").removesuffix(")")
    return spark.sql(
        text.replace("FROM customer", "FROM {customer}").replace("'q' || (", "'q' || CAST((").replace(
            "% 5) AS query_id", "% 5) AS STRING) AS query_id"
        ),
        customer=V.table(spark, sf, "customer"),
    )


@register(
    "search_many",
    MSG
    + ", "
    + ", ".join(
        _bm25("msg", "event_id", ["text_redacted"], phrases, f"{q}_") for q, phrases in _QUERY_PHRASES.items()
    )
    + ", every AS ("
    + " UNION ALL ".join(f"SELECT '{q}' AS query_id, * FROM {q}_scored" for q in _QUERY_PHRASES)
    + """), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
      FROM every) SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 20""",
)
def search_many(spark, sf):
    _, index = _message_index(spark, sf)
    return S.search_many(index, _queries(spark, sf)).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", rounded("score")
    )


@register("search_stemmed")
def search_stemmed(spark, sf):
    msg, index = _message_index(spark, sf, Analyzer(stemming=True))
    return _hits(S.search(msg, index, "things|tions"))


@register(
    "postings_by_term",
    MSG
    + f""", t AS (SELECT event_id, unnest({_tokens("text_redacted")}) AS term FROM msg)
    SELECT term, count(*) AS n, count(DISTINCT event_id) AS docs FROM t GROUP BY term""",
)
def postings_by_term(spark, sf):
    _, index = _message_index(spark, sf)
    per_doc = index.postings(None).groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@register(
    "text_lengths",
    DOCS + f"SELECT id AS doc_id, len({_tokens('content')}) AS n_terms FROM docs",
)
def text_lengths(spark, sf):
    _, index = _document_index(spark, sf)
    return index.lengths.withColumn("n_terms", F.col("n_terms").cast("bigint"))


@register(
    "errors",
    EV
    + f""", {_bm25("ev", "event_id", ["text_redacted", "tool_name"],
                  [["error"], ["error"], ["error"], ["failed"], ["failed"]])}
    SELECT * FROM (SELECT m.event_id, m.event_type, m.text_redacted, m.session_id, m.project_id, m.event_ts,
      round(score, 6) AS score FROM scored s JOIN ev m ON m.event_id = s.doc_id
    WHERE event_type = 'tool_result' AND tool_name IN ('Bash', 'bash')
      AND event_time >= TIMESTAMP '2024-01-03 00:00:00'
    ORDER BY s.score DESC, event_id LIMIT 50) WHERE {_ERROR_SQL}""",
)
def errors(spark, sf):
    ev = V.agent_events(spark, sf)
    index = _index(spark, sf, "events", ev, "event_id", ["text_redacted", "tool_name"])
    return _hits(S.errors(ev, index, EventFilter(since="2024-01-03")))


_DOC = "d.id, d.created_at, length(d.content) AS n_chars, round(score, 6) AS score"


def _doc_columns(rows):
    return rows.select(
        "id", "created_at", F.length("content").cast("bigint").alias("n_chars"), rounded("score")
    )


@register(
    "doc_fts",
    DOCS
    + f""", {_bm25("docs", "id", ["content"], [["that"], ["from", "the"], ["pour"]])}
    SELECT {_DOC} FROM scored s JOIN docs d ON d.id = s.doc_id ORDER BY s.score DESC, id LIMIT 20""",
)
def doc_fts(spark, sf):
    docs, index = _document_index(spark, sf)
    return _doc_columns(S.doc_search(docs, index, 'that OR "from the" OR pour'))


@register(
    "doc_like",
    DOCS
    + """SELECT id, created_at, length(content) AS n_chars, 1.0::DOUBLE AS score FROM docs
    WHERE content ILIKE '%th_t%from%' ORDER BY id LIMIT 20""",
)
def doc_like(spark, sf):
    return _doc_columns(S.doc_like(V.documents(spark, sf), "th.t.*from"))


def _words_sql(column: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(regexp_replace(lower({column}), '[^a-z0-9\\s]', ' ', 'g'),"
        " '\\s+'), lambda w: length(w) > 2)"
    )


def _overlap_sql(query: str, content: str) -> str:
    q, c = _words_sql(query), _words_sql(content)
    return (
        f"CASE WHEN len({q}) = 0 OR len({c}) = 0 THEN 0.0 ELSE "
        f"len(list_filter({q}, lambda w: list_contains({c}, w))) / len({q})::DOUBLE END"
    )


@register(
    "token_overlap",
    DOCS + f"SELECT id, round({_overlap_sql(repr('From this, that thing!'), 'content')}, 6) AS overlap FROM docs",
)
def overlap(spark, sf):
    docs = V.documents(spark, sf)
    share = token_overlap(F.lit("From this, that thing!"), F.col("content"))
    return docs.select("id", F.round(share, 6).alias("overlap"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MARKS_SQL = " + ".join(f"CAST(regexp_matches(content, {_quoted(m)}) AS INT)" for m in CONCRETE_MARKS)


@register("concreteness", DOCS + f"SELECT id, CAST({_MARKS_SQL} AS BIGINT) AS marks FROM docs")
def marks(spark, sf):
    return V.documents(spark, sf).select("id", concreteness(F.col("content")).cast("bigint").alias("marks"))


@register(
    "filter_documents",
    DOCS
    + """SELECT id FROM docs WHERE source IN ('src1') AND lang IN ('en', 'fr')
      AND coalesce(try_cast(created_at AS TIMESTAMPTZ) >= TIMESTAMPTZ '2024-03-01 00:00:00Z', true)
      AND coalesce(try_cast(created_at AS TIMESTAMPTZ) <= TIMESTAMPTZ '2024-10-01 00:00:00Z', true)""",
)
def filter_documents(spark, sf):
    flt = X.DocumentFilter("src1", ("en", "fr"), "2024-03-01", "2024-10-01")
    return X.filter_documents(V.documents(spark, sf), flt).select("id")


@register(
    "load_documents",
    """SELECT CAST(doc_id AS VARCHAR) AS id, text AS content FROM documents
    WHERE doc_id % 17 <> 0 AND length(text) > 0""",
)
def load_documents(spark, sf):
    raw = V.table(spark, sf, "documents").selectExpr(
        "CASE WHEN doc_id % 17 <> 0 THEN CAST(doc_id AS STRING) ELSE '' END AS id", "text AS content"
    )
    return X.valid_documents(raw)


# A plan per query: some actions lack a text or a weight, one query has none, one has a
# weight out of range.
_PLAN_SQL = """plan AS (SELECT DISTINCT 'q' || (c_nationkey % 5) AS query_id,
    c_nationkey // 5 + 1 AS action_id,
    CASE WHEN c_nationkey // 5 % 3 = 1 THEN 'regex_like' ELSE 'fts' END AS type,
    CASE c_nationkey // 5 WHEN 0 THEN 'that OR tion' WHEN 1 THEN 'th.t.*from' WHEN 2 THEN ''
      WHEN 3 THEN 'from OR "of the"' ELSE 'Than' END AS text,
    CASE WHEN c_nationkey % 5 = 3 AND c_nationkey // 5 = 0 THEN 3.0
      WHEN c_nationkey // 5 = 3 THEN 0.5 WHEN c_nationkey // 5 = 1 THEN 1.5 END AS weight
  FROM customer WHERE c_nationkey % 5 <> 4)"""
_VALID_SQL = f"""{_QUERIES_SQL}, {_PLAN_SQL},
  judged AS (SELECT query_id, bool_and(coalesce(weight BETWEEN 0 AND 2, true)) AS ok FROM plan
    GROUP BY query_id),
  valid AS (SELECT p.query_id, action_id, type, text, CAST(coalesce(weight, 1.0) AS DOUBLE) AS weight
      FROM plan p JOIN judged j ON j.query_id = p.query_id AND ok WHERE text <> ''
    UNION ALL SELECT q.query_id, a.action_id, 'fts', CASE a.action_id WHEN 1 THEN text ELSE '"' || text || '"' END,
      CASE a.action_id WHEN 1 THEN 1.0 ELSE 1.2 END
    FROM queries q, (VALUES (1), (2)) a(action_id)
    WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.query_id = q.query_id AND ok))"""


def _plan(spark, sf):
    return spark.sql(
        """SELECT DISTINCT concat('q', c_nationkey % 5) AS query_id, c_nationkey DIV 5 + 1 AS action_id,
          CASE WHEN c_nationkey DIV 5 % 3 = 1 THEN 'regex_like' ELSE 'fts' END AS type,
          CASE c_nationkey DIV 5 WHEN 0 THEN 'that OR tion' WHEN 1 THEN 'th.t.*from' WHEN 2 THEN ''
            WHEN 3 THEN 'from OR "of the"' ELSE 'Than' END AS text,
          CAST(CASE WHEN c_nationkey % 5 = 3 AND c_nationkey DIV 5 = 0 THEN 3.0
            WHEN c_nationkey DIV 5 = 3 THEN 0.5 WHEN c_nationkey DIV 5 = 1 THEN 1.5 END AS DOUBLE) AS weight
        FROM {customer} WHERE c_nationkey % 5 <> 4""",
        customer=V.table(spark, sf, "customer"),
    )


@register(
    "plan_fallback",
    f"WITH {_VALID_SQL} SELECT query_id, CAST(action_id AS BIGINT) AS action_id, type, text, weight FROM valid",
)
def plan_fallback(spark, sf):
    plan = X.validate_plan(_plan(spark, sf), _queries(spark, sf))
    return plan.withColumn("action_id", F.col("action_id").cast("bigint"))


@register(
    "query_keywords",
    f"""WITH {_QUERIES_SQL} SELECT query_id, array_to_string(list_filter(
      regexp_split_to_array(text, '\\s+'), lambda w: length(w) > 2), ' ') AS keywords FROM queries""",
)
def query_keywords(spark, sf):
    return X.query_keywords(_queries(spark, sf)).withColumn("keywords", F.array_join("keywords", " "))


@register(
    "plan_log_summary",
    f"""WITH {_VALID_SQL}, n AS (SELECT query_id, count(*) AS actions FROM valid GROUP BY query_id)
    SELECT text AS query, actions, len(list_filter(regexp_split_to_array(text, '\\s+'),
      lambda w: length(w) > 2)) AS keywords FROM queries JOIN n USING (query_id)
    ORDER BY query_id DESC LIMIT 5""",
)
def plan_log_summary(spark, sf):
    queries = _queries(spark, sf)
    records = X.plan_records(X.validate_plan(_plan(spark, sf), queries), queries, "2024-01-01T00:00:00Z")
    return X.plan_log_summary(records).withColumns(
        {c: F.col(c).cast("bigint") for c in ("actions", "keywords")}
    )


# Phrases of each valid action, written out for the comparison.
_K = 5
_FTS_ACTIONS = {
    ("q0", 1): [["that"], ["tion"]],
    ("q0", 4): [["from"], ["of", "the"]],
    ("q1", 1): [["that"], ["tion"]],
    ("q1", 4): [["from"], ["of", "the"]],
    ("q2", 1): [["that"], ["tion"]],
    ("q2", 4): [["from"], ["of", "the"]],
    ("q3", 1): [["with"]],
    ("q3", 2): [["with"]],
    ("q4", 1): [["the"]],
    ("q4", 2): [["the"]],
    ("q0", 2147483647): [["that", "thing"]],
    ("q1", 2147483647): [["of", "the"]],
    ("q2", 2147483647): [["tion", "from"]],
    ("q3", 2147483647): [["with"]],
    ("q4", 2147483647): [["the"]],
}
_PHRASE_LISTS: list[list[list[str]]] = []
for _phrases in _FTS_ACTIONS.values():
    if _phrases not in _PHRASE_LISTS:
        _PHRASE_LISTS.append(_phrases)


def _action_hits() -> str:
    parts = []
    for (q, a), phrases in _FTS_ACTIONS.items():
        k = _PHRASE_LISTS.index(phrases)
        parts.append(f"SELECT '{q}' AS query_id, {a} AS action_id, 'fts' AS type, doc_id AS id, score FROM f{k}_scored")
    for q in ("q0", "q1", "q2"):
        for action, pattern in ((2, "%th_t%from%"), (5, "%Than%")):
            parts.append(
                f"SELECT '{q}', {action}, 'regex_like', id, 1.0 FROM docs WHERE content ILIKE '{pattern}'"
            )
    return " UNION ALL ".join(parts)


_BM25_ALL = ", ".join(
    _bm25("docs", "id", ["content"], phrases, f"f{k}_") for k, phrases in enumerate(_PHRASE_LISTS)
)
_FUSED_SQL = f"""{_VALID_SQL}, {_BM25_ALL},
  strict AS (SELECT * FROM valid UNION ALL
    SELECT query_id, 2147483647, 'fts', '"' || text || '"', 1.2 FROM queries),
  all_hits AS ({_action_hits()}),
  kept AS (SELECT c.*, d.content FROM all_hits c JOIN docs d USING (id) WHERE d.lang IN ('en', 'fr')),
  normed AS (SELECT k.query_id, k.id, k.content,
      k.score / greatest(max(k.score) OVER (PARTITION BY k.query_id, k.action_id), 1.0) AS s,
      v.weight * CASE v.type WHEN 'regex_like' THEN 1.2 ELSE 0.95 END AS w
    FROM kept k JOIN strict v ON v.query_id = k.query_id AND v.action_id = k.action_id),
  merged AS (SELECT query_id, id, content, sum(s * w) / sum(w) AS base, count(*) AS n
    FROM normed GROUP BY query_id, id, content),
  judged_ AS (SELECT m.*, CAST({_MARKS_SQL} AS DOUBLE) AS marks,
      {_overlap_sql("q.text", "content")} AS overlap FROM merged m JOIN queries q USING (query_id)),
  final AS (SELECT query_id, id, base + marks / greatest(length(content) / 500.0, 1) * 0.2
      + least(n, 6) * 0.01 + overlap * 1.8 - CASE WHEN marks = 0 THEN 0.1 ELSE 0 END AS score
    FROM judged_),
  fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY score DESC, id) AS rank FROM final) WHERE rank <= {_K})"""


def _fused(spark, sf, k=_K):
    docs, index = _document_index(spark, sf)
    queries = _queries(spark, sf)
    plan = X.validate_plan(_plan(spark, sf), queries)
    return X.fused_search(docs, index, plan, queries, X.DocumentFilter(tags=("en", "fr")), k)


@register(
    "fused_search",
    DOCS
    + f", {_FUSED_SQL} SELECT query_id, rank, id, round(score, 6) AS score FROM fused",
)
def fused_search(spark, sf):
    return _fused(spark, sf).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "id", rounded("score")
    )


@register(
    "rerank",
    DOCS
    + f""", {_FUSED_SQL}, given AS (SELECT query_id, id,
        CAST(ascii(right(id, 1)) % 10 AS DOUBLE) AS judged FROM fused WHERE rank <> 2),
      mixed AS (SELECT f.query_id, f.id, f.score AS original_score, coalesce(judged, 5.0) AS judged,
        coalesce(judged, 5.0) * 0.7 + f.score / greatest(max(f.score) OVER (PARTITION BY f.query_id), 1.0)
          * 10 * 0.3 AS score FROM fused f LEFT JOIN given g ON g.query_id = f.query_id AND g.id = f.id),
      best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank
        FROM mixed)
    SELECT query_id, id, rank, judged, round(original_score, 6) AS original_score, round(score, 6) AS score
    FROM best WHERE rank <= 3""",
)
def rerank(spark, sf):
    hits = _fused(spark, sf)
    judgements = hits.where("rank <> 2").select(
        "query_id", "id", (F.ascii(F.right("id", F.lit(1))) % 10).cast("double").alias("score")
    )
    return X.rerank(hits, judgements, 3).select(
        "query_id",
        "id",
        F.col("rank").cast("bigint").alias("rank"),
        "judged",
        rounded("original_score"),
        rounded("score"),
    )


@register(
    "answer_context",
    DOCS
    + f""", {_FUSED_SQL} SELECT query_id, string_agg('[' || rank || '] ' || d.content,
      chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
    FROM fused JOIN docs d USING (id) GROUP BY query_id""",
)
def answer_context(spark, sf):
    return X.answer_context(_fused(spark, sf), V.documents(spark, sf))


# Documents that say nothing but a query's text, planted among the others; one query expects another's.
_PLANTED_SQL = f"""{_QUERIES_SQL}, planted AS (SELECT id, content FROM docs
    UNION ALL SELECT 'planted-' || query_id, text FROM queries)"""


@register(
    "hit_at_1",
    DOCS
    + f""", {_PLANTED_SQL}, """
    + ", ".join(_bm25("planted", "id", ["content"], phrases, f"{q}_") for q, phrases in _QUERY_PHRASES.items())
    + """, firsts AS ("""
    + " UNION ALL ".join(
        f"SELECT '{q}' AS query_id, (SELECT doc_id FROM {q}_scored ORDER BY score DESC, doc_id LIMIT 1) AS f" for q in _QUERY_PHRASES
    )
    + """), expected AS (SELECT query_id, 'planted-' || CASE query_id WHEN 'q3' THEN 'q4' ELSE query_id END AS e FROM queries)
    SELECT count(*) AS tests, count(*) FILTER (f = e) AS passes,
      round(count(*) FILTER (f = e) * 100 / count(*), 1) AS accuracy
    FROM expected JOIN firsts USING (query_id)""",
)
def hit_at_1(spark, sf):
    queries = _queries(spark, sf)
    planted = queries.select(F.concat(F.lit("planted-"), "query_id").alias("id"), F.col("text").alias("content"))
    docs = V.documents(spark, sf).select("id", "content").unionByName(planted)
    index = _index(spark, sf, "planted", docs, "id", ["content"])
    ranked = S.search_many(index, queries, 1).withColumnRenamed("doc_id", "id")
    expects = F.when(F.col("query_id") == "q3", "q4").otherwise(F.col("query_id"))
    return X.hit_at_1(ranked, queries.select("query_id", F.concat(F.lit("planted-"), expects).alias("expected_id")))


# Hundreds of loose patterns: for every third document a few words of it with something left out.
_MANY_SQL = r"""asked AS (SELECT DISTINCT CASE n % 3 WHEN 0 THEN w[3] || '.*' || w[7] WHEN 1 THEN left(w[4], 2) || '.' || w[5]
    ELSE w[5] || ' ' || w[6] END AS pattern
  FROM (SELECT CAST(right(id, 8) AS BIGINT) // 3 AS n, string_split(replace(content, chr(10), ' '), ' ') AS w FROM docs
    WHERE CAST(right(id, 8) AS BIGINT) % 3 = 0) WHERE len(w) > 8),
  liked AS (SELECT pattern, regexp_matches(pattern, '[.?%_]') AS wild, '(?s)' || replace(replace(replace(replace(replace(
    regexp_escape(lower(pattern)), '\.\*', '.*'), '\.', '.'), '\?', '.'), '_', '.'), '\%', '.*') AS body
    FROM asked WHERE pattern IS NOT NULL)"""


@register(
    "pattern_many",
    DOCS
    + f""", {_MANY_SQL} SELECT pattern, count(*) AS docs, min(id) AS first_id FROM liked
    JOIN docs ON CASE WHEN wild THEN regexp_matches(lower(content), body) ELSE contains(lower(content), lower(pattern)) END GROUP BY pattern""",
)
def pattern_many(spark, sf):
    docs = V.documents(spark, sf)
    number = F.right("id", F.lit(8)).cast("bigint")
    word = F.split(F.replace("content", F.lit("\n"), F.lit(" ")), " ")
    some = docs.where(number % 3 == 0).select(F.floor(number / 3).alias("n"), word.alias("w")).where(F.size("w") > 8)
    at = lambda i: F.element_at("w", F.lit(i))
    pattern = (
        F.when(F.col("n") % 3 == 0, F.concat(at(3), F.lit(".*"), at(7)))
        .when(F.col("n") % 3 == 1, F.concat(F.left(at(4), F.lit(2)), F.lit("."), at(5)))
        .otherwise(F.concat(at(5), F.lit(" "), at(6)))
    )
    found = P.pattern_hits(docs.select("id", "content"), some.select(pattern.alias("text")).distinct())
    return found.groupBy(F.col("text").alias("pattern")).agg(F.count("*").alias("docs"), F.min("id").alias("first_id"))


@register(
    "search_after_changes",
    DOCS
    + f""", current AS (SELECT id, CASE WHEN CAST(right(id, 8) AS BIGINT) % 7 = 0 THEN content || ' of the' ELSE content END AS content
      FROM docs WHERE source <> 'src3'),
    {_bm25("current", "id", ["content"], [["of", "the"], ["that"]])}
    SELECT s.doc_id AS id, round(score, 6) AS score FROM scored s ORDER BY s.score DESC, id LIMIT 50""",
)
def search_after_changes(spark, sf):
    """An index that grew by two segments, one of which replaced documents, lost a source and was merged in part."""
    docs = V.documents(spark, sf).select("id", "content", F.get_json_object("metadata", "$.source").alias("source"))
    number = F.right("id", F.lit(8)).cast("bigint")
    folder = run_folder(spark, "index-changes")
    first = G.append(docs.where(number % 3 > 0), folder, "id", ["content"], PLAIN)
    second = G.append(docs.where(number % 3 == 0), folder, "id", ["content"], PLAIN)
    changed = docs.where(number % 7 == 0).withColumn("content", F.concat("content", F.lit(" of the")))
    G.append(changed, folder, "id", ["content"], PLAIN)
    G.delete(spark, folder, docs.where("source = 'src3'").select("id"))
    G.merge(spark, folder, [first, second])
    hits = S.matches(G.open_index(spark, folder, PLAIN), "of the|that", spark)
    best = hits.orderBy(F.desc("score"), "doc_id").limit(50)
    return best.select(F.col("doc_id").alias("id"), rounded("score"))
