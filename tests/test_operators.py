"""Small fixtures with known answers, and brute force where SQL is not enough."""

import json
import math
import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tracemill.functions.analysis import Analyzer
from tracemill.functions.stem import stem
from tracemill.operators import files as H
from tracemill.operators import projects as P
from tracemill.operators import search as S
from tracemill.operators import store as K
from tracemill.operators import timeline as T
from tracemill.operators import topics as C
from tracemill.operators import usage as U
from tracemill.operators.filters import EventFilter, apply_filter
from tracemill.schema import EVENTS, promote

BASE = "2026-01-01T00:00:00Z"


def at(seconds: float) -> str:
    moment = datetime(2026, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)
    return moment.isoformat(timespec="milliseconds").replace("+00:00", "Z")


def make(spark, rows):
    """Canonical events from partial rows of stored columns."""
    stored = EVENTS.fields[:16]
    full = [
        tuple({"event_id": f"e{i:03}", "event_ts": BASE, **r}.get(f.name) for f in stored) for i, r in enumerate(rows)
    ]
    return promote(spark.createDataFrame(full, EVENTS.__class__(stored)))


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def test_promoted_columns_follow_the_schema(spark):
    made = make(spark, [{"event_type": "user_message"}])
    assert [(f.name, f.dataType) for f in made.schema.fields] == [(f.name, f.dataType) for f in EVENTS.fields]


def test_time_filter_works_on_whole_seconds(spark):
    ev = make(spark, [{"event_ts": t} for t in (at(0.4), at(1.9), at(2.2), "bad", "2026-01-01T02:00:01+02:00")])
    assert ids(apply_filter(ev, EventFilter(since=at(0.9), until=at(1.1)))) == ["e000", "e001", "e004"]
    assert ids(apply_filter(ev, EventFilter(since="never"))) == []


def test_time_filter_is_pushed_down(spark, tmp_path):
    make(spark, [{"event_ts": at(0)}]).write.parquet(str(tmp_path / "ev"))
    rows = apply_filter(K.read_events(spark, str(tmp_path / "ev")), EventFilter(since=at(0), event_types=("x",)))
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = rows.select("event_id")._jdf.queryExecution().explainString(formatted)
    pushed = re.search(r"PushedFilters: (.*)\nReadSchema: (.*)", plan)
    assert "GreaterThanOrEqual(event_time" in pushed[1] and "EqualTo(event_type,x)" in pushed[1]
    assert "text_redacted" not in pushed[2]


def test_wildcards_and_roles(spark):
    ev = make(
        spark,
        [
            {"session_id": "ses_A", "tool_name": "Bash", "event_type": "tool_call"},
            {"session_id": "sesxa", "tool_name": "read", "event_type": "user_message"},
            {"session_id": "other", "tool_name": "Write", "event_type": "git_tag"},
        ],
    )
    assert ids(apply_filter(ev, EventFilter(session="SES_*"))) == ["e000", "e001"]
    assert ids(apply_filter(ev, EventFilter(tool_names=("ba*", "Write")))) == ["e000", "e002"]
    assert ids(apply_filter(ev, EventFilter(tool_names=("bash",)))) == []
    assert ids(apply_filter(ev, EventFilter(role="user", event_types=("tool_call",)))) == []
    assert ids(apply_filter(ev, EventFilter(include_git=False))) == ["e000", "e001"]


def test_unresolved_project_is_compared_as_it_stands(spark):
    projects = spark.createDataFrame([("p-1", "One", "/w/one")], "project_id string, display_name string, root_path string")
    ev = make(spark, [{"project_id": "p-1"}, {"project_id": "ghost"}])
    for ident, want in (("One", ["e000"]), ("/w/one/deep", ["e000"]), ("ghost", ["e001"]), ("none", [])):
        assert ids(apply_filter(ev, EventFilter(project=ident), projects)) == want, ident


def test_longest_root_wins_without_slash_boundary(spark):
    projects = spark.createDataFrame([("a", "/w/a"), ("b", "/w/a/b"), ("u", "/w/_c")], "project_id string, root_path string")
    paths = spark.createDataFrame([("/w/a/b/x",), ("/w/ab",), ("/W/A",), ("/w/xc/y",), ("/none",)], "path string")
    got = {r.path: r.project_id for r in P.project_by_path(paths, projects).collect()}
    assert got == {"/w/a/b/x": "b", "/w/ab": "a", "/W/A": "a", "/w/xc/y": "u"}


def test_session_topics_equal_a_row_by_row_walk(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for s in range(6):
        t = 0
        for i in range(60):
            t += rng.choice([1, 60, 3600, 7199, 7200, 7201, 9000])
            rows.append({"session_id": f"s{s}", "event_ts": at(t), "text_redacted": "x" * 20, "event_type": "user_message"})
            groups = want.setdefault(f"s{s}", [])
            if not groups or t - groups[-1][-1] > 7200:
                groups.append([])
            groups[-1].append(t)
    got = {}
    for r in C.session_topics(make(spark, rows)).orderBy("session_id", "topic").collect():
        got.setdefault(r.session_id, []).append((r["count"], (r.end_ms - r.start_ms) // 1000))
    assert got == {s: [(len(g), g[-1] - g[0]) for g in gs] for s, gs in want.items()}


def test_read_snapshots_equal_a_pairwise_search(spark):
    rng = random.Random(5)
    body = "x" * 1001 + " }"
    rows = []
    for i in range(120):
        moment = rng.choice([rng.uniform(0, 300), 59.9, 60.0, 60.1, 55.0, 64.9])
        if rng.random() < 0.5:
            rows.append({"event_ts": at(moment), "event_type": "tool_call", "tool_name": "Read",
                         "tool_args_json": f'{{"filePath":"/f{rng.randrange(40)}"}}'})
        else:
            text = body if rng.random() < 0.8 else "short"
            rows.append({"event_ts": at(moment), "event_type": "tool_result", "tool_name": "Read", "text_redacted": f"{i}{text}"})
    ev = make(spark, rows)
    plain = [(r.event_id, r.event_type, r.event_ts, r.ms, r.arg_filepath, r.text_redacted)
             for r in ev.withColumn("ms", F.unix_millis("event_time")).collect()]
    calls, results = {}, []
    for eid, kind, ts, ms, path, text in plain:
        if kind == "tool_call":
            calls[path] = max(calls.get(path, ("", "", 0)), (ts, eid, ms))
        else:
            results.append((ms, eid, text))
    want = {}
    for path, (ts, _, ms) in calls.items():
        near = sorted(r for r in results if abs(r[0] - ms) < 5000)
        if near:
            want[path] = (ts, near[0][2])
    got = {r.path: (r.event_ts, r.content) for r in H.read_snapshots(ev).collect()}
    assert got == want and len(want) > 10


def test_reconstruct_prefers_a_whole_snapshot(spark):
    body = "y" * 1001 + "\n)  "
    edit = {"event_type": "tool_call", "tool_name": "Edit"}
    rows = [
        {**edit, "event_ts": at(1), "tool_args_json": '{"filePath":"/a","oldString":"one $& two","newString":"1 $& 2"}'},
        {**edit, "event_ts": at(2), "tool_args_json": '{"file_path":"/a","old_string":"1","new_string":"[1]"}'},
        {**edit, "event_ts": at(3), "tool_args_json": '{"path":"/a","oldString":"absent","newString":"z"}'},
        {**edit, "event_ts": at(4), "tool_args_json": '{"path":"/a","oldString":"2","newString":""}'},
        {"event_ts": at(5), "event_type": "tool_call", "tool_name": "Read", "tool_args_json": '{"filePath":"/b"}'},
        {"event_ts": at(7), "event_type": "tool_result", "tool_name": "Read", "text_redacted": body},
        {**edit, "event_ts": at(9), "tool_args_json": '{"path":"/a","oldString":"[1]","newString":"late"}'},
    ]
    ev = make(spark, rows)
    all_files = {r.path: r for r in H.reconstruct_all(ev, at(8)).collect()}
    a, b = all_files["/a"], all_files["/b"]
    assert (a.method, a.content, a.edits, a.applied, a.failed) == ("edits", "[1] $& 2", 4, 1 + 1, 1)
    assert (b.method, b.content, b.edits) == ("read", body, None)
    assert H.reconstruct(ev, "/a", at(8)).collect()[0].content == "[1] $& 2"
    assert H.reconstruct(ev, "/b", at(8)).collect()[0].method == "read"
    assert H.reconstruct(ev, "/none", at(8)).count() == 0


def test_strict_pairing_stays_in_the_session(spark):
    call = {"event_type": "tool_call", "tool_name": "Read", "tool_args_json": '{"file_path":"/a"}'}
    result = {"event_type": "tool_result", "tool_name": "Read", "text_redacted": "body"}
    meta = '{"tool_call_id":"tool:Read:1"}'
    ev = make(spark, [{**call, "session_id": "s1", "meta_json": meta}, {**result, "session_id": "s2", "meta_json": meta}])
    assert H.file_history(ev, "/a").count() == 1
    assert H.file_history(ev, "/a", pairing="strict").count() == 0


def test_tokens_count_once_per_message(spark):
    meta = '{"message_id":"m1","model":"gpt-4o","tokens":{"input":1000000,"output":10,"reasoning":5}}'
    tree = {"source_kind": "opencode_storage", "source_id": "s", "session_id": "x", "meta_json": meta}
    other = '{"model":"claude-sonnet-4.5","tokens":{"input":0,"output":1000000}}'
    rows = [
        {**tree, "event_type": "tool_call", "event_ts": at(5)},
        {**tree, "event_type": "assistant_message", "event_ts": at(1)},
        {**tree, "event_type": "assistant_message", "meta_json": '{"message_id":"m1"}', "event_ts": at(0)},
        {"source_kind": "claude_code_jsonl", "event_type": "assistant_message", "meta_json": other, "session_id": "x"},
        {"source_kind": "claude_code_jsonl", "event_type": "tool_call", "meta_json": other},
    ]
    total = U.usage(make(spark, rows)).collect()[0]
    assert (total.input, total.output, total.reasoning, total.cost_usd) == (1_000_000, 1_000_015, 5, 17.5)
    assert U.usage(make(spark, rows), "session").collect()[0].model == "gpt-4o"


def test_stemmed_ranking_equals_brute_force(spark):
    rng = random.Random(11)
    words = ["connect", "connected", "connecting", "errors", "error", "failing", "café", "cafe", "files", "x"]
    docs = [(f"d{i:02}", " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(60)]
    frame = spark.createDataFrame(docs, "event_id string, text_redacted string").withColumn("tool_name", F.lit(None).cast("string"))
    index = S.index_texts(frame, "event_id", ["text_redacted", "tool_name"], Analyzer(stemming=True))

    def analyze(text):
        return [stem(w) for w in text.lower().replace("é", "e").split()]

    phrases = [["connect"], ["fail", "file"], ["cafe"]]
    tokens = {d: analyze(t) for d, t in docs}
    mean = sum(map(len, tokens.values())) / len(docs)
    want = {}
    for phrase in phrases:
        tf = {d: sum(ts[i : i + len(phrase)] == phrase for i in range(len(ts))) for d, ts in tokens.items()}
        tf = {d: n for d, n in tf.items() if n}
        idf = max(math.log((len(docs) - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6)
        for d, n in tf.items():
            norm = n + 1.2 * (0.25 + 0.75 * len(tokens[d]) / mean)
            want[d] = want.get(d, 0) + idf * n * 2.2 / norm
    got = {r.doc_id: r.score for r in S.matches(index, 'connects|"failing file" OR Café', spark).collect()}
    assert got == pytest.approx(want)


def test_stored_index_gives_the_same_hits(spark, tmp_path):
    docs = spark.createDataFrame([("a", "red green"), ("b", "green red green")], "id string, content string")
    fresh = S.index_texts(docs, "id", ["content"])
    S.write_index(fresh, str(tmp_path))
    stored = S.read_index(spark, str(tmp_path))
    for query in ("green", '"red green"', "blue"):
        assert sorted(S.matches(stored, query, spark).collect()) == sorted(S.matches(fresh, query, spark).collect())


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "events")
    first = make(spark, [{"event_id": "a", "source_kind": "git"}, {"event_id": "b", "source_kind": "git"}])
    K.append_new(first, path)
    K.append_new(first.unionByName(make(spark, [{"event_id": "c", "source_kind": "git"}] * 2)), path)
    assert ids(K.read_events(spark, path)) == ["a", "b", "c"]


def test_upsert_takes_the_last_of_repeated_keys(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, v string")
    new = spark.createDataFrame([("a", "2", 1), ("a", "3", 2), ("c", "1", 3)], "id string, v string, upsert_seq long")
    assert sorted(map(tuple, K.upsert(old, new, ["id"]).collect())) == [("a", "3"), ("b", "1"), ("c", "1")]
    assert K.delete(old).count() == 0 and K.delete(old, F.col("id") == "a").count() == 1


def test_exports_have_a_header_and_nested_arguments(spark, tmp_path):
    rows = spark.createDataFrame(
        [("2026-01-01T00:00:00Z", "tool_call", 'say "x"\nnow', "Bash", None, None, None, '{"a": [1, {"b": 2}]}'), ("t", "e", "", "x", None, None, None, "plain")],
        "event_ts string, event_type string, text_redacted string, tool_name string, git_sha string, git_insertions int, git_deletions int, tool_args_json string",
    ).coalesce(1)
    T.export(rows, str(tmp_path / "csv"), "csv", "timeline")
    lines = next((tmp_path / "csv").glob("part-*")).read_text().splitlines()
    assert [c.strip('"') for c in lines[0].split(",")] == list(T.CSV_COLUMNS["timeline"])
    assert lines[1].startswith('"2026-01-01T00:00:00Z","tool_call","say ""x"" now","Bash"')
    T.export(rows, str(tmp_path / "json"), "json")
    first, second = next((tmp_path / "json").glob("part-*")).read_text().splitlines()
    assert json.loads(first)["tool_args_json"] == {"a": [1, {"b": 2}]} and json.loads(second)["tool_args_json"] == "plain"


def test_only_an_absent_path_is_an_empty_store(spark, tmp_path):
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        K.append_new(make(spark, [{"event_id": "a"}]), str(tmp_path / "store"))


def test_many_edits_of_one_file_and_empty_ones(spark):
    steps = [("f", f"2026-01-01T00:00:00.{i:06}Z", f"e{i:06}", f"<{i}>", f"<{i + 1}>") for i in range(12_000)]
    rows = spark.createDataFrame(steps + [("g", "2026-01-01T00:00:00Z", "x", "", "new"), (None, "2026-01-01T00:00:00Z", "y", "a", "b")], "file_path string, event_ts string, event_id string, old_string string, new_string string")
    got = {r.file_path: tuple(r)[1:] for r in H.replay_edits(rows).collect()}
    assert got == {"f": (12_000, 12_000, 0, "<12000>"), "g": (1, 0, 0, ""), None: (1, 1, 0, "b")}


def test_one_length_per_document(spark):
    docs = spark.createDataFrame([("a", "cafe\u0301 na\u00efve"), ("b", "plain words here"), ("c", None)], "id string, t string")
    index = S.index_texts(docs, "id", ["t"])
    lengths = dict(index.lengths.collect())
    assert {r.doc_id: r.n_terms for r in index.postings(None).collect()} == {k: v for k, v in lengths.items() if v}


def test_days_of_bad_timestamps_share_one_folder(spark):
    rows = make(spark, [{"event_id": "a", "event_ts": "2026-01-01T00:00:00Z"}, {"event_id": "b", "event_ts": "12:30"}, {"event_id": "c", "event_ts": ""}])
    assert {r.event_id: r.event_date for r in rows.collect()} == {"a": "2026-01-01", "b": "unknown", "c": "unknown"}


def test_plan_log_is_written_and_read_back(spark, tmp_path):
    from tracemill.operators import fusion as X

    plan = spark.createDataFrame([("q", 1, "fts", "two words", 1.0)], "query_id string, action_id int, type string, text string, weight double")
    queries = spark.createDataFrame([("q", "two words of it")], "query_id string, text string")
    for day in ("2026-01-01", "2026-01-02"):
        X.log_plan(plan, queries, str(tmp_path / "log"), day)
    log = spark.read.json(str(tmp_path / "log"))
    assert [tuple(r) for r in X.plan_log_summary(log).collect()] == [("two words of it", 1, 2)] * 2
