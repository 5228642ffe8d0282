import json

import pytest

from tracemill.sources import tree as T

NOW = "2026-01-01T00:00:00.000Z"
T0 = 1_767_225_600_000


def put(root, path, value):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(value if isinstance(value, str) else json.dumps(value))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    put(root, "project/p1.json", {"id": "p1", "worktree": "/w/one"})
    put(root, "project/bad.json", "{nope")
    put(root, "session/p1/s1.json", {"id": "s1", "projectID": "p1", "directory": "/w/one", "title": "t", "time": {"created": T0}})
    put(root, "session/p1/s2.json", {"id": "s2", "projectID": "zz", "directory": "/d", "time": {"created": T0 + 1}})
    tokens = {"input": 10, "output": 20, "reasoning": 3, "cache": {"read": 4, "write": 5}}
    put(root, "message/s1/m1.json", {"id": "m1", "sessionID": "s1", "role": "user", "time": {"created": T0}})
    put(
        root,
        "message/s1/m2.json",
        {"id": "m2", "sessionID": "s1", "role": "assistant", "time": {"created": T0 + 1000, "completed": T0 + 2000},
         "modelID": "mm", "providerID": "anthropic", "agent": "build", "tokens": tokens, "cost": 0.5},
    )
    put(root, "message/s1/m3.json", {"id": "m3", "sessionID": "s1", "role": "assistant", "time": {"created": T0 + 3000}})
    put(root, "message/s1/m4.json", {"id": "m4", "sessionID": "s1", "role": "user", "time": {"created": T0 + 4000}})
    put(root, "part/m1/a.json", {"id": "a", "messageID": "m1", "type": "text", "text": "pwd: secretsecret"})
    put(root, "part/m2/a.json", {"id": "b0", "messageID": "m2", "type": "step-start"})
    put(root, "part/m2/b.json", {"id": "b1", "messageID": "m2", "type": "reasoning", "text": "why", "time": {"start": 1}})
    put(
        root,
        "part/m2/c.json",
        {"id": "b2", "messageID": "m2", "type": "tool", "tool": "read", "callID": "c1", "time": {"start": 2},
         "state": {"input": {"filePath": "/f.ts"}, "output": "body", "time": {"start": 5, "end": 9}, "metadata": {"exit": 0}}},
    )
    put(
        root,
        "part/m2/d.json",
        {"id": "b3", "messageID": "m2", "type": "tool", "tool": "write", "time": {"start": 3},
         "state": {"input": {"path": "/g.ts", "content": "new"}}},
    )
    put(root, "part/m2/e.json", {"id": "b4", "messageID": "m2", "type": "tool", "tool": "bash", "time": {"start": 4},
                                 "state": {"input": {"command": "ls"}}})
    put(root, "part/m3/a.json", {"id": "x", "messageID": "m3", "type": "text", "text": "unfinished"})
    put(root, "part/m4/a.json", {"id": "y", "messageID": "m4", "type": "text", "text": "bye"})
    put(root, "session_diff/s1.json", [{"file": "/f.ts", "before": "a", "after": "b", "additions": 1, "deletions": 0},
                                       {"file": "/h.ts", "before": "", "after": "c"}])
    return str(root)


@pytest.fixture(scope="module")
def events(spark, root):
    return T.normalize(T.read_tree(spark, root), "dev", NOW).orderBy("source_seq").collect()


def test_order(events):
    assert [(e.source_seq, e.event_type, e.tool_name, e.text_redacted) for e in events] == [
        (0, "user_message", None, "[REDACTED:password]"),
        (1, "assistant_message", None, "why"),
        (2, "tool_call", "read", "Tool: read /f.ts"),
        (2.5, "tool_result", "read", "body"),
        (4, "tool_call", "write", "Tool: write /g.ts"),
        (4.5, "tool_result", "write", "new"),
        (6, "tool_call", "bash", "Tool: bash $ ls"),
        (7, "user_message", None, "bye"),
        (8, "tool_call", "edit", "Tool: edit /f.ts"),
        (9, "tool_call", "edit", "Tool: edit /h.ts"),
    ]


def test_details(events):
    assert [e.tok_input for e in events] == [None, 10] + [None] * 8
    assert (events[1].tok_reasoning, events[1].tok_cache_write, events[1].model) == (3, 5, "mm")
    assert events[2].call_id == events[3].call_id == "c1" and events[4].call_id == "tool:write:4"
    meta = json.loads(events[2].meta_json)
    assert meta["duration_ms"] == 4 and meta["exit_code"] == 0 and "tokens" not in meta
    assert events[8].arg_old == "a" and events[8].arg_new == "b" and events[8].file_paths == ["/f.ts"]
    assert events[8].event_ts == "2026-01-01T00:00:00.000Z" and events[7].event_ts == "2026-01-01T00:00:04.000Z"
    assert events[0].project_id.startswith("one-")


def test_incremental_run_takes_later_messages_only(spark, root):
    tree = T.read_tree(spark, root)
    after = tree.messages.where("id = 'm2'").selectExpr("sessionID", "time.created AS last_created")
    rows = T.normalize(tree, "dev", NOW, after=after).orderBy("source_seq").collect()
    assert [r.text_redacted for r in rows] == ["bye", "Tool: edit /f.ts", "Tool: edit /h.ts"]
    full = {r.event_id for r in T.normalize(tree, "dev", NOW).where("tool_name = 'edit'").collect()}
    assert {r.event_id for r in rows if r.tool_name == "edit"} == full


def test_listing(spark, root):
    tree = T.read_tree(spark, root)
    rows = T.session_sources(tree).collect()
    assert [(r.session_id, r.working_directory) for r in rows] == [("s2", "/d"), ("s1", "/w/one")]
    assert T.progress(tree).collect()[0].last_created == T0 + 4000
    assert T.usage_messages(tree).where("provider = 'anthropic'").collect()[0].cache_read == 4
