import json
import random

import pytest
from pyspark.sql import functions as F

from tracemill.sources import transcript
from tracemill.sources.lines import read_lines

NOW = "2026-01-01T00:00:00.000Z"
TEXT = """noise
user:
<user_query>
do it
A:
please
</user_query>
skipped
A:
first
<think>
deep
user:
</think>
second
A: not a header
[Tool call] Read
  path: /a.ts
  note: x: y
  path: /b.ts
  bare
ignored
[Tool result] Read
line 1

line 2
A:
<think>
only thought
</think>
user: no query
A:
[Tool call] Bare
user:
no query tag
A:
last
"""


def write(folder, text):
    path = folder / "projects" / "Users-me-x" / "agent-transcripts"
    path.mkdir(parents=True)
    (path / "t1.txt").write_text(text)
    return str(folder)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return write(tmp_path_factory.mktemp("t"), TEXT)


EXPECTED = [
    ("user", "do it\nA:\nplease", None),
    ("thinking", "deep\nuser:", None),
    ("assistant", "first\nsecond\nA: not a header", None),
    ("tool_call", "", "Read"),
    ("tool_result", "line 1\n\nline 2", "Read"),
    ("thinking", "only thought", None),
    ("tool_call", "", "Bare"),
    ("assistant", "last", None),
]


def test_blocks(spark, folder):
    rows = transcript.blocks(read_lines(spark, folder, "*.txt")).orderBy("seq").collect()
    assert [(r.type, r.text, r.tool) for r in rows] == EXPECTED
    assert [r.seq for r in rows] == list(range(len(EXPECTED)))
    assert rows[3].args == {"path": "/b.ts", "note": "x: y"} and rows[6].args is None


@pytest.mark.parametrize("width", [1, 3, 7])
def test_blocks_do_not_depend_on_input_splits(spark, folder, width):
    lines = read_lines(spark, folder, "*.txt").withColumn("block", F.floor(F.col("pos") / width))
    rows = transcript.blocks(lines).orderBy("seq").collect()
    assert [(r.type, r.text, r.tool) for r in rows] == EXPECTED


def sequential(text):
    """Plain reading of the same format, line after line."""
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        line = lines[i]
        if line.strip() == "user:":
            i += 1
            if i < len(lines) and lines[i].strip() == "<user_query>":
                body, i = [], i + 1
                while i < len(lines) and lines[i].strip() != "</user_query>":
                    body.append(lines[i])
                    i += 1
                out.append(("user", "\n".join(body).strip(), None))
                i += 1
        elif line.strip() == "A:":
            body, i = [], i + 1
            while i < len(lines) and not lines[i].startswith(("user:", "[Tool")):
                if lines[i].strip() == "<think>":
                    thought, i = [], i + 1
                    while i < len(lines) and lines[i].strip() != "</think>":
                        thought.append(lines[i])
                        i += 1
                    out.append(("thinking", "\n".join(thought).strip(), None))
                else:
                    body.append(lines[i])
                i += 1
            if "\n".join(body).strip():
                out.append(("assistant", "\n".join(body).strip(), None))
        elif line.startswith("[Tool call] "):
            i += 1
            while i < len(lines) and lines[i].startswith("  "):
                i += 1
            out.append(("tool_call", "", line[12:].strip()))
        elif line.startswith("[Tool result] "):
            body, i = [], i + 1
            while i < len(lines) and not lines[i].startswith(("A:", "[Tool", "user:")):
                body.append(lines[i])
                i += 1
            out.append(("tool_result", "\n".join(body).strip(), line[14:].strip()))
        else:
            i += 1
    return out


def test_random_transcripts_against_sequential_reading(spark, tmp_path):
    rng = random.Random(7)
    pool = ["user:", " user:", "user: x", "<user_query>", "</user_query>", "A:", "  A:", "A: y", "<think>", "</think>",
            "[Tool call] T", "[Tool result] T", "[Tool other", "  k: v", "text", ""]
    folder = tmp_path / "p" / "agent-transcripts"
    folder.mkdir(parents=True)
    texts = {f"r{n}": "\n".join(rng.choices(pool, k=60)) for n in range(30)}
    for name, text in texts.items():
        (folder / f"{name}.txt").write_text(text)
    lines = read_lines(spark, str(tmp_path), "*.txt")
    first = lines.groupBy("path").agg(F.min("pos").alias("p0"))
    lines = lines.join(first, "path").withColumn("block", F.floor((F.col("pos") - F.col("p0")) / 11)).drop("p0")
    got = {}
    for r in transcript.blocks(lines).orderBy("path", "seq").collect():
        got.setdefault(r.path.rsplit("/", 1)[1][:-4], []).append((r.type, r.text, r.tool))
    assert got == {k: v for k, v in ((k, sequential(t)) for k, t in texts.items()) if v}


def test_events(spark, folder):
    events = transcript.read(spark, folder, "dev", NOW).orderBy("source_seq").collect()
    assert [e.event_type for e in events][:4] == ["user_message", "assistant_message", "assistant_message", "tool_call"]
    assert json.loads(events[3].tool_args_json) == {"path": "/b.ts", "note": "x: y"}
    assert events[3].file_paths == ["/b.ts"] and events[3].arg_path == "/b.ts"
    assert events[1].meta_json == '{"reasoning":true}' and events[0].session_id == "t1"
    assert events[0].project_id.startswith("x-") and len(events[0].event_id) == 64
    files = read_lines(spark, folder, "*.txt")
    assert [r.directory for r in transcript.working_directories(files).collect()] == ["/Users/me/x"]
