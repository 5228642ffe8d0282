"""Ingestion of files that grow, shrink, end in the middle of a line, and are read in splits."""

import json
import os

import pytest

from tracemill.operators.store import read_events
from tracemill.sources import jsonl, tail, transcript
from tracemill.streaming import ingest as G

RUNS = [f"2026-01-0{i}T00:00:00.000Z" for i in range(1, 8)]


def record(text, ts="2026-01-01T00:00:00Z"):
    entry = {"type": "user", "message": {"content": text}}
    return json.dumps(entry | ({"timestamp": ts} if ts else {}))


def events(spark, store):
    return sorted((r.session_id, r.source_seq, r.text_redacted) for r in read_events(spark, store).collect())


def ids(spark, store):
    return [r.event_id for r in read_events(spark, store).select("event_id").collect()]


@pytest.fixture
def home(tmp_path):
    folder = tmp_path / "in" / "projects" / "-w"
    folder.mkdir(parents=True)
    return tmp_path, folder


def touch(path, at):
    os.utime(path, (at, at))


def test_reads_only_what_was_added(spark, home, monkeypatch):
    monkeypatch.setattr(tail, "SPLIT_BYTES", 100)
    tmp, folder = home
    source, store = str(tmp / "in"), str(tmp / "store")
    a, b = folder / "a.jsonl", folder / "b.jsonl"
    lines = [record(f"a{i} " + "x" * (37 * i % 90), None) for i in range(30)]
    a.write_text("\n".join(lines[:10]) + "\n" + lines[10][:25])
    b.write_text(record("b0") + "\n\n" + "not json\n" + record("b2 é"))  # complete JSON without a line end counts
    touch(a, 1_700_000_000)

    def run(n):
        return {r.path.rsplit("/", 1)[1]: r for r in G.ingest_grown(spark, source, store, "sessions", "dev", RUNS[n]).collect()}

    first = run(0)
    assert (first["a.jsonl"].lines, first["a.jsonl"].bytes) == (10, sum(len(x) + 1 for x in lines[:10]))
    assert first["b.jsonl"].offset == b.stat().st_size and first["b.jsonl"].next_seq == 3
    assert run(1) == {}  # a's unfinished line is looked at and left
    a.write_text("\n".join(lines) + "\n")
    touch(a, 1_700_000_100)
    second = run(2)
    assert list(second) == ["a.jsonl"] and second["a.jsonl"].bytes == sum(len(x) + 1 for x in lines[10:])
    whole = jsonl.read(spark, source, "dev", RUNS[0])
    want = sorted((r.event_id, r.source_seq) for r in whole.select("event_id", "source_seq").collect())
    got = sorted((r.event_id, r.source_seq) for r in read_events(spark, store).select("event_id", "source_seq").collect())
    assert got == want and len(got) == 32
    # without a time, a line's day is that of the run; it is not stored again when the file is read from its start
    a.write_text("\n".join(lines[:5]) + "\n")
    touch(a, 1_700_000_200)
    third = run(3)
    assert third["a.jsonl"].start == 0 and third["a.jsonl"].lines == 5 and third["a.jsonl"].next_seq == 5
    assert sorted(ids(spark, store)) == sorted(i for i, _ in want)
    # and it goes on from there
    a.write_text("\n".join(lines[:5]) + "\n" + record("other", None) + "\n")
    touch(a, 1_700_000_300)
    assert run(4)["a.jsonl"].lines == 1
    assert ("a", 5.0, "other") in events(spark, store)


def test_a_repeated_run_changes_nothing(spark, home):
    """Events are stored and progress is lost: the next run reads the same lines and stores none of them again."""
    tmp, folder = home
    source, store = str(tmp / "in"), str(tmp / "store")
    (folder / "a.jsonl").write_text("".join(record(f"m{i}", None) + "\n" for i in range(6)))
    lines = tail.lines(tail.grown(spark, source, "*.jsonl", G.progress(spark, store)))
    found = jsonl.normalize(lines, "dev", RUNS[0])
    from tracemill.operators.store import append_new

    append_new(found, store)
    assert len(ids(spark, store)) == 6
    G.ingest_grown(spark, source, store, "sessions", "dev", RUNS[3])
    assert len(ids(spark, store)) == 6


TRANSCRIPT = "user:\n<user_query>\nWhat is it?\n</user_query>\nA:\nA house.\n"


def test_grown_transcripts_store_only_what_is_new(spark, tmp_path):
    folder = tmp_path / "in" / "Users-me" / "agent-transcripts"
    folder.mkdir(parents=True)
    source, store, file = str(tmp_path / "in"), str(tmp_path / "store"), folder / "c.txt"
    file.write_text(TRANSCRIPT)
    touch(file, 1_700_000_000)
    G.ingest_grown(spark, source, store, "transcripts", "dev", RUNS[0])
    before = ids(spark, store)
    file.write_text(TRANSCRIPT + "user:\n<user_query>\nAnd then?\n</user_query>\n")
    touch(file, 1_700_000_000 + 3 * 86400)  # the day of all its events
    done = G.ingest_grown(spark, source, store, "transcripts", "dev", RUNS[1]).collect()
    assert [r.start for r in done] == [0]
    after = ids(spark, store)
    assert len(after) == len(set(after)) == len(before) + 1
    want = {r.event_id for r in transcript.read(spark, source, "dev", RUNS[0]).collect()}
    assert set(after) == want
    assert G.ingest_grown(spark, source, store, "transcripts", "dev", RUNS[2]).count() == 0


def test_stream_follows_growing_files(spark, home):
    tmp, folder = home
    source, store = str(tmp / "in"), str(tmp / "store")
    a = folder / "a.jsonl"
    lines = [record(f"a{i}", None) for i in range(12)]

    def follow(checkpoint="c"):
        G.ingest_sessions(spark, source, store, str(tmp / checkpoint), "dev", RUNS[0], poll=None).awaitTermination()
        return events(spark, store)

    a.write_text("\n".join(lines[:4]) + "\n" + lines[4][:10])
    assert [t for _, _, t in follow()] == ["a0", "a1", "a2", "a3"]
    a.write_text("\n".join(lines) + "\n")
    (folder / "b.jsonl").write_text(record("b0"))
    want = sorted([("a", float(i), f"a{i}") for i in range(12)] + [("b", 0.0, "b0")])
    assert follow() == want
    bytes_read = sorted((r.start, r.bytes) for r in G.progress(spark, store).collect() if r.path.endswith("a.jsonl"))
    cut = sum(len(x) + 1 for x in lines[:4])
    assert bytes_read == [(0, cut), (cut, a.stat().st_size - cut)]
    assert follow() == want and follow("other") == want


def test_stream_of_transcripts(spark, tmp_path):
    folder = tmp_path / "in" / "Users-me" / "agent-transcripts"
    folder.mkdir(parents=True)
    file, store = folder / "c.txt", str(tmp_path / "store")
    for i, text in enumerate((TRANSCRIPT, TRANSCRIPT + "user:\n<user_query>\nAnd then?\n</user_query>\n")):
        file.write_text(text)
        touch(file, 1_700_000_000 + i * 200_000)
        G.ingest_transcripts(spark, str(tmp_path / "in"), store, str(tmp_path / "c"), "dev", RUNS[0], poll=None).awaitTermination()
    got = ids(spark, store)
    assert len(got) == len(set(got))
    assert set(got) == {r.event_id for r in transcript.read(spark, str(tmp_path / "in"), "dev", RUNS[0]).collect()}


def test_last_line_end(tmp_path):
    file = tmp_path / "f"
    for data, start, plain, as_json in (
        (b"", 0, 0, 0), (b"ab", 0, 0, 0), (b"{}", 0, 0, 2), (b"a\n", 0, 2, 2), (b"a\n{", 0, 2, 2), (b"a\n{}", 0, 2, 4),
        (b"a\nb", 2, 2, 2), (b"x" * 200_000 + b"\n" + b"y" * 150_000, 0, 200_001, 200_001), (b"a\n\n  ", 0, 3, 3),
    ):
        file.write_bytes(data)
        assert tail.last_line_end(str(file), start, len(data), False) == plain
        assert tail.last_line_end(str(file), start, len(data), True) == as_json


@pytest.mark.parametrize("split", [1, 7, 64, 1000])
def test_splits_give_every_line_once(tmp_path, split):
    file = tmp_path / "f"
    data = b"".join(b"z" * (i * 13 % 40) + b"\n" for i in range(60)) + b"end"
    file.write_bytes(data)
    for start in (0, data.index(b"\n", 300) + 1):
        got = []
        for at in range(start, len(data), split):
            for batch in tail.read_range(str(file), start, at, at + split, len(data), None):
                got += zip(batch["pos"].to_pylist(), batch["line"].to_pylist(), strict=True)
        want, at = [], start
        for line in data[start:].split(b"\n"):
            want.append((at, line.decode()))
            at += len(line) + 1
        assert got == [w for w in want if w[0] < len(data)]
