import json

from pyspark.sql import functions as F

from tracemill.operators.store import read_events
from tracemill.sources import jsonl
from tracemill.streaming import ingest as G

NOW = "2026-01-01T00:00:00.000Z"


def record(text, ts):
    return json.dumps({"type": "user", "message": {"content": text}, "timestamp": ts})


def test_stream_equals_batch_and_repeats_add_nothing(spark, tmp_path):
    folder = tmp_path / "in" / "projects" / "-w"
    folder.mkdir(parents=True)
    for n in range(2):
        lines = [record(f"m{n}-{i}", f"2026-01-0{n + 1}T00:00:0{i}Z") for i in range(5)]
        (folder / f"a{n}.jsonl").write_text("\n".join(lines))
    store = str(tmp_path / "store")

    def run(checkpoint, max_files=None):
        G.ingest_sessions(
            spark, str(tmp_path / "in"), store, str(tmp_path / checkpoint), "dev", NOW, poll=None, max_files=max_files
        ).awaitTermination()
        return {(r.event_id, r.source_seq) for r in read_events(spark, store).collect()}

    batch = {(r.event_id, r.source_seq) for r in jsonl.read(spark, str(tmp_path / "in"), "dev", NOW).collect()}
    assert run("c1", max_files=1) == batch and len(batch) == 10
    # A new checkpoint replays every file; a late file from long ago is still taken.
    (folder / "b0.jsonl").write_text(record("late", "2020-01-01T00:00:00Z"))
    assert len(run("c2")) == 11
    assert read_events(spark, store).count() == 11


def test_repeats_are_dropped_on_live_feeds(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:10:00"), ("b", "2026-01-01 00:00:00")], "event_id string, t string"
    ).withColumn("event_time", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = (
        G.without_repeats(live, "1 hour")
        .writeStream.format("memory")
        .queryName("live_rows")
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert sorted(r.event_id for r in spark.table("live_rows").collect()) == ["a", "b"]


def usage_rows(days):
    """One file per batch: (event_id, message, day, tokens)."""
    return [
        (f"e{i}", "s", m, f"2026-01-{d:02}T00:00:00Z", "opencode_storage", "assistant_message", "ses", "m", t, 0, 0, 0, 0)
        for i, m, d, t in days
    ]


USAGE = "event_id string, source_id string, message_id string, event_ts string, source_kind string, event_type string, " \
    "session_id string, model string, tok_input long, tok_output long, tok_reasoning long, tok_cache_read long, tok_cache_write long"


def test_usage_stream_loses_and_repeats_nothing(spark, tmp_path):
    from tracemill.operators.usage import usage
    from tracemill.streaming import windows as X

    batches = [(1, "a", 20, 5), (2, "b", 21, 1), (3, "c", 22, 1), (4, "d", 10, 7), (5, "a", 26, 5), (6, "a", 9, 5), (1, "a", 20, 5)]
    everything = spark.createDataFrame(usage_rows(batches), USAGE)
    for i, b in enumerate(batches):
        spark.createDataFrame(usage_rows([b]), USAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(everything.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
        X.usage_by_day(stream, str(tmp_path / "out"), poll=None).awaitTermination()
    got = {r.day: r.input for r in X.read_report(spark, str(tmp_path / "out")).collect() if r.input}
    assert got == {"2026-01-09": 5, "2026-01-10": 7, "2026-01-21": 1, "2026-01-22": 1}
    once = everything.dropDuplicates(["event_id"])
    assert got == {r.day: r.input for r in usage(once, "day").collect()}
