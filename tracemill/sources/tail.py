"""What growing files hold beyond the place up to which they were read.

Progress is a table that is only appended to: one row for every stretch of a file that was taken in, with the place at
which it ends. A run lists the files, looks up the latest row of each, and reads from there to the end of the last
complete line; a file that is shorter than what was read of it is read from its start. Unterminated text at the end
counts as a line once it is whole, which for JSON can be told by reading it.

Ranges are cut into splits, so a large file is read by many tasks, and a task opens its file at its own place. The same
reader serves batches and, with places as its positions, a stream.
"""

from __future__ import annotations

import fnmatch
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tracemill.sources.lines import list_files

#: Bytes of a file that one task reads, about; bytes and lines of one batch of rows.
SPLIT_BYTES, BATCH_BYTES, BATCH_LINES = 16 << 20, 4 << 20, 10_000
#: Bytes that are read at a time when the end of a file is searched for its last line end.
STEP_BYTES = 1 << 16

PROGRESS = "path string, start long, offset long, modified timestamp, next_seq long, lines long, bytes long, run string"
LINES = "path string, block long, pos long, line string, modified timestamp, start long, bytes long"
_LINES = pa.schema(
    [("path", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("line", pa.string())]
    + [("modified", pa.timestamp("us", "UTC")), ("start", pa.int64()), ("bytes", pa.int64())]
)


def _open(path: str):
    """Random access to a file of any file system that Arrow knows: local and mounted folders, HDFS, object stores."""
    from pyarrow import fs

    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path
    return system.open_input_file(inner)


def last_line_end(path: str, start: int, size: int, whole_json: bool) -> int:
    """Place up to which the file holds complete lines, at least start; an unterminated last line counts if it is JSON."""
    with _open(path) as file:
        end, tail = size, []
        while end > start:
            step = max(start, end - STEP_BYTES)
            file.seek(step)
            piece = file.read(end - step)
            cut = piece.rfind(b"\n")
            tail.append(piece[cut + 1 :])
            if cut >= 0:
                end = step + cut + 1
                break
            end = step
    rest = b"".join(reversed(tail))
    if whole_json and rest.strip():
        try:
            json.loads(rest)
        except ValueError:
            return end
        return size
    return end


def read_range(path: str, start: int, at: int, upto: int, stop: int, modified) -> Iterator[pa.RecordBatch]:
    """Lines that begin in [at, upto) of a range [start, stop); each belongs to the split in which it begins."""
    rows: list[tuple] = []
    held = 0
    with _open(path) as raw:
        file = io.BufferedReader(raw, 1 << 20)
        if at > start:  # the line that runs into this split belongs to the one before
            file.seek(at - 1)
            at += len(file.readline()) - 1
        else:
            file.seek(at)
        block = at
        while at < min(upto, stop):
            line = file.readline()[: stop - at]
            if not line:
                break
            text = line[:-1] if line.endswith(b"\n") else line
            rows.append((path, block, at, text.decode("utf-8", "replace"), modified, start, len(line)))
            at += len(line)
            held += len(line)
            if held >= BATCH_BYTES or len(rows) >= BATCH_LINES:
                yield _batch(rows)
                rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LINES, strict=True)], schema=_LINES)


def latest(progress: DataFrame) -> DataFrame:
    """The last row of progress of every path."""
    newest = F.max_by(F.struct("offset", "modified", "next_seq"), F.struct("run", "offset")).alias("_p")
    return progress.groupBy("path").agg(newest).select("path", "_p.*")


def changed(files: DataFrame, progress: DataFrame, whole: bool = False) -> DataFrame:
    """(path, size, modified, start) of files with something to read; `whole` files are always read from their start.

    A file that was read to its end and has the same time is left out. One that is shorter than what was read of it,
    or of that length with another time, was written anew: it is read from 0.
    """
    known = latest(progress).select(F.col("path").alias("_path"), "offset", F.col("modified").alias("_modified"))
    joined = files.join(known, F.col("path") == F.col("_path"), "left")
    same = F.col("size").eqNullSafe(F.col("offset")) & F.col("modified").eqNullSafe(F.col("_modified"))
    anew = F.col("offset").isNull() | (F.col("size") <= F.col("offset")) | F.lit(whole)
    start = F.when(anew, 0).otherwise(F.col("offset"))
    return joined.where(~same).select("path", "size", "modified", start.cast("long").alias("start"))


def _with_stop(whole_json: bool):
    def run(batches):
        for batch in batches:
            paths, starts, sizes = (batch.column(c).to_pylist() for c in ("path", "start", "size"))
            stops = [last_line_end(p, a, n, whole_json) for p, a, n in zip(paths, starts, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stops, pa.int64())], [*batch.schema.names, "stop"])

    return run


def _read_splits(batches):
    for batch in batches:
        for row in batch.to_pylist():
            yield from read_range(row["path"], row["start"], row["at"], row["upto"], row["stop"], row["modified"])


def ranges(todo: DataFrame, whole_json: bool = True) -> DataFrame:
    """(path, size, modified, start, stop): the complete lines to read; files are opened by tasks."""
    spread = todo.repartition(todo.sparkSession.sparkContext.defaultParallelism, "path")
    return spread.mapInArrow(_with_stop(whole_json), "path string, size long, modified timestamp, start long, stop long")


def lines(found: DataFrame) -> DataFrame:
    """Lines (path, block, pos, line, modified, start, bytes) of ranges; `pos` is the byte at which a line begins."""
    at = F.explode(F.sequence(F.col("start"), F.col("stop") - 1, F.lit(SPLIT_BYTES)))
    splits = found.where("stop > start").select("path", "modified", "start", "stop", at.alias("at"))
    splits = splits.withColumn("upto", F.col("at") + SPLIT_BYTES)
    n = found.sparkSession.sparkContext.defaultParallelism
    return splits.repartition(n, "path", "at").mapInArrow(_read_splits, LINES)


def grown(spark: SparkSession, folder: str, glob: str, progress: DataFrame, whole: bool = False) -> DataFrame:
    """Ranges of the files below a folder that are not read yet."""
    return ranges(changed(list_files(spark, folder, glob), progress, whole), whole_json=glob.endswith("json") or glob.endswith("jsonl"))


class _Split(InputPartition):
    def __init__(self, path: str, start: int, at: int, upto: int, stop: int, modified: float):
        super().__init__((path, at))
        self.place = (path, start, at, upto, stop)
        self.modified = modified


class _TailReader(DataSourceStreamReader):
    """Positions are, for every file, how far it is read and how often it began anew."""

    def __init__(self, folder: str, glob: str, whole: bool, max_files: int | None):
        self.folder, self.glob, self.whole, self.max_files = folder, glob, whole, max_files
        self.seen: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _files(self):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        for info in system.get_file_info(fs.FileSelector(inner, recursive=True)):
            if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, self.glob):
                prefix = self.folder[: self.folder.index(inner)] if "://" in self.folder else ""
                yield prefix + info.path, info.size, info.mtime.timestamp()

    def latestOffset(self) -> dict:
        """Up to `max_files` files that changed since the last look move on; the others keep their place."""
        moved = 0
        for path, size, modified in sorted(self._files()):
            offset, times, old_size, old_modified = self.seen.get(path, [0, 0, -1, 0.0])
            if (size, modified) == (old_size, old_modified):
                continue
            if self.max_files and moved >= self.max_files:
                break
            anew = old_size >= 0 and (self.whole or size <= old_size)
            start = 0 if anew else offset
            stop = last_line_end(path, start, size, self.glob.endswith("jsonl"))
            self.seen[path] = [stop, times + anew, size, modified]
            moved += 1
        return {"files": dict(self.seen)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, (stop, times, _, modified) in end["files"].items():
            offset, before, _, _ = start["files"].get(path, [0, 0, 0, 0])
            first = offset if times == before and offset <= stop else 0
            for at in range(first, stop, SPLIT_BYTES):
                out.append(_Split(path, first, at, at + SPLIT_BYTES, stop, modified))
        for path, place in end["files"].items():  # after a restart, positions come from the checkpoint
            self.seen.setdefault(path, place)
        return out

    def read(self, partition: _Split):
        from datetime import UTC, datetime

        yield from read_range(*partition.place, datetime.fromtimestamp(partition.modified, UTC))

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """Stream of the lines that are added to the files below a folder.

    Options: path, glob, whole (read changed files from their start), maxFiles (files that a batch goes on with).
    """

    @classmethod
    def name(cls) -> str:
        return "growing_text"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        o = self.options
        many = o.get("maxFiles") or o.get("maxfiles")
        return _TailReader(o["path"], o.get("glob", "*"), o.get("whole", "false") == "true", int(many) if many else None)


def stream(spark: SparkSession, folder: str, glob: str, whole: bool = False, max_files: int | None = None) -> DataFrame:
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("growing_text").option("glob", glob).option("whole", str(whole).lower())
    if max_files:
        reader = reader.option("maxFiles", str(max_files))
    return reader.load(folder)
