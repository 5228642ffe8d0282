"""Session settings the jobs rely on."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """One temporary folder of this process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="tracemill-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster.

    Without one, a local session takes a temporary folder; on a cluster, whose machines share none, that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    return _own_folder()


def run_folder(spark: SparkSession, name: str) -> str:
    """New folder for one run below the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Lets Spark remove the shuffle files of an execution when it ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that pass between Spark and a Python task at a time.
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(rows: DataFrame, name: str, batch_rows: int | None = None, own: dict[str, str] | None = None) -> DataFrame:
    """Rows as a table in the shared folder: computed once, and read again after an executor is lost.

    What was shuffled for the write is of no use after it and is given back at once. Rows that carry whole texts may
    pass to Python in smaller batches. `discard` removes the table.
    """
    folder = run_folder(rows.sparkSession, name)
    stored(rows, folder, own=({_BATCH_ROWS: str(batch_rows)} if batch_rows else {}) | (own or {}))
    table = rows.sparkSession.read.schema(rows.schema).parquet(folder)
    table.written_folder = folder
    return table


def stored(rows: DataFrame, folder: str, mode: str = "errorifexists", own: dict[str, str] | None = None) -> None:
    """Write rows as Parquet, with settings of its own, and give back at once what was shuffled for it."""
    spark = rows.sparkSession
    own = {_FREE_SHUFFLES: "true"} | (own or {})
    before = {key: spark.conf.get(key, None) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        rows.write.mode(mode).parquet(folder)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def discard(*tables: DataFrame) -> None:
    """Remove written tables of which nothing more is read."""
    for table in tables:
        spark, folder = table.sparkSession, table.written_folder
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and the local benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracemill")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
