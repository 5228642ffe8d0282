"""Stored tables that are changed by rewriting the parts that a change touches, and nothing else.

Rows are dealt into buckets by their key. A change reads the buckets of its keys, writes them anew as a generation of
their own, and then adds one file to the manifest, which puts all of them in place at once; readers take of every
bucket the generation with the highest version. A run that breaks off before that leaves files that nobody reads.
One writer at a time. `vacuum` removes what no reader takes any more.

    data/gen=<generation>/bucket=<number>/...
    manifest: (version, bucket, gen)
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators import store as K

_MANIFEST = "version long, bucket int, gen string"


class Table:
    """A stored table with a key. `buckets` is fixed when it is made: about one for 100 MB."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 32):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _live(self) -> tuple[int, dict[int, str]]:
        """(version, generation of every bucket): at most as many rows as there are buckets."""
        manifest = K.read_table(self.spark, f"{self.path}/manifest", _MANIFEST)
        newest = manifest.groupBy("bucket").agg(F.max(F.struct("version", "gen")).alias("m")).select("bucket", "m.*").collect()
        return max((r.version for r in newest), default=0), {r.bucket: r.gen for r in newest}

    def _stored(self, live: dict[int, str], buckets: list[int] | None = None) -> DataFrame:
        """Rows of buckets, with their number; folders of other buckets and generations are pruned."""
        chosen = [f"{gen}/{b}" for b, gen in live.items() if buckets is None or b in buckets]
        schema = T.StructType([*self.schema.fields, T.StructField("gen", T.StringType()), T.StructField("bucket", T.IntegerType())])
        rows = K.read_table(self.spark, f"{self.path}/data", schema)
        here = F.concat_ws("/", "gen", F.col("bucket").cast("string"))
        return rows.where(here.isin(chosen)).drop("gen")

    def read(self) -> DataFrame:
        return self._stored(self._live()[1]).drop("bucket")

    def _replace(self, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrite the touched buckets; what `change` gives for them takes the place of what they held."""
        if not touched:
            return
        version, live = self._live()
        gen = uuid.uuid4().hex
        rows = change(self._stored(live, touched).drop("bucket")).select(*self.schema.names)
        placed = rows.withColumn("bucket", self._bucket()).repartition("bucket")
        placed.write.partitionBy("bucket").parquet(f"{self.path}/data/gen={gen}")
        self._commit([(version + 1, b, gen) for b in touched])

    def _commit(self, rows: list[tuple[int, int, str]]) -> None:
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _buckets_of(self, keyed: DataFrame) -> list[int]:
        return sorted(r.b for r in keyed.select(self._bucket().alias("b")).distinct().collect())

    def upsert(self, new: DataFrame) -> None:
        """Rows of `new` replace those of their keys or join them; of several the one of the highest `upsert_seq`."""
        self._replace(self._buckets_of(new), lambda old: K.upsert(old, new, self.keys))

    def register(self, wanted: DataFrame) -> None:
        """Add the rows whose keys are not there; buckets without such a row stay as they are."""
        held = self.read().select(*self.keys)
        fresh = wanted.join(held, self.keys, "left_anti")
        self._replace(self._buckets_of(fresh), lambda old: K.register(old, fresh, self.keys))

    def delete(self, condition: Column) -> None:
        """Remove the rows for which the condition holds."""
        hit = self._stored(self._live()[1]).where(condition).select("bucket").distinct()
        self._replace(sorted(r.bucket for r in hit.collect()), lambda old: K.delete(old, condition))

    def change(self, keyed: DataFrame, how: Callable[[DataFrame], DataFrame]) -> None:
        """Let `how` change the rows in the buckets of the keys in `keyed`."""
        self._replace(self._buckets_of(keyed), how)

    def vacuum(self) -> list[str]:
        """Remove the folders that no reader takes; their names."""
        live = {f"gen={gen}/bucket={b}" for b, gen in self._live()[1].items()}
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gone = []
        for gen in files.listStatus(root):
            for part in files.listStatus(gen.getPath()):
                name = f"{gen.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in live:
                    files.delete(part.getPath(), True)
                    gone.append(name)
        return sorted(gone)


def purge_source(source_id: str, sources: Table, progress: Table, events: Table | None = None) -> None:
    """Remove a source and its progress, and its events where their table is given: events first, the source last."""
    for table in (events, progress, sources):
        if table is not None:
            table.delete(F.col("source_id") == source_id)
