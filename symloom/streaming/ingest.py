"""Continuous ingestion: micro-batches of changed records into a versioned table, and late-tolerant counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symloom.tables import one_per_key


class VersionedTable:
    """A Parquet table whose versions are folders; a small pointer file names the current one.

    A new version is written beside the old and then pointed to, so that readers see either all of a batch
    or nothing. Batches carry their number: one that was already applied is skipped, so a restarted query
    changes nothing twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm = jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _pointer(self):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")

    def current(self) -> int:
        """Number of the last applied batch, -1 before the first."""
        where = self._pointer()
        files = where.getFileSystem(self._conf)
        if not files.exists(where):
            return -1
        return int(self.spark.read.text(f"{self.path}/CURRENT").first()[0])

    def read(self, schema: str | None = None) -> DataFrame | None:
        version = self.current()
        if version < 0:
            return self.spark.createDataFrame([], schema) if schema else None
        return self.spark.read.parquet(f"{self.path}/v{version:012d}")

    def publish(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{version:012d}")
        where = self._pointer()
        files = where.getFileSystem(self._conf)
        out = files.create(where, True)
        out.write(bytearray(str(version).encode()))
        out.close()


def upsert_batch(target: VersionedTable, batch: DataFrame, batch_id: int, keys: Sequence[str], newest: str) -> None:
    """Newest row per key of the table and the batch together; keys that are null are left out."""
    if batch_id <= target.current():
        return
    held = target.read()
    columns = [c for c in batch.columns if c not in keys]
    both = batch if held is None else held.unionByName(batch)
    target.publish(one_per_key(both, keys, columns, newest), batch_id)


def upsert_stream(spark: SparkSession, source: DataFrame, target: str, checkpoint: str, keys: Sequence[str], newest: str) -> StreamingQuery:
    """Start a query that applies every micro-batch of `source` (a streaming DataFrame) to the table at `target`."""
    held = VersionedTable(spark, target)
    return source.writeStream.foreachBatch(lambda df, n: upsert_batch(held, df, n, keys, newest)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and key; rows later than `late` behind the newest are dropped, state is bounded by it."""
    return events.withWatermark(time, late).groupBy(F.window(time, every), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
