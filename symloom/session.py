"""Session defaults, and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int = 8, memory: str = "8g", app: str = "symloom") -> SparkSession:
    """A session with the settings that this library's results rely on (UTC, AQE, skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where the session names none (tests, a laptop) and its master is local, a temporary folder is
    made and set. On a cluster without the setting this raises, as a machine-local folder would not be
    seen by the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="symloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_BASES: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    """Remove what this driver wrote below the shared folder; results may read it until then."""
    for spark, base in _BASES:
        try:
            _remove(spark, base)
        except Exception:  # noqa: BLE001 - the application is gone already
            return


class Cuts:
    """Written tables that cut lineage; each is a Parquet folder below the shared one.

    `cut` writes and reads back, so that later stages neither recompute nor depend on one executor's
    disk. `drop` removes a table that no later plan reads (an earlier round of an iteration).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/symloom-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        _BASES.append((spark, self.base))

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count:04d}"
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._symloom_path = path
        return back

    def measured(self, df: DataFrame, **aggregates: Column) -> tuple[DataFrame, dict]:
        """A cut, and aggregates over its rows that were taken while it was written."""
        seen = Observation()
        back = self.cut(df.observe(seen, *[a.alias(n) for n, a in aggregates.items()]))
        return back, dict(seen.get)

    def split(self, df: DataFrame, flag: str, name: str) -> tuple[tuple[int, int], tuple[DataFrame, DataFrame]]:
        """(rows with the flag, rows without), (all rows with it so far under `name`, those without it now): one job.

        Rows with the flag are added to what earlier calls wrote; each part is a table of its own, so that Spark
        knows its size. Rows without a value count as those that have not.
        """
        self.count += 1
        path, seen = f"{self.base}/{name}", Observation()
        kept = df.withColumn("_no", ~F.coalesce(flag, F.lit(False))).drop(flag).withColumn("_part", F.lit(self.count))
        kept.observe(seen, F.count_if(~F.col("_no")).alias("yes"), F.count_if(F.col("_no")).alias("no")).write.mode("append").partitionBy("_no", "_part").parquet(path)
        counts = (int(seen.get["yes"]), int(seen.get["no"]))
        schema = kept.drop("_no", "_part").schema
        self.yes = getattr(self, "yes", 0) + counts[0]
        where = (f"{path}/_no=false", f"{path}/_no=true/_part={self.count}")
        return counts, tuple(self.spark.read.schema(schema).parquet(w).select(*schema.names) if n else self.spark.createDataFrame([], schema) for w, n in zip(where, (self.yes, counts[1])))

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_symloom_path", None)
        if path:
            _remove(self.spark, path)



_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, unless their search path has it.

    Workers inherit PYTHONPATH from the driver's environment; where the package's folder is on it nothing
    is sent.
    """
    import shutil
    import sys

    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    on_path = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    application = spark.sparkContext.applicationId
    if home in on_path or application in _SHIPPED or not os.path.isdir(home):
        return
    folder = tempfile.mkdtemp(prefix="symloom-code-")
    archive = shutil.make_archive(os.path.join(folder, "symloom"), "zip", home, "symloom")
    before = list(sys.path)
    spark.sparkContext.addPyFile(archive)
    sys.path[:] = before  # the driver goes on with the folder itself
    _SHIPPED.add(application)
