"""Shared folders, stored frames and small helpers of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session without one makes its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tallyloom-llm-")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: What an Arrow batch of wide rows may hold. Executor and worker hold a batch several times, in memory that their allocators
#: keep for later stages; with Spark's defaults, 10,000 rows or 64 MB, that is most of what a stage adds.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(2000), "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started meanwhile send small batches to their workers. What the session sets itself stays."""
    unset = [k for k in SMALL_BATCHES if spark.conf.get(k, None) is None]
    for k in unset:
        spark.conf.set(k, SMALL_BATCHES[k])
    try:
        yield
    finally:
        for k in unset:
            spark.conf.unset(k)


class Workspace:
    """Frames written to a folder of their own in the shared folder, and read back.

    A written frame cuts lineage: a lost executor makes Spark read files again and compute nothing
    anew. What a result no longer needs is deleted by `drop`. A `lasting` folder has the given name alone, so that
    other sessions find it. One of `wide` rows, such as whole texts, sends them to workers in small batches.
    """

    def __init__(self, spark: SparkSession, name: str, lasting: bool = False, wide: bool = False):
        self.spark, self.wide = spark, wide
        self.folder = f"{shared_folder(spark)}/{name}" + ("" if lasting else f"-{uuid.uuid4().hex}")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def keep(self, rows: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        with small_batches(self.spark) if self.wide else nullcontext():
            rows.write.partitionBy(*partition_by).parquet(self.path(name))
        # Spark deletes a finished job's shuffle files once the driver's collector has found its plan
        # unreachable, which can take long on an idle heap; the copy just written makes them useless.
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(rows.schema).parquet(self.path(name)).select(*rows.columns)

    def exists(self, name: str) -> bool:
        target = self._hadoop(name)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def finished(self, prefix: str) -> list[str]:
        """Names with this prefix whose write has its success mark, sorted."""
        pattern = self._hadoop(f"{prefix}*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(f.getPath().getParent().getName() for f in found or [])

    def drop(self, *names: str) -> None:
        for name in names:
            target = self._hadoop(name)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder. Workers of a session that was started elsewhere get this package's place."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_group(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Add column `name`: groups of about `size` rows, whatever the rows hold.

    `rows` must be a stored frame, so that a retried task numbers the same rows alike.
    """
    groups = max(1, -(-rows.count() // size))
    return rows.withColumn(name, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))


def rows_with(rows: DataFrame, key: str, wanted: DataFrame, marks: int = 1 << 18) -> DataFrame:
    """Rows whose key is in `wanted`, a frame of distinct keys under the same name.

    Wide rows are sieved before the join shuffles them: `marks` bounds how many values of a short hash of the
    wanted keys are broadcast, whatever the number of keys; what passes the sieve by chance fails the join.
    """
    mark = F.pmod(F.xxhash64(key), F.lit(marks))
    sieve = wanted.select(mark.alias("_mark")).distinct()
    some = rows.withColumn("_mark", mark).join(F.broadcast(sieve), "_mark", "left_semi").drop("_mark")
    return some.join(wanted, key)
