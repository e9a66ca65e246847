"""Frames that several later steps read are written once and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def staging_folder(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir. Only a local session without
    one gets a temporary folder; on a cluster a missing folder is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tallyloom-")
        context.setCheckpointDir(named)
    return named


def stored(rows: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write `rows` as Parquet to the staging folder and return them read back.

    This cuts lineage, so a lost executor re-reads files instead of recomputing the input, and what
    follows reads only the columns and partitions it needs, with real sizes to choose joins by. Staged rows are full of
    repeated text and hashes in hex, so they are packed with zstd.
    """
    spark = rows.sparkSession
    path = f"{staging_folder(spark)}/stored-{uuid.uuid4().hex}"
    rows.write.partitionBy(*partition_by).parquet(path, compression="zstd")
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


def together(spark: SparkSession, *steps: Callable[[], object]) -> list:
    """Results of independent steps that write tables, run at the same time.

    A small table's write leaves most of a cluster idle, and planning one leaves all of it idle. The first failure is raised
    once all steps have ended.
    """
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    return [r.result() for r in running]
