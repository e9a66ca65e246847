"""Both Silver sides stored by one key, so that matching shuffles neither.

Each side becomes a bucketed table: rows are dealt by (vendor, period, normalised number) once, when they are written, and
every later join or aggregate on that key works bucket by bucket. A key that holds a large share of a side would make
one bucket, and one task, as large; the write counts the rows of each bucket, and `pair` says whether the buckets are even
enough. Where they are not, the same rows are there to be joined by `lookup_join`, which splits hot keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.staging import staging_folder

#: A bucket with more than this many times the rows of a mean one counts as hot, from HOT_ROWS rows on.
HOT_FACTOR, HOT_ROWS = 4, 100_000


@dataclass(frozen=True)
class Sides:
    """Statement and ledger rows; `even` if both are bucketed by `keys` without a hot bucket."""

    statement: DataFrame
    ledger: DataFrame
    keys: tuple[str, ...]
    even: bool


def bucket_count(rows: int, per_bucket: int) -> int:
    """The power of two of buckets that hold about `per_bucket` rows each."""
    return 1 << max(0, (max(1, rows) - 1) // per_bucket).bit_length()


def _write(rows: DataFrame, keys: Sequence[str], buckets: int) -> tuple[DataFrame, int]:
    """The rows as a bucketed table of one file a bucket, and the rows of its largest bucket."""
    spark = rows.sparkSession
    name = f"colocated_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).option("path", f"{staging_folder(spark)}/{name}").saveAsTable(name)
    back = spark.table(name)
    # A bucket is a file, so counting rows per file reads no column.
    largest = back.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return back, largest or 0


def store(statement: DataFrame, ledger: DataFrame, keys: Sequence[str], per_bucket: int = 250_000, hot_rows: int = HOT_ROWS) -> Sides:
    """Write both sides by `keys`, with as many buckets as the larger one needs. The sides must be stored frames: they are counted first.

    Rows whose key has a NULL match nothing; they are left where the key's hash puts them, and count when buckets are judged.
    """
    counts = [side.count() for side in (statement, ledger)]
    buckets = bucket_count(max(counts), per_bucket)
    made = [_write(side, keys, buckets) for side in (statement, ledger)]
    even = all(largest <= max(hot_rows, HOT_FACTOR * n / buckets) for (_, largest), n in zip(made, counts, strict=True))
    return Sides(made[0][0], made[1][0], tuple(keys), even)


def drop(spark: SparkSession, sides: Sides) -> None:
    """Forget the tables of both sides; their files stay with the staging folder."""
    for side in (sides.statement, sides.ledger):
        for file in side.inputFiles()[:1]:
            spark.sql(f"DROP TABLE IF EXISTS `{file.split('/')[-2]}`")
