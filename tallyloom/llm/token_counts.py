"""Token counts by source, language and tokenizer version, kept up to date by signed changes.

A batch is a set of changes: +1 document and +n tokens for an insert, the same with minus for a delete, and
both for a revised count. A batch is summed by group before it is stored (map-side first, so a source with
a third of all rows is a few rows per task), under its own id. Storing is idempotent: an id whose folder has
its success mark is left as it is, a half-written one is written anew. Totals are the sum of what is
stored: the success marks alone say which batches count, so a rollup with a name is opened again by a driver that was
restarted or by another session, which then takes no batch twice. Two drivers must not write one batch id at the same time.

Nulls: NULL source or language is a group of its own; a NULL text has no tokens; a NULL document id counts like
any other. Repeated rows count each. Empty batches and tables are valid and change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.bpe import word_bpe
from tallyloom.llm.common import Workspace
from tallyloom.llm.packing import VOCABULARY, vocabulary_path

GROUP = ("source", "lang", "tokenizer_version")
BATCH = "batch-"


def _safe(name: str) -> str:
    """A folder name for any string."""
    return hashlib.sha256(name.encode()).hexdigest()


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, lang, text_key (a hash of the text), n_tokens, one row per document row."""
    rows = docs.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key"), "text")
    kept = [f for f in rows.schema if f.name != "text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(vocabulary_path(vocabulary))
        for batch in batches:
            sizes = [np.diff(offsets) for _, _, offsets in encoder.encode(batch.column(4))]
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64())], names=[*batch.schema.names[:4], "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(count, f"{schema}, n_tokens long")


def inserts(counts: DataFrame, version: str) -> DataFrame:
    return counts.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long").alias("n_tokens"))


def deletes(counts: DataFrame, version: str) -> DataFrame:
    return inserts(counts, version).withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")})


def revisions(before: DataFrame, after: DataFrame, version: str) -> DataFrame:
    """Documents counted anew, or moved to another group: the old rows out, the new rows in."""
    return deletes(before, version).unionByName(inserts(after, version))


class Rollup:
    """Totals in a folder of the shared file system; one stored sum per committed batch. Without a name the folder is new."""

    def __init__(self, spark: SparkSession, name: str | None = None):
        self.spark = spark
        self._work = Workspace(spark, f"token-counts-{_safe(name)}", lasting=True) if name else Workspace(spark, "token-counts")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Store a batch unless its id is stored already; says whether it was new."""
        batch = BATCH + _safe(batch_id)
        if self._work.exists(f"{batch}/_SUCCESS"):
            return False
        summed = changes.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        summed.write.mode("overwrite").parquet(self._work.path(batch))
        return True

    def totals(self) -> DataFrame:
        """Groups with what is left in them: n_docs, n_tokens, and how many batches touched the group."""
        batches = self._work.finished(BATCH)
        if not batches:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_batches long")
        stored = self.spark.read.parquet(*map(self._work.path, batches))
        return stored.groupBy(*GROUP).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_batches")
        )
