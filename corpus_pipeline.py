"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents its predecessor kept and returns them with its decisions applied; the last
returns the pieces of the packed sequences. Stages are written as Parquet and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import ngram_join, packing, pii, suffix, toxicity
from tallyloom.llm.common import Workspace, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones among them, does not reject."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays, the one with the smallest doc_id. A row is known by its id and the fingerprints
    of its text, so ids may repeat with other texts; rows that share both are one. Rows without an id stay."""
    key = ["doc_id", *ngram_join.MARKS]
    known = Workspace(spark, "near-copies", wide=True).keep(ngram_join.marked_classes(docs), "classes")
    first = known.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("class").agg(F.min(F.struct(*key)).alias("first")).select("first.*")
    # Texts without words link with nothing and have no class.
    wordless = known.where("doc_id IS NOT NULL AND n_shingles = 0").select(*key)
    chosen = first.unionByName(wordless).distinct()
    rows = ngram_join.marked(docs.where("doc_id IS NOT NULL")).join(chosen, key, "left_semi").dropDuplicates(key)
    return rows.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the stretches that occur more than once."""
    return suffix.dedup(docs)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("suffix", cut_repeats),
    ("pii", redact_personal),
    ("packing", pack_sequences),
]

#: SQL has no boosted trees, ordinal regression or BPE; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline", wide=True)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return docs
