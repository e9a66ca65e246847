"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import (
    license_scan, neardup, ngram_join, packing, periodic, pii, sentencepieces, sharding, suffix, token_counts, topk, toxicity,
    vector_codes,
)
from tallyloom.llm.common import Workspace, table


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Bids as -ln of 52 bits of a hash; the checksum by its table of 256 entries, one byte after the other.
OP11_SQL = """
WITH crc AS (
  SELECT list(list_reduce(list_prepend(CAST(n AS BIGINT), list_transform(range(8), lambda x: CAST(x AS BIGINT))),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) s(n)
), d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: CAST('0x' || b AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
    list_transform(range(9), lambda s: -ln((CAST(CAST('0x' || substr(md5(coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || '/' || s), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)) AS bids
  FROM documents, crc
), p AS (
  SELECT *, CAST(list_position(bids[1:8], list_min(bids[1:8])) - 1 AS INTEGER) AS shard, CAST(list_position(bids, list_min(bids)) - 1 AS INTEGER) AS grown_shard FROM d
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM p
"""


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round spelled out: all parts against all entries, then the floor of the mean."""
    steps = [f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, part, e[part * len(e) // {parts} + 1 : (part + 1) * len(e) // {parts}] AS x FROM k, range({parts}) s(part)
), c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id, e) - 1 AS entry, x AS c
  FROM p JOIN (SELECT r, vec_id, e FROM k ORDER BY vec_id NULLS LAST, e LIMIT {entries}) USING (r)
)"""]
    for n in range(rounds + 1):
        steps.append(f""", a{n} AS MATERIALIZED (
  SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT r, part, entry, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN c{n} USING (part)
  ) GROUP BY r, part
)""")
        if n < rounds:
            steps.append(f""", c{n + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m, c) AS c FROM c{n} LEFT JOIN (
    SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (
      SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n FROM a{n} JOIN p USING (r, part), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY part, entry, i
    ) GROUP BY part, entry
  ) USING (part, entry)
)""")
    steps.append(f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
FROM k JOIN (
  SELECT r, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r
) USING (r)""")
    return "".join(steps)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.reported(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digest(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in; all but the first of equal texts go; the rest gain an end token.

    The second batch is handed in twice, as after a lost answer, and counts once.
    """
    version = token_counts.VOCABULARY.removesuffix(".json")
    counts = Workspace(spark, "counts").keep(token_counts.count_tokens(table(spark, sf_dir, "documents")), "counts")
    firsts = counts.groupBy("text_key").agg(F.min("doc_id").alias("first_id"))
    marked = counts.join(firsts.withColumnRenamed("first_id", "doc_id").select("doc_id", F.lit(True).alias("first")), "doc_id", "left")
    copies = marked.where(F.col("first").isNull() & F.col("doc_id").isNotNull())
    stay = marked.where("first")
    rollup = token_counts.Rollup(spark)
    rollup.commit("load", token_counts.inserts(counts, version))
    for _ in range(2):
        rollup.commit("drop-copies", token_counts.deletes(copies, version))
    rollup.commit("end-token", token_counts.revisions(stay, stay.withColumn("n_tokens", F.col("n_tokens") + 1), version))
    return rollup.totals()


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.stretched(table(spark, sf_dir, "documents")))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    functions = (
        pipeline, op1_pii, op2_ngram_join, op3_toxicity, op4_topk, op5_neardup, op6_packing, op7_suffix, op8_sentencepiece, op9_token_counts,
        op10_license_scan, op11_rendezvous, op12_periodic_runs, op13_ball_kmeans,
    )
    return {f.__name__: f for f in functions}


def statements() -> dict[str, str]:
    return {"op4_topk": OP4_SQL, "op11_rendezvous": OP11_SQL, "op13_ball_kmeans": _op13_sql()}
