"""Exact top-k inner-product search with a pivot table.

Vectors become integers, floor(64 x). PIVOTS rows of the table serve as pivots. What a row's distances to them tell
is kept in triangular form: its coordinates along the orthonormalised pivots and its distance from their span. That
gives d(q,v)^2 >= |q_p - v_p|^2 + (|q_r| - |v_r|)^2, which is at least the square of |d(q,p) - d(v,p)| for every pivot p,
so it is the largest bound the pivots allow; as a score, q.v <= q_p.v_p + |q_r| |v_r|.

1. Rows are ordered by their nearest pivot and their distance to it, and cut into chunks of about CHUNK rows; queries
   into blocks of about BLOCK. Each keeps the range of every coordinate.
2. A query's k-th score among FIRST rows of the table is a first floor. The ranges bound a block and a chunk as a
   whole; pairs below every floor of the block are dropped before any row moves.
3. Where a block meets a chunk, all bounds are one matrix product. Candidates above the floor are evaluated in the order
   of their bound, STEP a query at a time, until the next bound is below the k-th score: the exact stop. What is not
   evaluated cannot be among the k best, so results are exact whatever the pivots and the first rows are.

The stated query set meets all rows in blocks, so memory per task is fixed. A window ranks what the meetings return.

Nulls and other vectors: rows that are NULL, empty or hold NULL or non-finite components take no part, nor do
those of another length than most. A NULL vec_id takes no part. Equal scores go by the smaller vec_id. Rows that repeat a
vec_id are separate candidates and, as queries, get a list each; a query skips all rows of its own id. Fewer
candidates than k give fewer rows; an empty table none. Scores are exact while components stay below 2**23 in size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Workspace
from tallyloom.llm.vectors import matrix, usable

PIVOTS, FIRST, CHUNK, BLOCK, STEP = 56, 2048, 8192, 4096, 64
#: Queries whose bounds are held at once, and boxes of blocks or chunks that meet in one group.
SUB, GROUP = 256, 256


def _basis(pivots: np.ndarray) -> np.ndarray:
    """Orthonormal rows that span the pivots."""
    if not len(pivots):
        return np.zeros((0, pivots.shape[1]))
    _, sizes, rows = np.linalg.svd(pivots, full_matrices=False)
    return rows[sizes > 1e-9 * max(sizes[0], 1e-300)]


def _slack(q_size: np.ndarray, v_size: np.ndarray) -> np.ndarray:
    """More than rounding can take from a bound."""
    return 1e-6 + 1e-9 * q_size * v_size


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query, by falling score, then id; and their places."""
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    best = place < k
    return query[best], score[best], ids[best], place[best]


def _search(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of one chunk for each query of one block, of those that reach the query's floor."""
    v, v_p, v_r = np.stack(rows["v"]), np.stack(rows["p"]), rows["r"].to_numpy()
    ids, v_size = rows["vec_id"].to_numpy(), np.sqrt((v * v).sum(1))
    out = []
    for at in range(0, len(queries), SUB):
        part = queries.iloc[at : at + SUB]
        q, q_r, own = np.stack(part["v"]), part["r"].to_numpy(), part["vec_id"].to_numpy()
        floor = part["least"].to_numpy().copy()
        upper = np.stack(part["p"]) @ v_p.T
        upper += np.outer(q_r, v_r) + _slack(np.sqrt((q * q).sum(1))[:, None], v_size[None, :])
        at_q, at_v = np.nonzero(upper >= floor[:, None])
        other = own[at_q] != ids[at_v]
        at_q, at_v = at_q[other], at_v[other]
        bound = upper[at_q, at_v]
        order = np.lexsort((-bound, at_q))
        at_q, at_v, bound = at_q[order], at_v[order], bound[order]
        place = np.arange(len(at_q)) - np.searchsorted(at_q, at_q)
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        until = STEP
        while len(at_q):
            now = place < until
            score = np.einsum("ij,ij->i", q[at_q[now]], v[at_v[now]])
            reached = score >= floor[at_q[now]]
            found = (at_q[now][reached], score[reached], ids[at_v[now]][reached])
            *best, rank = _best(*(np.concatenate(pair) for pair in zip(best, found)), k)
            last = rank == k - 1
            floor[best[0][last]] = np.maximum(floor[best[0][last]], best[1][last])
            live = ~now & (bound >= floor[at_q])
            at_q, at_v, bound, place = at_q[live], at_v[live], bound[live], place[live]
            until += STEP
        out.append(pd.DataFrame({"query": part["rid"].to_numpy()[best[0]], "query_id": own[best[0]], "vec_id": best[2], "score": best[1].astype(np.int64)}))
    return pd.concat(out, ignore_index=True)


BOX = "group int, lo array<double>, hi array<double>, r_lo double, r_hi double, size double, least double"


def _box(group: int, lo, hi, r_lo, r_hi, size, least) -> pd.DataFrame:
    """Ranges of coordinates and residual, largest length and smallest floor of a chunk or block."""
    values = (lo.min(0), hi.max(0), r_lo.min(), r_hi.max(), size.max(), least.min())
    return pd.DataFrame([[group, *values]], columns=["group", "lo", "hi", "r_lo", "r_hi", "size", "least"])


def _boxes(rows: DataFrame) -> DataFrame:
    """One box per group: of each batch first, so that no row is shuffled."""

    def part(frames):
        for frame in frames:
            for group, some in frame.groupby("group"):
                p, r = np.stack(some["p"]), some["r"].to_numpy()
                yield _box(group, p, p, r, r, np.sqrt((p * p).sum(1) + r * r), some["least"].to_numpy())

    def merge(some: pd.DataFrame) -> pd.DataFrame:
        lo, hi = np.stack(some["lo"]), np.stack(some["hi"])
        return _box(some["group"].iloc[0], lo, hi, *(some[name].to_numpy() for name in ("r_lo", "r_hi", "size", "least")))

    return rows.select("group", "p", "r", "least").mapInPandas(part, BOX).groupBy("group").applyInPandas(merge, BOX)


def _open_pairs(blocks: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a block and a chunk in which some row may reach some floor."""
    lo, hi = np.stack(chunks["lo"]), np.stack(chunks["hi"])
    r_lo, r_hi, size = (chunks[name].to_numpy() for name in ("r_lo", "r_hi", "size"))
    out = []
    for q in blocks.itertuples():
        products = [a[None, :] * b for a in (q.lo, q.hi) for b in (lo, hi)]
        inner = np.maximum.reduce(products).sum(1) + q.r_hi * r_hi
        gap = np.maximum(np.maximum(lo - q.hi, q.lo - hi), 0)
        gap_r = np.maximum(np.maximum(r_lo - q.r_hi, q.r_lo - r_hi), 0)
        apart = (q.size**2 + size**2 - (gap * gap).sum(1) - gap_r**2) / 2
        open_ = np.minimum(inner, apart) + _slack(q.size, size) >= q.least
        out.append(pd.DataFrame({"block": q.group, "chunk": chunks["group"].to_numpy()[open_]}))
    return pd.concat(out, ignore_index=True).astype("int32")


def _meet(left: DataFrame, right: DataFrame, work, schema: str) -> DataFrame:
    """Groups that both sides hold; a group without rows on one side gives none."""

    def both(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        names = [field.split()[0] for field in schema.split(", ")]
        return work(one, other) if len(one) and len(other) else pd.DataFrame({name: [] for name in names}).astype("int64")

    return left.groupBy("chunk_key", "block_key").cogroup(right.groupBy("chunk_key", "block_key")).applyInPandas(both, schema)


def describe(rows: DataFrame, first_ids: np.ndarray, first: np.ndarray, k: int) -> DataFrame:
    """The pivot table: coordinates, residual, nearest pivot and, for queries, the floor that the first rows give."""
    pivots = first[:PIVOTS]
    basis = _basis(pivots)

    def fill(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("v"))
            p = v @ basis.T
            r = np.sqrt(((v - p @ basis) ** 2).sum(1))
            apart = np.sqrt(np.maximum((v * v).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * v @ pivots.T, 0))
            cell = apart.argmin(1)
            least = np.full(len(v), -np.inf)
            asked = np.flatnonzero(batch.column("is_query").to_numpy(zero_copy_only=False).astype(bool))
            if len(first) >= k:
                ids = batch.column("vec_id").to_numpy()
                scores = v[asked] @ first.T
                scores[ids[asked][:, None] == first_ids[None, :]] = -np.inf
                least[asked] = np.partition(scores, len(first) - k, axis=1)[:, len(first) - k]
            lists = lambda m: pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], m.ravel())
            columns = [batch.column("rid"), batch.column("vec_id"), batch.column("is_query"), lists(v), lists(p), r, cell.astype(np.int32), apart.min(1), least]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=None, names=names)

    names = ["rid", "vec_id", "is_query", "v", "p", "r", "cell", "near", "least"]
    kinds = "rid long, vec_id long, is_query boolean, v array<double>, p array<double>, r double, cell int, near double, least double"
    return rows.mapInArrow(fill, kinds)


def search(table: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows for each row that `is_query` selects."""
    spark = table.sparkSession
    work = Workspace(spark, "topk")
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("long"))
    asked = F.coalesce(is_query, F.lit(False)).alias("is_query")
    rows = usable(table).where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), scaled.alias("v"), asked)
    rows = work.keep(rows, "rows").withColumn("rid", F.monotonically_increasing_id())
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (size["n"] if size else 0))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(max(FIRST, PIVOTS)).select("vec_id", "v").collect()
    first_ids = np.array([r["vec_id"] for r in picked], np.int64)
    first = np.array([r["v"] for r in picked], float).reshape(len(picked), size["n"] if size else 1)
    known = work.keep(describe(rows, first_ids, first, k), "known")

    def grouped(some: DataFrame, rows_each: int, name: str) -> DataFrame:
        """Rows in the order of the pivots, cut into groups of about `rows_each`; equal places are cut too."""
        groups = max(1, -(-some.count() // rows_each))
        ordered = some.repartitionByRange(groups, "cell", "near", F.xxhash64("rid")).withColumn("group", F.spark_partition_id())
        stored = work.keep(ordered.drop("cell", "near", "is_query"), name)
        # A session may cut finer than asked; neighbours are joined again, since every block reads the chunks it meets.
        made = (stored.agg(F.max("group")).first()[0] or 0) + 1
        return stored.withColumn("group", F.floor(F.col("group") * min(groups, made) / made).cast("int"))

    chunks, blocks = grouped(known, CHUNK, "chunks"), grouped(known.where("is_query"), BLOCK, "blocks")
    chunk_boxes, block_boxes = work.keep(_boxes(chunks), "chunk_boxes"), work.keep(_boxes(blocks), "block_boxes")
    sides = {name: max(1, -(-boxes.count() // GROUP)) for name, boxes in (("chunk_key", chunk_boxes), ("block_key", block_boxes))}

    def dealt(boxes: DataFrame, own: str, other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(sides[other] - 1)))
        return boxes.withColumn(own, F.pmod("group", F.lit(sides[own]))).withColumn(other, every)

    pairs = _meet(dealt(block_boxes, "block_key", "chunk_key"), dealt(chunk_boxes, "chunk_key", "block_key"), _open_pairs, "block int, chunk int")
    pairs = work.keep(pairs.select(F.col("block").alias("block_key"), F.col("chunk").alias("chunk_key")), "pairs")
    asked = blocks.withColumnRenamed("group", "block_key").join(pairs, "block_key").select("rid", "vec_id", "v", "p", "r", "least", "block_key", "chunk_key")
    there = chunks.withColumnRenamed("group", "chunk_key").join(pairs, "chunk_key").select("vec_id", "v", "p", "r", "block_key", "chunk_key")
    found = _meet(asked, there, lambda a, b: _search(a, b, k), "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
