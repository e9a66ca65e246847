"""Near-duplicate vectors under one label by spherical-cap filters.

A filter is a direction; its cap holds the vectors closest to it. Directions are the words of a product code:
the vector is cut into BLOCKS parts, each with WORDS random unit vectors, and a filter takes one word per part.
A filter's score is the sum of the parts' inner products, so the CAPS best filters of a vector are list-decoded
from the parts' sorted scores without looking at the other WORDS**BLOCKS. Vectors that share a filter and a
label are compared by cosine in double precision; nothing below the threshold links.

Equal vectors are compared once and counted as often as they occur. Filters with one vector are dropped by a
count that is summed map-side. A large filter is cut into tiles of TILE vectors; tile meets tile in a task of
its own. A pair that shares several filters is counted in the first of them only. Tasks return link counts and a
spanning forest per meeting, never all pairs.

Nulls: vectors that are NULL, empty, zero or hold NULL or non-finite components, or whose label is NULL, link with
nothing and are returned with 0 links and themselves as component. Vectors of different length link with
nothing. A NULL vec_id links with nothing and is returned. Rows that repeat a vec_id count as separate vectors of
one component. An empty table gives no rows.

Recall against brute force is measured in the tests; it is not certain but a lost link needs two vectors within
12 degrees to share none of CAPS filters each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import bytescan
from tallyloom.llm.common import Workspace
from tallyloom.llm.components import components
from tallyloom.llm.vectors import matrix, usable
from tallyloom.operators.joins import lookup_join

THRESHOLD = 0.98
BLOCKS, WORDS, CAPS, TILE, SEED = 4, 24, 32, 256, 7


def _code(dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per part: which components, after a fixed shuffle, and its unit vectors."""
    rng = np.random.default_rng(SEED)
    order = rng.permutation(dims)
    out = []
    for part in np.array_split(order, BLOCKS):
        words = rng.standard_normal((WORDS, len(part)))
        out.append((part, words / np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-300)))
    return out


def _best(left: np.ndarray, right: np.ndarray, left_no: np.ndarray, right_no: np.ndarray, base: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The `keep` largest sums of one entry of each side, both sorted downwards, with their combined numbers.
    The sum of entries i and j is among them only if (i + 1) * (j + 1) <= keep."""
    i, j = np.meshgrid(np.arange(left.shape[1]), np.arange(right.shape[1]), indexing="ij")
    near = ((i + 1) * (j + 1)).ravel() <= keep
    i, j = i.ravel()[near], j.ravel()[near]
    sums = left[:, i] + right[:, j]
    top = np.argsort(-sums, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(sums, top, 1), left_no[np.arange(len(left))[:, None], i[top]] * base + right_no[np.arange(len(left))[:, None], j[top]]


def caps(x: np.ndarray) -> np.ndarray:
    """The numbers of the CAPS best filters of every unit vector."""
    total = number = None
    for part, words in _code(x.shape[1]):
        scores = x[:, part] @ words.T
        order = np.argsort(-scores, axis=1, kind="stable")[:, :CAPS]
        scores = np.take_along_axis(scores, order, 1)
        total, number = (scores, order) if total is None else _best(total, scores, number, order, WORDS, CAPS)
    return number.astype(np.int64)


def _coded(reps: DataFrame) -> DataFrame:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    x = matrix(some.column(2))
                    number = caps(x / np.linalg.norm(x, axis=1, keepdims=True))
                    number = np.sort(number * 65536 + int(size) % 65536, axis=1)
                    lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * number.shape[1], pa.array(number.ravel()))
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), some.column(3), lists], names=["rep", "label", "v", "n", "caps"])

    return reps.mapInArrow(decode, "rep long, label long, v array<double>, n long, caps array<long>")


def _met(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of each meeting: (a, b NULL, n) adds n links to a; (a, b, 0) is a link of the spanning forest."""
    for run in bytescan.runs(batches, ["cap", "label", "low", "high"]):
        x = matrix(run.column("v"))
        if len(x) < 2:
            continue
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        rep, n, tile, lists = (run.column(c) for c in ("rep", "n", "tile", "caps"))
        rep, n, tile, lists = rep.to_numpy(), n.to_numpy(), tile.to_numpy(), matrix(lists, np.int64)
        low, high, cap = run.column("low")[0].as_py(), run.column("high")[0].as_py(), run.column("cap")[0].as_py()
        one = np.flatnonzero(tile == low)
        two = one if low == high else np.flatnonzero(tile == high)
        i, j = np.nonzero(x[one] @ x[two].T >= threshold - 1e-9)
        i, j = one[i], two[j]
        if low == high:
            i, j = i[i < j], j[i < j]
        close = (x[i] * x[j]).sum(1) >= threshold
        i, j = i[close], j[close]
        counts, parent, kept = np.zeros(len(x), np.int64), np.arange(len(x)), []
        for at in range(0, len(i), 4096):
            a, b = i[at : at + 4096], j[at : at + 4096]
            shared = (lists[a][:, :, None] == lists[b][:, None, :]).any(2)
            first = np.where(shared, lists[a], np.iinfo(np.int64).max).min(1) == cap
            a, b = a[first], b[first]
            np.add.at(counts, a, n[b])
            np.add.at(counts, b, n[a])
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                while parent[p] != p:
                    parent[p] = p = parent[parent[p]]
                while parent[q] != q:
                    parent[q] = q = parent[parent[q]]
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    kept.append((rep[p], rep[q]))
        some = np.flatnonzero(counts)
        if len(some):
            a = np.concatenate([rep[some], np.array([e[0] for e in kept], np.int64)])
            b = pa.array([None] * len(some) + [int(e[1]) for e in kept], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([counts[some], np.zeros(len(kept), np.int64)]))], names=["a", "b", "n"])


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of the table."""
    spark = table.sparkSession
    work = Workspace(spark, "neardup")
    rows = table.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    able = usable(rows, "v").where("label IS NOT NULL AND vec_id IS NOT NULL").where(F.exists("v", lambda x: x != 0))
    able = work.keep(able.withColumn("same", F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256)), "able")
    reps = able.groupBy("label", "same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = work.keep(reps, "reps")
    members = work.keep(lookup_join(able.select("vec_id", "label", "same"), reps, ["label", "same"], "inner").select("vec_id", "rep", "n"), "members")
    vectors = reps.join(able.select(F.col("vec_id").alias("rep"), "label", "same", "v").dropDuplicates(["rep", "label", "same"]), ["rep", "label", "same"])
    coded = work.keep(_coded(vectors.select("rep", "label", "v", "n")), "coded")
    listed = coded.select("rep", "label", F.explode("caps").alias("cap"))
    sizes = listed.groupBy("label", "cap").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = work.keep(lookup_join(listed, sizes, ["label", "cap"], "inner").select("rep", "label", "cap", "size"), "shared")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    placed = shared.withColumns({"tiles": tiles, "tile": F.pmod(F.xxhash64("rep"), tiles).cast("int")})
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select("rep", "label", "cap", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    placed = placed.join(coded.select("rep", "label", "v", "n", "caps"), ["rep", "label"])
    keys = ["cap", "label", "low", "high"]
    met = placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda b: _met(b, threshold), "a long, b long, n long")
    met = work.keep(met, "met")
    linked = components(met.where("b IS NOT NULL").select("a", "b"), "neardup-components")
    counts = met.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    known = reps.groupBy("rep").agg(F.max("n").alias("copies"))
    by_rep = known.join(counts, "rep", "left").join(linked.withColumnRenamed("v", "rep"), "rep", "left")
    by_rep = work.keep(by_rep.select("rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "by-rep")
    found = lookup_join(members, by_rep, ["rep"], "inner").select("vec_id", "n_links", "component_id")
    rest = rows.select("vec_id", "label", "v")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    alone = rest.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = found.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
