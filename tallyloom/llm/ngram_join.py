"""Jaccard join of documents on word shingles by signature trees, down to connected classes.

A document's set holds its distinct SHINGLE-word shingles as 64-bit hashes. Documents with equal sets (128-bit
fingerprint) are one from the start. Two sets that reach the threshold share one of the first
n - ceil(threshold * n) + 1 shingles of each, in any fixed order of shingles; such a shingle makes a block. The order puts
shingles that are frequent in a bounded sample last, which keeps shared lines and passages out of blocks; the
order decides speed, never results. Blocks are counted map-side; those with one set disappear, those with the
same members become one.

Within a block (hot ones in tiles) a signature tree is built: a leaf holds a set's bitmap, an inner node the OR of
its children's, the range of their sizes and the largest number of shingles that share bits. A dual traversal
descends into a pair of nodes only if popcount(a & b) plus those extras reaches the overlap that the smallest
sizes would need, and if the size ranges are compatible. Bitmaps of long texts are full, so pairs of leaves that
remain are sieved once more by parity sketches, two to four bits a shingle: each says for every stretch of the hash
range whether it holds an odd number of shingles, and where two sketches differ the sets differ too. More
differences than the threshold allows rule a pair out. What is left is verified on whole sets.

Two rounds avoid all pairs of a block. The first verifies at most two partners per set and tile, which joins nearly
all that belongs together. The second traverses only blocks that still hold different components and yields
every remaining pair across components, so no link between components is lost. There the rows of a block's
largest component meet the others only, never one another. Both kinds are dealt into parts of about MEET sets, and a
task takes one part against another: two trees are traversed together, and each pair of sets meets once.

Nulls: a NULL or empty text has an empty set, links with nothing and is its own component. A NULL doc_id is returned
with its set size and a NULL component, and links with nothing. Repeated rows each give a row. An id that repeats
with another text is as many nodes as it has sets: each row gets the smallest id among the rows its own text reaches. An empty table gives
none. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import bytescan
from tallyloom.llm.common import Workspace, rows_with
from tallyloom.llm.components import components

SHINGLE, PERCENT = 5, 75
WORDS, FAN, TILE = 64, 16, 512  # bitmap words of 64 bits, children per node, sets per tile
MEET, NODE_PAIRS = 2048, 2048  # sets per part of the second round, node pairs a traversal looks at together
SAMPLE_DOCS, FREQUENT_SHARE, FREQUENT_MOST = 4000, 0.004, 20_000

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_PLACE = np.array([pow(0xA24BAED4963EE407, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row of a batch."""
    for at, _, raw, offsets in bytescan.slices(texts):
        data = _LOWER[raw]
        starts, ends, before = bytescan.words(data, offsets, _WORD)
        words = bytescan.span_hashes(data, starts, ends)
        n = len(words) - SHINGLE + 1
        whole = bytescan.mixed(sum(words[k : k + n] * _PLACE[k] for k in range(SHINGLE))) if n > 0 else np.zeros(0, np.uint64)
        for k in range(len(offsets) - 1):
            a, b = int(before[k]), int(before[k + 1])
            if b - a >= SHINGLE:
                yield at + k, np.unique(whole[a : b - SHINGLE + 1])
            elif b > a:
                short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield at + k, bytescan.mixed(np.array([short]))
            else:
                yield at + k, np.zeros(0, np.uint64)


def _parity(s: np.ndarray) -> bytes:
    """For each of m equal stretches of the hash range, whether it holds an odd number of the sorted hashes; m is
    the smallest power of two that is at least twice their number."""
    depth = max(3, (2 * len(s) - 1).bit_length())
    stretch = (s >> np.uint64(64 - depth)).astype(np.int64)
    starts = np.flatnonzero(np.diff(stretch, prepend=-1))
    odd = np.diff(np.append(starts, len(s))) % 2 == 1
    bits = np.zeros(1 << depth, bool)
    bits[stretch[starts[odd]]] = True
    return np.packbits(bits).tobytes()


def _differences(x: pa.Scalar, y: pa.Scalar) -> int:
    """Stretches that two sketches do not agree on, the finer one folded to the other's stretches."""
    x, y = sorted((np.unpackbits(np.frombuffer(v.as_buffer(), np.uint8)) for v in (x, y)), key=len)
    return int((x != np.bitwise_xor.reduce(y.reshape(len(x), -1), axis=1)).sum())


def fingerprints(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two 64-bit marks of a set of hashes."""
    return s.sum(dtype=np.uint64), bytescan.mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)


def _described(docs: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "f1", "f2", "bits", "parity", "prefix"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), []
            for k, s in shingle_sets(batch.column(1)):
                n = len(s)
                bits = np.zeros(WORDS * 64, bool)
                bits[(s & np.uint64(WORDS * 64 - 1)).astype(np.int64)] = True
                if len(frequent):
                    late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                    ordered = np.concatenate([s[~late], s[late]]) if late.any() else s
                else:
                    ordered = s
                prefix = ordered[: n - -(-percent * n // 100) + 1] if n else ordered
                f1, f2 = fingerprints(s)
                rows.append((keys[k], n, f1.astype(np.int64), f2.astype(np.int64), np.packbits(bits).tobytes(), _parity(s), prefix.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(describe, "doc_id long, n int, f1 long, f2 long, bits binary, parity binary, prefix array<long>")


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles of more than FREQUENT_SHARE of a bounded sample of documents; at most FREQUENT_MOST."""
    keys = docs.where("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()
    sample = docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id", "left_semi").select("text")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in shingle_sets(batch.column(0))]
            values, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["shingle", "n"])

    counts = sample.mapInArrow(take, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= max(8, int(SAMPLE_DOCS * FREQUENT_SHARE))).orderBy(F.desc("n"), "shingle").limit(FREQUENT_MOST).collect()
    return np.sort(np.array([r["shingle"] for r in top], np.int64).view(np.uint64))


class _Tree:
    """Levels of nodes over sets in the given order; level 0 is the sets themselves."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, height: int = 1):
        extra = sizes - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, sizes, sizes, extra)]
        while len(self.levels[-1][0]) > 1 or len(self.levels) < height:
            b, low, high, extra = self.levels[-1]
            cuts = np.arange(0, len(b), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(extra, cuts)))

    def pairs(self, percent: int, other: _Tree | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets that the bounds do not rule out: a < b of this tree, or a of this one and b of another as high."""
        ours, theirs = self.levels, (other or self).levels
        todo = [(len(ours) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            if len(a) > NODE_PAIRS:
                todo += [(level, a[NODE_PAIRS:], b[NODE_PAIRS:]), (level, a[:NODE_PAIRS], b[:NODE_PAIRS])]
                continue
            (bits_a, low_a, high_a, extra_a), (bits_b, low_b, high_b, extra_b) = ours[level], theirs[level]
            shared = np.bitwise_count(bits_a[a] & bits_b[b]).sum(1, dtype=np.int64) + np.minimum(extra_a[a], extra_b[b])
            need = -(-percent * (low_a[a] + low_b[b]) // (100 + percent))
            fine = (shared >= need) & (100 * high_b[b] >= percent * low_a[a]) & (100 * high_a[a] >= percent * low_b[b])
            a, b = a[fine], b[fine]
            if level == 0:
                yield (a, b) if other else (a[a < b], b[a < b])
            elif len(a):
                step = np.arange(FAN)
                x = (a[:, None, None] * FAN + step[None, :, None] + np.zeros((1, 1, FAN), np.int64)).ravel()
                y = (b[:, None, None] * FAN + step[None, None, :] + np.zeros((1, FAN, 1), np.int64)).ravel()
                inside = (x < len(ours[level - 1][0])) & (y < len(theirs[level - 1][0]))
                if not other:
                    inside &= x <= y
                todo.append((level - 1, x[inside], y[inside]))


class _Part:
    """Sets of one part of a block, in the order of their sizes, with their tree."""

    def __init__(self, run: pa.RecordBatch):
        rep, sizes, comp = (run.column(c).to_numpy() for c in ("rep", "n", "component"))
        bits = np.frombuffer(b"".join(run.column("bits").to_pylist()), np.uint64).reshape(len(rep), WORDS)
        order = np.lexsort((rep, comp, sizes))
        self.rep, self.sizes, self.comp, self.bits = rep[order], sizes[order].astype(np.int64), comp[order], bits[order]
        self.tree = _Tree(self.bits, self.sizes)

    def links(self, percent: int, other: _Part | None = None) -> Iterator[np.ndarray]:
        """Places of sets of different components that may link, a slice of the traversal at a time."""
        mine, theirs = self.tree, None
        if other:
            height = max(len(self.tree.levels), len(other.tree.levels))
            mine, theirs = _Tree(self.bits, self.sizes, height), _Tree(other.bits, other.sizes, height)
        for a, b in mine.pairs(percent, theirs):
            apart = self.comp[a] != (other or self).comp[b]
            if apart.any():
                yield np.stack([a[apart], b[apart]])


def _nearest(part: _Part, pairs: np.ndarray) -> np.ndarray:
    """At most two partners per set: the first that the order has, and the one with most in common."""
    if pairs.shape[1] <= len(part.rep):
        return pairs
    i, j = np.concatenate([pairs[0], pairs[1]]), np.concatenate([pairs[1], pairs[0]])
    shared = np.concatenate([np.bitwise_count(part.bits[pairs[0, k : k + 8192]] & part.bits[pairs[1, k : k + 8192]]).sum(1, dtype=np.int64) for k in range(0, pairs.shape[1], 8192)])
    shared = np.concatenate([shared, shared])
    best = np.lexsort((j, -shared, i))
    least = np.lexsort((j, i))
    pick = np.concatenate([o[np.unique(i[o], return_index=True)[1]] for o in (best, least)])
    return np.unique(np.sort(np.stack([i[pick], j[pick]]), 0), axis=1)


def _candidates(batches: Iterator[pa.RecordBatch], percent: int, everything: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a < b) of sets of different components from each run of (block, tile, across): the rows of the part `tile` meet
    those of the part `across`, or one another where the two are the same."""
    out: list[np.ndarray] = []
    held = 0
    for run in bytescan.runs(batches, ["block", "tile", "across"]):
        first = pc.equal(run.column("part"), run.column("tile"))
        one = _Part(run.filter(first))
        two = None if run.column("tile")[0] == run.column("across")[0] else _Part(run.filter(pc.invert(first)))
        if not len(one.rep) or (two and not len(two.rep)):
            continue
        found = one.links(percent, two)
        if not everything:
            found = [_nearest(one, np.concatenate([*found, np.zeros((2, 0), np.int64)], 1))]
        for a, b in found:
            if len(a):
                out.append(np.sort(np.stack([one.rep[a], (two or one).rep[b]]), 0))
                held += len(a)
            if held > 100_000:
                yield _pair_batch(out)
                out, held = [], 0
    if out:
        yield _pair_batch(out)


def _pair_batch(out: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.concatenate(out, 1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def _sieved(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose parity sketches differ no more than two sets at the threshold can."""

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.add(batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy())
            apart = np.array([_differences(x, y) for x, y in zip(batch.column(4), batch.column(5), strict=True)], np.int64)
            yield batch.select([0, 1]).filter(pa.array((100 + percent) * apart <= (100 - percent) * sizes))

    side = lambda key: signs.select(F.col("rep").alias(key), F.col("n").alias(f"n_{key}"), F.col("parity").alias(f"parity_{key}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "parity_a", "parity_b")
    return rows.mapInArrow(sieve, "a long, b long")


def _verified(tried: DataFrame, signs: DataFrame, docs: DataFrame, reps: DataFrame, work: Workspace, percent: int, name: str) -> DataFrame:
    """Pairs whose whole sets reach the threshold. A set is read from a row that has the id of its representative; other texts
    under that id have other fingerprints and find no pair."""
    pairs = work.keep(_sieved(tried, signs, percent), f"sieved-{name}")
    used = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    known = work.keep(reps.join(used, "rep", "left_semi"), f"wanted-{name}")
    texts = rows_with(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", known.select("doc_id").distinct())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in shingle_sets(batch.column(1))]
            marks = np.array([fingerprints(s) for s in sets], np.uint64).reshape(len(sets), 2).view(np.int64)
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())], names=["f1", "f2", "shingles"])

    found = texts.mapInArrow(gather, "f1 long, f2 long, shingles binary").join(known.select("f1", "f2", F.col("rep").alias("doc_id")), ["f1", "f2"])
    sets = work.keep(found.select("doc_id", "shingles").dropDuplicates(["doc_id"]), f"sets-{name}")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[place] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda key: sets.select(F.col("doc_id").alias(key), F.col("shingles").alias(f"set_{key}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    links = work.keep(rows.mapInArrow(measure, "a long, b long"), f"links-{name}")
    work.drop(f"sets-{name}")
    return links


def _unlike(found: DataFrame) -> DataFrame:
    """Of blocks with the same members the smallest. Members are told by their number and two 64-bit fingerprints."""
    marks = found.groupBy("block", "size").agg(F.bit_xor(F.xxhash64("rep")).alias("m1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("m2"))
    return marks.groupBy("size", "m1", "m2").agg(F.min("block").alias("block")).select("block")


def _dealt(start: Column, parts: Column) -> Column:
    """A part of the row's own among `parts` of its block, numbered from `start`."""
    return (start + F.pmod(F.xxhash64("rep", "block"), F.greatest(parts, F.lit(1)))).cast("int")


def _meetings(still: DataFrame) -> DataFrame:
    """Rows of blocks that hold several components, once for every pair of parts (tile <= across) that their own part is in.

    A block of up to MEET rows is one part. Above, the rows outside the largest component fill the first parts and
    those of the largest the parts from `others` on; a pair of parts needs one of the first kind.
    """
    small = F.col("size") <= MEET
    others = F.when(small, 1).otherwise(F.ceil((F.col("size") - F.col("most")) / MEET)).cast("int")
    all_ = F.when(small, 1).otherwise(F.col("others") + F.ceil(F.col("most") / MEET)).cast("int")
    inner = (F.col("component") == F.col("largest")) & ~small
    counted = still.withColumn("others", others).withColumn("all", all_)
    own = F.when(inner, _dealt(F.col("others"), F.col("all") - F.col("others"))).otherwise(_dealt(F.lit(0), F.col("others")))
    partners = F.when(inner, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("all") - 1))
    dealt = counted.select("block", "rep", "component", own.alias("part"), F.explode(partners).alias("partner"))
    return dealt.select("block", F.least("part", "partner").alias("tile"), F.greatest("part", "partner").alias("across"), "part", "rep", "component")


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per document row."""
    return marked_classes(docs, percent).select("doc_id", "n_shingles", "component_id")


def marked(docs: DataFrame) -> DataFrame:
    """All rows and columns, with the fingerprints of each row's set in the columns that `MARKS` names."""
    at = docs.columns.index("text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprints(s) for _, s in shingle_sets(batch.column(at))], np.uint64).reshape(batch.num_rows, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks[:, 0]), pa.array(marks[:, 1])], names=[*batch.schema.names, *MARKS])

    columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{m} long" for m in MARKS)])
    return docs.mapInArrow(mark, columns)


MARKS = ("_set_mark_1", "_set_mark_2")


def marked_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`classes`, with the fingerprints of each row's set, and a number of its class: where ids repeat, classes may share an id."""
    work = Workspace(docs.sparkSession, "ngram-join", wide=True)
    all_ = work.keep(_described(docs, _frequent(docs), percent), "described")
    some = all_.where("n > 0 AND doc_id IS NOT NULL")
    # A set stands for all rows that have it. It is numbered once, with the smallest id among them: ids may repeat with other texts.
    reps = some.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id"))
    reps = work.keep(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    first = some.join(reps, ["doc_id", "f1", "f2"]).dropDuplicates(["rep"])
    first = work.keep(first.select("rep", "n", "bits", "parity", "prefix"), "first")
    members = work.keep(all_.select("doc_id", "n", "f1", "f2").join(reps.select("f1", "f2", "rep"), ["f1", "f2"], "left").select("doc_id", "n", "f1", "f2", F.when(F.col("n") > 0, F.col("rep")).alias("rep")), "members")
    work.drop("described")

    tokens = first.select("rep", F.explode("prefix").alias("block"))
    counted = work.keep(tokens.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "counted")
    found = work.keep(tokens.join(counted, "block").select("block", "rep", "size"), "found")
    blocks = work.keep(_unlike(found), "blocks")
    shared = work.keep(found.join(blocks, "block", "left_semi"), "shared")
    work.drop("counted", "found", "blocks")
    signs = first.select("rep", "n", "bits")

    def traverse(rows: DataFrame, everything: bool, name: str) -> DataFrame:
        meeting = ("block", "tile", "across")
        rows = rows.join(signs, "rep").select(*meeting, "part", "rep", "n", "component", "bits").repartition(*meeting)
        found = rows.sortWithinPartitions(*meeting).mapInArrow(lambda b: _candidates(b, percent, everything), "a long, b long")
        return work.keep(found.distinct(), name)

    own = _dealt(F.lit(0), F.ceil(F.col("size") / TILE))
    diagonal = shared.select("block", own.alias("tile"), own.alias("across"), own.alias("part"), "rep", F.col("rep").alias("component"))
    tried = traverse(diagonal, False, "pairs-1")
    links = _verified(tried, first, docs, reps, work, percent, "1")
    known = components(links, "ngram-components-1")

    labelled = shared.join(known.withColumnRenamed("v", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = work.keep(labelled.select("block", "rep", "size", "component"), "labelled")
    parts = labelled.groupBy("block", "component").agg(F.count(F.lit(1)).alias("rows"))
    open_ = parts.groupBy("block").agg(
        F.count(F.lit(1)).alias("parts"), F.max("rows").alias("most"), F.max_by("component", F.struct("rows", "component")).alias("largest")
    ).where("parts > 1")
    rest = traverse(_meetings(labelled.join(work.keep(open_, "open"), "block")), True, "pairs-2")
    rest = work.keep(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    more = _verified(rest, first, docs, reps, work, percent, "2")
    final = components(links.unionByName(more), "ngram-components-2")
    labelled = reps.select("rep", "doc_id").join(final.withColumnRenamed("v", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_rep = members.join(labelled.select("rep", "component").join(least, "component").select("rep", "component", "component_id"), "rep", "left")
    own_id = F.coalesce("component_id", "doc_id")
    return by_rep.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own_id).alias("component_id"), F.col("f1").alias(MARKS[0]), F.col("f2").alias(MARKS[1]), F.col("component").alias("class"))
