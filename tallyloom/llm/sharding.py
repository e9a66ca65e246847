"""Rendezvous hashing: rows to weighted shards by a stable key.

Every shard bids for a key with -ln(u) / weight, u drawn from a hash of the key and the shard's number; the least bid
wins. A bid depends on nothing but key, shard and weight, so a shard that is added wins keys only for itself, one
that is taken away gives up only its own, and a shard's share of the keys is its share of the weight. There is no ring
and no table to hand out: the decision is one expression of SQL functions over the row.

Slots number the rows of a shard without gaps, by key, then size and checksum. A text is read once, for its size and
checksum; what follows moves narrow rows. They are dealt by ranges of (shard, key, ...), so one shard is many tasks;
each task numbers its rows as they come, and the rows before it are a sum over a row per task and shard. Rows that
agree in all columns are told apart by a stored number, so that a key with any share of the rows is dealt to many
tasks too; which of such twins gets which slot is open, and no column tells.

Nulls: a NULL key is a key of its own; all its rows go to one shard. A NULL text has no bytes and checksum 0, as an
empty one. Repeated rows get a slot each. Ties of bids go to the smaller shard. An empty table gives no rows. Columns of
the caller named like results (`shard`, `slot`) are replaced, all others pass through `assign` and `moves`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Workspace
from tallyloom.operators.joins import lookup_join

#: Hexadecimal digits of a hash that make a draw: 52 bits, which a double holds exactly.
_DIGITS = 13


def _bid(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight of one shard, u from the hash of key and shard number, never 0 or 1."""
    digest = F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary"))
    drawn = F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double")
    return -F.log((drawn + 0.5) / F.lit(float(16**_DIGITS))) / F.lit(float(weight))


def shard_of(keys: Sequence[str | Column], weights: Mapping[int, float]) -> Column:
    """The shard of a row. `weights` gives every shard's number and its weight; a weight of 0 takes nothing."""
    open_ = {shard: weight for shard, weight in sorted(weights.items()) if weight > 0}
    if not open_ or any(weight < 0 for weight in weights.values()):
        raise ValueError("weights must not be negative, and one shard at least needs a positive one")
    parts = [k if isinstance(k, Column) else F.col(k) for k in keys]
    # Lengths keep ("a", "bc") and ("ab", "c") apart; NULL has no length.
    texts = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    key = F.concat(*texts)
    bids = [F.struct(_bid(key, shard, weight).alias("bid"), F.lit(shard).alias("shard")) for shard, weight in open_.items()]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def assign(rows: DataFrame, keys: Sequence[str], weights: Mapping[int, float]) -> DataFrame:
    """All rows and columns, and the `shard` of each."""
    return rows.withColumn("shard", shard_of(keys, weights))


def moves(rows: DataFrame, keys: Sequence[str], before: Mapping[int, float], after: Mapping[int, float]) -> DataFrame:
    """from_shard, to_shard, n_rows: what changes place when the shards change."""
    pairs = rows.select(shard_of(keys, before).alias("from_shard"), shard_of(keys, after).alias("to_shard"))
    return pairs.where("from_shard <> to_shard").groupBy("from_shard", "to_shard").agg(F.count(F.lit(1)).alias("n_rows"))


def write(rows: DataFrame, keys: Sequence[str], weights: Mapping[int, float], path: str) -> None:
    """Write the rows to one folder a shard, below `path`. The rows of a shard may come from any number of tasks; nothing is shuffled."""
    assign(rows, keys, weights).write.partitionBy("shard").parquet(path)


def slots(rows: DataFrame, order: Sequence[str], work: Workspace) -> DataFrame:
    """Add `slot`, a number from 0 without gaps within `shard`, by the columns of `order`.

    `rows` must be a stored frame with a column `_number` that no two rows share; it is dropped."""
    by = ["shard", *order, "_number"]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # Within a task the number counts up in the order of rows, and a shard's rows stand side by side.
    dealt = work.keep(dealt.drop("_number").withColumns({"_task": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "dealt")
    parts = dealt.groupBy("shard", "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy("shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    placed = lookup_join(dealt, parts, ["shard", "_task"], "inner")
    return placed.withColumn("slot", F.col("_before") + F.col("_place") - F.col("_first")).drop("_task", "_place", "_first", "_before")


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard with one more shard, one row per document row.

    The law is `key`: the document's number and the count of shards decide. Equal texts under different numbers are free to part."""
    work = Workspace(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    equal = {shard: 1.0 for shard in range(n_shards)}
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(["doc_id"], equal).alias("shard"),
        shard_of(["doc_id"], equal | {n_shards: 1.0}).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_number"),
    )
    placed = slots(work.keep(narrow, "narrow"), ["doc_id", "size", "text_crc32"], work)
    work.drop("narrow")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
