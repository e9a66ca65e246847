"""Lookup joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    null_safe: bool = False,
) -> DataFrame:
    """Join `rows` to `lookup`, which must be unique on `keys`; key columns come from `rows`.

    `how` is left, inner, left_semi or left_anti. `lookup` usually comes out of an aggregate on
    the same keys, whose partitioning would satisfy the join, leaving no exchange for adaptive
    execution to split when one key is hot. The extra hash key asks for one more exchange of the
    narrow lookup side, so both inputs of the join are shuffle stages and a hot key's rows are
    spread over many tasks. Below the size threshold Spark still broadcasts the lookup.
    """
    marks = {k: f"_key_{i}" for i, k in enumerate(keys)}
    left = rows.withColumn("_mix", F.xxhash64(*keys))
    right = lookup.withColumn("_mix_r", F.xxhash64(*keys)).withColumnsRenamed(marks)
    condition: Column = F.col("_mix") == F.col("_mix_r")
    for k, mark in marks.items():
        same = F.col(k).eqNullSafe(F.col(mark)) if null_safe else F.col(k) == F.col(mark)
        condition = condition & same
    return left.join(right, condition, how).drop("_mix", "_mix_r", *marks.values())


def local_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join `rows` to `lookup`, which must be unique on `keys`, by these keys alone, so that frames stored by them meet without a
    shuffle. Key columns come from `rows`. Which side is small plays no part: buckets meet buckets."""
    marks = {k: f"_key_{i}" for i, k in enumerate(keys)}
    right = lookup.withColumnsRenamed(marks).hint("merge")
    condition: Column | None = None
    for k, mark in marks.items():
        same = F.col(k) == F.col(mark)
        condition = same if condition is None else condition & same
    return rows.join(right, condition, how).drop(*marks.values())


def computed_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however often they are used afterwards.

    A filter on a computed column is pushed below the projection and takes a copy of the
    expression along, and so does every column built on it. A generator stops both: what it
    yields is a plain value. Worth it for costly expressions only, such as parsing JSON.
    """
    once = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(once)))
