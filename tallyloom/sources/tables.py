"""The table set on Parquet: create, scan a scope, conform, replace a scope, count."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.operators.joins import lookup_join


def _name(table: str, database: str | None) -> str:
    return f"`{database}`.`{table}`" if database else f"`{table}`"


def create_tables(spark: SparkSession, database: str | None = None) -> None:
    """Create the eleven tables where they are missing, partitioned by their replace scope. Overwriting
    them replaces the partitions that get rows and no others; this is a property of each table, so
    that writers in one session cannot disturb each other."""
    for table in schemas.TABLES:
        by = ", ".join(schemas.PARTITIONS[table])
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {_name(table, database)} ({schemas.ddl(table)}) USING parquet "
            f"OPTIONS ('partitionOverwriteMode' 'dynamic') PARTITIONED BY ({by})"
        )


def scoped(rows: DataFrame, vendor_id: str, period: str) -> DataFrame:
    """Rows of one vendor and period; on the tables above both are partition columns."""
    return rows.where((F.col("vendor_id") == vendor_id) & (F.col("statement_period") == period))


def conform(rows: DataFrame, table: str) -> DataFrame:
    """Cast and order columns to the declared schema; all-NULL columns stay typed."""
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.schema(table)])


def replaced(existing: DataFrame, new: DataFrame, scope: DataFrame) -> DataFrame:
    """The state after a scoped replace: existing rows outside `scope`, plus the new rows.

    `scope` holds the keys to clear; it may name keys for which there are no new rows.
    """
    keys = scope.columns
    return lookup_join(existing, scope.distinct(), keys, "left_anti", null_safe=True).unionByName(new)


def _insert(spark: SparkSession, rows: DataFrame, table: str, database: str | None) -> None:
    """Overwrite exactly the partitions that `rows` has."""
    by = list(schemas.PARTITIONS[table])
    body = [f.name for f in schemas.schema(table) if f.name not in by]
    # Partition columns come last in a partitioned table. One shuffle by partition keeps a
    # partition's rows together; adaptive execution splits the large ones, so a vendor with a third
    # of all rows is written by many tasks.
    ready = conform(rows, table).select(*body, *by).hint("rebalance", *by)
    ready.write.insertInto(_name(table, database), overwrite=True)


def replace_scope(
    spark: SparkSession, table: str, rows: DataFrame, scope: Mapping[str, str], database: str | None = None
) -> None:
    """Replace one scope, given as a value for each of the table's partition columns. Rows of other
    scopes play no part, so a table of many scopes can be handed in whole.

    A dynamic overwrite with no rows would leave the old partition in place, so an empty frame
    drops it instead. The test for emptiness looks for one row; hand in a stored frame where
    that would set off long work.
    """
    by = schemas.PARTITIONS[table]
    if set(scope) != set(by):
        raise ValueError(f"scope of {table} needs exactly {', '.join(by)}")
    rows = reduce(lambda r, kv: r.where(F.col(kv[0]) == kv[1]), scope.items(), rows)
    if rows.isEmpty():
        _drop_partition(spark, table, scope, database)
    else:
        _insert(spark, rows, table, database)


def _drop_partition(spark: SparkSession, table: str, scope: Mapping[str, str], database: str | None) -> None:
    spec = ", ".join(f"{column} = '{_escaped(value)}'" for column, value in scope.items())
    spark.sql(f"ALTER TABLE {_name(table, database)} DROP IF EXISTS PARTITION ({spec})")


def _escaped(value: str) -> str:
    """A partition value as the inside of a SQL string; the partition clause takes no parameters."""
    return value.replace("\\", "\\\\").replace("'", "\\'")


def replace_statements(
    spark: SparkSession, table: str, rows: DataFrame, statements: DataFrame, database: str | None = None
) -> None:
    """Replace the rows of some statements and keep the partition's other statements.

    `statements` names what is cleared: the table's partition columns and statement_id. Only the
    partitions it touches are read and rewritten. Spark stages a dynamic overwrite next to the
    table and swaps partition by partition when the job commits, so reading the table in the same
    job is safe; the swap is atomic per partition, not across partitions.
    """
    by = list(schemas.PARTITIONS[table])
    existing = spark.table(_name(table, database))
    touched = statements.select(*by).distinct()
    affected = existing.join(touched, by, "left_semi")
    scope = statements.select(*by, "statement_id")
    state = replaced(conform(affected, table), conform(rows, table), scope)
    # A touched partition that keeps nothing gets no rows, so its old files would stay. Which ones do is
    # found before the write, while `rows` may still read the table's old content. The list has at most
    # one entry per partition, the size of the catalog's own listing.
    emptied = touched.join(state.select(*by).distinct(), by, "left_anti").collect()
    _insert(spark, state, table, database)
    for spec in emptied:
        _drop_partition(spark, table, spec.asDict(), database)


def inventory(spark: SparkSession, tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """Row count per table; a table that is not there counts as NULL instead of failing."""
    counts = None
    for name, rows in tables.items():
        if rows is None:
            one = spark.range(1).select(F.lit(name).alias("table_name"), F.lit(None).cast("bigint").alias("row_count"))
        else:
            one = rows.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def catalog_tables(
    spark: SparkSession, names: Sequence[str] = schemas.TABLES, database: str | None = None
) -> dict[str, DataFrame | None]:
    """Tables by name, None where the catalog has none."""
    return {
        name: spark.table(_name(name, database)) if spark.catalog.tableExists(_name(name, database)) else None
        for name in names
    }
