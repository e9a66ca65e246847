"""Replacing many partitions at once, crashes in between, and scans that open only their scope."""

import pytest
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.sources.versions import ConflictError, VersionedTable

TABLE = "validation_mutation_manifest"
KEY = ("vendor_id", "statement_period", "manifest_id")


def rows(spark, *given):
    base = spark.createDataFrame(given, "vendor_id string, statement_period string, manifest_id string")
    return base.select(*[(F.col(f.name) if f.name in KEY else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.schema(TABLE)])


def scopes(spark, *given):
    return spark.createDataFrame(given, "vendor_id string, statement_period string")


def contents(frame):
    return sorted(tuple(str(c) for c in r) for r in frame.select(*KEY).collect())


@pytest.fixture
def table(spark, tmp_path):
    made = VersionedTable(spark, str(tmp_path / "manifest"), TABLE)
    assert made.version() == 0 and made.read().count() == 0
    first = rows(spark, ("A", "2026-05", "1"), ("A", "2026-06", "2"), ("B", "2026-05", "3"), ("a/b: c%", "2026-05", "4"), (None, "2026-05", "5"))
    made.replace(first, scopes(spark, ("A", "2026-05"), ("A", "2026-06"), ("B", "2026-05"), ("a/b: c%", "2026-05"), (None, "2026-05")))
    return made


FIRST = sorted([("A", "2026-05", "1"), ("A", "2026-06", "2"), ("B", "2026-05", "3"), ("a/b: c%", "2026-05", "4"), ("None", "2026-05", "5")])


def test_replace_of_several_scopes(spark, table):
    assert contents(table.read()) == FIRST
    assert table.read().schema.simpleString() == schemas.schema(TABLE).simpleString()
    new = rows(spark, ("A", "2026-05", "7"), ("A", "2026-05", "8"), ("B", "2026-05", "9"), (None, "2026-05", "6"), ("C", "2026-05", "out of scope"))
    number = table.replace(new, scopes(spark, ("A", "2026-05"), ("A", "2026-06"), ("B", "2026-05"), (None, "2026-05")))
    assert contents(table.read()) == sorted(
        [("A", "2026-05", "7"), ("A", "2026-05", "8"), ("B", "2026-05", "9"), ("None", "2026-05", "6"), ("a/b: c%", "2026-05", "4")]
    )
    assert contents(table.read(number - 1)) == FIRST  # the state before stays readable
    assert len(table.clean()) == 0  # the first write still holds a partition
    table.replace(rows(spark), scopes(spark, ("a/b: c%", "2026-05")))
    assert len(table.clean()) == 2 and len(table.state()) == 3  # the first write, and one that made no partition


def test_a_writer_that_dies_between_two_partitions_leaves_the_old_state(spark, table, monkeypatch):
    """One partition's files are there, the task of another fails: nothing of the change shows, and a second try succeeds."""
    new = rows(spark, ("A", "2026-05", "7"), ("B", "2026-05", "9"))
    both = scopes(spark, ("A", "2026-05"), ("B", "2026-05"))
    broken = new.withColumn("manifest_id", F.when(F.col("vendor_id") == "B", F.raise_error(F.lit("lost"))).otherwise(F.col("manifest_id")))
    with pytest.raises(Exception, match="lost"):
        table.replace(broken, both)
    assert contents(table.read()) == FIRST and table.version() == 1
    # All partitions are written, the driver is lost before it publishes.
    monkeypatch.setattr(VersionedTable, "_publish", lambda *_: (_ for _ in ()).throw(SystemError("driver lost")))
    with pytest.raises(SystemError):
        table.replace(new, both)
    monkeypatch.undo()
    again = VersionedTable(spark, table.path, TABLE)
    assert contents(again.read()) == FIRST
    again.replace(new, both)
    assert ("A", "2026-05", "7") in contents(again.read()) and ("B", "2026-05", "9") in contents(again.read())
    assert again.clean() and contents(again.read())[0] == ("A", "2026-05", "7")


def test_two_writers_from_one_state(spark, table, monkeypatch):
    late = VersionedTable(spark, table.path, TABLE)
    monkeypatch.setattr(late, "version", lambda: 1)
    table.replace(rows(spark, ("A", "2026-05", "7")), scopes(spark, ("A", "2026-05")))
    after = contents(table.read())
    with pytest.raises(ConflictError):
        late.replace(rows(spark, ("A", "2026-05", "8")), scopes(spark, ("A", "2026-05")))
    assert contents(table.read()) == after and sorted(table._names("states")) == ["1", "2"]


def files_read(frame):
    """Files that the scans of an executed frame opened."""
    frame.collect()
    total, waiting = 0, [frame._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            waiting.append(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            waiting.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numFiles").value()
        children = node.children()
        waiting += [children.apply(k) for k in range(children.size())]
    return total


def test_a_scan_opens_only_its_scope(spark, table, capsys):
    one = table.scan({"vendor_id": "A", "statement_period": "2026-06"})
    assert contents(one) == [("A", "2026-06", "2")] and files_read(one) == 1
    one.explain()
    told = capsys.readouterr().out
    assert "PartitionFilters: [(vendor_id" in told and "DataFilters: []" in told
    assert contents(table.scan({"vendor_id": None})) == [("None", "2026-05", "5")]
    assert files_read(table.read()) == 5
    with pytest.raises(ValueError):
        table.scan({"manifest_id": "1"})


def test_a_scope_table_prunes_at_run_time(spark, table, tmp_path):
    scopes(spark, ("A", "2026-05"), ("B", "2026-05"), ("Z", "2026-05")).coalesce(1).write.parquet(str(tmp_path / "scopes"))
    wanted = table.scan_scopes(spark.read.parquet(str(tmp_path / "scopes")))
    assert contents(wanted) == [("A", "2026-05", "1"), ("B", "2026-05", "3")]
    assert files_read(wanted.select("manifest_id")) == 2 + 1  # two partitions, and the scope table's own file
    assert "dynamicpruning" in wanted._jdf.queryExecution().executedPlan().toString()
