"""Table set, scoped replace, inventory, checks and ground truth."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom import config, schemas
from tallyloom.operators import groundtruth, quality
from tallyloom.plans import reconcile
from tallyloom.sources import adapters, orders, tables
from tallyloom.sources.staging import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS lake")
    tables.create_tables(spark, "lake")
    tables.create_tables(spark, "lake")  # safe to run again
    return "lake"


def manifest_rows(spark, *rows):
    base = spark.createDataFrame(rows, "vendor_id string, statement_period string, manifest_id string")
    for f in schemas.schema("validation_mutation_manifest"):
        if f.name not in base.columns:
            base = base.withColumn(f.name, F.lit(None))
    return base


def contents(spark, name, *columns):
    return sorted(tuple(r) for r in spark.table(name).select(*columns).collect())


def test_tables_have_the_declared_columns(spark, database):
    for name in schemas.TABLES:
        table = spark.table(f"{database}.{name}")
        assert {f.name: f.dataType for f in table.schema} == {f.name: f.dataType for f in schemas.schema(name)}


def test_replace_scope(spark, database):
    name, key = "validation_mutation_manifest", ("vendor_id", "statement_period", "manifest_id")
    may, june = {"vendor_id": "A", "statement_period": "2026-05"}, {"vendor_id": "A", "statement_period": "2026-06"}
    tables.replace_scope(spark, name, manifest_rows(spark, ("A", "2026-05", "1"), ("A", "2026-05", "2")), may, database)
    tables.replace_scope(spark, name, manifest_rows(spark, ("A", "2026-06", "3")), june, database)
    tables.replace_scope(spark, name, manifest_rows(spark, ("A", "2026-05", "4")), may, database)
    full = f"{database}.{name}"
    assert contents(spark, full, *key) == [("A", "2026-05", "4"), ("A", "2026-06", "3")]
    # No new rows still clears the scope.
    tables.replace_scope(spark, name, manifest_rows(spark, ("A", "2026-05", "9")).limit(0), may, database)
    assert contents(spark, full, *key) == [("A", "2026-06", "3")]
    with pytest.raises(ValueError):
        tables.replace_scope(spark, name, manifest_rows(spark, ("A", "2026-05", "9")), {"vendor_id": "A"}, database)


def queue_rows(spark, *rows):
    base = spark.createDataFrame(rows, "vendor_id string, statement_period string, statement_id string, review_id string")
    for f in schemas.schema("validation_document_review_queue"):
        if f.name not in base.columns:
            base = base.withColumn(f.name, F.lit(None))
    return base


def test_replace_statements(spark, database):
    name = "validation_document_review_queue"
    full, key = f"{database}.{name}", ("vendor_id", "statement_period", "statement_id", "review_id")
    scope = lambda *rows: spark.createDataFrame(rows, "vendor_id string, statement_period string, statement_id string")
    first = queue_rows(spark, ("A", "05", "s1", "1"), ("A", "05", "s2", "2"), ("A", "06", "s3", "3"), ("B", "05", "s4", "4"))
    tables.replace_statements(spark, name, first, first.select("vendor_id", "statement_period", "statement_id"), database)
    tables.replace_statements(
        spark, name, queue_rows(spark, ("A", "05", "s1", "5"), ("A", "05", "s1", "6")), scope(("A", "05", "s1")), database
    )
    assert contents(spark, full, *key) == [
        ("A", "05", "s1", "5"), ("A", "05", "s1", "6"), ("A", "05", "s2", "2"), ("A", "06", "s3", "3"), ("B", "05", "s4", "4"),
    ]
    # Clearing a partition's only statement empties the partition.
    tables.replace_statements(spark, name, first.limit(0), scope(("A", "06", "s3")), database)
    assert [r[2] for r in contents(spark, full, *key)] == ["s1", "s1", "s2", "s4"]


def test_inventory_and_checks_with_missing_tables(spark, database):
    known = tables.catalog_tables(spark, ["gold_exceptions", "no_such_table"], database)
    counts = {r.table_name: r.row_count for r in tables.inventory(spark, known).collect()}
    assert counts == {"gold_exceptions": 0, "no_such_table": None}
    report = quality.run_checks(spark, tables.catalog_tables(spark, database=database)).orderBy("position").collect()
    assert len(report) == 12 and report[0].name == "Bronze Vendor Statement" and not report[0].passed
    passed = {r.name for r in report if r.passed}
    assert passed == {"Review Queue", "AI Audit Log"} | ({"Mutation Manifest"} & passed)
    missing = quality.run_checks(spark, {}).collect()
    assert not any(r.passed for r in missing) and {r.row_count for r in missing} == {None}


def test_bad_status_fails_only_its_check(spark):
    good = spark.createDataFrame([("RECONCILED",), (None,), ("ODD",)], "overall_status string")
    report = {r.name: r for r in quality.run_checks(spark, {"gold_reconciliation_summary": good}).collect()}
    assert report["Gold Reconciliation Summary"].details == "3 row(s), 2 with an unrecognized overall_status"


def test_split_matches_the_mix_exactly(spark):
    mix = config.DEFAULT_MIX
    for n in (0, 1, 7, 202, 1000):
        rows = spark.range(n).withColumnRenamed("id", "key")
        split = groundtruth.proportional_split(rows, mix, F.col("key"), 42)
        got = Counter(r.scenario_type for r in split.collect())
        wanted = {label: round(pct * n) for label, pct in mix.items()}
        wanted[max(wanted, key=wanted.get)] += n - sum(wanted.values())
        assert dict(got) == {label: count for label, count in wanted.items() if count > 0}
        assert sorted(r.split_rank for r in split.collect()) == list(range(n))
    again = groundtruth.proportional_split(spark.range(1000).repartition(3), mix, F.col("id"), 42)
    once = groundtruth.proportional_split(spark.range(1000), mix, F.col("id"), 42)
    assert sorted(again.select("id", "scenario_type").collect()) == sorted(once.select("id", "scenario_type").collect())


def test_whole_job_grades_itself(spark):
    """Planted labels come back out of the matching, through stored and lazy frames alike."""
    bronze = orders.statement_bronze(spark, SF)
    statement = orders.statement_silver(bronze)
    plan = orders.planted(statement)
    silver = statement.unionByName(orders.ledger_silver(orders.ledger_bronze(plan)))
    gold = reconcile.to_gold(silver, keep=stored)
    matched, excepted = gold["gold_matched_invoices"], gold["gold_exceptions"]
    on_statement = excepted.where("statement_record_id IS NOT NULL").count()
    assert matched.count() + on_statement == statement.count()
    shops, vendors = gold["gold_shop_summary"], gold["gold_vendor_summary"]
    assert shops.agg(F.sum("total_invoices")).first()[0] == vendors.agg(F.sum("total_invoices")).first()[0] == 1500
    lazy = reconcile.to_gold(silver)["gold_exceptions"]
    assert sorted(map(str, lazy.collect())) == sorted(map(str, excepted.collect()))
    for name, rows in gold.items():
        tables.conform(rows, name).write.format("noop").mode("overwrite").save()


def test_generated_ledger_adapter(spark):
    statement = orders.statement_silver(orders.statement_bronze(spark, SF))
    ledger = adapters.ledger_rows(statement, orders.VENDOR, config.Adapter())
    plain = config.ScenarioRules()
    assert ledger.count() == 1500 - round(0.08 * 1500) + round(0.03 * 1500)
    assert ledger.where("raw_status = 'PENDING' AND raw_posting_date IS NOT NULL").isEmpty()
    assert set(plain.mix) == set(plain.outcomes)


def test_rules_load_from_files(tmp_path):
    rules = {"amount_comparison_tolerance": 0.5, "minor_variance_threshold_pct": 0.02}
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(rules))
    assert config.load(config.MatchRules, str(path)) == config.MatchRules(0.5, 0.02)
    vendor = {
        "vendor_id": "Z", "vendor_name": "Zed", "period": {"end_date": "2026-05-31"}, "date_format": "MM/dd/yyyy",
        "source_column_mapping": {"Invoice Date": "invoice_date"}, "shop_extraction": {"pattern": "Shop (.*)"},
        "invoice_pattern": "^Z", "revision_suffixes": ["R$"],
    }
    loaded = config.VendorRules.from_mapping(vendor)
    assert loaded.period == "2026-05" and loaded.extraction_method == "pdfplumber_tabular"
    validation = config.ValidationRules.from_mapping({"required_fields": ["a"], "confidence_threshold": None})
    assert validation.required == ("a",) and validation.duplicate_key == ("vendor", "invoice_number", "amount")


def test_replace_scope_leaves_other_scopes(spark, database):
    """Rows of a foreign scope neither enter nor overwrite anything; no row of the scope empties it."""
    name = "validation_mutation_manifest"
    scope = lambda p: {"vendor_id": "Q", "statement_period": p}
    both = manifest_rows(spark, ("Q", "2026-05", "1"), ("Q", "2026-06", "2"))
    tables.replace_scope(spark, name, both, scope("2026-05"), database)
    tables.replace_scope(spark, name, both, scope("2026-06"), database)
    tables.replace_scope(spark, name, manifest_rows(spark, ("Q", "2026-05", "9")), scope("2026-06"), database)
    left = spark.table(f"{database}.{name}").where("vendor_id = 'Q'")
    assert [r["statement_period"] for r in left.collect()] == ["2026-05"]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_counting_reads_no_column(spark, database):
    """The numbers of rows come from the files' footers."""
    counts = tables.inventory(spark, tables.catalog_tables(spark, database=database))
    scans = [line for line in counts._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line]
    assert scans and all("ReadSchema: struct<>" in line and "FileScan parquet" in line for line in scans)


def test_labels_without_ranks_are_the_labels_of_ranks(spark):
    """Also where one hash stands on both sides of a label's end (keys that repeat or are null), and without rows."""
    from pyspark.sql import functions as F

    from tallyloom.operators import groundtruth

    mix = {"a": 0.5, "b": 0.3, "none": 0.0, "c": 0.2}
    for rows in (spark.range(997), spark.range(0), spark.range(40).selectExpr("id % 3 AS id"), spark.range(30).selectExpr("if(id < 20, NULL, id) AS id")):
        ranked = groundtruth.proportional_split(rows, mix, F.col("id"), 7).drop(groundtruth.RANK)
        plain = groundtruth.proportional_split(rows, mix, F.col("id"), 7, rank=False)
        count = lambda x: sorted(map(tuple, x.groupBy(groundtruth.LABEL).count().collect()))
        assert count(ranked) == count(plain) and plain.columns == ranked.columns
    unique = spark.range(997)
    plain = groundtruth.proportional_split(unique, mix, F.col("id"), 7, rank=False)
    assert sorted(plain.collect()) == sorted(groundtruth.proportional_split(unique, mix, F.col("id"), 7).drop(groundtruth.RANK).collect())
    assert "Window" not in plain._jdf.queryExecution().executedPlan().toString()
