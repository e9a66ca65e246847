"""The registered queries: one per operator, each over the whole derived input tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import contract as K
from tallyloom.config import MatchRules, ValidationRules
from tallyloom.functions import dates, keys, money, text
from tallyloom.operators import gold, groundtruth, ingest, matching, normalize, quality
from tallyloom.plans import reconcile
from tallyloom.sources import colocated, tables
from tallyloom.sources import orders as source
from tallyloom.sources.staging import staging_folder, stored, together
from tallyloom.sources.versions import VersionedTable
from tallyloom.schemas import schema

Query = Callable[[SparkSession, str], DataFrame]
VALIDATION = ValidationRules()
PROVIDER = "extractor"
_DUPLICATE_KEY = VALIDATION.duplicate_key
_REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


# --- shared inputs ----------------------------------------------------------------------
class _Inputs:
    """Statement and ledger side of one data folder, each derived from the one before.

    `sides` are lazy. Where later steps read the sides several times they start from `silver`,
    the Silver table, written once per query."""

    def __init__(self, spark: SparkSession, sf: str):
        self.statement_bronze = source.statement_bronze(spark, sf)
        self.statement = source.statement_silver(self.statement_bronze)

    @cached_property
    def plan(self) -> DataFrame:
        return source.planted(self.statement)

    @cached_property
    def ledger_bronze(self) -> DataFrame:
        return source.ledger_bronze(self.plan)

    @cached_property
    def ledger(self) -> DataFrame:
        return source.ledger_silver(self.ledger_bronze)

    @cached_property
    def manifest(self) -> DataFrame:
        return source.manifest(self.plan)

    @property
    def sides(self) -> tuple[DataFrame, DataFrame]:
        return self.statement, self.ledger

    @cached_property
    def silver(self) -> tuple[DataFrame, DataFrame]:
        both = stored(self.statement.unionByName(self.ledger), partition_by=["record_source"])
        return normalize.sides(both)

    @cached_property
    def shared(self) -> DataFrame:
        return stored(matching.shared_numbers(*self.silver))

    @cached_property
    def classified(self) -> DataFrame:
        return matching.classify(*self.silver, MatchRules(), self.shared)

    @cached_property
    def classified_table(self) -> DataFrame:
        return stored(gold.read_by_gold(self.classified))

    @cached_property
    def orphans(self) -> DataFrame:
        return gold.orphans(*self.silver, self.shared)

    @cached_property
    def shops(self) -> DataFrame:
        return gold.shop_aggregates(self.classified, self.orphans, self.silver[1])

    @cached_property
    def graded(self) -> DataFrame:
        return groundtruth.grade(self.manifest, self.classified)


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """The page table, written once per query, with each document's shop."""
    return ingest.attach_shop(stored(source.pages(spark, sf)), source.VENDOR)


def _records_of(pages: DataFrame) -> DataFrame:
    return ingest.page_records(pages, source.VENDOR, VALIDATION)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return _records_of(_pages(spark, sf))


def _candidates(pages: DataFrame, records: DataFrame) -> DataFrame:
    """What may enter Bronze, of stored records."""
    return ingest.candidate_records(records, pages, source.VENDOR)


def _candidates_of(pages: DataFrame) -> DataFrame:
    """The same of pages whose records nothing else reads: only the valid ones are written."""
    return ingest.candidate_records(_records_of(pages), pages, source.VENDOR, keep=stored)


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.flag_duplicates(_candidates_of(_pages(spark, sf)), _DUPLICATE_KEY)


def _timeless(rows: DataFrame, table: str) -> DataFrame:
    """All columns of a table but its time stamps, which belong to the run."""
    return rows.select(*[f.name for f in schema(table) if f.dataType.typeName() != "timestamp"])


# --- scans and writes ----------------------------------------------------------------------
def _silver_table(spark: SparkSession, sf: str) -> VersionedTable:
    """The statement side as a stored table of as many partitions as it has vendors and periods, written in one change."""
    table = VersionedTable(spark, f"{staging_folder(spark)}/silver-{uuid.uuid4().hex}", "silver_reconciliation_standard")
    rows = stored(_Inputs(spark, sf).statement)
    table.replace(rows, rows.select(*table.by))
    return table


_SCANNED = ["vendor_id", "statement_period", "invoice_number", "shop", "outstanding_amount"]


@query
def scan_scope(spark, sf):
    return _silver_table(spark, sf).scan({"vendor_id": "V1", "statement_period": "1997-05"}).select(*_SCANNED)


@query
def scan_scopes(spark, sf):
    """The scopes that a table lists: vendors and months of orders above a price."""
    dear = source.lines(spark, sf).where("cents > 49900000").select("vendor_id", "statement_period")
    return _silver_table(spark, sf).scan_scopes(dear).select(*_SCANNED)


@query
def replaced_scopes(spark, sf):
    """The stored table after one change of many scopes: May comes again at twice the amount, December goes."""
    table = _silver_table(spark, sf)
    month = F.substring("statement_period", 6, 2)
    now = table.read()
    again = now.where(month == "05").withColumn("outstanding_amount", (F.col("outstanding_amount") * 2).cast(money.AMOUNT))
    table.replace(again, now.where(month.isin("05", "12")).select(*table.by))
    return table.read().select(*_SCANNED)


@query
def conform_schema(spark, sf):
    table = "bronze_internal_erp_raw"
    return _timeless(tables.conform(_Inputs(spark, sf).ledger_bronze, table), table)


@query
def scoped_replace(spark, sf):
    """All May documents are re-issued at twice the amount; December's are withdrawn."""
    columns = ["statement_id", "invoice_number", "outstanding_amount"]
    silver = _Inputs(spark, sf).statement
    month = F.substring("statement_period", 6, 2)
    reissued = silver.where(month == "05").select(
        "statement_id", "invoice_number", (F.col("outstanding_amount") * 2).cast(money.AMOUNT).alias("outstanding_amount")
    )
    scope = silver.where(month.isin("05", "12")).select("statement_id")
    return tables.replaced(silver.select(*columns), reissued, scope)


def _all_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """All eleven tables, what several of them read written once and before what reads it, and what pages and matching do not
    need of each other at the same time."""
    given = _Inputs(spark, sf)

    def intake() -> tuple[DataFrame, DataFrame]:
        pages = _pages(spark, sf)
        return stored(_records_of(pages)), pages

    def matching_side() -> None:
        given.plan = stored(given.plan)
        given.classified = given.classified_table
        given.orphans = stored(gold.read_by_gold(given.orphans))
        given.shops = stored(given.shops)

    (records, pages), _ = together(spark, intake, matching_side)
    return {
        "bronze_vendor_statement_raw": given.statement_bronze,
        "bronze_internal_erp_raw": given.ledger_bronze,
        "silver_reconciliation_standard": given.silver[0].unionByName(given.silver[1]),
        "validation_mutation_manifest": given.manifest,
        **_page_tables(records, pages),
        **_gold_tables(given),
    }


def _page_tables(records: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    flagged = ingest.flag_duplicates(_candidates(pages, records), _DUPLICATE_KEY)
    return {"validation_document_review_queue": _queue(records, flagged), "ai_audit_log": ingest.page_audit(records, PROVIDER)}


def _gold_tables(given: _Inputs) -> dict[str, DataFrame]:
    return {
        "gold_matched_invoices": gold.matched_invoices(given.classified),
        "gold_exceptions": gold.exceptions(given.classified, given.orphans),
        "gold_vendor_summary": gold.vendor_summary(given.shops),
        "gold_shop_summary": gold.shop_summary(given.shops),
        "gold_reconciliation_summary": gold.reconciliation_summary(given.shops, MatchRules()),
    }


def _store_all(spark: SparkSession, sf: str, observed: quality.Observed) -> None:
    """Write all eleven tables, each from the stored ones before it and those that do not need each other at the same time."""
    given = _Inputs(spark, sf)

    def put(made: dict[str, DataFrame]) -> None:
        together(spark, *[lambda t=table, r=rows: observed.store(t, r) for table, rows in made.items()])

    def intake() -> None:
        pages = _pages(spark, sf)
        put(_page_tables(stored(_records_of(pages)), pages))

    def matching_side() -> None:
        _store_sides(given, observed)
        given.classified = given.classified_table
        given.orphans = stored(gold.read_by_gold(given.orphans))
        given.shops = stored(given.shops)
        put(_gold_tables(given))

    together(spark, intake, matching_side)


def _store_sides(given: _Inputs, observed: quality.Observed) -> None:
    """Both Bronze tables, the manifest and Silver, each read from what was stored before it."""
    given.statement_bronze = observed.store("bronze_vendor_statement_raw", given.statement_bronze)
    given.statement = source.statement_silver(given.statement_bronze)
    given.plan = stored(given.plan)

    def ledger_and_silver() -> None:
        given.ledger_bronze = observed.store("bronze_internal_erp_raw", given.ledger_bronze)
        both = given.statement.unionByName(given.ledger)
        given.silver = normalize.sides(observed.store("silver_reconciliation_standard", both, partition_by=["record_source"]))

    together(given.plan.sparkSession, ledger_and_silver, lambda: observed.store("validation_mutation_manifest", given.manifest))


def _queue(records: DataFrame, flagged: DataFrame) -> DataFrame:
    return (
        ingest.rejected_rows(records)
        .unionByName(ingest.failed_pages(records))
        .unionByName(ingest.duplicate_rows(flagged, _DUPLICATE_KEY))
    )


@query
def table_counts(spark, sf):
    return tables.inventory(spark, _all_tables(spark, sf))


# --- reading pages ---------------------------------------------------------------------------
@query
def cells_to_records(spark, sf):
    rows = ingest.cells_to_records(_pages(spark, sf), source.VENDOR)
    return rows.select("statement_id", "page_number", "row_number", *source.VENDOR.fields, "shop")


@query
def header_shop(spark, sf):
    return _pages(spark, sf).select("statement_id", "page_number", "shop")


@query
def voucher_lines(spark, sf):
    rows = ingest.voucher_lines(source.pages(spark, sf), source.ADAPTER.invoice_pattern, source.ADAPTER.credit_pattern)
    return rows.drop("vendor_id", "source_file", "statement_period")


@query
def page_fallback(spark, sf):
    rows = _candidates_of(_pages(spark, sf))
    return rows.select(
        "statement_id", "page_number", "row_number", "invoice_number", "amount", "outstanding_amount",
        F.col("model").isNull().alias("is_fallback"),
    )


@query
def parse_responses(spark, sf):
    return ingest.parse_responses(source.pages(spark, sf)).select(
        "statement_id", "page_number", F.size("items").cast("bigint").alias("item_count"), "contract_error"
    )


@query
def quoted_objects(spark, sf):
    """The same responses with two strings that look like objects put in front of the items: neither is one."""
    fakes = '{"invoices":["{\\"invoice_number\\":\\"X\\"}","\\u007bnot one","{",'
    text_ = F.replace(F.col("text"), F.lit('{"invoices":['), F.lit(fakes))
    pages = source.pages(spark, sf).withColumn("text", F.when(F.col("text").endswith("}]}"), text_).otherwise(F.col("text")))
    return ingest.parse_responses(pages).select(
        "statement_id", "page_number", F.size("items").cast("bigint").alias("item_count"), "contract_error"
    )


@query
def standardize(spark, sf):
    rows = _records(spark, sf).where(ingest.is_record())
    return rows.select(
        "statement_id", "page_number", "row_number", "vendor", "shop", "invoice_number", "amount", "outstanding_amount",
        "confidence",
    )


@query
def validate_records(spark, sf):
    rows = _records(spark, sf).where(ingest.is_record())
    return rows.select(
        "statement_id", "page_number", "row_number", "rejection_category", "rejection_details", "checked_confidence",
        "threshold_applied",
    )


@query
def accept_reject(spark, sf):
    """Where each parsed record and each broken page ends up, per document."""
    rows = _records(spark, sf)
    broken = ~F.col("success") | F.col("contract_error").isNotNull()
    return rows.groupBy("statement_id").agg(
        F.count_if(ingest.is_valid()).alias("accepted"),
        F.count_if(ingest.is_record() & ~ingest.is_valid()).alias("rejected"),
        F.count_if(broken).alias("broken_pages"),
    )


@query
def dedup_first(spark, sf):
    return _flagged(spark, sf).select("statement_id", "page_number", "row_number", "invoice_number", "is_duplicate")


@query
def redelivered_pages(spark, sf):
    """Every fifth page is delivered a second time: all of its records are later copies."""
    pages = source.pages(spark, sf)
    times = F.expr("if(page_id % 5 = 0, array(0L, 1L), array(0L))")
    twice = ingest.attach_shop(stored(pages.withColumn("delivery", F.explode(times))), source.VENDOR)
    flagged = ingest.flag_duplicates(_candidates_of(twice), _DUPLICATE_KEY)
    return flagged.select("statement_id", "page_number", "delivery", "row_number", "invoice_number", "is_duplicate")


@query
def bronze_rows(spark, sf):
    pages = _pages(spark, sf)
    flagged = ingest.flag_duplicates(_candidates_of(pages), _DUPLICATE_KEY)
    rows = ingest.bronze_rows(ingest.attach_responses(flagged.where("NOT is_duplicate"), pages))
    table = "bronze_vendor_statement_raw"
    return _timeless(tables.conform(rows, table), table).withColumn(
        "raw_gemini_response", F.md5("raw_gemini_response")
    )


@query
def review_queue(spark, sf):
    pages = _pages(spark, sf)
    records = _records_of(pages)
    records = stored(records)
    flagged = ingest.flag_duplicates(_candidates(pages, records), _DUPLICATE_KEY)
    return _timeless(_queue(records, flagged), "validation_document_review_queue")


@query
def page_audit(spark, sf):
    return _timeless(ingest.page_audit(_records(spark, sf), PROVIDER), "ai_audit_log")


@query
def error_buckets(spark, sf):
    return source.pages(spark, sf).select(
        "statement_id", "page_number", text.error_bucket(F.col("success"), F.col("error")).alias("response_status")
    )


@query
def pattern_flags(spark, sf):
    flagged = ingest.pattern_flags(_Inputs(spark, sf).ledger_bronze, source.VENDOR.invoice_pattern)
    return flagged.groupBy("statement_id").agg(
        F.count("*").alias("records"), F.count_if(~F.col("conforms")).alias("malformed")
    )


def _statement_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Statement lines with every 67th number printed in another form."""
    odd = F.substring("raw_invoice_number", 4, 12).cast("bigint") % 67 == 0
    printed = F.when(odd, F.concat(F.lit("#"), "raw_invoice_number")).otherwise(F.col("raw_invoice_number"))
    rows = _Inputs(spark, sf).statement_bronze.withColumn("raw_invoice_number", printed)
    return ingest.pattern_flags(rows, source.VENDOR.invoice_pattern)


@query
def statement_pattern_flags(spark, sf):
    return _statement_flags(spark, sf).groupBy("statement_id").agg(
        F.count("*").alias("records"), F.count_if(~F.col("conforms")).alias("malformed")
    )


@query
def statement_pattern_sample(spark, sf):
    """Up to five malformed numbers for the report, the smallest ones so that reruns agree."""
    return _statement_flags(spark, sf).where("NOT conforms").select("raw_invoice_number").orderBy("raw_invoice_number").limit(5)


# --- column functions ------------------------------------------------------------------------------
@query
def normalize_number(spark, sf):
    raw = F.expr(
        "CASE k % 10 WHEN 0 THEN number WHEN 1 THEN number || '-1' WHEN 2 THEN number || 'X12' WHEN 3 THEN number || 'R'"
        " WHEN 4 THEN number || '-1R' WHEN 5 THEN '  ' || number || 'X1-2R ' WHEN 6 THEN 'X' || k WHEN 7 THEN ''"
        " WHEN 8 THEN number || '-1-2-3-4-5-6-7-8' END"
    )
    rows = source.lines(spark, sf).select("k", raw.alias("raw_number"))
    return rows.withColumn(
        "normalized", text.normalize_number(F.col("raw_number"), source.VENDOR.revision_suffixes)
    )


@query
def normalize_by_vendor(spark, sf):
    """Each vendor's own suffixes, joined in; one vendor has an empty list and one no rules at all."""
    rules = spark.sql(
        "SELECT * FROM VALUES ('V0', array('-[0-9]+$')), ('V1', array('X[0-9]+$', 'R$')),"
        " ('V2', cast(array() AS array<string>)) AS rules(vendor_id, suffixes)"
    )
    raw = F.expr(
        "CASE k % 5 WHEN 0 THEN number WHEN 1 THEN number || '-1-2-3-4-5-6-7' WHEN 2 THEN number || 'X12R'"
        " WHEN 3 THEN number || 'RX1-2' END"
    )
    rows = source.lines(spark, sf).select("k", "vendor_id", raw.alias("raw_number")).join(rules, "vendor_id", "left")
    return rows.select(
        "k", "vendor_id", "raw_number", text.normalize_number_by(F.col("raw_number"), F.col("suffixes")).alias("normalized")
    )


@query
def parse_money(spark, sf):
    raw = F.expr(
        "CASE k % 8 WHEN 0 THEN amount_printed WHEN 1 THEN amount_text WHEN 2 THEN '(' || amount_printed || ')'"
        " WHEN 3 THEN '-' || amount_text WHEN 4 THEN '1-' || k WHEN 5 THEN 'N/A' WHEN 6 THEN 'USD ' || amount_text END"
    )
    rows = source.lines(spark, sf).select("k", raw.alias("raw_amount"))
    return rows.withColumn("amount", money.parse_money(F.col("raw_amount")))


@query
def parse_dates(spark, sf):
    raw = F.expr(
        "CASE k % 6 WHEN 0 THEN date_text WHEN 1 THEN due_text WHEN 2 THEN cast(d AS string) WHEN 3 THEN '13/45/2026'"
        " WHEN 4 THEN 'soon' END"
    )
    rows = source.lines(spark, sf).select("k", raw.alias("raw_date"))
    parsed = dates.parse_date(F.col("raw_date"), source.VENDOR.date_format)
    return rows.withColumns(
        {
            "parsed": parsed,
            "period": dates.period_of(parsed),
            "shown": dates.date_text(parsed, source.VENDOR.date_format),
            "date_like": text.looks_like_date(F.col("raw_date")),
        }
    )


@query
def record_ids(spark, sf):
    given = _Inputs(spark, sf)
    printed = [F.col(c) for c in ("vendor_id", "raw_invoice_number", "raw_outstanding_amount", "statement_id")]
    kept = ["raw_invoice_number", "statement_id"]
    statement = given.statement_bronze.select(*kept, keys.statement_record_id(*printed).alias("record_id"))
    ledger = given.ledger_bronze.select(
        *kept, keys.ledger_record_id(*printed, F.col("row_number")).alias("record_id")
    )
    return statement.unionByName(ledger)


@query
def amount_equal(spark, sf):
    rows = source.lines(spark, sf).selectExpr(
        "k", "cast(cents / 100 AS decimal(12,2)) AS a",
        "if(k % 7 = 6, NULL, cast((cents + k % 7 - 3) / 100 AS decimal(12,2))) AS b",
    )
    return rows.withColumn("is_equal", money.amount_equal(F.col("a"), F.col("b"), MatchRules().amount_tolerance))


# --- Silver ------------------------------------------------------------------------------------------
@query
def silver_statement(spark, sf):
    return _timeless(_Inputs(spark, sf).statement, "silver_reconciliation_standard")


@query
def silver_ledger(spark, sf):
    return _timeless(_Inputs(spark, sf).ledger, "silver_reconciliation_standard")


@query
def ordered_rows(spark, sf):
    return normalize.ordered(_Inputs(spark, sf).ledger).select("invoice_number", "ro_number", "record_id")


@query
def sample_revised(spark, sf):
    return normalize.revised_sample(_Inputs(spark, sf).ledger)


@query
def distinct_keys(spark, sf):
    return _Inputs(spark, sf).ledger.select("vendor_id", "statement_id").distinct()


@query
def control_totals(spark, sf):
    given = _Inputs(spark, sf)
    of_statement = quality.control_totals(given.statement_bronze, given.statement)
    of_ledger = quality.control_totals(given.ledger_bronze, given.ledger)
    return of_statement.withColumn("side", F.lit(K.STATEMENT_SOURCE)).unionByName(
        of_ledger.withColumn("side", F.lit(K.LEDGER_SOURCE))
    )


# --- matching ------------------------------------------------------------------------------------------
@query
def candidate_groups(spark, sf):
    groups = matching.candidate_groups(_Inputs(spark, sf).ledger)
    single = F.col("candidate_count") == 1
    return groups.select(
        "vendor_id",
        "invoice_number_normalized",
        "candidate_count",
        "copies_agree",
        F.when(single, F.col("candidate.record_id")).alias("only_record_id"),
        F.when(single, F.col("candidate.credit")).alias("only_credit"),
    )


@query
def candidate_join(spark, sf):
    rows = matching.attach_candidates(*_Inputs(spark, sf).sides)
    return rows.select(
        "record_id",
        "candidate_count",
        F.when(F.col("candidate_count") == 1, F.col("candidate.record_id")).alias("only_record_id"),
    )


@query
def work_order_lookup(spark, sf):
    rows = matching.attach_work_orders(*_Inputs(spark, sf).sides)
    return rows.select("record_id", "work_order_number", "work_order_match")


@query
def classify(spark, sf):
    return matching.classify(*_Inputs(spark, sf).sides, MatchRules()).select("record_id", "invoice_number", "decision.*")


@query
def orphans(spark, sf):
    return gold.orphans(*_Inputs(spark, sf).sides).select("record_id", "vendor_id", "invoice_number")


def _colocated(spark: SparkSession, sf: str) -> tuple[colocated.Sides, DataFrame]:
    """Both sides stored by the matching key, and the numbers they share, found once."""
    sides = colocated.store(*_Inputs(spark, sf).silver, matching.KEY)
    return sides, stored(matching.shared_numbers(sides.statement, sides.ledger))


@query
def classify_colocated(spark, sf):
    return matching.classify_stored(*_colocated(spark, sf), MatchRules()).select("record_id", "invoice_number", "decision.*")


@query
def orphans_colocated(spark, sf):
    return matching.orphans_stored(*_colocated(spark, sf)).select("record_id", "vendor_id", "invoice_number")


@query
def gold_matched(spark, sf):
    return _timeless(gold.matched_invoices(_Inputs(spark, sf).classified), "gold_matched_invoices")


@query
def gold_exceptions(spark, sf):
    given = _Inputs(spark, sf)
    rows = gold.exceptions(given.classified, given.orphans)
    return _timeless(rows, "gold_exceptions")


@query
def shop_aggregates(spark, sf):
    return _Inputs(spark, sf).shops


@query
def recon_summary(spark, sf):
    return gold.reconciliation_summary(_Inputs(spark, sf).shops, MatchRules())


@query
def shop_summary(spark, sf):
    return gold.shop_summary(_Inputs(spark, sf).shops)


@query
def vendor_summary(spark, sf):
    return gold.vendor_summary(_Inputs(spark, sf).shops)


def _rare(spark: SparkSession, sf: str) -> _Inputs:
    given = _Inputs(spark, sf)
    # The cases are projections of the stored sides, so that the ledger is derived once and not for each kind of case.
    given.silver = source.with_rare_cases(*given.silver)
    return given


@query
def rare_classify(spark, sf):
    return _rare(spark, sf).classified.select("record_id", "invoice_number", "decision.*")


@query
def rare_exceptions(spark, sf):
    given = _rare(spark, sf)
    return _timeless(gold.exceptions(given.classified, given.orphans), "gold_exceptions")


@query
def rare_summary(spark, sf):
    return gold.reconciliation_summary(_rare(spark, sf).shops, MatchRules())


# --- ground truth ------------------------------------------------------------------------------------
@query
def proportional_split(spark, sf):
    rows = source.labelled(_Inputs(spark, sf).statement)
    return rows.select("invoice_number", F.col(groundtruth.RANK).cast("bigint").alias("split_rank"), "scenario_type")


@query
def perturb_ledger(spark, sf):
    return _timeless(_Inputs(spark, sf).ledger_bronze, "bronze_internal_erp_raw").drop("page_number")


@query
def manifest(spark, sf):
    return _timeless(_Inputs(spark, sf).manifest, "validation_mutation_manifest")


@query
def mix_report(spark, sf):
    return groundtruth.mix_report(source.labelled(_Inputs(spark, sf).statement), source.SCENARIOS.mix)


@query
def grading(spark, sf):
    return _Inputs(spark, sf).graded


@query
def grading_mismatches(spark, sf):
    """Grading against a manifest in which every 89th expectation is wrong: those are found, and no others."""
    given = _Inputs(spark, sf)
    wrong = F.substring("statement_invoice_number", 4, 12).cast("bigint") % 89 == 0
    level, reason = F.col("expected_match_level"), F.col("expected_exception_reason")
    given.manifest = given.manifest.withColumns(
        {
            "expected_match_level": F.when(wrong, level + 1).otherwise(level),
            "expected_exception_reason": F.when(~wrong, reason),
        }
    )
    return groundtruth.grade_mismatches(given.graded)


@query
def grading_breakdown(spark, sf):
    return groundtruth.grade_breakdown(_Inputs(spark, sf).graded)


# --- quality ------------------------------------------------------------------------------------------
@query
def quality_checks(spark, sf):
    """Checks of all tables, from the writes that store them."""
    observed = quality.Observed(spark, stored)
    _store_all(spark, sf, observed)
    return observed.checks()


@query
def failing_checks(spark, sf):
    """The same checks over tables with faults: some empty, some missing, some with bad rows. None passes."""
    made = dict(_all_tables(spark, sf))

    def spoiled(table: str, column: str, where: Column) -> DataFrame:
        return made[table].withColumn(column, F.when(~where, F.col(column)))

    seventh = F.col("invoice_number").endswith("7")
    silver = spoiled("silver_reconciliation_standard", "invoice_date", seventh)
    made["silver_reconciliation_standard"] = silver.where(F.col("record_source") == K.STATEMENT_SOURCE)
    made["gold_matched_invoices"] = spoiled("gold_matched_invoices", "match_reason", seventh)
    made["gold_exceptions"] = spoiled("gold_exceptions", "exception_category", seventh)
    made["gold_reconciliation_summary"] = spoiled("gold_reconciliation_summary", "overall_status", F.col("shop").endswith("A"))
    for table in ("bronze_vendor_statement_raw", "validation_mutation_manifest", "gold_vendor_summary"):
        made[table] = made[table].where(F.lit(False))
    for table in ("bronze_internal_erp_raw", "validation_document_review_queue", "ai_audit_log", "gold_shop_summary"):
        del made[table]
    return quality.run_checks(spark, made)


@query
def parity_checks(spark, sf):
    """Control totals of both sides, the manifest and the plan of the ledger, all from the writes that store them."""
    observed = quality.Observed(spark, stored)
    given = _Inputs(spark, sf)
    _store_sides(given, observed)
    return quality.parity_of(
        observed.control_totals("bronze_vendor_statement_raw"),
        observed.control_totals("bronze_internal_erp_raw"),
        spark.range(1).select(F.lit(observed.rows_of("validation_mutation_manifest")).cast("bigint").alias("manifest_rows")),
        given.plan.agg(F.sum("copies").alias("expected")),
    )


# --- one run, pages to Gold ------------------------------------------------------------------------------
def _run(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    pages = stored(source.pages(spark, sf))
    return pages, reconcile.pages_to_gold(
        pages,
        _Inputs(spark, sf).ledger_bronze,
        source.VENDOR,
        source.ADAPTER,
        vendor_name=F.concat(F.lit("Vendor "), F.col("vendor_id")),
        keep=stored,
    )


@query
def pipeline_gold(spark, sf):
    """Every outcome of one run from pages to Gold, matched lines and exceptions together."""
    _, made = _run(spark, sf)
    shared = [
        "vendor_id", "statement_period", "shop", "invoice_number", "amount", "match_status", "reference_record_id",
        "statement_record_id",
    ]
    outcomes = {
        "gold_matched_invoices": ("matched_rule", "match_reason"),
        "gold_exceptions": ("exception_category", "deterministic_reason"),
    }
    matched, failed = (
        made[table].select(*shared, F.col(outcome).alias("outcome"), F.col(reason).alias("reason"))
        for table, (outcome, reason) in outcomes.items()
    )
    return matched.unionByName(failed)


@query
def pipeline_intake(spark, sf):
    """Per document: every parsed record was accepted, rejected or a duplicate, and none went missing."""
    pages, made = _run(spark, sf)
    bronze, queue = made["bronze_vendor_statement_raw"], made["validation_document_review_queue"]
    category = F.col("rejection_category")

    def counted(rows: DataFrame, kind: str, n: Column) -> DataFrame:
        return rows.select("statement_id", F.lit(kind).alias("kind"), n.cast("bigint").alias("n"))

    one = F.lit(1)
    stacked = (
        counted(ingest.parse_responses(pages), "parsed", F.coalesce(F.size("items"), F.lit(0)))
        .unionByName(counted(bronze.where("extraction_model IS NOT NULL"), "accepted", one))
        .unionByName(counted(bronze.where("extraction_model IS NULL"), "fallback", one))
        .unionByName(counted(queue.where(category == K.DUPLICATE_RECORD), "duplicates", one))
        .unionByName(
            counted(queue.where(~category.isin(K.DUPLICATE_RECORD, K.AI_CALL_FAILED, K.MALFORMED_JSON)), "rejected", one)
        )
    )
    kinds = ("parsed", "accepted", "rejected", "duplicates", "fallback")
    totals = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0).cast("bigint")).alias(k) for k in kinds]
    sums = stacked.groupBy("statement_id").agg(*totals)
    return sums.withColumn("balanced", F.expr("accepted + rejected + duplicates = parsed"))
