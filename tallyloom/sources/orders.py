"""Statement and ledger inputs derived from the `orders`, `customer` and `nation` tables.

Every order becomes one statement line. A document covers 40,000 consecutive order keys of one
vendor and month, a page 4,000 of them: page and row numbers come from the key itself, so no
window over a vendor or a month is needed, and no document outgrows a fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import contract as K
from tallyloom.config import Adapter, Outcome, ScenarioRules, VendorRules, DEFAULT_MIX
from tallyloom.operators import groundtruth, normalize

DOCUMENT_KEYS = 40_000
PAGE_KEYS = 4_000
MODEL = "extractor-1"

VENDOR = VendorRules(vendor_id="V0", vendor_name="Vendor V0", statement_date="2001-12-31")
ADAPTER = Adapter()
# The standard mix gives up three points for labels that test outcomes it never plants.
SCENARIOS = ScenarioRules().with_labels(
    {**DEFAULT_MIX, "exact_match": 0.72, "ro_missing": 0.01, "ro_conflict": 0.01, "ledger_only": 0.01},
    {
        "ro_missing": Outcome(K.MATCHED, level=2),
        "ro_conflict": Outcome(K.MATCHED, level=3),
        "ledger_only": Outcome(K.MATCHED, level=1),
    },
)

PAGE = ["vendor_id", "source_file", "statement_id", "statement_period", "page_number"]


# The columns read, stated so that no job is spent on inferring them.
_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One narrow row per order: what every field of a statement line follows from."""
    orders = _table(spark, sf_dir, "orders")
    customer = _table(spark, sf_dir, "customer")
    nation = _table(spark, sf_dir, "nation")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    return joined.selectExpr(
        "o_orderkey AS k",
        "o_custkey % 4 AS v",
        "o_custkey AS customer",
        "n_name AS shop",
        "cast(o_orderdate AS date) AS d",
        "date_format(o_orderdate, 'yyyy-MM') AS statement_period",
        "cast(round(o_totalprice * 100) AS bigint) AS cents",
    )


def _described(orders: DataFrame) -> DataFrame:
    """The order rows with the fields that are printed."""
    return orders.selectExpr(
        "*",
        "'SIN' || lpad(cast(k AS string), 12, '0') AS number",
        "if(k % 31 = 0, NULL, cast(24000000 + k AS string)) AS work_order",
        "if(k % 37 = 0, NULL, 'RO-' || customer) AS ro",
        "cast(cents div 100 AS string) || '.' || lpad(cast(cents % 100 AS string), 2, '0') AS amount_text",
        "concat('$', format_number(cast(cents AS decimal(16,0)) / 100, 2)) AS amount_printed",
        "date_format(d, 'MM/dd/yyyy') AS date_text",
        "date_format(date_add(d, 30), 'MM/dd/yyyy') AS due_text",
    )


_PAGE_NUMBER = f"cast((k % {DOCUMENT_KEYS}) div {PAGE_KEYS} + 1 AS int) AS page_number"
_PAGE_ID = f"k div {PAGE_KEYS} + 5 * v + year(d) * 12 + month(d) AS page_id"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with the fields a statement line needs."""
    return _described(_orders(spark, sf_dir)).drop("customer").selectExpr(
        "*",
        "'V' || v AS vendor_id",
        "'Vendor V' || v AS vendor_name",
        f"'V' || v || '-' || statement_period || '-' || (k div {DOCUMENT_KEYS}) AS statement_id",
        _PAGE_NUMBER,
        f"cast(k % {PAGE_KEYS} + 1 AS int) AS row_number",
        _PAGE_ID,
    ).withColumn("source_file", F.concat("statement_id", F.lit(".pdf")))


def statement_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr(
        "vendor_id",
        "source_file",
        "statement_id",
        "statement_period",
        "page_number",
        "row_number",
        "cast(NULL AS timestamp) AS ingestion_timestamp",
        "date_text AS raw_invoice_date",
        "number AS raw_invoice_number",
        "work_order AS raw_work_order_number",
        "ro AS raw_ro_number",
        "amount_printed AS raw_outstanding_amount",
        "due_text AS raw_due_date",
        "shop AS raw_shop_name",
        "cast((801 + (k * 7919) % 20 * 10) / 1000 AS decimal(5,4)) AS extraction_confidence",
        f"'{MODEL}' AS extraction_model",
        "cast(NULL AS string) AS document_section",
        "cast(NULL AS string) AS bounding_box",
        "cast(NULL AS string) AS raw_gemini_response",
    )


def statement_silver(bronze: DataFrame) -> DataFrame:
    vendor_name = F.concat(F.lit("Vendor "), F.col("vendor_id"))
    return normalize.statement_to_silver(bronze, VENDOR, vendor_name)


def _order_key() -> Column:
    return F.substring("invoice_number", 4, 12).cast("bigint")


def labelled(statement: DataFrame, rank: bool = True) -> DataFrame:
    """Statement rows with a planted label, and with their rank if it is asked for."""
    return groundtruth.proportional_split(statement, SCENARIOS.mix, _order_key(), SCENARIOS.seed, rank)


def planted(statement: DataFrame) -> DataFrame:
    return groundtruth.planted(labelled(statement, rank=False), _order_key(), SCENARIOS)


def ledger_bronze(plan: DataFrame) -> DataFrame:
    return groundtruth.ledger_extract(
        plan,
        SCENARIOS,
        VENDOR.date_format,
        f"mock_erp_generator_v{SCENARIOS.version}",
        sequence=_order_key() % DOCUMENT_KEYS,
    )


def ledger_silver(bronze: DataFrame) -> DataFrame:
    return normalize.ledger_to_silver(bronze, VENDOR, ADAPTER)


def with_rare_cases(statement: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both Silver sides with what the standard mix never plants: lines without a shop or a number, ledger rows without a
    status, credits that do not explain a difference, copies whose amounts differ, shops only the ledger knows, and
    numbers that another period has as well or instead."""
    number = F.col("invoice_number_normalized")
    digits = F.when(number.startswith("SIN"), F.substring(number, 4, 12)).try_cast("bigint")

    def every(n: int) -> Column:
        return F.coalesce(digits % n == 0, F.lit(False))

    def put(n: int, value, column: str) -> Column:
        return F.when(every(n), value).otherwise(F.col(column))

    def money_put(n: int, value: Column, column: str) -> Column:
        return put(n, value, column).cast("decimal(12,2)")

    outstanding = F.col("outstanding_amount")
    lines_ = statement.withColumns(
        {name: put(n, None, name) for name, n in (("shop", 13), ("invoice_number", 17), ("invoice_number_normalized", 17))}
    )
    records = ledger.withColumns(
        {
            "status": put(19, None, "status"),
            "outstanding_amount": money_put(23, outstanding - 5, "outstanding_amount"),
            "amount": money_put(23, F.col("amount") + 3, "amount"),
            "credit": money_put(23, F.lit(8), "credit"),
            "shop": put(43, "ELSEWHERE", "shop"),
            "statement_period": put(37, "1990-01", "statement_period"),
        }
    )
    differing = ledger.where(every(29)).withColumns(
        {"record_id": F.concat("record_id", F.lit("+")), "outstanding_amount": (outstanding + 1).cast("decimal(12,2)")}
    )
    earlier = ledger.where(every(41)).withColumns(
        {"record_id": F.concat("record_id", F.lit("*")), "statement_period": F.lit("1991-01")}
    )
    return lines_, records.unionByName(differing).unionByName(earlier)


def manifest(plan: DataFrame) -> DataFrame:
    return groundtruth.manifest(plan, SCENARIOS)


def _json_text(column: str) -> str:
    return f"coalesce('\"' || {column} || '\"', 'null')"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: printed text, table cells, voucher text and the extraction response.

    A page collects at most 4,000 consecutive order keys, whatever the size of the table. Orders meet by page as numbers and
    dates; what is printed of them, some ten times as wide, is made where the page is put together.
    """
    # What each printed line looks like in the three renderings; faults are planted by key.
    item = (
        "'{\"invoice_date\":\"' || if(k % 41 = 0, '', date_text) || '\",\"invoice_number\":\"' || number"
        f" || '\",\"work_order_number\":' || {_json_text('work_order')} || ',\"ro_number\":' || {_json_text('ro')}"
        " || ',\"outstanding_amount\":\"' || if(k % 43 = 0, 'N/A', amount_text) || if(again, '0', '')"
        " || '\",\"due_date\":\"' || if(k % 47 = 0, 'soon', due_text) || '\"'"
        " || if(k % 59 = 0, '', ',\"confidence\":' || if(k % 53 = 0, '0.5', '0.' || (801 + (k * 7919) % 20 * 10))) || '}'"
    )
    # Vendor, document and file of a page follow from these; without a date there is no document number.
    by = ["v", "statement_period", "document", "page_number", "page_id"]
    document = f"if(statement_period IS NULL, NULL, k div {DOCUMENT_KEYS}) AS document"
    orders = _orders(spark, sf_dir).selectExpr("k", "v", "customer", "d", "statement_period", "cents", document, _PAGE_NUMBER, _PAGE_ID)
    printed = (
        _described(orders.repartition(*by))
        .withColumn("again", F.explode(F.expr("if(k % 61 = 0, array(false, true), array(false))")))
        .selectExpr(
            *by,
            "k",
            "again",
            f"{item} AS item",
            "if(again, NULL, array(date_text, number, work_order, ro, amount_printed, due_text)) AS cells",
            "CASE WHEN again THEN NULL WHEN k % 10 = 3 THEN array('', '', '', '', '', '')"
            " WHEN k % 10 = 7 THEN array(date_text, NULL, 'see below', NULL, NULL, NULL) END AS filler",
            "if(again, NULL, date_text || ' Bill #' || number || ' ' || substring(amount_printed, 2)"
            " || ' ' || amount_text || ' ' || amount_text) AS bill",
            "CASE WHEN again THEN NULL WHEN k % 29 = 0 THEN date_text || ' Bill Credit #' || number || ' -' || amount_text"
            " WHEN k % 10 = 5 THEN 'Carried forward ' || amount_text END AS note",
        )
    )
    gathered = printed.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("k", "again", "item"))).alias("items"),
        F.sort_array(F.collect_list(F.struct("k", "again", "cells", "filler"))).alias("rows"),
        F.sort_array(F.collect_list(F.struct("k", "again", "bill", "note"))).alias("bills"),
    )
    named = gathered.selectExpr("*", "'V' || v AS vendor_id", "'V' || v || '-' || statement_period || '-' || document AS statement_id")
    fault = "page_id % 20"
    return named.withColumn("source_file", F.concat("statement_id", F.lit(".pdf"))).selectExpr(
        *PAGE,
        "page_id",
        "'Statement of account\n'"
        " || if(page_number = 1 AND cast(substring(statement_period, 6) AS int) % 11 != 0,"
        " 'Shop -   Body Shop ' || statement_id || '  \nplease pay', 'continued') AS page_text",
        "concat(if(page_number = 1, array(array('Invoice Date', 'Invoice #', 'Work Order #', 'RO #', 'Outstanding Amount', 'Due Date')), array()),"
        " flatten(transform(rows, x -> array_compact(array(x.cells, x.filler)))),"
        " array(array('Total Outstanding Invoices:', 'x', '', '', '', ''))) AS cells",
        "array_join(flatten(transform(bills, x -> array_compact(array('  ' || x.bill, x.note)))), '\n') AS voucher_text",
        f"{fault} != 7 AS success",
        f"CASE {fault} WHEN 7 THEN NULL WHEN 11 THEN '{{\"rows\":[]}}' WHEN 13 THEN '{{\"invoices\":[]}}' WHEN 3 THEN '[1]' ELSE"
        f" '{{\"invoices\":[' || if({fault} = 17, '\"note\",7,', '') || array_join(transform(items, x -> x.item), ',') || ']}}' END AS text",
        f"CASE WHEN {fault} = 7 THEN element_at(array('HTTP 503 on attempt 4: busy', 'Transport error on attempt 4: timed out',"
        " 'Missing API key: set environment variable EXTRACTOR_KEY', 'Response was not valid JSON: line 1',"
        " 'Unexpected response shape: no candidates', ''), cast(page_id div 20 % 6 + 1 AS int)) END AS error",
        "cast(100 + page_id % 900 AS double) AS latency_ms",
        f"if({fault} = 7, 4, 1) AS attempt_count",
        f"'{MODEL}' AS model",
    )
