"""Bronze to Silver: one typed schema for both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import contract as K
from tallyloom.config import Adapter, VendorRules
from tallyloom.functions import dates, keys, money, text
from tallyloom.schemas import schema

_SILVER = schema("silver_reconciliation_standard")


def _silver(rows: DataFrame, **columns: Column) -> DataFrame:
    """Fill the Silver columns in declared order; a column not given is a typed NULL."""
    passed_through = ("statement_id", "vendor_id", "statement_period", "source_file", "ingestion_timestamp")
    return rows.select(
        *[
            (
                columns[f.name]
                if f.name in columns
                else F.col(f.name) if f.name in passed_through else F.lit(None)
            )
            .cast(f.dataType)
            .alias(f.name)
            for f in _SILVER
        ]
    )


def statement_to_silver(bronze: DataFrame, rules: VendorRules, vendor_name: Column | None = None) -> DataFrame:
    """Statement lines: one amount, which is both the original and the outstanding one."""
    outstanding = money.parse_money(F.col("raw_outstanding_amount"))
    return _silver(
        bronze,
        record_id=keys.statement_record_id(
            F.col("vendor_id"), F.col("raw_invoice_number"), F.col("raw_outstanding_amount"), F.col("statement_id")
        ),
        record_source=F.lit(K.STATEMENT_SOURCE),
        document_type=F.lit(K.STATEMENT_SOURCE),
        statement_date=F.lit(rules.statement_date),
        vendor_name=F.lit(rules.vendor_name) if vendor_name is None else vendor_name,
        shop=F.col("raw_shop_name"),
        invoice_number=F.col("raw_invoice_number"),
        invoice_number_normalized=text.normalize_number(F.col("raw_invoice_number"), rules.revision_suffixes),
        invoice_date=dates.parse_date(F.col("raw_invoice_date"), rules.date_format),
        ro_number=F.col("raw_ro_number"),
        work_order_number=F.col("raw_work_order_number"),
        amount=outstanding,
        outstanding_amount=outstanding,
        due_date=dates.parse_date(F.col("raw_due_date"), rules.date_format),
    )


def ledger_to_silver(bronze: DataFrame, rules: VendorRules, adapter: Adapter) -> DataFrame:
    """Ledger records: original and outstanding amount differ by the credit."""
    amount = money.parse_money(F.col("raw_amount"))
    outstanding = money.parse_money(F.col("raw_outstanding_amount"))
    return _silver(
        bronze,
        record_id=keys.ledger_record_id(
            F.col("vendor_id"), F.col("raw_invoice_number"), F.col("raw_outstanding_amount"),
            F.col("statement_id"), F.col("row_number"),
        ),
        record_source=F.lit(K.LEDGER_SOURCE),
        document_type=F.lit(adapter.document_type),
        statement_date=F.lit(rules.statement_date),
        vendor_name=F.col("raw_vendor"),
        shop=F.col("raw_shop"),
        invoice_number=F.col("raw_invoice_number"),
        invoice_number_normalized=text.normalize_number(F.col("raw_invoice_number"), rules.revision_suffixes),
        invoice_date=dates.parse_date(F.col("raw_invoice_date"), rules.date_format),
        ro_number=F.col("raw_ro_number"),
        po_number=F.col("raw_po_number"),
        amount=amount,
        credit=money.credit_of(amount, outstanding),
        outstanding_amount=outstanding,
        posting_date=dates.parse_date(F.col("raw_posting_date"), rules.date_format),
        status=F.col("raw_status"),
    )


def sides(silver: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statement rows and ledger rows of one Silver table."""
    source = F.col("record_source")
    return silver.where(source == K.STATEMENT_SOURCE), silver.where(source == K.LEDGER_SOURCE)


def revised_sample(silver: DataFrame, size: int = 3) -> DataFrame:
    """The first few numbers that normalisation changed: a report for the eye."""
    return (
        silver.where(F.col("invoice_number") != F.col("invoice_number_normalized"))
        .select("invoice_number", "invoice_number_normalized")
        .orderBy("invoice_number")
        .limit(size)
    )


def ordered(silver: DataFrame) -> DataFrame:
    """Total order over Silver rows, ties broken to the last column."""
    return silver.orderBy("invoice_number", "ro_number", "record_id")
