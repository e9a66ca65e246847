"""The eleven tables: columns, types and the columns each is partitioned by.

Fixed values: column names, order and types are the contract of the tables.
"""

from pyspark.sql import types as T

_COLUMNS = {
    "bronze_vendor_statement_raw": """
        vendor_id string, source_file string, statement_id string, statement_period string,
        page_number int, row_number int, ingestion_timestamp timestamp,
        raw_invoice_date string, raw_invoice_number string, raw_work_order_number string,
        raw_ro_number string, raw_outstanding_amount string, raw_due_date string, raw_shop_name string,
        extraction_confidence decimal(5,4), extraction_model string, document_section string,
        bounding_box string, raw_gemini_response string""",
    "bronze_internal_erp_raw": """
        vendor_id string, source_file string, statement_id string, statement_period string,
        page_number int, row_number int, ingestion_timestamp timestamp,
        raw_vendor string, raw_invoice_number string, raw_invoice_date string, raw_posting_date string,
        raw_amount string, raw_outstanding_amount string, raw_ro_number string, raw_po_number string,
        raw_shop string, raw_status string""",
    "silver_reconciliation_standard": """
        record_id string, record_source string, document_type string, statement_id string,
        statement_date date, vendor_id string, vendor_name string, shop string, invoice_number string,
        invoice_number_normalized string, invoice_date date, ro_number string, work_order_number string,
        po_number string, amount decimal(12,2), credit decimal(12,2), outstanding_amount decimal(12,2),
        due_date date, posting_date date, status string, description string, statement_period string,
        source_file string, ingestion_timestamp timestamp""",
    "gold_matched_invoices": """
        match_id string, vendor_id string, shop string, invoice_number string, ro_number string,
        amount decimal(12,2), match_level int, matched_rule string, match_reason string,
        match_status string, statement_record_id string, reference_record_id string, source_file string,
        statement_id string, match_timestamp timestamp, statement_period string""",
    "gold_exceptions": """
        exception_id string, vendor_id string, shop string, invoice_number string, ro_number string,
        amount decimal(12,2), match_status string, exception_category string,
        deterministic_reason string, reference_record_id string, exception_status string,
        statement_record_id string, source_file string, statement_id string, date_raised timestamp,
        date_resolved timestamp, statement_period string""",
    "gold_vendor_summary": """
        vendor_id string, vendor_name string, statement_period string, total_invoices int,
        matched_count int, exception_count int, match_pct decimal(5,2),
        total_outstanding_amount decimal(14,2)""",
    "gold_shop_summary": """
        shop string, vendor_id string, statement_period string, total_invoices int,
        matched_count int, exception_count int, match_pct decimal(5,2)""",
    "gold_reconciliation_summary": """
        vendor_id string, vendor_name string, shop string, statement_period string,
        statement_total decimal(14,2), internal_erp_total decimal(14,2), difference decimal(14,2),
        total_invoice_count int, matched_count int, exception_count int, match_pct decimal(5,2),
        overall_status string""",
    "validation_mutation_manifest": """
        manifest_id string, vendor_id string, statement_period string, statement_invoice_number string,
        generated_erp_invoice_number string, scenario_type string, expected_match_status string,
        expected_match_level int, expected_exception_reason string, mutation_details string,
        generator_config_version string, generation_timestamp timestamp""",
    "validation_document_review_queue": """
        review_id string, vendor_id string, source_file string, statement_id string,
        statement_period string, pipeline_stage string, rejection_category string,
        rejection_details string, extraction_confidence decimal(5,4),
        confidence_threshold_applied decimal(5,4), raw_payload string, ai_audit_id string,
        review_status string, flagged_timestamp timestamp, reviewed_by string,
        reviewed_timestamp timestamp, resolution_notes string""",
    "ai_audit_log": """
        audit_id string, source_file string, vendor_id string, statement_id string,
        interaction_type string, ai_provider string, model string, prompt_version string,
        request_timestamp timestamp, latency_ms double, attempt_count int, success boolean,
        response_status string, error_message string, extraction_confidence decimal(5,4),
        validation_result string""",
}

_VENDOR_PERIOD = ("vendor_id", "statement_period")
PARTITIONS = {name: _VENDOR_PERIOD for name in _COLUMNS}
PARTITIONS["silver_reconciliation_standard"] = ("vendor_id", "statement_period", "record_source")
PARTITIONS["ai_audit_log"] = ("vendor_id",)

TABLES = tuple(_COLUMNS)


def ddl(table: str) -> str:
    """Column list of a table as a DDL string."""
    return " ".join(_COLUMNS[table].split())


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "decimal(5,2)": T.DecimalType(5, 2),
    "decimal(5,4)": T.DecimalType(5, 4),
    "decimal(12,2)": T.DecimalType(12, 2),
    "decimal(14,2)": T.DecimalType(14, 2),
}


def schema(table: str) -> T.StructType:
    """Column list of a table as a StructType, all columns nullable. Needs no running session."""
    columns = (column.split() for column in ddl(table).split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns])
