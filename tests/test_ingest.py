"""Reading pages: cells, vouchers, responses, validation, fallback, de-duplication, review and audit."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallyloom import contract as K
from tallyloom import queries
from tallyloom.config import Adapter, ValidationRules, VendorRules
from tallyloom.operators import ingest
from tallyloom.plans import reconcile
from tallyloom.sources import adapters, orders
from tallyloom.sources.staging import stored

VENDOR = VendorRules("V", "Vendor", "2026-05-31")
PAGES = (
    "page_number int, page_text string, cells array<array<string>>, voucher_text string, success boolean, text string, "
    "error string, latency_ms double, attempt_count int, model string"
)
RECORD = {
    "invoice_number": "SIN1", "outstanding_amount": "48.75", "invoice_date": "05/01/2026", "confidence": 0.95,
}


def pages(spark, *rows):
    names = [c.split()[0] for c in PAGES.split(", ")]
    defaults = {
        "page_number": 1, "page_text": "Shop - Main", "success": True, "latency_ms": 1.0, "attempt_count": 1, "model": "m",
    }
    filled = [tuple({**defaults, **r}.get(n) for n in names) for r in rows]
    base = spark.createDataFrame(filled, PAGES)
    named = {"vendor_id": "V", "source_file": "f", "statement_id": "S", "statement_period": "2026-05"}
    return base.select(*[F.lit(v).alias(n) for n, v in named.items()], *names)


def answer(*records):
    return json.dumps({"invoices": list(records)})


def parsed(spark, *records, rules=ValidationRules(), vendor=VENDOR):
    frame = ingest.attach_shop(pages(spark, {"text": answer(*records)}), vendor)
    return ingest.page_records(frame, vendor, rules)


@pytest.mark.parametrize(
    ("change", "category", "details"),
    [
        ({}, None, None),
        ({"confidence": None}, None, None),
        ({"invoice_number": ""}, K.MISSING_MANDATORY_FIELD, "Missing required field(s): invoice_number"),
        (
            {"invoice_number": None, "invoice_date": ""},
            K.MISSING_MANDATORY_FIELD,
            "Missing required field(s): invoice_number, invoice_date",
        ),
        ({"outstanding_amount": "N/A"}, K.INVALID_FIELD_TYPE, "Field 'amount' is not numeric: 'N/A'"),
        ({"amount": "1", "outstanding_amount": "x"}, K.INVALID_FIELD_TYPE, "Field 'outstanding_amount' is not numeric: 'x'"),
        ({"due_date": "soon"}, K.INVALID_FIELD_TYPE, "Field 'due_date' does not look like a date: 'soon'"),
        ({"confidence": 0.5}, K.LOW_CONFIDENCE, "extraction_confidence 0.5 is below threshold 0.75"),
        ({"confidence": 0.1, "invoice_number": ""}, K.MISSING_MANDATORY_FIELD, "Missing required field(s): invoice_number"),
        ({"confidence": 0.75}, None, None),
        ({"confidence": "high"}, K.INVALID_FIELD_TYPE, "Field 'extraction_confidence' is not numeric: 'high'"),
    ],
)
def test_validation(spark, change, category, details):
    row = parsed(spark, {**RECORD, **change}).first()
    assert (row.rejection_category, row.rejection_details) == (category, details)
    if category in (K.MISSING_MANDATORY_FIELD, K.INVALID_FIELD_TYPE):
        assert row.checked_confidence is None and row.threshold_applied is None


def test_amount_is_derived_only_when_the_vendor_says_so(spark):
    assert parsed(spark, RECORD).first().amount == "48.75"
    kept = parsed(spark, {**RECORD, "amount": "50"}).first()
    assert (kept.amount, kept.outstanding_amount) == ("50.00", "48.75")
    strict = parsed(spark, RECORD, vendor=replace(VENDOR, derive_amount=False)).first()
    assert strict.amount is None and strict.rejection_category == K.MISSING_MANDATORY_FIELD


@pytest.mark.parametrize(
    ("text", "count", "kind"),
    [
        ('{"invoices":[]}', 0, None),
        ('{"invoices":[{"a":1},"x",7,null,[1],{"b":2}]}', 2, None),
        ('{"rows":[]}', None, "dict"),
        ('{"invoices":"none"}', None, "dict"),
        ('[{"invoices":[]}]', None, "list"),
        ('"text"', None, "str"),
        ("12", None, "int"),
        ("null", None, "NoneType"),
    ],
)
def test_response_contract(spark, text, count, kind):
    row = ingest.parse_responses(pages(spark, {"text": text})).first()
    assert (None if row["items"] is None else len(row["items"])) == count
    wanted = None if kind is None else "Expected a JSON object shaped like {'invoices': [...]}, got: " + kind
    assert row.contract_error == wanted


def test_cells(spark):
    table = [
        ["Invoice Date", "Invoice #", "W", "R", "O", "D"],
        ["05/01/2026", "SIN1", "W1", "R1", "$1.00", "06/01/2026"],
        ["", "SIN2", "", "", "", ""],
        [None, "SIN3", "", "", "", ""],
        ["05/01/2026", None, "", "", "", ""],
        ["05/02/2026", "SIN4"],
        ["Total Outstanding Invoices:", "x", "", "", "", ""],
    ]
    frame = ingest.attach_shop(pages(spark, {"cells": table}), VENDOR)
    got = [(r.row_number, r.invoice_number, r.due_date, r.shop) for r in ingest.cells_to_records(frame, VENDOR).collect()]
    assert got == [(2, "SIN1", "06/01/2026", "Main"), (6, "SIN4", None, "Main")]


def test_voucher_lines(spark):
    text = "Paid To\n 05/01/2026 Bill #A-1 1,000.00 900.00 900.00 \nnoise\n5/2/2026 Bill Credit #C1 -10.00\n5/3/2026 Bill #B1 1"
    adapter = Adapter(name="payment_voucher")
    rows = adapters.ledger_rows(pages(spark, {"voucher_text": text}), VENDOR, adapter).collect()
    assert [(r.row_number, r.raw_transaction_date, r.raw_amount_due, r.raw_applied_amount) for r in rows] == [
        (1, "05/01/2026", "900.00", "900.00"),
        (2, "5/2/2026", None, "-10.00"),
    ]
    with pytest.raises(ValueError):
        adapters.ledger_rows(pages(spark), VENDOR, Adapter(name="netsuite"))


TABLE = [["05/01/2026", "SIN9", "W", "R", "$1,234.50", "06/01/2026"]]


def test_whole_document(spark):
    given = pages(
        spark,
        {"page_number": 1, "text": answer(RECORD, {**RECORD, "invoice_number": "SIN2", "confidence": 0.2}), "cells": TABLE},
        {"page_number": 2, "text": answer({**RECORD, "outstanding_amount": "48.750"}, {**RECORD, "invoice_number": "SIN3"})},
        {"page_number": 3, "success": False, "error": "HTTP 503 on attempt 4", "cells": TABLE},
        {"page_number": 4, "text": '{"rows":[]}', "cells": TABLE},
        {"page_number": 5, "text": '{"invoices":[]}'},
    )
    out = reconcile.to_bronze(given, VENDOR, run_at="2026-06-01 00:00:00")
    bronze = out["bronze_vendor_statement_raw"].orderBy("page_number", "row_number").collect()
    # Page 3's and 4's tables hold the same line: the first stays, the second is a duplicate.
    assert [(r.page_number, r.raw_invoice_number, r.extraction_model) for r in bronze] == [
        (1, "SIN1", "m"), (2, "SIN3", "m"), (3, "SIN9", None),
    ]
    texts = {r.page_number: r.text for r in given.collect()}
    assert [r.raw_gemini_response for r in bronze] == [texts[1], texts[2], None]
    queue = {(r.rejection_category, r.pipeline_stage): r for r in out["validation_document_review_queue"].collect()}
    assert out["validation_document_review_queue"].count() == 5
    assert set(queue) == {
        (K.LOW_CONFIDENCE, K.STAGE_EXTRACTION), (K.DUPLICATE_RECORD, K.STAGE_VALIDATION),
        (K.AI_CALL_FAILED, K.STAGE_EXTRACTION), (K.MALFORMED_JSON, K.STAGE_EXTRACTION),
    }
    low = queue[K.LOW_CONFIDENCE, K.STAGE_EXTRACTION]
    assert (str(low.extraction_confidence), str(low.confidence_threshold_applied)) == ("0.2000", "0.7500")
    assert low.review_status == K.PENDING_REVIEW and json.loads(low.raw_payload)["invoice_number"] == "SIN2"
    assert queue[K.DUPLICATE_RECORD, K.STAGE_VALIDATION].ai_audit_id is None
    failed = queue[K.AI_CALL_FAILED, K.STAGE_EXTRACTION]
    assert failed.rejection_details == "Page 3: HTTP 503 on attempt 4" and failed.raw_payload == "HTTP 503 on attempt 4"
    audit = {r.audit_id: r for r in out["ai_audit_log"].collect()}
    assert sorted(r.validation_result for r in audit.values()) == [
        "0/0 valid", "1/2 valid", "2/2 valid", "AI_CALL_FAILED", "MALFORMED_JSON",
    ]
    assert audit[failed.ai_audit_id].response_status == "HTTP_ERROR"
    assert str(audit[low.ai_audit_id].extraction_confidence) == "0.5750"
    cells_only = reconcile.to_bronze(given, replace(VENDOR, extraction_method="pdfplumber_tabular"))
    assert set(cells_only) == {"bronze_vendor_statement_raw"}
    assert cells_only["bronze_vendor_statement_raw"].count() == 3


def test_duplicates_against_brute_force(spark):
    rows = spark.range(3000).select(
        F.lit("V").alias("vendor_id"), F.lit("f").alias("source_file"), F.lit("S").alias("statement_id"),
        F.lit("2026-05").alias("statement_period"), (F.col("id") % 7).cast("int").alias("page_number"),
        F.col("id").cast("int").alias("row_number"), F.lit("V").alias("vendor"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 400).cast("string")).alias("invoice_number"),
        F.when(F.col("id") % 5 == 0, None).otherwise("1.00").alias("amount"),
    )
    key = ["vendor", "invoice_number", "amount"]
    flagged = ingest.flag_duplicates(rows, key).collect()
    assert len(flagged) == 3000
    seen = set()
    for r in sorted(flagged, key=lambda r: (r.page_number, r.row_number)):
        value = tuple(r[k] for k in key)
        assert r.is_duplicate == (value in seen)
        seen.add(value)


def test_first_page_delivered_twice(spark):
    rows = [("V1", "f", "d", "2026-05", p, "no header") for p in (1, 1, 2)]
    given = spark.createDataFrame(rows, "vendor_id string, source_file string, statement_id string, statement_period string, page_number int, page_text string")
    assert ingest.attach_shop(given, VENDOR).count() == len(rows)


def test_responses_are_attached_last(spark):
    """A page delivered twice with different responses: no record carries its response, each gets its own at the end."""
    one, two = answer(RECORD), answer({**RECORD, "invoice_number": "SIN2"}, {**RECORD, "invoice_number": "SIN3"})
    given = pages(spark, {"text": one}, {"text": two})
    records = ingest.page_records(ingest.attach_shop(given, VENDOR), VENDOR, ValidationRules())
    assert {r.text for r in records.collect()} == {None}
    got = {r.invoice_number: r.text for r in ingest.attach_responses(records, given).collect()}
    assert got == {"SIN1": one, "SIN2": two, "SIN3": two}


def test_page_delivered_twice(spark):
    """The later delivery of a page adds what is new in it; the rest are duplicates of the earlier one, whatever their rows."""
    new = {**RECORD, "invoice_number": "SIN9"}
    given = pages(spark, {"text": answer(RECORD)}, {"text": answer(new, RECORD)}, {"text": answer(RECORD), "page_number": 2})
    given = given.withColumn("delivery", F.when(F.col("text") == answer(new, RECORD), 10**18 - 1).otherwise(F.lit(0)).cast("long"))
    records = ingest.page_records(ingest.attach_shop(given, VENDOR), VENDOR, ValidationRules())
    flagged = ingest.flag_duplicates(records, ValidationRules().duplicate_key)
    got = sorted((r.invoice_number, r.page_number, r.delivery, r.is_duplicate) for r in flagged.collect())
    late = 10**18 - 1
    assert got == [("SIN1", 1, 0, False), ("SIN1", 1, late, True), ("SIN1", 2, 0, True), ("SIN9", 1, late, False)]
    text = flagged._jdf.queryExecution().executedPlan().toString()
    assert any("HashAggregate" in line and "min(_place" in line for line in text.split("\n"))


def test_a_string_that_looks_like_an_object_is_none(spark):
    texts = {
        '{"invoices":["{\\"a\\":1}",{"b":2}]}': ['{"b":2}'],
        '{"invoices":["\\u007b","\\u007B}",{"b":"{"}, 7, null, ["{"]]}': ['{"b":"{"}'],
        '{"invoices":[{"b":"\\"{"}]}': ['{"b":"\\"{"}'],
        '{"invoices":["{"]}': [],
        '{"invoices":[]}': [],
    }
    got = ingest.parse_responses(pages(spark, *[{"text": t} for t in texts])).select("text", "items").collect()
    assert {r.text: r.items for r in got} == texts


def test_delivery_numbers_of_files(spark, tmp_path):
    spark.range(50, numPartitions=2).write.parquet(str(tmp_path / "pages"))
    read = lambda: [r[0] for r in spark.read.parquet(str(tmp_path / "pages")).select(ingest.file_delivery()).collect()]
    numbers = read()
    assert sorted(numbers) == sorted(read()) and len(set(numbers)) == 50 and all(0 < n < 10**18 for n in numbers)


def test_unknown_extraction_method(spark):
    with pytest.raises(ValueError, match="unknown extraction method"):
        reconcile.to_bronze(spark.range(0), replace(VENDOR, extraction_method="guess"))


def test_candidates_leave_the_response_behind(spark):
    """What moves to find duplicates holds neither an item's text nor a page's audit; responses are named by 16 bytes."""
    frame = ingest.attach_shop(pages(spark, {"text": answer(RECORD)}, {"text": "[1]", "page_number": 2}), VENDOR)
    records = ingest.page_records(frame, VENDOR, ValidationRules())
    moved = ingest.candidate_records(records, frame, VENDOR)
    assert not {"item", "audit_id", "rejection_details"} & set(moved.columns) and dict(moved.dtypes)["response_key"] == "binary"


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_field_is_tested_once(spark):
    """category, details and threshold follow from one test of each field, however many of them are asked for."""
    rules = ValidationRules()
    fields = sorted({*rules.required, *rules.numeric, *rules.dates, "confidence"})
    checked = ingest.validate(spark.createDataFrame([], ", ".join(f"{f} string" for f in fields)), rules)
    text = checked._jdf.queryExecution().analyzed().toString()
    assert text.count(K.DATE_LIKE) == len(rules.dates)


def test_records_are_parsed_once_and_cells_read_only_where_needed(spark):
    """kept records are read by the fallback and by the search for duplicates, which parse no response; the pages
    that have records lose their cells before these become rows."""
    header = ["Invoice Date", "Invoice #"]
    cells = [header, ["05/02/2026", "SIN2"], ["05/02/2026", "SIN2"]]
    frame = stored(ingest.attach_shop(pages(spark, {"text": answer(RECORD, RECORD), "cells": cells}, {"text": "[1]", "page_number": 2, "cells": cells}), VENDOR))
    made = ingest.candidate_records(ingest.page_records(frame, VENDOR, ValidationRules()), frame, VENDOR, keep=stored)
    flagged = ingest.flag_duplicates(made, ["invoice_number"])
    plan = _plan(flagged)
    assert "from_json" not in plan
    assert plan.index("posexplode(cells") < plan.index("LeftAnti")
    got = {(r.page_number, r.row_number, r.invoice_number, r.is_duplicate) for r in flagged.collect()}
    assert got == {(1, 1, "SIN1", False), (1, 2, "SIN1", True), (2, 2, "SIN2", False), (2, 3, "SIN2", True)}


def test_redelivered_pages_parse_once(spark):
    """the query's own plan reads stored records, and the lists of a page are not sorted by a lambda."""
    sf = "/root/testdata/sf0.001"
    assert "from_json" not in _plan(queries.redelivered_pages(spark, sf))
    assert "array_sort" not in _plan(orders.pages(spark, sf))
