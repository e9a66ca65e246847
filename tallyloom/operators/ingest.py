"""Pages to Bronze: table cells, printed lines and extraction responses become statement records.

Input is one row per page. A page is named by `DOCUMENT` + `page_number`; everything read from a
page stays in that page's row until it is exploded, so ingestion shuffles only where pages of a
document must meet: the header's shop, the per-page fallback and duplicates across pages.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import contract as K
from tallyloom.config import ValidationRules, VendorRules
from tallyloom.functions import keys, money, text
from tallyloom.operators.joins import computed_once, lookup_join
from tallyloom.schemas import schema

DOCUMENT = ["vendor_id", "source_file", "statement_id", "statement_period"]
PAGE = [*DOCUMENT, "page_number"]
_AMOUNTS = ("amount", "outstanding_amount")
_OPTIONAL = ("amount", "document_section", "confidence")


DELIVERY = "delivery"


def _delivery(rows: DataFrame) -> list[str]:
    """The delivery number travels with a page's records where pages have one."""
    return [DELIVERY] if DELIVERY in rows.columns else []


def file_delivery() -> Column:
    """A delivery number for pages read from files: when the file came, in seconds, then a number of the file's row, the same in
    every run. At most 18 digits, as `flag_duplicates` needs."""
    came = F.unix_seconds(F.col("_metadata.file_modification_time"))
    row = F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.lit(100_000_000))
    return came * 100_000_000 + row


# --- reading one page -------------------------------------------------------------------
def attach_shop(pages: DataFrame, rules: VendorRules) -> DataFrame:
    """The shop printed on a document's first page, for all its pages; NULL if it is not found."""
    first = pages.where(F.col("page_number") == 1).select(
        *DOCUMENT, text.header_value(F.col("page_text"), rules.shop_pattern).alias("shop")
    )
    # A first page that was delivered twice must not multiply the document's pages.
    first = first.groupBy(*DOCUMENT).agg(F.min("shop").alias("shop"))
    return lookup_join(pages, first, DOCUMENT, null_safe=True)


def cells_to_records(pages: DataFrame, rules: VendorRules) -> DataFrame:
    """Table cells to records: no header, no footer, no row without an invoice number.

    Row numbers count every row of the table, also the ones left out.
    """
    row = F.col("row")
    first, number = F.get(row, F.lit(0)), F.get(row, F.lit(1))
    return (
        pages.select(*PAGE, *_delivery(pages), "shop", F.posexplode("cells").alias("pos", "row"))
        .where(first.isNotNull() & ~first.isin("", K.HEADER_CELL) & ~first.startswith(K.FOOTER_PREFIX))
        .where(number.isNotNull() & (number != ""))
        .select(
            *PAGE,
            *_delivery(pages),
            (F.col("pos") + 1).alias("row_number"),
            *[F.get(row, F.lit(i)).alias(name) for i, name in enumerate(rules.fields)],
            "shop",
        )
    )


def voucher_lines(pages: DataFrame, invoice_pattern: str, credit_pattern: str) -> DataFrame:
    """Printed voucher lines to rows: an invoice line has three amounts, a credit line one.

    Row numbers count the lines that matched, per page.
    """
    line = F.col("raw_description")
    date, amount = K.VOUCHER_DATE, K.VOUCHER_MONEY
    invoice = rf"^({date})\s+{_uncaptured(invoice_pattern)}\s+({amount})\s+({amount})\s+({amount})$"
    credit = rf"^({date})\s+{_uncaptured(credit_pattern)}\s+({amount})$"
    found = F.filter(
        F.transform(F.split("voucher_text", "\n"), text.strip), lambda x: x.rlike(invoice) | x.rlike(credit)
    )
    is_invoice = line.rlike(invoice)
    return (
        pages.select(*PAGE, F.posexplode(found).alias("pos", "raw_description"))
        .select(
            *PAGE,
            (F.col("pos") + 1).alias("row_number"),
            F.when(is_invoice, F.regexp_extract(line, invoice, 1))
            .otherwise(F.regexp_extract(line, credit, 1))
            .alias("raw_transaction_date"),
            "raw_description",
            F.when(is_invoice, F.regexp_extract(line, invoice, 3)).alias("raw_amount_due"),
            F.when(is_invoice, F.regexp_extract(line, invoice, 4))
            .otherwise(F.regexp_extract(line, credit, 2))
            .alias("raw_applied_amount"),
        )
    )


def _uncaptured(pattern: str) -> str:
    return pattern.replace(r"(\S+)", r"\S+")


def parse_responses(pages: DataFrame) -> DataFrame:
    """Add `items` (the JSON objects of a good response) and `contract_error` (why it has none)."""
    body = F.ltrim("text")
    # An object or nothing: from_json would also unwrap a one-element array.
    invoices = F.when(body.startswith("{"), F.from_json("text", "invoices array<string>")["invoices"])
    kind = (
        F.when(body.startswith("{"), "dict")
        .when(body.startswith("["), "list")
        .when(body.startswith('"'), "str")
        .when(body.rlike("^(true|false)"), "bool")
        .when(body.rlike(r"^-?\d+\s*$"), "int")
        .when(body.rlike(r"^-?\d"), "float")
        .otherwise("NoneType")
    )
    ok = F.col("success")
    return (
        computed_once(pages, _invoices=F.when(ok, invoices))
        .withColumn("items", _objects(F.col("_invoices"), F.col("text")))
        .withColumn(
            "contract_error",
            F.when(ok & F.col("_invoices").isNull(), _contract_error(kind)),
        )
        .drop("_invoices")
    )


def _objects(invoices: Column, response: Column) -> Column:
    """The items that are JSON objects, as they were written.

    An item's text starts with a brace if it is an object, or a string that starts with one. A response in which no string
    does is settled by that; others are parsed as a variant, which knows the type of every item.
    """
    braced = lambda x: x.startswith("{")
    doubtful = response.rlike(r'"(?:\{|\\u007[bB])')
    typed = F.try_variant_get(F.try_parse_json(response), "$.invoices", "array<variant>")
    is_object = F.coalesce(F.transform(typed, lambda v: F.schema_of_variant(v).startswith("OBJECT")), F.array().cast("array<boolean>"))
    # Side by side: a look-up inside a filter would parse the whole response again for each of its items.
    sure = F.filter(F.zip_with(invoices, is_object, lambda x, o: F.when(braced(x) & F.coalesce(o, F.lit(True)), x)), lambda x: x.isNotNull())
    return F.when(doubtful, sure).otherwise(F.filter(invoices, braced))


def _contract_error(kind: Column) -> Column:
    before, after = K.CONTRACT_ERROR.format(kind="\0").split("\0")
    return F.concat(F.lit(before), kind, F.lit(after))


# --- one record -----------------------------------------------------------------------------
def standardize(records: DataFrame, derive_amount: bool) -> DataFrame:
    """Name the vendor, derive a missing amount from the outstanding one, make amounts canonical."""
    amount = F.col("amount")
    own = money.canonical_amount(amount)
    rows = computed_once(
        records.withColumn("vendor", F.col("vendor_id")), outstanding_amount=money.canonical_amount(F.col("outstanding_amount"))
    )
    # A derived amount is canonical already.
    return computed_once(rows, amount=F.when(amount.isNull() | (amount == ""), F.col("outstanding_amount")).otherwise(own) if derive_amount else own)


def validate(records: DataFrame, rules: ValidationRules) -> DataFrame:
    """Add `rejection_category` (NULL when valid), details, and the confidence that was checked.

    Structural faults come first and leave the confidence unchecked: all missing fields together,
    then the first field that is not a number, then the first that does not look like a date. A
    record without a confidence passes.
    """

    def missing(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name) == "")

    absent = F.array_compact(F.array(*[F.when(missing(f), F.lit(f)) for f in rules.required]))
    steps = [
        (
            F.size(absent) > 0,
            K.MISSING_MANDATORY_FIELD,
            text.render(K.DETAIL_MISSING_FIELDS, fields=F.array_join(absent, ", ")),
        )
    ] if rules.required else []
    for f in rules.numeric:
        steps.append(
            (
                F.col(f).isNotNull() & ~text.is_numeric(F.col(f)),
                K.INVALID_FIELD_TYPE,
                text.render(K.DETAIL_NOT_NUMERIC, field=F.lit(f), value=text.quoted(F.col(f))),
            )
        )
    for f in rules.dates:
        steps.append(
            (
                F.col(f).isNotNull() & ~text.looks_like_date(F.col(f)),
                K.INVALID_FIELD_TYPE,
                text.render(K.DETAIL_NOT_A_DATE, field=F.lit(f), value=text.quoted(F.col(f))),
            )
        )
    confidence = F.col("confidence").try_cast("double")
    steps.append(
        (
            F.col("confidence").isNotNull() & confidence.isNull(),
            K.INVALID_FIELD_TYPE,
            text.render(K.DETAIL_NOT_NUMERIC, field=F.lit("extraction_confidence"), value=text.quoted(F.col("confidence"))),
        )
    )
    threshold = rules.confidence_threshold
    structural = len(steps)
    if threshold is not None:
        steps.append(
            (
                confidence < F.lit(float(threshold)),
                K.LOW_CONFIDENCE,
                text.render(
                    K.DETAIL_LOW_CONFIDENCE, confidence=text.number_shown(F.col("confidence")), threshold=F.lit(str(threshold))
                ),
            )
        )
    # Each field is tested once: all that is reported follows from the first step that fails.
    first, fault = F, F.col("_fault")
    category = details = F
    for position, (fails, name, message) in enumerate(steps):
        first = first.when(fails, position)
        category = category.when(fault == position, name)
        details = details.when(fault == position, message)
    broken = F.coalesce(fault < structural, F.lit(False))
    limit = F.lit(None) if threshold is None else F.lit(float(threshold))
    # A threshold is reported with a rejected record only where it decided.
    return (
        computed_once(records, _fault=first.otherwise(F.lit(None)), _confidence=confidence)
        .withColumns(
            {
                "rejection_category": category.otherwise(F.lit(None)),
                "rejection_details": details.otherwise(F.lit(None)),
                "checked_confidence": F.when(~broken, F.col("_confidence")),
                "threshold_applied": F.when(~broken, limit.cast("double")),
            }
        )
        .drop("_fault", "_confidence")
    )


# --- a whole response ----------------------------------------------------------------------------
def page_records(pages: DataFrame, rules: VendorRules, validation: ValidationRules) -> DataFrame:
    """Every item of every page, standardised and validated; a page without items keeps one row
    whose `item` is NULL, so page-level results need no join back.

    A response is as long as its page, so no record carries it: records name it by `response_key`, and
    `text` stays only where a page has no items."""
    fields = [*rules.fields, *[f for f in _OPTIONAL if f not in rules.fields]]
    parsed = parse_responses(pages).withColumns({"response_key": response_key(), "audit_id": page_audit_id()})
    rows = parsed.select(
        *PAGE, *_delivery(pages), "shop", "success", "error", "text", "response_key", "latency_ms", "attempt_count", "model", "contract_error",
        "audit_id", F.posexplode_outer("items").alias("pos", "item"),
    )
    item_type = ", ".join(f"{f} string" for f in fields)
    read = computed_once(rows, _item=F.from_json("item", item_type))
    flat = read.select(*rows.columns, *[F.col(f"_item.{f}").alias(f) for f in fields]).withColumns(
        {"row_number": (F.col("pos") + 1).cast("int"), "text": F.when(F.col("item").isNull(), F.col("text"))}
    )
    return validate(standardize(flat, rules.derive_amount), validation)


def response_key() -> Column:
    """What names a response: 16 bytes, half of what they take in hex."""
    return F.unhex(F.md5("text"))


def attach_responses(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Fill `text` with the response a record came from; NULL where it came from none.

    The last step before Bronze: only here a response meets its records again, and nothing shuffles
    the result. A page delivered twice with the same response counts once.
    """
    key = [*PAGE, "response_key"]
    responses = pages.where(F.col("text").isNotNull()).select(*PAGE, response_key().alias("response_key"), "text")
    unique = responses.groupBy(*key).agg(F.first("text").alias("text"))
    return lookup_join(records.drop("text"), unique, key, null_safe=True)


def page_audit_id() -> Column:
    return keys.stable_id("audit", *[F.col(c) for c in PAGE])


def is_record() -> Column:
    return F.col("item").isNotNull()


def is_valid() -> Column:
    return is_record() & F.col("rejection_category").isNull()


def accepted(records: DataFrame) -> DataFrame:
    return records.where(is_valid())


def page_audit(records: DataFrame, provider: str, run_at: str | None = None) -> DataFrame:
    """One audit row per response: how many of its records are valid and their mean confidence.

    Page facts are grouping keys, so the aggregate finishes on the map side, where all rows of a
    page already are, and shuffles one narrow row per page.
    """
    facts = ["success", "error", "latency_ms", "attempt_count", "model", "contract_error", "audit_id"]
    ratio = text.render(K.VALIDATION_RATIO, valid=F.col("valid").cast("string"), total=F.col("total").cast("string"))
    return (
        records.groupBy(*PAGE, *facts)
        .agg(
            F.count_if(is_valid()).alias("valid"),
            F.count("item").alias("total"),
            F.avg(F.col("confidence").try_cast("decimal(28,6)")).alias("mean_confidence"),
        )
        .select(
            "audit_id",
            *[c for c in PAGE if c != "statement_period"],
            F.lit(K.INTERACTION_EXTRACTION).alias("interaction_type"),
            F.lit(provider).alias("ai_provider"),
            "model",
            F.lit(K.PROMPT_VERSION).alias("prompt_version"),
            F.lit(run_at).cast("timestamp").alias("request_timestamp"),
            "latency_ms",
            "attempt_count",
            "success",
            text.error_bucket(F.col("success"), F.col("error")).alias("response_status"),
            F.col("error").alias("error_message"),
            money.confidence(F.col("mean_confidence")).alias("extraction_confidence"),
            F.when(~F.col("success"), K.AI_CALL_FAILED)
            .when(F.col("contract_error").isNotNull(), K.MALFORMED_JSON)
            .otherwise(ratio)
            .alias("validation_result"),
        )
    )


# --- a whole document -------------------------------------------------------------------------------
def uncovered(rows: DataFrame, valid: DataFrame) -> DataFrame:
    """Those of the rows, pages or what was read from them, whose page has no valid response record."""
    return lookup_join(rows, valid.select(*PAGE).distinct(), PAGE, "left_anti", null_safe=True)


def with_fallback(valid: DataFrame, cell_records: DataFrame) -> DataFrame:
    """Valid response records, plus the table-cell records of every page that has none."""
    return valid.unionByName(uncovered(cell_records, valid), allowMissingColumns=True)


def flag_duplicates(records: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add `is_duplicate`: true for every record after the first of its key within a document.

    NULLs in the key are equal to each other. The first position per key is an aggregate that
    combines on the map side, not a window, so a record copied a million times is no hot group;
    only keys that do repeat come back into the join.

    Where records have a `delivery` (a number from 0 of at most 18 digits that grows with the arrival of pages and differs
    between two deliveries of a page), an earlier delivery of a page comes before a later one, so a page that is delivered
    again adds nothing but duplicates and what is new in it.
    """
    place = F.col("page_number").cast("bigint") * 4_294_967_296 + F.col("row_number")
    if DELIVERY in records.columns:
        # Page, delivery and row side by side in one number, whose minimum needs a buffer of fixed width.
        page, row = F.col("page_number").cast("decimal(10,0)"), F.col("row_number").cast("decimal(10,0)")
        place = page * F.lit(Decimal(10) ** 28) + F.col(DELIVERY).cast("decimal(18,0)") * F.lit(Decimal(10) ** 10) + row
    group = [*DOCUMENT, *[k for k in key if k not in DOCUMENT]]
    placed = records.withColumn("_place", place)
    repeated = (
        placed.groupBy(*group)
        .agg(F.count("*").alias("_copies"), F.min("_place").alias("_first"))
        .where(F.col("_copies") > 1)
        .drop("_copies")
    )
    return (
        lookup_join(placed, repeated, group, null_safe=True)
        .withColumn("is_duplicate", F.coalesce(F.col("_place") != F.col("_first"), F.lit(False)))
        .drop("_place", "_first")
    )


def bronze_rows(kept: DataFrame, run_at: str | None = None) -> DataFrame:
    """Standard records to Bronze rows; model and response text are NULL for fallback records."""
    return kept.select(
        *DOCUMENT,
        F.col("page_number").cast("int").alias("page_number"),
        F.col("row_number").cast("int").alias("row_number"),
        F.lit(run_at).cast("timestamp").alias("ingestion_timestamp"),
        *[
            F.col(name).alias(f"raw_{name}")
            for name in (
                "invoice_date", "invoice_number", "work_order_number", "ro_number", "outstanding_amount", "due_date",
            )
        ],
        F.col("shop").alias("raw_shop_name"),
        money.confidence(F.col("confidence")).alias("extraction_confidence"),
        F.col("model").alias("extraction_model"),
        "document_section",
        F.lit(None).cast("string").alias("bounding_box"),
        F.col("text").alias("raw_gemini_response"),
    )


def _queue(rows: DataFrame, stage: str, run_at: str | None, **columns: Column) -> DataFrame:
    """Review rows in the table's shape: pending, nothing resolved yet."""
    filled = {
        "review_id": keys.stable_id(
            "review", *[F.col(c) for c in PAGE], columns["row_number"], columns["rejection_category"]
        ),
        "pipeline_stage": F.lit(stage),
        "review_status": F.lit(K.PENDING_REVIEW),
        "flagged_timestamp": F.lit(run_at),
        **{name: column for name, column in columns.items() if name != "row_number"},
    }
    return rows.select(
        *[
            filled.get(f.name, F.col(f.name) if f.name in DOCUMENT else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema("validation_document_review_queue")
        ]
    )


def rejected_rows(records: DataFrame, run_at: str | None = None) -> DataFrame:
    """Records that failed validation."""
    failed = records.where(is_record() & F.col("rejection_category").isNotNull())
    low = F.col("rejection_category") == K.LOW_CONFIDENCE
    return _queue(
        failed,
        K.STAGE_EXTRACTION,
        run_at,
        row_number=F.col("row_number"),
        rejection_category=F.col("rejection_category"),
        rejection_details=F.col("rejection_details"),
        extraction_confidence=money.confidence(F.when(low, F.col("checked_confidence"))),
        confidence_threshold_applied=money.confidence(F.when(low, F.col("threshold_applied"))),
        raw_payload=F.col("item"),
        ai_audit_id=F.col("audit_id"),
    )


def failed_pages(records: DataFrame, run_at: str | None = None) -> DataFrame:
    """Pages whose call failed or whose answer broke the contract: one review row each."""
    call_failed = ~F.col("success")
    broken = records.where(call_failed | F.col("contract_error").isNotNull())
    reason = F.when(call_failed, text.shown(F.col("error"))).otherwise(F.col("contract_error"))
    payload = F.when(F.col("text") != "", F.col("text")).otherwise(F.coalesce("error", F.lit("")))
    return _queue(
        broken,
        K.STAGE_EXTRACTION,
        run_at,
        row_number=F.lit(None),
        rejection_category=F.when(call_failed, K.AI_CALL_FAILED).otherwise(K.MALFORMED_JSON),
        rejection_details=text.render(K.DETAIL_PAGE_ERROR, page=F.col("page_number").cast("string"), error=reason),
        raw_payload=payload,
        ai_audit_id=F.col("audit_id"),
    )


_PAYLOAD = (
    "invoice_date", "invoice_number", "work_order_number", "ro_number", "outstanding_amount", "due_date",
    "vendor", "shop", "amount", "page_number", "row_number",
)


def duplicate_rows(flagged: DataFrame, key: Sequence[str], run_at: str | None = None) -> DataFrame:
    """Later copies of a record; they belong to no single response, so no audit id."""
    values = F.concat(F.lit("["), F.concat_ws(", ", *[text.quoted(F.col(k)) for k in key]), F.lit("]"))
    names = "[" + ", ".join(repr(k) for k in key) + "]"
    return _queue(
        flagged.where("is_duplicate"),
        K.STAGE_VALIDATION,
        run_at,
        row_number=F.col("row_number"),
        rejection_category=F.lit(K.DUPLICATE_RECORD),
        rejection_details=text.render(K.DETAIL_DUPLICATE, fields=F.lit(names), values=values),
        raw_payload=F.to_json(F.struct(*_PAYLOAD), {"ignoreNullFields": "false"}),
    )


_OF_RESPONSE = (
    "item", "pos", "success", "error", "contract_error", "latency_ms", "attempt_count", "audit_id",
    "rejection_category", "rejection_details", "checked_confidence", "threshold_applied",
)


def candidate_records(
    records: DataFrame, pages: DataFrame, rules: VendorRules, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> DataFrame:
    """What may enter Bronze: valid records and, if the vendor wants it, the per-page fallback.

    Valid records are read more than once, here and by what looks for duplicates; `keep` may write them, so that records that
    are not stored yet are parsed once. Cells are read only of the pages that need them.

    Fallback records are standardised but not validated, and carry no model and no response. What only the review and the
    audit of a response ask for stays behind, the item's own text above all: records move from here on.
    """
    valid = keep(accepted(records).drop(*_OF_RESPONSE))
    if not rules.fallback_on_failure:
        return valid
    cells = with_blank_extraction(cells_to_records(uncovered(pages, valid), rules))
    return valid.unionByName(standardize(cells, rules.derive_amount), allowMissingColumns=True)


def with_blank_extraction(cells: DataFrame) -> DataFrame:
    """Table-cell records with the fields only a response can fill, all NULL."""
    blank = [f for f in (*_OPTIONAL, "model", "response_key", "text") if f not in cells.columns]
    return cells.withColumns({f: F.lit(None).cast("binary" if f == "response_key" else "string") for f in blank})


def pattern_flags(bronze: DataFrame, pattern: str) -> DataFrame:
    """Flag, never reject, invoice numbers that do not look like this vendor's."""
    return bronze.withColumn("conforms", F.coalesce(text.conforms(F.col("raw_invoice_number"), pattern), F.lit(False)))
