"""Names, texts, patterns and rules that results must carry exactly.

Everything here is data, not logic. The operators read it; nothing else in the
package spells these strings a second time.
"""

# --- vocabularies ---------------------------------------------------------
STATEMENT_SOURCE = "VENDOR_STATEMENT"
LEDGER_SOURCE = "INTERNAL_ERP"

MATCHED = "MATCHED"
EXCEPTION = "EXCEPTION"
POSTED = "POSTED"
PENDING = "PENDING"
OPEN = "Open"
PENDING_REVIEW = "PENDING_REVIEW"

INVOICE_MISSING = "Invoice Missing"
AMOUNT_MISMATCH = "Amount Mismatch"
DUPLICATE_INVOICE = "Duplicate Invoice"
MISSING_CREDIT = "Missing Credit"
PENDING_POSTING = "Pending Posting"
UNMATCHED_RECORD = "Unmatched Record"

LEVEL_1 = "LEVEL_1_FULL_MATCH"
LEVEL_2 = "LEVEL_2_AMOUNT_MATCH_RO_MISSING"
LEVEL_3 = "LEVEL_3_RO_CONFLICT"

RECONCILED = "RECONCILED"
MINOR_VARIANCE = "MINOR_VARIANCE"
EXCEPTIONS_PRESENT = "EXCEPTIONS_PRESENT"
OVERALL_STATUSES = (RECONCILED, MINOR_VARIANCE, EXCEPTIONS_PRESENT)

MISSING_MANDATORY_FIELD = "MISSING_MANDATORY_FIELD"
INVALID_FIELD_TYPE = "INVALID_FIELD_TYPE"
LOW_CONFIDENCE = "LOW_CONFIDENCE"
DUPLICATE_RECORD = "DUPLICATE_RECORD"
AI_CALL_FAILED = "AI_CALL_FAILED"
MALFORMED_JSON = "MALFORMED_JSON"

STAGE_EXTRACTION = "AI_EXTRACTION"
STAGE_VALIDATION = "VALIDATION"
INTERACTION_EXTRACTION = "EXTRACTION"
PROMPT_VERSION = "extraction_v1"

# --- response status buckets: first hit wins, text compared in lower case ---
STATUS_SUCCESS = "SUCCESS"
STATUS_UNKNOWN = "UNKNOWN_ERROR"
ERROR_CONTAINS = (
    ("missing api key", "MISSING_API_KEY"),
    ("environment variable", "MISSING_API_KEY"),
    ("transport error", "TRANSPORT_ERROR"),
    ("not valid json", "PARSE_ERROR"),
    ("unexpected response shape", "PARSE_ERROR"),
)
ERROR_STARTS_WITH = (("http ", "HTTP_ERROR"),)

# --- reason texts; {name} is replaced by the row's value ---------------------
REASON_LEVEL_1 = "Invoice number (normalized), amount, and RO number all agree."
REASON_LEVEL_2 = "Invoice number (normalized) and amount agree; RO number is missing on at least one side."
REASON_LEVEL_3 = (
    "Invoice number (normalized) and amount agree; RO numbers differ ({statement_ro} vs {ledger_ro}) -- "
    "treated as a lower-confidence match, not a failure."
)
REASON_DUPLICATE = "{count} ERP records share invoice number {normalized} (expected exactly 1); {note}."
NOTE_COPIES_AGREE = "all copies have the same outstanding_amount"
NOTE_COPIES_DIFFER = "the copies do NOT all agree on outstanding_amount -- review individually"
REASON_MISSING = "No ERP record found for invoice {number}."
REASON_MISSING_WORK_ORDER = (
    " An ERP record with invoice_number={ledger_number} matches this statement invoice's work_order_number "
    "({work_order}) -- likely a vendor reference issue (the ERP recorded the work order instead of the invoice "
    "number), but this is reported as Invoice Missing since Levels 1-3 cannot confirm it."
)
REASON_PENDING = (
    "ERP record for invoice {number} has status={status}, not POSTED -- not yet finished posting."
)
REASON_MISSING_CREDIT = (
    "ERP's original amount ({ledger_amount}) matches the statement ({statement_outstanding}), but a credit of "
    "{credit} was applied on the ERP side that isn't on the statement, reducing outstanding_amount to "
    "{ledger_outstanding}."
)
REASON_MISMATCH_CREDIT = (
    "Statement outstanding_amount ({statement_outstanding}) does not match ERP outstanding_amount "
    "({ledger_outstanding}); a credit of {credit} is also present on the ERP side but does not fully explain the "
    "discrepancy."
)
REASON_MISMATCH = (
    "Statement outstanding_amount ({statement_outstanding}) does not match ERP outstanding_amount "
    "({ledger_outstanding})."
)
REASON_UNMATCHED = "ERP record for invoice {number} has no corresponding Vendor Statement invoice."

# --- rejection texts ----------------------------------------------------------
DETAIL_MISSING_FIELDS = "Missing required field(s): {fields}"
DETAIL_NOT_NUMERIC = "Field '{field}' is not numeric: {value}"
DETAIL_NOT_A_DATE = "Field '{field}' does not look like a date: {value}"
DETAIL_LOW_CONFIDENCE = "extraction_confidence {confidence} is below threshold {threshold}"
DETAIL_DUPLICATE = "Duplicate on {fields}: {values}"
DETAIL_PAGE_ERROR = "Page {page}: {error}"
CONTRACT_ERROR = "Expected a JSON object shaped like {{'invoices': [...]}}, got: {kind}"
VALIDATION_RATIO = "{valid}/{total} valid"

# --- patterns and formats --------------------------------------------------------
DATE_LIKE = r"\d{1,4}[/\-]\d{1,2}[/\-]\d{1,4}"
MONEY_NOISE = r"[^\d.\-]"
LOOSE_MONEY_NOISE = r"[$, ]"
HEADER_CELL = "Invoice Date"
FOOTER_PREFIX = "Total"
VOUCHER_DATE = r"\d{1,2}/\d{1,2}/\d{4}"
VOUCHER_MONEY = r"[\d,.\-]+"
SYNTHETIC_WORK_ORDER_PREFIX = "WO-SYNTH-"

# --- texts of the ground-truth manifest ---------------------------------------------
DETAILS_EXACT = "ERP record mirrors the statement exactly."
DETAILS_REVISION = "ERP re-issued the invoice number with suffix {suffix}: {number} -> {ledger_number}"
DETAILS_MISSING = "Invoice exists on the statement but is entirely absent from the ERP extract."
DETAILS_MISMATCH = "ERP amount differs from the statement by {sign}{pct}%: {amount} -> {ledger_outstanding}"
DETAILS_DUPLICATE = "Invoice appears {copies} times in the ERP extract (1 original + {extra} duplicate(s))."
DETAILS_SYNTHETIC_WORK_ORDER = (
    "No real work_order_number was captured for this invoice -- used a synthesized placeholder. "
)
DETAILS_REFERENCE = (
    "ERP references the work order number instead of the invoice number: {number} -> {ledger_number} "
    "(no RO number carried)."
)
DETAILS_CREDIT = (
    "ERP outstanding amount reduced by a {pct}% credit not on the statement: {amount} -> {ledger_outstanding}"
)
DETAILS_PENDING = "Invoice exists on the ERP side but has not finished posting yet."

# --- texts of the quality checks -----------------------------------------------------------
CHECK_ROWS = "{rows} row(s)"
CHECK_EMPTY = "table is empty"
CHECK_NO_SIDE = "no {side} rows found"
CHECK_UNREADABLE = "query failed: table not found"
CHECK_BAD_DATES = ", {bad} with unparsed invoice_date"
CHECK_QUEUE = "{rows} row(s) flagged for review (informational)"
CHECK_AUDIT = "{rows} AI call(s) logged (informational)"
CHECK_MATCHES = ", {bad} missing matched_rule/match_reason"
CHECK_EXCEPTIONS = ", {bad} missing exception_category/deterministic_reason"
CHECK_STATUS = ", {bad} with an unrecognized overall_status"
