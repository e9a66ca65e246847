"""Each registered query once more as plain SQL over the given tables.

The SQL is written from the rules, not from the Spark jobs: ranks are one global window, JSON and
table cells are never built where a rule gives the result, joins and lists are spelled out.
"""

from __future__ import annotations

import re

_H = "CAST('0x' || substr(md5('42|{salt}|' || k), 1, 8) AS BIGINT)"


def _hash(salt: str) -> str:
    return _H.format(salt=salt)


def _cents_text(column: str) -> str:
    return f"(({column}) // 100) || '.' || lpad(CAST(({column}) % 100 AS VARCHAR), 2, '0')"


def _normal(column: str) -> str:
    return rf"regexp_extract({column}, '^(.+?)(?:X\d+|-\d+|R)*$', 1)"


_ITEM = """'{"invoice_date":"' || invoice_date || '","invoice_number":"' || number || '","work_order_number":'
  || coalesce('"' || work_order || '"', 'null') || ',"ro_number":' || coalesce('"' || ro || '"', 'null')
  || ',"outstanding_amount":"' || raw_outstanding || '","due_date":"' || due_date || '"'
  || coalesce(',"confidence":' || conf, '') || '}'"""
_REVIEW_ID = (
    "sha256(concat_ws('|', 'review', vendor_id, source_file, statement_id, period, page_number, {row}, {category}))"
)
_AUDIT_ID = "sha256(concat_ws('|', 'audit', vendor_id, source_file, statement_id, period, page_number))"

_CTES = {
    "line": """
SELECT o_orderkey AS k, o_custkey % 4 AS v, 'V' || (o_custkey % 4) AS vendor_id,
  'Vendor V' || (o_custkey % 4) AS vendor_name, n_name AS shop, CAST(o_orderdate AS DATE) AS d,
  strftime(o_orderdate, '%Y-%m') AS period, 'SIN' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS number,
  CASE WHEN o_orderkey % 31 <> 0 THEN CAST(24000000 + o_orderkey AS VARCHAR) END AS work_order,
  CASE WHEN o_orderkey % 37 <> 0 THEN 'RO-' || o_custkey END AS ro,
  CAST(round(o_totalprice * 100) AS BIGINT) AS cents
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "doc": f"""
SELECT *, vendor_id || '-' || period || '-' || (k // 40000) AS statement_id,
  vendor_id || '-' || period || '-' || (k // 40000) || '.pdf' AS source_file,
  CAST((k % 40000) // 4000 + 1 AS INTEGER) AS page_number, CAST(k % 4000 + 1 AS INTEGER) AS row_number,
  k // 4000 + 5 * v + year(d) * 12 + month(d) AS page_id,
  {_cents_text('cents')} AS amount_text,
  '$' || format('{{:,}}', cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS amount_printed,
  strftime(d, '%m/%d/%Y') AS date_text, strftime(d + 30, '%m/%d/%Y') AS due_text
FROM line""",
    # --- planted labels and the ledger derived from them
    "mix": """
SELECT * FROM (VALUES (1, 'exact_match', 0.72::DOUBLE), (2, 'invoice_revision', 0.05::DOUBLE),
  (3, 'missing_invoice', 0.08::DOUBLE), (4, 'amount_mismatch', 0.05::DOUBLE), (5, 'duplicate_invoice', 0.03::DOUBLE),
  (6, 'vendor_reference_issue', 0.02::DOUBLE), (7, 'missing_credit', 0.01::DOUBLE), (8, 'pending_posting', 0.01::DOUBLE),
  (9, 'ro_missing', 0.01::DOUBLE), (10, 'ro_conflict', 0.01::DOUBLE), (11, 'ledger_only', 0.01::DOUBLE)
) AS t(pos, label, pct)""",
    "target": """
SELECT pos, label, CAST(round_even(pct * n, 0) AS BIGINT) AS rows_wanted, n
FROM mix, (SELECT count(*) AS n FROM line)""",
    "span": """
SELECT label, sum(share) OVER (ORDER BY pos) - share AS lo, sum(share) OVER (ORDER BY pos) AS hi FROM (
  SELECT pos, label, rows_wanted + CASE WHEN pos = (
      SELECT min(pos) FROM target WHERE rows_wanted = (SELECT max(rows_wanted) FROM target))
    THEN n - (SELECT sum(rows_wanted) FROM target) ELSE 0 END AS share FROM target)""",
    "labelled": """
SELECT r.*, s.label FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || k)) - 1 AS rk FROM doc) r
JOIN span s ON r.rk >= s.lo AND r.rk < s.hi""",
    "drawn": f"""
SELECT *, ['-1', 'X1', 'R'][{_hash('suffix')} % 3 + 1] AS suffix,
  CASE WHEN {_hash('direction')} % 2 = 0 THEN 1 ELSE -1 END AS sign,
  50 + {_hash('variance')} % 201 AS variance, 50 + {_hash('credit')} % 101 AS credit_permille,
  CAST(1 + {_hash('lag')} % 5 AS INTEGER) AS lag_days,
  'WO-SYNTH-' || (10000000 + {_hash('work_order')} % 90000000) AS synthetic
FROM labelled""",
    "planned": """
SELECT *,
  CASE label WHEN 'missing_invoice' THEN NULL WHEN 'invoice_revision' THEN number || suffix
    WHEN 'vendor_reference_issue' THEN coalesce(work_order, synthetic) ELSE number END AS ledger_number,
  CASE WHEN label IN ('vendor_reference_issue', 'ro_missing') THEN NULL
    WHEN label = 'ro_conflict' THEN ro || '-Z' ELSE ro END AS ledger_ro,
  CASE label WHEN 'amount_mismatch' THEN cents + sign * (cents * variance // 1000) ELSE cents END AS cents_1,
  CASE label WHEN 'amount_mismatch' THEN cents + sign * (cents * variance // 1000)
    WHEN 'missing_credit' THEN cents - cents * credit_permille // 1000 ELSE cents END AS cents_2,
  CASE label WHEN 'missing_invoice' THEN 0 WHEN 'duplicate_invoice' THEN 2 WHEN 'ledger_only' THEN 2 ELSE 1 END AS copies,
  CASE label WHEN 'pending_posting' THEN 'PENDING' ELSE 'POSTED' END AS status
FROM drawn""",
    "ledger": f"""
SELECT vendor_id, vendor_name, shop, period, 'mock_erp_generator_v1.0' AS source_file,
  'LEDGER-' || statement_id AS statement_id, CAST((k % 40000) * 2 + copy AS INTEGER) AS row_number,
  CASE WHEN label = 'ledger_only' AND copy = 2 THEN 'LED' || ledger_number ELSE ledger_number END AS number,
  date_text, CASE WHEN status = 'POSTED' THEN strftime(d + lag_days, '%m/%d/%Y') END AS posting_text,
  {_cents_text('cents_1')} AS amount_text, {_cents_text('cents_2')} AS outstanding_text,
  cents_1, cents_2, ledger_ro AS ro, status, d,
  CASE WHEN status = 'POSTED' THEN CAST(d + lag_days AS DATE) END AS posting_date
FROM planned JOIN (VALUES (1), (2)) AS c(copy) ON copy <= copies""",
    "manifest_rows": f"""
SELECT sha256(concat_ws('|', 'manifest', vendor_id, period, number, statement_id)) AS manifest_id, vendor_id,
  period AS statement_period, number AS statement_invoice_number, ledger_number AS generated_erp_invoice_number,
  label AS scenario_type,
  CASE WHEN label IN ('exact_match', 'invoice_revision', 'ro_missing', 'ro_conflict', 'ledger_only') THEN 'MATCHED'
    ELSE 'EXCEPTION' END AS expected_match_status,
  CASE WHEN label IN ('exact_match', 'invoice_revision', 'ledger_only') THEN CASE WHEN ro IS NULL THEN 2 ELSE 1 END
    WHEN label = 'ro_missing' THEN 2
    WHEN label = 'ro_conflict' THEN CASE WHEN ro IS NULL THEN 2 ELSE 3 END END AS expected_match_level,
  CASE label WHEN 'missing_invoice' THEN 'Invoice Missing' WHEN 'vendor_reference_issue' THEN 'Invoice Missing'
    WHEN 'amount_mismatch' THEN 'Amount Mismatch' WHEN 'duplicate_invoice' THEN 'Duplicate Invoice'
    WHEN 'missing_credit' THEN 'Missing Credit' WHEN 'pending_posting' THEN 'Pending Posting' END AS expected_exception_reason,
  CASE label
    WHEN 'invoice_revision' THEN 'ERP re-issued the invoice number with suffix ''' || suffix || ''': ' || number || ' -> ' || ledger_number
    WHEN 'missing_invoice' THEN 'Invoice exists on the statement but is entirely absent from the ERP extract.'
    WHEN 'amount_mismatch' THEN 'ERP amount differs from the statement by ' || CASE WHEN sign > 0 THEN '+' ELSE '-' END
      || (variance // 10) || '.' || (variance % 10) || '%: ' || amount_text || ' -> ' || {_cents_text('cents_2')}
    WHEN 'duplicate_invoice' THEN 'Invoice appears 2 times in the ERP extract (1 original + 1 duplicate(s)).'
    WHEN 'vendor_reference_issue' THEN CASE WHEN work_order IS NULL
        THEN 'No real work_order_number was captured for this invoice -- used a synthesized placeholder. ' ELSE '' END
      || 'ERP references the work order number instead of the invoice number: ' || number || ' -> ' || ledger_number
      || ' (no RO number carried).'
    WHEN 'missing_credit' THEN 'ERP outstanding amount reduced by a ' || (credit_permille // 10) || '.' || (credit_permille % 10)
      || '% credit not on the statement: ' || amount_text || ' -> ' || {_cents_text('cents_2')}
    WHEN 'pending_posting' THEN 'Invoice exists on the ERP side but has not finished posting yet.'
    ELSE 'ERP record mirrors the statement exactly.' END AS mutation_details,
  '1.0' AS generator_config_version
FROM planned""",
    # --- Silver
    "silver_s": """
SELECT sha256(concat_ws('|', 'VENDOR_STATEMENT', vendor_id, number, amount_printed, statement_id)) AS record_id,
  'VENDOR_STATEMENT' AS record_source, 'VENDOR_STATEMENT' AS document_type, statement_id,
  DATE '2001-12-31' AS statement_date, vendor_id, vendor_name, shop, number AS invoice_number,
  number AS invoice_number_normalized, d AS invoice_date, ro AS ro_number, work_order AS work_order_number,
  CAST(NULL AS VARCHAR) AS po_number, CAST(cents / 100.0 AS DECIMAL(12,2)) AS amount,
  CAST(NULL AS DECIMAL(12,2)) AS credit, CAST(cents / 100.0 AS DECIMAL(12,2)) AS outstanding_amount,
  CAST(d + 30 AS DATE) AS due_date, CAST(NULL AS DATE) AS posting_date, CAST(NULL AS VARCHAR) AS status,
  CAST(NULL AS VARCHAR) AS description, period AS statement_period, source_file
FROM doc""",
    "silver_l": f"""
SELECT sha256(concat_ws('|', 'INTERNAL_ERP', vendor_id, number, outstanding_text, statement_id, row_number)) AS record_id,
  'INTERNAL_ERP' AS record_source, 'MOCK_ERP_EXTRACT' AS document_type, statement_id,
  DATE '2001-12-31' AS statement_date, vendor_id, vendor_name, shop, number AS invoice_number,
  {_normal('number')} AS invoice_number_normalized, d AS invoice_date, ro AS ro_number,
  CAST(NULL AS VARCHAR) AS work_order_number, 'PO-' || vendor_id || '-' ||
    CASE WHEN row_number < 1000 THEN lpad(CAST(row_number AS VARCHAR), 4, '0') ELSE CAST(row_number AS VARCHAR) END AS po_number,
  CAST(cents_1 / 100.0 AS DECIMAL(12,2)) AS amount,
  CASE WHEN cents_1 > cents_2 THEN CAST((cents_1 - cents_2) / 100.0 AS DECIMAL(12,2)) END AS credit,
  CAST(cents_2 / 100.0 AS DECIMAL(12,2)) AS outstanding_amount, CAST(NULL AS DATE) AS due_date, posting_date, status,
  CAST(NULL AS VARCHAR) AS description, period AS statement_period, source_file
FROM ledger""",
    # --- matching
    "cand": """
SELECT vendor_id, statement_period, invoice_number_normalized, count(*) AS n, count(DISTINCT outstanding_amount) = 1 AS agree,
  min(record_id) AS c_id, min(outstanding_amount) AS c_out, min(amount) AS c_amount, min(ro_number) AS c_ro,
  min(status) AS c_status, min(credit) AS c_credit
FROM silver_l GROUP BY 1, 2, 3""",
    "joined": """
SELECT s.*, coalesce(c.n, 0) AS n, c.agree, c.c_id, c.c_out, c.c_amount, c.c_ro, c.c_status, c.c_credit,
  (SELECT min(l.invoice_number) FROM silver_l l
   WHERE l.vendor_id = s.vendor_id AND l.statement_period = s.statement_period AND l.invoice_number = s.work_order_number) AS wo_match
FROM silver_s s LEFT JOIN cand c USING (vendor_id, statement_period, invoice_number_normalized)""",
    "verdict": """
SELECT *, CASE WHEN n > 1 THEN 'duplicate' WHEN n = 0 THEN 'missing' WHEN c_status IS DISTINCT FROM 'POSTED' THEN 'pending'
  WHEN abs(outstanding_amount::DOUBLE - c_out::DOUBLE) <= 0.01 THEN
    CASE WHEN ro_number IS NULL OR c_ro IS NULL THEN 'level2' WHEN ro_number = c_ro THEN 'level1' ELSE 'level3' END
  WHEN c_credit IS NULL THEN 'mismatch'
  WHEN abs(outstanding_amount::DOUBLE - c_amount::DOUBLE) <= 0.01 THEN 'credit' ELSE 'mismatch_credit' END AS verdict
FROM joined""",
    "decided": """
SELECT *, CASE WHEN verdict LIKE 'level%' THEN 'MATCHED' ELSE 'EXCEPTION' END AS match_status,
  CASE verdict WHEN 'level1' THEN 1 WHEN 'level2' THEN 2 WHEN 'level3' THEN 3 END AS match_level,
  CASE verdict WHEN 'level1' THEN 'LEVEL_1_FULL_MATCH' WHEN 'level2' THEN 'LEVEL_2_AMOUNT_MATCH_RO_MISSING'
    WHEN 'level3' THEN 'LEVEL_3_RO_CONFLICT' END AS matched_rule,
  CASE verdict WHEN 'level1' THEN 'Invoice number (normalized), amount, and RO number all agree.'
    WHEN 'level2' THEN 'Invoice number (normalized) and amount agree; RO number is missing on at least one side.'
    WHEN 'level3' THEN 'Invoice number (normalized) and amount agree; RO numbers differ (''' || ro_number || ''' vs '''
      || c_ro || ''') -- treated as a lower-confidence match, not a failure.' END AS match_reason,
  CASE verdict WHEN 'duplicate' THEN 'Duplicate Invoice' WHEN 'missing' THEN 'Invoice Missing' WHEN 'pending' THEN 'Pending Posting'
    WHEN 'credit' THEN 'Missing Credit' WHEN 'mismatch' THEN 'Amount Mismatch' WHEN 'mismatch_credit' THEN 'Amount Mismatch'
    END AS exception_category,
  CASE verdict
    WHEN 'duplicate' THEN n || ' ERP records share invoice number ''' || invoice_number_normalized || ''' (expected exactly 1); '
      || CASE WHEN agree THEN 'all copies have the same outstanding_amount'
         ELSE 'the copies do NOT all agree on outstanding_amount -- review individually' END || '.'
    WHEN 'missing' THEN 'No ERP record found for invoice ' || coalesce('''' || invoice_number || '''', 'None') || '.' || CASE WHEN wo_match IS NULL THEN '' ELSE
      ' An ERP record with invoice_number=''' || wo_match || ''' matches this statement invoice''s work_order_number ('''
      || work_order_number || ''') -- likely a vendor reference issue (the ERP recorded the work order instead of the invoice '
      || 'number), but this is reported as Invoice Missing since Levels 1-3 cannot confirm it.' END
    WHEN 'pending' THEN 'ERP record for invoice ''' || invoice_number || ''' has status='
      || coalesce('''' || c_status || '''', 'None') || ', not POSTED -- not yet finished posting.'
    WHEN 'credit' THEN 'ERP''s original amount (' || c_amount || ') matches the statement (' || outstanding_amount
      || '), but a credit of ' || c_credit || ' was applied on the ERP side that isn''t on the statement, reducing '
      || 'outstanding_amount to ' || c_out || '.'
    WHEN 'mismatch' THEN 'Statement outstanding_amount (' || outstanding_amount || ') does not match ERP outstanding_amount ('
      || c_out || ').'
    WHEN 'mismatch_credit' THEN 'Statement outstanding_amount (' || outstanding_amount || ') does not match ERP '
      || 'outstanding_amount (' || c_out || '); a credit of ' || c_credit || ' is also present on the ERP side but does not '
      || 'fully explain the discrepancy.' END AS deterministic_reason,
  CASE WHEN verdict NOT IN ('duplicate', 'missing') THEN c_id END AS reference_record_id
FROM verdict""",
    "orphan": """
SELECT l.* FROM silver_l l
WHERE NOT EXISTS (SELECT 1 FROM silver_s s WHERE s.vendor_id = l.vendor_id AND s.statement_period = l.statement_period
    AND s.invoice_number_normalized = l.invoice_number_normalized)
  AND NOT EXISTS (SELECT 1 FROM silver_s s WHERE s.vendor_id = l.vendor_id AND s.statement_period = l.statement_period
    AND s.work_order_number = l.invoice_number)""",
    "matched_out": """
SELECT sha256(concat_ws('|', 'match', vendor_id, statement_period, record_id)) AS match_id, vendor_id, shop, invoice_number,
  ro_number, outstanding_amount AS amount, match_level, matched_rule, match_reason, match_status,
  record_id AS statement_record_id, reference_record_id, source_file, statement_id, statement_period
FROM decided WHERE match_status = 'MATCHED'""",
    "exception_out": """
SELECT sha256(concat_ws('|', 'exception', vendor_id, statement_period, record_id)) AS exception_id, vendor_id, shop,
  invoice_number, ro_number, outstanding_amount AS amount, match_status, exception_category, deterministic_reason,
  reference_record_id, 'Open' AS exception_status, record_id AS statement_record_id, source_file, statement_id, statement_period
FROM decided WHERE match_status = 'EXCEPTION'
UNION ALL
SELECT sha256(concat_ws('|', 'orphan', vendor_id, statement_period, record_id)), vendor_id, shop, invoice_number, ro_number,
  outstanding_amount, 'EXCEPTION', 'Unmatched Record',
  'ERP record for invoice ' || invoice_number || ' has no corresponding Vendor Statement invoice.',
  record_id, 'Open', NULL, source_file, statement_id, statement_period
FROM orphan""",
    "shops": """
SELECT s.vendor_id, s.vendor_name, s.statement_period, s.shop, s.total_invoice_count,
  coalesce(m.matched_count, 0) AS matched_count, coalesce(e.exception_count, 0) AS exception_count, s.statement_total,
  coalesce(l.internal_erp_total, CAST(0 AS DECIMAL(14,2))) AS internal_erp_total
FROM (SELECT vendor_id, vendor_name, statement_period, shop, count(*) AS total_invoice_count,
    CAST(sum(outstanding_amount) AS DECIMAL(14,2)) AS statement_total FROM silver_s GROUP BY ALL) s
LEFT JOIN (SELECT vendor_id, statement_period, shop, count(*) AS matched_count FROM matched_out GROUP BY ALL) m
  USING (vendor_id, statement_period, shop)
LEFT JOIN (SELECT vendor_id, statement_period, shop, count(*) AS exception_count FROM exception_out GROUP BY ALL) e
  USING (vendor_id, statement_period, shop)
LEFT JOIN (SELECT vendor_id, statement_period, shop, CAST(sum(outstanding_amount) AS DECIMAL(14,2)) AS internal_erp_total
    FROM silver_l GROUP BY ALL) l USING (vendor_id, statement_period, shop)""",
    "recon": """
SELECT vendor_id, vendor_name, shop, statement_period, statement_total, internal_erp_total,
  CAST(statement_total - internal_erp_total AS DECIMAL(14,2)) AS difference, total_invoice_count, matched_count,
  exception_count, CAST(round(matched_count / total_invoice_count * 100, 2) AS DECIMAL(5,2)) AS match_pct,
  CASE WHEN exception_count > 0 THEN 'EXCEPTIONS_PRESENT'
    WHEN statement_total <> 0 AND abs((statement_total - internal_erp_total)::DOUBLE) / statement_total::DOUBLE > 0.01
      THEN 'MINOR_VARIANCE' ELSE 'RECONCILED' END AS overall_status
FROM shops""",
    "vendors": """
SELECT vendor_id, vendor_name, statement_period, CAST(sum(total_invoice_count) AS BIGINT) AS total_invoices,
  CAST(sum(matched_count) AS BIGINT) AS matched_count, CAST(sum(exception_count) AS BIGINT) AS exception_count,
  CAST(sum(statement_total) AS DECIMAL(14,2)) AS total_outstanding_amount,
  CAST(round(sum(matched_count) / sum(total_invoice_count) * 100, 2) AS DECIMAL(5,2)) AS match_pct
FROM shops GROUP BY vendor_id, vendor_name, statement_period""",
    "graded": """
SELECT m.vendor_id, m.statement_period, m.statement_invoice_number, scenario_type, expected_match_status,
  d.match_status AS actual_match_status, expected_match_level, d.match_level AS actual_match_level,
  expected_exception_reason, d.exception_category AS actual_exception_category,
  coalesce(expected_match_status = d.match_status AND CASE WHEN expected_match_status = 'MATCHED'
    THEN expected_match_level = d.match_level ELSE expected_exception_reason = d.exception_category END, false) AS graded_correct
FROM manifest_rows m LEFT JOIN decided d
  ON d.vendor_id = m.vendor_id AND d.statement_period = m.statement_period AND d.invoice_number = m.statement_invoice_number""",
    # --- pages and what is read from them
    "page": """
SELECT vendor_id, source_file, statement_id, period, page_number, page_id, page_id % 20 AS fault,
  CASE WHEN bool_or(page_number = 1) OVER (PARTITION BY statement_id) AND substr(period, 6) <> '11'
    THEN 'Body Shop ' || statement_id END AS shop
FROM (SELECT DISTINCT vendor_id, source_file, statement_id, period, page_number, page_id FROM doc)""",
    "page_error": """
SELECT *, CASE WHEN fault = 7 THEN ['HTTP 503 on attempt 4: busy', 'Transport error on attempt 4: timed out',
    'Missing API key: set environment variable EXTRACTOR_KEY', 'Response was not valid JSON: line 1',
    'Unexpected response shape: no candidates', ''][page_id // 20 % 6 + 1] END AS error,
  CASE WHEN fault = 7 THEN ['HTTP_ERROR', 'TRANSPORT_ERROR', 'MISSING_API_KEY', 'PARSE_ERROR', 'PARSE_ERROR',
    'UNKNOWN_ERROR'][page_id // 20 % 6 + 1] ELSE 'SUCCESS' END AS response_status,
  CASE fault WHEN 11 THEN 'Expected a JSON object shaped like {''invoices'': [...]}, got: dict'
    WHEN 3 THEN 'Expected a JSON object shaped like {''invoices'': [...]}, got: list' END AS contract_error
FROM page""",
    "printed": """
SELECT d.*, again, CASE WHEN k % 41 = 0 THEN '' ELSE date_text END AS invoice_date,
  CASE WHEN k % 43 = 0 THEN 'N/A' ELSE amount_text END || CASE WHEN again THEN '0' ELSE '' END AS raw_outstanding,
  CASE WHEN k % 43 = 0 THEN 'N/A' || CASE WHEN again THEN '0' ELSE '' END ELSE amount_text END AS amount,
  CASE WHEN k % 47 = 0 THEN 'soon' ELSE due_text END AS due_date,
  CASE WHEN k % 59 = 0 THEN NULL WHEN k % 53 = 0 THEN '0.5' ELSE '0.' || (801 + (k * 7919) % 20 * 10) END AS conf
FROM doc d JOIN (VALUES (false), (true)) AS t(again) ON NOT again OR k % 61 = 0""",
    "item": f"""
SELECT p.* EXCLUDE (shop, row_number), g.shop, g.fault, {_ITEM} AS item,
  CAST(row_number() OVER (PARTITION BY statement_id, page_number ORDER BY k, again) AS INTEGER) AS row_number,
  concat_ws(', ', CASE WHEN invoice_date = '' THEN 'invoice_date' END, CASE WHEN g.shop IS NULL THEN 'shop' END) AS missing
FROM printed p JOIN page g USING (statement_id, page_number) WHERE g.fault NOT IN (3, 7, 11, 13)""".replace(
        "p.* EXCLUDE (shop, row_number)",
        "p.k, p.again, p.vendor_id, p.source_file, p.statement_id, p.period, p.page_number, p.number, p.work_order, p.ro, "
        "p.invoice_date, p.raw_outstanding, p.amount, p.due_date, p.conf",
    ),
    "checked": """
SELECT *, CASE WHEN missing <> '' THEN 'MISSING_MANDATORY_FIELD' WHEN k % 43 = 0 OR due_date = 'soon' THEN 'INVALID_FIELD_TYPE'
    WHEN CAST(conf AS DOUBLE) < 0.75 THEN 'LOW_CONFIDENCE' END AS rejection_category,
  CASE WHEN missing <> '' THEN 'Missing required field(s): ' || missing
    WHEN k % 43 = 0 THEN 'Field ''amount'' is not numeric: ''' || amount || ''''
    WHEN due_date = 'soon' THEN 'Field ''due_date'' does not look like a date: ''soon'''
    WHEN CAST(conf AS DOUBLE) < 0.75 THEN 'extraction_confidence 0.5 is below threshold 0.75' END AS rejection_details
FROM item""",
    "cell": """
SELECT d.*, g.shop AS page_shop, CAST(CASE WHEN page_number = 1 THEN 1 ELSE 0 END + 1 + coalesce(
    sum(CASE WHEN k % 10 IN (3, 7) THEN 2 ELSE 1 END) OVER (PARTITION BY statement_id, page_number ORDER BY k
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS cell_row
FROM doc d JOIN page g USING (statement_id, page_number)""".replace(
        "d.*",
        "d.k, d.vendor_id, d.source_file, d.statement_id, d.period, d.page_number, d.number, d.work_order, d.ro, d.date_text, "
        "d.due_text, d.amount_printed",
    ),
    "candidate": """
SELECT vendor_id, source_file, statement_id, period, page_number, row_number, number, invoice_date, work_order, ro, amount,
  amount AS outstanding, due_date, shop, conf, false AS is_fallback FROM checked WHERE rejection_category IS NULL
UNION ALL
SELECT vendor_id, source_file, statement_id, period, page_number, cell_row, number, date_text, work_order, ro, amount_printed,
  amount_printed, due_text, page_shop, NULL, true
FROM cell c WHERE NOT EXISTS (SELECT 1 FROM checked v WHERE v.rejection_category IS NULL
  AND v.statement_id = c.statement_id AND v.page_number = c.page_number)""",
    "placed": """
SELECT *, row_number() OVER (PARTITION BY statement_id, vendor_id, number, amount ORDER BY page_number, row_number) > 1
  AS is_duplicate FROM candidate""",
    "body": f"""
SELECT statement_id, page_number, CASE fault WHEN 7 THEN NULL WHEN 11 THEN '{{"rows":[]}}' WHEN 13 THEN '{{"invoices":[]}}'
    WHEN 3 THEN '[1]' ELSE '{{"invoices":[' || CASE WHEN fault = 17 THEN '"note",7,' ELSE '' END || items || ']}}' END AS text
FROM page JOIN (SELECT statement_id, page_number, string_agg({_ITEM}, ',' ORDER BY k, again) AS items
  FROM printed GROUP BY ALL) USING (statement_id, page_number)""",
    "rejects": f"""
SELECT {_REVIEW_ID.format(row='row_number', category='rejection_category')} AS review_id, vendor_id, source_file, statement_id,
  period AS statement_period, 'AI_EXTRACTION' AS pipeline_stage, rejection_category, rejection_details,
  CASE WHEN rejection_category = 'LOW_CONFIDENCE' THEN CAST(0.5 AS DECIMAL(5,4)) END AS extraction_confidence,
  CASE WHEN rejection_category = 'LOW_CONFIDENCE' THEN CAST(0.75 AS DECIMAL(5,4)) END AS confidence_threshold_applied,
  item AS raw_payload, {_AUDIT_ID} AS ai_audit_id
FROM checked WHERE rejection_category IS NOT NULL""",
    "broken": f"""
SELECT {_REVIEW_ID.format(row="'~'", category="CASE WHEN fault = 7 THEN 'AI_CALL_FAILED' ELSE 'MALFORMED_JSON' END")} AS review_id,
  vendor_id, source_file, statement_id, period AS statement_period, 'AI_EXTRACTION' AS pipeline_stage,
  CASE WHEN fault = 7 THEN 'AI_CALL_FAILED' ELSE 'MALFORMED_JSON' END AS rejection_category,
  'Page ' || page_number || ': ' || coalesce(error, contract_error) AS rejection_details,
  CAST(NULL AS DECIMAL(5,4)) AS extraction_confidence, CAST(NULL AS DECIMAL(5,4)) AS confidence_threshold_applied,
  CASE fault WHEN 7 THEN error WHEN 11 THEN '{{"rows":[]}}' ELSE '[1]' END AS raw_payload, {_AUDIT_ID} AS ai_audit_id
FROM page_error WHERE fault IN (3, 7, 11)""",
    "doubles": f"""
SELECT {_REVIEW_ID.format(row='row_number', category="'DUPLICATE_RECORD'")} AS review_id, vendor_id, source_file, statement_id,
  period AS statement_period, 'VALIDATION' AS pipeline_stage, 'DUPLICATE_RECORD' AS rejection_category,
  'Duplicate on [''vendor'', ''invoice_number'', ''amount'']: [''' || vendor_id || ''', ''' || number || ''', ''' || amount
    || ''']' AS rejection_details,
  CAST(NULL AS DECIMAL(5,4)) AS extraction_confidence, CAST(NULL AS DECIMAL(5,4)) AS confidence_threshold_applied,
  '{{"invoice_date":"' || invoice_date || '","invoice_number":"' || number || '","work_order_number":'
    || coalesce('"' || work_order || '"', 'null') || ',"ro_number":' || coalesce('"' || ro || '"', 'null')
    || ',"outstanding_amount":"' || outstanding || '","due_date":"' || due_date || '","vendor":"' || vendor_id || '","shop":'
    || coalesce('"' || shop || '"', 'null') || ',"amount":"' || amount || '","page_number":' || page_number
    || ',"row_number":' || row_number || '}}' AS raw_payload, CAST(NULL AS VARCHAR) AS ai_audit_id
FROM placed WHERE is_duplicate""",
    "audit": f"""
SELECT {_AUDIT_ID} AS audit_id, source_file, vendor_id, statement_id, 'EXTRACTION' AS interaction_type,
  'extractor' AS ai_provider, 'extractor-1' AS model, 'extraction_v1' AS prompt_version,
  CAST(100 + page_id % 900 AS DOUBLE) AS latency_ms, CAST(CASE WHEN fault = 7 THEN 4 ELSE 1 END AS INTEGER) AS attempt_count,
  fault <> 7 AS success, response_status, error AS error_message,
  CAST((20 * milli + rated) // (2 * rated) / 10000.0 AS DECIMAL(5,4)) AS extraction_confidence,
  CASE WHEN fault = 7 THEN 'AI_CALL_FAILED' WHEN contract_error IS NOT NULL THEN 'MALFORMED_JSON'
    ELSE coalesce(valid, 0) || '/' || coalesce(total, 0) || ' valid' END AS validation_result
FROM page_error LEFT JOIN (
  SELECT statement_id, page_number, count(*) AS total, count(*) FILTER (rejection_category IS NULL) AS valid, count(conf) AS rated,
    CAST(sum(CAST(CAST(conf AS DECIMAL(5,3)) * 1000 AS BIGINT)) AS BIGINT) AS milli
  FROM checked GROUP BY ALL) USING (statement_id, page_number)""",
    # --- quality
    "control": """
SELECT 'VENDOR_STATEMENT' AS side, count(*) AS bronze_rows, CAST(sum(cents) / 100 AS DECIMAL(18,2)) AS bronze_total,
  count(*) AS silver_rows, CAST((SELECT sum(outstanding_amount) FROM silver_s) AS DECIMAL(18,2)) AS silver_total,
  CAST(0 AS BIGINT) AS null_dates, CAST(0 AS BIGINT) AS null_amounts, count(*) AS posted_without_date,
  CAST(0 AS BIGINT) AS pending_with_date FROM doc
UNION ALL
SELECT 'INTERNAL_ERP', count(*), CAST(sum(cents_2) / 100 AS DECIMAL(18,2)), count(*),
  CAST((SELECT sum(outstanding_amount) FROM silver_l) AS DECIMAL(18,2)), 0, 0,
  count(*) FILTER (posting_date IS NULL AND status <> 'PENDING'), count(*) FILTER (posting_date IS NOT NULL AND status = 'PENDING')
FROM ledger""",
    "table_rows": """
SELECT 'bronze_vendor_statement_raw' AS table_name, count(*) AS row_count FROM doc
UNION ALL SELECT 'bronze_internal_erp_raw', count(*) FROM ledger
UNION ALL SELECT 'silver_reconciliation_standard', (SELECT count(*) FROM doc) + (SELECT count(*) FROM ledger)
UNION ALL SELECT 'validation_mutation_manifest', count(*) FROM planned
UNION ALL SELECT 'validation_document_review_queue',
  (SELECT count(*) FROM rejects) + (SELECT count(*) FROM broken) + (SELECT count(*) FROM doubles)
UNION ALL SELECT 'ai_audit_log', count(*) FROM audit
UNION ALL SELECT 'gold_matched_invoices', count(*) FROM matched_out
UNION ALL SELECT 'gold_exceptions', count(*) FROM exception_out
UNION ALL SELECT 'gold_vendor_summary', count(*) FROM vendors
UNION ALL SELECT 'gold_shop_summary', count(*) FROM recon
UNION ALL SELECT 'gold_reconciliation_summary', count(*) FROM recon""",
}


def _check(position: int, name: str, relation: str, fault: str = "false", fault_text: str = "", shown: str = "row(s)", empty: str | None = "table is empty") -> str:
    is_empty = "false" if empty is None else "n = 0"
    return (
        f"SELECT {position} AS position, '{name}' AS name, bad = 0 AND NOT ({is_empty}) AS passed, "
        f"CASE WHEN {is_empty} THEN '{empty}' ELSE n || ' {shown}' || CASE WHEN bad > 0 THEN ', ' || bad || ' {fault_text}' "
        f"ELSE '' END END AS details, n AS row_count FROM (SELECT count(*) AS n, count(*) FILTER ({fault}) AS bad FROM {relation})"
    )


_CHECKS = "\nUNION ALL ".join(
    [
        _check(1, "Bronze Vendor Statement", "doc"),
        _check(2, "Silver Vendor Statement", "silver_s", "invoice_date IS NULL", "with unparsed invoice_date"),
        _check(3, "Bronze Internal ERP", "ledger"),
        _check(4, "Silver Internal ERP", "silver_l", "invoice_date IS NULL", "with unparsed invoice_date"),
        _check(
            5, "Review Queue",
            "(SELECT review_id FROM rejects UNION ALL SELECT review_id FROM broken UNION ALL SELECT review_id FROM doubles)",
            shown="row(s) flagged for review (informational)", empty=None,
        ),
        _check(6, "AI Audit Log", "audit", shown="AI call(s) logged (informational)", empty=None),
        _check(7, "Mutation Manifest", "manifest_rows"),
        _check(8, "Gold Matched Invoices", "matched_out", "matched_rule IS NULL OR match_reason IS NULL", "missing"),
        _check(9, "Gold Exceptions", "exception_out", "exception_category IS NULL OR deterministic_reason IS NULL", "missing"),
        _check(10, "Gold Vendor Summary", "vendors"),
        _check(11, "Gold Shop Summary", "recon"),
        _check(
            12, "Gold Reconciliation Summary", "recon",
            "overall_status IS NULL OR overall_status NOT IN ('RECONCILED', 'MINOR_VARIANCE', 'EXCEPTIONS_PRESENT')", "unrecognized",
        ),
    ]
)

def _unreadable(position: int, name: str) -> str:
    return (
        f"SELECT {position} AS position, '{name}' AS name, false AS passed, 'query failed: table not found' AS details, "
        "CAST(NULL AS BIGINT) AS row_count"
    )


_FAILING = "\nUNION ALL ".join(
    [
        _check(1, "Bronze Vendor Statement", "doc WHERE false"),
        _check(2, "Silver Vendor Statement", "silver_s", "invoice_number LIKE '%7'", "with unparsed invoice_date"),
        _unreadable(3, "Bronze Internal ERP"),
        _check(4, "Silver Internal ERP", "silver_s WHERE false", empty="no INTERNAL_ERP rows found"),
        _unreadable(5, "Review Queue"),
        _unreadable(6, "AI Audit Log"),
        _check(7, "Mutation Manifest", "manifest_rows WHERE false"),
        _check(8, "Gold Matched Invoices", "matched_out", "invoice_number LIKE '%7'", "missing matched_rule/match_reason"),
        _check(
            9, "Gold Exceptions", "exception_out", "invoice_number LIKE '%7'",
            "missing exception_category/deterministic_reason",
        ),
        _check(10, "Gold Vendor Summary", "vendors WHERE false"),
        _unreadable(11, "Gold Shop Summary"),
        _check(12, "Gold Reconciliation Summary", "recon", "shop LIKE '%A'", "with an unrecognized overall_status"),
    ]
)

_PARITY_TESTS = {
    "rows present": "bronze_rows > 0",
    "row count kept": "bronze_rows = silver_rows",
    "total kept": "bronze_total = silver_total",
    "dates parsed": "null_dates = 0",
    "amounts parsed": "null_amounts = 0",
    "posted rows have a posting date": "posted_without_date = 0",
    "pending rows have no posting date": "pending_with_date = 0",
}
_PARITY = "\nUNION ALL ".join(
    [
        f"SELECT side, '{name}' AS test, {test} AS passed FROM control"
        + (" WHERE side = 'INTERNAL_ERP'" if "posting date" in name else "")
        for name, test in _PARITY_TESTS.items()
    ]
    + [
        "SELECT 'GENERATOR', 'ledger rows as planned', (SELECT count(*) FROM ledger) = (SELECT sum(copies) FROM planned)",
        "SELECT 'GENERATOR', 'one manifest row per statement row', (SELECT count(*) FROM manifest_rows) = (SELECT count(*) FROM doc)",
    ]
)

_BRONZE_LEDGER = """SELECT vendor_id, source_file, statement_id, period AS statement_period{page}, row_number,
  vendor_name AS raw_vendor, number AS raw_invoice_number, date_text AS raw_invoice_date, posting_text AS raw_posting_date,
  amount_text AS raw_amount, outstanding_text AS raw_outstanding_amount, ro AS raw_ro_number,
  'PO-' || vendor_id || '-' || CASE WHEN row_number < 1000 THEN lpad(CAST(row_number AS VARCHAR), 4, '0')
    ELSE CAST(row_number AS VARCHAR) END AS raw_po_number, shop AS raw_shop, status AS raw_status FROM ledger"""

_QUERIES = {
    "scan_scope": """SELECT vendor_id, statement_period, invoice_number, shop, outstanding_amount FROM silver_s
WHERE vendor_id = 'V1' AND statement_period = '1997-05'""",
    "scan_scopes": """SELECT vendor_id, statement_period, invoice_number, shop, outstanding_amount FROM silver_s
WHERE EXISTS (SELECT 1 FROM line WHERE line.cents > 49900000 AND line.vendor_id = silver_s.vendor_id AND line.period = silver_s.statement_period)""",
    "replaced_scopes": """SELECT vendor_id, statement_period, invoice_number, shop, CAST(CASE WHEN substr(statement_period, 6) = '05'
  THEN outstanding_amount * 2 ELSE outstanding_amount END AS DECIMAL(12,2)) AS outstanding_amount
FROM silver_s WHERE substr(statement_period, 6) <> '12'""",
    "conform_schema": _BRONZE_LEDGER.format(page=", CAST(NULL AS INTEGER) AS page_number"),
    "scoped_replace": """SELECT statement_id, invoice_number, CAST(CASE WHEN substr(statement_period, 6) = '05'
  THEN outstanding_amount * 2 ELSE outstanding_amount END AS DECIMAL(12,2)) AS outstanding_amount
FROM silver_s WHERE substr(statement_period, 6) <> '12'""",
    "table_counts": "SELECT table_name, row_count FROM table_rows",
    "cells_to_records": """SELECT statement_id, page_number, cell_row AS row_number, date_text AS invoice_date,
  number AS invoice_number, work_order AS work_order_number, ro AS ro_number, amount_printed AS outstanding_amount,
  due_text AS due_date, page_shop AS shop FROM cell""",
    "header_shop": "SELECT statement_id, page_number, shop FROM page",
    "voucher_lines": """SELECT statement_id, page_number, CAST(row_number() OVER (PARTITION BY statement_id, page_number
    ORDER BY k, kind) AS INTEGER) AS row_number, date_text AS raw_transaction_date,
  date_text || CASE WHEN kind = 0 THEN ' Bill #' || number || ' ' || substr(amount_printed, 2) || ' ' || amount_text || ' '
    || amount_text ELSE ' Bill Credit #' || number || ' -' || amount_text END AS raw_description,
  CASE WHEN kind = 0 THEN amount_text END AS raw_amount_due,
  CASE WHEN kind = 0 THEN amount_text ELSE '-' || amount_text END AS raw_applied_amount
FROM doc JOIN (VALUES (0), (1)) AS t(kind) ON kind = 0 OR k % 29 = 0""",
    "page_fallback": """SELECT statement_id, page_number, row_number, number AS invoice_number, amount,
  outstanding AS outstanding_amount, is_fallback FROM candidate""",
    "parse_responses": """SELECT statement_id, page_number, CASE WHEN fault IN (3, 7, 11) THEN NULL ELSE coalesce(n, 0) END
  AS item_count, contract_error FROM page_error LEFT JOIN (SELECT statement_id, page_number, count(*) AS n FROM item GROUP BY ALL)
  USING (statement_id, page_number)""",
    "quoted_objects": """SELECT statement_id, page_number, CASE WHEN fault IN (3, 7, 11) THEN NULL ELSE coalesce(n, 0) END
  AS item_count, contract_error FROM page_error LEFT JOIN (SELECT statement_id, page_number, count(*) AS n FROM item GROUP BY ALL)
  USING (statement_id, page_number)""",
    "standardize": """SELECT statement_id, page_number, row_number, vendor_id AS vendor, shop, number AS invoice_number, amount,
  amount AS outstanding_amount, conf AS confidence FROM checked""",
    "validate_records": """SELECT statement_id, page_number, row_number, rejection_category, rejection_details,
  CASE WHEN rejection_category IS NULL OR rejection_category = 'LOW_CONFIDENCE' THEN CAST(conf AS DOUBLE) END AS checked_confidence,
  CASE WHEN rejection_category IS NULL OR rejection_category = 'LOW_CONFIDENCE' THEN CAST(0.75 AS DOUBLE) END AS threshold_applied
FROM checked""",
    "accept_reject": """SELECT statement_id, CAST(coalesce(sum(a), 0) AS BIGINT) AS accepted,
  CAST(coalesce(sum(r), 0) AS BIGINT) AS rejected, count(*) FILTER (fault IN (3, 7, 11)) AS broken_pages
FROM page LEFT JOIN (SELECT statement_id, page_number, count(*) FILTER (rejection_category IS NULL) AS a,
    count(*) FILTER (rejection_category IS NOT NULL) AS r FROM checked GROUP BY ALL) USING (statement_id, page_number)
GROUP BY statement_id""",
    "redelivered_pages": """SELECT statement_id, page_number, CAST(0 AS BIGINT) AS delivery, row_number, number AS invoice_number, is_duplicate
FROM placed
UNION ALL SELECT statement_id, page_number, 1, row_number, number, true FROM placed JOIN page USING (statement_id, page_number)
WHERE page_id % 5 = 0""",
    "dedup_first": "SELECT statement_id, page_number, row_number, number AS invoice_number, is_duplicate FROM placed",
    "bronze_rows": """SELECT vendor_id, source_file, statement_id, period AS statement_period, page_number, row_number,
  invoice_date AS raw_invoice_date, number AS raw_invoice_number, work_order AS raw_work_order_number, ro AS raw_ro_number,
  outstanding AS raw_outstanding_amount, due_date AS raw_due_date, shop AS raw_shop_name,
  CAST(conf AS DECIMAL(5,4)) AS extraction_confidence, CASE WHEN NOT is_fallback THEN 'extractor-1' END AS extraction_model,
  CAST(NULL AS VARCHAR) AS document_section, CAST(NULL AS VARCHAR) AS bounding_box,
  CASE WHEN NOT is_fallback THEN md5(text) END AS raw_gemini_response
FROM placed JOIN body USING (statement_id, page_number) WHERE NOT is_duplicate""",
    "review_queue": """SELECT *, 'PENDING_REVIEW' AS review_status, CAST(NULL AS VARCHAR) AS reviewed_by,
  CAST(NULL AS VARCHAR) AS resolution_notes
FROM (SELECT * FROM rejects UNION ALL SELECT * FROM broken UNION ALL SELECT * FROM doubles)""",
    "page_audit": "SELECT * FROM audit",
    "error_buckets": "SELECT statement_id, page_number, response_status FROM page_error",
    "pattern_flags": r"""SELECT statement_id, count(*) AS records,
  count(*) FILTER (NOT regexp_matches(number, '(?i)^SIN\d+$')) AS malformed FROM ledger GROUP BY statement_id""",
    "statement_pattern_flags": """SELECT statement_id, count(*) AS records, count(*) FILTER (k % 67 = 0) AS malformed
FROM doc GROUP BY statement_id""",
    "statement_pattern_sample": """SELECT '#' || number AS raw_invoice_number FROM doc WHERE k % 67 = 0 ORDER BY k LIMIT 5""",
    "normalize_number": """SELECT k, CASE k % 10 WHEN 0 THEN number WHEN 1 THEN number || '-1' WHEN 2 THEN number || 'X12'
    WHEN 3 THEN number || 'R' WHEN 4 THEN number || '-1R' WHEN 5 THEN '  ' || number || 'X1-2R ' WHEN 6 THEN 'X' || k
    WHEN 7 THEN '' WHEN 8 THEN number || '-1-2-3-4-5-6-7-8' END AS raw_number,
  CASE WHEN k % 10 = 6 THEN 'X' || k WHEN k % 10 = 7 THEN '' WHEN k % 10 < 9 THEN number END AS normalized FROM line""",
    # V0 strips '-n' only, V1 'Xn' and 'R', V2 and V3 nothing.
    "normalize_by_vendor": """SELECT k, vendor_id, CASE k % 5 WHEN 0 THEN number WHEN 1 THEN number || '-1-2-3-4-5-6-7'
    WHEN 2 THEN number || 'X12R' WHEN 3 THEN number || 'RX1-2' END AS raw_number,
  CASE k % 5 WHEN 0 THEN number WHEN 1 THEN number || CASE v WHEN 0 THEN '' ELSE '-1-2-3-4-5-6-7' END
    WHEN 2 THEN number || CASE v WHEN 1 THEN '' ELSE 'X12R' END
    WHEN 3 THEN number || CASE v WHEN 0 THEN 'RX1' ELSE 'RX1-2' END END AS normalized FROM line""",
    "parse_money": """SELECT k, CASE k % 8 WHEN 0 THEN amount_printed WHEN 1 THEN amount_text
    WHEN 2 THEN '(' || amount_printed || ')' WHEN 3 THEN '-' || amount_text WHEN 4 THEN '1-' || k WHEN 5 THEN 'N/A'
    WHEN 6 THEN 'USD ' || amount_text END AS raw_amount,
  CASE WHEN k % 8 IN (0, 1, 2, 6) THEN CAST(cents / 100.0 AS DECIMAL(12,2)) WHEN k % 8 = 3
    THEN CAST(-cents / 100.0 AS DECIMAL(12,2)) END AS amount FROM doc""",
    "parse_dates": """SELECT k, CASE k % 6 WHEN 0 THEN date_text WHEN 1 THEN due_text WHEN 2 THEN CAST(d AS VARCHAR)
    WHEN 3 THEN '13/45/2026' WHEN 4 THEN 'soon' END AS raw_date, parsed, strftime(parsed, '%Y-%m') AS period,
  strftime(parsed, '%m/%d/%Y') AS shown, CASE WHEN k % 6 < 4 THEN true WHEN k % 6 = 4 THEN false END AS date_like
FROM (SELECT *, CASE k % 6 WHEN 0 THEN d WHEN 1 THEN CAST(d + 30 AS DATE) END AS parsed FROM doc)""",
    "record_ids": """SELECT invoice_number AS raw_invoice_number, statement_id, record_id FROM silver_s
UNION ALL SELECT invoice_number, statement_id, record_id FROM silver_l""",
    "amount_equal": """SELECT k, a, b, coalesce(abs(a::DOUBLE - b::DOUBLE) <= 0.01, false) AS is_equal FROM (
  SELECT k, CAST(cents / 100.0 AS DECIMAL(12,2)) AS a,
    CASE WHEN k % 7 <> 6 THEN CAST((cents + k % 7 - 3) / 100.0 AS DECIMAL(12,2)) END AS b FROM line)""",
    "silver_statement": "SELECT * FROM silver_s",
    "silver_ledger": "SELECT * FROM silver_l",
    "ordered_rows": "SELECT invoice_number, ro_number, record_id FROM silver_l ORDER BY ALL",
    "sample_revised": """SELECT invoice_number, invoice_number_normalized FROM silver_l
WHERE invoice_number <> invoice_number_normalized ORDER BY invoice_number LIMIT 3""",
    "distinct_keys": "SELECT DISTINCT vendor_id, statement_id FROM silver_l",
    "control_totals": "SELECT * FROM control",
    "candidate_groups": """SELECT vendor_id, invoice_number_normalized, n AS candidate_count, agree AS copies_agree,
  CASE WHEN n = 1 THEN c_id END AS only_record_id, CASE WHEN n = 1 THEN c_credit END AS only_credit FROM cand""",
    "candidate_join": """SELECT record_id, n AS candidate_count, CASE WHEN n = 1 THEN c_id END AS only_record_id FROM joined""",
    "work_order_lookup": "SELECT record_id, work_order_number, wo_match AS work_order_match FROM joined",
    "classify": """SELECT record_id, invoice_number, match_status, match_level, matched_rule, match_reason, exception_category,
  deterministic_reason, reference_record_id FROM decided""",
    "orphans": "SELECT record_id, vendor_id, invoice_number FROM orphan",
    "classify_colocated": """SELECT record_id, invoice_number, match_status, match_level, matched_rule, match_reason, exception_category,
  deterministic_reason, reference_record_id FROM decided""",
    "orphans_colocated": "SELECT record_id, vendor_id, invoice_number FROM orphan",
    "gold_matched": "SELECT * FROM matched_out",
    "gold_exceptions": "SELECT * FROM exception_out",
    "shop_aggregates": "SELECT * FROM shops",
    "recon_summary": "SELECT * FROM recon",
    "shop_summary": """SELECT shop, vendor_id, statement_period, total_invoice_count AS total_invoices, matched_count,
  exception_count, match_pct FROM recon""",
    "vendor_summary": "SELECT * FROM vendors",
    "proportional_split": "SELECT number AS invoice_number, rk AS split_rank, label AS scenario_type FROM labelled",
    "perturb_ledger": _BRONZE_LEDGER.format(page=""),
    "manifest": "SELECT * FROM manifest_rows",
    "mix_report": """SELECT t.label AS scenario_type, t.rows_wanted AS target, count(l.k) AS achieved
FROM target t LEFT JOIN labelled l ON l.label = t.label GROUP BY t.label, t.rows_wanted""",
    "grading": "SELECT * FROM graded",
    "grading_mismatches": """SELECT * EXCLUDE (m) REPLACE (
  CASE WHEN m % 89 = 0 THEN expected_match_level + 1 ELSE expected_match_level END AS expected_match_level,
  CASE WHEN m % 89 = 0 THEN NULL ELSE expected_exception_reason END AS expected_exception_reason,
  graded_correct AND m % 89 <> 0 AS graded_correct)
FROM (SELECT *, CAST(substr(statement_invoice_number, 4, 12) AS BIGINT) AS m FROM graded)
WHERE NOT graded_correct OR m % 89 = 0""",
    "grading_breakdown": """SELECT scenario_type, count(*) AS total, count(*) FILTER (graded_correct) AS correct
FROM graded GROUP BY scenario_type""",
    "quality_checks": _CHECKS,
    "failing_checks": _FAILING,
    "rare_classify": """SELECT record_id, invoice_number, match_status, match_level, matched_rule, match_reason, exception_category,
  deterministic_reason, reference_record_id FROM rare_decided""",
    "rare_exceptions": "SELECT * FROM rare_exception_out",
    "rare_summary": "SELECT * FROM rare_recon",
    "pipeline_gold": """SELECT vendor_id, statement_period, shop, invoice_number, amount, match_status, reference_record_id,
  statement_record_id, matched_rule AS outcome, match_reason AS reason FROM paged_matched_out
UNION ALL SELECT vendor_id, statement_period, shop, invoice_number, amount, match_status, reference_record_id,
  statement_record_id, exception_category, deterministic_reason FROM paged_exception_out""",
    "pipeline_intake": """SELECT statement_id, coalesce(parsed, 0) AS parsed, coalesce(accepted, 0) AS accepted,
  coalesce(rejected, 0) AS rejected, coalesce(duplicates, 0) AS duplicates, coalesce(fallback, 0) AS fallback, true AS balanced
FROM (SELECT DISTINCT statement_id FROM page)
LEFT JOIN (SELECT statement_id, count(*) AS parsed, count(*) FILTER (rejection_category IS NOT NULL) AS rejected
  FROM checked GROUP BY ALL) USING (statement_id)
LEFT JOIN (SELECT statement_id, count(*) FILTER (NOT is_fallback AND NOT is_duplicate) AS accepted,
    count(*) FILTER (is_duplicate) AS duplicates, count(*) FILTER (is_fallback AND NOT is_duplicate) AS fallback
  FROM placed GROUP BY ALL) USING (statement_id)""",
    "parity_checks": _PARITY,
}


_SERIAL = "CASE WHEN invoice_number_normalized LIKE 'SIN%' THEN CAST(substr(invoice_number_normalized, 4, 12) AS BIGINT) END AS m"
_CTES["rare_silver_s"] = f"""
SELECT * EXCLUDE (m) REPLACE (CASE WHEN m % 13 = 0 THEN NULL ELSE shop END AS shop,
  CASE WHEN m % 17 = 0 THEN NULL ELSE invoice_number END AS invoice_number,
  CASE WHEN m % 17 = 0 THEN NULL ELSE invoice_number_normalized END AS invoice_number_normalized)
FROM (SELECT *, {_SERIAL} FROM silver_s)"""
_CTES["rare_silver_l"] = f"""
SELECT * EXCLUDE (m) REPLACE (CASE WHEN m % 19 = 0 THEN NULL ELSE status END AS status,
  CAST(outstanding_amount - CASE WHEN m % 23 = 0 THEN 5 ELSE 0 END AS DECIMAL(12,2)) AS outstanding_amount,
  CAST(amount + CASE WHEN m % 23 = 0 THEN 3 ELSE 0 END AS DECIMAL(12,2)) AS amount,
  CAST(CASE WHEN m % 23 = 0 THEN 8 ELSE credit END AS DECIMAL(12,2)) AS credit,
  CASE WHEN m % 43 = 0 THEN 'ELSEWHERE' ELSE shop END AS shop,
  CASE WHEN m % 37 = 0 THEN '1990-01' ELSE statement_period END AS statement_period)
FROM (SELECT *, {_SERIAL} FROM silver_l)
UNION ALL SELECT * EXCLUDE (m) REPLACE (record_id || '+' AS record_id,
  CAST(outstanding_amount + 1 AS DECIMAL(12,2)) AS outstanding_amount)
FROM (SELECT *, {_SERIAL} FROM silver_l) WHERE m % 29 = 0
UNION ALL SELECT * EXCLUDE (m) REPLACE (record_id || '*' AS record_id, '1991-01' AS statement_period)
FROM (SELECT *, {_SERIAL} FROM silver_l) WHERE m % 41 = 0"""
_SILVER_ON = ("silver_s", "silver_l", "cand", "joined", "verdict", "decided", "orphan", "matched_out", "exception_out", "shops", "recon")
for _name in _SILVER_ON[2:]:
    _CTES[f"rare_{_name}"] = re.sub(rf"\b(FROM|JOIN) ({'|'.join(_SILVER_ON)})\b", r"\1 rare_\2", _CTES[_name])

# The run from pages to Gold applies the same rules to what ingestion kept, where other queries take all lines as read.
_CTES["paged_silver_s"] = """
SELECT sha256(concat_ws('|', 'VENDOR_STATEMENT', vendor_id, number, outstanding, statement_id)) AS record_id,
  vendor_id, period AS statement_period, source_file, statement_id, shop, number AS invoice_number,
  number AS invoice_number_normalized, ro AS ro_number, work_order AS work_order_number,
  CAST(replace(replace(outstanding, '$', ''), ',', '') AS DECIMAL(12,2)) AS outstanding_amount
FROM placed WHERE NOT is_duplicate"""
for _name in ("joined", "verdict", "decided", "orphan", "matched_out", "exception_out"):
    _CTES[f"paged_{_name}"] = re.sub(r"\b(FROM|JOIN) (silver_s|joined|verdict|decided|orphan)\b", r"\1 paged_\2", _CTES[_name])


def _needed(text: str) -> list[str]:
    """Names of the shared relations a statement uses, directly or not, in definition order."""
    found: set[str] = set()
    waiting = [text]
    while waiting:
        words = set(re.findall(r"\b(?:FROM|JOIN|,)\s*\(?\s*(\w+)", waiting.pop()))
        for name in words & _CTES.keys() - found:
            found.add(name)
            waiting.append(_CTES[name])
    return [name for name in _CTES if name in found]


def statements() -> dict[str, str]:
    """One self-contained SQL string per registered query."""
    result = {}
    for name, body in _QUERIES.items():
        shared = ",\n".join(f"{cte} AS ({_CTES[cte]})" for cte in _needed(body))
        result[name] = f"WITH {shared}\n{body}"
    return result
