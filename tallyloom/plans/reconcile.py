"""Whole jobs: pages to Bronze, Bronze to Silver, Silver to Gold. Lazy frames in, lazy frames out."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame

from tallyloom.config import Adapter, MatchRules, ValidationRules, VendorRules
from tallyloom.operators import gold, ingest, matching, normalize
from tallyloom.sources import colocated


Keep = Callable[[DataFrame], DataFrame]


def lazily(rows: DataFrame) -> DataFrame:
    return rows


def from_responses(
    pages: DataFrame,
    vendor: VendorRules,
    validation: ValidationRules = ValidationRules(),
    provider: str = "extractor",
    run_at: str | None = None,
    keep: Keep = lazily,
) -> dict[str, DataFrame]:
    """Extraction responses with validation, per-page fallback, de-duplication, review and audit.

    Parsed records feed everything here, `keep` decides whether they are written once."""
    with_shop = ingest.attach_shop(pages, vendor)
    records = keep(ingest.page_records(with_shop, vendor, validation))
    candidates = ingest.candidate_records(records, with_shop, vendor)
    flagged = keep(ingest.flag_duplicates(candidates, validation.duplicate_key))
    queue = (
        ingest.rejected_rows(records, run_at)
        .unionByName(ingest.failed_pages(records, run_at))
        .unionByName(ingest.duplicate_rows(flagged, validation.duplicate_key, run_at))
    )
    return {
        "bronze_vendor_statement_raw": ingest.bronze_rows(
            ingest.attach_responses(flagged.where("NOT is_duplicate"), pages), run_at
        ),
        "validation_document_review_queue": queue,
        "ai_audit_log": ingest.page_audit(records, provider, run_at),
    }


def from_cells(
    pages: DataFrame,
    vendor: VendorRules,
    validation: ValidationRules = ValidationRules(),
    provider: str = "extractor",
    run_at: str | None = None,
    keep: Keep = lazily,
) -> dict[str, DataFrame]:
    """Table cells straight to Bronze: no validation, no review, no audit."""
    rows = ingest.cells_to_records(ingest.attach_shop(pages, vendor), vendor)
    return {"bronze_vendor_statement_raw": ingest.bronze_rows(ingest.with_blank_extraction(rows), run_at)}


# Which method a vendor's rules name.
EXTRACTION_METHODS: Mapping[str, Callable[..., dict[str, DataFrame]]] = {
    "ai_extraction": from_responses,
    "pdfplumber_tabular": from_cells,
}


def to_bronze(pages: DataFrame, vendor: VendorRules, **options) -> dict[str, DataFrame]:
    """Bronze by the vendor's own extraction method; a method nobody knows is an error."""
    if vendor.extraction_method not in EXTRACTION_METHODS:
        raise ValueError(f"unknown extraction method: {vendor.extraction_method!r}")
    return EXTRACTION_METHODS[vendor.extraction_method](pages, vendor, **options)


def to_silver(
    statement_bronze: DataFrame,
    ledger_bronze: DataFrame,
    vendor: VendorRules,
    adapter: Adapter = Adapter(),
    vendor_name: Column | None = None,
) -> DataFrame:
    return normalize.statement_to_silver(statement_bronze, vendor, vendor_name).unionByName(
        normalize.ledger_to_silver(ledger_bronze, vendor, adapter)
    )


def to_gold(
    silver: DataFrame,
    rules: MatchRules = MatchRules(),
    run_at: str | None = None,
    keep: Keep = lazily,
    colocate: bool = False,
) -> dict[str, DataFrame]:
    """The five Gold tables.

    The classified rows feed four of them. `keep` may write a frame and return it read back, as
    `sources.staging.stored` does, so that the joins behind it run once; by default all stays lazy.
    With `colocate` both sides are first stored by the matching key, and matching shuffles neither; this pays where they are
    matched more than once or where `silver` is a stored table of many rows.
    """
    statement, ledger = normalize.sides(silver)
    if colocate:
        sides = colocated.store(statement, ledger, matching.KEY)
        ledger = sides.ledger
        shared = keep(matching.shared_numbers(sides.statement, ledger))
        classified = keep(gold.read_by_gold(matching.classify_stored(sides, shared, rules)))
        orphan_rows = keep(gold.read_by_gold(matching.orphans_stored(sides, shared)))
    else:
        shared = keep(matching.shared_numbers(statement, ledger))
        classified = keep(gold.read_by_gold(matching.classify(statement, ledger, rules, shared)))
        orphan_rows = keep(gold.read_by_gold(gold.orphans(statement, ledger, shared)))
    shops = gold.shop_aggregates(classified, orphan_rows, ledger)
    return {
        "gold_matched_invoices": gold.matched_invoices(classified, run_at),
        "gold_exceptions": gold.exceptions(classified, orphan_rows, run_at),
        "gold_vendor_summary": gold.vendor_summary(shops),
        "gold_shop_summary": gold.shop_summary(shops),
        "gold_reconciliation_summary": gold.reconciliation_summary(shops, rules),
    }


def pages_to_gold(
    pages: DataFrame,
    ledger_bronze: DataFrame,
    vendor: VendorRules,
    adapter: Adapter = Adapter(),
    rules: MatchRules = MatchRules(),
    vendor_name: Column | None = None,
    run_at: str | None = None,
    keep: Keep = lazily,
    colocate: bool = False,
) -> dict[str, DataFrame]:
    """One run for any number of vendors and periods: what ingestion wrote to Bronze feeds Silver, then matching.

    Each layer is handed to `keep` before the next one reads it."""
    read = to_bronze(pages, vendor, run_at=run_at, keep=keep)
    read["bronze_vendor_statement_raw"] = keep(read["bronze_vendor_statement_raw"])
    silver = keep(to_silver(read["bronze_vendor_statement_raw"], ledger_bronze, vendor, adapter, vendor_name))
    return {
        **read,
        "bronze_internal_erp_raw": ledger_bronze,
        "silver_reconciliation_standard": silver,
        **to_gold(silver, rules, run_at, keep, colocate),
    }
