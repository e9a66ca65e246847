"""What can feed the ledger side, by the name the rules file gives it."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.config import Adapter, ScenarioRules, VendorRules
from tallyloom.operators import groundtruth, ingest


def generated_ledger(
    statement_silver: DataFrame, vendor: VendorRules, adapter: Adapter, scenarios: ScenarioRules = ScenarioRules()
) -> DataFrame:
    """A ledger planted from the statement side, in Bronze ledger shape."""
    key = F.concat_ws("|", "statement_id", "invoice_number", "ro_number", "record_id")
    labelled = groundtruth.proportional_split(statement_silver, scenarios.mix, key, scenarios.seed)
    plan = groundtruth.planted(labelled, key, scenarios)
    return groundtruth.ledger_extract(
        plan, scenarios, vendor.date_format, f"mock_erp_generator_v{scenarios.version}"
    )


def payment_voucher(pages: DataFrame, vendor: VendorRules, adapter: Adapter) -> DataFrame:
    """Voucher lines found in a page's text."""
    return ingest.voucher_lines(pages, adapter.invoice_pattern, adapter.credit_pattern)


LEDGER_ADAPTERS: Mapping[str, Callable[..., DataFrame]] = {
    "mock_erp_generator": generated_ledger,
    "payment_voucher": payment_voucher,
}


def ledger_rows(source: DataFrame, vendor: VendorRules, adapter: Adapter, **options) -> DataFrame:
    """Rows of the active adapter; an adapter that is named but not built yet is an error."""
    if adapter.name not in LEDGER_ADAPTERS:
        raise ValueError(f"no ledger adapter named {adapter.name}")
    return LEDGER_ADAPTERS[adapter.name](source, vendor, adapter, **options)
