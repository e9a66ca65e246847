"""Rules as frozen dataclasses. Each one also loads from the JSON files that hold them."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from tallyloom import contract as K


@dataclass(frozen=True)
class VendorRules:
    vendor_id: str
    vendor_name: str
    statement_date: str
    date_format: str = "MM/dd/yyyy"
    # Column headings of a statement table, in table order, and the field each one fills.
    column_mapping: tuple[tuple[str, str], ...] = (
        ("Invoice Date", "invoice_date"),
        ("Invoice #", "invoice_number"),
        ("Work Order #", "work_order_number"),
        ("RO #", "ro_number"),
        ("Outstanding Amount", "outstanding_amount"),
        ("Due Date", "due_date"),
    )
    shop_pattern: str = "Shop - (.*)"
    invoice_pattern: str = r"^SIN\d+$"
    revision_suffixes: tuple[str, ...] = (r"X\d+$", r"-\d+$", r"R$")
    extraction_method: str = "ai_extraction"
    fallback_on_failure: bool = True
    derive_amount: bool = True

    @property
    def period(self) -> str:
        return self.statement_date[:7]

    @property
    def fields(self) -> list[str]:
        return [name for _, name in self.column_mapping]

    @classmethod
    def from_mapping(cls, raw: Mapping) -> VendorRules:
        # A vendor file without an "extraction" block predates AI extraction: table cells only.
        extraction = raw.get("extraction") or {}
        return cls(
            vendor_id=raw["vendor_id"],
            vendor_name=raw["vendor_name"],
            statement_date=raw["period"]["end_date"],
            date_format=raw["date_format"],
            column_mapping=tuple(raw["source_column_mapping"].items()),
            shop_pattern=raw["shop_extraction"]["pattern"],
            invoice_pattern=raw["invoice_pattern"],
            revision_suffixes=tuple(raw["revision_suffixes"]),
            extraction_method=extraction.get("active_method", "pdfplumber_tabular"),
            fallback_on_failure=extraction.get("fallback_on_ai_failure", False),
            derive_amount=extraction.get("derive_amount_from_outstanding", False),
        )


@dataclass(frozen=True)
class MatchRules:
    amount_tolerance: float = 0.01
    minor_variance: float = 0.01

    @classmethod
    def from_mapping(cls, raw: Mapping) -> MatchRules:
        return cls(raw["amount_comparison_tolerance"], raw["minor_variance_threshold_pct"])


@dataclass(frozen=True)
class ValidationRules:
    required: tuple[str, ...] = (
        "vendor", "invoice_number", "amount", "outstanding_amount", "invoice_date", "shop",
    )
    numeric: tuple[str, ...] = ("amount", "outstanding_amount")
    dates: tuple[str, ...] = ("invoice_date", "due_date")
    duplicate_key: tuple[str, ...] = ("vendor", "invoice_number", "amount")
    confidence_threshold: float | None = 0.75

    @classmethod
    def from_mapping(cls, raw: Mapping) -> ValidationRules:
        return cls(
            required=tuple(raw.get("required_fields", ())),
            numeric=tuple(raw.get("numeric_fields", ())),
            dates=tuple(raw.get("date_fields", ())),
            duplicate_key=tuple(raw.get("duplicate_key_fields", cls.duplicate_key)),
            confidence_threshold=raw.get("confidence_threshold"),
        )


@dataclass(frozen=True)
class Adapter:
    """What currently feeds the ledger side."""

    name: str = "mock_erp_generator"
    document_type: str = "MOCK_ERP_EXTRACT"
    invoice_pattern: str = r"Bill #(\S+)"
    credit_pattern: str = r"Bill Credit #(\S+)"

    @classmethod
    def from_mapping(cls, raw: Mapping) -> Adapter:
        name = raw["active_adapter"]
        entry = raw["adapters"][name]
        found = entry.get("invoice_extraction", {})
        return cls(
            name,
            entry["document_type"],
            found.get("invoice_pattern", cls.invoice_pattern),
            found.get("credit_pattern", cls.credit_pattern),
        )


@dataclass(frozen=True)
class Outcome:
    """The classification a planted label must lead to."""

    status: str
    level: int | None = None
    category: str | None = None


# The planted mix, what each label must be classified as, and its ledger status.
DEFAULT_MIX = {
    "exact_match": 0.75,
    "invoice_revision": 0.05,
    "missing_invoice": 0.08,
    "amount_mismatch": 0.05,
    "duplicate_invoice": 0.03,
    "vendor_reference_issue": 0.02,
    "missing_credit": 0.01,
    "pending_posting": 0.01,
}
DEFAULT_OUTCOMES = {
    "exact_match": Outcome(K.MATCHED, level=1),
    "invoice_revision": Outcome(K.MATCHED, level=1),
    "missing_invoice": Outcome(K.EXCEPTION, category=K.INVOICE_MISSING),
    "amount_mismatch": Outcome(K.EXCEPTION, category=K.AMOUNT_MISMATCH),
    "duplicate_invoice": Outcome(K.EXCEPTION, category=K.DUPLICATE_INVOICE),
    "vendor_reference_issue": Outcome(K.EXCEPTION, category=K.INVOICE_MISSING),
    "missing_credit": Outcome(K.EXCEPTION, category=K.MISSING_CREDIT),
    "pending_posting": Outcome(K.EXCEPTION, category=K.PENDING_POSTING),
}


@dataclass(frozen=True)
class ScenarioRules:
    mix: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_MIX))
    outcomes: Mapping[str, Outcome] = field(default_factory=lambda: dict(DEFAULT_OUTCOMES))
    seed: int = 42
    version: str = "1.0"
    suffixes: tuple[str, ...] = ("-1", "X1", "R")
    variance_permille: tuple[int, int] = (50, 250)
    credit_permille: tuple[int, int] = (50, 150)
    extra_copies: int = 1
    lag_days: tuple[int, int] = (1, 5)
    po_prefix: str | None = None
    statuses: Mapping[str, str] = field(default_factory=lambda: {"pending_posting": K.PENDING})

    @classmethod
    def from_mapping(cls, raw: Mapping) -> ScenarioRules:
        knobs = raw["mutation_parameters"]
        dates = raw["field_generation"]

        def permille(label: str, low: str, high: str) -> tuple[int, int]:
            entry = knobs.get(label, {})
            return round(entry.get(low, 0) * 1000), round(entry.get(high, 0) * 1000)

        return cls(
            mix=dict(raw["scenario_mix"]),
            outcomes={
                label: Outcome(o["match_status"], o["match_level"], o["exception_reason"])
                for label, o in raw["expected_outcome_by_scenario"].items()
            },
            seed=raw["random_seed"],
            version=raw["generator_version"],
            suffixes=tuple(knobs.get("invoice_revision", {}).get("suffixes_to_apply", ())),
            variance_permille=permille("amount_mismatch", "variance_min_pct", "variance_max_pct"),
            credit_permille=permille("missing_credit", "credit_min_pct", "credit_max_pct"),
            extra_copies=knobs.get("duplicate_invoice", {}).get("max_duplicate_copies", 1),
            lag_days=(dates["posting_date_lag_days_min"], dates["posting_date_lag_days_max"]),
            po_prefix=dates["po_number_prefix"],
            statuses=dict(raw["erp_status_by_scenario"]),
        )

    def with_labels(self, mix: Mapping[str, float], outcomes: Mapping[str, Outcome]) -> ScenarioRules:
        return replace(self, mix=dict(mix), outcomes={**self.outcomes, **outcomes})


def load(kind: type, path: str):
    """Read one rules file: `load(VendorRules, "config/vendors/x.json")`."""
    with open(path, encoding="utf-8") as handle:
        return kind.from_mapping(json.load(handle))
