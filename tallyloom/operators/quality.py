"""Data-quality checks: a few figures per table, one result row per check.

The figures of a table are aggregates over its rows. `run_checks` and `control_totals` take them from tables that are
there; `Observed` takes the same ones from the write that stores a table, so that nothing is read again to be checked.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyloom import contract as K
from tallyloom.functions import money
from tallyloom.functions.text import render


@dataclass(frozen=True)
class Check:
    """What one table must satisfy. `fault` marks a bad row and must never be NULL."""

    name: str
    table: str
    fault: Column | None = None
    fault_text: str = ""
    only: Column | None = None
    rows_text: str = K.CHECK_ROWS
    empty_text: str | None = K.CHECK_EMPTY


def _null(*names: str) -> Column:
    broken = F.col(names[0]).isNull()
    for name in names[1:]:
        broken = broken | F.col(name).isNull()
    return broken


def standard_checks() -> list[Check]:
    """All checks in report order."""

    def side(name: str, source: str) -> Check:
        return Check(
            name,
            "silver_reconciliation_standard",
            fault=_null("invoice_date"),
            fault_text=K.CHECK_BAD_DATES,
            only=F.col("record_source") == source,
            empty_text=K.CHECK_NO_SIDE.format(side=source),
        )

    known = F.coalesce(F.col("overall_status").isin(*K.OVERALL_STATUSES), F.lit(False))
    return [
        Check("Bronze Vendor Statement", "bronze_vendor_statement_raw"),
        side("Silver Vendor Statement", K.STATEMENT_SOURCE),
        Check("Bronze Internal ERP", "bronze_internal_erp_raw"),
        side("Silver Internal ERP", K.LEDGER_SOURCE),
        Check("Review Queue", "validation_document_review_queue", rows_text=K.CHECK_QUEUE, empty_text=None),
        Check("AI Audit Log", "ai_audit_log", rows_text=K.CHECK_AUDIT, empty_text=None),
        Check("Mutation Manifest", "validation_mutation_manifest"),
        Check(
            "Gold Matched Invoices", "gold_matched_invoices",
            fault=_null("matched_rule", "match_reason"), fault_text=K.CHECK_MATCHES,
        ),
        Check(
            "Gold Exceptions", "gold_exceptions",
            fault=_null("exception_category", "deterministic_reason"), fault_text=K.CHECK_EXCEPTIONS,
        ),
        Check("Gold Vendor Summary", "gold_vendor_summary"),
        Check("Gold Shop Summary", "gold_shop_summary"),
        Check("Gold Reconciliation Summary", "gold_reconciliation_summary", fault=~known, fault_text=K.CHECK_STATUS),
    ]


def _check_figures(table: str) -> list[Column]:
    """Rows and faults of each of a table's checks."""
    figures = []
    for position, check in enumerate(standard_checks(), start=1):
        if check.table == table:
            among = F.lit(True) if check.only is None else F.coalesce(check.only, F.lit(False))
            fault = F.lit(False) if check.fault is None else check.fault
            figures += [F.count_if(among).alias(f"n_{position}"), F.count_if(among & fault).alias(f"bad_{position}")]
    return figures


def _verdict(position: int, check: Check) -> Column:
    """A check's result row, from the figures of its table."""
    n, bad = F.col(f"n_{position}"), F.col(f"bad_{position}")
    text = render(check.rows_text, rows=n.cast("string"))
    if check.fault is not None:
        text = F.when(bad > 0, F.concat(text, render(check.fault_text, bad=bad.cast("string")))).otherwise(text)
    passed = bad == 0
    if check.empty_text is not None:
        text = F.when(n == 0, check.empty_text).otherwise(text)
        passed = passed & (n > 0)
    return _row(position, check, passed, text, n)


def _row(position: int, check: Check, passed: Column, text: Column, n: Column) -> Column:
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(check.name).alias("name"),
        passed.alias("passed"),
        text.alias("details"),
        n.alias("row_count"),
    )


def _missing(position: int, check: Check) -> Column:
    return _row(position, check, F.lit(False), F.lit(K.CHECK_UNREADABLE), F.lit(None).cast("bigint"))


def _report(spark: SparkSession, figures: Mapping[str, DataFrame | None]) -> DataFrame:
    """One row per check in report order from one-row frames of figures by table; a table without one fails its checks."""
    by_table: dict[str, list[tuple[int, Check]]] = {}
    for position, check in enumerate(standard_checks(), start=1):
        by_table.setdefault(check.table, []).append((position, check))
    parts = []
    for table, checks in by_table.items():
        one_row = figures.get(table)
        if one_row is None:
            parts.append(spark.range(1).select(F.inline(F.array(*[_missing(p, c) for p, c in checks]))))
        else:
            parts.append(one_row.select(F.inline(F.array(*[_verdict(p, c) for p, c in checks]))))
    return reduce(DataFrame.unionByName, parts)


def run_checks(spark: SparkSession, tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """One row per check, `position` giving the report order; one aggregate per table. A table that is not there fails only
    its own checks."""
    figures = {name: None if rows is None else rows.agg(*_check_figures(name)) for name, rows in tables.items() if _check_figures(name)}
    return _report(spark, figures)


def _ledger_side() -> Column:
    return F.col("record_source") == K.LEDGER_SOURCE


def _total_figures(table: str) -> list[Column]:
    """What control totals need: of a Bronze table all rows, of Silver each side."""
    if table in _BRONZE:
        return _bronze_totals()
    if table == "silver_reconciliation_standard":
        sides = {K.STATEMENT_SOURCE: ~_ledger_side(), K.LEDGER_SOURCE: _ledger_side()}
        return [total for side, where in sides.items() for total in _silver_totals(where, f"{side}_")]
    return []


_BRONZE = {"bronze_vendor_statement_raw": K.STATEMENT_SOURCE, "bronze_internal_erp_raw": K.LEDGER_SOURCE}


@dataclass
class Observed:
    """Stores tables and takes the figures of checks and control totals from the writes themselves.

    `write` stores a frame and returns it read back. The figures are taken in the last stage before the files, whose tasks
    count once each however often they are tried, and come back with the finished write: a few numbers per table.
    """

    spark: SparkSession
    write: Callable[..., DataFrame]
    figures: dict[str, dict[str, object]] = field(default_factory=dict)
    _types: dict[str, dict[str, str]] = field(default_factory=dict)

    def store(self, table: str, rows: DataFrame, **options) -> DataFrame:
        """The table's rows, written once, with its figures kept."""
        wanted = _check_figures(table) + _total_figures(table)
        if not wanted:
            return self.write(rows, **options)
        seen = Observation(f"figures of {table}")
        back = self.write(rows.observe(seen, *wanted), **options)
        self.figures[table] = seen.get
        # Types of the figures as Spark has them: a sum that met no value comes back without one.
        self._types[table] = {f.name: f.dataType.simpleString() for f in rows.agg(*wanted).schema}
        return back

    def _frame(self, *tables: str) -> DataFrame:
        """The figures of some tables as one row; no two tables share a figure's name."""
        columns = [F.lit(value).cast(self._types[t][name]).alias(name) for t in tables for name, value in self.figures[t].items()]
        return self.spark.range(1, numPartitions=1).select(*columns)

    def checks(self) -> DataFrame:
        """The standard checks of the tables stored so far; the others count as missing."""
        one_row = self._frame(*self.figures)
        checks = list(enumerate(standard_checks(), start=1))
        found = [_verdict(p, c) if c.table in self.figures else _missing(p, c) for p, c in checks]
        return one_row.select(F.inline(F.array(*found)))

    def control_totals(self, bronze: str) -> DataFrame:
        """Control totals of one Bronze table and its side of Silver, as `control_totals` returns them."""
        prefix = f"{_BRONZE[bronze]}_"
        silver = self._frame("silver_reconciliation_standard")
        side = silver.select(*[F.col(c).alias(c.removeprefix(prefix)) for c in silver.columns if c.startswith(prefix)])
        return _side_by_side(self._frame(bronze).select("bronze_rows", "bronze_total"), side)

    def rows_of(self, table: str) -> int:
        """How many rows went into a table that has a check of its own over all rows."""
        position = next(p for p, c in enumerate(standard_checks(), start=1) if c.table == table and c.only is None)
        return int(self.figures[table][f"n_{position}"])


def _bronze_totals() -> list[Column]:
    return [
        F.count("*").alias("bronze_rows"),
        F.round(F.sum(money.loose_money(F.col("raw_outstanding_amount"))), 2).cast("decimal(18,2)").alias("bronze_total"),
    ]


def _silver_totals(where: Column | None = None, prefix: str = "") -> list[Column]:
    among = F.lit(True) if where is None else where
    pending = F.coalesce(F.col("status") == K.PENDING, F.lit(False))
    posted = F.col("posting_date").isNotNull()
    return [
        F.count_if(among).alias(f"{prefix}silver_rows"),
        F.sum(F.when(among, F.col("outstanding_amount"))).cast("decimal(18,2)").alias(f"{prefix}silver_total"),
        F.count_if(among & F.col("invoice_date").isNull()).alias(f"{prefix}null_dates"),
        F.count_if(among & F.col("outstanding_amount").isNull()).alias(f"{prefix}null_amounts"),
        # A missing status counts as not pending here; a statement side has neither column filled.
        F.count_if(among & ~posted & ~pending).alias(f"{prefix}posted_without_date"),
        F.count_if(among & posted & pending).alias(f"{prefix}pending_with_date"),
    ]


def control_totals(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """One row: row counts and money totals on both sides of normalisation, and what did not parse.

    The Bronze total reads the printed text more loosely than Silver does, so it is a second opinion.
    """
    raw = bronze.agg(*_bronze_totals())
    typed = silver.agg(*_silver_totals())
    return _side_by_side(raw, typed)


def _side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """Put one-row aggregates next to each other: stacked, then one aggregate instead of a join without a key."""
    stacked = one_row_frames[0]
    for other in one_row_frames[1:]:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def _parity(totals: DataFrame, side: str, ledger: bool) -> DataFrame:
    tests = {
        "rows present": F.col("bronze_rows") > 0,
        "row count kept": F.col("bronze_rows") == F.col("silver_rows"),
        "total kept": F.coalesce(F.col("bronze_total") == F.col("silver_total"), F.lit(False)),
        "dates parsed": F.col("null_dates") == 0,
        "amounts parsed": F.col("null_amounts") == 0,
    }
    if ledger:
        tests["posted rows have a posting date"] = F.col("posted_without_date") == 0
        tests["pending rows have no posting date"] = F.col("pending_with_date") == 0
    rows = [F.struct(F.lit(side).alias("side"), F.lit(t).alias("test"), ok.alias("passed")) for t, ok in tests.items()]
    return totals.select(F.inline(F.array(*rows)))


def parity_checks(
    statement: tuple[DataFrame, DataFrame],
    ledger: tuple[DataFrame, DataFrame],
    manifest: DataFrame,
    expected_ledger_rows: DataFrame,
) -> DataFrame:
    """Bronze to Silver parity per side, and generator parity. Pairs are (bronze, silver);
    `expected_ledger_rows` is a one-row frame with the column `expected`."""
    return parity_of(
        control_totals(*statement), control_totals(*ledger), manifest.agg(F.count("*").alias("manifest_rows")), expected_ledger_rows
    )


def parity_of(statement_totals: DataFrame, ledger_totals: DataFrame, manifest_rows: DataFrame, expected_ledger_rows: DataFrame) -> DataFrame:
    """The parity report from control totals and row counts, each a frame of one row."""
    generated = _side_by_side(
        ledger_totals.select(F.col("bronze_rows").alias("ledger_rows")),
        expected_ledger_rows.select("expected"),
        manifest_rows.select("manifest_rows"),
        statement_totals.select(F.col("silver_rows").alias("statement_rows")),
    )
    generator = generated.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit("GENERATOR").alias("side"), F.lit(test).alias("test"), ok.alias("passed"))
                    for test, ok in (
                        ("ledger rows as planned", F.col("ledger_rows") == F.col("expected")),
                        ("one manifest row per statement row", F.col("manifest_rows") == F.col("statement_rows")),
                    )
                ]
            )
        )
    )
    return (
        _parity(statement_totals, K.STATEMENT_SOURCE, ledger=False)
        .unionByName(_parity(ledger_totals, K.LEDGER_SOURCE, ledger=True))
        .unionByName(generator)
    )
