"""Planted ground truth: label statement rows, derive a ledger from the labels, grade the result."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import contract as K
from tallyloom.config import ScenarioRules
from tallyloom.functions import dates, keys, money
from tallyloom.functions.text import quoted, render
from tallyloom.operators.joins import computed_once, lookup_join

LABEL = "scenario_type"
RANK = "split_rank"


def _seeded(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def _offsets(hashed: DataFrame) -> DataFrame:
    """Rows per `_bucket`, rows in the buckets before it, and rows in all."""
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        hashed.groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        .select(
            "_bucket",
            "_n",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
            F.sum("_n").over(everything).alias("_total"),
        )
    )


def _ranked(
    rows: DataFrame, key: Column, seed: int, extend: Callable[[DataFrame], DataFrame], digits: int = 4
) -> DataFrame:
    """Add `split_rank`, the 0-based position in the order of a seeded hash of `key`, plus what
    `extend` adds to the offset table, where `_total` is the number of rows.

    A window over all rows would sort them in one task. Here the hash's first digits make
    16^digits even buckets; their counts give each bucket an offset, and rows are numbered inside
    their bucket. The offset table has at most 16^digits rows whatever the input, which is what
    bounds the single-task running sum and the broadcast. `key` must be unique per row.
    """
    hashed = rows.withColumn("_hash", _seeded(key, seed)).withColumn("_bucket", F.substring("_hash", 1, digits))
    offsets = _offsets(hashed).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash"))
    return (
        hashed.withColumn("_inside", inside)
        .join(F.broadcast(extend(offsets)), "_bucket")
        .withColumn(RANK, F.col("_offset") + F.col("_inside") - 1)
        .drop("_hash", "_bucket", "_inside", "_offset", "_total")
    )


def ranked(rows: DataFrame, key: Column, seed: int) -> DataFrame:
    """Add `split_rank`: every row's position in a seeded, reproducible random order."""
    return _ranked(rows, key, seed, lambda offsets: offsets)


def _cuts(mix: Mapping[str, float]) -> Callable[[DataFrame], DataFrame]:
    """Add `_cuts`: the rank at which each label ends. Rows per label are the half-even rounded
    share; the largest label (the first on ties) absorbs what rounding leaves over."""
    rows = [f"_rows_{i}" for i in range(len(mix))]
    ends = [f"_end_{i}" for i in range(len(mix))]
    zero = F.lit(0).cast("bigint")

    def extend(offsets: DataFrame) -> DataFrame:
        shares = {
            name: F.bround(F.lit(float(pct)) * F.col("_total"), 0).cast("bigint") for name, pct in zip(rows, mix.values())
        }
        wanted = offsets.withColumns(shares)
        assigned = sum((F.col(n) for n in rows), zero)
        most = F.array_max(F.array(*rows))
        wanted = wanted.withColumns(
            {"_drift": F.col("_total") - assigned, "_largest": F.array_position(F.array(*rows), most) - 1}
        )
        settled = wanted.withColumns(
            {
                n: F.when(F.col("_largest") == i, F.greatest(F.col(n) + F.col("_drift"), zero)).otherwise(F.col(n))
                for i, n in enumerate(rows)
            }
        )
        for i, (end, n) in enumerate(zip(ends, rows)):
            settled = settled.withColumn(end, F.col(n) + (F.col(ends[i - 1]) if i else zero))
        return settled.select(*offsets.columns, F.array(*ends).alias("_cuts"))

    return extend


def proportional_split(rows: DataFrame, mix: Mapping[str, float], key: Column, seed: int, rank: bool = True) -> DataFrame:
    """Give every row exactly one label, in the mix's proportions, reproducibly for a seed.

    Without `rank` the labels are the same, but no row is numbered: the hashes at which labels end are found first, and each
    row's own hash says between which of them it lies. Only where rows with one and the same hash get different labels must
    they be counted, as ranks do."""
    ends = None if rank else _label_ends(rows, mix, key, seed)
    label = F
    if ends is None:
        numbered = _ranked(rows, key, seed, _cuts(mix))
        for i, name in enumerate(mix):
            label = label.when(F.col(RANK) < F.get("_cuts", F.lit(i)), name)
        labelled = numbered.withColumn(LABEL, label).drop("_cuts")
        return labelled if rank else labelled.drop(RANK)
    hashed = rows.withColumn("_hash", _seeded(key, seed))
    for i, name in enumerate(mix):
        label = label.when(F.col("_hash") < ends[i] if i in ends else F.lit(True), name)
    # A plain value from here on: the plan of a ledger asks for the label dozens of times.
    return computed_once(hashed, **{LABEL: label}).drop("_hash")


def _label_ends(rows: DataFrame, mix: Mapping[str, float], key: Column, seed: int, digits: int = 4) -> dict[int, str] | None:
    """For each label, by position, the hash of the first row after its last one; a label without one has no row after it. None if
    such a hash also stands before the end.

    Counts per bucket tell in which buckets labels end; only the hashes of these, one bucket per label at most, are sorted."""
    hashed = rows.select(_seeded(key, seed).alias("_hash")).withColumn("_bucket", F.substring("_hash", 1, digits))
    spark = rows.sparkSession
    cuts = _cuts(mix)(spark.createDataFrame([(hashed.count(),)], "_total long")).first()["_cuts"]
    ends = _offsets(hashed).select("_bucket", "_offset", "_n", F.posexplode(F.array(*map(F.lit, cuts))).alias("label", "cut"))
    ends = ends.where("cut >= _offset AND cut < _offset + _n").select("_bucket", "label", (F.col("cut") - F.col("_offset") + 1).alias("place"))
    ends = spark.createDataFrame(ends.collect(), ends.schema)
    order = Window.partitionBy("_bucket").orderBy("_hash")
    some = hashed.join(F.broadcast(ends.select("_bucket").distinct()), "_bucket", "left_semi")
    placed = some.select("_bucket", "_hash", F.row_number().over(order).alias("place"), F.lag("_hash").over(order).alias("_last"))
    found = placed.join(F.broadcast(ends), ["_bucket", "place"]).select("label", "_hash", F.col("_hash").eqNullSafe(F.col("_last")).alias("tied")).collect()
    return None if any(r["tied"] for r in found) else {r["label"]: r["_hash"] for r in found}


def mix_report(labelled: DataFrame, mix: Mapping[str, float]) -> DataFrame:
    """Rows per label against the configured target, in one pass."""
    counts = labelled.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(LABEL) == name).alias(f"n_{i}") for i, name in enumerate(mix)],
    )
    lines = [
        F.struct(
            F.lit(name).alias(LABEL),
            F.bround(F.lit(float(pct)) * F.col("total"), 0).cast("bigint").alias("target"),
            F.col(f"n_{i}").alias("achieved"),
        )
        for i, (name, pct) in enumerate(mix.items())
    ]
    return counts.select(F.inline(F.array(*lines)))


def _between(limits: tuple[int, int], number: Column) -> Column:
    return F.lit(limits[0]) + number % F.lit(limits[1] - limits[0] + 1)


def _permille_of(cents: Column, permille: Column) -> Column:
    return F.call_function("div", cents * permille, F.lit(1000))


def _tenths(permille: Column) -> Column:
    return F.concat(F.call_function("div", permille, F.lit(10)).cast("string"), F.lit("."), (permille % 10).cast("string"))


def planted(labelled: DataFrame, key: Column, rules: ScenarioRules) -> DataFrame:
    """Add what the ledger will show for each labelled statement row: number, RO, cents, copies.

    All labels are branches of one projection. Random choices come from hashes of `key`, amounts
    are whole cents, so a rerun or a retried task gives the same ledger. Three labels serve tests of
    outcomes the standard mix never plants: `ro_missing`, `ro_conflict`, and `ledger_only`, which
    mirrors its row and adds a ledger record that no statement row has.
    """

    def number(salt: str) -> Column:
        return keys.hash_number(rules.seed, salt, key)

    label = F.col(LABEL)
    work_order = F.nullif(F.col("work_order_number"), F.lit(""))
    synthetic = F.concat(
        F.lit(K.SYNTHETIC_WORK_ORDER_PREFIX), (F.lit(10_000_000) + number("work_order") % 90_000_000).cast("string")
    )
    suffix = (
        F.element_at(F.array(*map(F.lit, rules.suffixes)), (number("suffix") % len(rules.suffixes) + 1).cast("int"))
        if rules.suffixes
        else F.lit("")
    )
    cents = money.cents(F.col("outstanding_amount"))
    mismatch, credit = label == "amount_mismatch", label == "missing_credit"
    # Drawn only where the label asks for it: each draw is a hash of its own.
    drawn = labelled.withColumns(
        {
            "_cents": cents,
            "_suffix": F.when(label == "invoice_revision", suffix),
            "_sign": F.when(mismatch, F.when(number("direction") % 2 == 0, 1).otherwise(-1)),
            "_variance": F.when(mismatch, _between(rules.variance_permille, number("variance"))),
            "_credit": F.when(credit, _between(rules.credit_permille, number("credit"))),
            "_lag": _between(rules.lag_days, number("lag")).cast("int"),
        }
    )
    changed = F.col("_cents") + F.col("_sign") * _permille_of(F.col("_cents"), F.col("_variance"))
    reduced = F.col("_cents") - _permille_of(F.col("_cents"), F.col("_credit"))
    return drawn.withColumns(
        {
            "ledger_number": F.when(label == "missing_invoice", F.lit(None).cast("string"))
            .when(label == "invoice_revision", F.concat("invoice_number", "_suffix"))
            .when(label == "vendor_reference_issue", F.coalesce(work_order, synthetic))
            .otherwise(F.col("invoice_number")),
            "ledger_ro": F.when(label.isin("vendor_reference_issue", "ro_missing"), F.lit(None).cast("string"))
            .when(label == "ro_conflict", F.concat("ro_number", F.lit("-Z")))
            .otherwise(F.col("ro_number")),
            "ledger_cents": F.when(mismatch, changed).otherwise(F.col("_cents")),
            "ledger_outstanding_cents": F.when(mismatch, changed).when(credit, reduced).otherwise(F.col("_cents")),
            "copies": F.when(label == "missing_invoice", 0)
            .when(label == "duplicate_invoice", 1 + rules.extra_copies)
            .when(label == "ledger_only", 2)
            .otherwise(1),
            "ledger_status": _lookup(rules.statuses, label, K.POSTED),
        }
    )


def _lookup(table: Mapping[str, str], name: Column, default: str) -> Column:
    result = F.lit(default)
    for entry, value in table.items():
        result = F.when(name == entry, value).otherwise(result)
    return result


def ledger_extract(
    plan: DataFrame,
    rules: ScenarioRules,
    date_format: str,
    source_file: str,
    sequence: Column | None = None,
    statement_prefix: str = "LEDGER-",
    run_at: str | None = None,
) -> DataFrame:
    """Bronze ledger rows of a planted frame.

    `sequence` numbers a row within its ledger document, by default its split rank; copies of one
    row get consecutive numbers.
    """
    base = F.col(RANK) if sequence is None else sequence
    most = max(1 + rules.extra_copies, 2)
    only_copy = (F.col(LABEL) == "ledger_only") & (F.col("copy") == 2)
    po_prefix = F.concat(F.lit("PO-"), F.col("vendor_id"), F.lit("-")) if rules.po_prefix is None else F.lit(rules.po_prefix)
    posted = F.col("ledger_status") == K.POSTED
    number_text = F.col("row_number").cast("string")
    return (
        plan.where(F.col("copies") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .withColumn("row_number", (base * most + F.col("copy")).cast("int"))
        .select(
            "vendor_id",
            F.lit(source_file).alias("source_file"),
            F.concat(F.lit(statement_prefix), "statement_id").alias("statement_id"),
            "statement_period",
            F.lit(None).cast("int").alias("page_number"),
            "row_number",
            F.lit(run_at).cast("timestamp").alias("ingestion_timestamp"),
            F.col("vendor_name").alias("raw_vendor"),
            F.when(only_copy, F.concat(F.lit("LED"), "ledger_number")).otherwise(F.col("ledger_number")).alias("raw_invoice_number"),
            dates.date_text(F.col("invoice_date"), date_format).alias("raw_invoice_date"),
            F.when(posted, dates.date_text(F.date_add("invoice_date", F.col("_lag")), date_format)).alias("raw_posting_date"),
            money.cents_text(F.col("ledger_cents")).alias("raw_amount"),
            money.cents_text(F.col("ledger_outstanding_cents")).alias("raw_outstanding_amount"),
            F.col("ledger_ro").alias("raw_ro_number"),
            # Zero-filled to four digits, longer numbers are kept whole.
            F.concat(po_prefix, F.lpad(number_text, F.greatest(F.lit(4), F.length(number_text)), F.lit("0"))).alias("raw_po_number"),
            F.col("shop").alias("raw_shop"),
            F.col("ledger_status").alias("raw_status"),
        )
    )


def manifest(plan: DataFrame, rules: ScenarioRules, run_at: str | None = None) -> DataFrame:
    """One row per statement row: what was planted and what it must be classified as.

    A row whose statement has no RO can match at level 2 at best, so the expectation says so.
    """
    label = F.col(LABEL)
    level = F.lit(None).cast("int")
    status, category = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, outcome in rules.outcomes.items():
        status = F.when(label == name, outcome.status).otherwise(status)
        level = F.when(label == name, F.lit(outcome.level).cast("int")).otherwise(level)
        category = F.when(label == name, F.lit(outcome.category).cast("string")).otherwise(category)
    amount = money.cents_text(F.col("_cents"))
    outstanding = money.cents_text(F.col("ledger_outstanding_cents"))
    number, ledger_number = F.col("invoice_number"), F.col("ledger_number")
    no_work_order = F.coalesce(F.col("work_order_number") == "", F.lit(True))
    details = (
        F.when(
            label == "invoice_revision",
            render(K.DETAILS_REVISION, suffix=quoted(F.col("_suffix")), number=number, ledger_number=ledger_number),
        )
        .when(label == "missing_invoice", K.DETAILS_MISSING)
        .when(
            label == "amount_mismatch",
            render(
                K.DETAILS_MISMATCH,
                sign=F.when(F.col("_sign") > 0, "+").otherwise("-"),
                pct=_tenths(F.col("_variance")),
                amount=amount,
                ledger_outstanding=outstanding,
            ),
        )
        .when(
            label == "duplicate_invoice",
            render(K.DETAILS_DUPLICATE, copies=F.lit(str(1 + rules.extra_copies)), extra=F.lit(str(rules.extra_copies))),
        )
        .when(
            label == "vendor_reference_issue",
            F.concat(
                F.when(no_work_order, K.DETAILS_SYNTHETIC_WORK_ORDER).otherwise(""),
                render(K.DETAILS_REFERENCE, number=number, ledger_number=ledger_number),
            ),
        )
        .when(
            label == "missing_credit",
            render(K.DETAILS_CREDIT, pct=_tenths(F.col("_credit")), amount=amount, ledger_outstanding=outstanding),
        )
        .when(label == "pending_posting", K.DETAILS_PENDING)
        .otherwise(K.DETAILS_EXACT)
    )
    return plan.select(
        keys.stable_id("manifest", F.col("vendor_id"), F.col("statement_period"), number, F.col("statement_id")).alias("manifest_id"),
        "vendor_id",
        "statement_period",
        number.alias("statement_invoice_number"),
        ledger_number.alias("generated_erp_invoice_number"),
        LABEL,
        status.alias("expected_match_status"),
        F.when((level == 1) & F.col("ro_number").isNull(), 2).when((level == 3) & F.col("ro_number").isNull(), 2).otherwise(level).alias("expected_match_level"),
        category.alias("expected_exception_reason"),
        details.alias("mutation_details"),
        F.lit(rules.version).alias("generator_config_version"),
        F.lit(run_at).cast("timestamp").alias("generation_timestamp"),
    )


def grade(manifest_rows: DataFrame, classified: DataFrame) -> DataFrame:
    """Compare each planted expectation with the decision taken for its invoice.

    Decisions are reduced to one row per invoice first, so a number that many statement lines
    repeat cannot multiply rows; lines that were decided differently count as wrong, and so does
    an invoice that was never classified.
    """
    d = F.col("decision")
    outcome = F.struct(
        d["match_status"].alias("status"), d["match_level"].alias("level"), d["exception_category"].alias("category")
    )
    key = ["vendor_id", "statement_period", "statement_invoice_number"]
    actual = (
        classified.withColumnRenamed("invoice_number", "statement_invoice_number")
        .groupBy(*key)
        .agg(F.min(outcome).alias("lowest"), F.max(outcome).alias("highest"))
    )
    low = F.col("lowest")
    detail = F.when(
        F.col("expected_match_status") == K.MATCHED, F.col("expected_match_level").eqNullSafe(low["level"])
    ).otherwise(F.col("expected_exception_reason").eqNullSafe(low["category"]))
    return lookup_join(manifest_rows, actual, key).select(
        *key,
        LABEL,
        "expected_match_status",
        low["status"].alias("actual_match_status"),
        "expected_match_level",
        low["level"].alias("actual_match_level"),
        "expected_exception_reason",
        low["category"].alias("actual_exception_category"),
        (
            low.eqNullSafe(F.col("highest")) & F.col("expected_match_status").eqNullSafe(low["status"]) & detail
        ).alias("graded_correct"),
    )


def grade_breakdown(graded: DataFrame) -> DataFrame:
    return graded.groupBy(LABEL).agg(
        F.count("*").alias("total"), F.count_if("graded_correct").alias("correct")
    )


def grade_mismatches(graded: DataFrame) -> DataFrame:
    return graded.where(~F.col("graded_correct"))
