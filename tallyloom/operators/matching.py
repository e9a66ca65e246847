"""Match statement rows against ledger rows and decide each one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom import contract as K
from tallyloom.config import MatchRules
from tallyloom.functions.money import amount_equal
from tallyloom.functions.text import quoted, render, shown
from tallyloom.operators.joins import computed_once, local_join, lookup_join
from tallyloom.sources.colocated import Sides

_SCOPE = ["vendor_id", "statement_period"]
KEY = [*_SCOPE, "invoice_number_normalized"]
_CANDIDATE = ("record_id", "outstanding_amount", "amount", "ro_number", "status", "credit")


def candidate_groups(ledger: DataFrame) -> DataFrame:
    """One row per (vendor, period, normalised number): how many ledger records share it, whether their
    outstanding amounts agree (NULL counts as a value), and the record itself.

    The decision reads the record only where there is exactly one, so no list of candidates is
    kept: every aggregate combines on the map side and a key with a million copies stays one row.
    """
    outstanding = F.col("outstanding_amount")
    known = F.count(outstanding)
    return (
        ledger.dropna(subset=KEY)
        .groupBy(*KEY)
        .agg(
            F.count("*").alias("candidate_count"),
            (
                (known == 0)
                | ((known == F.count("*")) & (F.min(outstanding) == F.max(outstanding)))
            ).alias("copies_agree"),
            F.any_value(F.struct(*_CANDIDATE)).alias("candidate"),
        )
    )


def stored_candidate_groups(ledger: DataFrame) -> DataFrame:
    """The same groups of a ledger that is stored by the key. Counting has buffers of fixed width, so it hashes and sorts
    nothing; the record of a key that has only one is fetched by joining the ledger with itself, bucket by bucket. The key
    of many copies is left out there, so none of its rows meets another."""
    outstanding = F.col("outstanding_amount")
    counted = (
        ledger.dropna(subset=KEY)
        .groupBy(*KEY)
        .agg(
            F.count("*").alias("candidate_count"),
            F.count(outstanding).alias("_known"),
            F.min(outstanding).alias("_least"),
            F.max(outstanding).alias("_most"),
        )
    )
    agree = (F.col("_known") == 0) | ((F.col("_known") == F.col("candidate_count")) & (F.col("_least") == F.col("_most")))
    groups = counted.select(*KEY, "candidate_count", agree.alias("copies_agree"))
    only = groups.where("candidate_count = 1").select(*KEY)
    records = local_join(ledger.select(*KEY, F.struct(*_CANDIDATE).alias("candidate")), only, KEY, "left_semi")
    return local_join(groups, records, KEY)


def attach_candidates(statement: DataFrame, ledger: DataFrame, stored_by_key: bool = False) -> DataFrame:
    """Every statement row with its candidate group; no group gives a count of 0."""
    if stored_by_key:
        joined = local_join(statement, stored_candidate_groups(ledger), KEY)
    else:
        joined = lookup_join(statement, candidate_groups(ledger), KEY)
    return joined.withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0).cast("bigint")))


def attach_work_orders(statement: DataFrame, ledger: DataFrame) -> DataFrame:
    """Add the ledger number that equals the row's work order, if the ledger of its vendor and period has one."""
    numbers = (
        ledger.select(*_SCOPE, F.col("invoice_number").alias("work_order_number"))
        .dropna()
        .distinct()
        .withColumn("work_order_match", F.col("work_order_number"))
    )
    return lookup_join(statement, numbers, [*_SCOPE, "work_order_number"])


def shared_numbers(statement: DataFrame, ledger: DataFrame) -> DataFrame:
    """(vendor, period, number): numbers that a statement has as a work order and the ledger of its vendor and period as an
    invoice number. Both sides are tagged, stacked and summed in one shuffle of one row per number, side and task.

    The work-order lookup and the exclusion of orphans both ask for a number of this one, mostly small, set."""
    tag = lambda rows, column, ours: rows.select(*_SCOPE, F.col(column).alias("number"), F.lit(ours).alias("ordered"))
    both = tag(statement, "work_order_number", True).unionByName(tag(ledger, "invoice_number", False)).dropna()
    sides = both.groupBy(*_SCOPE, "number").agg(F.max("ordered").alias("ordered"), F.min("ordered").alias("only_ordered"))
    return sides.where("ordered AND NOT only_ordered").select(*_SCOPE, "number")


def attach_shared(statement: DataFrame, shared: DataFrame) -> DataFrame:
    """`attach_work_orders` from the numbers that both sides share."""
    numbers = shared.withColumnRenamed("number", "work_order_number").withColumn("work_order_match", F.col("work_order_number"))
    return lookup_join(statement, numbers, [*_SCOPE, "work_order_number"])


def decision(rules: MatchRules) -> Column:
    """The decision struct of a row that carries its candidate group: the first rule that applies."""
    count, candidate = F.col("candidate_count"), F.col("candidate")
    outstanding, ro = F.col("outstanding_amount"), F.col("ro_number")
    agree = amount_equal(outstanding, candidate["outstanding_amount"], rules.amount_tolerance)
    explained = amount_equal(outstanding, candidate["amount"], rules.amount_tolerance)
    text = {
        "number": quoted(F.col("invoice_number")),
        "normalized": quoted(F.col("invoice_number_normalized")),
        "count": count.cast("string"),
        "note": F.when(F.col("copies_agree"), K.NOTE_COPIES_AGREE).otherwise(K.NOTE_COPIES_DIFFER),
        "status": quoted(candidate["status"]),
        "ledger_number": quoted(F.col("work_order_match")),
        "work_order": quoted(F.col("work_order_number")),
        "statement_ro": quoted(ro),
        "ledger_ro": quoted(candidate["ro_number"]),
        "statement_outstanding": shown(outstanding),
        "ledger_outstanding": shown(candidate["outstanding_amount"]),
        "ledger_amount": shown(candidate["amount"]),
        "credit": shown(candidate["credit"]),
    }

    def said(template: str) -> Column:
        return render(template, **{name: column for name, column in text.items() if f"{{{name}}}" in template})

    def outcome(status: str, level: int | None, rule: str | None, category: str | None, reason: Column, reference: Column) -> Column:
        matched = status == K.MATCHED
        nothing = F.lit(None).cast("string")
        return F.struct(
            F.lit(status).alias("match_status"),
            F.lit(level).cast("int").alias("match_level"),
            F.lit(rule).cast("string").alias("matched_rule"),
            (reason if matched else nothing).alias("match_reason"),
            F.lit(category).cast("string").alias("exception_category"),
            (nothing if matched else reason).alias("deterministic_reason"),
            reference.cast("string").alias("reference_record_id"),
        )

    def match(level: int, rule: str, reason: Column) -> Column:
        return outcome(K.MATCHED, level, rule, None, reason, candidate["record_id"])

    def fault(category: str, reason: Column, reference: Column = candidate["record_id"]) -> Column:
        return outcome(K.EXCEPTION, None, None, category, reason, reference)

    work_order_known = F.coalesce(F.col("work_order_match") != "", F.lit(False))
    missing = F.concat(said(K.REASON_MISSING), F.when(work_order_known, said(K.REASON_MISSING_WORK_ORDER)).otherwise(""))
    same_ro = ro == candidate["ro_number"]
    return (
        F.when(count > 1, fault(K.DUPLICATE_INVOICE, said(K.REASON_DUPLICATE), F.lit(None)))
        .when(count == 0, fault(K.INVOICE_MISSING, missing, F.lit(None)))
        .when(~candidate["status"].eqNullSafe(F.lit(K.POSTED)), fault(K.PENDING_POSTING, said(K.REASON_PENDING)))
        .when(agree & same_ro, match(1, K.LEVEL_1, F.lit(K.REASON_LEVEL_1)))
        .when(agree & same_ro.isNull(), match(2, K.LEVEL_2, F.lit(K.REASON_LEVEL_2)))
        .when(agree, match(3, K.LEVEL_3, said(K.REASON_LEVEL_3)))
        .when(candidate["credit"].isNull(), fault(K.AMOUNT_MISMATCH, said(K.REASON_MISMATCH)))
        .when(explained, fault(K.MISSING_CREDIT, said(K.REASON_MISSING_CREDIT)))
        .otherwise(fault(K.AMOUNT_MISMATCH, said(K.REASON_MISMATCH_CREDIT)))
    )


_ATTACHED = ("candidate_count", "copies_agree", "candidate", "work_order_match")


def classify(statement: DataFrame, ledger: DataFrame, rules: MatchRules = MatchRules(), shared: DataFrame | None = None) -> DataFrame:
    """Statement rows plus a `decision` struct. One row in, one row out. `shared` may hold the `shared_numbers` of both sides.

    A work order only matters where a number has no candidate, so only such rows go on to look theirs up; all others have met
    the ledger once and move no more. Both parts read the one join with the candidates."""
    plain = attach_candidates(statement, ledger).withColumn("work_order_match", F.lit(None).cast("string"))
    asks = (F.col("candidate_count") == 0) & F.col("work_order_number").isNotNull()
    # Computed once, so that neither part's filter moves below the join, which both then share.
    decided = computed_once(plain, decision=decision(rules), _asks=asks).drop(*_ATTACHED)
    asking = decided.where("_asks")
    looked_up = (attach_work_orders(asking, ledger) if shared is None else attach_shared(asking, shared)).withColumns(
        {"candidate_count": F.lit(0).cast("bigint"), "copies_agree": F.lit(None).cast("boolean"), "candidate": F.lit(None).cast(_candidate_type(ledger))}
    )
    parts = looked_up.withColumn("decision", decision(rules)), decided.where("NOT _asks")
    return parts[0].drop(*_ATTACHED).unionByName(parts[1]).drop("_asks")


def _candidate_type(ledger: DataFrame) -> StructType:
    return ledger.select(*_CANDIDATE).schema


def classify_stored(sides: Sides, shared: DataFrame, rules: MatchRules = MatchRules()) -> DataFrame:
    """`classify` of sides stored by the matching key and the numbers they share: statement and ledger stay where they are, and
    only the lookup of work orders may move rows. Sides with a hot bucket go the way that splits hot keys."""
    joined = attach_shared(attach_candidates(sides.statement, sides.ledger, sides.even), shared)
    return joined.withColumn("decision", decision(rules)).drop(*_ATTACHED)


def orphans_stored(sides: Sides, shared: DataFrame) -> DataFrame:
    """Ledger rows that no statement row of their vendor and period has, neither as its number nor as its work order."""
    join = local_join if sides.even else lookup_join
    numbers = sides.statement.select(*KEY).dropna().distinct()
    unmatched = join(sides.ledger, numbers, KEY, "left_anti")
    return lookup_join(unmatched, shared.withColumnRenamed("number", "invoice_number"), [*_SCOPE, "invoice_number"], "left_anti")
