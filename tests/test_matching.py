"""The decision for single rows, Gold tables over a small pair of sides, and skewed keys."""

import pytest
from pyspark.sql import functions as F

from tallyloom import contract as K
from tallyloom.config import MatchRules
from tallyloom.operators import gold, matching
from tallyloom.operators.joins import lookup_join

STATEMENT = (
    "vendor_id string, statement_period string, shop string, vendor_name string, record_id string, invoice_number string, "
    "invoice_number_normalized string, outstanding_amount decimal(12,2), ro_number string, work_order_number string, "
    "source_file string, statement_id string"
)
LEDGER = (
    "vendor_id string, statement_period string, shop string, record_id string, invoice_number string, "
    "invoice_number_normalized string, outstanding_amount decimal(12,2), amount decimal(12,2), ro_number string, "
    "status string, credit decimal(12,2), source_file string, statement_id string"
)


def frame(spark, schema, rows, **base):
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = ", ".join(f"{n} string" for n in names)
    values = [tuple(None if {**base, **r}.get(n) is None else str({**base, **r}[n]) for n in names) for r in rows]
    text = spark.createDataFrame(values, kinds)
    return text.select(*[F.col(n).cast(c.split()[1]).alias(n) for n, c in zip(names, schema.split(", "))])


def statement(spark, *rows):
    return frame(
        spark, STATEMENT, rows or ({},), vendor_id="V", statement_period="2026-05", shop="A", vendor_name="Vendor",
        record_id="stmt-1", invoice_number="SIN12200241", invoice_number_normalized="SIN12200241",
        outstanding_amount="100.00", ro_number="RO-1", work_order_number="24419074", source_file="f", statement_id="S",
    )


def ledger(spark, *rows):
    return frame(
        spark, LEDGER, rows, vendor_id="V", statement_period="2026-05", shop="A", record_id="erp-1",
        invoice_number="SIN12200241", invoice_number_normalized="SIN12200241", outstanding_amount="100.00",
        amount="100.00", ro_number="RO-1", status="POSTED", source_file="g", statement_id="L",
    )


def decide(spark, candidates, **row):
    return matching.classify(statement(spark, row), ledger(spark, *candidates), MatchRules()).select("decision.*").first()


CASES = [
    ([{}], {}, (K.MATCHED, 1, None)),
    ([{"invoice_number": "SIN12200241-1"}], {}, (K.MATCHED, 1, None)),
    ([{"ro_number": None}], {}, (K.MATCHED, 2, None)),
    ([{}], {"ro_number": None}, (K.MATCHED, 2, None)),
    ([{"ro_number": None}], {"ro_number": None}, (K.MATCHED, 2, None)),
    ([{"ro_number": "RO-2"}], {}, (K.MATCHED, 3, None)),
    ([], {}, (K.EXCEPTION, None, K.INVOICE_MISSING)),
    ([{}, {"record_id": "erp-2"}], {}, (K.EXCEPTION, None, K.DUPLICATE_INVOICE)),
    ([{}] * 3, {}, (K.EXCEPTION, None, K.DUPLICATE_INVOICE)),
    ([{"outstanding_amount": 115, "amount": 115}], {}, (K.EXCEPTION, None, K.AMOUNT_MISMATCH)),
    ([{"outstanding_amount": 85, "credit": 15}], {}, (K.EXCEPTION, None, K.MISSING_CREDIT)),
    ([{"outstanding_amount": 95, "amount": 110, "credit": 15}], {}, (K.EXCEPTION, None, K.AMOUNT_MISMATCH)),
    ([{"status": "PENDING"}], {}, (K.EXCEPTION, None, K.PENDING_POSTING)),
    ([{"status": None}], {}, (K.EXCEPTION, None, K.PENDING_POSTING)),
    ([{}], {"outstanding_amount": None}, (K.EXCEPTION, None, K.AMOUNT_MISMATCH)),
    ([{}], {"invoice_number_normalized": None}, (K.EXCEPTION, None, K.INVOICE_MISSING)),
]


@pytest.mark.parametrize(("candidates", "row", "expected"), CASES)
def test_decisions(spark, candidates, row, expected):
    d = decide(spark, candidates, **row)
    assert (d.match_status, d.match_level, d.exception_category) == expected
    explained = d.match_reason if d.match_status == K.MATCHED else d.deterministic_reason
    assert explained
    alone = len(candidates) == 1 and row.get("invoice_number_normalized", "x") is not None
    assert d.reference_record_id == ("erp-1" if alone else None)


def test_reasons_in_full(spark):
    two = decide(spark, [{}, {"outstanding_amount": 90}])
    assert two.deterministic_reason == (
        "2 ERP records share invoice number 'SIN12200241' (expected exactly 1); the copies do NOT all agree on "
        "outstanding_amount -- review individually."
    )
    same = decide(spark, [{"outstanding_amount": None}, {"outstanding_amount": None}])
    assert "all copies have the same outstanding_amount" in same.deterministic_reason
    mixed = decide(spark, [{}, {"outstanding_amount": None}])
    assert "do NOT all agree" in mixed.deterministic_reason
    pending = decide(spark, [{"status": None}])
    assert pending.deterministic_reason == (
        "ERP record for invoice 'SIN12200241' has status=None, not POSTED -- not yet finished posting."
    )
    lost = decide(spark, [{"invoice_number": "24419074", "invoice_number_normalized": "24419074"}])
    assert lost.exception_category == K.INVOICE_MISSING
    assert "invoice_number='24419074'" in lost.deterministic_reason
    credit = decide(spark, [{"outstanding_amount": 85, "credit": 15}])
    assert "a credit of 15.00 was applied" in credit.deterministic_reason
    partly = decide(spark, [{"outstanding_amount": 95, "amount": 110, "credit": 15}])
    assert "does not fully explain" in partly.deterministic_reason


def test_orphans_and_summaries(spark):
    left = statement(
        spark,
        {"record_id": "s1", "invoice_number": "A1", "invoice_number_normalized": "A1", "work_order_number": "W1"},
        {"record_id": "s2", "invoice_number": "A2", "invoice_number_normalized": "A2", "shop": None, "work_order_number": None},
    )
    right = ledger(
        spark,
        {"record_id": "l1", "invoice_number": "A1", "invoice_number_normalized": "A1"},
        {"record_id": "l2", "invoice_number": "W1", "invoice_number_normalized": "W1"},
        {"record_id": "l3", "invoice_number": "Z9", "invoice_number_normalized": "Z9"},
        {"record_id": "l4", "invoice_number": None, "invoice_number_normalized": None},
        {"record_id": "l5", "invoice_number": "Z8", "invoice_number_normalized": "Z8", "shop": "only ledger"},
    )
    orphan_rows = gold.orphans(left, right)
    assert {r.record_id for r in orphan_rows.collect()} == {"l3", "l4", "l5"}
    classified = matching.classify(left, right)
    everything = gold.exceptions(classified, orphan_rows)
    assert everything.where("deterministic_reason IS NULL").isEmpty()
    # Reruns give the same rows, ids included.
    assert sorted(map(str, everything.collect())) == sorted(map(str, everything.collect()))
    shops = {r.shop: r for r in gold.reconciliation_summary(gold.shop_aggregates(classified, orphan_rows, right)).collect()}
    assert set(shops) == {"A", None}
    assert (shops["A"].matched_count, shops["A"].exception_count) == (1, 2)
    assert str(shops["A"].internal_erp_total) == "400.00" and str(shops["A"].difference) == "-300.00"
    assert (shops[None].matched_count, shops[None].exception_count, shops[None].overall_status) == (0, 0, "MINOR_VARIANCE")
    vendor = gold.vendor_summary(gold.shop_aggregates(classified, orphan_rows, right)).first()
    assert (vendor.total_invoices, vendor.matched_count, str(vendor.match_pct)) == (2, 1, "50.00")


def test_hot_key_is_split_and_result_whole(spark):
    """A third of all rows share one key: the join splits it, and no row is lost."""
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "48",
    }
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        n = 60_000
        rows = spark.range(0, n, 1, 8).select(
            F.col("id").cast("string").alias("record_id"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("key"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        )
        lookup = rows.groupBy("key").agg(F.count("*").alias("size"))
        joined = lookup_join(rows, lookup, ["key"])
        collected = joined.collect()
        assert len(collected) == n
        assert all(r["size"] == n // 3 for r in collected if r["key"] == "hot")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
        without = lookup_join(rows, lookup.where("key != 'hot'"), ["key"], "left_anti")
        assert without.count() == n // 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_hot_candidate_group_stays_one_row(spark):
    copies = ledger(spark, {}).crossJoin(spark.range(5000)).drop("id")
    group = matching.candidate_groups(copies).collect()
    assert [(g.candidate_count, g.copies_agree) for g in group] == [(5000, True)]


def test_periods_stay_apart(spark):
    """Numbers repeat between periods; each period is matched by itself."""
    may, april, june = "2026-05", "2026-04", "2026-06"

    def own(number, period, record):
        return {"invoice_number": number, "invoice_number_normalized": number, "statement_period": period, "record_id": record}

    rows = statement(
        spark, own("A1", april, "s1"), own("A1", may, "s2"), own("B1", may, "s3"),
        own("C1", june, "s4"), {**own("D1", june, "s5"), "work_order_number": "W1"},
    )
    booked = ledger(spark, own("A1", april, "l1"), own("A1", may, "l2"), own("B1", april, "l3"), own("C1", may, "l4"), own("W1", may, "l5"))
    got = {r["record_id"]: r["decision"] for r in matching.classify(rows, booked, MatchRules()).collect()}
    assert (got["s1"].match_level, got["s1"].reference_record_id) == (1, "l1")
    assert (got["s2"].match_level, got["s2"].reference_record_id) == (1, "l2")
    assert got["s3"].exception_category == got["s4"].exception_category == K.INVOICE_MISSING
    assert "W1" not in got["s5"].deterministic_reason
    assert {r["record_id"] for r in gold.orphans(rows, booked).collect()} == {"l3", "l4", "l5"}


def test_rows_without_a_work_order_to_look_up_move_once(spark):
    """Only rows whose number has no candidate look their work order up; the decision is the same with shared numbers."""
    rows = statement(
        spark, {"record_id": "s1"}, {"record_id": "s2", "invoice_number_normalized": "Q", "work_order_number": "W1"},
        {"record_id": "s3", "invoice_number_normalized": None, "work_order_number": "W1"}, {"record_id": "s4", "invoice_number_normalized": "Q", "work_order_number": None},
        {"record_id": "s5", "work_order_number": "W1"},
    )
    booked = ledger(spark, {}, {"record_id": "l2", "invoice_number": "W1", "invoice_number_normalized": "W1"})
    shared = matching.shared_numbers(rows, booked)
    got = {r["record_id"]: r["decision"] for r in matching.classify(rows, booked, MatchRules()).collect()}
    assert got == {r["record_id"]: r["decision"] for r in matching.classify(rows, booked, MatchRules(), shared).collect()}
    assert {k for k, d in got.items() if "W1" in (d.deterministic_reason or "")} == {"s2", "s3"} and len(got) == 5
    assert sorted(gold.orphans(rows, booked).collect()) == sorted(gold.orphans(rows, booked, shared).collect())
