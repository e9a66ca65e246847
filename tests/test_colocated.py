"""Matching of sides stored by the key: the same answers, no shuffle of either side, hot keys on the other way."""

import re

import pytest
from pyspark.sql import functions as F

from tallyloom.config import MatchRules
from tallyloom.operators import gold, matching
from tallyloom.plans import reconcile
from tallyloom.sources import colocated, orders
from tallyloom.sources.staging import stored

SF = "/root/testdata/sf0.001"
NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture(scope="module")
def silver(spark):
    bronze = orders.statement_bronze(spark, SF)
    statement = orders.statement_silver(bronze)
    ledger = orders.ledger_silver(orders.ledger_bronze(orders.planted(statement)))
    return tuple(stored(side) for side in orders.with_rare_cases(statement, ledger))


@pytest.fixture(scope="module")
def sides(spark, silver):
    made = colocated.store(*silver, matching.KEY, per_bucket=400)
    yield made
    colocated.drop(spark, made)


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def with_options(spark, options, work):
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        return work()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def order(rows):
    return sorted(map(str, rows.collect()))


def test_same_answers_as_by_shuffling(spark, silver, sides):
    shared = stored(matching.shared_numbers(*silver))
    assert sides.even and shared.count() > 0
    columns = ["record_id", "statement_period", "invoice_number", "decision.*"]
    rules = MatchRules()
    assert order(matching.classify_stored(sides, shared, rules).select(*columns)) == order(matching.classify(*silver, rules).select(*columns))
    assert order(matching.orphans_stored(sides, shared).select("record_id")) == order(gold.orphans(*silver).select("record_id"))
    uneven = colocated.Sides(*silver, sides.keys, False)
    assert order(matching.classify_stored(uneven, shared, rules).select(*columns)) == order(matching.classify(*silver, rules).select(*columns))
    assert order(matching.orphans_stored(uneven, shared).select("record_id")) == order(gold.orphans(*silver).select("record_id"))


def test_neither_side_is_shuffled(spark, silver, sides):
    """Broadcasts are switched off, so nothing is spared by being small."""
    shared = stored(matching.shared_numbers(*silver))

    def exchanges():
        candidates = matching.attach_candidates(sides.statement, sides.ledger, stored_by_key=True)
        numbers = sides.statement.select(*matching.KEY).dropna().distinct()
        classified, orphans = matching.classify_stored(sides, shared), matching.orphans_stored(sides, shared)
        for frame in (candidates, numbers):
            frame.write.format("noop").mode("overwrite").save()
        count = lambda rows: len(re.findall(r"\bExchange\b", plan(rows)))
        return count(candidates), count(numbers), count(classified) + count(orphans), plan(candidates)

    alone, distinct, in_all, text = with_options(spark, NO_BROADCAST, exchanges)
    # The four left are those of the look-ups of work orders: rows and numbers, for the statement and for the ledger.
    assert (alone, distinct) == (0, 0) and in_all <= 4
    assert "SortAggregate" not in text and "HashAggregate" in text


def test_shared_numbers_take_one_shuffle(spark, silver):
    text = with_options(spark, NO_BROADCAST, lambda: plan(matching.shared_numbers(*silver)))
    assert len(re.findall(r"\bExchange\b", text)) == 1 and "SortAggregate" not in text


def test_hot_bucket_goes_the_way_that_splits(spark, silver):
    """A third of all lines and records have one number: the buckets are uneven, and the decisions stay the same."""
    hot = [
        side.withColumn("invoice_number_normalized", F.when(F.xxhash64("record_id") % 3 == 0, "HOT").otherwise(F.col("invoice_number_normalized")))
        .withColumn("vendor_id", F.lit("V1")).withColumn("statement_period", F.lit("1997-05"))
        for side in silver
    ]
    hot = [stored(side) for side in hot]
    made = colocated.store(*hot, matching.KEY, per_bucket=100, hot_rows=100)
    assert not made.even
    shared = stored(matching.shared_numbers(*hot))
    columns = ["record_id", "decision.*"]
    assert order(matching.classify_stored(made, shared).select(*columns)) == order(matching.classify(*hot).select(*columns))
    # Also the local way never pairs the copies of a hot number with each other.
    local = matching.attach_candidates(made.statement, made.ledger, stored_by_key=True)
    assert local.count() == hot[0].count()


def test_gold_tables_are_the_same(spark, silver):
    both = stored(silver[0].unionByName(silver[1]))
    plain, stored_by_key = (reconcile.to_gold(both, keep=stored, colocate=c) for c in (False, True))
    for name, rows in plain.items():
        assert order(stored_by_key[name]) == order(rows) and stored_by_key[name].schema == rows.schema, name


def test_bucket_counts():
    assert [colocated.bucket_count(n, 100) for n in (0, 1, 100, 101, 350, 10_000)] == [1, 1, 1, 2, 4, 128]
    assert colocated.bucket_count(10**11, 2_000_000) == 65_536


def test_empty_sides(spark, silver):
    made = colocated.store(*[stored(side.limit(0)) for side in silver], matching.KEY)
    assert made.even and matching.classify_stored(made, matching.shared_numbers(*silver)).count() == 0


def test_buckets_of_a_large_side_are_many(spark):
    """a million rows make as many tasks as a small cluster has cores, whose sorts stay small."""
    side = stored(spark.range(600_000).selectExpr("'V' AS vendor_id", "'P' AS statement_period", "cast(id AS string) AS invoice_number_normalized"))
    made = colocated.store(side, side, matching.KEY)
    try:
        assert len(made.statement.inputFiles()) == 4 and made.even and made.ledger.count() == 600_000
    finally:
        colocated.drop(spark, made)


def test_plan_draws_only_what_a_label_asks_for(spark):
    """random choices are hashes; rows whose label does not use one have none."""
    plan_ = orders.planted(orders.statement_silver(orders.statement_bronze(spark, SF)))
    drawn = {"_suffix": "invoice_revision", "_sign": "amount_mismatch", "_variance": "amount_mismatch", "_credit": "missing_credit"}
    for column, label in drawn.items():
        assert {r[0] for r in plan_.where(F.col(column).isNotNull()).select("scenario_type").distinct().collect()} <= {label}
    assert plan_.where("scenario_type = 'amount_mismatch' AND (_sign IS NULL OR _variance IS NULL)").isEmpty()
