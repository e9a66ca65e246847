"""Money columns. Amounts are DECIMAL; only the tolerance test works in binary doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom import contract as K
from tallyloom.functions.text import is_numeric, strip

AMOUNT = "decimal(12,2)"
TOTAL = "decimal(14,2)"
PERCENT = "decimal(5,2)"
CONFIDENCE = "decimal(5,4)"


def parse_money(c: Column) -> Column:
    """Keep digits, point and minus, then read as DECIMAL(12,2); NULL if that is not a number."""
    return F.regexp_replace(c, K.MONEY_NOISE, "").try_cast(AMOUNT)


def loose_money(c: Column) -> Column:
    """The looser reading used for control totals: drop `$`, `,` and blanks; exact, so that sums are."""
    return F.regexp_replace(c, K.LOOSE_MONEY_NOISE, "").try_cast("decimal(28,6)")


def canonical_amount(c: Column) -> Column:
    """`48.750` and `48.75` become one text; anything that is not a number stays as it is."""
    plain = F.replace(strip(c), F.lit("_"), F.lit(""))
    return F.coalesce(F.when(is_numeric(c), plain.try_cast("decimal(38,2)").cast("string")), c)


def credit_of(amount: Column, outstanding: Column) -> Column:
    """A credit exists only where the original amount exceeds what is still outstanding."""
    return F.when(amount > outstanding, (amount - outstanding).cast(AMOUNT))


def amount_equal(a: Column, b: Column, tolerance: float) -> Column:
    """Within tolerance as binary doubles; never NULL."""
    return F.coalesce(
        F.abs(a.cast("double") - b.cast("double")) <= F.lit(float(tolerance)), F.lit(False)
    )


def percent(part: Column, whole: Column) -> Column:
    return F.round(part / whole * 100, 2).cast(PERCENT)


def confidence(c: Column) -> Column:
    return c.try_cast(CONFIDENCE)


def cents(c: Column) -> Column:
    """A DECIMAL amount as whole cents."""
    return (c * 100).cast("bigint")


def cents_text(c: Column) -> Column:
    """Whole cents as a plain two-decimal text."""
    return (c.cast("decimal(16,0)") / 100).cast(TOTAL).cast("string")
