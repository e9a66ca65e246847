"""Date columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(c: Column, fmt: str) -> Column:
    """NULL, never an error, where the text does not follow the format."""
    return F.try_to_date(c, fmt)


def date_text(c: Column, fmt: str) -> Column:
    return F.date_format(c, fmt)


def period_of(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")
