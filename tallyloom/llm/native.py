"""Column expressions shared by the operators that stay within SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


#: ASCII characters other than letters and digits.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def word_line(text: Column) -> Column:
    """The words of a text, A-Z in lower case, each between single spaces: ` one two three `.

    A word is a maximal run of ASCII letters, digits and characters beyond ASCII. One translation makes
    every separator a space; three plain replacements then make runs of spaces one (the two marks used for
    that are separators themselves, so no text still holds them). No regex runs over the text.
    """
    spaced = F.concat(F.lit(" "), F.translate(text, BETWEEN + UPPER, " " * len(BETWEEN) + LOWER), F.lit(" "))
    marked = F.replace(F.replace(spaced, F.lit(" "), F.lit("<>")), F.lit("><"), F.lit(""))
    return F.replace(marked, F.lit("<>"), F.lit(" "))


def found(text: Column, pattern: str | Column, measure=F.length) -> Column:
    """All non-overlapping matches, leftmost first: array of (start, end, value), in units of `measure`.

    Spark tells what matched but not where. Splitting by the same pattern gives the text between the matches,
    and the measures of both, summed up alternately, are the places.
    """
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern
    values, gaps = F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, rx, -1)
    steps = F.zip_with(values, gaps, lambda v, g: F.struct(v.alias("value"), measure(g).cast("int").alias("gap"), measure(v).cast("int").alias("size")))
    spans = F.aggregate(
        F.filter(steps, lambda s: s["value"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans")),
        lambda a, s: F.struct(
            (a["at"] + s["gap"] + s["size"]).alias("at"),
            F.concat(a["spans"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + s["size"]).alias("end"), s["value"].alias("value")))).alias("spans"),
        ),
    )
    return spans["spans"]


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string>>")
