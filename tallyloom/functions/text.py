"""Text columns: rendered messages, number normalisation, field checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom import contract as K

# A number as Python's float() reads it: digits may be grouped by single underscores.
_DIGITS = r"\d(?:_?\d)*"
_FLOAT = (
    rf"(?i)^\s*[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|inf(?:inity)?|nan)\s*$"
)


def strip(c: Column) -> Column:
    """Drop leading and trailing white space of every kind, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def render(template: str, **parts: Column) -> Column:
    """Fill `{name}` slots of a message template with columns."""
    pieces = re.split(r"\{(\w+)\}", template)
    columns = [
        parts[piece] if position % 2 else F.lit(piece)
        for position, piece in enumerate(pieces)
        if position % 2 or piece
    ]
    return F.concat(*columns)


def quoted(c: Column) -> Column:
    """A value as Python's repr() shows it: quoted text, or None for NULL."""
    text = c
    for raw, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    single = c.contains("'")
    return (
        F.when(c.isNull(), "None")
        .when(single & ~c.contains('"'), F.concat(F.lit('"'), text, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def shown(c: Column) -> Column:
    """A number as str() shows it, None for NULL."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def number_shown(c: Column) -> Column:
    """A number's text as Python's str() shows the number: whole numbers as they are, others shortest."""
    double = c.try_cast("double").cast("string")
    small = r"^(-?)(\d)\.(\d+)E-(\d+)$"
    part = lambda i: F.regexp_extract(double, small, i)
    rest = F.when(part(3) == "0", "").otherwise(part(3))
    exponent = F.concat(part(1), part(2), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("e-"), F.lpad(part(4), F.greatest(F.length(part(4)), F.lit(2)), F.lit("0")))
    return (
        F.when(c.rlike(r"^-?\d+$"), c)
        .when(double.rlike(r"E-4$"), F.concat(part(1), F.lit("0.000"), part(2), rest))
        .when(double.rlike(small), exponent)
        .otherwise(double)
    )


# A suffix that starts with a sign of its own: that character, then at most one class of others, to the end.
_SIGNED = re.compile(r"(?P<sign>\\?[^\\\[\](){}.*+?^$|])(?:(?P<others>\[(?:[^\]\\^]|\\.)+\]|\\d)[+*]?)?\$")
_LINE_ENDS = r"[\n\r\u0085\u2028\u2029]"


def all_suffixes(patterns: Sequence[str]) -> str | None:
    """One expression for all suffixes at a value's end, or None where the order in which they go may matter.

    If each suffix starts with a sign that no suffix holds further on, a row of suffixes can be read in one way only: the signs
    cut it. Then stripping one after the other ends where the longest such row starts, provided that something stays in front.
    """
    parts = [_SIGNED.fullmatch(p) for p in patterns]
    if not parts or not all(parts):
        return None
    signs = [p["sign"].removeprefix("\\") for p in parts]
    if any(p["others"] and re.fullmatch(p["others"], sign) for p in parts for sign in signs):
        return None
    # Possessive: a row that is read once is not read again in another way. The first place it fits is the longest row's.
    return rf"(?s)(?<=.)(?:{'|'.join(f'(?:{p[:-1]})' for p in patterns)})++$"


def normalize_number(raw: Column, patterns: Sequence[str]) -> Column:
    """Strip revision suffixes until none is left; a suffix goes only when something stays in front of it.

    Suffixes that can be told apart by their signs go all at once, with one expression. Others go in rounds, and so do values
    with line ends in them, before which an end anchor would match as well.
    """
    one = all_suffixes(patterns)
    if one is None:
        return _in_rounds(raw, patterns)
    base = strip(raw)
    return F.when(base.rlike(_LINE_ENDS), _in_rounds(raw, patterns)).otherwise(F.regexp_replace(base, one, ""))


def _in_rounds(raw: Column, patterns: Sequence[str]) -> Column:
    """The look-ahead leaves a value alone when its leftmost hit starts at position 0. Every round that
    changes a value shortens it, so as many rounds as it has characters reach the end. Most numbers
    carry no suffix at all: one combined test guards the rounds, and each of them.
    """
    base = strip(raw)
    if not patterns:
        return base
    revised = "|".join(f"(?:{p})" for p in patterns)

    def shortened(value: Column, _: Column) -> Column:
        result = value
        for p in patterns:
            result = F.regexp_replace(result, f"(?s)^(?!(?:{p}))(?<kept>.+?)(?:{p}).*$", "${kept}")
        return F.when(value.rlike(revised), result).otherwise(value)

    rounds = F.sequence(F.lit(1), F.length(base))
    return F.when(base.rlike(revised), F.aggregate(rounds, base, shortened)).otherwise(base)


def normalize_number_by(raw: Column, patterns: Column) -> Column:
    """Same as `normalize_number`, with the patterns held in an array column (many vendors in one job).

    An empty or NULL array leaves the stripped text as it is.
    """
    base = strip(raw)
    known = F.coalesce(patterns, F.array().cast("array<string>"))
    reduced = F.aggregate(
        F.flatten(F.array_repeat(known, F.length(base))),
        base,
        lambda text, p: F.regexp_replace(
            text,
            F.concat(F.lit("(?s)^(?!(?:"), p, F.lit("))(?<kept>.+?)(?:"), p, F.lit(").*$")),
            F.lit("${kept}"),
        ),
    )
    return F.when(F.exists(known, lambda p: F.rlike(base, p)), reduced).otherwise(base)


def looks_like_date(c: Column) -> Column:
    return c.rlike(K.DATE_LIKE)


def is_numeric(c: Column) -> Column:
    """True where Python's float() would accept the text."""
    return c.rlike(_FLOAT)


def conforms(c: Column, pattern: str) -> Column:
    """Case-insensitive match from the start of the value; never rejects, only flags."""
    return c.rlike(f"(?i)^(?:{pattern})")


def header_value(text: Column, pattern: str) -> Column:
    """First group of the first hit, trimmed; NULL when the pattern is not found."""
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def error_bucket(success: Column, error: Column) -> Column:
    """Bucket a call's free-text error into a small set of status codes."""
    low = F.lower(error)
    bucket = F.when(success, K.STATUS_SUCCESS).when(
        error.isNull() | (error == ""), K.STATUS_UNKNOWN
    )
    for part, code in K.ERROR_CONTAINS:
        bucket = bucket.when(low.contains(part), code)
    for part, code in K.ERROR_STARTS_WITH:
        bucket = bucket.when(low.startswith(part), code)
    return bucket.otherwise(K.STATUS_UNKNOWN)
