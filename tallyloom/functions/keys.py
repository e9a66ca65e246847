"""Hash keys and hash-derived numbers: the same input always gives the same value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom import contract as K


def record_id(source: str, *parts: Column) -> Column:
    """SHA-256 over the parts; NULL parts are skipped, as the table contract has it."""
    return F.sha2(F.concat_ws("|", F.lit(source), *[p.cast("string") for p in parts]), 256)


def statement_record_id(vendor: Column, number: Column, outstanding: Column, statement: Column) -> Column:
    return record_id(K.STATEMENT_SOURCE, vendor, number, outstanding, statement)


def ledger_record_id(
    vendor: Column, number: Column, outstanding: Column, statement: Column, row_number: Column
) -> Column:
    """The row number keeps intentional duplicates apart."""
    return record_id(K.LEDGER_SOURCE, vendor, number, outstanding, statement, row_number)


def stable_id(kind: str, *parts: Column) -> Column:
    """An id that a rerun reproduces. NULL parts are marked, so positions never shift."""
    return F.sha2(
        F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]), 256
    )


def hash_number(seed: int, salt: str, key: Column) -> Column:
    """A whole number in [0, 2^32) from a seed, a salt and a key."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
