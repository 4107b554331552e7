"""Argument checks. A failing row is marked, it never fails the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted argument ranges.
MAX_TEXT = 100
MIN_LIMIT, MAX_LIMIT = 1, 50
MIN_NUMBER, MAX_NUMBER = 0, 200_000

OK, INVALID = "ok", "invalid"


def valid_suggest(qstr: Column, limit: Column, min_chars: int = 0) -> Column:
    chars = F.length(F.coalesce(qstr, F.lit("")))
    return chars.between(min_chars, MAX_TEXT) & (limit.isNull() | limit.between(MIN_LIMIT, MAX_LIMIT))


def valid_number(number: Column) -> Column:
    return F.coalesce(number.between(MIN_NUMBER, MAX_NUMBER), F.lit(False))


def valid_crossing(street1: Column, street2: Column) -> Column:
    def one(s: Column) -> Column:
        return F.length(s).between(1, MAX_TEXT)

    return F.coalesce(one(street1) & one(street2), F.lit(False))


def status(valid: Column) -> Column:
    return F.when(valid, F.lit(OK)).otherwise(F.lit(INVALID))
