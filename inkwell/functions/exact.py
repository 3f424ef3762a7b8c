"""Exact decimal arithmetic in whole hundredths, halves rounded away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hundredths(text: Column) -> Column:
    """A decimal text as whole hundredths; a comma counts as a point; null for anything else or more than two places."""
    t = F.replace(F.trim(text), F.lit(","), F.lit("."))
    return F.when(t.rlike(r"^[+-]?[0-9]+(\.[0-9]{1,2})?$"), (t.cast("decimal(30,2)") * 100).cast("bigint"))


def quotient(num: Column, den: int) -> Column:
    half = den // 2
    return F.when(num < 0, -F.floor((-num + half) / F.lit(den).cast("decimal(20,0)"))).otherwise(F.floor((num + half) / F.lit(den).cast("decimal(20,0)"))).cast("bigint")


def times(a: Column, quantity: Column) -> Column:
    return quotient(a * quantity, 100)


def percent(a: Column, rate: Column) -> Column:
    return quotient(a * rate, 10_000)


def backoff(attempt: Column, base: int = 1_000, most: int = 300_000) -> Column:
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)))).cast("bigint")
