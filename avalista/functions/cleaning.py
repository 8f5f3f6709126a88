"""Cleaning and feature expressions for one loan row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_scian(code) -> Column:
    """Two-character sector code; empty markers become ``'00'``."""
    two = F.substring(code.cast("string"), 1, 2)
    return F.when(two.isNull() | two.isin("0", "na"), F.lit("00")).otherwise(two)


def whole(number) -> Column:
    """Missing counts as zero; fractions are dropped."""
    return F.coalesce(number.cast("double"), F.lit(0.0)).cast("int")


def money(number) -> Column:
    return F.coalesce(number.cast("double"), F.lit(0.0))


def ratio_or_zero(top, bottom) -> Column:
    return F.when(bottom > 0, F.try_divide(top, bottom)).otherwise(F.lit(0.0))


def nafin_portion(guaranteed, amount) -> Column:
    return ratio_or_zero(guaranteed, amount)


def loan_per_employee(amount, employees) -> Column:
    return ratio_or_zero(amount, employees + 1)


def term_years(term) -> Column:
    return term / F.lit(12.0)


def debt_to_nafin(amount, guaranteed) -> Column:
    return amount - guaranteed


def log_amount(amount) -> Column:
    return F.log1p(amount)


def flag(value) -> Column:
    return F.coalesce(value.cast("int"), F.lit(0))


def is_urban(code) -> Column:
    return F.coalesce((code == 1).cast("int"), F.lit(0))
