"""Text in and out: parsing application forms, formatting report labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Answers that mean yes.
YES_WORDS = ["s", "si", "sí", "y", "yes"]


def yes_no(text) -> Column:
    return F.coalesce(F.lower(text).isin(*YES_WORDS), F.lit(False))


def state_code(text) -> Column:
    return F.upper(F.trim(text))


def sector_code(text) -> Column:
    return F.substring(F.trim(text), 1, 2)


def number(text) -> Column:
    return F.trim(text).try_cast("double")


def whole_number(text) -> Column:
    return F.trim(text).try_cast("int")


def money_label(amount, decimals: int = 0) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, decimals))


def percent_label(share, decimals: int = 1) -> Column:
    """A share as text, rounded half-even and without thousand separators."""
    return F.concat(F.replace(F.format_number(share * 100, decimals), F.lit(","), F.lit("")), F.lit("%"))


def plain_label(number, decimals: int = 2) -> Column:
    return F.replace(F.format_number(number, decimals), F.lit(","), F.lit(""))
