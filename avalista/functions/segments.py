"""Segment labels. Each bucket has a label and an ``*_ord`` integer for sorting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket edges and labels; intervals are open on the left, closed on the right.
AMOUNT_EDGES = [0.0, 200000.0, 500000.0, 1000000.0, None]
AMOUNT_LABELS = ["<$200K", "$200K-500K", "$500K-1M", ">$1M"]
SIZE_EDGES = [0, 10, 50, 250, 1000]
SIZE_LABELS = ["Micro", "Pequeña", "Mediana", "Grande"]
SIZE_LABELS_LONG = ["Micro (≤10)", "Pequeña (11-50)", "Mediana (51-250)", "Grande (>250)"]
TERM_LABELS = ["<2 años", "2-5 años", "5-10 años", ">10 años"]
PORTION_LABELS = ["Con NAFIN (≥70%)", "Con NAFIN (50-70%)", "Con NAFIN (<50%)", "Sin NAFIN"]
BUSINESS_LABELS = ["Existente", "Nuevo"]
CRISIS_WINDOWS = [("2020-03-01", "2021-07-01")]
RATE_RED, RATE_AMBER = 0.10, 0.07


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def right_closed(value, edges, results) -> Column:
    """``results[i]`` where ``edges[i] < value <= edges[i+1]``; a last edge of None is unbounded."""
    value = _col(value)
    out = F.when(value <= F.lit(edges[0]), F.lit(None))
    for upper, result in zip(edges[1:], results):
        inside = value.isNotNull() if upper is None else value <= F.lit(upper)
        out = out.when(inside, F.lit(result))
    return out


def _ordinals(labels):
    return list(range(1, len(labels) + 1))


def amount_bucket(amount="GrAppv") -> Column:
    return right_closed(amount, AMOUNT_EDGES, AMOUNT_LABELS)


def amount_bucket_ord(amount="GrAppv") -> Column:
    return right_closed(amount, AMOUNT_EDGES, _ordinals(AMOUNT_LABELS))


def size_class(employees="NoEmp", long: bool = False) -> Column:
    return right_closed(employees, SIZE_EDGES, SIZE_LABELS_LONG if long else SIZE_LABELS)


def size_class_ord(employees="NoEmp") -> Column:
    return right_closed(employees, SIZE_EDGES, _ordinals(SIZE_LABELS))


def _term_case(term, results) -> Column:
    term = _col(term)
    return (
        F.when(term < 24, F.lit(results[0]))
        .when(term <= 60, F.lit(results[1]))
        .when(term <= 120, F.lit(results[2]))
        .when(term > 120, F.lit(results[3]))
    )


def term_bucket(term="Term") -> Column:
    return _term_case(term, TERM_LABELS)


def term_bucket_ord(term="Term") -> Column:
    return _term_case(term, _ordinals(TERM_LABELS))


def _portion_case(portion, results) -> Column:
    portion = _col(portion)
    return (
        F.when(portion >= 0.70, F.lit(results[0]))
        .when(portion >= 0.50, F.lit(results[1]))
        .when(portion > 0, F.lit(results[2]))
        .when(portion == 0, F.lit(results[3]))
    )


def portion_band(portion="Portion") -> Column:
    return _portion_case(portion, PORTION_LABELS)


def portion_band_ord(portion="Portion") -> Column:
    return _portion_case(portion, _ordinals(PORTION_LABELS))


def crisis_flag(date="ApprovalDate", windows=None) -> Column:
    """True inside a half-open date window; plain comparisons, so the scan can prune on them."""
    date = _col(date)
    hit = F.lit(False)
    for start, end in windows or CRISIS_WINDOWS:
        hit = hit | ((date >= F.lit(start).cast("date")) & (date < F.lit(end).cast("date")))
    return hit


def business_label(is_new) -> Column:
    return F.when(_col(is_new) == 1, F.lit(BUSINESS_LABELS[1])).when(_col(is_new) == 0, F.lit(BUSINESS_LABELS[0]))


def approval_year(date="ApprovalDate") -> Column:
    return F.year(_col(date))


def days_term(term="Term") -> Column:
    return _col(term) * 30


def revline_flag(flag="RevLineCr") -> Column:
    return F.coalesce((_col(flag) == "Y").cast("int"), F.lit(0))


def rate_light(rate) -> Column:
    rate = _col(rate)
    return (
        F.when(rate > RATE_RED, F.lit("red"))
        .when(rate > RATE_AMBER, F.lit("amber"))
        .when(rate.isNotNull(), F.lit("green"))
    )


def term_band_for_amount(amount="GrAppv") -> Column:
    """Amount band that decides which terms are usual."""
    amount = _col(amount)
    return (
        F.when(amount < 200000, F.lit("<200K"))
        .when(amount < 500000, F.lit("200K-500K"))
        .when(amount < 2000000, F.lit("500K-2M"))
        .when(amount.isNotNull(), F.lit(">=2M"))
    )
