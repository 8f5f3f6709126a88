"""Lookups and joins."""

from pyspark.sql import functions as F

from avalista.catalog.loan_view import dirty, loans, scored
from avalista.catalog.registry import query, rounded
from avalista.catalog.features import AMOUNT_SQL, SIZE_SQL
from avalista.functions.segments import SIZE_LABELS, amount_bucket, size_class
from avalista.operators import lookups as j
from avalista.operators import portfolio as p
from avalista.operators.calibration import segment_calibration

c = F.col
ODD = "CASE WHEN LoanNr % 101 = 0 THEN '99' ELSE SCIAN END"


def _with_odd_codes(view):
    """Some loans get a sector and a state that no dimension row explains."""
    return view.withColumns({
        "SCIAN": F.when(c("LoanNr") % 101 == 0, "99").otherwise(c("SCIAN")),
        "State": F.when(c("LoanNr") % 103 == 0, "ZZ").otherwise(c("State")),
    })


@query("sector_name_or_code", f"SELECT LoanNr, substring(coalesce(sector_name, code), 1, 20) AS sector FROM (SELECT LoanNr, {ODD} AS code FROM dirty) LEFT JOIN sectors ON code = sector_code")
def _(spark, sf):
    return j.with_sector_name(_with_odd_codes(dirty(spark, sf))).select("LoanNr", "sector")


@query("sector_name_or_text", f"SELECT LoanNr, substring(coalesce(sector_name, 'No especificado'), 1, 25) AS sector FROM (SELECT LoanNr, {ODD} AS code FROM loans) LEFT JOIN sectors ON code = sector_code")
def _(spark, sf):
    return j.with_sector_name(_with_odd_codes(loans(spark, sf)), fallback="No especificado", length=25).select("LoanNr", "sector")


@query("sector_name_or_null", f"SELECT LoanNr, sector_name AS sector FROM (SELECT LoanNr, {ODD} AS code FROM loans) LEFT JOIN sectors ON code = sector_code")
def _(spark, sf):
    return j.with_sector_name(_with_odd_codes(loans(spark, sf)), fallback=None, length=None).select("LoanNr", "sector")


@query("sector_info", f"SELECT LoanNr, coalesce(base_rate, 0.07e0) AS base_rate, coalesce(volatility, 'media') AS volatility FROM (SELECT LoanNr, {ODD} AS code FROM loans) LEFT JOIN sectors ON code = sector_code")
def _(spark, sf):
    return j.with_sector_info(_with_odd_codes(loans(spark, sf))).select("LoanNr", "base_rate", "volatility")


@query("state_name", "SELECT LoanNr, substring(coalesce(state_name, code), 1, 15) AS state_label FROM (SELECT LoanNr, CASE WHEN LoanNr % 103 = 0 THEN 'ZZ' ELSE State END AS code FROM loans) LEFT JOIN states ON code = state_code")
def _(spark, sf):
    return j.with_state_name(_with_odd_codes(loans(spark, sf))).select("LoanNr", "state_label")


@query("unknown_codes", """SELECT 'SCIAN' AS dimension, '99' AS code, count(*) AS n_loans FROM loans WHERE LoanNr % 101 = 0
  UNION ALL SELECT 'State', 'ZZ', count(*) FROM loans WHERE LoanNr % 103 = 0""")
def _(spark, sf):
    return j.unknown_codes(_with_odd_codes(loans(spark, sf)))


@query("complete_categories", f"""SELECT size_class, i::INTEGER AS size_class_ord, coalesce(n, 0) AS n, round(default_rate, 8) AS default_rate
  FROM (SELECT unnest(['Micro','Pequeña','Mediana','Grande']) AS size_class, generate_subscripts(['Micro','Pequeña','Mediana','Grande'], 1) AS i)
  LEFT JOIN (SELECT {SIZE_SQL} AS size_class, count(*) AS n, avg("Default") AS default_rate FROM loans WHERE NoEmp <= 250 GROUP BY 1) USING (size_class)""")
def _(spark, sf):
    small = loans(spark, sf).filter(c("NoEmp") <= 250)
    rates = p.default_rate_by(small, size_class(), "size_class")
    return rounded(j.complete_categories(rates, "size_class", SIZE_LABELS), default_rate=8)


@query("restrict_to", """SELECT State, round(avg(GrAppv), 4) AS mean_amount FROM loans WHERE State IN (
  SELECT State FROM loans GROUP BY State HAVING count(*) >= 50 ORDER BY count(*) DESC, State LIMIT 15) GROUP BY State""")
def _(spark, sf):
    view = loans(spark, sf)
    amounts = view.groupBy("State").agg(F.avg("GrAppv").alias("mean_amount"))
    return rounded(j.restrict_to(amounts, p.top_states(view), "State"), mean_amount=4)


@query("attach_predictions", "SELECT LoanNr, GrAppv, ChgOffPrinGr, pd, lgd, el FROM scored")
def _(spark, sf):
    predictions = scored(spark, sf).select("LoanNr", "pd", "lgd", "el")
    return j.attach_predictions(loans(spark, sf).select("LoanNr", "GrAppv", "ChgOffPrinGr"), predictions)


@query("apply_segment_factors", f""", seg AS (SELECT {AMOUNT_SQL} AS bucket, sum(ChgOffPrinGr) / sum(el) AS factor FROM scored WHERE GrAppv > 200000 GROUP BY 1)
  SELECT LoanNr, s.bucket, round(coalesce(factor, 1e0), 8) AS segment_factor, round(el * coalesce(factor, 1e0), 4) AS el_segment
  FROM (SELECT *, {AMOUNT_SQL} AS bucket FROM scored) s LEFT JOIN seg ON s.bucket = seg.bucket""")
def _(spark, sf):
    view = scored(spark, sf).withColumn("bucket", amount_bucket())
    factors = segment_calibration(view.filter(c("GrAppv") > 200000), "bucket")
    out = j.apply_segment_factors(view, factors, "bucket").select("LoanNr", "bucket", "segment_factor", "el_segment")
    return rounded(out, segment_factor=8, el_segment=4)
