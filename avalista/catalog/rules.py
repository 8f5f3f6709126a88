"""Rule scores and propensities."""

from pyspark.sql import functions as F

from avalista.catalog.features import AMOUNT_SQL, SIZE_SQL
from avalista.catalog.loan_view import loans
from avalista.catalog.registry import query, rounded
from avalista.functions.segments import amount_bucket, size_class
from avalista.operators import rules as r

c = F.col

SCORE_SQL = """mult AS (
  SELECT l.*, coalesce(s.base_rate, 0.07e0) AS base_rate, coalesce(s.volatility, 'media') AS volatility,
    GrAppv / greatest(NoEmp * 80000e0, 1e0) AS ratio, coalesce(st.tier, 'low') AS tier
  FROM loans l LEFT JOIN sectors s ON SCIAN = sector_code LEFT JOIN states st ON State = state_code
), rule AS (
  SELECT *, least(greatest(base_rate * (
      CASE WHEN NewExist = 1 THEN CASE volatility WHEN 'alta' THEN 1.8e0 WHEN 'media' THEN 1.5e0 ELSE 1.3e0 END ELSE 0.85e0 END
    * CASE WHEN NoEmp <= 3 THEN 1.4e0 WHEN NoEmp <= 10 THEN 1.15e0 WHEN NoEmp <= 50 THEN 1e0 WHEN NoEmp <= 250 THEN 0.8e0 ELSE 0.6e0 END
    * CASE WHEN Portion >= 0.7e0 THEN 0.65e0 WHEN Portion >= 0.5e0 THEN 0.75e0 WHEN Portion > 0 THEN 0.85e0 ELSE 1e0 END
    * CASE WHEN RealEstate = 1 THEN 0.75e0 ELSE 1e0 END
    * CASE WHEN ratio > 8 THEN 1.35e0 WHEN ratio > 5 THEN 1.2e0 WHEN ratio > 3 THEN 1.1e0 WHEN ratio < 1 THEN 0.9e0 ELSE 1e0 END
    * CASE WHEN Term > 84 THEN 1.25e0 WHEN Term > 60 THEN 1.15e0 WHEN Term < 18 THEN 0.95e0 ELSE 1e0 END
    * CASE tier WHEN 'high' THEN 0.85e0 WHEN 'medium' THEN 1e0 ELSE 1.15e0 END
    * CASE WHEN UrbanRural = 2 THEN 1.2e0 ELSE 1e0 END
    * CASE WHEN Recession = 1 THEN CASE WHEN volatility = 'alta' THEN 1.7e0 ELSE 1.4e0 END ELSE 1e0 END), 0.02e0), 0.40e0) AS score
  FROM mult
), rule_pd AS (
  SELECT *, CASE WHEN score > 0.25e0 THEN 0.8e0 WHEN score > 0.15e0 THEN score * 2.5e0 WHEN score > 0.08e0 THEN score * 1.5e0 WHEN score > 0.04e0 THEN score ELSE 0.03e0 END AS rpd
  FROM rule
)"""
LGD_SQL = "CASE WHEN Portion > 0 AND RealEstate = 1 THEN 0.20e0 WHEN Portion > 0 THEN 0.25e0 WHEN RealEstate = 1 THEN 0.35e0 ELSE 0.75e0 END"


@query("risk_score", f", {SCORE_SQL} SELECT LoanNr, score AS risk_score FROM rule")
def _(spark, sf):
    return r.risk_score(loans(spark, sf, customer=True)).select("LoanNr", "risk_score")


@query("score_to_pd", f", {SCORE_SQL} SELECT LoanNr, rpd AS rule_pd FROM rule_pd")
def _(spark, sf):
    return r.score_to_pd(r.risk_score(loans(spark, sf, customer=True))).select("LoanNr", "rule_pd")


@query("rule_lgd_rate", f"SELECT LoanNr, {LGD_SQL} AS rule_lgd_rate FROM loans")
def _(spark, sf):
    return r.rule_lgd(loans(spark, sf)).select("LoanNr", "rule_lgd_rate")


@query("rule_loss_given_default", f"SELECT LoanNr, round(GrAppv * ({LGD_SQL}) * 0.6e0, 2) AS rule_loss FROM loans")
def _(spark, sf):
    return r.rule_lgd(loans(spark, sf)).select("LoanNr", "rule_loss")


@query("rule_expected_loss", f", {SCORE_SQL} SELECT LoanNr, rpd * round(GrAppv * ({LGD_SQL}) * 0.6e0, 2) AS rule_el FROM rule_pd")
def rule_expected_loss(spark, sf):
    return r.rule_expected_loss(loans(spark, sf, customer=True)).select("LoanNr", "rule_el")


@query("reference_rate", f"""SELECT LoanNr, least(greatest(12e0 + CASE {SIZE_SQL} WHEN 'Micro' THEN 4e0 WHEN 'Pequeña' THEN 2e0 ELSE 0e0 END
  + CASE WHEN NewExist = 1 THEN 3e0 ELSE 0e0 END + CASE WHEN volatility = 'alta' THEN 2e0 ELSE 0e0 END, 8e0), 28e0) AS reference_rate FROM loans LEFT JOIN sectors ON SCIAN = sector_code""")
def _(spark, sf):
    return r.reference_rate(loans(spark, sf, customer=True)).select("LoanNr", "reference_rate")


GUARANTEE_SQL = f"""least(CASE WHEN SCIAN IN ('31','32','33') THEN 0.5e0 WHEN SCIAN = '11' THEN 0.45e0 WHEN SCIAN IN ('54','51') THEN 0.4e0 WHEN SCIAN IN ('72','71') THEN 0.2e0 ELSE 0.35e0 END
  * CASE {SIZE_SQL} WHEN 'Grande' THEN 1.3e0 WHEN 'Mediana' THEN 1.15e0 WHEN 'Micro' THEN 0.85e0 ELSE 1e0 END, 0.7e0)"""
COLLATERAL_SQL = f"""least(CASE {SIZE_SQL} WHEN 'Grande' THEN 0.6e0 WHEN 'Mediana' THEN 0.45e0 WHEN 'Pequeña' THEN 0.3e0 ELSE 0.1e0 END
  + CASE WHEN GrAppv > 2000000 THEN 0.15e0 WHEN GrAppv > 1000000 THEN 0.1e0 ELSE 0e0 END, 0.75e0)"""
URBAN_SQL = "CASE WHEN State IN ('CDMX','NL','JAL','QRO','AGS') THEN 0.9e0 WHEN State IN ('MEX','GTO','PUE','COAH','CHIH','BC','SON','TAM') THEN 0.75e0 WHEN State IN ('OAX','CHIS','GRO','HGO','ZAC','DGO') THEN 0.5e0 ELSE 0.65e0 END"
NEW_SQL = "CASE coalesce(volatility, 'media') WHEN 'alta' THEN 0.35e0 WHEN 'media' THEN 0.25e0 ELSE 0.15e0 END"


@query("guarantee_propensity", f"SELECT LoanNr, round({GUARANTEE_SQL}, 8) AS guarantee_propensity FROM loans")
def _(spark, sf):
    return rounded(r.guarantee_propensity(loans(spark, sf)).select("LoanNr", "guarantee_propensity"), guarantee_propensity=8)


@query("guarantee_pct_mid", "SELECT LoanNr, CASE WHEN Portion > 0 THEN CASE WHEN GrAppv <= 500000 THEN 0.75e0 WHEN GrAppv <= 2000000 THEN 0.675e0 ELSE 0.6e0 END ELSE 0e0 END AS guarantee_pct_mid FROM loans")
def _(spark, sf):
    return r.guarantee_pct_mid(loans(spark, sf)).select("LoanNr", "guarantee_pct_mid")


@query("collateral_propensity", f"SELECT LoanNr, round({COLLATERAL_SQL}, 8) AS collateral_propensity FROM loans")
def _(spark, sf):
    return rounded(r.collateral_propensity(loans(spark, sf)).select("LoanNr", "collateral_propensity"), collateral_propensity=8)


@query("urban_propensity", f"SELECT LoanNr, {URBAN_SQL} AS urban_propensity FROM loans")
def _(spark, sf):
    return r.urban_propensity(loans(spark, sf)).select("LoanNr", "urban_propensity")


@query("new_business_propensity", f"SELECT LoanNr, {NEW_SQL} AS new_business_propensity FROM loans LEFT JOIN sectors ON SCIAN = sector_code")
def _(spark, sf):
    return r.new_business_propensity(loans(spark, sf)).select("LoanNr", "new_business_propensity")


@query("typical_amount", f"""SELECT LoanNr, typical AS typical_amount, round(GrAppv / typical, 8) AS amount_ratio FROM (SELECT LoanNr, GrAppv,
  CASE {SIZE_SQL} WHEN 'Micro' THEN 150000e0 WHEN 'Pequeña' THEN 800000e0 WHEN 'Mediana' THEN 3500000e0 ELSE 15000000e0 END * CASE WHEN SCIAN IN ('23','53') THEN 1.3e0 ELSE 1e0 END AS typical FROM loans)""")
def _(spark, sf):
    return rounded(r.typical_amount(loans(spark, sf)).select("LoanNr", "typical_amount", "amount_ratio"), amount_ratio=8)


def _observed(name, rule, segment_sql, segment, seen, expected):
    @query(f"observed_vs_rule_{name}", f"""SELECT {segment_sql} AS segment, count(*) AS n, round(avg(({seen})::INTEGER), 8) AS observed, round(avg({expected}), 8) AS expected,
      round(avg(({seen})::INTEGER) - avg({expected}), 8) + 0e0 AS gap FROM loans LEFT JOIN sectors ON SCIAN = sector_code WHERE ({segment_sql}) IS NOT NULL GROUP BY 1""")
    def _(spark, sf):
        return rounded(r.observed_vs_rule(loans(spark, sf, customer=rule == "new_business"), rule, segment()), observed=8, expected=8, gap=8)


_observed("guarantee", "guarantee", "SCIAN", lambda: c("SCIAN"), "Portion > 0", GUARANTEE_SQL)
_observed("collateral", "collateral", SIZE_SQL, size_class, "RealEstate = 1", COLLATERAL_SQL)
_observed("urban", "urban", "State", lambda: c("State"), "UrbanRural = 1", URBAN_SQL)
_observed("new_business", "new_business", AMOUNT_SQL, amount_bucket, "NewExist = 1", NEW_SQL)
