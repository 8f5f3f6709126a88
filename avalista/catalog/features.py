"""Feature columns, segments and flags."""

from pyspark.sql import functions as F

from avalista.catalog.loan_view import applications, dirty, legacy, loans
from avalista.catalog.registry import query, rounded
from avalista.functions import segments as seg
from avalista.functions import text
from avalista.operators import features as f
from avalista.operators import quotes
from avalista.operators.encoding import (
    class_weights, label_encode, one_hot, scaler_stats, standardize, with_exact_fold, with_fold,
)
from avalista.operators.lookups import with_development_tier
from avalista.sources.dims import SECTOR_CODES, STATE_CODES

c = F.col

CLEAN_SQL = """clean AS (
  SELECT LoanNr, coalesce(GrAppv, 0e0) AS GrAppv, coalesce(NAFIN_Appv, 0e0) AS NAFIN_Appv,
    coalesce(Term, 0)::INTEGER AS Term, coalesce(NoEmp, 0)::INTEGER AS NoEmp, coalesce(NewExist, 2)::DOUBLE AS NewExist,
    coalesce(State, 'CDMX') AS State,
    CASE WHEN SCIAN IS NULL OR substring(SCIAN, 1, 2) IN ('0', 'na') THEN '00' ELSE substring(SCIAN, 1, 2) END AS SCIAN,
    coalesce(ChgOffPrinGr, 0e0) AS ChgOffPrinGr, "Default",
    coalesce(RealEstate, 0) AS HasRealEstate, coalesce(Recession, 0) AS InRecession,
    (UrbanRural = 1)::INTEGER AS IsUrban
  FROM dirty
), feat AS (
  SELECT *, (NewExist = 1)::INTEGER AS IsNewBusiness,
    CASE WHEN GrAppv > 0 THEN NAFIN_Appv / GrAppv ELSE 0e0 END AS NAFIN_Portion,
    GrAppv / (NoEmp + 1) AS Loan_per_Employee, Term / 12e0 AS Term_Years,
    GrAppv - NAFIN_Appv AS Debt_to_NAFIN, round(ln(1e0 + GrAppv), 8) AS Log_GrAppv
  FROM clean
)"""


@query("normalize_legacy", "SELECT LoanNr, SCIAN, NAFIN_Appv FROM loans")
def _(spark, sf):
    return f.normalize_legacy(legacy(spark, sf)).select("LoanNr", "SCIAN", "NAFIN_Appv")


@query("to_legacy_format", "SELECT LoanNr, SCIAN AS NAICS, NAFIN_Appv AS SBA_Appv, 'N' AS LowDoc FROM loans")
def _(spark, sf):
    return f.to_legacy_format(loans(spark, sf)).select("LoanNr", "NAICS", "SBA_Appv", "LowDoc")


@query("add_compat_columns", "SELECT LoanNr, SCIAN AS NAICS, NAFIN_Appv AS SBA_Appv, year(ApprovalDate)::INTEGER AS ApprovalFY FROM loans")
def _(spark, sf):
    return f.add_compat_columns(loans(spark, sf)).select("LoanNr", "NAICS", "SBA_Appv", "ApprovalFY")


@query("with_targets", 'SELECT LoanNr, coalesce(ChgOffPrinGr, 0e0) AS ChgOffPrinGr, "Default" AS given, (coalesce(ChgOffPrinGr, 0e0) > 0)::INTEGER AS derived FROM dirty')
def _(spark, sf):
    source = dirty(spark, sf)
    given = f.with_targets(source.withColumn("keep", c("Default")))
    return f.with_targets(given.drop("Default").withColumnRenamed("keep", "given")).select(
        "LoanNr", "ChgOffPrinGr", "given", c("Default").alias("derived")
    )


@query("clean_base", f", {CLEAN_SQL} SELECT LoanNr, GrAppv, NAFIN_Appv, Term, NoEmp, NewExist, State FROM clean")
def _(spark, sf):
    return f.clean_base(dirty(spark, sf, customer=True)).select("LoanNr", "GrAppv", "NAFIN_Appv", "Term", "NoEmp", "NewExist", "State")


@query("is_new_business", f", {CLEAN_SQL} SELECT LoanNr, IsNewBusiness FROM feat")
def _(spark, sf):
    return f.is_new_business(f.clean_base(dirty(spark, sf, customer=True))).select("LoanNr", "IsNewBusiness")


@query("clean_scian", f", {CLEAN_SQL} SELECT LoanNr, SCIAN FROM clean")
def _(spark, sf):
    return f.clean_base(dirty(spark, sf, customer=True)).select("LoanNr", "SCIAN")


def _ratio_query(name, column, digits=None):
    @query(name, f", {CLEAN_SQL} SELECT LoanNr, {column} FROM feat")
    def _(spark, sf):
        out = f.with_ratios(f.clean_base(dirty(spark, sf, customer=True))).select("LoanNr", column)
        return rounded(out, **{column: digits}) if digits else out


_ratio_query("nafin_portion", "NAFIN_Portion")
_ratio_query("loan_per_employee", "Loan_per_Employee")
_ratio_query("term_years", "Term_Years")
_ratio_query("debt_to_nafin", "Debt_to_NAFIN")
_ratio_query("log_grappv", "Log_GrAppv", 8)


@query("has_real_estate_in_recession", f", {CLEAN_SQL} SELECT LoanNr, HasRealEstate, InRecession FROM feat")
def _(spark, sf):
    return f.with_flags(dirty(spark, sf)).select("LoanNr", "HasRealEstate", "InRecession")


@query("is_urban", f", {CLEAN_SQL} SELECT LoanNr, IsUrban FROM feat")
def _(spark, sf):
    return f.with_flags(dirty(spark, sf)).select("LoanNr", "IsUrban")


FEATURES = "GrAppv, NAFIN_Appv, Debt_to_NAFIN, Log_GrAppv, Term, Term_Years, NoEmp, IsNewBusiness, NAFIN_Portion, Loan_per_Employee, HasRealEstate, InRecession, IsUrban, SCIAN, State"


@query("feature_select", f", {CLEAN_SQL} SELECT LoanNr, {FEATURES} FROM feat")
def _(spark, sf):
    return rounded(f.feature_select(f.build_features(dirty(spark, sf, customer=True)), "LoanNr"), Log_GrAppv=8)


@query("build_features", f', {CLEAN_SQL} SELECT LoanNr, "Default", ChgOffPrinGr, {FEATURES} FROM feat')
def _(spark, sf):
    return rounded(f.feature_select(f.build_features(dirty(spark, sf, customer=True)), "LoanNr", "Default", "ChgOffPrinGr"), Log_GrAppv=8)


@query("build_features_legacy", """SELECT LoanNr, (ChgOffPrinGr > 0)::INTEGER AS "Default", NAFIN_Appv, SCIAN, 0 AS HasRealEstate, 0 AS InRecession, 1 AS IsUrban FROM loans""")
def _(spark, sf):
    return f.build_features(legacy(spark, sf, customer=True)).select("LoanNr", "Default", "NAFIN_Appv", "SCIAN", "HasRealEstate", "InRecession", "IsUrban")


AMOUNT_SQL = """CASE WHEN GrAppv <= 0 THEN NULL WHEN GrAppv <= 200000 THEN '<$200K' WHEN GrAppv <= 500000 THEN '$200K-500K'
  WHEN GrAppv <= 1000000 THEN '$500K-1M' WHEN GrAppv > 1000000 THEN '>$1M' END"""
AMOUNT_ORD_SQL = """CASE WHEN GrAppv <= 0 THEN NULL WHEN GrAppv <= 200000 THEN 1 WHEN GrAppv <= 500000 THEN 2
  WHEN GrAppv <= 1000000 THEN 3 WHEN GrAppv > 1000000 THEN 4 END"""
TERM_SQL = "CASE WHEN Term < 24 THEN '<2 años' WHEN Term <= 60 THEN '2-5 años' WHEN Term <= 120 THEN '5-10 años' WHEN Term > 120 THEN '>10 años' END"
TERM_ORD_SQL = "CASE WHEN Term < 24 THEN 1 WHEN Term <= 60 THEN 2 WHEN Term <= 120 THEN 3 WHEN Term > 120 THEN 4 END"
SIZE_SQL = "CASE WHEN NoEmp <= 0 THEN NULL WHEN NoEmp <= 10 THEN 'Micro' WHEN NoEmp <= 50 THEN 'Pequeña' WHEN NoEmp <= 250 THEN 'Mediana' WHEN NoEmp <= 1000 THEN 'Grande' END"
PORTION_SQL = "CASE WHEN Portion >= 0.70e0 THEN 'Con NAFIN (≥70%)' WHEN Portion >= 0.50e0 THEN 'Con NAFIN (50-70%)' WHEN Portion > 0 THEN 'Con NAFIN (<50%)' WHEN Portion = 0 THEN 'Sin NAFIN' END"
PORTION_ORD_SQL = "CASE WHEN Portion >= 0.70e0 THEN 1 WHEN Portion >= 0.50e0 THEN 2 WHEN Portion > 0 THEN 3 WHEN Portion = 0 THEN 4 END"


@query("amount_bucket", f"SELECT LoanNr, {AMOUNT_SQL} AS bucket, {AMOUNT_ORD_SQL} AS bucket_ord FROM dirty")
def _(spark, sf):
    return dirty(spark, sf).select("LoanNr", seg.amount_bucket().alias("bucket"), seg.amount_bucket_ord().alias("bucket_ord"))


@query("term_bucket", f"SELECT LoanNr, {TERM_SQL} AS bucket, {TERM_ORD_SQL} AS bucket_ord FROM dirty")
def _(spark, sf):
    return dirty(spark, sf).select("LoanNr", seg.term_bucket().alias("bucket"), seg.term_bucket_ord().alias("bucket_ord"))


@query("size_class", f"SELECT LoanNr, {SIZE_SQL} AS size_class FROM dirty")
def _(spark, sf):
    return dirty(spark, sf).select("LoanNr", seg.size_class().alias("size_class"))


@query("portion_band", f"SELECT LoanNr, {PORTION_SQL} AS band, {PORTION_ORD_SQL} AS band_ord FROM loans")
def _(spark, sf):
    return loans(spark, sf).select("LoanNr", seg.portion_band().alias("band"), seg.portion_band_ord().alias("band_ord"))


@query("crisis_flag", "SELECT LoanNr, ((year(ApprovalDate) = 2020 AND month(ApprovalDate) >= 3) OR (year(ApprovalDate) = 2021 AND month(ApprovalDate) <= 6)) AS crisis FROM loans")
def _(spark, sf):
    return loans(spark, sf).select("LoanNr", seg.crisis_flag().alias("crisis"))


@query("approval_year_daysterm", "SELECT LoanNr, year(ApprovalDate)::INTEGER AS approval_year, Term * 30 AS daysterm FROM loans")
def _(spark, sf):
    return loans(spark, sf).select("LoanNr", seg.approval_year().alias("approval_year"), seg.days_term().alias("daysterm"))


@query("revline_flag", "SELECT LoanNr, (RevLineCr = 'Y')::INTEGER AS revline FROM loans")
def _(spark, sf):
    return loans(spark, sf).select("LoanNr", seg.revline_flag().alias("revline"))


@query("filter_defaults", 'SELECT LoanNr, GrAppv, ChgOffPrinGr FROM loans WHERE "Default" = 1')
def _(spark, sf):
    return f.filter_defaults(loans(spark, sf)).select("LoanNr", "GrAppv", "ChgOffPrinGr")


@query("development_tier", "SELECT LoanNr, CASE WHEN State IN ('NL','CDMX','JAL','QRO','AGS','COAH','CHIH','BC','SON') THEN 'high' WHEN State IN ('MEX','GTO','PUE','TAM','SIN','YUC','QROO','MOR','SLP','DGO','BCS','COL') THEN 'medium' ELSE 'low' END AS tier FROM dirty")
def _(spark, sf):
    return with_development_tier(dirty(spark, sf)).select("LoanNr", "tier")


@query("rate_light", """SELECT State, round(avg("Default"), 8) AS rate, CASE WHEN avg("Default") > 0.10e0 THEN 'red' WHEN avg("Default") > 0.07e0 THEN 'amber' ELSE 'green' END AS light FROM loans GROUP BY State""")
def _(spark, sf):
    rates = loans(spark, sf).groupBy("State").agg(F.avg("Default").alias("rate"))
    return rounded(rates.withColumn("light", seg.rate_light("rate")), rate=8)


@query("validate_applications", """SELECT application_id, reason AS reject_reason, reason IS NULL AS is_valid FROM (
  SELECT application_id, CASE WHEN NOT coalesce(approved_amount BETWEEN 50000 AND 50000000, false) THEN 'amount'
    WHEN NOT coalesce(term_months IN (6,12,18,24,36,48,60,84,120), false) THEN 'term'
    WHEN NOT coalesce(num_employees BETWEEN 1 AND 1000, false) THEN 'employees'
    WHEN scian_code IS NULL OR scian_code NOT IN (SELECT sector_code FROM sectors) THEN 'sector'
    WHEN state_code IS NULL OR state_code NOT IN (SELECT state_code FROM states) THEN 'state'
    WHEN NOT coalesce(market_bank_rate BETWEEN 8e0 AND 35e0, false) THEN 'rate' END AS reason
  FROM (SELECT a.* REPLACE (CASE WHEN application_id % 41 = 0 THEN 'XX' ELSE state_code END AS state_code,
      CASE WHEN application_id % 37 = 0 THEN 0 ELSE num_employees END AS num_employees,
      CASE WHEN application_id % 31 = 0 THEN 13 ELSE term_months END AS term_months,
      CASE WHEN application_id % 43 = 0 THEN NULL ELSE scian_code END AS scian_code) FROM applications a))""")
def _(spark, sf):
    spoiled = applications(spark, sf)
    mod = lambda n: c("application_id") % n == 0
    spoiled = spoiled.withColumns({
        "state_code": F.when(mod(41), "XX").otherwise(c("state_code")),
        "num_employees": F.when(mod(37), 0).otherwise(c("num_employees")),
        "term_months": F.when(mod(31), 13).otherwise(c("term_months")),
        "scian_code": F.when(~mod(43), c("scian_code")),
    })
    return quotes.validate_applications(spoiled).select("application_id", "reject_reason", "is_valid")


@query("parse_application_text", """SELECT application_id, CASE WHEN application_id % 13 = 0 THEN NULL ELSE approved_amount END AS approved_amount,
  term_months::INTEGER AS term_months, is_new_business, substring(scian_code, 1, 2) AS scian_code, state_code FROM applications""")
def _(spark, sf):
    yes = F.when(c("application_id") % 3 == 0, "Sí").when(c("application_id") % 3 == 1, "YES").otherwise("s")
    raw = applications(spark, sf, customer=True).select(
        "application_id",
        F.when(c("application_id") % 13 == 0, F.lit("n/d")).otherwise(
            F.concat(F.lit(" "), c("approved_amount").cast("string"))
        ).alias("approved_amount"),
        F.concat(c("term_months").cast("string"), F.lit(" ")).alias("term_months"),
        F.when(c("is_new_business"), yes).otherwise("no").alias("is_new_business"),
        F.concat(F.lit("  "), c("scian_code"), F.lit("1234")).alias("scian_code"),
        F.concat(F.lower("state_code"), F.lit(" ")).alias("state_code"),
    )
    return quotes.parse_application_text(raw)


@query("label_money_pct", "SELECT LoanNr, format('${:,.0f}', GrAppv) AS amount, format('{:.1f}%', pd_fix * 100) AS pd FROM loans")
def _(spark, sf):
    return loans(spark, sf).select("LoanNr", text.money_label(c("GrAppv")).alias("amount"), text.percent_label(c("pd_fix")).alias("pd"))


@query("split", """SELECT LoanNr, "Default", CASE WHEN substring(md5(LoanNr::VARCHAR || '|42'), 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS fold FROM loans""")
def _(spark, sf):
    return with_fold(loans(spark, sf)).select("LoanNr", "Default", "fold")


@query("split_exact", """SELECT LoanNr, "Default", CASE WHEN place <= round(n * 0.2e0) THEN 'test' ELSE 'train' END AS fold FROM (
  SELECT LoanNr, "Default", row_number() OVER (PARTITION BY "Default" ORDER BY md5(LoanNr::VARCHAR || '|42'), LoanNr) AS place,
    count(*) OVER (PARTITION BY "Default") AS n FROM loans)""")
def _(spark, sf):
    return with_exact_fold(loans(spark, sf).select("LoanNr", "Default"))


@query("standardize", f""", {CLEAN_SQL} SELECT LoanNr, round((GrAppv - avg(GrAppv) OVER ()) / stddev_pop(GrAppv) OVER (), 8) + 0e0 AS num__GrAppv,
  round((Term - avg(Term) OVER ()) / stddev_pop(Term) OVER (), 8) + 0e0 AS num__Term,
  round((NAFIN_Portion - avg(NAFIN_Portion) OVER ()) / stddev_pop(NAFIN_Portion) OVER (), 8) + 0e0 AS "num__NAFIN_Portion", 0e0 AS num__constant FROM feat""")
def _(spark, sf):
    columns = ["GrAppv", "Term", "NAFIN_Portion", "constant"]
    features = f.build_features(dirty(spark, sf, customer=True)).withColumn("constant", F.lit(3.0))
    out = standardize(features, columns).select("LoanNr", *[f"num__{x}" for x in columns])
    return rounded(out, num__GrAppv=8, num__Term=8, num__NAFIN_Portion=8)


@query("scaler_stats", f", {CLEAN_SQL} SELECT round(avg(GrAppv), 4) AS GrAppv_mean, round(avg(NoEmp), 8) AS NoEmp_mean, round(stddev_pop(GrAppv), 4) AS GrAppv_std, round(stddev_pop(NoEmp), 8) AS NoEmp_std FROM feat")
def _(spark, sf):
    stats = scaler_stats(f.build_features(dirty(spark, sf, customer=True)), ["GrAppv", "NoEmp"])
    return rounded(stats, GrAppv_mean=4, NoEmp_mean=8, GrAppv_std=4, NoEmp_std=8)


@query("one_hot", "SELECT LoanNr, " + ", ".join(f"coalesce((SCIAN = '{x}')::INTEGER, 0) AS \"cat__SCIAN_{x}\"" for x in SECTOR_CODES)
       + ", " + ", ".join(f"coalesce((State = '{x}')::INTEGER, 0) AS \"cat__State_{x}\"" for x in STATE_CODES) + " FROM dirty")
def _(spark, sf):
    hot = one_hot(one_hot(dirty(spark, sf), "SCIAN", SECTOR_CODES), "State", STATE_CODES)
    return hot.select("LoanNr", *[f"cat__SCIAN_{x}" for x in SECTOR_CODES], *[f"cat__State_{x}" for x in STATE_CODES])


@query("label_encode", """SELECT LoanNr, (dense_rank() OVER (ORDER BY encode(State)) - 1)::INTEGER AS State_encoded, (dense_rank() OVER (ORDER BY encode(SCIAN)) - 1)::INTEGER AS SCIAN_encoded,
  (dense_rank() OVER (ORDER BY encode(Bank)) - 1)::INTEGER AS Bank_encoded FROM loans""")
def _(spark, sf):
    return label_encode(loans(spark, sf), ["State", "SCIAN", "Bank"]).select("LoanNr", "State_encoded", "SCIAN_encoded", "Bank_encoded")


@query("class_weights", """SELECT "Default", count(*) AS n, round((SELECT count(*) FROM loans) / (2 * count(*)), 8) AS weight FROM loans GROUP BY "Default" """)
def _(spark, sf):
    return rounded(class_weights(loans(spark, sf)), weight=8)
