"""Loan, application and scored-loan views derived from the test tables.

``loans`` is orders with the summed line items of each order and, when a query
needs the borrower's name or age class, its customer. The line items are unique
per order after the sum, so Spark drops that join where its columns are unused.
The customer table is joined as it is: Spark broadcasts it while it is small and
splits hot customers when it is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from avalista.functions.rules import rule_lgd_rate, rule_loss_given_default
from avalista.operators.calibration import predict_el
from avalista.sources.dims import BANK_NAMES, BANKS, SECTOR_CODES, SECTORS, STATE_CODES, STATES, TERMS

c = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _list(values) -> str:
    return "array(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


# Spark SQL text of the base columns; m is the scratch number behind NoEmp.
_BASE = f"""
o_orderkey AS LoanNr
element_at({_list(STATE_CODES)}, int(o_custkey % 32) + 1) AS State
element_at({_list(SECTOR_CODES)}, int(floor(sqrt(double(o_orderkey % 441)))) + 1) AS SCIAN
element_at({_list(BANK_NAMES)}, int(o_custkey % 14) + 1) AS Bank
add_months(date(o_orderdate), 240) AS ApprovalDate
element_at({_list(TERMS)}, int(o_orderkey % 9) + 1) AS Term
(o_orderkey * 31 + o_custkey) % 1000 AS m
CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 0 WHEN '5-LOW' THEN 2 ELSE 1 END AS UrbanRural
double(floor(o_totalprice / 100D)) * 1000D AS GrAppv
CASE WHEN o_orderkey % 20 < 7 THEN double(50 + o_orderkey % 31) / 100D ELSE 0D END AS Portion
int(o_orderstatus = 'O') AS RealEstate
8D + double(o_custkey % 271) / 10D AS InterestRate
CASE WHEN o_orderkey % 4 = 0 THEN 'Y' ELSE 'N' END AS RevLineCr
CASE WHEN o_orderkey % 10 < 3 THEN 'Y' ELSE 'N' END AS LowDoc
coalesce(int(returned_qty / qty > 0.75D), 0) AS Default
""".strip().split("\n")

_CUSTOMER = ["c_name AS Name", "CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END AS NewExist"]

_DERIVED = """
int(CASE WHEN m < 700 THEN 1 + m % 10 WHEN m < 900 THEN 11 + m % 40 WHEN m < 980 THEN 51 + m % 200 ELSE 251 + m % 250 END) AS NoEmp
year(ApprovalDate) AS ApprovalFY
round(GrAppv * Portion, 2) AS NAFIN_Appv
int(ApprovalDate >= DATE '2020-03-01' AND ApprovalDate < DATE '2021-07-01') AS Recession
double((LoanNr * 7919) % 10000) / 100000D AS pd_fix
""".strip().split("\n")


def loans(spark: SparkSession, sf_dir: str, customer: bool = False) -> DataFrame:
    """``customer`` adds the columns Name and NewExist, at the price of a join."""
    orders = table(spark, sf_dir, "orders")
    returned = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.expr("sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0D END)").alias("returned_qty"),
        F.sum("l_quantity").alias("qty"),
    )
    joined = orders.join(returned, c("o_orderkey") == c("l_orderkey"), "left")
    if customer:
        joined = joined.join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey"), "left")
    loss = F.round(c("GrAppv") * rule_lgd_rate() * F.expr("double(40 + LoanNr % 41) / 100D"), 2)
    return (
        joined.selectExpr(*_BASE, *(_CUSTOMER if customer else []))
        .selectExpr("*", *_DERIVED)
        .withColumns({
            "ChgOffPrinGr": F.when(c("Default") == 1, loss).otherwise(0.0),
            "lgd_fix": rule_loss_given_default(),
        })
        .drop("m")
    )


# Every n-th loan misses the column.
_GAPS = {"GrAppv": 97, "State": 89, "SCIAN": 83, "RealEstate": 79, "NoEmp": 73, "NewExist": 71, "Term": 67, "ChgOffPrinGr": 61}


def dirty(spark: SparkSession, sf_dir: str, customer: bool = False) -> DataFrame:
    """The loan view with missing values sprinkled in."""
    view = loans(spark, sf_dir, customer)
    return view.withColumns({x: F.when(c("LoanNr") % n != 0, c(x)) for x, n in _GAPS.items() if x in view.columns})


def legacy(spark: SparkSession, sf_dir: str, customer: bool = False) -> DataFrame:
    return loans(spark, sf_dir, customer).withColumnsRenamed({"SCIAN": "NAICS", "NAFIN_Appv": "SBA_Appv"}).drop(
        "Default", "RealEstate", "Recession", "UrbanRural"
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans with the fixed test scores as model output."""
    view = loans(spark, sf_dir).withColumnsRenamed({"pd_fix": "pd", "lgd_fix": "lgd"})
    return predict_el(view)


def applications(spark: SparkSession, sf_dir: str, customer: bool = False) -> DataFrame:
    return loans(spark, sf_dir, customer).select(
        c("LoanNr").alias("application_id"),
        c("GrAppv").alias("approved_amount"),
        c("Term").alias("term_months"),
        c("NoEmp").alias("num_employees"),
        *([(c("NewExist") == 1).alias("is_new_business")] if customer else []),
        c("SCIAN").alias("scian_code"),
        c("State").alias("state_code"),
        c("InterestRate").alias("market_bank_rate"),
        (c("RealEstate") == 1).alias("has_real_estate"),
        (c("Recession") == 1).alias("in_recession"),
        c("pd_fix").alias("pd"),
        c("lgd_fix").alias("lgd"),
    )


def _text(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _values(rows, names) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        return f"'{v}'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS t({names})"


_LGD_SQL = (
    "CASE WHEN Portion > 0 AND RealEstate = 1 THEN 0.20e0 WHEN Portion > 0 THEN 0.25e0 "
    "WHEN RealEstate = 1 THEN 0.35e0 ELSE 0.75e0 END"
)

VIEWS_SQL = f"""sectors AS (SELECT * FROM {_values(SECTORS, "sector_code, sector_name, sector_share, base_rate, volatility")}),
states AS (SELECT * FROM {_values(STATES, "state_code, state_name, state_share, tier")}),
banks AS (SELECT * FROM {_values(BANKS, "bank_name, bank_share")}),
returned AS (
  SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS returned_qty, sum(l_quantity) AS qty
  FROM lineitem GROUP BY l_orderkey
),
base0 AS (
  SELECT o_orderkey AS LoanNr, c_name AS Name, {_text(STATE_CODES)}[(o_custkey % 32) + 1] AS State,
    {_text(SECTOR_CODES)}[floor(sqrt((o_orderkey % 441)::DOUBLE))::BIGINT + 1] AS SCIAN,
    {_text(BANK_NAMES)}[(o_custkey % 14) + 1] AS Bank,
    (o_orderdate + INTERVAL 20 YEAR)::DATE AS ApprovalDate,
    {TERMS}[(o_orderkey % 9) + 1] AS Term,
    (o_orderkey * 31 + o_custkey) % 1000 AS m,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END AS NewExist,
    CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 0 WHEN '5-LOW' THEN 2 ELSE 1 END AS UrbanRural,
    floor(o_totalprice / 100e0) * 1000e0 AS GrAppv,
    CASE WHEN o_orderkey % 20 < 7 THEN (50 + o_orderkey % 31)::DOUBLE / 100e0 ELSE 0e0 END AS Portion,
    (o_orderstatus = 'O')::INTEGER AS RealEstate,
    8e0 + (o_custkey % 271)::DOUBLE / 10e0 AS InterestRate,
    CASE WHEN o_orderkey % 4 = 0 THEN 'Y' ELSE 'N' END AS RevLineCr,
    CASE WHEN o_orderkey % 10 < 3 THEN 'Y' ELSE 'N' END AS LowDoc,
    coalesce((returned_qty / qty > 0.75e0)::INTEGER, 0) AS "Default"
  FROM orders LEFT JOIN returned ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey
),
loans AS (
  SELECT * EXCLUDE (m),
    (CASE WHEN m < 700 THEN 1 + m % 10 WHEN m < 900 THEN 11 + m % 40 WHEN m < 980 THEN 51 + m % 200 ELSE 251 + m % 250 END)::INTEGER AS NoEmp,
    year(ApprovalDate)::INTEGER AS ApprovalFY,
    round(GrAppv * Portion, 2) AS NAFIN_Appv,
    (ApprovalDate >= DATE '2020-03-01' AND ApprovalDate < DATE '2021-07-01')::INTEGER AS Recession,
    CASE WHEN "Default" = 1 THEN round(GrAppv * ({_LGD_SQL}) * (40 + LoanNr % 41)::DOUBLE / 100e0, 2) ELSE 0e0 END AS ChgOffPrinGr,
    ((LoanNr * 7919) % 10000)::DOUBLE / 100000e0 AS pd_fix,
    round(GrAppv * ({_LGD_SQL}) * 0.60e0, 2) AS lgd_fix
  FROM base0
),
dirty AS (
  SELECT * REPLACE ({", ".join(f"CASE WHEN LoanNr % {n} <> 0 THEN {x} END AS {x}" for x, n in _GAPS.items())}) FROM loans
),
scored AS (SELECT * EXCLUDE (pd_fix, lgd_fix), pd_fix AS pd, lgd_fix AS lgd, pd_fix * lgd_fix AS el FROM loans),
applications AS (
  SELECT LoanNr AS application_id, GrAppv AS approved_amount, Term AS term_months, NoEmp AS num_employees,
    NewExist = 1 AS is_new_business, SCIAN AS scian_code, State AS state_code, InterestRate AS market_bank_rate,
    RealEstate = 1 AS has_real_estate, Recession = 1 AS in_recession, pd_fix AS pd, lgd_fix AS lgd
  FROM loans
)"""
