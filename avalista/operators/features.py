"""Loan table -> feature table. Narrow projections only: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avalista.functions import cleaning as clean
from avalista.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES, REQUIRED, require

c = F.col


def normalize_legacy(loans: DataFrame) -> DataFrame:
    """Accept the older column names for the loan id, the sector and the guaranteed amount."""
    have = set(loans.columns)
    added = {}
    if "LoanNr" not in have and "LoanNr_ChkDgt" in have:
        added["LoanNr"] = c("LoanNr_ChkDgt")
    if "NAFIN_Appv" not in have:
        added["NAFIN_Appv"] = c("SBA_Appv").cast("double") if "SBA_Appv" in have else F.lit(0.0)
    if "SCIAN" not in have:
        added["SCIAN"] = c("NAICS").cast("string") if "NAICS" in have else F.lit("00")
    return loans.withColumns(added) if added else loans


def to_legacy_format(loans: DataFrame) -> DataFrame:
    """Rename to the older layout; an existing column of the older name is replaced."""
    renames = {"SCIAN": "NAICS", "NAFIN_Appv": "SBA_Appv"}
    clash = [new for old, new in renames.items() if old in loans.columns and new in loans.columns]
    return loans.drop(*clash).withColumnsRenamed(renames).withColumn("LowDoc", F.lit("N"))


def add_compat_columns(loans: DataFrame) -> DataFrame:
    require(loans, ["SCIAN", "NAFIN_Appv", "ApprovalDate"], "loan table")
    return loans.withColumns(
        {"NAICS": c("SCIAN"), "SBA_Appv": c("NAFIN_Appv"), "ApprovalFY": F.year("ApprovalDate")}
    )


def with_targets(loans: DataFrame) -> DataFrame:
    """Loss with missing as zero, and the 0/1 default flag (from the loss if not given)."""
    require(loans, ["ChgOffPrinGr"], "loan table")
    loss = clean.money(c("ChgOffPrinGr"))
    default = c("Default").cast("int") if "Default" in loans.columns else (loss > 0).cast("int")
    return loans.withColumns({"ChgOffPrinGr": loss, "Default": default})


def clean_base(loans: DataFrame) -> DataFrame:
    """Fill missing values of the base columns and settle the sector and state codes."""
    require(loans, ["GrAppv", "Term", "NoEmp", "NewExist"], "loan table")
    loans = normalize_legacy(loans)
    state = F.coalesce(c("State").cast("string"), F.lit("CDMX")) if "State" in loans.columns else F.lit("CDMX")
    return loans.withColumns({
        "GrAppv": clean.money(c("GrAppv")),
        "NAFIN_Appv": clean.money(c("NAFIN_Appv")),
        "Term": clean.whole(c("Term")),
        "NoEmp": clean.whole(c("NoEmp")),
        "NewExist": F.coalesce(c("NewExist").cast("double"), F.lit(2.0)),
        "SCIAN": clean.clean_scian(c("SCIAN")),
        "State": state,
    })


def is_new_business(loans: DataFrame) -> DataFrame:
    flag = c("New").cast("int") if "New" in loans.columns else (c("NewExist") == 1.0).cast("int")
    return loans.withColumn("IsNewBusiness", flag)


def with_ratios(loans: DataFrame) -> DataFrame:
    """Amount ratios and transforms, on cleaned columns."""
    amount, guaranteed = c("GrAppv"), c("NAFIN_Appv")
    return loans.withColumns({
        "NAFIN_Portion": clean.nafin_portion(guaranteed, amount),
        "Loan_per_Employee": clean.loan_per_employee(amount, c("NoEmp")),
        "Term_Years": clean.term_years(c("Term")),
        "Debt_to_NAFIN": clean.debt_to_nafin(amount, guaranteed),
        "Log_GrAppv": clean.log_amount(amount),
    })


def with_flags(loans: DataFrame) -> DataFrame:
    """Collateral, crisis and urban flags; fixed when their source column is absent."""
    have = set(loans.columns)
    return loans.withColumns({
        "HasRealEstate": clean.flag(c("RealEstate")) if "RealEstate" in have else F.lit(0),
        "InRecession": clean.flag(c("Recession")) if "Recession" in have else F.lit(0),
        "IsUrban": clean.is_urban(c("UrbanRural")) if "UrbanRural" in have else F.lit(1),
    })


def build_features(loans: DataFrame) -> DataFrame:
    """The whole preparation; collapses into one projection over the scan."""
    require(loans, REQUIRED, "loan table")
    return with_flags(with_ratios(is_new_business(clean_base(with_targets(loans)))))


def feature_select(features: DataFrame, *keep: str) -> DataFrame:
    """Model columns in their fixed order, those present, after any ``keep`` columns."""
    wanted = [f for f in NUMERIC_FEATURES + CATEGORICAL_FEATURES if f in features.columns]
    return features.select(*keep, *wanted)


def filter_defaults(loans: DataFrame) -> DataFrame:
    return loans.filter(c("Default") == 1)
