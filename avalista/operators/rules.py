"""Rule-based scoring of a loan table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from avalista.functions import rules as r
from avalista.operators.lookups import with_development_tier, with_sector_info

c = F.col


def _with_sector(loans: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that need the sector attributes, without leaving those behind."""
    return with_sector_info(loans).withColumns(columns).drop("base_rate", "volatility")


def risk_score(loans: DataFrame, name="risk_score") -> DataFrame:
    return _with_sector(with_development_tier(loans), **{name: r.risk_score()}).drop("tier")


def score_to_pd(loans: DataFrame, score="risk_score", name="rule_pd") -> DataFrame:
    return loans.withColumn(name, r.score_to_pd(c(score)))


def rule_lgd(loans: DataFrame) -> DataFrame:
    return loans.withColumns({"rule_lgd_rate": r.rule_lgd_rate(), "rule_loss": r.rule_loss_given_default()})


def rule_expected_loss(loans: DataFrame) -> DataFrame:
    """Score, default probability, loss given default and their product, without any model."""
    scored = rule_lgd(score_to_pd(risk_score(loans)))
    return scored.withColumn("rule_el", c("rule_pd") * c("rule_loss"))


def reference_rate(loans: DataFrame) -> DataFrame:
    return _with_sector(loans, reference_rate=r.reference_rate())


def guarantee_propensity(loans: DataFrame) -> DataFrame:
    return loans.withColumn("guarantee_propensity", r.guarantee_propensity())


def guarantee_pct_mid(loans: DataFrame) -> DataFrame:
    return loans.withColumn("guarantee_pct_mid", r.guarantee_pct_mid())


def collateral_propensity(loans: DataFrame) -> DataFrame:
    return loans.withColumn("collateral_propensity", r.collateral_propensity())


def urban_propensity(loans: DataFrame) -> DataFrame:
    return loans.withColumn("urban_propensity", r.urban_propensity())


def new_business_propensity(loans: DataFrame) -> DataFrame:
    return _with_sector(loans, new_business_propensity=r.new_business_propensity())


def typical_amount(loans: DataFrame) -> DataFrame:
    priced = loans.withColumn("typical_amount", r.typical_amount())
    return priced.withColumn("amount_ratio", c("GrAppv") / c("typical_amount"))


RULES = {
    "guarantee": (guarantee_propensity, "guarantee_propensity", lambda: c("Portion") > 0),
    "collateral": (collateral_propensity, "collateral_propensity", lambda: c("RealEstate") == 1),
    "urban": (urban_propensity, "urban_propensity", lambda: c("UrbanRural") == 1),
    "new_business": (new_business_propensity, "new_business_propensity", lambda: c("NewExist") == 1),
}


def observed_vs_rule(loans: DataFrame, rule: str, segment: Column, name="segment") -> DataFrame:
    """Observed share against the share the rule expects, per segment."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    operator, column, observed = RULES[rule]
    return (
        operator(loans)
        .groupBy(segment.alias(name))
        .agg(
            F.count("*").alias("n"),
            F.avg(observed().cast("double")).alias("observed"),
            F.avg(column).alias("expected"),
        )
        .filter(c(name).isNotNull())
        .withColumn("gap", c("observed") - c("expected"))
    )
