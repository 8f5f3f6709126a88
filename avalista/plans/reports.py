"""The tables behind each analysis, as named lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avalista.functions import segments as seg
from avalista.operators import calibration, curves, features, metrics, portfolio, quotes

c = F.col


def portfolio_report(loans: DataFrame) -> dict[str, DataFrame]:
    """Portfolio overview: headline figures, segment rates, distributions, top lists."""
    ready = features.build_features(loans)
    return {
        "summary": portfolio.portfolio_summary(ready),
        "by_amount": portfolio.by_amount_bucket(ready),
        "by_term": portfolio.by_term_bucket(ready),
        "by_business_age": portfolio.by_business_age(ready),
        "by_size": portfolio.by_size_class(ready),
        "by_portion": portfolio.by_portion_band(ready),
        "by_collateral": portfolio.by_collateral(ready),
        "by_crisis": portfolio.by_crisis(ready),
        "by_year": portfolio.by_approval_year(ready),
        "by_sector": portfolio.by_sector(ready),
        "top_sectors": portfolio.top_risk_sectors(ready),
        "top_states": portfolio.top_states(ready),
        "default_share": portfolio.value_counts(ready, "Default"),
        "amounts": portfolio.histogram(ready, "GrAppv", 50),
        "amounts_by_size": portfolio.box_stats(ready, "GrAppv", seg.size_class()),
    }


def model_analysis(scored: DataFrame, factor: float = 1.0) -> dict[str, DataFrame]:
    """Model quality, expected loss and risk classes of a scored test set.

    ``scored`` is read by every table, so persist it first when it is costly.
    """
    classed = curves.risk_quintile(scored)
    defaults = scored.filter(c("Default") == 1)
    return {
        "report": metrics.model_report(scored, factor),
        "roc": curves.roc_curve(scored, drop_collinear=True),
        "confusion": metrics.confusion(scored),
        "classification": metrics.classification_report(scored),
        "pd_distribution": portfolio.histogram(scored, "pd", 50),
        "pd_by_outcome": metrics.score_by_outcome(scored),
        "reliability": metrics.reliability_table(scored),
        "lgd_quality": metrics.evaluate_lgd(scored),
        "pd_quality": metrics.evaluate_pd(scored),
        "lgd_residuals": metrics.residual_histogram(scored),
        "lgd_residual_summary": metrics.residual_summary(scored),
        "lgd_pairs": metrics.actual_vs_predicted(defaults, "lgd"),
        "el_pairs": metrics.actual_vs_predicted(scored, "el"),
        "cumulative_loss": curves.cumulative_loss_curve(scored),
        "accuracy_by_state": metrics.segment_accuracy(scored, c("State")),
        "loss_distribution": portfolio.histogram(defaults, "ChgOffPrinGr", 50),
        "lgd_distribution": portfolio.histogram(defaults, "lgd", 50),
        "el_distribution": portfolio.histogram(scored, "el", 50),
        "lift": curves.lift_by_percentile(scored),
        "loss_by_amount": portfolio.loss_by_amount_bucket(scored),
        "accuracy_by_amount": metrics.segment_accuracy(scored),
        "accuracy_by_term": metrics.segment_accuracy(scored, seg.term_bucket()),
        "risk_classes": quotes.risk_table_labels(curves.risk_summary(classed)),
        "calibration_by_sector": calibration.segment_calibration(scored, "SCIAN"),
        "totals": calibration.predicted_vs_actual(scored),
    }
