"""Expected loss and its calibration to the losses that were booked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def predict_el(scored: DataFrame, factor: float | Column = 1.0, name="el") -> DataFrame:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return scored.withColumn(name, c("pd") * c("lgd") * factor)


def _factor(actual, predicted) -> Column:
    return F.when(predicted > 0, F.try_divide(actual, predicted)).otherwise(F.lit(1.0))


def calibration_factor(scored: DataFrame, el="el", loss="ChgOffPrinGr") -> DataFrame:
    """One row: booked over predicted loss; 1 when nothing is predicted."""
    sums = scored.agg(F.sum(loss).alias("actual"), F.sum(el).alias("predicted"))
    return sums.select("actual", "predicted", _factor(c("actual"), c("predicted")).alias("factor"))


def segment_calibration(scored: DataFrame, segment: str, el="el", loss="ChgOffPrinGr") -> DataFrame:
    """One factor per segment; the null segment keeps factor 1."""
    sums = scored.groupBy(segment).agg(F.sum(loss).alias("actual"), F.sum(el).alias("predicted"))
    factor = F.when(c(segment).isNull(), F.lit(1.0)).otherwise(_factor(c("actual"), c("predicted")))
    return sums.select(segment, "actual", "predicted", factor.alias("factor"))


def predicted_vs_actual(scored: DataFrame, el="el", loss="ChgOffPrinGr") -> DataFrame:
    sums = scored.agg(F.sum(el).alias("predicted"), F.sum(loss).alias("actual"))
    ratio = F.when(c("actual") > 0, F.try_divide(c("predicted"), c("actual"))).otherwise(F.lit(0.0))
    return sums.select("predicted", "actual", ratio.alias("ratio"))
