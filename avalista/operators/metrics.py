"""Model quality tables, each a single aggregate over the scored loans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from avalista.functions.segments import amount_bucket
from avalista.operators.encoding import split_hash
from avalista.operators.curves import area, auc, ranked_scores
from avalista.operators.portfolio import histogram, histogram_by_class

c = F.col
# Fixed value: smallest step of a double, as used to keep probabilities off 0 and 1.
EPSILON = 2.220446049250313e-16


def _brier(p, y):
    return F.avg(F.pow(p - y, F.lit(2.0)))


def _off_the_ends(p):
    return F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1.0 - EPSILON))


def _log_loss(p, y):
    safe = _off_the_ends(p)
    return F.avg(F.when(y == 1, -F.log(safe)).otherwise(-F.log(F.lit(1.0) - safe)))


def brier(scored: DataFrame, score="pd", label="Default") -> DataFrame:
    return scored.agg(_brier(c(score), c(label)).alias("brier"))


def log_loss(scored: DataFrame, score="pd", label="Default") -> DataFrame:
    return scored.agg(_log_loss(c(score), c(label)).alias("log_loss"))


def default_rates(scored: DataFrame, score="pd", label="Default") -> DataFrame:
    return scored.agg(F.avg(label).alias("default_rate_actual"), F.avg(score).alias("default_rate_predicted"))


def evaluate_pd(scored: DataFrame, score="pd", label="Default") -> DataFrame:
    """All probability measures in one row, from the counts per distinct score: one pass over the loans."""
    p, pos, neg = c("score"), c("pos").cast("double"), c("neg").cast("double")
    safe = _off_the_ends(p)
    n = F.sum(pos + neg)
    return ranked_scores(scored, score, label).agg(
        (F.sum(pos * F.pow(p - 1.0, F.lit(2.0)) + neg * F.pow(p, F.lit(2.0))) / n).alias("brier"),
        (F.sum(-pos * F.log(safe) - neg * F.log(F.lit(1.0) - safe)) / n).alias("log_loss"),
        (F.sum(pos) / n).alias("default_rate_actual"),
        (F.sum(p * (pos + neg)) / n).alias("default_rate_predicted"),
        area().alias("auc"),
    )


def _regression(y, p):
    """Aggregates for error measures; the total variation comes from the same pass."""
    return [
        F.count("*").alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.avg(F.pow(y - p, F.lit(2.0)))).alias("rmse"),
        F.sum(F.pow(y - p, F.lit(2.0))).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
        F.avg(y).alias("mean_actual"),
        F.avg(p).alias("mean_predicted"),
    ]


def _r2():
    return F.when(c("_sst") > 0, 1 - F.try_divide(c("_sse"), c("_sst")))


def evaluate_lgd(scored: DataFrame, prediction="lgd", actual="ChgOffPrinGr", defaults_only=True) -> DataFrame:
    rows = scored.filter(c("Default") == 1) if defaults_only else scored
    return rows.agg(*_regression(c(actual), c(prediction))).select(
        "n", "mae", "rmse", _r2().alias("r2"), "mean_actual", "mean_predicted"
    )


def _confusion_counts(scored, threshold, score, label):
    hit, y = c(score) >= threshold, c(label) == 1
    known = scored.filter(c(score).isNotNull() & c(label).isNotNull())
    return known.agg(
        F.count_if(~y & ~hit).alias("tn"), F.count_if(~y & hit).alias("fp"),
        F.count_if(y & ~hit).alias("fn"), F.count_if(y & hit).alias("tp"),
    )


def confusion(scored: DataFrame, threshold: float = 0.5, score="pd", label="Default") -> DataFrame:
    """All four cells, also the empty ones."""
    return _confusion_counts(scored, threshold, score, label).select(
        F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) as (actual, predicted, n)")
    )


def classification_report(scored: DataFrame, threshold: float = 0.5, score="pd", label="Default") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and both averages."""
    cells = _confusion_counts(scored, threshold, score, label)
    safe = lambda top, bottom: F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))
    sides = {"0": ("tn", "fn", "fp"), "1": ("tp", "fp", "fn")}
    rows = cells
    for k, (right, wrong, missed) in sides.items():
        rows = rows.withColumns({
            f"p{k}": safe(c(right), c(right) + c(wrong)),
            f"r{k}": safe(c(right), c(right) + c(missed)),
            f"s{k}": c(right) + c(missed),
        })
        rows = rows.withColumn(f"f{k}", safe(2 * c(f"p{k}") * c(f"r{k}"), c(f"p{k}") + c(f"r{k}")))
    n = c("s0") + c("s1")
    rows = rows.withColumns({"n": n, "acc": safe(c("tn") + c("tp"), n)})
    for m in "prf":
        rows = rows.withColumns({
            f"{m}m": (c(f"{m}0") + c(f"{m}1")) / 2,
            f"{m}w": safe(c(f"{m}0") * c("s0") + c(f"{m}1") * c("s1"), c("n")),
        })
    return rows.select(F.expr(
        "stack(5, '0', p0, r0, f0, s0, '1', p1, r1, f1, s1, 'accuracy', acc, acc, acc, n,"
        " 'macro avg', pm, rm, fm, n, 'weighted avg', pw, rw, fw, n)"
        " as (class, precision, recall, f1, support)"
    ))


def residuals(scored: DataFrame, prediction="lgd", actual="ChgOffPrinGr", key="LoanNr") -> DataFrame:
    """Booked minus predicted loss of every defaulted loan."""
    return scored.filter(c("Default") == 1).select(
        key, c(prediction).alias("predicted"), c(actual).alias("actual"),
        (c(actual) - c(prediction)).alias("residual"),
    )


def residual_summary(scored: DataFrame, prediction="lgd", actual="ChgOffPrinGr") -> DataFrame:
    return residuals(scored, prediction, actual).agg(
        F.count("*").alias("n"), F.avg("residual").alias("mean"), F.stddev_samp("residual").alias("std"),
        F.min("residual").alias("min"), F.max("residual").alias("max"),
    )


def residual_histogram(scored: DataFrame, bins: int = 50, prediction="lgd", actual="ChgOffPrinGr") -> DataFrame:
    return histogram(residuals(scored, prediction, actual), "residual", bins)


def reliability_table(scored: DataFrame, bins: int = 10, score="pd", label="Default") -> DataFrame:
    """Predicted against observed default rate per equal-width probability bin."""
    place = F.least(F.floor(c(score) * bins), F.lit(bins - 1).cast("long"))
    return (
        scored.filter(c(score).isNotNull())
        .groupBy(place.alias("bin"))
        .agg(F.count("*").alias("n"), F.avg(score).alias("predicted"), F.avg(label).alias("observed"))
    )


def score_by_outcome(scored: DataFrame, bins: int = 30, score="pd", label="Default") -> DataFrame:
    """One score histogram per actual class, each over its own range."""
    return histogram_by_class(scored, score, bins, label, [0, 1])


def model_report(scored: DataFrame, factor: float = 1.0, score="pd", lgd="lgd", el="el", loss="ChgOffPrinGr") -> DataFrame:
    """Headline figures of a scored test set in one row."""
    defaulted = c("Default") == 1
    y, p = F.when(defaulted, c(loss)), F.when(defaulted, c(lgd))
    sums = scored.agg(
        *_regression(y, p), F.sum(el).alias("predicted_loss"), F.sum(loss).alias("actual_loss")
    )
    ratio = F.when(c("actual_loss") > 0, F.try_divide(c("predicted_loss"), c("actual_loss"))).otherwise(F.lit(0.0))
    return sums.select(
        auc(scored, score).select("auc").scalar().alias("auc"),
        "mae", _r2().alias("r2"), F.lit(float(factor)).alias("factor"),
        "predicted_loss", "actual_loss", ratio.alias("ratio"),
    )


def segment_accuracy(scored: DataFrame, segment: Column | None = None, name="segment", el="el", loss="ChgOffPrinGr") -> DataFrame:
    """Error measures of expected loss and predicted-to-booked ratio per segment."""
    segment = amount_bucket() if segment is None else segment
    return (
        scored.groupBy(segment.alias(name))
        .agg(*_regression(c(loss), c(el)), F.sum(el).alias("predicted"), F.sum(loss).alias("actual"))
        .filter(c(name).isNotNull())
        .select(
            name, "n", "mae", "rmse", _r2().alias("r2"), "mean_actual", "mean_predicted",
            F.when(c("actual") > 0, F.try_divide(c("predicted"), c("actual"))).otherwise(F.lit(0.0)).alias("ratio"),
        )
    )


def actual_vs_predicted(scored: DataFrame, what="lgd", fraction: float = 1.0, seed: int = 42, key="LoanNr", loss="ChgOffPrinGr") -> DataFrame:
    """Pairs for a scatter plot: LGD on defaults, EL on all loans.

    Below fraction 1 the loans whose digest is among that lowest share of all digests: the same on every run and layout.
    """
    rows = scored.filter(c("Default") == 1) if what == "lgd" else scored
    if fraction < 1:
        rows = rows.filter(F.substring(split_hash(key, seed), 1, 8) < F.lit(format(int(fraction * 2**32), "08x")))
    return rows.select(key, c(what).alias("predicted"), c(loss).alias("actual"))
