"""Risk quantiles, cumulative curves, ROC and AUC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from avalista.operators.ordered import quantiles, running_totals, thin_out
from avalista.session import cut_lineage

c = F.col

# Labels of the risk quantiles.
FIVE = ["Muy Bajo", "Bajo", "Medio", "Alto", "Muy Alto"]
THREE = ["Bajo", "Medio", "Alto"]


def risk_edges(scored: DataFrame, column="el", accuracy: int | None = None) -> dict[str, float]:
    """Minimum, quintile and tercile edges and maximum of a score: eight numbers, fitted once."""
    points = {f"q{i}": i / 5 for i in range(6)} | {"t1": 1 / 3, "t2": 2 / 3}
    return quantiles(scored, column, points, accuracy=accuracy).first().asDict()


def risk_quintile(
    scored: DataFrame, column="el", name="risk_category", edges: dict[str, float] | None = None, accuracy: int | None = None
) -> DataFrame:
    """Five classes by quantile edges, right-closed, the minimum in the first one.

    Repeated edges fall back to three classes; if those repeat too, it raises.
    Equal values always share a class. Pass ``edges`` to reuse those of another table.
    """
    at = edges or risk_edges(scored, column, accuracy)
    five = [at[f"q{i}"] for i in range(6)]
    three = [at["q0"], at["t1"], at["t2"], at["q5"]]
    for cuts, labels in ((five, FIVE), (three, THREE)):
        if None not in cuts and all(low < high for low, high in zip(cuts, cuts[1:])):
            break
    else:
        raise ValueError(f"{column} has too few distinct values for risk classes")
    bounds = [None, *cuts[1:-1], None]
    return scored.withColumns({
        name: _class_of(c(column), bounds, labels),
        f"{name}_ord": _class_of(c(column), bounds, list(range(1, len(labels) + 1))),
    })


def _class_of(value, bounds, results):
    out = F.when(value.isNull(), F.lit(None))
    for upper, result in zip(bounds[1:-1], results):
        out = out.when(value <= upper, F.lit(result))
    return out.otherwise(F.lit(results[-1]))


def risk_summary(classified: DataFrame, category="risk_category", el="el", loss="ChgOffPrinGr") -> DataFrame:
    lost = (c(loss) > 0).cast("double")
    return (
        classified.groupBy(category, f"{category}_ord")
        .agg(F.count("*").alias("n"), F.avg(el).alias("mean_el"), F.avg(F.coalesce(lost, F.lit(0.0))).alias("default_rate"))
        .filter(c(category).isNotNull())
    )


def cumulative_loss_curve(scored: DataFrame, el="el", loss="ChgOffPrinGr", key="LoanNr") -> DataFrame:
    """Loans by falling expected loss with running predicted and booked loss.

    Ties are ordered by loan id. ``pct`` is the share of loans so far, in percent.
    """
    narrow = scored.select(key, c(el).alias("el"), c(loss).alias("loss"))
    run = _cumulative(narrow, [c("el").desc(), c(key).asc()], F.lit(1))
    return run.withColumn("pct", c("position") / c("position_total") * 100)


def lift_by_percentile(scored: DataFrame, el="el", loss="ChgOffPrinGr", key="LoanNr") -> DataFrame:
    """The cumulative curve read at 1, 2, ... 100 percent of the loans.

    Only loans near a percent boundary are sorted one by one; those between two
    boundaries are summed. If a sum turns out to span a boundary, all are sorted.
    """
    narrow = scored.select(c(key).alias("key"), c(el).alias("el"), c(loss).alias("loss"))
    data = narrow.withColumn("_value", -c("el").cast("double"))
    thin = thin_out(data, [i / 100 for i in range(1, 100)])
    if thin is not None and not data.filter(c("_value").isNull()).limit(1).count():
        rows = thin.groupBy("_place", "_gap", F.when(~c("_gap"), c("key")).alias("key")).agg(
            F.count("*").alias("n"), F.sum("el").alias("el"), F.sum("loss").alias("loss")
        )
        run = cut_lineage(_cumulative(rows, [c("_place").asc(), c("key").asc()], c("n")))
        started = F.ceil((c("position") - c("n") + 1) * 100 / c("position_total"))
        if not run.filter(c("_gap") & (started != _percent_of())).limit(1).count():
            return _at_percents(run)
    return _at_percents(_cumulative(narrow, [c("el").desc(), c("key").asc()], F.lit(1)))


def _cumulative(rows, order, count):
    measures = {"position": count, "cum_el": c("el"), "cum_loss": c("loss")}
    return running_totals(rows, order, measures, totals=True)


def _percent_of():
    return F.ceil(c("position") * 100 / c("position_total"))


def _at_percents(curve):
    return curve.groupBy(_percent_of().alias("pct")).agg(
        F.max("position").alias("n_loans"),
        F.max("cum_el").alias("cum_el"),
        F.max("cum_loss").alias("cum_loss"),
        F.max(F.try_divide(c("cum_loss"), c("cum_loss_total"))).alias("loss_share"),
    )


def score_counts(scored: DataFrame, score="pd", label="Default") -> DataFrame:
    """Positives and negatives per distinct score; ties collapse before any sorting."""
    return (
        scored.filter(c(score).isNotNull() & c(label).isNotNull())
        .groupBy(c(score).alias("score"))
        .agg(F.sum((c(label) == 1).cast("long")).alias("pos"), F.sum((c(label) != 1).cast("long")).alias("neg"))
    )


def ranked_scores(scored: DataFrame, score="pd", label="Default") -> DataFrame:
    """Distinct scores from the highest, with running and total positives and negatives."""
    return running_totals(
        score_counts(scored, score, label), [c("score").desc()], {"tp": c("pos"), "fp": c("neg")}, totals=True
    )


def roc_curve(scored: DataFrame, score="pd", label="Default", drop_collinear: bool = False) -> DataFrame:
    """One point per distinct score, from (0, 0); rates are null when a class is absent.

    ``drop_collinear`` leaves out points in the middle of equal steps.
    """
    ranked = ranked_scores(scored, score, label)
    if drop_collinear:
        ranked = _corners(ranked)
    points = ranked.select(
        c("score").alias("threshold"),
        F.try_divide(c("fp").cast("double"), c("fp_total")).alias("fpr"),
        F.try_divide(c("tp").cast("double"), c("tp_total")).alias("tpr"),
    )
    origin = scored.sparkSession.range(0, 1, 1, 1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(points)


def _corners(ranked: DataFrame) -> DataFrame:
    """Drop points whose step to the next point repeats the step that led to them.

    The first and the last point always stay.
    """
    numbered = running_totals(ranked, [c("score").desc()], {"place": F.lit(1)})
    following = numbered.select((c("place") - 1).alias("place"), c("pos").alias("next_pos"), c("neg").alias("next_neg"))
    turned = (c("pos") != c("next_pos")) | (c("neg") != c("next_neg"))
    ends = (c("place") == 1) | c("next_pos").isNull()
    return numbered.join(following, "place", "left").filter(ends | turned)


def area() -> Column:
    """Area under the ROC curve as an aggregate over ``ranked_scores``."""
    below = c("fp_total") - c("fp")
    wins = F.sum(c("pos").cast("double") * (below + c("neg") / 2.0))
    return F.try_divide(wins, F.max("tp_total").cast("double") * F.max("fp_total"))


def auc(scored: DataFrame, score="pd", label="Default") -> DataFrame:
    """Exact area under the ROC curve; ties count half; null when only one class is present."""
    return ranked_scores(scored, score, label).agg(
        area().alias("auc"), F.max("tp_total").alias("n_pos"), F.max("fp_total").alias("n_neg")
    )
