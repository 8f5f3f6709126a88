"""Calibration, ordered curves and model-quality tables on the scored view."""

from pyspark.sql import functions as F

from avalista.catalog.features import AMOUNT_SQL, TERM_SQL
from avalista.catalog.loan_view import scored
from avalista.catalog.portfolio import _histogram_sql
from avalista.catalog.registry import query, rounded
from avalista.functions.segments import amount_bucket, term_bucket
from avalista.operators import calibration as cal
from avalista.operators import curves as w
from avalista.operators import metrics as e
from avalista.operators.quotes import risk_table_labels

c = F.col


@query("predict_el", "SELECT LoanNr, pd * lgd * 1.25e0 AS el FROM scored")
def _(spark, sf):
    return cal.predict_el(scored(spark, sf), 1.25).select("LoanNr", "el")


@query("calibration_factor", "SELECT round(sum(ChgOffPrinGr), 2) AS actual, round(sum(el), 1) AS predicted, round(CASE WHEN sum(el) > 0 THEN sum(ChgOffPrinGr) / sum(el) ELSE 1e0 END, 8) AS factor FROM scored")
def _(spark, sf):
    return rounded(cal.calibration_factor(scored(spark, sf)), actual=2, predicted=1, factor=8)


@query("segment_calibration", "SELECT State, round(sum(ChgOffPrinGr), 2) AS actual, round(sum(el), 1) AS predicted, round(CASE WHEN State IS NULL OR sum(el) <= 0 THEN 1e0 ELSE sum(ChgOffPrinGr) / sum(el) END, 8) AS factor FROM (SELECT * REPLACE (CASE WHEN LoanNr % 89 <> 0 THEN State END AS State) FROM scored) GROUP BY State")
def _(spark, sf):
    gaps = scored(spark, sf).withColumn("State", F.when(c("LoanNr") % 89 != 0, c("State")))
    return rounded(cal.segment_calibration(gaps, "State"), actual=2, predicted=1, factor=8)


@query("segment_calibration_term", f"SELECT {TERM_SQL} AS bucket, round(sum(ChgOffPrinGr), 2) AS actual, round(sum(el), 1) AS predicted, round(sum(ChgOffPrinGr) / sum(el), 8) AS factor FROM scored GROUP BY 1")
def _(spark, sf):
    view = scored(spark, sf).withColumn("bucket", term_bucket())
    return rounded(cal.segment_calibration(view, "bucket"), actual=2, predicted=1, factor=8)


@query("predicted_vs_actual", "SELECT round(sum(el), 1) AS predicted, round(sum(ChgOffPrinGr), 2) AS actual, round(CASE WHEN sum(ChgOffPrinGr) > 0 THEN sum(el) / sum(ChgOffPrinGr) ELSE 0e0 END, 8) AS ratio FROM scored")
def _(spark, sf):
    return rounded(cal.predicted_vs_actual(scored(spark, sf)), predicted=1, actual=2, ratio=8)


QUINTILE_SQL = """edges AS (SELECT quantile_cont(el, 0.2) AS e1, quantile_cont(el, 0.4) AS e2, quantile_cont(el, 0.6) AS e3, quantile_cont(el, 0.8) AS e4 FROM scored),
classed AS (SELECT s.*, CASE WHEN el <= e1 THEN 'Muy Bajo' WHEN el <= e2 THEN 'Bajo' WHEN el <= e3 THEN 'Medio' WHEN el <= e4 THEN 'Alto' ELSE 'Muy Alto' END AS risk_category,
  CASE WHEN el <= e1 THEN 1 WHEN el <= e2 THEN 2 WHEN el <= e3 THEN 3 WHEN el <= e4 THEN 4 ELSE 5 END AS risk_category_ord FROM scored s, edges)"""


@query("risk_quintile", f", {QUINTILE_SQL} SELECT LoanNr, risk_category, risk_category_ord FROM classed")
def _(spark, sf):
    return w.risk_quintile(scored(spark, sf)).select("LoanNr", "risk_category", "risk_category_ord")


@query("risk_tercile_on_ties", """, few AS (SELECT LoanNr, CASE WHEN LoanNr % 10 = 0 THEN 1 WHEN LoanNr % 10 <= 5 THEN 2 WHEN LoanNr % 10 <= 8 THEN 3 ELSE 4 END AS x FROM scored),
  edges AS (SELECT quantile_cont(x, 1/3) AS t1, quantile_cont(x, 2/3) AS t2 FROM few)
  SELECT LoanNr, CASE WHEN x <= t1 THEN 'Bajo' WHEN x <= t2 THEN 'Medio' ELSE 'Alto' END AS risk_category, CASE WHEN x <= t1 THEN 1 WHEN x <= t2 THEN 2 ELSE 3 END AS risk_category_ord
  FROM few, edges""")
def _(spark, sf):
    """Half of the loans share one score, so five classes do not fit and three are made."""
    digit = c("LoanNr") % 10
    x = F.when(digit == 0, 1).when(digit <= 5, 2).when(digit <= 8, 3).otherwise(4)
    few = scored(spark, sf).withColumn("x", x)
    return w.risk_quintile(few, "x").select("LoanNr", "risk_category", "risk_category_ord")


@query("risk_summary", f", {QUINTILE_SQL} SELECT risk_category, risk_category_ord, count(*) AS n, round(avg(el), 3) AS mean_el, round(avg((ChgOffPrinGr > 0)::INTEGER), 8) AS default_rate FROM classed GROUP BY 1, 2")
def risk_summary(spark, sf):
    return rounded(w.risk_summary(w.risk_quintile(scored(spark, sf))), mean_el=3, default_rate=8)


@query("risk_table_labels", f""", {QUINTILE_SQL} SELECT risk_category, count(*) AS n, format('${{:,.0f}}', avg(el)) AS mean_el_label,
  format('{{:.1f}}%', avg((ChgOffPrinGr > 0)::INTEGER) * 100) AS default_rate_label FROM classed GROUP BY 1""")
def _(spark, sf):
    summary = w.risk_summary(w.risk_quintile(scored(spark, sf)))
    return risk_table_labels(summary).select("risk_category", "n", "mean_el_label", "default_rate_label")


CURVE_SQL = """curve AS (SELECT LoanNr, row_number() OVER o AS position, count(*) OVER () AS n,
  sum(el) OVER (o ROWS UNBOUNDED PRECEDING) AS cum_el, sum(ChgOffPrinGr) OVER (o ROWS UNBOUNDED PRECEDING) AS cum_loss, sum(ChgOffPrinGr) OVER () AS total_loss
  FROM scored WINDOW o AS (ORDER BY el DESC, LoanNr))"""


@query("cumulative_loss_curve", f", {CURVE_SQL} SELECT LoanNr, position, round(position / n * 100, 8) AS pct, round(cum_el / 1e6, 4) AS cum_el_millions, round(cum_loss, 2) AS cum_loss FROM curve")
def cumulative_loss_curve(spark, sf):
    curve = w.cumulative_loss_curve(scored(spark, sf))
    return rounded(
        curve.select("LoanNr", "position", "pct", (c("cum_el") / 1e6).alias("cum_el_millions"), "cum_loss"),
        pct=8, cum_el_millions=4, cum_loss=2,
    )


@query("lift_by_percentile", f", {CURVE_SQL} SELECT ceil(position * 100 / n)::BIGINT AS pct, max(position) AS n_loans, round(max(cum_el) / 1e6, 4) AS cum_el, round(max(cum_loss), 2) AS cum_loss, round(max(cum_loss / total_loss), 8) AS loss_share FROM curve GROUP BY 1")
def _(spark, sf):
    lift = w.lift_by_percentile(scored(spark, sf)).withColumn("cum_el", c("cum_el") / 1e6)
    return rounded(lift, cum_el=4, cum_loss=2, loss_share=8)


ROC_SQL = """s AS (SELECT pd AS score, sum("Default")::BIGINT AS pos, (count(*) - sum("Default"))::BIGINT AS neg FROM scored GROUP BY 1),
pts AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(neg) OVER (ORDER BY score DESC)::BIGINT AS fp, (SELECT sum(pos) FROM s)::BIGINT AS np, (SELECT sum(neg) FROM s)::BIGINT AS nn,
  lead(pos) OVER (ORDER BY score DESC) AS next_pos, lead(neg) OVER (ORDER BY score DESC) AS next_neg, row_number() OVER (ORDER BY score DESC) AS place FROM s)"""


@query("roc_curve", f", {ROC_SQL} SELECT score AS threshold, round(fp / nn, 8) AS fpr, round(tp / np, 8) AS tpr FROM pts UNION ALL SELECT NULL, 0e0, 0e0")
def _(spark, sf):
    return rounded(w.roc_curve(scored(spark, sf)), fpr=8, tpr=8)


@query("roc_curve_corners", f", {ROC_SQL} SELECT score AS threshold, round(fp / nn, 8) AS fpr, round(tp / np, 8) AS tpr FROM pts WHERE place = 1 OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg UNION ALL SELECT NULL, 0e0, 0e0")
def _(spark, sf):
    return rounded(w.roc_curve(scored(spark, sf), drop_collinear=True), fpr=8, tpr=8)


AUC_SQL = "(SELECT sum(pos::DOUBLE * (nn - fp + neg / 2e0)) / (any_value(np)::DOUBLE * any_value(nn)) FROM pts)"


@query("auc", f", {ROC_SQL} SELECT round({AUC_SQL}, 10) AS auc, any_value(np) AS n_pos, any_value(nn) AS n_neg FROM pts")
def auc(spark, sf):
    return rounded(w.auc(scored(spark, sf)), auc=10)


BRIER_SQL = 'avg(pow(pd - "Default", 2))'
LOG_LOSS_SQL = 'avg(CASE WHEN "Default" = 1 THEN -ln(least(greatest(pd, 2.220446049250313e-16), 1e0 - 2.220446049250313e-16)) ELSE -ln(1e0 - least(greatest(pd, 2.220446049250313e-16), 1e0 - 2.220446049250313e-16)) END)'


@query("brier", f"SELECT round({BRIER_SQL}, 8) AS brier FROM scored")
def _(spark, sf):
    return rounded(e.brier(scored(spark, sf)), brier=8)


@query("log_loss", f"SELECT round({LOG_LOSS_SQL}, 8) AS log_loss FROM scored")
def _(spark, sf):
    return rounded(e.log_loss(scored(spark, sf)), log_loss=8)


@query("default_rates", 'SELECT round(avg("Default"), 10) AS default_rate_actual, round(avg(pd), 10) AS default_rate_predicted FROM scored')
def _(spark, sf):
    return rounded(e.default_rates(scored(spark, sf)), default_rate_actual=10, default_rate_predicted=10)


@query("evaluate_pd", f', {ROC_SQL} SELECT round({BRIER_SQL}, 8) AS brier, round({LOG_LOSS_SQL}, 8) AS log_loss, round(avg("Default"), 10) AS default_rate_actual, round(avg(pd), 10) AS default_rate_predicted, round({AUC_SQL}, 10) AS auc FROM scored')
def _(spark, sf):
    return rounded(e.evaluate_pd(scored(spark, sf)), brier=8, log_loss=8, default_rate_actual=10, default_rate_predicted=10, auc=10)


def _errors_sql(y, p):
    return f"""round(avg(abs({y} - {p})), 4) AS mae, round(sqrt(avg(pow({y} - {p}, 2))), 4) AS rmse,
      round(1 - sum(pow({y} - {p}, 2)) / (var_pop({y}) * count({y})), 8) AS r2, round(avg({y}), 4) AS mean_actual, round(avg({p}), 4) AS mean_predicted"""


@query("evaluate_lgd", 'SELECT count(*) AS n, ' + _errors_sql("ChgOffPrinGr", "lgd") + ' FROM scored WHERE "Default" = 1')
def _(spark, sf):
    return rounded(e.evaluate_lgd(scored(spark, sf)), mae=4, rmse=4, r2=8, mean_actual=4, mean_predicted=4)


@query("confusion", """SELECT a AS actual, p AS predicted, count(LoanNr) AS n FROM (SELECT unnest([0,0,1,1]) AS a, unnest([0,1,0,1]) AS p)
  LEFT JOIN (SELECT LoanNr, "Default" AS d, (pd >= 0.05e0)::INTEGER AS h FROM scored) ON a = d AND p = h GROUP BY 1, 2""")
def _(spark, sf):
    return e.confusion(scored(spark, sf), 0.05)


@query("confusion_half", """SELECT a AS actual, p AS predicted, count(LoanNr) AS n FROM (SELECT unnest([0,0,1,1]) AS a, unnest([0,1,0,1]) AS p)
  LEFT JOIN (SELECT LoanNr, "Default" AS d, (pd >= 0.5e0)::INTEGER AS h FROM scored) ON a = d AND p = h GROUP BY 1, 2""")
def _(spark, sf):
    return e.confusion(scored(spark, sf))


@query("classification_report", """, cm AS (SELECT count(*) FILTER (WHERE y = 0 AND h = 0) AS tn, count(*) FILTER (WHERE y = 0 AND h = 1) AS fp, count(*) FILTER (WHERE y = 1 AND h = 0) AS fn, count(*) FILTER (WHERE y = 1 AND h = 1) AS tp
    FROM (SELECT "Default" AS y, (pd >= 0.05e0)::INTEGER AS h FROM scored)),
  pr AS (SELECT *, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn + fp AS s0, tp + fn AS s1 FROM cm),
  f AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1 FROM pr)
  SELECT '0' AS class, round(p0, 8) AS precision, round(r0, 8) AS recall, round(f0, 8) AS f1, s0 AS support FROM f
  UNION ALL SELECT '1', round(p1, 8), round(r1, 8), round(f1, 8), s1 FROM f
  UNION ALL SELECT 'accuracy', round((tn + tp) / (s0 + s1), 8), round((tn + tp) / (s0 + s1), 8), round((tn + tp) / (s0 + s1), 8), s0 + s1 FROM f
  UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 8), round((r0 + r1) / 2, 8), round((f0 + f1) / 2, 8), s0 + s1 FROM f
  UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / (s0 + s1), 8), round((r0 * s0 + r1 * s1) / (s0 + s1), 8), round((f0 * s0 + f1 * s1) / (s0 + s1), 8), s0 + s1 FROM f""")
def _(spark, sf):
    return rounded(e.classification_report(scored(spark, sf), 0.05), precision=8, recall=8, f1=8)


@query("residuals", 'SELECT LoanNr, lgd AS predicted, ChgOffPrinGr AS actual, round(ChgOffPrinGr - lgd, 2) + 0e0 AS residual FROM scored WHERE "Default" = 1')
def _(spark, sf):
    return rounded(e.residuals(scored(spark, sf)), residual=2)


@query("residual_summary", 'SELECT count(*) AS n, round(avg(ChgOffPrinGr - lgd), 4) AS mean, round(stddev_samp(ChgOffPrinGr - lgd), 4) AS std, round(min(ChgOffPrinGr - lgd), 2) AS min, round(max(ChgOffPrinGr - lgd), 2) AS max FROM scored WHERE "Default" = 1')
def _(spark, sf):
    return rounded(e.residual_summary(scored(spark, sf)), mean=4, std=4, min=2, max=2)


@query("residual_histogram", "SELECT * FROM " + _histogram_sql("ChgOffPrinGr - lgd", "scored", 50, '"Default" = 1'))
def _(spark, sf):
    return rounded(e.residual_histogram(scored(spark, sf)), bin_lo=6, bin_hi=6, mean=6)


@query("reliability_table", 'SELECT least(floor(pd * 10e0 * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(pd * 10e0), 8) AS predicted, round(avg("Default"), 8) AS observed FROM scored GROUP BY 1')
def _(spark, sf):
    return rounded(e.reliability_table(scored(spark, sf).withColumn("pd", c("pd") * 10.0)), predicted=8, observed=8)


@query("score_by_outcome", "SELECT * FROM " + _histogram_sql("pd", "scored", 30, '"Default" = 0', ", 0 AS actual") + " UNION ALL SELECT * FROM " + _histogram_sql("pd", "scored", 30, '"Default" = 1', ", 1 AS actual"))
def _(spark, sf):
    return rounded(e.score_by_outcome(scored(spark, sf)), bin_lo=6, bin_hi=6, mean=6)


@query("model_report", f""", {ROC_SQL} SELECT round({AUC_SQL}, 10) AS auc, round(avg(abs(ChgOffPrinGr - lgd)) FILTER (WHERE "Default" = 1), 4) AS mae,
  round((SELECT 1 - sum(pow(ChgOffPrinGr - lgd, 2)) / (var_pop(ChgOffPrinGr) * count(*)) FROM scored WHERE "Default" = 1), 8) AS r2, 1e0 AS factor,
  round(sum(el), 1) AS predicted_loss, round(sum(ChgOffPrinGr), 2) AS actual_loss, round(sum(el) / sum(ChgOffPrinGr), 8) AS ratio FROM scored""")
def _(spark, sf):
    return rounded(e.model_report(scored(spark, sf)), auc=10, mae=4, r2=8, predicted_loss=1, actual_loss=2, ratio=8)


@query("segment_accuracy", f"SELECT {AMOUNT_SQL} AS segment, count(*) AS n, {_errors_sql('ChgOffPrinGr', 'el')}, round(sum(el) / sum(ChgOffPrinGr), 8) AS ratio FROM scored WHERE GrAppv > 0 GROUP BY 1")
def _(spark, sf):
    return rounded(e.segment_accuracy(scored(spark, sf), amount_bucket()), mae=4, rmse=4, r2=8, mean_actual=4, mean_predicted=4, ratio=8)


@query("actual_vs_predicted_lgd", 'SELECT LoanNr, lgd AS predicted, ChgOffPrinGr AS actual FROM scored WHERE "Default" = 1')
def _(spark, sf):
    return e.actual_vs_predicted(scored(spark, sf), "lgd")


@query("actual_vs_predicted_el", "SELECT LoanNr, el AS predicted, ChgOffPrinGr AS actual FROM scored")
def _(spark, sf):
    return e.actual_vs_predicted(scored(spark, sf), "el")


@query("actual_vs_predicted_sample", "SELECT LoanNr, el AS predicted, ChgOffPrinGr AS actual FROM scored WHERE substring(md5(LoanNr::VARCHAR || '|42'), 1, 8) < '19999999'")
def _(spark, sf):
    """A tenth of the pairs, drawn by digest of the loan id."""
    return e.actual_vs_predicted(scored(spark, sf), "el", fraction=0.1)
