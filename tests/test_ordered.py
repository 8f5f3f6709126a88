"""Running totals, quantiles and curves against plain Python, with hot ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from avalista.catalog.loan_view import scored
from avalista.operators import curves, ordered, portfolio

c = F.col


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one value; ids tell them apart."""
    return spark.range(3000).select(
        c("id").alias("LoanNr"),
        F.when(c("id") % 3 == 0, 7.0).otherwise((c("id") * 7919 % 1009).cast("double")).alias("el"),
        (c("id") % 5).cast("double").alias("ChgOffPrinGr"),
        F.when(c("id") % 2 == 0, "a").when(c("id") % 7 != 0, "b").alias("grp"),
    )


def test_running_totals_match_a_window(hot):
    order = [c("el").desc(), c("LoanNr").asc()]
    got = ordered.running_totals(hot, order, {"cum": c("ChgOffPrinGr"), "place": F.lit(1)}, parts=7)
    plain = hot.withColumns({
        "cum": F.sum("ChgOffPrinGr").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)),
        "place": F.row_number().over(Window.orderBy(*order)),
    })
    a = got.select("LoanNr", "cum", "place").orderBy("LoanNr").toPandas()
    b = plain.select("LoanNr", "cum", "place").orderBy("LoanNr").toPandas()
    assert (a.values == b.values).all()


def test_hot_value_spreads_over_parts(hot):
    ties = hot.filter("el = 7.0")
    parts = ties.withColumn("part", ordered.part_of(ties, [c("el").desc(), c("LoanNr").asc()], 8))
    sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 400


def test_running_totals_with_nulls_in_the_order(spark):
    rows = [(i, None if i % 4 == 0 else float(i % 9)) for i in range(300)]
    table = spark.createDataFrame(rows, "k long, x double")
    for order in ([c("x").desc(), c("k").asc()], [c("x").asc(), c("k").desc()], [c("x").desc_nulls_first(), c("k").asc()]):
        along = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        want = {r.k: r.n for r in table.withColumn("n", F.count("*").over(along)).collect()}
        got = {r.k: r.n for r in ordered.running_totals(table, order, {"n": F.lit(1)}, parts=11).collect()}
        assert got == want


def test_parts_follow_the_rows(hot, monkeypatch):
    order = [c("el").desc(), c("LoanNr").asc()]
    seen = []
    part_of = ordered.part_of
    monkeypatch.setattr(ordered, "part_of", lambda df, order, parts: seen.append(parts) or part_of(df, order, parts))
    for least, most in ((1 << 14, 1 << 20), (100, 1 << 20), (10, 50)):
        monkeypatch.setattr(ordered, "LEAST_ROWS", least)
        monkeypatch.setattr(ordered, "PART_ROWS", most)
        got = ordered.running_totals(hot, order, {"place": F.lit(1)}).orderBy(*order).select("place").toPandas()["place"]
        assert list(got) == list(range(1, len(got) + 1))
    assert seen == [1, 8, 60]


def test_running_totals_by_group_with_null_group(hot):
    got = ordered.running_totals(hot, [c("LoanNr").asc()], {"place": F.lit(1)}, ["grp"], totals=True, parts=5)
    frame = got.toPandas().sort_values("LoanNr")
    for _, part in frame.groupby("grp", dropna=False):
        assert list(part["place"]) == list(range(1, len(part) + 1))
        assert set(part["place_total"]) == {len(part)}


@pytest.mark.parametrize("p", [0.0, 0.25, 1 / 3, 0.5, 0.8, 1.0])
def test_quantiles_match_numpy(hot, p):
    want = np.quantile([r.el for r in hot.select("el").collect()], p)
    assert ordered.exact_quantiles(hot, "el", {"q": p}).first().q == pytest.approx(want)


def test_quantiles_by_group(hot):
    got = {r.grp: r.m for r in ordered.exact_quantiles(hot, "el", {"m": 0.5}, ["grp"]).collect()}
    want = hot.toPandas().groupby("grp", dropna=False)["el"].median()
    assert got["a"] == want["a"] and got["b"] == want["b"]


def test_approximate_quantiles(hot):
    assert ordered.quantiles(hot, "LoanNr", {"m": 0.5}, accuracy=1000).first().m == pytest.approx(1500, abs=5)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "x double")
    row = ordered.exact_quantiles(empty, "x", {"m": 0.5}).first()
    assert row.m is None


def test_risk_classes_match_pandas(spark):
    values = [float(x * 37 % 101) for x in range(500)]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, el double")
    got = curves.risk_quintile(table).orderBy("i").toPandas()["risk_category"]
    want = pd.qcut(pd.Series(values), 5, labels=curves.FIVE).astype(str)
    assert list(got) == list(want)


def test_risk_classes_keep_ties_together_and_fail_on_constants(spark):
    table = spark.createDataFrame([(1.0,)] * 10, "el double")
    with pytest.raises(ValueError):
        curves.risk_quintile(table)


def test_curve_ends_at_the_totals(spark, sf):
    view = scored(spark, sf)
    total = view.agg(F.sum("ChgOffPrinGr"), F.sum("el"), F.count("*")).first()
    last = curves.cumulative_loss_curve(view).orderBy(c("position").desc()).first()
    assert last.pct == 100 and last.position == total[2]
    assert last.cum_loss == pytest.approx(total[0]) and last.cum_el == pytest.approx(total[1])


def test_auc_matches_brute_force_and_library(spark, sf):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    view = scored(spark, sf).select("pd", "Default")
    rows = view.collect()
    pos = np.array([r.pd for r in rows if r.Default == 1])
    neg = np.array([r.pd for r in rows if r.Default == 0])
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    got = curves.auc(view).first().auc
    assert got == pytest.approx(want)
    vectors = view.withColumn("raw", array_to_vector(F.array(1 - c("pd"), c("pd"))))
    ml = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="Default", numBins=0).evaluate(vectors)
    assert got == pytest.approx(ml)


def test_auc_of_one_class_is_null(spark):
    table = spark.createDataFrame([(0.1, 0), (0.2, 0)], "pd double, Default int")
    assert curves.auc(table).first().auc is None


def test_corner_points_keep_the_curve(spark):
    table = spark.createDataFrame([(1 - i / 10, int(i < 3)) for i in range(10)], "pd double, Default int")
    corners = curves.roc_curve(table, drop_collinear=True).orderBy("fpr", "tpr").collect()
    assert [(round(p.fpr, 4), round(p.tpr, 4)) for p in corners] == [(0, 0), (0, 0.3333), (0, 1), (1, 1)]


def test_histogram_counts_every_row(hot):
    rows = portfolio.histogram(hot, "el", 20).orderBy("bin").collect()
    counts, edges = np.histogram([r.el for r in hot.select("el").collect()], 20)
    assert [r.n for r in rows] == list(counts)
    assert [r.bin_lo for r in rows] == pytest.approx(list(edges[:-1]))


def test_histogram_of_a_constant(spark):
    table = spark.createDataFrame([(5.0,)] * 4, "x double")
    rows = portfolio.histogram(table, "x", 10).collect()
    assert sum(r.n for r in rows) == 4 and min(r.bin_lo for r in rows) == 4.5


def test_histogram_in_a_given_range(hot):
    rows = portfolio.histogram(hot, "el", 10, lo=0, hi=100).collect()
    assert sum(r.n for r in rows) == hot.filter("el between 0 and 100").count()


def test_box_stats_match_numpy(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    table = spark.createDataFrame([("x", v) for v in values] + [("y", 5.0)], "g string, v double")
    rows = {r.segment: r for r in portfolio.box_stats(table, "v", c("g")).collect()}
    assert (rows["x"].q1, rows["x"].median, rows["x"].q3) == (2, 3, 4)
    assert (rows["x"].whisker_lo, rows["x"].whisker_hi, rows["x"].n_outliers) == (1, 4, 1)
    assert (rows["y"].whisker_lo, rows["y"].n_outliers) == (5, 0)


@pytest.mark.parametrize("by", [(), ("grp",)])
@pytest.mark.parametrize("sketch", [20, 200])
def test_thinned_quantiles_stay_exact(hot, monkeypatch, by, sketch):
    points = {"a": 0.0, "b": 0.2, "c": 1 / 3, "d": 0.5, "e": 0.99, "f": 1.0}
    rows = ordered.exact_quantiles(hot, "LoanNr", points, by, sketch).collect()
    frame = hot.toPandas()
    for row in rows:
        part = frame if not by else frame[frame["grp"].isna() if row.grp is None else frame["grp"] == row.grp]
        for name, p in points.items():
            assert row[name] == pytest.approx(np.quantile(part["LoanNr"], p))


def test_thinning_leaves_few_rows(hot):
    data = hot.select(c("LoanNr").cast("double").alias("_value"))
    thin = ordered.thin_out(data, [0.5], sketch=200)
    assert thin.filter("NOT _gap").count() < 200
    assert thin.select("_place", "_gap").distinct().count() < 200
    assert thin.filter("_gap AND _place > _value").count() == 0


def test_wrong_brackets_fall_back_to_all_values(hot, monkeypatch):
    wrong = lambda data, probabilities, by, sketch, also=(): data.groupBy(*by).agg(
        F.array(F.lit(1.0), F.lit(2.0)).alias("_cuts")
    )
    monkeypatch.setattr(ordered, "_bracket_table", wrong)
    assert ordered.exact_quantiles(hot, "LoanNr", {"m": 0.5}).first().m == 1499.5
    grouped = {r.grp: r.m for r in ordered.exact_quantiles(hot, "LoanNr", {"m": 0.5}, ["grp"]).collect()}
    assert grouped["a"] == 1499.0


def test_many_groups_are_joined(hot, monkeypatch):
    monkeypatch.setattr(ordered, "broadcast_if_small", lambda table, **_: table)  # too many groups to broadcast
    assert {r.grp: r.m for r in ordered.exact_quantiles(hot, "LoanNr", {"m": 0.5}, ["grp"]).collect()}["a"] == 1499.0


@pytest.mark.parametrize("mode", ["thin", "broken"])
def test_lift_equals_the_full_curve(hot, monkeypatch, mode):
    if mode == "broken":
        wrong = lambda data, probabilities, by, sketch, also=(): data.agg(
            F.array(F.lit(-8.0), F.lit(-6.0)).alias("_cuts")
        )
        monkeypatch.setattr(ordered, "_bracket_table", wrong)
    else:
        monkeypatch.setattr(ordered, "SKETCH", 1000)
    got = curves.lift_by_percentile(hot).orderBy("pct").toPandas()
    frame = hot.toPandas().sort_values(["el", "LoanNr"], ascending=[False, True])
    ends = [30 * k for k in range(1, 101)]
    assert list(got["n_loans"]) == ends
    assert list(got["cum_el"]) == pytest.approx([frame["el"].iloc[:e].sum() for e in ends])
    assert list(got["cum_loss"]) == pytest.approx([frame["ChgOffPrinGr"].iloc[:e].sum() for e in ends])
