"""Training: figures, calibration identities, saving, library parity."""

import threading

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from avalista.catalog.loan_view import applications, loans
from avalista.operators import features as f
from avalista.operators.calibration import predict_el
from avalista.operators.encoding import standardize
from avalista.operators.quotes import quote
from avalista.plans import training as m
from avalista.sources.artifacts import load_artifacts, save_artifacts

c = F.col
SMALL = m.TrainConfig(pd_params={"trees": 5, "step": 0.2}, lgd_params={"trees": 5})


@pytest.fixture(scope="module")
def table(spark, sf):
    return loans(spark, sf, customer=True).cache()


@pytest.fixture(scope="module")
def model(table):
    return m.train_risk_model(table, SMALL)


def test_figures(model, table):
    meta = model.metadata
    assert meta["n_train"] + meta["n_test"] == table.count()
    assert 0 <= meta["pd_auc"] <= 1 and meta["lgd_mae"] > 0
    assert (meta["currency"], meta["country"]) == ("MXN", "Mexico")


def test_calibrated_loss_matches_on_the_training_rows(model, table):
    train = m.score_portfolio(m.training_fold(f.build_features(table), model.metadata), model).filter("fold = 'train'")
    sums = train.agg(F.sum("el"), F.sum("ChgOffPrinGr")).first()
    assert sums[0] == pytest.approx(sums[1])


def test_isotonic_map_is_monotone_and_unbiased(spark, table):
    features = f.build_features(table)
    vectors = m.preprocessor(features).transform(features).select("features", "Default")
    raw = m.train_pd(vectors, "random_forest", trees=3).setPredictionCol("k").transform(vectors)
    out = m.calibrate_isotonic(raw).transform(raw).select(vector_to_array("probability")[1].alias("raw"), "pd", "Default")
    rows = out.orderBy("raw").collect()
    assert all(a.pd <= b.pd + 1e-12 for a, b in zip(rows, rows[1:]))
    assert np.mean([r.pd for r in rows]) == pytest.approx(np.mean([r.Default for r in rows]))


def test_preprocessor_uses_population_deviation(table):
    features = f.build_features(table)
    vectors = m.preprocessor(features).transform(features)
    got = vectors.select("LoanNr", vector_to_array("features")[0].alias("x"))
    want = standardize(features, ["GrAppv"]).select("LoanNr", c("num__GrAppv").alias("y"))
    assert got.join(want, "LoanNr").filter(F.abs(c("x") - c("y")) > 1e-9).count() == 0
    names = m.feature_names(vectors)
    assert names[0] == "num__GrAppv" and names[12] == "num__IsUrban" and "cat__State_CDMX" in names
    assert sum("SCIAN" in n for n in names) == 21 and sum("State" in n for n in names) == 32


def test_segment_factors_balance_each_segment(model, table):
    train = m.training_fold(f.build_features(table), model.metadata).filter("fold = 'train'")
    for segment, bucket in m.SEGMENTS.items():
        rows = m.score_portfolio(train, model, segment).groupBy(bucket().alias("b")).agg(F.sum("el_segment").alias("el"), F.sum("ChgOffPrinGr").alias("loss")).collect()
        assert all(r.el == pytest.approx(r.loss) for r in rows if r.loss > 0)


def test_folds_have_the_same_share_of_defaults(model, table):
    shares = {r.fold: r.y for r in m.training_fold(f.build_features(table), model.metadata).groupBy("fold").agg(F.avg("Default").alias("y")).collect()}
    assert shares["train"] == pytest.approx(shares["test"], abs=0.002)


def test_unseen_category_scores(model, table):
    odd = table.limit(5).withColumn("State", F.lit("ZZ"))
    assert m.score_portfolio(odd, model).filter("pd is null").count() == 0


def test_logistic_solves_the_penalised_problem(table):
    """The gradient of the weighted, penalised loss is zero at the fitted coefficients."""
    features = f.build_features(table)
    vectors = m.preprocessor(features).transform(features).select("features", "Default")
    fit = m.train_pd(vectors, "logistic")
    rows = vectors.collect()
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([r.Default for r in rows], dtype=float)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    p = 1 / (1 + np.exp(-(x @ fit.coefficients.toArray() + fit.intercept)))
    gradient = fit.coefficients.toArray() + 0.1 * x.T @ (weight * (p - y))
    assert np.abs(gradient).max() / len(y) < 1e-4


def test_save_and_load(spark, model, table, tmp_path):
    save_artifacts(model, str(tmp_path / "model"), spark)
    again = load_artifacts(spark, str(tmp_path / "model"))
    assert again.factor == model.factor and again.metadata == model.metadata and again.segment_factors == model.segment_factors
    a, b = m.score_portfolio(table, model), m.score_portfolio(table, again)
    assert a.select("LoanNr", "pd", "lgd", "el").exceptAll(b.select("LoanNr", "pd", "lgd", "el")).count() == 0
    with pytest.raises(Exception):
        load_artifacts(spark, str(tmp_path / "nothing"))


def test_training_goes_on_where_it_stopped(table, model, tmp_path, monkeypatch):
    """A training that is lost after the PD stage fits neither that nor the preparation again."""
    fitted = []
    for name in ("preprocessor", "train_pd", "calibrate_isotonic", "train_lgd"):
        monkeypatch.setattr(m, name, lambda *a, _name=name, _fit=getattr(m, name), **k: fitted.append(_name) or _fit(*a, **k))
    lost = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("driver lost"))
    with monkeypatch.context() as now:
        now.setattr(m, "calibrate_isotonic", lost)
        with pytest.raises(RuntimeError, match="lost"):
            m.train_risk_model(table, SMALL, resume=str(tmp_path))
    assert fitted == ["preprocessor", "train_pd"]
    again = m.train_risk_model(table, SMALL, resume=str(tmp_path))
    assert fitted == ["preprocessor", "train_pd", "calibrate_isotonic", "train_lgd"]
    assert again.metadata["n_train"] == model.metadata["n_train"] and again.metadata["pd_auc"] == pytest.approx(model.metadata["pd_auc"])
    m.train_risk_model(table, SMALL, resume=str(tmp_path))
    assert len(fitted) == 4
    m.train_risk_model(table.limit(900), SMALL, resume=str(tmp_path))  # other loans, other stages
    assert len(fitted) == 8


def test_quotes_from_a_model(spark, sf, model):
    raw = applications(spark, sf, customer=True).drop("pd", "lgd")
    got = quote(raw, model, keep=["application_id"])
    assert got.count() == raw.count() and got.filter("pd is null or expected_loss is null").count() == 0


def test_unknown_algorithms_raise(table):
    with pytest.raises(ValueError):
        m.train_pd(table, "magic")
    with pytest.raises(ValueError):
        m.train_lgd(table, "magic")


def test_holdout_calibration(table):
    fitted = m.train_risk_model(table, m.TrainConfig(pd_params={"trees": 2}, lgd_params={"trees": 2}, calibrate_on="holdout"))
    assert fitted.metadata["n_test"] > 0


def test_feature_importance_is_sorted(table):
    features = f.build_features(table)
    vectors = m.preprocessor(features).transform(features)
    fit = m.train_lgd(f.filter_defaults(vectors.select("features", "Default", "ChgOffPrinGr")), trees=3)
    rows = m.feature_importance(fit, m.feature_names(vectors)).collect()
    values = [r.importance for r in rows]
    assert values == sorted(values) and sum(values) == pytest.approx(1)


def test_expected_loss(spark):
    assert predict_el(spark.createDataFrame([(0.1, 200.0)], "pd double, lgd double"), 1.5).first().el == pytest.approx(30)


def test_isotonic_fit_matches_brute_force(spark):
    """max-min formula over a small set with tied scores, unweighted."""
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(5)
    score = np.round(rng.uniform(0.05, 0.95, 60), 1)
    y = (rng.uniform(size=60) < score).astype(int)
    rows = [(Vectors.dense([1 - s, s]), int(t)) for s, t in zip(score.tolist(), y.tolist())]
    raw = spark.createDataFrame(rows, ["probability", "Default"])
    out = m.calibrate_isotonic(raw).transform(raw).select(vector_to_array("probability")[1].alias("s"), "pd").distinct()
    got = {round(r.s, 1): r.pd for r in out.collect()}
    levels = sorted(set(score.tolist()))
    mean = lambda i, j: np.mean(np.concatenate([y[score == v] for v in levels[i:j + 1]]))
    for k, level in enumerate(levels):
        want = max(min(mean(i, j) for j in range(k, len(levels))) for i in range(k + 1))
        assert got[round(level, 1)] == pytest.approx(want)


def test_example_model_decides_like_its_saved_copy(spark, table, tmp_path):
    from avalista.plans.example import load_example_model, train_example_model

    fitted = train_example_model(table, trees=3)
    fitted.save(str(tmp_path / "example"))
    a = fitted.decide(table).select("LoanNr", "pd", "lgd", "decision")
    b = load_example_model(spark, str(tmp_path / "example")).decide(table).select("LoanNr", "pd", "lgd", "decision")
    assert a.exceptAll(b).count() == 0 and a.count() == table.count()
    assert a.filter((c("pd") >= 0.15) & (c("decision") != "RECHAZAR - Riesgo alto")).count() == 0
    with pytest.raises(Exception, match="unseen Bank"):
        fitted.decide(table.withColumn("Bank", F.lit("Otro"))).collect()


def test_forests_are_fitted_on_all_cores(table, monkeypatch):
    """Narrow rows come in one partition; a forest goes over them many times, so they are spread first."""
    vectors = table.select("Default", "ChgOffPrinGr").coalesce(1)
    monkeypatch.setattr(m, "TREE_PART_ROWS", 200)
    with m._even(vectors, "Default") as even:
        assert even.rdd.getNumPartitions() == min(8, -(-vectors.count() // 200)) > 1 and even.columns == ["Default"]
    many = vectors.repartition(40)
    with m._even(many, "Default") as even:
        assert even.rdd.getNumPartitions() <= 8 and even.count() == many.count()


def test_the_loss_model_does_not_wait_for_the_classifier(spark, sf, monkeypatch):
    started, fit_pd, fit_lgd = threading.Event(), m.train_pd, m.train_lgd

    def train_pd(*args, **params):
        assert started.wait(60), "the loss model waits"
        return fit_pd(*args, **params)

    def train_lgd(*args, **params):
        started.set()
        return fit_lgd(*args, **params)

    monkeypatch.setattr(m, "train_pd", train_pd)
    monkeypatch.setattr(m, "train_lgd", train_lgd)
    assert m.train_risk_model(loans(spark, sf, customer=True), SMALL).metadata["n_train"] > 0
