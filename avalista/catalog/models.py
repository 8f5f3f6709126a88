"""Trained models at the full size of their presets, and what must hold for them whatever the trees.

Row-level results have no SQL twin; each stands beside a query of its properties that has one. Models are
kept for the session, so the queries over one model train it once. The 2500-tree forest of
depth 18 is not run here: its nodes do not fit the driver of a test session.
"""

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from avalista.catalog.features import CLEAN_SQL
from avalista.catalog.loan_view import applications, loans
from avalista.catalog.registry import query, rounded
from avalista.catalog.sources import scratch
from avalista.functions.pricing import gps_category
from avalista.functions.segments import amount_bucket
from avalista.operators import features as f
from avalista.operators.encoding import with_fold
from avalista.operators.metrics import evaluate_lgd, evaluate_pd
from avalista.operators.quotes import quote
from avalista.plans import example as ex
from avalista.plans import training as m
from avalista.schema import NUMERIC_FEATURES
from avalista.sources.artifacts import load_artifacts, save_artifacts
from avalista.sources.dims import SECTOR_CODES, STATE_CODES

c = F.col
_KEPT: dict[tuple, object] = {}


def _once(spark, sf, what, make):
    """What ``make`` returns, made once per session and tables."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def _trained(spark, sf):
    return _once(spark, sf, "risk", lambda: m.train_risk_model(loans(spark, sf, customer=True)))


def _vectors(spark, sf):
    """The feature vectors of all loans, made and kept once."""
    def make():
        features = m.keep_even(f.build_features(loans(spark, sf, customer=True)))
        return m.preprocessor(features).transform(features)

    return _once(spark, sf, "vectors", make)


# the fold of the training: the lowest digests of each class
FOLD_SQL = """(SELECT *, CASE WHEN row_number() OVER (PARTITION BY "Default" ORDER BY md5(LoanNr::VARCHAR || '|42'), LoanNr)
  <= round(count(*) OVER (PARTITION BY "Default") * 0.2) THEN 'test' ELSE 'train' END AS fold FROM loans)"""
WHOLE_SQL = CLEAN_SQL.replace("FROM dirty", "FROM loans").replace("round(ln(1e0 + GrAppv), 8)", "ln(1e0 + GrAppv)")


@query("preprocessor", f""", {WHOLE_SQL} SELECT LoanNr,
  {", ".join(f"round(({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER (), 6) + 0e0 AS num__{x}" for x in NUMERIC_FEATURES)},
  {", ".join(f"(SCIAN = '{x}')::DOUBLE AS cat__SCIAN_{x}" for x in SECTOR_CODES)},
  {", ".join(f"(State = '{x}')::DOUBLE AS cat__State_{x}" for x in STATE_CODES)} FROM feat""")
def _(spark, sf):
    """The feature vector, one column per position, under the names its metadata gives."""
    features = f.build_features(loans(spark, sf, customer=True))
    vectors = m.preprocessor(features).transform(features)
    names = m.feature_names(vectors)
    flat = vectors.withColumn("v", vector_to_array("features")).select(
        "LoanNr", *[c("v")[i].alias(name) for i, name in enumerate(names)]
    )
    return rounded(flat, **{x: 6 for x in names if x.startswith("num__")})


PD_ALGOS = ["boosted", "random_forest", "logistic"]
LGD_ALGOS = ["boosted", "random_forest", "gradient_boosting"]


def _pd(spark, sf, algo):
    """Raw and calibrated default probability of every loan."""
    vectors = _vectors(spark, sf).select("LoanNr", "features", "Default")

    def make():
        model = m.train_pd(vectors, algo).setPredictionCol("pd_class")
        return model, m.calibrate_isotonic(model.transform(vectors))

    model, calibrator = _once(spark, sf, f"pd {algo}", make)
    return calibrator.transform(model.transform(vectors)).withColumn("raw", vector_to_array("probability")[1])


def _lgd(spark, sf, algo):
    vectors = _vectors(spark, sf).select("LoanNr", "features", "Default", "ChgOffPrinGr")
    defaults = f.filter_defaults(vectors)
    return _once(spark, sf, f"lgd {algo}", lambda: m.train_lgd(defaults, algo)).transform(defaults)


def _row_queries():
    for algo in PD_ALGOS:
        query(f"train_pd_{algo}")(lambda spark, sf, algo=algo: _pd(spark, sf, algo).select("LoanNr", "Default", "pd"))
    for algo in LGD_ALGOS:
        query(f"train_lgd_{algo}")(lambda spark, sf, algo=algo: _lgd(spark, sf, algo).select("LoanNr", "ChgOffPrinGr", "lgd"))


_row_queries()


def _values(names):
    return "(VALUES " + ", ".join(f"('{x}')" for x in names) + ") AS t(algo)"


@query("train_pd_properties", f"""SELECT algo, count(*) AS n, sum("Default")::BIGINT AS n_default, round(avg("Default"), 6) AS mean_pd, 0::BIGINT AS breaks
  FROM loans, {_values(PD_ALGOS)} GROUP BY algo""")
def _(spark, sf):
    """On the fitted rows the calibrated mean is the default rate, and a higher raw score never has a lower PD."""
    found = None
    for algo in PD_ALGOS:
        rows = _pd(spark, sf, algo)
        steps = rows.groupBy("raw").agg(F.min("pd").alias("low"), F.max("pd").alias("high")).withColumn("slice", F.floor(c("raw") * 1000))
        before = F.max("high").over(Window.partitionBy("slice").orderBy("raw").rowsBetween(Window.unboundedPreceding, -1))
        breaks = steps.withColumn("before", before).agg(F.count_if((c("before") > c("low") + 1e-12) | (c("high") > c("low") + 1e-12)).alias("breaks"))
        sums = rows.agg(F.count("*").alias("n"), F.sum("Default").cast("long").alias("n_default"), F.round(F.avg("pd"), 6).alias("mean_pd"))
        one = sums.withColumn("breaks", breaks.scalar()).withColumn("algo", F.lit(algo))
        found = one if found is None else found.unionByName(one)
    return found.select("algo", "n", "n_default", "mean_pd", "breaks")


@query("train_lgd_properties", f"""SELECT algo, count(*) AS n, 0::BIGINT AS n_null, 0::BIGINT AS forest_outside
  FROM loans, {_values(LGD_ALGOS)} WHERE "Default" = 1 GROUP BY algo""")
def _(spark, sf):
    """Every defaulted loan has a prediction; a forest's stays inside the range of the losses it saw."""
    found = None
    for algo in LGD_ALGOS:
        rows = _lgd(spark, sf, algo)
        seen = rows.agg(F.struct(F.min("ChgOffPrinGr").alias("lo"), F.max("ChgOffPrinGr").alias("hi"))).scalar()
        outside = (c("lgd") < c("seen.lo") - 1e-6) | (c("lgd") > c("seen.hi") + 1e-6) if algo == "random_forest" else F.lit(False)
        one = rows.withColumn("seen", seen).agg(
            F.count("*").alias("n"), F.count_if(c("lgd").isNull()).alias("n_null"), F.count_if(outside).alias("forest_outside"))
        one = one.withColumn("algo", F.lit(algo))
        found = one if found is None else found.unionByName(one)
    return found.select("algo", "n", "n_null", "forest_outside")


@query("train_risk_model")
def _(spark, sf):
    table = loans(spark, sf, customer=True)
    model = m.train_risk_model(table)
    _once(spark, sf, "risk", lambda: model)
    test = m.training_fold(f.build_features(table), model.metadata).filter(c("fold") == "test")
    return evaluate_pd(m.score_portfolio(test, model)).withColumns({x: F.lit(v) for x, v in model.metadata.items()})


@query("training_figures", f"""SELECT count(*) FILTER (WHERE fold = 'train') AS n_train, count(*) FILTER (WHERE fold = 'test') AS n_test,
  round(avg("Default"), 8) AS default_rate, round(sum(ChgOffPrinGr), 2) AS total_loss, 'MXN' AS currency, 'Mexico' AS country,
  round(avg("Default") FILTER (WHERE fold = 'test'), 8) AS test_default_rate
  FROM {FOLD_SQL}""")
def _(spark, sf):
    """The saved figures of a trained model that do not depend on its trees; both folds have the same share of defaults."""
    path = scratch(spark, "figures")
    save_artifacts(_trained(spark, sf), path, spark)
    saved = spark.read.parquet(f"{path}/metadata")
    folds = m.training_fold(f.build_features(loans(spark, sf, customer=True)), saved.first().asDict())
    share = folds.filter(c("fold") == "test").agg(F.avg("Default")).scalar()
    figures = saved.select("n_train", "n_test", "default_rate", "total_loss", "currency", "country").withColumn("test_default_rate", share)
    return rounded(figures, default_rate=8, total_loss=2, test_default_rate=8)


@query("training_balance", f"""SELECT fold, count(*) AS n, sum("Default")::BIGINT AS n_default, round(sum("Default") / count(*), 6) AS mean_pd, 1e0 AS el_over_loss
  FROM {FOLD_SQL} WHERE fold = 'train' GROUP BY fold""")
def _(spark, sf):
    """On the fitted rows the mean calibrated PD is the default rate, and EL adds up to the booked loss."""
    model = _trained(spark, sf)
    scored = m.score_portfolio(m.training_fold(f.build_features(loans(spark, sf, customer=True)), model.metadata), model)
    sums = scored.filter(c("fold") == "train").groupBy("fold").agg(
        F.count("*").alias("n"), F.sum("Default").alias("n_default"), F.avg("pd").alias("mean_pd"),
        (F.sum("el") / F.sum("ChgOffPrinGr")).alias("el_over_loss"),
    )
    return rounded(sums, mean_pd=6, el_over_loss=6)


@query("segment_balance", f"""SELECT CASE WHEN GrAppv <= 200000 THEN '<$200K' WHEN GrAppv <= 500000 THEN '$200K-500K' WHEN GrAppv <= 1000000 THEN '$500K-1M' ELSE '>$1M' END AS bucket,
  count(*) AS n, CASE WHEN sum(ChgOffPrinGr) > 0 THEN 1e0 END AS el_over_loss FROM {FOLD_SQL} WHERE fold = 'train' AND GrAppv > 0 GROUP BY bucket""")
def _(spark, sf):
    """With saved segment factors, EL adds up to the booked loss within each amount bucket of the fitted rows."""
    path = scratch(spark, "segments")
    save_artifacts(_trained(spark, sf), path, spark)
    model = load_artifacts(spark, path)
    scored = m.score_portfolio(m.training_fold(f.build_features(loans(spark, sf, customer=True)), model.metadata), model, segment="amount")
    sums = scored.filter(c("fold") == "train").groupBy(amount_bucket().alias("bucket")).agg(
        F.count("*").alias("n"), F.try_divide(F.sum("el_segment"), F.sum("ChgOffPrinGr")).alias("el_over_loss"))
    return rounded(sums.filter(c("bucket").isNotNull()), el_over_loss=6)


@query("score_portfolio")
def _(spark, sf):
    return m.score_portfolio(loans(spark, sf, customer=True), _trained(spark, sf)).select("LoanNr", "pd", "lgd", "el", "gps_category")


@query("score_portfolio_properties", "SELECT count(*) AS n, 0::BIGINT AS wrong_pd, 0::BIGINT AS wrong_el, 0::BIGINT AS wrong_category FROM loans")
def _(spark, sf):
    model = _trained(spark, sf)
    scored = m.score_portfolio(loans(spark, sf, customer=True), model)
    return scored.agg(
        F.count("*").alias("n"),
        F.count_if(c("pd").isNull() | (c("pd") < 0) | (c("pd") > 1)).alias("wrong_pd"),
        F.count_if(~c("el").eqNullSafe(c("pd") * c("lgd") * model.factor)).alias("wrong_el"),
        F.count_if(~c("gps_category").eqNullSafe(gps_category(c("pd")))).alias("wrong_category"),
    )


@query("quote_with_model")
def _(spark, sf):
    unscored = applications(spark, sf, customer=True).drop("pd", "lgd")
    return quote(unscored, _trained(spark, sf), keep=["application_id"])


@query("quote_with_model_properties", "SELECT count(*) AS n, 0::BIGINT AS incomplete, 0::BIGINT AS wrong_category FROM applications")
def _(spark, sf):
    unscored = applications(spark, sf, customer=True).drop("pd", "lgd")
    quotes = quote(unscored, _trained(spark, sf), keep=["application_id"])
    return quotes.agg(
        F.count("*").alias("n"), F.count_if(c("pd").isNull() | c("expected_loss").isNull()).alias("incomplete"),
        F.count_if(~c("gps_category").eqNullSafe(gps_category(c("pd")))).alias("wrong_category"))


@query("save_load_artifacts")
def _(spark, sf):
    path = scratch(spark, "model")
    save_artifacts(_trained(spark, sf), path, spark)
    return m.score_portfolio(loans(spark, sf, customer=True), load_artifacts(spark, path)).select("LoanNr", "pd", "lgd", "el")


@query("save_load_properties", "SELECT count(*) AS n, 0::BIGINT AS differing FROM loans")
def _(spark, sf):
    """A loaded model scores every loan as the saved one does."""
    path, model = scratch(spark, "model"), _trained(spark, sf)
    save_artifacts(model, path, spark)
    features = f.build_features(loans(spark, sf, customer=True))
    once = model.score(features).select("LoanNr", *[c(x).alias(f"{x}_1") for x in ("pd", "lgd", "el")])
    again = load_artifacts(spark, path).score(features).select("LoanNr", "pd", "lgd", "el")
    differs = ~(c("pd").eqNullSafe(c("pd_1")) & c("lgd").eqNullSafe(c("lgd_1")) & c("el").eqNullSafe(c("el_1")))
    return once.join(again, "LoanNr").agg(F.count("*").alias("n"), F.count_if(differs).alias("differing"))


def _importance(spark, sf):
    vectors = _vectors(spark, sf)
    _pd(spark, sf, "boosted")
    return m.feature_importance(_once(spark, sf, "pd boosted", None)[0], m.feature_names(vectors))


@query("feature_importance")
def _(spark, sf):
    return _importance(spark, sf)


@query("feature_importance_properties", f"""SELECT {len(NUMERIC_FEATURES)} + count(DISTINCT SCIAN) + count(DISTINCT State) AS n, 1e0 AS total, 0::BIGINT AS wrong_names FROM loans""")
def _(spark, sf):
    """One importance per feature, named after the loans' own sectors and states; they add up to one."""
    names = [f"num__{x}" for x in NUMERIC_FEATURES] + [f"cat__SCIAN_{x}" for x in SECTOR_CODES] + [f"cat__State_{x}" for x in STATE_CODES]
    return _importance(spark, sf).agg(
        F.count("*").alias("n"), F.round(F.sum("importance"), 6).alias("total"), F.count_if(~c("feature").isin(*names)).alias("wrong_names"))


EXAMPLES = ["example_forest", "example_boosted"]


def _examples(spark, sf):
    """Test-fold rows of both example classifiers, with their probability."""
    table = loans(spark, sf, customer=True)
    vectors = _once(spark, sf, "example vectors", lambda: ex.example_features(with_fold(table), ex.example_codes(table)).select(
        "features", "Default", "fold").persist(StorageLevel.MEMORY_AND_DISK))
    train, test = vectors.filter(c("fold") == "train"), vectors.filter(c("fold") == "test")

    def rows(algo):
        model = _once(spark, sf, algo, lambda: m.train_pd(train.select("features", "Default"), algo).setPredictionCol("pd_class"))
        return model.transform(test).withColumn("pd", vector_to_array("probability")[1])

    return {algo: rows(algo) for algo in EXAMPLES}


@query("example_models")
def _(spark, sf):
    """Both example classifiers on the same label-encoded features, with their test figures."""
    one, two = (evaluate_pd(rows).withColumn("algo", F.lit(algo)) for algo, rows in _examples(spark, sf).items())
    return one.unionByName(two)


@query("example_models_properties", f"""SELECT algo, count(*) AS n, round(avg("Default"), 8) AS default_rate, 0::BIGINT AS wrong_pd
  FROM loans, {_values(EXAMPLES)} WHERE substring(md5(LoanNr::VARCHAR || '|42'), 1, 8) < '33333333' GROUP BY algo""")
def _(spark, sf):
    def figures(algo, rows):
        return rows.agg(
            F.count("*").alias("n"), F.round(F.avg("Default"), 8).alias("default_rate"),
            F.count_if(c("pd").isNull() | (c("pd") < 0) | (c("pd") > 1)).alias("wrong_pd")).withColumn("algo", F.lit(algo))

    one, two = (figures(algo, rows) for algo, rows in _examples(spark, sf).items())
    return one.unionByName(two)


@query("example_loss_model")
def _(spark, sf):
    """Loss forest on defaulted loans only, split without regard to class."""
    table = f.filter_defaults(loans(spark, sf, customer=True))
    vectors = ex.example_features(with_fold(table), ex.example_codes(table)).select("features", "Default", "ChgOffPrinGr", "fold")
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    model = m.train_lgd(vectors.filter(c("fold") == "train"), "example_forest")
    return evaluate_lgd(model.transform(vectors.filter(c("fold") == "test")))


@query("example_decisions")
def _(spark, sf):
    """Saved, loaded again, and applied to every loan."""
    path = scratch(spark, "example")
    table = loans(spark, sf, customer=True)
    ex.train_example_model(table).save(path)
    return ex.load_example_model(spark, path).decide(table).select("LoanNr", "pd", "lgd", "expected_loss", "decision")
