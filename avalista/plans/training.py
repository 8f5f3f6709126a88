"""Training jobs on Spark ML: default probability, loss given default, calibration."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from hashlib import md5
from math import sqrt

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from avalista.functions import segments as seg
from avalista.operators.calibration import calibration_factor, predict_el, segment_calibration
from avalista.operators.curves import auc
from avalista.operators.encoding import with_class_weight, with_exact_fold, with_fold
from avalista.operators.features import build_features, feature_select, filter_defaults
from avalista.operators.metrics import evaluate_lgd
from avalista.plans.boosting import PART_ROWS, fit_boosted, fit_forest
from avalista.functions.pricing import gps_category
from avalista.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from avalista.session import ensure_checkpoint_dir, spread
from avalista.sources.dims import constant_table

c = F.col
MODEL_INPUTS = ["GrAppv", "Term"]
TREE_PART_ROWS = 1 << 11  # loans that are worth a task of a forest

# Full-size model settings. ``trees`` can be lowered for trial runs.
PD_PRESETS = {
    "boosted": {
        "trees": 600, "step": 0.02, "depth": 4, "rows": 0.8, "columns": 0.6, "gain": 0.2, "leaf": 5, "alpha": 1.0, "reg_lambda": 2.0, "delta": 1.0,
        "weights": "positive", "seed": 2024},
    "random_forest": {"trees": 200, "depth": 12, "leaf": 50, "weights": "balanced", "seed": 42},
    "logistic": {"c": 0.1, "iterations": 1000, "weights": "balanced"},
    "deep_forest": {"trees": 2500, "depth": 18, "leaf": 2, "columns": "sqrt", "weights": "balanced", "seed": 2024},
    "example_forest": {"trees": 100, "depth": 10, "leaf": 1, "weights": "balanced", "seed": 42},
    "example_boosted": {"trees": 100, "step": 0.1, "depth": 5, "rows": 1.0, "columns": "all", "weights": None, "seed": 42},
}
LGD_PRESETS = {
    "boosted": {
        "trees": 200, "step": 0.05, "depth": 6, "rows": 0.8, "columns": 0.8, "gain": 0.0, "leaf": 5, "alpha": 0.1, "reg_lambda": 1.0, "delta": 0.0, "seed": 42},
    "random_forest": {"trees": 200, "depth": 10, "leaf": 20, "seed": 42},
    "gradient_boosting": {"trees": 200, "step": 0.05, "depth": 5, "rows": 0.8, "columns": "all", "leaf": 20, "seed": 42},
    "example_forest": {"trees": 100, "depth": 10, "leaf": 1, "seed": 42},
}


@dataclass
class TrainConfig:
    pd_algo: str = "boosted"
    lgd_algo: str = "random_forest"
    pd_params: dict = field(default_factory=dict)
    lgd_params: dict = field(default_factory=dict)
    test_size: float = 0.2
    seed: int = 42
    key: str = "LoanNr"
    calibrate_on: str = "train"
    stratify: bool = True  # the same share of defaults in both folds


@dataclass
class RiskModel:
    preprocessor: PipelineModel
    pd_model: object
    calibrator: object
    lgd_model: object
    factor: float = 1.0
    metadata: dict = field(default_factory=dict)
    segment_factors: dict[str, dict[str, float]] = field(default_factory=dict)

    def score(self, features: DataFrame, segment: str | None = None) -> DataFrame:
        """Add ``pd``, ``lgd`` and ``el``; every other column stays.

        With ``segment`` ("amount" or "term") also ``segment_factor`` and ``el_segment``, the loss
        calibrated within the loan's segment; a segment that training did not see keeps the overall factor.
        """
        vectors = self.preprocessor.transform(features)
        raw = self.calibrator.transform(self.pd_model.transform(vectors))
        lgd = self.lgd_model.transform(raw)
        scored = predict_el(lgd, self.factor).select(*features.columns, "pd", "lgd", "el")
        if segment is None:
            return scored
        known = [F.lit(x) for pair in self.segment_factors[segment].items() for x in pair]
        factor = F.element_at(F.create_map(*known), SEGMENTS[segment]()) if known else F.lit(None).cast("double")
        scored = scored.withColumn("segment_factor", F.coalesce(factor, F.lit(1.0)))
        return scored.withColumn("el_segment", c("el") * c("segment_factor"))


SEGMENTS = {"amount": seg.amount_bucket, "term": seg.term_bucket}

# Further names the algorithms are known by.
ALIASES = {"xgboost": "boosted", "randomforest": "random_forest"}


def _settings(presets, algo, params):
    algo = ALIASES.get(algo, algo)
    if algo not in presets:
        raise ValueError(f"unknown algorithm {algo!r}; known: {', '.join(presets)}")
    return {**presets[algo], **params}


def preprocessor(features: DataFrame) -> PipelineModel:
    """Scale the numeric and one-hot the categorical columns into ``features``, fitted on the input.

    One aggregate of the input gives means, population deviations and categories. The scaler is then fitted on two
    rows that have this mean and deviation; neither it nor the indexers see the input again.
    """
    sums = features.agg(
        *[F.avg(x).alias(f"mean_{x}") for x in NUMERIC_FEATURES], *[F.stddev_pop(x).alias(f"dev_{x}") for x in NUMERIC_FEATURES],
        *[F.sort_array(F.collect_set(c(x).cast("string"))).alias(x) for x in CATEGORICAL_FEATURES]).first()
    if sums[f"mean_{NUMERIC_FEATURES[0]}"] is None:
        raise ValueError("no rows to prepare")
    index = [f"{x}_index" for x in CATEGORICAL_FEATURES]
    hot = [f"cat__{x}" for x in CATEGORICAL_FEATURES]
    indexers = [StringIndexerModel.from_labels(sums[x], x, out, "keep") for x, out in zip(CATEGORICAL_FEATURES, index)]
    assembler = VectorAssembler(inputCols=NUMERIC_FEATURES, outputCol="num_raw")
    spark = features.sparkSession
    middle = [float(sums[f"mean_{x}"]) for x in NUMERIC_FEATURES]
    off = [float(sums[f"dev_{x}"]) / sqrt(2) for x in NUMERIC_FEATURES]  # of two rows, the sample deviation is their distance over sqrt(2)
    two = spark.createDataFrame([(Vectors.dense([m + way * d for m, d in zip(middle, off)]),) for way in (-1, 1)], ["num_raw"])
    scaler = StandardScaler(inputCol="num_raw", outputCol="num", withMean=True, withStd=True).fit(two)
    none = PipelineModel(indexers).transform(features.limit(0))  # the encoder reads the categories from the columns' attributes
    encoder = OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True).fit(none)
    return PipelineModel([*indexers, encoder, assembler, scaler, VectorAssembler(inputCols=["num", *hot], outputCol="features")])


def feature_names(vectors: DataFrame, column="features") -> list[str]:
    """Names behind the vector positions: ``num__<column>``, then ``cat__<column>_<value>``."""
    attrs = vectors.schema[column].metadata["ml_attr"]["attrs"]
    found = sorted((a["idx"], a.get("name", "")) for group in attrs.values() for a in group)
    scaled = [f"num__{x}" for x in NUMERIC_FEATURES]
    return scaled + [name for _, name in found[len(scaled):]]


@contextmanager
def _even(rows: DataFrame, *columns: str):
    """The named columns spread over the cores and kept, as trees go over them once or more per level."""
    narrow = rows.select(*columns)
    kept = spread(narrow, narrow.count(), TREE_PART_ROWS).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def keep_even(rows: DataFrame) -> DataFrame:
    """``rows`` kept on memory and disk in partitions for all cores, as each training and scoring pass goes over them."""
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
    even = spread(kept, kept.count(), TREE_PART_ROWS)
    if even is not kept:
        even = even.persist(StorageLevel.MEMORY_AND_DISK)
        even.count()
        kept.unpersist()
    return even


def train_pd(vectors: DataFrame, algo: str = "boosted", label="Default", **params):
    """Fit a classifier on ``features``; returns the model."""
    p = _settings(PD_PRESETS, algo, params)
    rows = with_class_weight(vectors, label, p["weights"]) if p["weights"] else vectors.withColumn("weight", F.lit(1.0))
    common = {"featuresCol": "features", "labelCol": label, "weightCol": "weight"}
    if algo == "logistic":
        total = rows.agg(F.sum("weight")).first()[0]
        return LogisticRegression(
            **common, regParam=1.0 / (p["c"] * total), elasticNetParam=0.0, standardization=False, maxIter=p["iterations"]
        ).fit(rows)
    if "reg_lambda" in p:
        return fit_boosted(rows, label, "weight", True, **{k: v for k, v in p.items() if k != "weights"})
    if "step" in p:
        ensure_checkpoint_dir(vectors.sparkSession)
        trees = GBTClassifier(
            **common, maxIter=p["trees"], stepSize=p["step"], maxDepth=p["depth"], subsamplingRate=p["rows"],
            featureSubsetStrategy=p["columns"], minInstancesPerNode=p.get("leaf", 1), seed=p["seed"], checkpointInterval=10,
        )
    else:
        trees = RandomForestClassifier(
            **common, numTrees=p["trees"], maxDepth=p["depth"], minInstancesPerNode=p["leaf"],
            featureSubsetStrategy=p.get("columns", "sqrt"), seed=p["seed"],
        )
    with _even(rows, "features", label, "weight") as even:
        return trees.fit(even)


def calibrate_isotonic(scored: DataFrame, label="Default"):
    """Monotone map from raw score to probability, fitted without weights.

    Loans are counted per distinct score first, so the fit sees one weighted row
    per score instead of one per loan.
    """
    points = (
        scored.select(vector_to_array("probability")[1].alias("raw_pd"), c(label).cast("double").alias("y"))
        .groupBy("raw_pd")
        .agg(F.avg("y").alias("label"), F.count("*").cast("double").alias("weight"))
    )
    model = IsotonicRegression(
        featuresCol="raw_pd", labelCol="label", weightCol="weight", predictionCol="pd"
    ).fit(points)
    return model.setFeaturesCol("probability").setFeatureIndex(1)


def train_lgd(vectors: DataFrame, algo: str = "random_forest", label="ChgOffPrinGr", **params):
    """Fit a loss model; give it defaulted loans only."""
    p = _settings(LGD_PRESETS, algo, params)
    common = {"featuresCol": "features", "labelCol": label, "predictionCol": "lgd"}
    if "reg_lambda" in p:
        return fit_boosted(vectors.withColumn("weight", F.lit(1.0)), label, "weight", False, **p).setPredictionCol("lgd")
    if "step" in p:
        ensure_checkpoint_dir(vectors.sparkSession)
        trees = GBTRegressor(
            **common, maxIter=p["trees"], stepSize=p["step"], maxDepth=p["depth"], subsamplingRate=p["rows"],
            featureSubsetStrategy=p["columns"], minInstancesPerNode=p["leaf"], seed=p["seed"], checkpointInterval=10,
        )
    elif vectors.count() <= PART_ROWS:
        return fit_forest(vectors, label, p["trees"], p["depth"], p["leaf"], p["seed"]).setPredictionCol("lgd")
    else:
        trees = RandomForestRegressor(
            **common, numTrees=p["trees"], maxDepth=p["depth"], minInstancesPerNode=p["leaf"],
            featureSubsetStrategy="all", seed=p["seed"],
        )
    with _even(vectors, "features", label) as even:
        return trees.fit(even)


class Stages:
    """Fitted stages of a training, kept under a key of configuration and input, so that a training can be taken up again.

    A stage counts as kept only once its mark is written, which happens after the stage itself.
    """

    def __init__(self, spark: SparkSession, folder: str | None, key: str = ""):
        self.spark, self.folder = spark, folder and f"{folder}/{key}"

    def get(self, name: str, fit):
        if not self.folder:
            return fit()
        path, mark = f"{self.folder}/{name}", self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.done")
        files = mark.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(mark):
            return PipelineModel.load(path) if name == "preprocessor" else DefaultParamsReader.loadParamsInstance(path, self.spark)
        model = fit()
        model.write().overwrite().save(path)
        files.create(mark).close()
        return model


def training_key(features: DataFrame, cfg: TrainConfig) -> str:
    """A digest of the configuration and of all rows, whatever their order."""
    mark = features.agg(F.count("*"), F.bit_xor(F.xxhash64(*features.columns)), F.sum(F.xxhash64(*features.columns).cast("decimal(38,0)"))).first()
    return md5(f"{sorted(vars(cfg).items())}|{tuple(mark)}".encode()).hexdigest()


def train_risk_model(loans: DataFrame, config: TrainConfig | None = None, resume: str | None = None) -> RiskModel:
    """Prepare, split, fit, calibrate and evaluate; returns the model with its figures.

    ``calibrate_on='holdout'`` fits the probability map on the test fold instead of the rows the classifier saw. With
    ``resume``, a folder on shared storage, each fitted stage is saved there, and a training of the same configuration and loans
    that stopped goes on behind its last saved stage.
    """
    cfg = config or TrainConfig()
    prepared = training_fold(build_features(loans), vars(cfg))
    features = feature_select(prepared, cfg.key, "fold", "Default", "ChgOffPrinGr")
    # Training makes many passes, so spread the narrow rows evenly once and keep them.
    features = keep_even(features.repartition(c(cfg.key), c("GrAppv"), c("Term")))
    try:
        train, test = features.filter(c("fold") == "train"), features.filter(c("fold") == "test")
        stages = Stages(loans.sparkSession, resume, training_key(features, cfg) if resume else "")
        prep = stages.get("preprocessor", lambda: preprocessor(train))
        vectors = prep.transform(train).select("features", "Default", "ChgOffPrinGr")
        if cfg.calibrate_on == "train":
            calibration_rows = vectors
        elif cfg.calibrate_on == "holdout":
            calibration_rows = prep.transform(test)
        else:
            raise ValueError(f"unknown calibrate_on {cfg.calibrate_on!r}")
        fit_pd = lambda: train_pd(vectors, cfg.pd_algo, **cfg.pd_params).setPredictionCol("pd_class")
        fit_lgd = lambda: train_lgd(filter_defaults(vectors), cfg.lgd_algo, **cfg.lgd_params)
        ensure_checkpoint_dir(loans.sparkSession)
        with ThreadPoolExecutor(1) as other:
            # The loss model needs nothing of the classifier, whose trees leave most cores idle; stages that are saved follow one another.
            lgd_job = None if resume else other.submit(inheritable_thread_target(fit_lgd))
            pd_model = stages.get("pd_model", fit_pd)
            calibrator = stages.get("calibrator", lambda: calibrate_isotonic(pd_model.transform(calibration_rows)))
            lgd_model = lgd_job.result() if lgd_job else stages.get("lgd_model", fit_lgd)
        model = RiskModel(prep, pd_model, calibrator, lgd_model)

        on_train = model.score(train).select(*MODEL_INPUTS, "ChgOffPrinGr", "el").persist(StorageLevel.MEMORY_AND_DISK)  # scored once, read for each factor
        try:
            model = replace(model, factor=float(calibration_factor(on_train).first()["factor"]))
            model = replace(model, segment_factors={x: _segment_factors(on_train, x, model.factor) for x in SEGMENTS})
        finally:
            on_train.unpersist()
        split = {"test_size": cfg.test_size, "seed": cfg.seed, "key": cfg.key, "stratify": cfg.stratify}
        return replace(model, metadata=_figures(model, features, test) | split)
    finally:
        features.unpersist()


def training_fold(loans: DataFrame, split: dict) -> DataFrame:
    """Mark each loan as the training did; ``split`` is the configuration, or the figures saved with a model."""
    fold = with_exact_fold if split["stratify"] else with_fold
    return fold(loans, split["test_size"], split["seed"], key=split["key"])


def _segment_factors(scored, segment, factor) -> dict[str, float]:
    """Booked over predicted loss per segment, on top of the overall factor; a handful of labels."""
    table = segment_calibration(scored.withColumn("el", c("el") * factor).withColumn("_segment", SEGMENTS[segment]()), "_segment")
    return {row["_segment"]: row["factor"] for row in table.collect() if row["_segment"] is not None}


def _figures(model, features, test):
    scored = model.score(test).select("Default", "ChgOffPrinGr", "pd", "lgd").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _figures_of(scored, features)
    finally:
        scored.unpersist()


def _figures_of(scored, features):
    whole = fold_counts(features)
    quality = evaluate_lgd(scored).first()
    return {
        "n_train": whole["n_train"],
        "n_test": whole["n_test"],
        "default_rate": whole["default_rate"],
        "pd_auc": auc(scored).first()["auc"],
        "lgd_mae": quality["mae"] if quality["n"] else 0.0,
        "total_loss": whole["total_loss"],
        "currency": "MXN",
        "country": "Mexico",
    }


def fold_counts(features: DataFrame) -> dict:
    return features.agg(
        F.count_if(c("fold") == "train").alias("n_train"),
        F.count_if(c("fold") == "test").alias("n_test"),
        F.avg("Default").alias("default_rate"),
        F.sum("ChgOffPrinGr").alias("total_loss"),
    ).first().asDict()


def score_portfolio(loans: DataFrame, model: RiskModel, segment: str | None = None) -> DataFrame:
    """Default probability, loss, expected loss and price category of every loan; with ``segment`` also the loss calibrated in it."""
    return model.score(build_features(loans), segment).withColumn("gps_category", gps_category(c("pd")))


def feature_importance(model, names) -> DataFrame:
    """Feature names with their importance, smallest first; one row per model feature."""
    values = [float(x) for x in model.featureImportances.toArray()]
    table = constant_table(SparkSession.getActiveSession(), list(zip(names, values)), ["feature", "importance"])
    return table.orderBy("importance", "feature")
