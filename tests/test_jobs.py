"""The batch jobs end to end, on loans with defaults planted by the rule score."""

import pytest
from pyspark.sql import functions as F

from avalista.__main__ import main
from avalista.catalog.loan_view import applications, loans
from avalista.operators import rules
from avalista.operators.curves import auc
from avalista.operators.encoding import split_hash, with_fold
from avalista.plans import training as m
from avalista.operators.features import to_legacy_format
from avalista.sources.loans import read_loans, write_loans

c = F.col


def planted(spark, sf):
    """The loan view with defaults drawn by the loan's digest at its rule probability."""
    scored = rules.rule_expected_loss(loans(spark, sf, customer=True))
    draw = F.conv(F.substring(split_hash("LoanNr", 7), 1, 7), 16, 10).cast("double") / float(16**7)
    hit = (draw < c("rule_pd")).cast("int")
    return scored.withColumns({"Default": hit, "ChgOffPrinGr": F.when(hit == 1, c("rule_loss")).otherwise(0.0)}).drop(
        "risk_score", "rule_lgd_rate", "rule_loss", "rule_el"
    )


def test_a_model_finds_planted_risk(spark):
    table = planted(spark, "/root/testdata/sf0.01")
    model = m.train_risk_model(table, m.TrainConfig(pd_params={"trees": 20, "step": 0.2}, lgd_params={"trees": 5}))
    held_out = with_fold(table).filter("fold = 'test'")
    ceiling = auc(held_out, "rule_pd").first().auc
    assert model.metadata["pd_auc"] > 0.65
    assert model.metadata["pd_auc"] > ceiling - 0.08
    spread = held_out.filter("Default = 1").agg(F.stddev("ChgOffPrinGr")).first()[0]
    assert model.metadata["lgd_mae"] < spread


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    base = tmp_path_factory.mktemp("jobs")
    write_loans(planted(spark, sf).drop("rule_pd"), str(base / "loans.csv"))
    main(["train", str(base / "loans.csv"), str(base / "model"), "--trees", "3"])
    return base


def test_convert(spark, folder):
    main(["convert", str(folder / "loans.csv"), str(folder / "loans.parquet")])
    assert spark.read.parquet(str(folder / "loans.parquet")).count() == 1500


def test_score_and_portfolio(spark, folder):
    main(["score", str(folder / "loans.csv"), str(folder / "model"), str(folder / "scored")])
    assert spark.read.parquet(str(folder / "scored")).filter("el IS NULL").count() == 0
    main(["portfolio", str(folder / "loans.csv"), str(folder / "report")])
    assert spark.read.parquet(str(folder / "report" / "summary")).first().n_loans == 1500


def test_analyze(spark, folder):
    main(["analyze", str(folder / "loans.csv"), str(folder / "model"), str(folder / "analysis")])
    assert spark.read.parquet(str(folder / "analysis" / "lift")).count() == 100
    assert spark.read.parquet(str(folder / "analysis" / "report")).first().auc > 0.5


def test_analyze_reads_the_older_layout(spark, folder):
    older = to_legacy_format(read_loans(spark, str(folder / "loans.csv"))).withColumnRenamed("LoanNr", "LoanNr_ChkDgt")
    write_loans(older, str(folder / "older.csv"))
    main(["analyze", str(folder / "older.csv"), str(folder / "model"), str(folder / "older")])
    assert spark.read.parquet(str(folder / "older" / "lift")).count() == 100
    assert spark.read.parquet(str(folder / "older" / "lgd_residual_summary")).first().n > 0


def test_quotes_and_stream(spark, sf, folder):
    table = applications(spark, sf, customer=True).drop("pd", "lgd")
    texts = table.withColumns({x: F.when(c(x), "sí").otherwise("no") for x in ("is_new_business", "has_real_estate", "in_recession")})
    texts.write.option("header", True).csv(str(folder / "forms"))
    main(["quotes", str(folder / "forms"), str(folder / "model"), str(folder / "priced")])
    priced = spark.read.parquet(str(folder / "priced" / "quotes"))
    rejected = spark.read.parquet(str(folder / "priced" / "rejected"))
    assert priced.count() + rejected.count() == 1500 and rejected.count() > 0
    table.write.parquet(str(folder / "arriving"))
    main(["stream", str(folder / "arriving"), str(folder / "model"), str(folder / "streamed")])
    streamed = spark.read.parquet(str(folder / "streamed" / "quotes"))
    assert streamed.count() == priced.count()
    assert spark.read.parquet(str(folder / "streamed" / "rejected")).count() == rejected.count()
    pairs = priced.join(
        streamed.select(c("application_id").cast("string").alias("application_id"), c("monthly_payment").alias("other")),
        "application_id",
    )
    assert pairs.count() == priced.count()
    assert pairs.filter(F.abs(c("monthly_payment") - c("other")) > 1e-9).count() == 0
