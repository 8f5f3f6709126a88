"""Batch jobs: ``python -m avalista <job> ...``; run with spark-submit on a cluster."""

from __future__ import annotations

import argparse

from pyspark import StorageLevel

from avalista.operators.features import build_features
from avalista.plans.reports import model_analysis, portfolio_report
from avalista.plans.training import TrainConfig, score_portfolio, train_risk_model, training_fold
from avalista.schema import APPLICATION_SCHEMA
from avalista.session import get_session
from avalista.sources.artifacts import load_artifacts, save_artifacts
from avalista.sources.loans import read_loans, write_loans
from avalista.streaming.quotes import TEXT_SCHEMA, check_and_quote, read_application_stream, write_checked_quotes


def _write_tables(tables, folder):
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def convert(spark, a):
    write_loans(read_loans(spark, a.loans, a.format), a.output, a.to)


def train(spark, a):
    config = TrainConfig(
        pd_algo=a.pd, lgd_algo=a.lgd, calibrate_on=a.calibrate_on,
        pd_params={"trees": a.trees} if a.trees and a.pd != "logistic" else {},
        lgd_params={"trees": a.trees} if a.trees else {},
    )
    model = train_risk_model(read_loans(spark, a.loans, a.format), config, resume=a.resume)
    save_artifacts(model, a.model, spark)
    print(model.metadata | {"calibration_factor": model.factor})


def score(spark, a):
    scored = score_portfolio(read_loans(spark, a.loans, a.format), load_artifacts(spark, a.model))
    scored.write.mode("overwrite").parquet(a.output)


def portfolio(spark, a):
    _write_tables(portfolio_report(read_loans(spark, a.loans, a.format)), a.output)


def analyze(spark, a):
    model = load_artifacts(spark, a.model)
    held_out = training_fold(build_features(read_loans(spark, a.loans, a.format)), model.metadata).filter("fold = 'test'")
    scored = score_portfolio(held_out, model).persist(StorageLevel.MEMORY_AND_DISK)
    _write_tables(model_analysis(scored, model.factor), a.output)


def quotes(spark, a):
    """Applications come as text columns with a header and are parsed and checked first."""
    raw = spark.read.option("header", True).csv(a.applications)
    _write_tables(check_and_quote(raw, load_artifacts(spark, a.model), fee_mode=a.fee_mode, keep=_id(raw)), a.output)


def _id(table):
    return [x for x in ("application_id",) if x in table.columns]


def stream(spark, a):
    """As quotes, on files that arrive in a folder: text columns in CSV, typed ones in parquet."""
    applications = read_application_stream(spark, a.applications, a.format, TEXT_SCHEMA if a.format == "csv" else APPLICATION_SCHEMA)
    write_checked_quotes(
        applications, a.output, f"{a.output}/checkpoint", load_artifacts(spark, a.model), fee_mode=a.fee_mode, keep=_id(applications), available_now=not a.forever
    ).awaitTermination()


def main(argv=None):
    parser = argparse.ArgumentParser(prog="avalista", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(run, *paths):
        sub = jobs.add_parser(run.__name__, help=run.__doc__)
        for path in paths:
            sub.add_argument(path)
        sub.set_defaults(run=run)
        return sub

    job(convert, "loans", "output").add_argument("--to", default="parquet", choices=["parquet", "csv"])
    training = job(train, "loans", "model")
    training.add_argument("--pd", default="boosted")
    training.add_argument("--lgd", default="random_forest")
    training.add_argument("--trees", type=int, help="fewer trees than the preset, for trial runs")
    training.add_argument("--resume", help="shared folder in which fitted stages are kept and taken up again")
    training.add_argument("--calibrate-on", default="train", choices=["train", "holdout"])
    job(score, "loans", "model", "output")
    job(portfolio, "loans", "output")
    job(analyze, "loans", "model", "output")
    for sub in (job(quotes, "applications", "model", "output"), job(stream, "applications", "model", "output")):
        sub.add_argument("--fee-mode", default="flat", choices=["flat", "el_margin"])
    jobs.choices["stream"].add_argument("--forever", action="store_true")
    for name, sub in jobs.choices.items():
        if name != "quotes":
            sub.add_argument("--format", default="parquet" if name == "stream" else "csv")
    args = parser.parse_args(argv)
    args.run(get_session(f"avalista-{args.job}"), args)


if __name__ == "__main__":
    main()
