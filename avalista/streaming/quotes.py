"""Quotes on a stream of applications: the batch pricing, stateless, in append mode; or parsed, checked and set apart batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from avalista.operators.quotes import parse_application_text, quote, validate_applications
from avalista.schema import APPLICATION_SCHEMA

TEXT_SCHEMA = StructType([StructField(f.name, StringType()) for f in APPLICATION_SCHEMA.fields])


def read_application_stream(
    spark: SparkSession, folder: str, fmt: str = "parquet", schema=APPLICATION_SCHEMA, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def quote_stream(applications: DataFrame, model=None, factor: float = 1.0, fee_mode: str = "flat", keep=()) -> DataFrame:
    return quote(applications, model, factor, fee_mode, keep)


def write_quote_stream(quotes: DataFrame, folder: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True):
    """Start the sink; with ``available_now`` it drains what is there and stops.

    ``checkpoint`` must be on storage that all executors share.
    """
    writer = quotes.writeStream.outputMode("append").format(fmt).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(folder)


def check_and_quote(applications: DataFrame, model=None, factor: float = 1.0, fee_mode: str = "flat", keep=()) -> dict[str, DataFrame]:
    """``rejected``: applications that fail a check, with the reason; ``quotes``: the prices of the others. Text columns are parsed first."""
    texts = {f.name for f in applications.schema.fields if isinstance(f.dataType, StringType)}
    typed = parse_application_text(applications) if "approved_amount" in texts else applications
    checked = validate_applications(typed)
    return {"rejected": checked.filter("NOT is_valid"), "quotes": quote(checked.filter("is_valid"), model, factor, fee_mode, keep)}


def write_checked_quotes(applications: DataFrame, folder: str, checkpoint: str, model=None, factor: float = 1.0, fee_mode: str = "flat", keep=(), available_now: bool = True):
    """Start a stream with two sinks, ``rejected`` and ``quotes`` below ``folder``, one folder ``batch=N`` of each for every batch.

    A batch that runs again after a failure writes over its own folders, so each application appears once.
    ``folder`` and ``checkpoint`` must be on storage that all executors share.
    """

    def price(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, rows in check_and_quote(batch, model, factor, fee_mode, keep).items():
                rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            batch.unpersist()

    writer = applications.writeStream.foreachBatch(price).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
