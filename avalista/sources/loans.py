"""Reading and writing loan tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from avalista.schema import COLUMN_TYPES, MISSING_TEXTS, REQUIRED, require

IDS = ["LoanNr", "LoanNr_ChkDgt"]  # a typed file's id keeps its type
SCRATCH_COLUMNS = ["TamanoEmpresa", "score_riesgo"]


def _typed(text, dtype, strict: bool):
    """A text column as ``dtype``; whole numbers may be written with a decimal point."""
    known = F.when(~F.trim(text).isin(*MISSING_TEXTS), text)
    if isinstance(dtype, T.StringType):
        return known
    cast = (lambda x, t: x.cast(t)) if strict else (lambda x, t: x.try_cast(t))
    if isinstance(dtype, T.IntegerType):
        return cast(cast(known, "double"), "int")
    return cast(known, dtype.simpleString())


def _cast(field: T.StructField, dtype, strict: bool):
    """A column that already has a type, as the type its name stands for."""
    if dtype is None or field.dataType == dtype or field.name in IDS:
        return F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return _typed(F.col(field.name), dtype, strict).alias(field.name)
    column = F.col(field.name)
    return (column.cast(dtype) if strict else column.try_cast(dtype)).alias(field.name)


def read_loans(spark: SparkSession, path: str, fmt: str = "csv", on_bad_value: str = "raise") -> DataFrame:
    """A loan table with the known columns typed by name; column order does not matter.

    Columns of typed formats are cast where their type differs. CSV columns are read as text, so sector codes keep their leading zero and all
    the usual texts for a missing value become null. ``on_bad_value='null'``
    nulls values that do not parse instead of failing the job.
    """
    if on_bad_value not in ("raise", "null"):
        raise ValueError(f"unknown on_bad_value {on_bad_value!r}")
    strict = on_bad_value == "raise"
    if fmt != "csv":
        loans = spark.read.format(fmt).load(path)
        require(loans, REQUIRED, path)
        return loans.select(*[_cast(x, COLUMN_TYPES.get(x.name), strict) for x in loans.schema.fields])
    raw = spark.read.option("header", True).csv(path)
    require(raw, REQUIRED, path)
    return raw.select(*[_typed(F.col(x), COLUMN_TYPES.get(x, T.StringType()), strict).alias(x) for x in raw.columns])


def write_loans(loans: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Drop scratch columns and write; parquet is laid out by approval year.

    Rows are rebalanced by year first: small years share a task, a year that
    holds much of the table is split over several.
    """
    loans = loans.drop(*SCRATCH_COLUMNS)
    if fmt == "csv":
        dates = [f.name for f in loans.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
        texts = loans.withColumns({d: F.date_format(d, "yyyy-MM-dd") for d in dates}) if dates else loans
        texts.write.mode(mode).option("header", True).csv(path)
        return
    if "ApprovalFY" not in loans.columns and "ApprovalDate" in loans.columns:
        loans = loans.withColumn("ApprovalFY", F.year("ApprovalDate"))
    if "ApprovalFY" in loans.columns:
        loans.hint("rebalance", F.col("ApprovalFY")).write.mode(mode).partitionBy("ApprovalFY").format(fmt).save(path)
    else:
        loans.write.mode(mode).format(fmt).save(path)
