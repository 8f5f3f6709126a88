"""Joins with the constant dimension tables, and joins between loan tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avalista.functions.rules import DEFAULT_BASE_RATE, DEFAULT_VOLATILITY
from avalista.session import broadcast_if_small
from avalista.sources.dims import constant_table, dim_sectors, dim_states


def _name_or(name, code, fallback, length):
    """``fallback``: 'code' keeps the code itself, None keeps null, any other text stands in."""
    if fallback == "code":
        name = F.coalesce(name, code)
    elif fallback is not None:
        name = F.coalesce(name, F.lit(fallback))
    return name if length is None else F.substring(name, 1, length)


def _lookup(df, dim, key, columns):
    """Left equi-join with a constant table of at most 32 rows."""
    code = dim.columns[0]
    return df.join(F.broadcast(dim.select(code, *columns)), df[key] == dim[code], "left").drop(code)


def with_sector_name(df: DataFrame, key="SCIAN", fallback="code", length=20, name="sector") -> DataFrame:
    dim = dim_sectors(df.sparkSession).withColumnRenamed("sector_code", "_code")
    joined = _lookup(df, dim, key, ["sector_name"])
    return joined.withColumn(name, _name_or(F.col("sector_name"), F.col(key), fallback, length)).drop("sector_name")


def with_state_name(df: DataFrame, key="State", fallback="code", length=15, name="state_label") -> DataFrame:
    dim = dim_states(df.sparkSession).withColumnRenamed("state_code", "_code")
    joined = _lookup(df, dim, key, ["state_name"])
    return joined.withColumn(name, _name_or(F.col("state_name"), F.col(key), fallback, length)).drop("state_name")


def with_sector_info(df: DataFrame, key="SCIAN") -> DataFrame:
    """Base rate and volatility of the sector; unknown sectors get the middle values."""
    dim = dim_sectors(df.sparkSession).withColumnRenamed("sector_code", "_code")
    return _lookup(df, dim, key, ["base_rate", "volatility"]).withColumns({
        "base_rate": F.coalesce("base_rate", F.lit(DEFAULT_BASE_RATE)),
        "volatility": F.coalesce("volatility", F.lit(DEFAULT_VOLATILITY)),
    })


def with_development_tier(df: DataFrame, key="State") -> DataFrame:
    """State development tier; unknown states count as low."""
    dim = dim_states(df.sparkSession).withColumnRenamed("state_code", "_code")
    return _lookup(df, dim, key, ["tier"]).withColumn("tier", F.coalesce("tier", F.lit("low")))


def unknown_codes(loans: DataFrame) -> DataFrame:
    """Sector and state codes that no dimension row explains, with their loan counts.

    Loans are counted per code first, so the anti join sees one row per code.
    """
    spark = loans.sparkSession

    def missing(column, dim, code):
        counts = loans.groupBy(F.col(column).alias("code")).agg(F.count("*").alias("n_loans"))
        known = dim.select(F.col(code).alias("code"))
        return counts.join(F.broadcast(known), "code", "left_anti").select(
            F.lit(column).alias("dimension"), "code", "n_loans"
        )

    return missing("SCIAN", dim_sectors(spark), "sector_code").unionByName(
        missing("State", dim_states(spark), "state_code")
    )


def complete_categories(summary: DataFrame, key: str, categories, count="n") -> DataFrame:
    """Every listed category, in order; absent ones with count 0 and null measures."""
    spark = summary.sparkSession
    listed = constant_table(spark, [(label, i) for i, label in enumerate(categories, start=1)], [key, f"{key}_ord"])
    listed = listed.withColumn(f"{key}_ord", F.col(f"{key}_ord").cast("int"))
    rest = summary.drop(f"{key}_ord")
    return listed.join(rest, key, "left").withColumn(count, F.coalesce(F.col(count), F.lit(0).cast("long")))


def restrict_to(summary: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of one summary whose key appears in another."""
    return summary.join(keys.select(key), key, "left_semi")


def attach_predictions(loans: DataFrame, predictions: DataFrame, key="LoanNr") -> DataFrame:
    """Put the predictions of the same loan on its row."""
    overlap = [x for x in predictions.columns if x in loans.columns and x != key]
    return loans.drop(*overlap).join(predictions, key, "inner")


def apply_segment_factors(loans: DataFrame, factors: DataFrame, segment: str, el="el") -> DataFrame:
    """Scale expected loss by the factor of its segment; segments without one keep factor 1."""
    table = factors.filter(F.col(segment).isNotNull()).select(
        F.col(segment).alias("_segment"), F.col("factor").alias("segment_factor")
    )
    joined = loans.join(broadcast_if_small(table), F.col(segment) == F.col("_segment"), "left").drop("_segment")
    return joined.withColumn("segment_factor", F.coalesce("segment_factor", F.lit(1.0))).withColumn(
        "el_segment", F.col(el) * F.col("segment_factor")
    )
