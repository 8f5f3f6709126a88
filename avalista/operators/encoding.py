"""Scaling, encoding, splitting and weighting as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from avalista.operators.ordered import running_totals
from avalista.session import broadcast_if_small, with_totals

c = F.col
DIGITS = 4  # 65,536 buckets per class


def split_hash(key, seed: int = 42) -> Column:
    """Hexadecimal digest of loan id and seed: the same on every run, machine and layout."""
    return F.md5(F.concat(c(key).cast("string"), F.lit(f"|{seed}")))


def with_fold(loans: DataFrame, test_size: float = 0.2, seed: int = 42, key="LoanNr", name="fold") -> DataFrame:
    """Mark each loan ``train`` or ``test`` by its digest; needs no shuffle.

    The digest is independent of the default flag, so both folds keep its share
    up to chance. ``with_exact_fold`` fixes the share in every class.
    """
    cut = format(int(test_size * 2**32), "08x")
    is_test = F.substring(split_hash(key, seed), 1, 8) < F.lit(cut)
    return loans.withColumn(name, F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


def with_exact_fold(loans: DataFrame, test_size: float = 0.2, seed: int = 42, by="Default", key="LoanNr", name="fold") -> DataFrame:
    """Test share fixed in every class: the loans with the lowest digests of each class.

    Digests are uniform, so counting them by their first ``DIGITS`` digits finds the bucket in which
    a class reaches its share; only that bucket's digests are ranked. The loans
    themselves are compared with the cut where they are.
    """
    digest = split_hash(key, seed)
    narrow = loans.select(c(by).alias("_class"), digest.alias("_digest"), c(key).alias("_key")).withColumn("_bucket", F.substring("_digest", 1, DIGITS))
    along = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = narrow.groupBy("_class", "_bucket").agg(F.count("*").alias("_n")).withColumns(
        {"_upto": F.sum("_n").over(along), "_total": F.sum("_n").over(Window.partitionBy("_class"))})
    wanted = F.round(c("_total") * test_size)
    reached = counts.filter((c("_upto") >= wanted) & (c("_upto") - c("_n") < wanted)).select(
        c("_class").alias("_in"), c("_bucket").alias("_at"), (wanted - c("_upto") + c("_n")).alias("_rest"))
    near = narrow.join(reached, c("_class").eqNullSafe(c("_in")) & (c("_bucket") == c("_at")))
    place = F.row_number().over(Window.partitionBy("_class").orderBy("_digest", "_key"))
    last = near.withColumn("_place", place).filter(c("_place") == c("_rest")).select("_class", F.struct("_digest", "_key").alias("_cut"))
    joined = loans.join(broadcast_if_small(last), c(by).eqNullSafe(c("_class")), "left")
    is_test = F.struct(digest.alias("_digest"), c(key).alias("_key")) <= c("_cut")
    return joined.withColumn(name, F.when(is_test, F.lit("test")).otherwise(F.lit("train"))).drop("_class", "_cut")


def scaler_stats(loans: DataFrame, columns) -> DataFrame:
    """Mean and population deviation of every column, in one row."""
    return loans.agg(
        *[F.avg(x).alias(f"{x}_mean") for x in columns], *[F.stddev_pop(x).alias(f"{x}_std") for x in columns]
    )


def standardize(loans: DataFrame, columns, stats: DataFrame | None = None, prefix="num__") -> DataFrame:
    """(x - mean) / population deviation, zero for constant columns; stats default to the input's own."""
    stats = stats if stats is not None else scaler_stats(loans, columns)
    at = c("_stats").getField
    scaled = loans.withColumn("_stats", stats.select(F.struct(*stats.columns)).scalar()).withColumns({
        prefix + x: F.coalesce(F.try_divide(c(x) - at(f"{x}_mean"), at(f"{x}_std")), F.lit(0.0) * c(x)) for x in columns
    })
    return scaled.drop("_stats")


def one_hot(loans: DataFrame, column: str, categories) -> DataFrame:
    """One 0/1 column per known category, in sorted order; unknown values give all zeros."""
    return loans.withColumns({
        f"cat__{column}_{x}": F.coalesce((c(column) == x).cast("int"), F.lit(0)) for x in sorted(categories)
    })


def label_codes(loans: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, numbered from 0 in sorted order."""
    values = loans.filter(c(column).isNotNull()).select(c(column).cast("string").alias(column)).distinct()
    return running_totals(values, [c(column).asc()], {"_place": F.lit(1)}).select(
        column, (c("_place") - 1).cast("int").alias(f"{column}_encoded")
    )


def label_encode(loans: DataFrame, columns, codes: dict[str, DataFrame] | None = None) -> DataFrame:
    """Replace category text by its number; with given ``codes`` an unseen value fails the job."""
    out = loans
    for column in columns:
        table = codes[column] if codes else label_codes(loans, column)
        found = broadcast_if_small(table.withColumnRenamed(column, "_code"))
        out = out.join(found, c(column).cast("string") == c("_code"), "left").drop("_code")
        if codes:
            unseen = F.raise_error(F.concat(F.lit(f"unseen {column}: "), F.coalesce(c(column).cast("string"), F.lit("null"))))
            out = out.withColumn(f"{column}_encoded", F.coalesce(c(f"{column}_encoded"), unseen.cast("int")))
    return out


def class_weights(loans: DataFrame, label="Default", mode="balanced", positive: float = 3.0) -> DataFrame:
    """Weight per class: n / (2 n_class), or a fixed weight for the positive class."""
    counts = loans.groupBy(label).agg(F.count("*").alias("n"))
    if mode == "balanced":
        return with_totals(counts, _n=F.sum("n")).withColumn("weight", c("_n") / (2 * c("n"))).drop("_n")
    if mode == "positive":
        return counts.withColumn("weight", F.when(c(label) == 1, F.lit(positive)).otherwise(F.lit(1.0)))
    raise ValueError(f"unknown mode {mode!r}")


def with_class_weight(loans: DataFrame, label="Default", mode="balanced", positive: float = 3.0, name="weight") -> DataFrame:
    """Put the weight of its class on each row; class counts are a scalar subquery."""
    y = c(label) == 1
    if mode == "balanced":
        sizes = loans.agg(F.struct(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))).scalar()
        pos, neg = c("_sizes").getField("pos"), c("_sizes").getField("neg")
        weight = F.try_divide((pos + neg).cast("double"), 2 * F.when(y, pos).otherwise(neg))
        return loans.withColumn("_sizes", sizes).withColumn(name, weight).drop("_sizes")
    if mode == "positive":
        return loans.withColumn(name, F.when(y, F.lit(positive)).otherwise(F.lit(1.0)))
    raise ValueError(f"unknown mode {mode!r}")
