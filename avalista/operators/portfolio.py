"""Portfolio aggregates. Sums and means use partial aggregation, so hot keys stay cheap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from avalista.functions import segments as seg
from avalista.operators.lookups import complete_categories, with_sector_name, with_state_name
from avalista.operators.ordered import exact_quantiles, quantiles
from avalista.session import broadcast_if_small, cut_lineage, with_totals

c = F.col


def profile_loans(loans: DataFrame) -> DataFrame:
    """Row count, column count and the column list."""
    names = loans.columns
    return loans.agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.lit(len(names)).cast("long").alias("n_columns"), F.lit(",".join(names)).alias("column_names")
    )


def first_rows(loans: DataFrame, n: int = 5, key="LoanNr") -> DataFrame:
    return loans.orderBy(key).limit(n)


def portfolio_summary(loans: DataFrame) -> DataFrame:
    """One row with the headline figures, in a single pass."""
    with_guarantee = (c("Portion") > 0).cast("int")
    with_collateral = (c("RealEstate") == 1).cast("int")
    loss = c("ChgOffPrinGr")
    return loans.agg(
        F.count("*").alias("n_loans"),
        F.avg("Default").alias("default_rate"),
        F.sum("GrAppv").alias("total_amount"),
        F.avg("GrAppv").alias("mean_amount"),
        F.sum(loss).alias("total_loss"),
        F.avg(F.when(loss > 0, loss)).alias("mean_loss_when_lost"),
        F.coalesce(F.sum(with_guarantee), F.lit(0)).alias("n_guaranteed"),
        F.avg(F.coalesce(with_guarantee, F.lit(0))).alias("share_guaranteed"),
        F.coalesce(F.sum(with_collateral), F.lit(0)).alias("n_collateral"),
        F.avg(F.coalesce(with_collateral, F.lit(0))).alias("share_collateral"),
    )


def default_rate_by(loans: DataFrame, key, name=None, overall=False, order=None, **measures: Column) -> DataFrame:
    """Default rate and count per key; null keys are dropped.

    ``order`` is an integer column that sorts the keys; ``overall`` adds the
    portfolio rate; ``measures`` are further aggregates.
    """
    key = key if isinstance(key, Column) else c(key).alias(key)
    name = name or "segment"
    keys = [key.alias(name)] + ([order.alias(f"{name}_ord")] if order is not None else [])
    out = loans.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("Default").alias("default_rate"),
        *[m.alias(n) for n, m in measures.items()],
        *([F.sum("Default").alias("_defaults"), F.count("Default").alias("_known")] if overall else []),
    )
    if overall:
        out = with_totals(out, _all=F.sum("_defaults"), _of=F.sum("_known"))
        out = out.withColumn("overall_rate", F.try_divide("_all", "_of")).drop("_defaults", "_known", "_all", "_of")
    return out.filter(c(name).isNotNull())


def _percent(summary: DataFrame, *columns: str) -> DataFrame:
    return summary.withColumns({x: c(x) * 100 for x in columns or ("default_rate",)})


def by_amount_bucket(loans):
    return _percent(default_rate_by(loans, seg.amount_bucket(), "bucket", order=seg.amount_bucket_ord()))


def by_term_bucket(loans):
    return _percent(default_rate_by(loans, seg.term_bucket(), "bucket", order=seg.term_bucket_ord()))


def by_business_age(loans, is_new="IsNewBusiness"):
    return _percent(default_rate_by(loans, seg.business_label(is_new), "business"))


def by_approval_year(loans, overall=True):
    out = default_rate_by(loans, seg.approval_year(), "year", overall=overall)
    return _percent(out, *(["default_rate", "overall_rate"] if overall else ["default_rate"]))


def by_sector(loans, overall=False):
    return default_rate_by(loans, c("SCIAN"), "SCIAN", overall=overall).orderBy("default_rate", "SCIAN")


def by_sector_amount(loans):
    return default_rate_by(loans, c("SCIAN"), "SCIAN", total_amount=F.sum("GrAppv"))


def by_sector_with_support(loans, min_loans: int = 100):
    out = default_rate_by(loans, c("SCIAN"), "SCIAN").filter(c("n") >= min_loans)
    return _percent(out)


def by_state_with_support(loans, min_loans: int = 50):
    out = default_rate_by(loans, c("State"), "State", mean_amount=F.avg("GrAppv")).filter(c("n") >= min_loans)
    return _percent(out)


def by_size_class(loans, long=True):
    labels = seg.SIZE_LABELS_LONG if long else seg.SIZE_LABELS
    found = default_rate_by(loans, seg.size_class("NoEmp", long=long), "size_class")
    return complete_categories(_percent(found), "size_class", labels)


def by_portion_band(loans):
    found = default_rate_by(loans, seg.portion_band(), "portion_band")
    return complete_categories(_percent(found), "portion_band", seg.PORTION_LABELS)


def by_collateral(loans):
    return _percent(default_rate_by(loans, c("RealEstate"), "RealEstate"))


def by_crisis(loans):
    return _percent(default_rate_by(loans, c("Recession"), "Recession"))


SEGMENTS = {
    "amount": lambda: seg.amount_bucket(),
    "term": lambda: seg.term_bucket(),
    "size": lambda: seg.size_class("NoEmp"),
    "portion": lambda: seg.portion_band(),
    "sector": lambda: c("SCIAN"),
    "state": lambda: c("State"),
    "business": lambda: seg.business_label(F.when(c("NewExist") == 1, 1).otherwise(0)),
    "collateral": lambda: c("RealEstate").cast("string"),
    "crisis": lambda: c("Recession").cast("string"),
    "year": lambda: seg.approval_year().cast("string"),
}


def multi_segment_rates(loans: DataFrame, segments=None) -> DataFrame:
    """All segment tables from one scan, as grouping sets over the narrow segment columns.

    Each row is expanded once per segment inside the map task and summed there,
    so only one row per segment value and task is shuffled.
    """
    names = list(segments or SEGMENTS)
    narrow = loans.select(*[SEGMENTS[n]().alias(n) for n in names], "Default", "ChgOffPrinGr")
    sets = narrow.groupingSets([[c(n)] for n in names], *names).agg(
        F.grouping_id().alias("_set"),
        F.count("*").alias("n"),
        F.avg("Default").alias("default_rate"),
        F.sum("ChgOffPrinGr").alias("total_loss"),
    )
    everything = (1 << len(names)) - 1
    which, value = F, F
    for i, n in enumerate(names):
        mine = c("_set") == everything - (1 << (len(names) - 1 - i))
        which, value = which.when(mine, F.lit(n)), value.when(mine, c(n))
    return sets.select(
        which.alias("dimension"), value.alias("segment"), "n", "default_rate", "total_loss"
    ).filter(c("segment").isNotNull())


def value_counts(loans: DataFrame, column: str) -> DataFrame:
    """Counts of non-null values, largest first, with their share."""
    counts = loans.filter(c(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    shares = counts.withColumn("share", c("n") / loans.agg(F.count(column)).scalar())  # a column of any number of values
    return shares.orderBy(c("n").desc(), c(column))


def describe(loans: DataFrame, columns, accuracy: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, one row per column."""
    pairs = ", ".join(f"'{x}', cast(`{x}` as double)" for x in columns)
    long = loans.select(F.expr(f"stack({len(columns)}, {pairs}) as (column_name, value)"))
    moments = [
        F.count("_value").alias("n"), F.avg("_value").alias("mean"), F.stddev_samp("_value").alias("std"),
        F.min("_value").alias("min"), F.max("_value").alias("max"),
    ]
    points = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    if accuracy is None:
        return exact_quantiles(long, "value", points, ["column_name"], also=moments)
    cuts = [F.percentile_approx("_value", p, accuracy).alias(name) for name, p in points.items()]
    return long.withColumnRenamed("value", "_value").groupBy("column_name").agg(*moments, *cuts)


def null_counts(loans: DataFrame, columns) -> DataFrame:
    counts = loans.agg(*[F.count_if(c(x).isNull()).alias(x) for x in columns])
    pairs = ", ".join(f"'{x}', `{x}`" for x in columns)
    return counts.select(F.expr(f"stack({len(columns)}, {pairs}) as (column_name, n_null)"))


def score_quantiles(loans: DataFrame, column: str, accuracy: int | None = None) -> DataFrame:
    points = {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "max": 1.0}
    return quantiles(loans, column, points, accuracy=accuracy)


def histogram(loans: DataFrame, value, bins: int, lo=None, hi=None) -> DataFrame:
    """Equal-width bins from min to max, the last one closed; empty bins included.

    The range is a scalar subquery unless given; values outside a given range are left out.
    """
    value = value if isinstance(value, Column) else c(value)
    data = loans.select(value.cast("double").alias("x")).filter(c("x").isNotNull())
    found = data.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"))
    low = F.lit(float(lo)) if lo is not None else c("lo")
    high = F.lit(float(hi)) if hi is not None else c("hi")
    flat = low == high
    found = found.select(
        F.when(flat, low - 0.5).otherwise(low).alias("lo"), F.when(flat, high + 0.5).otherwise(high).alias("hi"), "mean"
    )
    limits = found.select(F.struct("lo", ((c("hi") - c("lo")) / bins).alias("width"), "hi", "mean").alias("r")).scalar()
    at = c("r").getField
    ranged = data.withColumn("r", limits)
    if lo is not None or hi is not None:
        ranged = ranged.filter((c("x") >= at("lo")) & (c("x") <= at("hi")))
    place = F.least(F.floor((c("x") - at("lo")) / at("width")), F.lit(bins - 1).cast("long"))
    counts = ranged.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    grid = loans.sparkSession.range(0, bins, 1, 1).withColumnRenamed("id", "bin")
    return grid.join(counts, "bin", "left").withColumn("r", limits).select(
        "bin",
        (at("lo") + c("bin") * at("width")).alias("bin_lo"),
        (at("lo") + (c("bin") + 1) * at("width")).alias("bin_hi"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        at("mean").alias("mean"),
    )


def histogram_by_class(loans: DataFrame, value: str, bins: int, label: str, classes) -> DataFrame:
    """One histogram per class, each over its own range; two passes for all classes together."""
    data = loans.filter(c(label).isin(*classes) & c(value).isNotNull()).select(
        c(label).alias("class"), c(value).cast("double").alias("x")
    )
    low, high = F.min("x"), F.max("x")
    limits = data.groupBy("class").agg(
        F.when(low == high, low - 0.5).otherwise(low).alias("lo"),
        F.when(low == high, high + 0.5).otherwise(high).alias("hi"),
        F.avg("x").alias("mean"),
    ).withColumn("width", (c("hi") - c("lo")) / bins)
    limits = F.broadcast(limits)  # one row per listed class
    place = F.least(F.floor((c("x") - c("lo")) / c("width")), F.lit(bins - 1).cast("long"))
    counts = data.join(limits, "class").groupBy("class", place.alias("bin")).agg(F.count("*").alias("n"))
    grid = loans.sparkSession.range(0, bins * len(classes), 1, 1).select(
        F.element_at(F.array(*[F.lit(x) for x in classes]), F.floor(c("id") / bins).cast("int") + 1).alias("class"),
        (c("id") % bins).alias("bin"),
    )
    return grid.join(counts, ["class", "bin"], "left").join(limits, "class").select(
        c("class").alias("actual"),
        "bin",
        (c("lo") + c("bin") * c("width")).alias("bin_lo"),
        (c("lo") + (c("bin") + 1) * c("width")).alias("bin_hi"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        "mean",
    )


def box_stats(loans: DataFrame, value: str, by: Column, name="segment", accuracy: int | None = None) -> DataFrame:
    """Quartiles, whiskers (furthest data within 1.5 quartile ranges) and outlier count per group.

    ``by`` must have a handful of groups, such as a size class.
    """
    data = cut_lineage(loans.select(by.alias(name), c(value).cast("double").alias("x")).filter(  # read three times below
        c(name).isNotNull() & c("x").isNotNull()
    ))
    box = quantiles(data, "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, [name], accuracy)
    reach = 1.5 * (c("q3") - c("q1"))
    fences = box.withColumns({"_lo": c("q1") - reach, "_hi": c("q3") + reach})
    joined = data.join(broadcast_if_small(fences), name)
    inside = (c("x") >= c("_lo")) & (c("x") <= c("_hi"))
    return joined.groupBy(name).agg(
        F.count("*").alias("n"),
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, c("x"))).alias("whisker_lo"),
        F.max(F.when(inside, c("x"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"),
    )


def loss_by_amount_bucket(scored: DataFrame, el="el", loss="ChgOffPrinGr") -> DataFrame:
    return (
        scored.groupBy(seg.amount_bucket().alias("bucket"), seg.amount_bucket_ord().alias("bucket_ord"))
        .agg(F.sum(el).alias("predicted_el"), F.sum(loss).alias("actual_loss"))
        .filter(c("bucket").isNotNull())
    )


def mix_vs_target(loans: DataFrame, key, target: DataFrame, within: str | None = None) -> DataFrame:
    """Portfolio share against the normalised target share, and the post-stratification weight.

    ``target`` has columns key, weight and, with ``within``, the outer group that
    both shares are taken in. One row per key on both sides, keys with neither
    side absent; the tables are aggregates, so their size is the number of keys.
    """
    groups = [within] if within else []
    keyed = loans.select(*groups, key.alias("key") if isinstance(key, Column) else c(key).alias("key"))
    keyed = keyed.filter(c("key").isNotNull())
    counts = keyed.groupBy(*groups, "key").agg(F.count("*").alias("n"))
    if within:
        total = F.sum("n").over(Window.partitionBy(*groups))
        weight_total = F.sum("weight").over(Window.partitionBy(*groups))
    else:
        counts, total = with_totals(counts, _total=F.sum("n")), c("_total")
        weight_total = target.agg(F.sum("weight")).scalar()
    actual = counts.select(*groups, "key", "n", (c("n") / total).alias("share"))
    wanted = target.select(*groups, "key", (c("weight") / weight_total).alias("target_share"))
    out = actual.join(wanted, [*groups, "key"], "full").withColumns({
        "n": F.coalesce("n", F.lit(0).cast("long")),
        "share": F.coalesce("share", F.lit(0.0)),
        "target_share": F.coalesce("target_share", F.lit(0.0)),
    })
    return out.withColumns({
        "difference": c("share") - c("target_share"),
        "weight": F.when(c("share") > 0, F.try_divide(c("target_share"), c("share"))),
    })


def top_risk_sectors(loans: DataFrame, k: int = 8, min_loans: int = 100) -> DataFrame:
    top = by_sector_with_support(loans, min_loans).orderBy(c("default_rate").desc(), "SCIAN").limit(k)
    return with_sector_name(top, length=20)


def top5_sectors(loans: DataFrame, k: int = 5) -> DataFrame:
    top = by_sector_amount(loans).orderBy(c("default_rate").desc(), "SCIAN").limit(k)
    return with_sector_name(_percent(top), fallback="Desconocido", length=30)


def top_states(loans: DataFrame, k: int = 15, min_loans: int = 50) -> DataFrame:
    top = by_state_with_support(loans, min_loans).orderBy(c("n").desc(), "State").limit(k)
    return with_state_name(top, length=15)


def rank_sectors(loans: DataFrame) -> DataFrame:
    """Position of each sector by default rate; the window runs over one row per sector."""
    order = Window.orderBy(c("default_rate").desc(), c("SCIAN"))
    dense = Window.orderBy(c("default_rate").desc())
    rates = default_rate_by(loans, c("SCIAN"), "SCIAN")
    return rates.withColumns({
        "position": F.row_number().over(order), "rate_rank": F.dense_rank().over(dense)
    })


def list_codes(dim: DataFrame) -> DataFrame:
    """Code and name of a dimension table, sorted by code."""
    code, name = dim.columns[:2]
    return dim.select(code, name).orderBy(code)
