"""Running totals and exact quantiles over a total order, without a one-task window.

Running totals: the narrow rows are written once to the checkpoint folder, as they are read three times. A sample of them, drawn by hash,
gives cut points over the *whole* sort key, so rows that tie on the first column still spread as long as a later key column tells them apart. A row's part
is a function of its key and the cuts, not of where it happens to lie, so a recomputed task sees the same parts. Each part is summed before
the shuffle and on its own behind it; a small table of part totals gives every part its starting offset. The rows are
shuffled once, and the number of parts follows their number.

Quantiles: a one-pass sketch brackets each wanted rank. A second pass keeps the values inside the brackets and counts the rest as one row per gap, so
only a thin slice of the data (some 4 / ``SKETCH`` of it for each rank) is written, and sorted in its group. Every rank is then checked to lie inside a
bracket; if one does not, all values are ranked.
"""

from __future__ import annotations

import re
from functools import reduce
from math import ceil, inf, nextafter, sqrt

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from avalista.session import broadcast_if_small, cut_lineage

PART = "_part"
SKETCH = 10_000  # rank error of the bracketing sketch: 1 / SKETCH
DRAWN = 32  # sampled rows per part
PART_ROWS = 1 << 20  # at most about so many rows in a part
LEAST_ROWS = 1 << 14  # and no fewer than so many, unless there is one part


def _sort_keys(order) -> list[tuple[Column, bool, bool]]:
    """Expression, descending, nulls first of each sort key."""
    keys = []
    for item in order:
        text = item._jc.toString()
        found = re.fullmatch(r"(.*) (ASC|DESC) NULLS (FIRST|LAST)", text)
        name, way, nulls = found.groups() if found else (text, "ASC", "FIRST")
        keys.append((F.col(name), way == "DESC", nulls == "FIRST"))
    return keys


def _reached(cut: Column, keys) -> Column:
    """Whether a row's sort key is that of ``cut`` or comes after it."""
    out = F.lit(True)
    for i, (key, down, nulls_first) in reversed(list(enumerate(keys))):
        mark = cut[f"k{i}"]
        beyond = (mark > key) if down else (mark < key)
        null_before = mark.isNull() & key.isNotNull() if nulls_first else mark.isNotNull() & key.isNull()
        out = null_before | F.coalesce(beyond, F.lit(False)) | (mark.eqNullSafe(key) & out)
    return out


def part_of(df: DataFrame, order, parts: int) -> Column:
    """The part of each row along ``order``: the number of cut points it has reached, found in two steps.

    The cut points come from the ``DRAWN * parts`` rows of the smallest hash, sorted.
    """
    if parts == 1:
        return F.lit(0)
    keys = _sort_keys(order)
    named = df.select(*[key.alias(f"k{i}") for i, (key, _, _) in enumerate(keys)])
    drawn = named.orderBy(F.xxhash64(*named.columns)).limit(DRAWN * parts)
    along = [(c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last())
             for c, down, first in ((F.col(f"k{i}"), down, first) for i, (_, down, first) in enumerate(keys))]
    rows = drawn.orderBy(*along).collect()
    cuts = [rows[len(rows) * i // parts] for i in range(1, parts)] if rows else []
    if not cuts:
        return F.lit(0)
    types = dict(named.dtypes)
    mark = lambda row: F.struct(*[F.lit(row[k]).cast(types[k]).alias(k) for k in named.columns])
    reached = lambda marks: F.size(F.filter(marks, lambda cut: _reached(cut, keys)))
    step = ceil(sqrt(len(cuts)))
    groups = [[mark(row) for row in cuts[i : i + step]] for i in range(0, len(cuts), step)]
    coarse = reached(F.array(*[group[0] for group in groups]))
    fine = reached(F.get(F.array(*[F.array(*group) for group in groups]), coarse - 1))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + fine)


def running_totals(
    df: DataFrame, order, measures: dict[str, Column], by=(), totals: bool = False, parts: int | None = None
) -> DataFrame:
    """Add each measure's inclusive running total along ``order``, restarted per ``by`` group.

    With ``totals`` the group total is added as ``<name>_total``. ``parts`` fixes
    the number of ranges; by default it follows the number of rows and the session's shuffle partitions.
    """
    order, by = list(order), list(by)
    narrow = cut_lineage(df.withColumns({f"_{name}_in": expr for name, expr in measures.items()}))
    if parts is None:
        rows = narrow.count()
        parts = max(ceil(rows / PART_ROWS), min(ceil(rows / LEAST_ROWS), 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1)
    placed = narrow.withColumn(PART, part_of(df, order, parts))
    inputs = {name: F.col(f"_{name}_in") for name in measures}

    part_totals = placed.groupBy(*by, PART).agg(*[F.sum(x).alias(n) for n, x in inputs.items()])
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    offsets = part_totals.select(
        *[F.col(b).alias(f"_by_{b}") for b in by],
        F.col(PART).alias("_offset_part"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}_before") for n in measures],
        *([F.sum(n).over(group).alias(f"{n}_total") for n in measures] if totals else []),
    )
    if not by:
        offsets = F.broadcast(offsets)  # one row per part

    within = Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumns({name: F.sum(x).over(within) for name, x in inputs.items()})
    same = F.col(PART) == F.col("_offset_part")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return (
        local.join(offsets, same)
        .withColumns({name: F.col(name) + F.col(f"_{name}_before") for name in measures})
        .drop(
            PART, "_offset_part", *[f"_by_{b}" for b in by],
            *[f"_{n}_before" for n in measures], *[f"_{n}_in" for n in measures],
        )
    )


def _bracket_table(data: DataFrame, probabilities, by, sketch: int, also=()) -> DataFrame:
    """Low and high cut around each probability, twice the sketch's error apart, and the aggregates ``also``, per group."""
    slack = 2.0 / sketch
    cuts = [edge for p in probabilities for edge in (max(0.0, p - slack), min(1.0, p + slack))]
    return data.groupBy(*by).agg(F.percentile_approx("_value", cuts, sketch).alias("_cuts"), *also)


def thin_out(data: DataFrame, probabilities, by=(), sketch: int | None = None, table: DataFrame | None = None) -> DataFrame | None:
    """Add ``_place`` and ``_gap``: values near a wanted rank keep theirs, a gap between them shares one.

    ``_place`` sorts like ``_value``. ``table`` has the brackets of each group, if they are known already. None when there is nothing to bracket.
    """
    value = F.col("_value")
    if table is None:
        table = cut_lineage(_bracket_table(data, probabilities, by, sketch or SKETCH))
    if not by:
        cuts = table.first()["_cuts"]
        if not cuts:
            return None
        brackets = [(low, nextafter(high, inf)) for low, high in zip(cuts[::2], cuts[1::2])]
        starts = [-inf, *sorted({edge for pair in brackets for edge in pair})]
        kept = [any(low <= start < high for low, high in brackets) for start in starts]
        cell = Bucketizer(splits=[*starts, inf], inputCol="_value", outputCol="_cell", handleInvalid="keep").transform(data)
        at = F.col("_cell").cast("int") + 1
        gap = ~F.element_at(F.array(*[F.lit(k) for k in [*kept, True]]), at)
        start = F.element_at(F.array(*[F.lit(float(x)) for x in [*starts, inf]]), at)
        return cell.withColumns({"_gap": gap, "_place": F.when(gap, start).otherwise(value)}).drop("_cell")

    renamed = table.select(*[F.col(b).alias(f"_by_{b}") for b in by], "_cuts")
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by])
    joined = data.join(broadcast_if_small(renamed, written=True), same).drop(*[f"_by_{b}" for b in by])
    pairs = [(F.col("_cuts")[2 * i], F.col("_cuts")[2 * i + 1]) for i in range(len(probabilities))]
    gap = ~reduce(lambda x, y: x | y, [(value >= low) & (value <= high) for low, high in pairs])
    below = F.greatest(F.lit(-inf), *[F.when(high < value, high) for _, high in pairs])
    return joined.withColumns({"_gap": gap, "_place": F.when(gap, below).otherwise(value)}).drop("_cuts")


def _in_one_window(counts: DataFrame, by) -> DataFrame:
    group, along = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_place", "_gap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumns({"_upto": F.sum("_count").over(along), "_upto_total": F.sum("_count").over(group)})


def _in_parts(counts: DataFrame, by) -> DataFrame:
    return running_totals(counts, [F.col("_place").asc(), F.col("_gap").asc()], {"_upto": F.col("_count")}, by, totals=True)


def _pick(ranked: DataFrame, probabilities: dict[str, float], by) -> DataFrame:
    """Interpolated quantiles from ranked counts of values; ``_unsure`` when a rank falls into a gap."""
    first = F.col("_upto") - F.col("_count")
    covers = lambda rank: (first <= rank) & (rank < F.col("_upto"))
    measures, unsure = [], F.lit(False)
    for name, p in probabilities.items():
        rank = F.lit(float(p)) * (F.col("_upto_total") - 1)
        measures += [
            F.max(F.when(covers(F.floor(rank)), F.col("_place"))).alias(f"_low_{name}"),
            F.max(F.when(covers(F.ceil(rank)), F.col("_place"))).alias(f"_high_{name}"),
            F.max(rank - F.floor(rank)).alias(f"_part_{name}"),
        ]
        unsure = unsure | covers(F.floor(rank)) | covers(F.ceil(rank))
    found = ranked.groupBy(*by).agg(*measures, F.max(F.col("_gap") & unsure).alias("_unsure"))
    low, high, part = (lambda n: F.col(f"_low_{n}")), (lambda n: F.col(f"_high_{n}")), (lambda n: F.col(f"_part_{n}"))
    return found.select(
        *by, *[(low(n) + (high(n) - low(n)) * part(n)).alias(n) for n in probabilities], "_unsure"
    )


def exact_quantiles(df: DataFrame, value, probabilities: dict[str, float], by=(), sketch: int | None = None, also=()) -> DataFrame:
    """Linearly interpolated quantiles, one column per name; one row per ``by`` group.

    Equal values are counted before any shuffle, so a hot value costs one row. ``also`` are further named aggregates of the
    rows, taken in the same pass as the sketch; with them, groups without a value stay.
    """
    by, also = list(by), list(also)
    value = value if isinstance(value, Column) else F.col(value)
    data = df.select(*by, value.cast("double").alias("_value"))
    data = data if also else data.filter(F.col("_value").isNotNull())
    table = cut_lineage(_bracket_table(data, list(probabilities.values()), by, sketch or SKETCH, also))
    data = data.filter(F.col("_value").isNotNull())
    thin = thin_out(data, list(probabilities.values()), by, sketch, table)
    found = None
    if thin is not None:
        counts = cut_lineage(thin.groupBy(*by, "_place", "_gap").agg(F.count("*").alias("_count")))
        found = cut_lineage(_pick(_in_one_window(counts, by), probabilities, by))
    if found is None or found.filter("_unsure").limit(1).count():
        counts = data.groupBy(*by, F.col("_value").alias("_place")).agg(F.count("*").alias("_count"))
        found = _pick(_in_parts(counts.withColumn("_gap", F.lit(False)), by), probabilities, by)
    found = found.drop("_unsure")
    if not also:
        return found
    more = table.drop("_cuts").withColumnsRenamed({b: f"_by_{b}" for b in by})
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by])
    return more.join(broadcast_if_small(found, written=True), same, "left").select(
        *[F.col(f"_by_{b}").alias(b) for b in by], *[x for x in more.columns if not x.startswith("_by_")], *probabilities)


def quantiles(df: DataFrame, value, probabilities: dict[str, float], by=(), accuracy: int | None = None) -> DataFrame:
    """Exact by default; with ``accuracy`` a one-pass sketch with rank error 1/accuracy."""
    if accuracy is None:
        return exact_quantiles(df, value, probabilities, by)
    value = value if isinstance(value, Column) else F.col(value)
    return df.groupBy(*by).agg(
        *[F.percentile_approx(value.cast("double"), float(p), accuracy).alias(n) for n, p in probabilities.items()]
    )
