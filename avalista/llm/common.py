"""What several operators share: reading tables, cutting lineage, batches in Python tasks."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from avalista.session import cut_lineage  # noqa: F401  (used by the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Return a worker's freed memory to the machine, as workers are used again by other tasks."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
        ctypes.CDLL(None).malloc_trim(0)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished work now: Spark removes them once the driver's JVM has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BITS = 1 << 23


def bitmap(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bitmap of fixed size of the column ``h``; at most ``bits / 64`` rows reach the driver."""
    bit = F.pmod(F.col("h"), F.lit(bits))
    words = hashes.select(F.floor(bit / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) % 64 as int))").alias("mask"))
    rows = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["mask"].to_numpy()
    return out


def passes(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which of the signed hashes may be in a bitmap; all that were put in are."""
    bits = len(words) * 64
    bit = (hashes & (bits - 1) if bits & (bits - 1) == 0 else np.mod(hashes, bits)).astype(np.uint64)  # a division costs more than the look-up
    return (words.view(np.uint64)[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def by_group(df: DataFrame, keys: list[str], order: list[str], fn, schema: str, parts: int | None = None) -> DataFrame:
    """Bring the rows of a key together and apply ``fn(table) -> iterator of record batches`` to each key's rows, in order.

    A task streams its partition and holds one key's rows at a time, so keys must be bounded.
    """
    spark = df.sparkSession
    placed = df.repartition(parts or shuffle_partitions(spark), *keys).sortWithinPartitions(*keys, *order)

    def tasks(batches):
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = pa.Table.from_batches([batch])
            new = np.zeros(batch.num_rows, bool)
            for key in keys:
                column = batch.column(batch.schema.get_field_index(key))
                codes = column.dictionary_encode()
                codes = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                part = rows.slice(start, end - start)
                if held is not None and start == 0 and all(held[k][0].as_py() == part[k][0].as_py() for k in keys):
                    held = pa.concat_tables([held, part])
                    continue
                if held is not None:
                    yield from fn(held)
                held = part
        if held is not None:
            yield from fn(held)

    return placed.mapInArrow(tasks, schema)
