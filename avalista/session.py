"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_PART_ROWS = 1 << 19


def get_session(app: str = "avalista", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; sizes are left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.checkpoint.compress": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's own, or a scratch one where the driver is the only process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="avalista-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, on the storage all executors share; removed when the driver's Python ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def remove():
        if spark.sparkContext._jsc is not None:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    atexit.register(remove)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files.

    Row placement is frozen with it, so a recomputed task cannot see other rows
    than its first attempt did.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(rows: DataFrame, n_rows: int, part_rows: int, most: int | None = None) -> DataFrame:
    """``rows`` in as many partitions as there are cores, for work that goes over them many times; fewer if these had less than ``part_rows``.

    Neither one partition, as adaptive execution makes of narrow rows, nor many are left: what a pass returns per partition grows with their number.
    ``most`` bounds the partitions; without it, rows beyond ``MOST_PART_ROWS`` a core get further ones.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    top = min(cores, most) if most else max(cores, -(-n_rows // MOST_PART_ROWS))
    now, want = rows.rdd.getNumPartitions(), min(top, -(-n_rows // part_rows))
    return rows.repartition(max(1, want)) if now < want or now > top else rows


def with_totals(summary: DataFrame, **totals: Column) -> DataFrame:
    """Add grand totals of a grouped table to each of its rows.

    A window over the grouped rows, so the loans behind them are read once and nothing runs
    before the caller acts. The grouped table is one row per key; it must be small enough for one task.
    """
    return summary.withColumns({name: total.over(Window.partitionBy()) for name, total in totals.items()})


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000, written: bool = False) -> DataFrame:
    """Mark ``df`` for broadcast only after counting it; otherwise leave it to AQE.

    Meant for aggregates whose size depends on the data (one row per segment). Unless it has been already (``written``),
    the aggregate is written out first, so counting it does not run it twice.
    """
    fixed = df if written else cut_lineage(df)
    if fixed.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(fixed)
    return fixed
