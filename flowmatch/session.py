"""Session set-up and the few physical-planning helpers the operators share."""

from __future__ import annotations

import os
import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def get_spark(app: str = "flowmatch", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build or reuse a session with AQE, skew-join splitting and UTC time.

    On a cluster the master, memory, shuffle partitions and
    ``spark.checkpoint.dir`` come from the submit configuration: a setting
    that the session already has is never overridden.  ``shuffle_partitions``
    (or FLOWMATCH_SHUFFLE_PARTITIONS) fills an unset one; local sessions
    without either get one for each core.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            b = b.config("spark.driver.memory", os.environ.get("FLOWMATCH_DRIVER_MEMORY", "16g"))
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          # checkpoints that no plan refers to any more are deleted
          .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    parts = shuffle_partitions or os.environ.get("FLOWMATCH_SHUFFLE_PARTITIONS")
    if not parts and is_local(spark):
        parts = spark.sparkContext.defaultParallelism
    fill = {"spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.coalescePartitions.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.execution.arrow.pyspark.enabled": "true"}
    if parts:
        fill["spark.sql.shuffle.partitions"] = str(parts)
    for key, value in fill.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    if is_local(spark) or spark.conf.get("spark.checkpoint.dir", None):
        checkpoint_dir(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine."""
    m = spark.sparkContext.master
    return m == "local" or m.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder in that setting and it is used as is; a
    cluster that names none is an error, as its executors would not see a
    folder of the driver.  Local sessions get a fresh scratch folder.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir()
    if hasattr(d, "isDefined"):
        d = d.get() if d.isDefined() else None
    if not d:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="flowmatch-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return d


def bounded_broadcast(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Broadcast ``df`` only where Spark's own size estimate of its plan is at
    most ``max_bytes`` (default: ``spark.sql.autoBroadcastJoinThreshold``);
    otherwise return it.  No job is run: beyond the estimate the join starts
    as a shuffle join, and AQE still broadcasts a side that turns out small.
    """
    if max_bytes is None:
        limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        max_bytes = int(limit)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= max_bytes else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread rows before CPU-heavy per-row work (parsing, n-grams) when
    the input has fewer partitions than the cluster has task slots.

    A small table stored as one row group scans as a single task; on large
    inputs (many splits) this is a no-op and adds no shuffle."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *keys) if keys else df.repartition(slots)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by the keys before each of them grows into many (lines, tokens).

    However small a table, a row group of it is one task's: the splits of its
    scan don't tell how its rows lie.  The number of partitions is fixed, as
    the bytes of the rows dealt don't tell what they grow to."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def counted_broadcast(df: DataFrame, max_rows: int = 1 << 17) -> DataFrame:
    """Broadcast ``df``, which must be cheap to read twice (``cut_lineage``), if
    it has no more rows than that; otherwise return it.

    For a side of few keys that many rows share: its size estimate after joins
    and aggregates is too high for ``bounded_broadcast``, and adaptive execution
    leaves a side alone that fills few of the shuffle partitions."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ship_by_value(*modules: str) -> None:
    """Have task functions of these modules of this package sent by value."""
    for name in modules:
        if name.startswith("flowmatch") and name in sys.modules:
            cloudpickle.register_pickle_by_value(sys.modules[name])
