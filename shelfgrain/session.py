"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Settings that may be changed on a running session.  HTML cells can be megabytes, so
# Arrow batches are kept short; scan splits are kept small because parsing is CPU-bound.
# Joins are broadcast on measured sizes only: the planner's guess from file sizes is
# switched off (it knows nothing about the output of a parse or an explode), adaptive
# execution may still choose a broadcast once a shuffle has shown how small a side is.
# Per-group limits of any usual size are cut in every task before the shuffle.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
    "spark.sql.files.maxPartitionBytes": "64m",
}

_shipped: set[str] = set()  # applications whose workers have the package
_own_folders: dict[str, str] = {}  # by application, for sessions without a named folder


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators count on to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  **options: str) -> SparkSession:
    builder = SparkSession.builder.appName("shelfgrain")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in options.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Parsing runs on the executors, which need not have the package installed and do not
    share the driver's folder.  The archive is only read by the driver, which serves it.
    """
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="shelfgrain-package-"), "shelfgrain")
        spark.sparkContext.addPyFile(shutil.make_archive(
            target, "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped.add(application)


def work_folder(spark: SparkSession) -> str:
    """The shared folder for staged tables and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a local
    session gets a temporary folder and any other one a folder in the warehouse, if that is
    in a shared store: on a machine-local folder every executor would write to a disk of its own.
    """
    application = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own_folders.get(application)
    if not folder:
        if spark.sparkContext.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="shelfgrain-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shelfgrain_work"
            if folder.startswith(("file:", "/")):
                raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        folder = _own_folders.setdefault(application, folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it back.

    A written table rather than ``checkpoint()``: it is compressed, and later readers
    fetch only the columns they use.
    """
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)  # one file per task: callers merge narrow results first, see ``gathered``
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """Narrow rows made by a wide scan, merged into files of a usual size before they are staged."""
    return df.hint("rebalance")


BROADCAST_ROWS = 500_000  # rows of a few short columns: some tens of MB in memory


def fits(df: DataFrame, limit: int | None = None) -> bool:
    """Whether ``df``, of a few short columns, has few enough rows to be broadcast."""
    return df.count() <= (BROADCAST_ROWS if limit is None else limit)


def sized(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Hint how to join a side of narrow rows, from its counted size.

    Spark's own estimate misses rows made by ``explode`` and overrates aggregates, and a
    wide table is shuffled before adaptive execution could notice.  So the side is counted:
    up to ``limit`` rows it is broadcast, beyond that it is merged on the key.
    """
    return F.broadcast(df) if fits(df, limit) else df.hint("merge")


def sized_stage(df: DataFrame, label: str, limit: int | None = None) -> DataFrame:
    """``sized`` for a side that is costly to compute: it is staged, then counted."""
    return sized(stage(df, label), limit)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small scan enough tasks for CPU-bound work; leave a large one alone.

    ``df`` must be a plain scan or projection: its partition count is then known from
    planning, without running anything.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)
