"""A catalog that grows crawl by crawl: snapshot and delta merged by key, the first record wins.

A merge writes a new snapshot beside the old one and then one line in the table of versions, which switches
readers over.  Until that line the old snapshot is what everyone reads.  A merge that finds, after its
line, that another one took the same version first starts again from that one's snapshot, so no delta is lost.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.dedup import dedup_products

LINES = "version long, attempt string, written_us long"


def versions(spark: SparkSession, folder: str) -> dict[int, str]:
    """The attempt behind every version; of several lines for one version the first counts."""
    try:
        lines = spark.read.schema(LINES).parquet(f"{folder.rstrip('/')}/versions").collect()
    except Exception as problem:  # no version yet
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return {}
    found: dict[int, str] = {}
    for line in sorted(lines, key=lambda x: (x["written_us"], x["attempt"])):
        found.setdefault(line["version"], line["attempt"])
    return found


def read_snapshot(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """The newest snapshot or that of ``version``; None while there is none."""
    known = versions(spark, folder)
    if not known:
        return None
    return spark.read.parquet(f"{folder.rstrip('/')}/snapshots/{known[max(known) if version is None else version]}")


def merge_catalog(delta: DataFrame, folder: str, key: str | Sequence[str] = "name", order: Sequence[str] = ("page_id",),
                  within: Sequence[str] = ()) -> int:
    """Merge the records of a crawl into the catalog of ``folder``; the version that holds them.

    ``order`` is the crawl order over all crawls: a record of a later crawl that comes first in it replaces the known one, so crawls may be
    merged in any order, repeatedly, and in any pieces.  Columns of the delta beyond the catalog's are not taken over.
    """
    spark = delta.sparkSession
    first = dedup_products(delta, key, order, within)
    while True:
        known = versions(spark, folder)
        version = max(known, default=0) + 1
        current = read_snapshot(spark, folder, version - 1) if known else None
        merged = first if current is None else dedup_products(current.unionByName(first.select(*current.columns)), key, order, within)
        attempt = uuid.uuid4().hex
        merged.write.parquet(f"{folder.rstrip('/')}/snapshots/{attempt}")
        switch(spark, folder, version, attempt)
        if versions(spark, folder)[version] == attempt:
            return version


def switch(spark: SparkSession, folder: str, version: int, attempt: str) -> None:
    line = spark.createDataFrame([(version, attempt, time.time_ns() // 1000)], LINES)
    line.coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/versions")


def changes(spark: SparkSession, folder: str, key: Sequence[str], older: int, newer: int) -> DataFrame:
    """Keys that a version has over an older one, or with another record: (key columns, ``is_new``)."""
    before, after = read_snapshot(spark, folder, older), read_snapshot(spark, folder, newer)
    gone = after.exceptAll(before).select(*key)
    return gone.join(before.select(*key, F.lit(True).alias("_was")), [*key], "left").select(*key, F.col("_was").isNull().alias("is_new"))
