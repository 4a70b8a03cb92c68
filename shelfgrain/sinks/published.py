"""Runs that are published as a whole.

The sheets of a run are written to a folder of their own attempt, and one line in a table of published runs makes
them visible together.  A crash before that line leaves files that no reader sees and that block nobody; the
run is simply made again.  Of several attempts that were published under one name the first line counts.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

LINES = "run string, attempt string, published_us long, sheets array<string>"


def published_runs(spark: SparkSession, folder: str) -> dict[str, dict]:
    """The published runs of ``folder`` by name."""
    try:
        lines = spark.read.schema(LINES).parquet(f"{folder.rstrip('/')}/published").collect()
    except Exception as problem:  # nothing published yet
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return {}
    found: dict[str, dict] = {}
    for line in sorted(lines, key=lambda x: (x["published_us"], x["attempt"])):
        found.setdefault(line["run"], line.asDict())
    return found


def write_attempt(sheets: Mapping[str, DataFrame], folder: str) -> str:
    """Write all sheets of a run, unseen; the name of the attempt."""
    attempt = uuid.uuid4().hex
    for name, rows in sheets.items():
        rows.write.parquet(f"{folder.rstrip('/')}/attempts/{attempt}/{name}")
    return attempt


def publish(spark: SparkSession, folder: str, run: str, attempt: str, sheets: Mapping[str, DataFrame]) -> None:
    line = (run, attempt, time.time_ns() // 1000, sorted(sheets))
    spark.createDataFrame([line], LINES).coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/published")


def publish_run(sheets: Mapping[str, DataFrame], folder: str, run: str) -> None:
    """Write the sheets and publish them under ``run``; a published run is never replaced."""
    spark = next(iter(sheets.values())).sparkSession
    if run in published_runs(spark, folder):
        raise FileExistsError(f"run {run} is published already")
    publish(spark, folder, run, write_attempt(sheets, folder), sheets)


def read_run(spark: SparkSession, folder: str, run: str) -> dict[str, DataFrame]:
    """All sheets of a published run by name; a run that is not published is not there."""
    line = published_runs(spark, folder).get(run)
    if line is None:
        raise FileNotFoundError(f"no published run {run} in {folder}")
    root = f"{folder.rstrip('/')}/attempts/{line['attempt']}"
    return {name: spark.read.parquet(f"{root}/{name}") for name in line["sheets"]}
