"""The catalog as a stream: newly landed pages, first records, live figures."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.products import extract_products
from ..session import work_path

POLL_S = 0.5   # between two looks at the reports of a running stream


def stream_products(pages: DataFrame, variant: str = "full", run_ts: Column | None = None, **options) -> DataFrame:
    """Product records of pages as they land; the batch extraction is row-wise and is reused, with its options."""
    return extract_products(pages, variant, run_ts, **options)


def stream_dedup(records: DataFrame, key: str | Sequence[str], event_time: str, delay: str) -> DataFrame:
    """The first record to arrive per key.

    Keys are forgotten ``delay`` after their event time, which bounds the state; a key that
    returns later than that is let through again.  A record that arrives more than ``delay`` after
    younger ones were seen is dropped by the watermark: choose a delay beyond the disorder of
    the source.  ``run_to_table`` raises if that happened.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return (
        records.withColumn(event_time, F.col(event_time).cast("timestamp"))
        .withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark(keys)
    )


def stream_stats(log: DataFrame, width: str) -> DataFrame:
    """Requests, exceptions and mean response time per tumbling window.

    For ``run_updates``: a window is put out whenever it changes, so every request counts, however
    late it comes and however the files are batched.  The state is one row per window of
    the log, not per request, so it needs no watermark.
    """
    return (
        log.withColumn("ts", F.col("ts").cast("timestamp"))
        .groupBy(F.window("ts", width))
        .agg(
            F.count_if(F.col("error").isNull()).alias("requests"),
            F.count_if(F.col("error").isNotNull()).alias("errors"),
            F.avg("elapsed_s").alias("mean_response"),
        )
        .select(F.col("window.start").alias("window_start"), "requests", "errors", "mean_response")
    )


def late_rows(query: StreamingQuery, seen: dict[int, int]) -> None:
    """Note in ``seen`` how many rows the watermark has dropped in each batch with state that the query still reports."""
    for report in query.recentProgress:
        if report["stateOperators"]:
            dropped = sum(state.get("numRowsDroppedByWatermark", 0) for state in report["stateOperators"])
            seen[report["batchId"]] = max(dropped, seen.get(report["batchId"], 0))


def _drain(query: StreamingQuery, label: str, timeout_s: float | None) -> dict[int, int]:
    """Wait for the end; rows dropped by the watermark in each batch.

    A query reports its last batches only (100 unless set otherwise), so it is asked over and over.
    """
    seen: dict[int, int] = {}
    end = None if timeout_s is None else time.monotonic() + timeout_s
    while True:
        left = POLL_S if end is None else min(POLL_S, end - time.monotonic())
        done = left > 0 and query.awaitTermination(left)
        late_rows(query, seen)
        if done:
            return seen
        if end is not None and time.monotonic() >= end:
            query.stop()
            raise TimeoutError(f"stream {label} did not finish within {timeout_s} s")


def run_to_table(stream: DataFrame, label: str, timeout_s: float | None = None) -> DataFrame:
    """Run a stream over all that has landed, append to a table, return that table.

    There is no time limit unless one is given.  Raises if rows came too late for the watermark.
    """
    spark = stream.sparkSession
    target, state = work_path(spark, label), work_path(spark, f"{label}-state")
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", state).option("path", target)
        .trigger(availableNow=True).start()
    )
    seen = _drain(query, label, timeout_s)
    if late := sum(seen.values()):
        raise ValueError(f"stream {label}: {late} rows came later than the delay allows and were dropped")
    if seen and len(seen) <= max(seen):   # batches are numbered from 0
        raise ValueError(f"stream {label}: {max(seen) + 1 - len(seen)} batches went by unseen, so rows may have been dropped")
    return spark.read.schema(stream.schema).parquet(target)


def run_updates(stream: DataFrame, key: str | Sequence[str], label: str, timeout_s: float | None = None) -> DataFrame:
    """Run an updating stream over all that has landed; the last state of every ``key``.

    Each batch writes the rows it changed; the newest batch of a key holds.  Nothing landed gives an empty table.
    """
    spark = stream.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    target, state = work_path(spark, label), work_path(spark, f"{label}-state")
    written: list[int] = []

    def write(rows: DataFrame, batch: int) -> None:  # a repeated batch replaces itself
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{target}/batch={batch}")
        written.append(batch)

    query = (
        stream.writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    _drain(query, label, timeout_s)
    if not written:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])).parquet(target)
    columns = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_batch").alias("_row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in stream.columns])
