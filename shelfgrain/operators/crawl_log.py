"""Reports over the crawl log.

The log holds one row per request: ``run_id host id ts phase url status error elapsed_s``.
One host may own a large part of it, so nothing here windows over a whole host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..session import sized_stage, stage
from .joins import lookup_join
from .numbering import with_position

BLOCK_ROWS = 1_000_000


def succeeded() -> Column:
    return (F.col("status") == 200) & F.col("error").isNull()


def blocked(log: DataFrame, block_rows: int) -> DataFrame:
    """The log in blocks of ``block_rows`` by (host, ts, id), each with copies of the 49 rows before it."""
    width = V.ROLLING_RESPONSES - 1
    if block_rows < width:
        raise ValueError(f"a block must hold at least {width} rows")
    place = F.col("_position") - 1
    block = F.floor(place / block_rows)
    near_end = place % block_rows >= block_rows - width
    return (
        with_position(log, ["host", "ts", "id"], "_position")
        .withColumn("_own", block)
        .withColumn("_block", F.explode(
            F.when(near_end, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
        .withColumn("_copy", F.col("_block") != F.col("_own"))
    )


def with_means(placed: DataFrame) -> DataFrame:
    """Mean of the host's last 50 responses in ``mean_response``, from the 10th on."""
    frame = Window.partitionBy("host", "_block").orderBy("_position").rowsBetween(-(V.ROLLING_RESPONSES - 1), 0)
    return placed.withColumn("mean_response", F.when(
        F.count(F.lit(1)).over(frame) >= V.MIN_RESPONSES, F.avg("elapsed_s").over(frame)))


def crawl_health(log: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rolling response time, error pressure and health signal of every request.

    * ``mean_response``: mean of the host's last 50 responses, from the 10th on.
    * ``error_pressure``: a counter per host, +1 per failure, -1 per success, never below 0.
      With S the running sum of the steps that is S - min(0, running min of S).
    * ``signal``: -3 failing under pressure, +2 fast and calm, -1 slow, else 0.

    Rows are numbered by (host, ts, id) and cut into blocks of ``block_rows``.  A block also
    gets copies of the 49 rows before it, so each rolling frame is whole; the counter needs
    only two figures per host and earlier block, which a small table carries over.
    """
    step = F.when(F.col("_copy"), 0).when(succeeded(), -1).otherwise(1)
    in_block = Window.partitionBy("host", "_block").orderBy("_position")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, 0)
    placed = blocked(log, block_rows)
    rolled = stage(
        with_means(placed)
        .withColumn("_sum", F.sum(step).over(so_far))
        .withColumn("_low", F.min("_sum").over(so_far))
        .filter(~F.col("_copy")).drop("_copy", "_own"), "rolled-log")

    # One row per host and block; a host as large as the whole log has rows / block_rows.
    blocks = rolled.groupBy("host", "_block").agg(
        F.max_by("_sum", "_position").alias("_total"), F.min("_low").alias("_lowest"))
    earlier = Window.partitionBy("host").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocks
        .withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .withColumn("_floor", F.coalesce(
            F.min(F.col("_before") + F.col("_lowest")).over(earlier), F.lit(0)))
        .select(F.col("host").alias("_host"), F.col("_block").alias("_of"), "_before", "_floor")
    )
    same_block = F.col("host").eqNullSafe(F.col("_host")) & (F.col("_block") == F.col("_of"))
    lowest = F.least(F.lit(0), F.col("_floor"), F.col("_before") + F.col("_low"))
    return (
        rolled.join(sized_stage(carried, "block-sums"), same_block)
        .withColumn("error_pressure", F.col("_before") + F.col("_sum") - lowest)
        .withColumn("signal", _signal())
        .select(*log.columns, "mean_response", "error_pressure", "signal")
    )


def _signal() -> Column:
    mean, pressure = F.col("mean_response"), F.col("error_pressure")
    return (
        F.when(~succeeded(), F.when(pressure > V.TOLERATED_ERRORS, -3).otherwise(0))
        .when((mean < V.FAST_MEAN) & (pressure == 0), 2)
        .when(mean > V.SLOW_MEAN, -1)
        .otherwise(0)
    )


def rolling_response(log: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The mean alone: one window, no counter."""
    narrow = log.select("host", "ts", "id", "elapsed_s")
    return with_means(blocked(narrow, block_rows)).filter(~F.col("_copy")).select("host", "id", "mean_response")


def error_pressure(log: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return crawl_health(log, block_rows).select("host", "id", "error_pressure")


def health_signal(log: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return crawl_health(log, block_rows).select("host", "id", "signal")


def within_budget(log: DataFrame, seconds: float, share: float | None = None) -> DataFrame:
    """Log rows inside the time budget of their run.

    Without ``share`` a row counts if it starts within ``seconds`` of the run's first row.
    With ``share`` the limit is that part of the budget and is checked after each row: the
    first row beyond it is still kept.  Rows are ordered by (ts, id) within a run; the first
    row beyond the limit is an aggregate, so no window has to hold a whole run.
    """
    limit = seconds if share is None else seconds * share
    starts = stage(log.groupBy("run_id").agg(
        F.min("ts").alias("_start"), F.count(F.lit(1)).alias("_rows")), "run-starts")
    counts = starts.select("run_id", "_rows")
    timed = lookup_join(log, starts.drop("_rows"), counts, "run_id").withColumn("_elapsed", _seconds("ts") - _seconds("_start"))
    inside = F.col("_elapsed") <= limit
    if share is not None:
        crossing = timed.filter(~inside).groupBy("run_id").agg(
            F.min(F.struct("ts", "id")).alias("_crossing"))
        timed = lookup_join(timed, stage(crossing, "run-crossings"), counts, "run_id", "left")
        inside = inside | (F.struct("ts", "id") == F.col("_crossing"))
    return timed.filter(inside).select(*log.columns)


def _seconds(name: str) -> Column:
    return F.unix_micros(F.col(name)) / 1_000_000


def product_pages(log: DataFrame) -> DataFrame:
    """The distinct product pages that each run has fetched: (run_id, url)."""
    return log.filter(succeeded() & (F.col("phase") == "product")).select("run_id", "url").distinct()


def run_stats(log: DataFrame, products: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Per run: pages, products, requests that got a response, errors, duration, and rates.

    ``products`` (needs ``run_id``) has a row per product found.  ``errors`` counts exceptions
    and the rows of ``failures`` (needs ``run_id``), pages that could not be parsed; a response
    other than 200 is no error here but is no page either.  The duration behind the product
    rate is at least a millisecond.
    """
    stats = log.groupBy("run_id").agg(
        F.count_if(succeeded()).alias("pages_processed"),
        F.count_if(F.col("error").isNull()).alias("network_requests"),
        F.count_if(F.col("error").isNotNull()).alias("_exceptions"),
        F.count(F.lit(1)).alias("attempts"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1_000_000).alias("duration_s"),
    )
    counts = products.groupBy("run_id").agg(F.count(F.lit(1)).alias("_found"))
    stats = stats.join(counts, "run_id", "left").withColumn("errors", F.col("_exceptions"))
    if failures is not None:
        failed = failures.groupBy("run_id").agg(F.count(F.lit(1)).alias("_failed"))
        stats = stats.join(failed, "run_id", "left").withColumn(
            "errors", F.col("_exceptions") + F.coalesce("_failed", F.lit(0)))
    found = F.coalesce("_found", F.lit(0))
    return stats.select(
        "run_id", "pages_processed", found.alias("products_found"), "network_requests", "errors",
        "duration_s",
        (found / F.greatest("duration_s", F.lit(0.001))).alias("products_per_second"),
        (F.try_divide("pages_processed", "attempts") * 100).alias("success_pct"),
        (F.try_divide("errors", "attempts") * 100).alias("error_pct"),
    )


def run_verdict(stats: DataFrame) -> DataFrame:
    """Rate tier and time-target verdict of each run."""
    top, middle = V.RATE_TIERS
    rate = F.col("products_per_second")
    return stats.select(
        "run_id",
        F.when(rate > top, "top").when(rate > middle, "middle").otherwise("below").alias("rate_tier"),
        (F.col("duration_s") < V.DURATION_TARGET).alias("time_target_met"),
    )
