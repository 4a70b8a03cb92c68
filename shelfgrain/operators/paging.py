"""Page yields of a listing walk: counts, stop rule, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .. import fixed_values as V
from ..session import sized_stage


def page_yield(products: DataFrame, frontier: DataFrame) -> DataFrame:
    """Products per listing page; pages without any appear with 0."""
    counts = products.groupBy("base_url", "page_no").agg(F.count(F.lit(1)).alias("found"))
    return (
        frontier.select("base_url", "page_no")
        .join(counts, ["base_url", "page_no"], "left")
        .select("base_url", "page_no", F.coalesce("found", F.lit(0)).alias("found"))
    )


def last_page(yields: DataFrame, empty_pages: int = V.EMPTY_PAGES_TO_STOP) -> DataFrame:
    """Per base the page at which the walk stops: the last of the first run of empty pages.

    Page numbers are gapless, so a run of n empty pages ends at page p exactly if p-n+1..p
    are all empty.  Each empty page votes for the n pages it may be part of a run for, and
    the votes are counted: plain aggregations, no window over a base.
    """
    votes = yields.filter(F.col("found") == 0).select(
        "base_url", F.explode(F.sequence(F.col("page_no"), F.col("page_no") + empty_pages - 1)).alias("page_no"))
    runs = votes.groupBy("base_url", "page_no").agg(F.count(F.lit(1)).alias("_n"))
    return (
        runs.filter(F.col("_n") == empty_pages)
        .groupBy("base_url").agg(F.min("page_no").alias("last_page"))
    )


def stop_after_empty(
    rows: DataFrame, yields: DataFrame, empty_pages: int = V.EMPTY_PAGES_TO_STOP
) -> DataFrame:
    """Rows (of any table with ``base_url`` and ``page_no``) up to the page the walk stops at.

    One base may own most rows, so the table of last pages (a row per base) is sized first
    and the rows stay where they are if it is small.
    """
    last = sized_stage(last_page(yields, empty_pages), "last-pages")
    return (
        rows.join(last, "base_url", "left")
        .filter(F.col("last_page").isNull() | (F.col("page_no") <= F.col("last_page")))
        .select(*rows.columns)
    )


def progress(yields: DataFrame, every: int = V.REPORT_EVERY) -> DataFrame:
    """A report row per ``every`` pages with the running total.

    The report is made after the page counter moved on, so the row labelled 10 holds the
    total through page 9.  Pages are summed into stretches of ``every`` pages first; the
    running total then covers one row per stretch.
    """
    stretch = F.floor(F.col("page_no") / every).cast("int")
    sums = yields.groupBy("base_url", stretch.alias("_stretch")).agg(
        F.sum("found").alias("_sum"), F.max("page_no").alias("_last"))
    running = F.sum("_sum").over(
        Window.partitionBy("base_url").orderBy("_stretch")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    label = (F.col("_stretch") + 1) * every
    return (
        sums.withColumn("total_products", running)
        .filter(F.col("_last") == label - 1)
        .select("base_url", label.alias("page_label"), "total_products")
    )
