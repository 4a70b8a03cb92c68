"""Catalog figures, each from one aggregation pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.numbers import fmt2


def catalog_summary(products: DataFrame, order: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row: counts, price figures over priced products, and the first product's URL."""
    price = F.col("price_kes")
    priced = F.when(price > 0, price)
    return products.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count(priced).alias("with_price"),
        F.count_if(F.length("sku") > 0).alias("with_sku"),
        F.count_if(F.length("brand") > 0).alias("with_brand"),
        F.count_if(F.size("images") > 0).alias("with_images"),
        F.avg(priced).alias("mean_price"),
        F.max(priced).alias("max_price"),
        F.min(priced).alias("min_price"),
        F.min_by("source_url", F.struct(*order)).alias("source_site"),
    )


def summary_state(products: DataFrame, by: Sequence[str], order: Sequence[str] = ("page_id",)) -> DataFrame:
    """What summary and completeness need of the products of each run or slice ``by``; one narrow row that can be merged.

    Stored per run, it answers for any set of runs without reading products again.
    """
    price = F.col("price_kes")
    priced = F.when(price > 0, price)
    return products.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count(priced).alias("with_price"),
        F.count_if(F.length("sku") > 0).alias("with_sku"),
        F.count_if(F.length("brand") > 0).alias("with_brand"),
        F.count_if(F.size("images") > 0).alias("with_images"),
        F.count_if(F.length("name") > 0).alias("with_name"),
        F.count_if(F.length("primary_image") > 0).alias("with_primary_image"),
        F.sum(priced).alias("price_sum"), F.max(priced).alias("max_price"), F.min(priced).alias("min_price"),
        F.min(F.struct(*order, "source_url")).alias("first_record"),
    )


COUNTS = ("total_products", "with_price", "with_sku", "with_brand", "with_images", "with_name", "with_primary_image")


def merged_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of slices merged into one per ``by``, or into a single one (zeros if there are none)."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]
    rest = [F.sum("price_sum").alias("price_sum"), F.max("max_price").alias("max_price"), F.min("min_price").alias("min_price"),
            F.min("first_record").alias("first_record")]
    return states.groupBy(*by).agg(*sums, *rest)


def summary_of_states(states: DataFrame) -> DataFrame:
    """``catalog_summary`` of all products behind the states."""
    return merged_states(states).select(
        *COUNTS[:5], F.try_divide("price_sum", "with_price").alias("mean_price"), "max_price", "min_price",
        F.col("first_record.source_url").alias("source_site"))


def completeness_of_states(states: DataFrame) -> DataFrame:
    """``completeness`` of all products behind the states."""
    share = lambda name: F.try_divide(F.col(name), F.col("total_products"))
    return merged_states(states).select(
        F.col("total_products").alias("products"), share("with_name").alias("name_share"),
        share("with_price").alias("price_share"), share("with_primary_image").alias("image_share"))


def summary_long(summary: DataFrame, run_stamp: Column) -> DataFrame:
    """The summary sheet: ``metric`` and ``value`` rows in sheet order."""
    shown = lambda name: F.coalesce(fmt2(F.col(name)), F.lit("0"))
    counts = [F.col(c).cast("string") for c in
              ("total_products", "with_price", "with_sku", "with_brand", "with_images")]
    values = [*counts, shown("mean_price"), shown("max_price"), shown("min_price"),
              run_stamp, F.coalesce("source_site", F.lit(""))]
    rows = F.array(*[
        F.struct(F.lit(place).alias("place"), F.lit(metric).alias("metric"), value.alias("value"))
        for place, (metric, value) in enumerate(zip(V.SUMMARY_METRICS, values), 1)])
    return summary.select(F.inline(rows))


def completeness(products: DataFrame) -> DataFrame:
    """Share of records with a name, a price and an image."""
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    return products.agg(
        F.count(F.lit(1)).alias("products"),
        share(F.length("name") > 0).alias("name_share"),
        share(F.col("price_kes") > 0).alias("price_share"),
        share(F.length("primary_image") > 0).alias("image_share"),
    )


def coverage(products: DataFrame, listed: DataFrame) -> DataFrame:
    """Products found out of products listed, in percent; null when nothing is listed."""
    marks = products.select(F.lit(1).alias("found"), F.lit(0).alias("listed")).unionAll(
        listed.select(F.lit(0), F.lit(1)))
    totals = marks.agg(
        F.coalesce(F.sum("found"), F.lit(0)).alias("found"),
        F.coalesce(F.sum("listed"), F.lit(0)).alias("listed"))
    return totals.select(
        "found", "listed", (F.try_divide(F.col("found"), F.col("listed")) * 100).alias("coverage_pct"))
