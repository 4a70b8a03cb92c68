"""Catalog sheets as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.dates import stamp_text
from ..functions.text import ellipsize, spec_text


def filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def catalog_export(products: DataFrame, optional: bool = False) -> DataFrame:
    """The product sheet: fixed columns, defaults filled in.

    ``products`` needs ``product_id`` (see ``with_product_id``).  With ``optional``, yen
    price, exchange rate and specifications are added where the input has them.
    """
    columns = [
        F.col("product_id"),
        filled("name").alias("product_name"),
        F.coalesce("price_kes", F.lit(0.0)).alias("price_kes"),
        filled("original_currency").alias("original_currency"),
        filled("sku").alias("sku"),
        filled("brand").alias("brand"),
        filled("category").alias("category"),
        filled("stock_status").alias("stock_status"),
        ellipsize(filled("description"), V.EXPORT_DESCRIPTION_LENGTH).alias("description"),
        filled("primary_image").alias("primary_image_url"),
        F.size(F.coalesce("images", F.array().cast("array<string>"))).alias("total_images"),
        filled("source_url").alias("source_url"),
        stamp_text(F.coalesce("scraped_at", F.timestamp_seconds(F.lit(0)))).alias("scraped_date"),
        F.coalesce("has_warranty", F.lit(False)).alias("has_warranty"),
        F.coalesce("has_shipping_info", F.lit(False)).alias("has_shipping_info"),
    ]
    if optional and "price_jpy" in products.columns:
        yen = F.col("price_jpy").isNotNull() & (F.col("price_jpy") != 0)
        rate = F.col("exchange_rate") if "exchange_rate" in products.columns else F.lit(None).cast("double")
        columns.append(F.when(yen, F.col("price_jpy")).alias("price_jpy"))
        columns.append(F.when(yen, F.coalesce(rate, F.lit(0.0))).alias("exchange_rate_used"))
    if optional and "specifications" in products.columns:
        specs = F.col("specifications")
        columns.append(F.when(F.size(specs) > 0, spec_text(specs)).alias("specifications"))
    return products.select(*columns)


def catalog_short(products: DataFrame) -> DataFrame:
    """The short catalog: nine columns with data-quality flags."""
    return products.select(
        F.col("product_id").alias("id"),
        F.col("name").alias("product_name"),
        F.col("price_kes"),
        F.col("original_currency").alias("currency"),
        F.col("source_url"),
        F.col("primary_image"),
        stamp_text(F.col("scraped_at")).alias("scraped_at"),
        F.col("price_kes").isNotNull().alias("has_price"),
        F.col("primary_image").isNotNull().alias("has_image"),
    )
