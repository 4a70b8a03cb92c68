"""Pages or page facts to product records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from . import fields as P
from .parse import FULL_FIELDS, LEAN_FIELDS, parse_pages, valid_page
from .price import price_columns, price_lean, resolve_price


# What each column of a full record is made of, beyond the page itself.
MADE_OF = {
    "name": ("name",), "price_kes": ("price", "jsonld"), "original_currency": ("price", "jsonld"),
    "raw_price_text": ("price", "jsonld"), "sku": ("sku",), "brand": ("brand",), "category": ("category",),
    "description": ("description",), "stock_status": ("stock",), "images": ("image",), "primary_image": ("image",),
    "has_warranty": ("words",), "has_shipping_info": ("words",),
}


def named_only(products: DataFrame) -> DataFrame:
    return products.filter(F.col("name").isNotNull() & (F.col("name") != ""))


def extract_products(
    pages: DataFrame,
    variant: str = "full",
    run_ts: Column | None = None,
    images: bool = True,
    descriptions: bool = True,
    selectors: dict[str, tuple[str, ...]] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Product records of all pages that hold one; row-wise, so it also runs on a stream.

    ``variant`` is ``full`` or ``lean``.  ``scraped_at`` is ``run_ts``, else the page's own
    ``fetched_at``, else null - never the wall clock, so that results repeat.  Switched-off
    images or descriptions are not even parsed for.  ``columns`` names the columns of a full
    record that are wanted besides ``source_url``, ``scraped_at`` and ``name``; only what they
    are made of is parsed for.  Columns of ``pages`` beyond ``url`` and
    ``html`` (ids, page numbers, bases) are kept for ordering and joining.
    """
    if variant == "lean":
        wanted = LEAN_FIELDS
    else:
        off = ({"image"} if not images else set()) | ({"description"} if not descriptions else set())
        if columns is not None:
            unknown = set(columns) - set(MADE_OF)
            if unknown:
                raise ValueError(f"unknown columns: {sorted(unknown)}")
            off |= set(FULL_FIELDS) - {"name"} - {f for c in columns for f in MADE_OF[c]}
        wanted = tuple(f for f in FULL_FIELDS if f not in off)
    facts = parse_pages(pages, wanted, selectors, min_text=V.MIN_PAGE_TEXT, whole_prices=False).filter(valid_page())
    carried = [c for c in pages.columns if c not in ("url", "html")]
    return products_from_facts(facts, carried, variant, run_ts, columns)


def products_from_facts(
    facts: DataFrame, carried: list[str], variant: str = "full", run_ts: Column | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Product records from the facts of valid pages."""
    if run_ts is None:
        run_ts = F.col("fetched_at") if "fetched_at" in facts.columns else F.lit(None)
    base = [*carried, F.col("url").alias("source_url"), run_ts.cast("timestamp").alias("scraped_at")]
    if variant == "lean":
        priced = facts.select(
            *base,
            P.product_name("lean").alias("name"),
            price_lean().alias("price_kes"),
            P.primary_image("lean").alias("primary_image"),
        )
        return named_only(priced).withColumn(
            "original_currency", price_columns(F.col("price_kes"))["original_currency"])

    has = set(facts.columns)
    made = {
        "name": P.product_name,
        "price_kes": resolve_price,
        "sku": lambda: P.first_text("sku"),
        "brand": lambda: P.first_text("brand"),
        "category": P.category_path,
        "description": lambda: P.product_description() if "description" in has else F.lit(None).cast("string"),
        "stock_status": P.stock_status,
        "images": lambda: P.product_images() if "image" in has else F.array().cast("array<string>"),
        **{name: lambda flag=flag: flag for name, flag in (P.text_flags() if "words" in has else {}).items()},
    }
    wanted = [c for c in MADE_OF if columns is None or c == "name" or c in columns]
    sources = {"original_currency": "price_kes", "raw_price_text": "price_kes", "primary_image": "images"}
    needed = {sources.get(c, c) for c in wanted}
    found = facts.select(*base, *[column().alias(name) for name, column in made.items() if name in needed])
    price = price_columns(F.col("price_kes"))
    derived = {**{c: price[c] for c in ("original_currency", "raw_price_text")}, "primary_image": F.get("images", F.lit(0))}
    return named_only(found).select(
        *carried, "source_url", "scraped_at", *[derived[c].alias(c) if c in derived else F.col(c) for c in wanted])
