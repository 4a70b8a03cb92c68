"""Prices: structured data first, then the product area; or the lean whole-page rule."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V, schemas
from ..functions.numbers import money_text, to_number
from ..functions.text import contains_any, without


def price_from_jsonld() -> Column:
    """First price above zero in (script, item, offer, specification) order.

    ``from_json`` with an explicit schema tolerates what real shops write: a script that is
    no JSON gives nulls, a subtree of another shape gives null while its siblings survive.
    """
    scripts = F.transform(
        F.col("jsonld"),
        lambda script: F.from_json(script, schemas.JSONLD, {"allowSingleQuotes": "false"})["@graph"],
    )
    items = F.flatten(F.filter(scripts, lambda graph: graph.isNotNull()))
    products = F.filter(items, lambda item: (item["@type"] == "Product") & item["offers"].isNotNull())
    offers = F.flatten(F.transform(products, lambda item: item["offers"]))
    specifications = F.flatten(F.filter(
        F.transform(offers, lambda offer: offer["priceSpecification"]), lambda specs: specs.isNotNull()))
    prices = F.transform(specifications, lambda spec: to_number(spec["price"]))
    return F.get(F.filter(prices, lambda price: price > 0), F.lit(0))


def in_local_currency(text: Column) -> Column:
    return contains_any(text, V.CURRENCY_MARKS)


def price_from_area(above: float = V.AREA_PRICE_ABOVE) -> Column:
    """First plausible local-currency amount among the price hits inside the product area."""
    inside = F.filter(F.col("price"), lambda h: h["in_area"] & in_local_currency(h["text"]))
    amounts = F.transform(inside, lambda h: F.regexp_extract(
        without(h["text"], V.CURRENCY_MARKS + (",",)), r"[0-9]+(\.[0-9]+)?", 0).try_cast("double"))
    return F.get(F.filter(amounts, lambda amount: amount > above), F.lit(0))


def price_lean(limits: tuple[float, float] = V.LEAN_PRICE_RANGE) -> Column:
    """First amount within limits among the first price hits of each selector, whole page."""
    first_hits = F.filter(F.col("price"), lambda h: (h["ord"] <= V.LEAN_PRICES_PER_SELECTOR)
                          & in_local_currency(h["text"]))
    amounts = F.transform(first_hits, lambda h: F.regexp_extract(
        without(h["text"], (",",)), r"[0-9]+\.?[0-9]*", 0).try_cast("double"))
    return F.get(F.filter(amounts, lambda amount: amount.between(*limits)), F.lit(0))


def resolve_price() -> Column:
    return F.coalesce(price_from_jsonld(), price_from_area())


def price_columns(price: Column) -> dict[str, Column]:
    """Currency code and text, present only when there is a price."""
    return {
        "original_currency": F.when(price.isNotNull(), V.CURRENCY_CODE),
        "raw_price_text": F.when(price.isNotNull(), money_text(price)),
    }
