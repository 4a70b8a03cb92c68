"""Product fields as Catalyst expressions over the hit columns of ``parse_pages``.

Every function names the facts columns it reads and returns a column; hits arrive sorted
by selector rank and document order, so "the first that qualifies" is element 0 of a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from ..functions.text import clean_name, crumb_path


def first_text(field: str, longer_than: int = 0) -> Column:
    """Text of the first hit, in rank order, that is longer than ``longer_than``.

    The hit columns of single-value fields hold only the first hit per selector.
    """
    return F.get(F.filter(F.col(field), lambda h: F.length(h["text"]) > longer_than), F.lit(0))["text"]


def product_name(variant: str = "full") -> Column:
    found = first_text("name", V.MIN_NAME_LENGTH)
    return clean_name(found) if variant == "full" else F.left(found, F.lit(V.LEAN_NAME_LENGTH))


def product_description() -> Column:
    return F.left(first_text("description", V.MIN_DESCRIPTION_LENGTH), F.lit(V.DESCRIPTION_LENGTH))


def stock_status() -> Column:
    text = F.lower(F.get(F.col("stock"), F.lit(0))["text"])
    return (
        F.when(text.contains("in stock"), V.IN_STOCK)
        .when(text.contains("out of stock"), V.OUT_OF_STOCK)
    )


def category_path() -> Column:
    """All category hits in rank order, without the shop's own crumbs, first levels joined."""
    texts = F.transform(F.col("category"), lambda h: h["text"])
    return crumb_path(F.filter(
        texts, lambda text: (text != "") & ~F.lower(text).isin(*V.CRUMB_NOISE)))


def product_images() -> Column:
    """Per selector the first hit that has an address; up to one entry per selector, however many there are."""
    first = F.filter(F.col("image"), lambda h, k: (k == 0) | (F.get(F.col("image"), k - 1)["rank"] != h["rank"]))
    return F.filter(F.transform(first, lambda h: h["url"]), lambda url: url.isNotNull())


def primary_image(variant: str = "full") -> Column:
    if variant == "full":
        return F.get(product_images(), F.lit(0))
    return F.get(F.filter(F.col("image"), lambda h: h["ord"] == 1), F.lit(0))["url"]


def mentions(words: tuple[str, ...]) -> Column:
    """Whether the page text contains one of the watched words."""
    return F.arrays_overlap(F.col("words"), F.array(*[F.lit(w) for w in words]))


def text_flags() -> dict[str, Column]:
    return {"has_warranty": mentions(V.WARRANTY_WORDS), "has_shipping_info": mentions(V.SHIPPING_WORDS)}
