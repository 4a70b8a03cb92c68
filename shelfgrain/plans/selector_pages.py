"""One page per selector: markup that only this selector, or one that contains it, has to find.

Pages are dealt to the parts table by key, so that every selector meets many pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..operators.parse import parse_pages

LINK, TEXT, IMAGE = '<a href="/product/{v}">x</a>', "value {v}", '<img src="/i/{v}.jpg">'
PRICE = "KSh {v}"

# Markup by field and selector; {v} is the value to be found.
MARKUP: dict[str, dict[str, str]] = {
    "link": {
        'a[href*="/product/"]': LINK,
        ".product-item a[href]": f'<div class="product-item"><p>{LINK}</p></div>',
        ".product a[href]": f'<ul><li class="first product">{LINK}</li></ul>',
        ".woocommerce-loop-product__link[href]": '<a class="woocommerce-loop-product__link" href="/product/{v}">x</a>',
        "h2 a[href]": f"<h2><span>{LINK}</span></h2>",
        "h3 a[href]": f"<h3>{LINK}</h3>",
    },
    "name": {
        "h1.entry-title": f'<h1 class="big entry-title">{TEXT}</h1>',
        "h1.product_title": f'<h1 class="product_title">{TEXT}</h1>',
        "h1.product-title": f'<h1 class="product-title">{TEXT}</h1>',
        ".product_title": f'<p class="product_title">{TEXT}</p>',
        ".entry-title": f'<h2 class="entry-title">{TEXT}</h2>',
        "h1": f"<h1>{TEXT}</h1>",
    },
    "price": {
        ".woocommerce-Price-amount bdi": f'<span class="woocommerce-Price-amount"><bdi>{PRICE}</bdi></span>',
        ".woocommerce-Price-amount": f'<span class="woocommerce-Price-amount">{PRICE}</span>',
        ".price .amount": f'<p class="price"><span class="amount">{PRICE}</span></p>',
        ".price bdi": f'<p class="price"><bdi>{PRICE}</bdi></p>',
        ".price": f'<p class="price">{PRICE}</p>',
    },
    "area": {
        ".single-product-wrapper": f'<div class="single-product-wrapper"><p class="price">{PRICE}</p></div>',
        ".product-detail": f'<section class="product-detail"><p class="price">{PRICE}</p></section>',
        ".entry-summary": f'<div class="entry-summary"><p class="price">{PRICE}</p></div>',
        ".summary": f'<div class="summary"><p class="price">{PRICE}</p></div>',
    },
    "sku": {
        ".sku": f'<span class="sku">{TEXT}</span>',
        ".product_meta .sku": f'<div class="product_meta"><i><span class="sku">{TEXT}</span></i></div>',
        "[data-sku]": f'<p data-sku="1">{TEXT}</p>',
    },
    "brand": {
        ".brand": f'<span class="brand">{TEXT}</span>',
        ".product_meta .brand": f'<div class="product_meta"><span class="brand">{TEXT}</span></div>',
        "[data-brand]": f'<p data-brand="1">{TEXT}</p>',
    },
    "category": {
        ".product_meta .posted_in a": f'<div class="product_meta"><span class="posted_in"><a href="/c">{TEXT}</a></span></div>',
        ".breadcrumb a": f'<nav class="breadcrumb"><a href="/c">{TEXT}</a></nav>',
        ".category a": f'<div class="category"><b><a href="/c">{TEXT}</a></b></div>',
    },
    "description": {
        ".woocommerce-product-details__short-description": f'<div class="woocommerce-product-details__short-description">{TEXT}</div>',
        ".product-short-description": f'<div class="product-short-description">{TEXT}</div>',
        ".entry-summary p": f'<div class="entry-summary"><div><p>{TEXT}</p></div></div>',
        ".summary p": f'<div class="summary"><p>{TEXT}</p></div>',
    },
    "stock": {".stock": f'<p class="stock in">{TEXT}</p>'},
    "image": {
        ".woocommerce-product-gallery img": f'<div class="woocommerce-product-gallery"><figure>{IMAGE}</figure></div>',
        ".product-image img": f'<div class="product-image">{IMAGE}</div>',
        ".wp-post-image": '<img class="wp-post-image" src="/i/{v}.jpg">',
        ".attachment-shop_single": '<img class="attachment-shop_single" src="/i/{v}.jpg">',
    },
}
ORDER = {
    "link": V.LINK_SELECTORS, "name": V.NAME_SELECTORS, "price": V.PRICE_SELECTORS, "area": V.AREA_SELECTORS,
    "sku": V.SKU_SELECTORS, "brand": V.BRAND_SELECTORS, "category": V.CATEGORY_SELECTORS,
    "description": V.DESCRIPTION_SELECTORS, "stock": V.STOCK_SELECTORS, "image": V.IMAGE_SELECTORS,
}
CASES = [(field, selector, rank) for field, selectors in ORDER.items() for rank, selector in enumerate(selectors)]
SITE = "https://shop.example.com"


def selector_pages(parts: DataFrame) -> DataFrame:
    """``page_id field selector rank url html``, one page per part."""
    case = (F.col("p_partkey") % len(CASES) + 1).cast("int")
    listed = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(s).alias("selector"), F.lit(r).alias("rank"), F.lit(MARKUP[f][s]).alias("markup"))
                       for f, s, r in CASES])
    page = F.concat(F.lit("<html><head><title>t</title></head><body>"), F.replace("_case.markup", F.lit("{v}"), F.col("p_partkey").cast("string")),
                    F.lit("<footer>footer</footer></body></html>"))
    return parts.select("p_partkey", F.element_at(listed, case).alias("_case")).select(
        F.col("p_partkey").alias("page_id"), "_case.field", "_case.selector", "_case.rank", F.lit(SITE).alias("url"), page.alias("html"))


def selector_hits(parts: DataFrame) -> DataFrame:
    """What each page's selector has found: the first hit of its rank; for areas, the first price inside one."""
    fields = [f for f in ORDER if f != "area"]
    facts = parse_pages(selector_pages(parts), fields)

    def found(field: str) -> Column:
        hits = F.col("price" if field == "area" else field)
        own = F.filter(hits, (lambda h: h["in_area"]) if field == "area" else (lambda h: h["rank"] == F.col("rank")))
        return F.get(own, F.lit(0))["url" if field in ("link", "image") else "text"]

    value = F.coalesce(*[F.when(F.col("field") == field, found(field)) for field in ORDER])
    return facts.select("page_id", "field", "selector", value.alias("value"))
