"""Shop pages rendered from the parts table.

The stored crawl holds no shop pages, so product and listing pages are rendered, as Spark
expressions, from ``part``: known values go in, and extraction has to bring them back.
Parts are dealt to shops of 1,200 (60 listing pages of 20), so more parts mean more shops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PARTS_PER_SHOP = 1200
PARTS_PER_PAGE = 20


def shop_root(key: Column) -> Column:
    return F.concat(F.lit("https://shop"), F.floor(key / PARTS_PER_SHOP), F.lit(".example.com"))


def shop_base(key: Column) -> Column:
    return F.concat(shop_root(key), F.lit("/shop/"))


def product_url(key: Column) -> Column:
    return F.concat(shop_root(key), F.lit("/product/p"), key)


def listing_page_no(key: Column) -> Column:
    return (F.floor((key % PARTS_PER_SHOP) / PARTS_PER_PAGE) + 1).cast("int")


def is_empty_listing(page_no: Column) -> Column:
    return (page_no % 7 == 0) | page_no.between(40, 43)


def shop_bases(parts: DataFrame) -> DataFrame:
    return parts.select(shop_base(F.col("p_partkey")).alias("base_url")).distinct()


def _join(*pieces: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def product_pages(parts: DataFrame) -> DataFrame:
    """One product page per part: ``page_id url html``; every 50th page is too short."""
    k, name, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    price = F.col("p_retailprice")
    jsonld = _join(
        '<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":"Product","offers":'
        '[{"priceSpecification":[{"price":"bad"},{"price":"',
        F.replace(F.format_number(price, 2), F.lit(","), F.lit("")), '"}]}]}]}</script>')
    stock = F.when(k % 3 == 0, '<p class="stock">12 in stock</p>').when(
        k % 3 == 1, '<p class="stock">Out of Stock</p>').otherwise("")
    image = F.when(k % 5 != 0, _join(
        '<div class="product-image"><img data-src="/i/', k, '.jpg"></div>')).otherwise("")
    page = _join(
        "<html><head><title>", name, "</title>", F.when(k % 4 == 0, jsonld).otherwise(""),
        '</head><body><div class="breadcrumb"><a href="/">Home</a><a href="/shop">Shop</a><a href="/c">',
        F.col("p_type"), "</a></div>",
        '<h1 class="product_title">NEW  ', name, " ", brand, " SALE</h1>",
        '<div class="summary">',
        F.when(k % 4 != 3, _join('<p class="price">KSh ', F.format_number(price * 10, 2), "</p>")).otherwise(""),
        "<p>Genuine ", name, " for your car, checked &amp; ready to fit</p></div>",
        '<span class="sku">SKU-', k, '</span><span class="brand">', brand, "</span>",
        stock, image,
        F.when(k % 2 == 0, "<p>One year Warranty</p>").otherwise("<p>Fast delivery</p>"),
        "<footer>", F.repeat(F.lit("x"), 100), "</footer></body></html>",
    )
    short = "<html><head><title>t</title></head><body><h1>Short page</h1></body></html>"
    return parts.select(
        k.alias("page_id"), product_url(k).alias("url"),
        F.when(k % 50 == 0, short).otherwise(page).alias("html"))


def oil_filter_pages(parts: DataFrame) -> DataFrame:
    """The product pages of the oil filters that listings show beside each part: ``url html``."""
    k = F.col("p_partkey")
    page = _join('<html><head><title>Shop</title></head><body><h1 class="product_title">Oil filter ', k, "</h1>",
                 '<div class="summary"><p class="price">KSh ', k + 500, ".00</p></div><footer>", F.repeat(F.lit("x"), 400), "</footer></body></html>")
    return parts.select(F.concat(shop_root(k), F.lit("/product/oil-filter-"), k).alias("url"), page.alias("html"))


def listing_pages(parts: DataFrame, tasks: int | None = None) -> DataFrame:
    """One listing page per 20 parts: ``base_url page_no url html``; some pages are empty.

    ``tasks`` fixes the number of tasks that render pages.  Only keys are shuffled, so
    adaptive execution, going by bytes, would otherwise render many pages in one task.
    """
    k = F.col("p_partkey")
    page_no = F.col("page_no")
    if tasks:
        parts = parts.repartition(tasks, shop_base(k), listing_page_no(k))
    item = lambda x: _join(
        '<a href="/product/p', x, '">img</a><h2><a href="/product/p', x, '">part</a></h2>',
        '<a href="/product/p', x, '?add-to-cart=1">Buy</a><a href="/product/oil-filter-', x,
        '">Oil filter</a>')
    grouped = parts.groupBy(shop_base(k).alias("base_url"), listing_page_no(k).alias("page_no")).agg(
        F.sort_array(F.collect_list(k)).alias("_keys"))
    head = '<html><head><title>Shop</title></head><body><a href="/about">About</a>'
    full = _join(head, '<a href="/product-category/x">X</a>',
                 F.array_join(F.transform("_keys", item), ""), "</body></html>")
    return grouped.select(
        "base_url", "page_no",
        F.when(page_no == 1, F.col("base_url")).otherwise(
            F.concat("base_url", F.lit("?page="), page_no)).alias("url"),
        F.when(is_empty_listing(page_no), head + "</body></html>").otherwise(full).alias("html"))


def shop_pages(parts: DataFrame, tasks: int | None = None) -> DataFrame:
    """Listing and product pages of all shops as one stored crawl: ``url html``."""
    return product_pages(parts).select("url", "html").unionByName(
        listing_pages(parts, tasks).select("url", "html"))
