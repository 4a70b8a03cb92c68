"""Plain SQL for the same results, straight from the stored tables.

None of these statements renders or parses a shop page: what extraction has to find is
computed from ``part`` directly.  Written for DuckDB; table names are views.
"""

from __future__ import annotations

from .selector_pages import CASES, SITE

RUN = "2025-09-22 00:50:44"

# Known values of every rendered product page that passes the validity gate.
PRODUCT = """
product AS (
  SELECT p_partkey AS k,
    'https://shop' || (p_partkey // 1200) || '.example.com/shop/' AS base_url,
    CAST((p_partkey % 1200) // 20 + 1 AS INTEGER) AS page_no,
    'https://shop' || (p_partkey // 1200) || '.example.com/product/p' || p_partkey AS source_url,
    p_name || ' ' || p_brand AS name,
    'NEW  ' || p_name || ' ' || p_brand || ' SALE' AS raw_name,
    CASE WHEN p_partkey % 4 = 0 THEN round(p_retailprice, 2) END AS jsonld_price,
    CASE WHEN p_partkey % 4 <> 3 THEN round(p_retailprice * 10, 2) END AS area_price,
    CASE WHEN p_partkey % 4 = 0 THEN round(p_retailprice, 2)
         WHEN p_partkey % 4 <> 3 THEN round(p_retailprice * 10, 2) END AS price_kes,
    'SKU-' || p_partkey AS sku, p_brand AS brand, p_type AS category,
    CASE WHEN p_partkey % 4 = 3
         THEN 'Genuine ' || p_name || ' for your car, checked & ready to fit' END AS description,
    CASE p_partkey % 3 WHEN 0 THEN 'In Stock' WHEN 1 THEN 'Out of Stock' END AS stock_status,
    CASE WHEN p_partkey % 5 <> 0 THEN
      'https://shop' || (p_partkey // 1200) || '.example.com/i/' || p_partkey || '.jpg' END AS image,
    p_partkey % 2 = 0 AS has_warranty, p_partkey % 2 = 1 AS has_shipping_info
  FROM part WHERE p_partkey % 50 <> 0)
"""

# Listing pages that show products, and where each link stands on its page.
SHOWN = """
shown AS (
  SELECT p_partkey AS k,
    'https://shop' || (p_partkey // 1200) || '.example.com/shop/' AS base_url,
    CAST((p_partkey % 1200) // 20 + 1 AS INTEGER) AS page_no,
    'https://shop' || (p_partkey // 1200) || '.example.com/product/p' || p_partkey AS link,
    CAST(p_partkey % 20 AS INTEGER) AS place
  FROM part
  WHERE ((p_partkey % 1200) // 20 + 1) % 7 <> 0
    AND ((p_partkey % 1200) // 20 + 1) NOT BETWEEN 40 AND 43)
"""

LISTING_URL = "base_url || CASE WHEN page_no = 1 THEN '' ELSE '?page=' || page_no END"

FULL_COLUMNS = f"""
  name, price_kes, CASE WHEN price_kes IS NOT NULL THEN 'KES' END AS original_currency,
  'KSh ' || format('{{:,.2f}}', price_kes) AS raw_price_text, sku, brand, category, description,
  stock_status, coalesce(image, '') AS images, image AS primary_image, has_warranty,
  has_shipping_info, '{RUN}' AS scraped_at
"""

LOG = """
log AS (
  SELECT 'run1' AS run_id, 'host' || (user_id % 8) AS host, event_id AS id, ts,
    CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 404 ELSE 200 END AS status,
    CASE event_type WHEN 'error' THEN 'timeout' END AS error,
    round(value * 100) / CASE user_id % 4 WHEN 0 THEN 2048.0::DOUBLE WHEN 1 THEN 4096.0::DOUBLE
      WHEN 2 THEN 8192.0::DOUBLE ELSE 16384.0::DOUBLE END AS elapsed_s
  FROM events)
"""

HEALTH = f"""
WITH {LOG},
steps AS (
  SELECT *, count(*) OVER frame AS seen, avg(elapsed_s) OVER frame AS mean,
    sum(CASE WHEN status = 200 AND error IS NULL THEN -1 ELSE 1 END)
      OVER (PARTITION BY host ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS s
  FROM log
  WINDOW frame AS (PARTITION BY host ORDER BY ts, id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
health AS (
  SELECT *, CASE WHEN seen >= 10 THEN mean END AS mean_response,
    CAST(s - least(0, min(s) OVER (PARTITION BY host ORDER BY ts, id ROWS UNBOUNDED PRECEDING)) AS BIGINT)
      AS error_pressure
  FROM steps)
"""

# All links of the stored pages, absolute; every reference there is host-relative.
NAV = """
nav AS (
  SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS ord
  FROM pages),
nav_links AS (
  SELECT page_url, regexp_extract(page_url, '^[a-z]+://[^/?#]+')
      || replace(replace(href, '&quot;', '"'), '&amp;', '&') AS link,
    CAST(0 AS INTEGER) AS selector_rank, CAST(min(ord) AS INTEGER) AS ord
  FROM nav GROUP BY 1, 2)
"""


def unescaped(text: str) -> str:
    return (f"replace(replace(replace(replace({text}, '&quot;', '\"'), '&copy;', '©'), "
            "'&middot;', '·'), '&amp;', '&')")


BLANKS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def cleaned(text: str) -> str:
    """Noise removed, blanks collapsed, trimmed, cut; Unicode blanks listed one by one."""
    bare = f"replace(replace(replace(replace({text}, 'BARGAIN PRICE', ''), 'Used', ''), 'NEW', ''), 'SALE', '')"
    return f"left(trim(regexp_replace({bare}, '{BLANKS}+', ' ', 'g')), 200)"


# Page text: markup, scripts and styles out, entities decoded.
PAGE_TEXT = unescaped(
    "regexp_replace(regexp_replace(html, '<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'gs'),"
    " '<[^>]*>', '', 'gs')")
H1 = unescaped("trim(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'))")

FRONTIER = """
WITH bases AS (
  SELECT 'https://s' || s_suppkey || '.example.com/shop/'
    || CASE WHEN s_suppkey % 3 = 0 THEN '?view=grid' ELSE '' END AS base_url FROM supplier)
SELECT base_url, CAST(n AS INTEGER) AS page_no,
  CASE WHEN n = 1 THEN base_url ELSE base_url || {joint} || n END AS url
FROM bases, range(1, {last}) AS r(n)
"""
AUTO = "CASE WHEN contains(base_url, '?') THEN '&page=' ELSE '?page=' END"

CRAWL = """
WITH stored AS (
  SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END AS status,
    CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 13 = 0 THEN '' ELSE html END AS html
  FROM pages)
"""

SUMMARY = f"""
WITH {PRODUCT},
figures AS (
  SELECT count(*) AS n, count(price_kes) AS priced, count(sku) AS skus, count(brand) AS brands,
    count(image) AS images, avg(price_kes) AS mean, max(price_kes) AS high, min(price_kes) AS low,
    arg_min(source_url, k) AS site
  FROM product {{where}})
"""

SUMMARY_ROWS = SUMMARY + """
SELECT CAST(1 AS INTEGER) AS place, 'Total Products Scraped' AS metric, n::VARCHAR AS value FROM figures
UNION ALL SELECT 2, 'Products with Valid Prices', priced::VARCHAR FROM figures
UNION ALL SELECT 3, 'Products with SKU', skus::VARCHAR FROM figures
UNION ALL SELECT 4, 'Products with Brand Info', brands::VARCHAR FROM figures
UNION ALL SELECT 5, 'Products with Images', images::VARCHAR FROM figures
UNION ALL SELECT 6, 'Average Price (KES)', coalesce(format('{{:.2f}}', mean), '0') FROM figures
UNION ALL SELECT 7, 'Highest Price (KES)', coalesce(format('{{:.2f}}', high), '0') FROM figures
UNION ALL SELECT 8, 'Lowest Price (KES)', coalesce(format('{{:.2f}}', low), '0') FROM figures
UNION ALL SELECT 9, 'Scraping Date', '20250922_005044' FROM figures
UNION ALL SELECT 10, 'Source Website', coalesce(site, '') FROM figures
"""

SHEET = f"""
WITH {PRODUCT}
SELECT row_number() OVER (ORDER BY k) AS product_id, name AS product_name,
  coalesce(price_kes, 0) AS price_kes,
  CASE WHEN price_kes IS NOT NULL THEN 'KES' ELSE '' END AS original_currency, sku, brand, category,
  coalesce(stock_status, '') AS stock_status, coalesce(description, '') AS description,
  coalesce(image, '') AS primary_image_url, CAST(image IS NOT NULL AS INTEGER) AS total_images,
  source_url, '{RUN}' AS scraped_date, has_warranty, has_shipping_info
FROM product
"""

DAILY = """
WITH days AS (
  SELECT base_url, CAST(n AS INTEGER) AS page_no
  FROM (SELECT DISTINCT 'u' || user_id AS base_url FROM events), range(1, 32) AS r(n)),
yields AS (
  SELECT d.base_url, d.page_no, count(e.event_id) AS found
  FROM days d LEFT JOIN events e
    ON d.base_url = 'u' || e.user_id AND d.page_no = day(e.ts)
  GROUP BY 1, 2)
"""


def product_columns(columns: str, where: str = "TRUE") -> str:
    return f"WITH {PRODUCT} SELECT k AS page_id, {columns} FROM product WHERE {where}"


def spec(name: str = "p_") -> str:
    """The rendered specification map as text, keys sorted."""
    return ("CASE WHEN p_partkey % 3 <> 0 THEN 'brand: ' || p_brand || '; ' ELSE '' END"
            " || 'size: ' || p_size || '; type: ' || p_type")


def walk(pages: str, columns: str) -> str:
    """First record per name and base among the products of the listing pages ``pages``."""
    return f"""
WITH {PRODUCT}, {SHOWN},
found AS (
  SELECT p.*, s.place, row_number() OVER (PARTITION BY p.base_url, p.name ORDER BY p.page_no, s.place) AS rn
  FROM product p JOIN shown s USING (k) WHERE {pages})
SELECT base_url, source_url, page_no, CAST(0 AS INTEGER) AS selector_rank,
  CAST(place * 4 + 1 AS INTEGER) AS ord, {columns}
FROM found WHERE rn = 1
"""


ORACLE: dict[str, str] = {
    # stored pages
    "latest_page_per_url": "SELECT page_id, url, CAST(length(html) AS INTEGER) AS html_len FROM pages",
    "page_facts": f"""
SELECT page_id, url, contains(html, '<title>') AS has_title, CAST(length({PAGE_TEXT}) AS INTEGER) AS text_len,
  CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) AS links,
  CAST(len(regexp_extract_all(html, '<h1>')) AS INTEGER) AS names, {H1} AS h1, FALSE AS failed
FROM pages""",
    "valid_pages": f"""
SELECT page_id, CAST(length({PAGE_TEXT}) AS INTEGER) AS text_len, length({PAGE_TEXT}) >= 2000 AS valid_at_2000
FROM pages WHERE contains(html, '<title>') AND length({PAGE_TEXT}) >= 100""",
    "page_names": f"""
SELECT page_id, {cleaned(H1)} AS name, left({H1}, 150) AS raw_name
FROM pages WHERE length({H1}) > 3 AND {cleaned(H1)} <> '' AND length({PAGE_TEXT}) >= 100""",
    "start_url_check": """
SELECT page_id, regexp_matches(url, '^https?://.*[.]') AS valid,
  regexp_matches(upper(url), '^https?://.*[.]') AS valid_upper,
  regexp_matches(replace(url, '.', ''), '^https?://.*[.]') AS valid_undotted FROM pages""",
    "page_links": f"WITH {NAV} SELECT page_url, link, selector_rank, ord FROM nav_links",
    "page_links_capped": f"""
WITH {NAV} SELECT page_url, link, selector_rank, ord FROM nav_links
QUALIFY row_number() OVER (PARTITION BY page_url ORDER BY ord) <= 3""",
    "distinct_links": f"WITH {NAV} SELECT DISTINCT link FROM nav_links",
    "limit_links": f"WITH {NAV} SELECT DISTINCT link FROM nav_links ORDER BY link LIMIT 300",
    "dedup_by_name": f"""
SELECT page_id, url, {cleaned(H1)} AS name
FROM pages WHERE length({H1}) > 3 AND {cleaned(H1)} <> '' AND length({PAGE_TEXT}) >= 100
QUALIFY row_number() OVER (PARTITION BY {cleaned(H1)} ORDER BY page_id) = 1""",
    # frontier and lookup
    "listing_frontier": FRONTIER.format(joint=AUTO, last=21),
    "listing_frontier_full": FRONTIER.format(joint="'?page='", last=1000),
    "page_budget": FRONTIER.format(joint=AUTO, last=6),
    "fetch_join": CRAWL + """
SELECT page_id, url, CAST(length(html) AS INTEGER) AS html_len FROM stored
WHERE status = 200 AND html <> ''""",
    "fetch_join_lean": CRAWL + """
SELECT page_id, url, CAST(length(html) AS INTEGER) AS html_len FROM stored
WHERE status = 200 AND html IS NOT NULL""",
    "fetch_failures": CRAWL + """
SELECT url || '/gone/' || page_id AS url, 'not crawled' AS reason FROM stored
UNION ALL SELECT url, CASE WHEN status <> 200 THEN 'HTTP ' || status WHEN html IS NULL THEN 'no body'
  ELSE 'empty body' END FROM stored WHERE status <> 200 OR html IS NULL OR html = ''""",
    "fetch_failures_recrawled": """
WITH versions AS (
  SELECT url, page_id, CASE WHEN page_id % 3 = 0 THEN 404 WHEN page_id % 5 = 0 THEN NULL ELSE 200 END AS status, html FROM pages
  UNION ALL SELECT url, page_id + 1000000000, CASE WHEN page_id % 2 = 0 THEN 500 WHEN page_id % 7 = 0 THEN NULL ELSE 200 END,
    CASE WHEN page_id % 11 = 0 THEN '' ELSE html END FROM pages),
told AS (
  SELECT *, CASE WHEN status IS NULL THEN 'no status' WHEN status <> 200 THEN 'HTTP ' || status
    WHEN html = '' THEN 'empty body' END AS reason FROM versions)
SELECT url, arg_max(coalesce(reason, ''), page_id) AS reason FROM told GROUP BY url HAVING count(*) = count(reason)""",
    "parse_failures": "SELECT page_id, url, 'no body' AS error FROM pages WHERE page_id % 9 = 0",
    # links
    "product_links_full": f"""
WITH {SHOWN} SELECT base_url, page_no, {LISTING_URL} AS page_url, link, CAST(0 AS INTEGER) AS selector_rank,
  CAST(place * 4 + 1 AS INTEGER) AS ord FROM shown""",
    "product_links_lean": f"""
WITH {SHOWN} SELECT base_url, page_no, {LISTING_URL} AS page_url, link,
  CAST(CASE WHEN place < 8 THEN 0 ELSE 3 END AS INTEGER) AS selector_rank,
  CAST(CASE WHEN place < 8 THEN place * 4 + 1 ELSE place + 1 END AS INTEGER) AS ord FROM shown""",
    "product_lookup": f"""
WITH {PRODUCT}, {SHOWN} SELECT p.base_url, p.page_no, source_url, name, price_kes, sku
FROM product p JOIN shown USING (k)""",
    "product_url_test": """
WITH root AS (SELECT p_partkey AS k, 'https://shop' || (p_partkey // 1200) || '.example.com' AS r FROM part),
urls AS (
  SELECT unnest([r || '/product/p' || k, upper(r || '/product/p' || k),
    r || '/product/p' || k || '?add-to-cart=' || k, r || '/product/oil-filter-' || k,
    r || '/product-category/c' || k]) AS url FROM root
  UNION ALL SELECT url FROM pages)
SELECT url, contains(lower(url), '/product/')
    AND NOT regexp_matches(lower(url), 'add-to-cart|filter|page=|orderby=|category') AS is_product,
  contains(lower(url), '/product/') AND NOT contains(lower(url), 'add-to-cart') AS is_product_open
FROM urls""",
    # fields
    "product_name_full": product_columns("name"),
    "product_name_lean": product_columns("left(raw_name, 150) AS name"),
    "price_jsonld": product_columns("jsonld_price AS price"),
    "price_area": product_columns("area_price AS price"),
    "price_lean": product_columns("area_price AS price"),
    "price_resolved": product_columns(
        "price_kes, CASE WHEN price_kes IS NOT NULL THEN 'KES' END AS original_currency,"
        " 'KSh ' || format('{:,.2f}', price_kes) AS raw_price_text"),
    "jsonld_shapes": """
SELECT p_partkey, CASE WHEN p_partkey % 8 IN (0, 1, 2, 7) THEN p_retailprice END AS price FROM part""",
    "price_plausibility": """
SELECT p_partkey, CASE WHEN p_partkey % 200 > 100 THEN (p_partkey % 200)::DOUBLE
    WHEN p_partkey * p_partkey > 100 THEN (p_partkey * p_partkey)::DOUBLE END AS full_price,
  CASE WHEN p_partkey % 200 BETWEEN 10 AND 10000000 THEN (p_partkey % 200)::DOUBLE
    WHEN p_partkey * p_partkey BETWEEN 10 AND 10000000 THEN (p_partkey * p_partkey)::DOUBLE END AS lean_price
FROM part""",
    "sku": product_columns("sku"),
    "brand": product_columns("brand"),
    "description": product_columns("description"),
    "stock_status": product_columns("stock_status"),
    "category_path": product_columns("category"),
    "product_images": product_columns(
        "CAST(image IS NOT NULL AS INTEGER) AS image_count, coalesce(image, '') AS images, image AS primary_image"),
    "primary_image_lean": product_columns("image AS primary_image"),
    "text_flags": product_columns("has_warranty, has_shipping_info"),
    "text_flags_pages": f"""
SELECT page_id, regexp_matches(lower({PAGE_TEXT}), 'warranty|guarantee') AS has_warranty,
  regexp_matches(lower({PAGE_TEXT}), 'shipping|delivery') AS has_shipping_info FROM pages""",
    "provenance": f"""
WITH {PRODUCT}
SELECT k AS page_id, source_url, strftime(make_timestamp(k * 60000000), '%Y-%m-%d %H:%M:%S') AS scraped_at
FROM product
UNION ALL SELECT k, source_url, '{RUN}' FROM product""",
    "named_records": "SELECT p_partkey, p_name AS name FROM part WHERE p_partkey % 3 = 2",
    "products_full": product_columns(f"source_url, {FULL_COLUMNS}"),
    "products_lean": product_columns(
        "source_url, left(raw_name, 150) AS name, area_price AS price_kes, image AS primary_image,"
        f" CASE WHEN area_price IS NOT NULL THEN 'KES' END AS original_currency, '{RUN}' AS scraped_at"),
    "products_without_media": product_columns(
        "name, price_kes, NULL::VARCHAR AS description, '' AS images, NULL::VARCHAR AS primary_image"),
    # scalar functions
    "clean_names": f"""
SELECT 'd' || doc_id AS id, {cleaned('text')} AS name FROM documents
UNION ALL SELECT 'p' || p_partkey,
  {cleaned("' RENEWED  ' || p_name || chr(9) || chr(10) || 'BARGAIN PRICEUsed ' || p_brand")} FROM part""",
    "ellipsized": """
SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS shown FROM documents""",
    "parsed_numbers": """
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_retailprice WHEN 1 THEN p_retailprice
  WHEN 5 THEN p_partkey * 100.0::DOUBLE WHEN 6 THEN p_partkey::DOUBLE END AS number FROM part""",
    "money_text": "SELECT o_orderkey, 'KSh ' || format('{:,.2f}', o_totalprice) AS price_text FROM orders",
    "two_decimals": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  format('{:.2f}', l_extendedprice * (1 - l_discount)) AS amount_text FROM lineitem""",
    "duration_text": """
SELECT event_id, CASE WHEN value * 32 < 60 THEN format('{:.1f}s', value * 32)
  WHEN value * 32 < 3600 THEN format('{:.1f}m', value * 32 / 60)
  ELSE format('{:.1f}h', value * 32 / 3600) END AS duration FROM events""",
    "epoch_text": """
SELECT event_id, strftime(make_timestamp(CAST(floor(event_id * 86399.9::DOUBLE) AS BIGINT) * 1000000),
  '%Y-%m-%d %H:%M:%S') AS moment FROM events""",
    "spec_text": f"SELECT p_partkey, {spec()} AS specifications FROM part",
    # duplicates
    "dedup_pair": """
WITH r AS (SELECT p_partkey AS page_id, p_name AS name, p_retailprice AS price_kes,
  'https://shop' || ((p_partkey // 6 * 2 + p_partkey % 2) // 1200) || '.example.com/product/p'
    || (p_partkey // 6 * 2 + p_partkey % 2) AS source_url FROM part WHERE p_partkey % 10 <> 9)
SELECT page_id, name, source_url, price_kes FROM r
QUALIFY row_number() OVER (PARTITION BY name, source_url ORDER BY page_id) = 1""",
    "dedup_url": """
WITH r AS (SELECT p_partkey AS page_id, p_name AS name, p_retailprice AS price_kes,
  'https://shop' || ((p_partkey // 6 * 2 + p_partkey % 2) // 1200) || '.example.com/product/p'
    || (p_partkey // 6 * 2 + p_partkey % 2) AS source_url FROM part WHERE p_partkey % 10 <> 9)
SELECT page_id, name, source_url, price_kes FROM r
QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY page_id) = 1""",
    # sheets
    "product_ids": f"WITH {PRODUCT} SELECT row_number() OVER (ORDER BY k) AS product_id, source_url FROM product",
    "sheet": SHEET,
    "sheet_optional": f"""
WITH {PRODUCT} SELECT row_number() OVER (ORDER BY k) AS product_id, sku,
  CASE WHEN k % 3 <> 1 AND k > 0 THEN k * 2.0::DOUBLE END AS price_jpy,
  CASE WHEN k % 3 <> 1 AND k > 0 THEN CASE WHEN k % 2 = 0 THEN 0.9::DOUBLE ELSE 0 END END AS exchange_rate_used,
  CASE WHEN k % 5 <> 0 THEN {spec()} END AS specifications
FROM product JOIN part ON k = p_partkey""",
    "sheet_short": f"""
WITH {PRODUCT} SELECT row_number() OVER (ORDER BY k) AS id, name AS product_name, price_kes,
  CASE WHEN price_kes IS NOT NULL THEN 'KES' END AS currency, source_url, image AS primary_image,
  '{RUN}' AS scraped_at, price_kes IS NOT NULL AS has_price, image IS NOT NULL AS has_image FROM product""",
    "written_sheet": SHEET,
    "written_sheet_csv": SHEET,
    "written_summary": SUMMARY_ROWS.format(where=""),
    # figures
    "summary_wide": SUMMARY.format(where="") + """
SELECT n AS total_products, priced AS with_price, skus AS with_sku, brands AS with_brand,
  images AS with_images, round(mean, 4) AS mean_price, high AS max_price, low AS min_price,
  site AS source_site FROM figures""",
    "summary_rows": SUMMARY_ROWS.format(where=""),
    "summary_rows_empty": SUMMARY_ROWS.format(where="WHERE price_kes < 0"),
    "completeness_shares": f"""
WITH {PRODUCT} SELECT count(*) AS products, round(count(*) FILTER (k % 5 <> 1) / count(*), 6) AS name_share,
  round(count(price_kes) / count(*), 6) AS price_share, round(count(image) / count(*), 6) AS image_share
FROM product""",
    "coverage_rate": """
SELECT count(*) FILTER (p_partkey % 50 <> 0) AS found, count(*) AS listed,
  round(count(*) FILTER (p_partkey % 50 <> 0) / count(*) * 100, 6) AS coverage_pct FROM part""",
    "page_yields": f"""
WITH {PRODUCT}, {SHOWN},
counts AS (SELECT p.base_url, p.page_no, count(*) AS found FROM product p JOIN shown USING (k) GROUP BY 1, 2),
listed AS (SELECT base_url, CAST(n AS INTEGER) AS page_no
  FROM (SELECT DISTINCT 'https://shop' || (p_partkey // 1200) || '.example.com/shop/' AS base_url FROM part),
    range(1, 61) AS r(n))
SELECT base_url, page_no, coalesce(found, 0) AS found FROM listed LEFT JOIN counts USING (base_url, page_no)""",
    "run_stats": f"""
WITH {LOG}, wanted AS (
  SELECT DISTINCT 'host' || (user_id % 8) AS host, event_id AS id FROM events WHERE event_type NOT IN ('view', 'error', 'signup')),
products AS (SELECT count(*) FILTER (id % 8 <> 0) AS found, count(*) FILTER (id % 8 = 0) AS unreadable FROM wanted),
s AS (
  SELECT run_id, count(*) FILTER (status = 200 AND error IS NULL) AS pages_processed,
    count(*) FILTER (error IS NULL) AS network_requests, count(error) + any_value(unreadable) AS errors, count(*) AS attempts,
    any_value(found) AS found,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000::DOUBLE AS duration_s FROM log, products GROUP BY 1)
SELECT run_id, pages_processed, found AS products_found, network_requests, errors, duration_s,
  round(found / greatest(duration_s, 0.001), 6) AS products_per_second,
  round(pages_processed / attempts * 100, 6) AS success_pct, round(errors / attempts * 100, 6) AS error_pct
FROM s""",
    "run_verdicts": f"""
WITH s AS (
  SELECT 'host' || (user_id % 8) || '-' || strftime(ts, '%Y%m%d') AS run_id,
    count(DISTINCT event_id) FILTER (event_type NOT IN ('view', 'error', 'signup')) AS pages,
    (max((epoch_us(ts) - epoch_us(date_trunc('day', ts))) // CAST(power(10, user_id % 8) AS BIGINT))
      - min((epoch_us(ts) - epoch_us(date_trunc('day', ts))) // CAST(power(10, user_id % 8) AS BIGINT))) / 1000000::DOUBLE AS duration_s
  FROM events GROUP BY 1)
SELECT run_id, CASE WHEN pages / greatest(duration_s, 0.001) > 50 THEN 'top'
  WHEN pages / greatest(duration_s, 0.001) > 20 THEN 'middle' ELSE 'below' END AS rate_tier,
  duration_s < 60 AS time_target_met FROM s""",
    # order-dependent reports
    "stop_after_empty": DAILY + """
, islands AS (SELECT *, sum((found > 0)::INT) OVER (PARTITION BY base_url ORDER BY page_no) AS grp FROM yields),
streaks AS (SELECT *, sum((found = 0)::INT) OVER (PARTITION BY base_url, grp ORDER BY page_no) AS streak FROM islands),
stops AS (SELECT *, min(CASE WHEN streak = 3 THEN page_no END) OVER (PARTITION BY base_url) AS last_page FROM streaks)
SELECT base_url, page_no, found FROM stops WHERE last_page IS NULL OR page_no <= last_page""",
    "walk_progress": DAILY + """
SELECT base_url, CAST(page_no + 1 AS INTEGER) AS page_label, CAST(total AS BIGINT) AS total_products FROM (
  SELECT *, sum(found) OVER (PARTITION BY base_url ORDER BY page_no) AS total FROM yields)
WHERE (page_no + 1) % 10 = 0""",
    "rolling_response": HEALTH + "SELECT host, id, mean_response FROM health",
    "error_pressure": HEALTH + "SELECT host, id, error_pressure FROM health",
    "health_signal": HEALTH + """
SELECT host, id, CAST(CASE WHEN status <> 200 OR error IS NOT NULL
    THEN CASE WHEN error_pressure > 5 THEN -3 ELSE 0 END
  WHEN mean_response < 0.5 AND error_pressure = 0 THEN 2 WHEN mean_response > 2.0 THEN -1 ELSE 0 END
  AS INTEGER) AS signal FROM health""",
    "within_budget": f"""
WITH {LOG} SELECT id, host FROM (SELECT *, min(ts) OVER (PARTITION BY run_id) AS start FROM log)
WHERE epoch_us(ts) - epoch_us(start) <= 864000000000""",
    "within_budget_share": f"""
WITH {LOG}, timed AS (
  SELECT *, epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY host)) AS elapsed FROM log),
chained AS (SELECT *, lag(elapsed) OVER (PARTITION BY host ORDER BY ts, id) AS before FROM timed)
SELECT id, host FROM chained WHERE before IS NULL OR before <= 345600000000""",
    # whole walks
    "site_catalog": walk("p.page_no <= 20", FULL_COLUMNS),
    "full_catalog": walk("p.page_no <= 42", FULL_COLUMNS),
    "full_catalog_open": f"""
WITH {PRODUCT}, {SHOWN}, found AS (
  SELECT p.base_url, p.page_no, source_url, name, price_kes, k FROM product p JOIN shown USING (k) WHERE p.page_no <= 42
  UNION ALL SELECT base_url, page_no, replace(link, '/product/p', '/product/oil-filter-'), 'Oil filter ' || k,
    k + 500::DOUBLE, k FROM shown WHERE page_no <= 42)
SELECT base_url, page_no, source_url, name, price_kes FROM found
QUALIFY row_number() OVER (PARTITION BY base_url, name ORDER BY page_no, k) = 1""",
    "lean_catalog": f"""
WITH {PRODUCT}, {SHOWN},
asked AS (
  SELECT *, row_number() OVER (PARTITION BY base_url ORDER BY link) AS rn FROM shown WHERE page_no <= 25)
SELECT p.base_url, source_url, p.page_no, CAST(CASE WHEN place < 8 THEN 0 ELSE 3 END AS INTEGER) AS selector_rank,
  CAST(CASE WHEN place < 8 THEN place * 4 + 1 ELSE place + 1 END AS INTEGER) AS ord,
  left(raw_name, 150) AS name, area_price AS price_kes, image AS primary_image,
  CASE WHEN area_price IS NOT NULL THEN 'KES' END AS original_currency, '{RUN}' AS scraped_at
FROM product p JOIN asked USING (k) WHERE rn <= 300""",
    # streams
    "stream_products": product_columns("source_url, name, price_kes, stock_status, has_warranty"),
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_stats": f"""
WITH {LOG} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) FILTER (error IS NULL) AS requests,
  count(error) AS errors, avg(elapsed_s) AS mean_response
FROM log GROUP BY 1""",
}
ORACLE["first_distinct_links"] = ORACLE["limit_links"]
ORACLE["product_lookup_stored"] = ORACLE["product_lookup"]
ORACLE["newest_stored_pages"] = """
SELECT page_id + 1000000000 AS page_id, url,
  CAST(CASE WHEN page_id % 2 = 0 THEN 500 WHEN page_id % 7 = 0 THEN NULL ELSE 200 END AS INTEGER) AS status,
  md5(CASE WHEN page_id % 11 = 0 THEN '' ELSE html END) AS html_md5
FROM pages QUALIFY page_id = max(page_id) OVER (PARTITION BY url)"""
ORACLE["stream_failures"] = CRAWL + """
SELECT url || '/gone/' || page_id AS url, 'not crawled' AS reason FROM stored
UNION ALL SELECT url, CASE WHEN page_id % 8 = 7 THEN 'not crawled' WHEN status <> 200 THEN 'HTTP ' || status
  WHEN html IS NULL THEN 'no body' ELSE 'empty body' END
FROM stored WHERE page_id % 8 = 7 OR status <> 200 OR html IS NULL OR html = ''"""
ORACLE["catalog_merge"] = ORACLE["dedup_pair"]
ORACLE["summary_from_states"] = ORACLE["summary_rows"]
ORACLE["completeness_from_states"] = f"""
WITH {PRODUCT} SELECT count(*) AS products, 1.0::DOUBLE AS name_share, round(count(price_kes) / count(*), 6) AS price_share,
  round(count(image) / count(*), 6) AS image_share FROM product"""
ORACLE["full_catalog_waves"] = ORACLE["full_catalog"]
ORACLE["stream_first_records"] = ORACLE["dedup_pair"]
ORACLE["stream_health"] = ORACLE["health_signal"].replace("SELECT host, id,", "SELECT host, id, mean_response, error_pressure,")
ORACLE["published_run"] = f"""
WITH {PRODUCT}, {SHOWN}, found AS (
  SELECT p.*, s.place, row_number() OVER (PARTITION BY p.base_url, p.name ORDER BY p.page_no, s.place) AS rn
  FROM product p JOIN shown s USING (k) WHERE p.page_no <= 42),
sheet AS (SELECT{SHEET.rsplit("SELECT", 1)[1].replace("ORDER BY k", "ORDER BY base_url, page_no, place").replace("FROM product", "FROM found WHERE rn = 1")})
SELECT *, count(*) OVER () AS total_products FROM sheet"""
SHAPES = {"link": f"'{SITE}/product/' || p_partkey", "image": f"'{SITE}/i/' || p_partkey || '.jpg'",
          "price": "'KSh ' || p_partkey", "area": "'KSh ' || p_partkey"}
LISTED = ", ".join(f"({k}, '{field}', '{selector}')" for k, (field, selector, _) in enumerate(CASES))
ORACLE["selector_matrix"] = f"""
SELECT p_partkey AS page_id, field, selector,
  CASE field {" ".join(f"WHEN '{field}' THEN {shape}" for field, shape in SHAPES.items())} ELSE 'value ' || p_partkey END AS value
FROM part JOIN (VALUES {LISTED}) AS c(k, field, selector) ON p_partkey % {len(CASES)} = k"""
ORACLE["cap_links"] = ORACLE["page_links_capped"]

ORACLE["prices_nested"] = """
SELECT p_partkey, CAST(p_size + 1 AS INTEGER) AS hits,
  CASE WHEN p_partkey > 100 THEN CAST(p_partkey AS DOUBLE) ELSE CAST(CAST(p_retailprice AS DECIMAL(15,2)) AS DOUBLE) END AS full_price,
  CASE WHEN p_partkey BETWEEN 10 AND 10000000 THEN CAST(p_partkey AS DOUBLE)
       WHEN p_size = 1 THEN CAST(CAST(p_retailprice AS DECIMAL(15,2)) AS DOUBLE) END AS lean_price
FROM part
"""
