"""Links, duplicates, numbering, frontier and latest pages against brute force."""

import random

from pyspark.sql import functions as F

from shelfgrain import fixed_values as V
from shelfgrain.operators import links, numbering
from shelfgrain.operators.dedup import dedup_products
from shelfgrain.operators.numbering import with_position
from shelfgrain.operators.parse import parse_pages
from shelfgrain.sources import frontier as fr
from shelfgrain.sources.tables import latest_pages

BASE = "https://shop.example.com/shop/"


def links_of(spark, html, *args, **kwargs):
    pages = spark.createDataFrame([(BASE, html)], "url string, html string")
    found = links.product_links(parse_pages(pages, ("link",)), *args, **kwargs)
    return [(r.link.rsplit("/", 1)[1], r.selector_rank, r.ord) for r in
            found.orderBy("selector_rank", "ord").collect()]


def test_links_full_and_lean(spark):
    html = ('<h3><a href="/product/h3">x</a></h3><div class="product"><a href="../product/in#f">x</a></div>'
            '<h2><a href="https://other.example.com/product/h2">x</a></h2><a href="/product/h2b?page=2">x</a>'
            '<a class="woocommerce-loop-product__link" href="/PRODUCT/loud">x</a>')
    assert links_of(spark, html) == [("h3", 0, 1), ("in#f", 0, 2), ("h2", 0, 3), ("loud", 3, 1)]
    assert links_of(spark, html, "lean") == [("h3", 0, 1), ("in#f", 0, 2), ("h2", 0, 3), ("loud", 1, 1)]
    assert links_of(spark, html, per_page=2) == [("h3", 0, 1), ("in#f", 0, 2)]


def test_lean_reads_thirty_hits_before_the_url_test(spark):
    rejected = "".join(f'<a href="/product/{n}?orderby=x">x</a>' for n in range(29))
    html = rejected + '<a href="/product/a">x</a><a href="/product/b">x</a><h2><a href="/product/c">x</a></h2>'
    assert links_of(spark, html, "lean") == [("a", 0, 30), ("c", 3, 1)]
    assert [name for name, _, _ in links_of(spark, html)] == ["a", "b", "c"]


def test_caps_match_the_array_form(spark):
    rows = [(f"p{n % 7}", f"l{n * 37 % 101}", n % 3, n) for n in range(200)]
    table = spark.createDataFrame(rows, "page_url string, link string, selector_rank int, ord int")
    got = {(r.page_url, r.link, r.ord) for r in links.cap_links(table, 5).collect()}
    expected = set()
    for page in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == page), key=lambda r: (r[2], r[3], r[1]))
        expected |= {(r[0], r[1], r[3]) for r in own[:5]}
    assert got == expected
    distinct = links.distinct_links(table, table)
    assert distinct.count() == len({r[1] for r in rows})
    assert [r.link for r in links.limit_links(distinct, 9).orderBy("link").collect()] == sorted({r[1] for r in rows})[:9]
    by_page = links.limit_links(links.distinct_links(table, by=["page_url"]), 3, by=["page_url"])
    assert {(r.page_url, r.link) for r in by_page.collect()} == {
        (p, l) for p in {r[0] for r in rows} for l in sorted({r[1] for r in rows if r[0] == p})[:3]}


def test_dedup_with_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(n, rng.choice(["hot", "hot", "", None, f"n{rng.randrange(40)}"]), f"u{n % 50}", rng.random()) for n in range(3000)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "page_id long, name string, source_url string, price double").repartition(7)
    for keys in (["name"], ["name", "source_url"], ["source_url"]):
        seen = {}
        for row in sorted(rows):
            record = dict(zip(table.columns, row))
            key = tuple(record[k] for k in keys)
            if all(key) and key not in seen:
                seen[key] = row
        assert sorted(map(tuple, dedup_products(table, keys).collect())) == sorted(seen.values())
    within = dedup_products(table, "name", within=["source_url"])
    assert within.count() == len({(r[1], r[2]) for r in rows if r[1]})
    assert within.columns == table.columns


def test_positions(spark):
    rows = [(n % 3, n * 7919 % 1000) for n in range(1000)]
    table = spark.createDataFrame(rows, "host int, id int").repartition(9)
    got = {(r.host, r.id): r.position for r in with_position(table, ["host", "id"]).collect()}
    assert got == {row: place for place, row in enumerate(sorted(rows), 1)}
    assert with_position(table.filter("id < 0"), ["host", "id"]).count() == 0


def test_positions_in_more_slices_than_the_usual_shuffle(spark, monkeypatch):
    monkeypatch.setattr(numbering, "SLICE_ROWS", 30)
    table = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"))
    got = {r.id: r.position for r in with_position(table, ["id"]).collect()}
    assert got == {n: n + 1 for n in range(1000)}


def urls(spark, base, *args, **kwargs):
    bases = spark.createDataFrame([(base,)], "base_url string")
    return [r.url for r in fr.listing_frontier(bases, *args, **kwargs).orderBy("page_no").collect()]


def test_frontier(spark):
    assert urls(spark, "https://a.b/s", 3) == ["https://a.b/s", "https://a.b/s?page=2", "https://a.b/s?page=3"]
    assert urls(spark, "https://a.b/?v=1", 2) == ["https://a.b/?v=1", "https://a.b/?v=1&page=2"]
    assert urls(spark, "https://a.b/?v=1", 2, style="full")[1] == "https://a.b/?v=1?page=2"
    assert urls(spark, "https://a.b/s", 0) == urls(spark, "https://a.b/s", -4) == ["https://a.b/s"]
    assert len(urls(spark, "x", V.FULL_LISTING_PAGES)) == 999
    assert [fr.pages_for(n) for n in (0, 19, 39, 100)] == [1, 1, 1, 5]


def test_fetch(spark):
    pages = spark.createDataFrame(
        [("a", 200, "A"), ("b", 404, "B"), ("c", 200, None), ("d", 200, ""), ("e", 200, "E")], "url string, status int, html string")
    asked = spark.createDataFrame([(u,) for u in "abcdx"], "url string")
    assert {r.url for r in fr.fetch_join(asked, pages).collect()} == {"a"}
    assert {r.url for r in fr.fetch_join(asked, pages, keep_empty=True).collect()} == {"a", "d"}
    assert {r.url: r.reason for r in fr.fetch_failures(asked, pages).collect()} == {
        "b": "HTTP 404", "c": "no body", "d": "empty body", "x": "not crawled"}
    assert "d" not in {r.url for r in fr.fetch_failures(asked, pages, keep_empty=True).collect()}


def test_large_frontier_is_merged_with_the_same_result(spark, monkeypatch):
    pages = spark.range(500).select(F.concat(F.lit("u"), F.col("id")).alias("url"), F.lit("h").alias("html"))
    asked = pages.filter("url like '%7'").select("url")
    few = fr.fetch_join(asked, pages)
    monkeypatch.setattr(fr, "sized", lambda df: df.hint("merge"))
    many = fr.fetch_join(asked, pages)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    assert sorted(few.collect()) == sorted(many.collect())


def test_latest_pages(spark):
    rows = [(1, "a", "old"), (5, "a", "new"), (2, "b", "only"), (4, "a", "mid"), (3, None, "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {(r.page_id, r.html) for r in latest_pages(table).collect()} == {(5, "new"), (2, "only"), (3, "x")}


def test_fetched_and_failed_share_the_frontier(spark):
    """Several versions: usable if any is; the newest gives the reason; a null status has one."""
    rows = [(1, "a", 404, "x"), (2, "a", 200, "x"), (3, "a", 500, "x"), (4, "b", 200, ""), (5, "b", None, "x"), (6, "c", None, "x"), (7, "d", 200, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, status int, html string")
    asked = spark.createDataFrame([(u,) for u in "abcde"], "url string")
    failed = {r.url: r.reason for r in fr.fetch_failures(asked, pages).collect()}
    assert failed == {"b": "no status", "c": "no status", "e": "not crawled"}
    assert {r.url for r in fr.fetch_join(asked, pages).collect()} == set("abcde") - set(failed)
