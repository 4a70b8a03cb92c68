"""Whole walks over a small hand-made site, sinks and streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfgrain import session
from shelfgrain.plans import catalog
from shelfgrain.sinks.catalog import run_path, write_catalog, write_summary
from shelfgrain.session import work_path
from shelfgrain.sources import frontier as fr
from shelfgrain.sources.tables import latest_pages
from shelfgrain.streaming import live

BASE = "https://shop.example.com/shop/"


def listing(*keys):
    return "<title>l</title>" + "".join(f'<a href="/product/{k}">x</a>' for k in keys)


def product(name, price="KSh 500"):
    return (f"<html><head><title>t</title></head><body><h1>{name}</h1><div class='summary'>"
            f"<p class='price'>{price}</p></div>{'x' * 100}</body></html>")


SITE = {
    BASE: listing("c", "a", "gone"),
    BASE + "?page=2": listing("a", "b", "twin"),
    BASE + "?page=3": listing("gone"),            # links, but no product behind them
    BASE + "?page=4": "<title>l</title>",
    BASE + "?page=6": listing("late"),            # page 5 was never stored
    "https://shop.example.com/product/a": product("Alpha"),
    "https://shop.example.com/product/b": product("Beta"),
    "https://shop.example.com/product/c": product("Gamma"),
    "https://shop.example.com/product/twin": product("Alpha", "KSh 900"),
    "https://shop.example.com/product/late": product("Late"),
    "https://shop.example.com/product/unlinked": product("Unlinked"),
}


@pytest.fixture(scope="module")
def site(spark):
    pages = spark.createDataFrame(list(SITE.items()), "url string, html string")
    return pages, spark.createDataFrame([(BASE,)], "base_url string")


def found(products):
    return {(r.name, r.source_url.rsplit("/", 1)[1], r.page_no) for r in products.collect()}


def test_site_walk(site):
    assert found(catalog.site_catalog(*site, max_pages=2)) == {("Gamma", "c", 1), ("Alpha", "a", 1), ("Beta", "b", 2)}
    assert ("Late", "late", 6) in found(catalog.site_catalog(*site, max_pages=9))
    assert found(catalog.site_catalog(*site, max_pages=2, per_page=1)) == {("Gamma", "c", 1), ("Alpha", "a", 2)}


def test_full_walk_stops_after_three_empty_pages(site):
    assert found(catalog.full_catalog(*site)) == {("Gamma", "c", 1), ("Alpha", "a", 1), ("Beta", "b", 2)}


def test_lean_walk(site):
    walked = {("Gamma", "c", 1), ("Alpha", "a", 1), ("Alpha", "twin", 2), ("Beta", "b", 2), ("Late", "late", 6)}
    assert found(catalog.lean_catalog(*site)) == walked
    assert found(catalog.lean_catalog(*site, key="source_url")) == walked
    assert found(catalog.lean_catalog(*site, limit=2)) == {("Alpha", "a", 1), ("Beta", "b", 2)}


def test_sinks(spark, tmp_path):
    when = datetime(2025, 9, 22, 0, 50, 44)
    assert run_path("out/", when) == "out/scraped_products_20250922_005044"
    assert run_path("out", when, "p", "given") == "out/given"
    rows = spark.createDataFrame([(1, 'say "x", y'), (2, "")], "product_id long, product_name string")
    path = run_path(f"file:{tmp_path}/new", when)
    for fmt in ("parquet", "csv"):
        target = write_catalog(rows, f"{path}/{fmt}", fmt)
        back = spark.read.schema(rows.schema).option("header", True).option("escape", '"').format(fmt).load(target)
        assert sorted(map(tuple, back.fillna("").collect())) == [(1, 'say "x", y'), (2, "")]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_catalog(rows, f"{path}/csv", "csv")
    summary = write_summary(rows.repartition(3), path)
    assert spark.read.parquet(summary).rdd.getNumPartitions() == 1


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    rows = [(n, f"https://s.example.com/product/{n}", product(f"Part {n % 4}")) for n in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    source = f"file:{tmp_path}/landing"
    pages.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(source)
    made = live.run_to_table(live.stream_products(stream), "test-products")
    batch = live.stream_products(pages)
    assert sorted(map(str, made.collect())) == sorted(map(str, batch.collect()))

    stamped = live.stream_products(stream).withColumn("seen", F.timestamp_seconds(F.col("page_id") + 10**9))
    first = live.stream_dedup(stamped, "name", "seen", "1 day").select("name")
    assert sorted(r.name for r in live.run_to_table(first, "test-first").collect()) == [f"Part {n}" for n in range(4)]


def test_time_limits(spark, site):
    """Listing pages were fetched every ten seconds; product pages do not count."""
    pages, bases = site
    number = F.coalesce(F.regexp_extract("url", "page=([0-9]+)", 1).try_cast("int"), F.lit(1))
    timed = pages.withColumn("fetched_at", F.timestamp_seconds((number - 1) * 10 + 1000))
    full = lambda seconds: {name for name, _, _ in found(catalog.full_catalog(timed, bases, max_time=seconds))}
    assert full(9) == {"Gamma", "Alpha"}
    assert full(10) == full(1000) == {"Gamma", "Alpha", "Beta"}
    lean = lambda seconds: {key for _, key, _ in found(catalog.lean_catalog(timed, bases, max_time=seconds))}
    assert lean(20) == {"c", "a", "b", "twin"}            # the limit is 8: page 2 crosses it and is kept
    assert lean(60) == {"c", "a", "b", "twin"}            # 24: page 4, at 30, crosses it; page 6 comes after
    assert lean(124) == {"c", "a", "b", "twin", "late"}   # 49.6: page 6, at 50, is the one that crosses
    assert lean(1000) == {"c", "a", "b", "twin", "late"}


def test_a_late_row_is_an_error(spark, tmp_path):
    """A row that the watermark drops is not lost in silence."""
    source = f"file:{tmp_path}/late"
    for second in (10**9, 10**9 + 500_000, 10**9 + 500_001, 10**9 + 7):
        spark.createDataFrame([(second, f"k{second}")], "s long, name string").coalesce(1).write.mode("append").parquet(source)
    rows = spark.readStream.schema("s long, name string").option("maxFilesPerTrigger", 1).parquet(source)
    first = live.stream_dedup(rows.withColumn("seen", F.timestamp_seconds("s")), "name", "seen", "1 day").select("name")
    with pytest.raises(ValueError, match="1 rows came later"):
        live.run_to_table(first, "test-late")
    patient = live.stream_dedup(rows.withColumn("seen", F.timestamp_seconds("s")), "name", "seen", "30 days").select("name")
    assert live.run_to_table(patient, "test-patient").count() == 4


def test_stream_figures_do_not_depend_on_files(spark, tmp_path):
    """One file per trigger, newest first, against the batch."""
    log = spark.range(400).select(
        F.timestamp_seconds(10**9 + F.col("id") * 3000).alias("ts"), F.when(F.col("id") % 9 == 0, "timeout").alias("error"),
        (F.col("id") % 16 / 16.0).alias("elapsed_s"))
    source = f"file:{tmp_path}/log"
    for part in reversed(range(8)):
        log.filter(F.floor((F.unix_seconds("ts") - 10**9) / 150_000) == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = live.run_updates(live.stream_stats(stream, "1 day"), "window_start", "test-figures").collect()
    assert sorted(got) == sorted(live.stream_stats(log, "1 day").collect())
    assert sum(r.requests + r.errors for r in got) == 400


def versions(spark):
    """The site stored twice: once with old prices, and the newest version of one page without a body."""
    rows = [(1, u, h.replace("KSh 500", "KSh 700")) for u, h in SITE.items()]
    rows += [(2, u, h) for u, h in SITE.items()] + [(3, "https://shop.example.com/product/a", "")]
    return rows


def test_the_newest_usable_version_counts(spark, site, monkeypatch):
    for limit in (500_000, 0):
        monkeypatch.setattr(session, "BROADCAST_ROWS", limit)
        for rows in (versions(spark), versions(spark)[::-1]):
            pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
            for walk in (catalog.full_catalog, catalog.site_catalog):
                got = walk(pages, site[1], max_pages=9)
                assert {(r.name, r.price_kes) for r in got.collect()} >= {("Alpha", 500.0), ("Beta", 500.0), ("Gamma", 500.0)}
                assert found(got) == found(walk(*site, max_pages=9)) and "page_id" not in got.columns


def test_html_is_never_shuffled(spark, site, monkeypatch):
    """Not even when nothing is small enough to be broadcast."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    pages = spark.createDataFrame(versions(spark), "page_id long, url string, html string").withColumn("status", F.lit(200))
    source = work_path(spark, "stored-pages")
    pages.write.parquet(source)
    pages = spark.read.parquet(source)
    asked = pages.select("url")
    frames = [
        catalog.site_catalog(pages, site[1]), catalog.full_catalog(pages, site[1]), catalog.lean_catalog(pages, site[1]),
        fr.fetch_failures(asked, pages), fr.fetch_join(asked, pages, facts={"size": F.length("html")}),
        latest_pages(pages, {"size": F.length("html")}), catalog.listing_links(site[1], pages, 9),
        catalog.product_lookup(catalog.listing_links(site[1], pages, 9), pages)]
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.split("\n") if "Exchange" in line and "html" in line]
        assert not scans and "html" not in "".join(shuffled(frame._jdf.queryExecution().executedPlan()))
    assert found(catalog.full_catalog(pages, site[1], max_pages=9)) == found(catalog.full_catalog(*site, max_pages=9))


def shuffled(node):
    """Names of the columns that go through exchanges."""
    names = []
    if "Exchange" in node.nodeName() or node.nodeName() == "AdaptiveSparkPlan":
        inner = node.children() if "Exchange" in node.nodeName() else None
        if inner is None:
            return shuffled(node.executedPlan())
        names.append(node.output().toString())
    children = node.children()
    for k in range(children.size()):
        names += shuffled(children.apply(k))
    return names


def test_own_rules_reach_the_lookup(spark, site):
    pages = spark.createDataFrame(
        [(BASE, listing("oil-filter", "pump")), ("https://shop.example.com/product/oil-filter", product("Filter")),
         ("https://shop.example.com/product/pump", product("Pump"))], "url string, html string")
    names = lambda frame: {r.name for r in frame.collect()}
    rules = catalog.Rules(exclude=("add-to-cart",))
    for walk in (catalog.site_catalog, catalog.full_catalog, catalog.lean_catalog):
        assert names(walk(pages, site[1])) == {"Pump"}
        assert names(walk(pages, site[1], rules=rules)) == {"Pump", "Filter"}
        own = catalog.Rules(exclude=("add-to-cart",), selectors={"link": (".none", "a"), "name": ("title",)})
        assert names(walk(pages, site[1], rules=own)) <= {"t"}


def test_listings_are_found_by_their_own_url(spark):
    """The same rows as joining the generated frontier."""
    bases = ["https://a.b/s", "https://a.b/?v=1", "https://a.b/s?page=2", "x"]
    stored = [u for b in bases for u in (b, b + "?page=2", b + "&page=2", b + "?page=3", b + "?page=9", b + "?page=02", b + "?page=1", b + "?page=2?page=3")]
    pages = spark.createDataFrame([(u, "h") for u in sorted(set(stored))], "url string, html string")
    table = spark.createDataFrame([(b,) for b in bases], "base_url string")
    for style in ("auto", "full"):
        for last in (1, 3, 0):
            got, rest = fr.listings_of(table, pages, last, style)
            assert rest is None
            frontier = fr.listing_frontier(table, last, style)
            assert sorted(map(tuple, got.select("base_url", "page_no", "url").collect())) == sorted(
                map(tuple, pages.join(frontier, "url").select("base_url", "page_no", "url").collect()))


def test_places_out_of_range_are_refused(spark):
    links = spark.createDataFrame([("b", "l", 1 << 23, 0, 1)], "base_url string, link string, page_no int, selector_rank int, ord int")
    with pytest.raises(Exception, match="out of range"):
        catalog.first_links(links).collect()


class Reporting:
    """A query that runs ten batches between two looks and reports the last ``kept``; the second batch dropped three rows."""

    def __init__(self, kept):
        self.batch, self.kept = 0, kept

    def awaitTermination(self, timeout=None):
        self.batch = 60 if timeout is None else self.batch + 10
        return self.batch >= 60

    @property
    def recentProgress(self):
        return [{"batchId": k, "stateOperators": [{"numRowsDroppedByWatermark": 3 * (k == 1)}]} for k in range(max(0, self.batch - self.kept), self.batch)]


def test_late_rows_of_batches_no_longer_reported():
    assert sum(live._drain(Reporting(20), "x", None).values()) == 3
    seen = live._drain(Reporting(20), "x", 100)
    assert sorted(seen) == list(range(60)) and seen[1] == 3
    assert len(live._drain(Reporting(5), "x", None)) < 60   # a gap, which ``run_to_table`` reports
