"""Pages stored by URL, failures of a stream, and bounded distinct links."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfgrain.operators import links
from shelfgrain.plans import catalog
from shelfgrain.session import work_path
from shelfgrain.sources import page_store
from shelfgrain.sources.frontier import fetch_failures
from shelfgrain.sources.tables import latest_pages
from shelfgrain.streaming import failures as lost
from shelfgrain.streaming import live
from test_walks import product

T0 = datetime(2025, 1, 1)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges(frame):
    return [line for line in plan(frame).splitlines() if "Exchange" in line]


@pytest.fixture(scope="module")
def pages(spark):
    draw = random.Random(5)
    rows = [(k, f"https://a.example.com/product/p{draw.randrange(60)}", product(f"Name {k}", f"KSh {100 + k}")) for k in range(200)]
    rows += [(500, None, "x"), (501, None, "y"), (None, "https://a.example.com/product/p1", "z"), (502, "https://a.example.com/product/n", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).cache()


@pytest.fixture(scope="module")
def store(spark, pages):
    return page_store.write_page_store(pages, work_path(spark, "store"), 4, "stored_pages_test")


def test_newest_pages_lie_together(pages, store):
    newest = page_store.newest_in_store(store)
    assert rows_of(newest) == rows_of(latest_pages(pages))
    assert not exchanges(newest)


def test_only_urls_move_to_the_store(spark, pages, store):
    asked = spark.createDataFrame([(f"https://a.example.com/product/p{k}",) for k in (1, 2, 2, 90)] + [(None,)], "url string")
    found = page_store.asked_in_store(store, asked)
    assert rows_of(found) == rows_of(pages.filter(F.col("url").isin("https://a.example.com/product/p1", "https://a.example.com/product/p2")))
    moved = exchanges(found)
    assert moved and all("hashpartitioning(url" in line for line in moved)
    wide = [n for n, line in enumerate(plan(found).splitlines()) if "html" in line and "Exchange" in line]
    assert not wide and "Bucketed: true" in plan(found)


def test_a_store_is_opened_again(spark, pages):
    path = work_path(spark, "store")
    page_store.write_page_store(pages, path, 3, "stored_pages_once")
    opened = page_store.open_page_store(spark, path, "stored_pages_again")
    assert rows_of(opened) == rows_of(pages)
    assert not exchanges(page_store.newest_in_store(opened))
    assert rows_of(page_store.newest_in_store(opened)) == rows_of(latest_pages(pages))


def test_a_store_of_nothing(spark, pages):
    empty = page_store.write_page_store(pages.limit(0), work_path(spark, "store"), 2, "stored_pages_none")
    assert page_store.newest_in_store(empty).count() == 0
    assert page_store.asked_in_store(empty, pages).count() == 0


def test_unlinked_pages_are_not_parsed(spark, pages, store, monkeypatch):
    base = "https://a.example.com/product/"
    found = spark.createDataFrame([("b", 1, base + f"p{k}") for k in (3, 5, 7, 7, 99)], "base_url string, page_no int, link string")
    expected = rows_of(catalog.product_lookup(found, pages, columns=("price_kes",)).select("source_url", "name", "price_kes"))
    parsed, extract = [], catalog.extract_products
    monkeypatch.setattr(catalog, "extract_products", lambda of, *a, **k: parsed.append(of) or extract(of, *a, **k))
    monkeypatch.setattr(catalog, "BROADCAST_BYTES", 0)
    made = catalog.product_lookup(found, store, by_url=True, columns=("price_kes",))
    assert rows_of(made.select("source_url", "name", "price_kes")) == expected and expected
    assert {r.url for of in parsed for r in of.select("url").collect()} == {base + "p3", base + "p5", base + "p7"}
    assert not any("html" in line for of in parsed for line in exchanges(of))


ASKED, LANDED = "url string, asked_at timestamp", "url string, page_id long, status int, html string, landed_at timestamp"


def a_crawl():
    draw, asked, landed = random.Random(6), [], []
    for k in range(300):
        at = T0 + timedelta(minutes=k)
        asked.append((f"u{k}", at))
        for version in range(draw.choice((0, 1, 1, 1, 2))):
            landed.append((f"u{k}", 2 * k + version, draw.choice((200, 200, 404, 500, None)), draw.choice(("x", "x", "", None)),
                           at + timedelta(minutes=draw.choice((0, 1, 20, 60)))))
    return asked, landed


def as_stream(spark, rows, schema, pieces, at, shuffled=None):
    """Rows as files that land one after the other, a beat as the last of them."""
    path, size = work_path(spark, "landing"), -(-len(rows) // pieces)
    rows = sorted(rows, key=lambda r: r[-1])
    if shuffled:  # out of order by less than the delay
        rows.sort(key=lambda r: r[-1] + timedelta(minutes=shuffled.randrange(25)))
    beat = tuple("" if n == 0 else T0 + timedelta(days=9) if n == len(schema.split(",")) - 1 else None for n in range(len(schema.split(","))))
    for part in [rows[k:k + size] for k in range(0, len(rows), size)] + [[beat]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("pieces, disorder", [(1, None), (3, random.Random(7))])
def test_failures_of_a_stream(spark, pieces, disorder):
    asked, landed = a_crawl()
    made = lost.stream_outcomes(
        as_stream(spark, asked + asked[:20], ASKED, pieces, "asked_at", disorder),
        as_stream(spark, landed, LANDED, pieces, "landed_at", disorder), "1 HOUR", "30 minutes")
    outcomes = live.run_to_table(made, "outcomes")
    expected = fetch_failures(spark.createDataFrame(asked, ASKED), spark.createDataFrame(landed, LANDED))
    assert rows_of(lost.failures(outcomes).select("url", "asked_at", "reason")) == rows_of(expected.select("url", "asked_at", "reason"))
    assert lost.fetch_ledger(outcomes).count() == len(asked)


def test_pages_outside_the_time_do_not_count(spark):
    asked = [("early", T0), ("late", T0), ("edge", T0), ("twice", T0), ("twice", T0 + timedelta(hours=5))]
    landed = [("early", 1, 200, "x", T0 - timedelta(seconds=1)), ("late", 2, 200, "x", T0 + timedelta(hours=1, seconds=1)),
              ("edge", 3, 200, "x", T0 + timedelta(hours=1)), ("twice", 4, 404, "x", T0), ("twice", 5, 200, "x", T0 + timedelta(hours=5))]
    made = lost.stream_outcomes(as_stream(spark, asked, ASKED, 1, "asked_at"), as_stream(spark, landed, LANDED, 1, "landed_at"), "1 HOUR", "0 seconds")
    ledger = lost.fetch_ledger(live.run_to_table(made, "outcomes"))
    assert {(r.url, r.asked_at): r.reason for r in ledger.collect()} == {
        ("early", T0): "not crawled", ("late", T0): "not crawled", ("edge", T0): None,
        ("twice", T0): "HTTP 404", ("twice", T0 + timedelta(hours=5)): None}


def test_first_distinct_links(spark):
    draw = random.Random(8)
    urls = [f"u{int(draw.paretovariate(0.3)) % 5000}" for _ in range(20_000)] + ["é", "z", "", None, "\U0001F600", "￿"]
    table = spark.createDataFrame([(u, 1) for u in urls], "link string, link_id int").repartition(7)
    for limit in (0, 1, 50, 10_000):
        expected = rows_of(links.limit_links(links.distinct_links(table.filter("link IS NOT NULL")), limit))
        assert rows_of(links.first_distinct_links(table, table, limit=limit)) == expected
    assert links.first_distinct_links(table.limit(0)).count() == 0
    made = links.first_distinct_links(table, limit=50)
    per_task = made._jdf.queryExecution().analyzed().toString()
    assert per_task.index("Deduplicate") < per_task.index("MapInArrow")    # cut in the tasks, then merged
