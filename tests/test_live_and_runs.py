"""Walks in waves, live health, first records over restarts, and runs published as a whole."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfgrain.operators import crawl_log
from shelfgrain.operators.dedup import dedup_products
from shelfgrain.plans import catalog
from shelfgrain.plans.run import catalog_run, run_sheets
from shelfgrain.session import work_path
from shelfgrain.sinks import published
from shelfgrain.streaming import live
from shelfgrain.streaming.first_records import FirstRecords, run_first_records
from shelfgrain.streaming.health import HostHealth, stream_health
from test_walks import listing, product

STARTED = datetime(2025, 9, 22, 0, 50, 44)


@pytest.fixture(scope="module")
def sites(spark):
    """Shops with empty pages in many patterns; a page that lists nothing may still be followed by full ones."""
    draw, pages, bases = random.Random(4), {}, []
    patterns = ["1101110001", "0001", "1", "10010010000111", "110" * 6 + "0001", "1" * 33 + "000" + "1" * 20]
    for shop, pattern in enumerate(patterns):
        base = f"https://shop{shop}.example.com/shop/"
        bases.append((base,))
        for k, full in enumerate(pattern, 1):
            name = f"p{shop}x{k}"
            shown = [name, f"p{shop}x{max(1, k - 1)}"] if full == "1" and pattern[k - 2] == "1" and k > 1 else [name]
            pages[base + (f"?page={k}" if k > 1 else "")] = listing(*(shown if full == "1" else [f"gone{k}"] if draw.random() < 0.5 else []))
            if full == "1":
                pages[f"https://shop{shop}.example.com/product/{name}"] = product(f"Name {k % 5}", f"KSh {100 * k}")
    stored = spark.createDataFrame(list(pages.items()), "url string, html string").repartition(2).cache()
    return stored, spark.createDataFrame(bases, "base_url string")


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_waves_walk_what_the_full_walk_does(sites, monkeypatch):
    pages, bases = sites
    columns = ["base_url", "page_no", "source_url", "name", "price_kes", "selector_rank", "ord"]
    expected = rows_of(catalog.full_catalog(pages, bases, columns=("price_kes",)).select(*columns))
    parsed, parse = [], catalog.parse_pages
    monkeypatch.setattr(catalog, "parse_pages", lambda of, *given: parsed.append(of.select("url")) or parse(of, *given))
    assert rows_of(catalog.full_catalog_waves(pages, bases, columns=("price_kes",), first_wave=2).select(*columns)) == expected
    read = [r["url"] for of in parsed for r in of.collect()]
    assert len(read) == len(set(read))                          # no listing page is parsed twice
    stops = {0: 9, 1: 3, 2: 4, 3: 11, 4: 21, 5: 36}
    for shop, stop in stops.items():
        numbers = [int(u.split("page=")[1]) if "page=" in u else 1 for u in read if u.startswith(f"https://shop{shop}.")]
        assert max(numbers) <= max(2, 2 * stop + 2)             # the wave in which it stops, none after that
    assert rows_of(catalog.full_catalog_waves(pages, bases, max_pages=5, columns=("price_kes",), first_wave=3).select(*columns)) == \
        rows_of(catalog.full_catalog(pages, bases, max_pages=5, columns=("price_kes",)).select(*columns))


SCHEMA = "run_id string, host string, id long, ts timestamp, phase string, url string, status int, error string, elapsed_s double"


def a_log(n=420):
    draw, rows, at = random.Random(9), [], datetime(2025, 1, 1)
    for k in range(n):
        at += timedelta(seconds=draw.choice((0, 1, 2, 30)))
        host = draw.choice(("a", "a", "a", "b", None))
        status, error = draw.choice(((200, None), (200, None), (404, None), (0, "timeout"), (None, None)))
        rows.append(("r", host, k, at, "listing", f"u{k}", status, error, draw.choice((0.125, 0.25, 3.5, None))))
    return rows


def in_files(spark, rows, schema, parts):
    """A folder with one file per part, and a stream that reads one file per batch, in that order."""
    folder = work_path(spark, "landed")
    for k, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.parquet(f"{folder}/f{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/f*")


def health_of(stream, delay, label):
    made = live.run_updates(stream_health(stream, delay), ["host", "id"], label)
    assert made.columns == ["host", "id", "mean_response", "error_pressure", "signal", "late"]
    return rows_of(made)


def test_live_health_is_that_of_the_whole_log(spark):
    rows = a_log()
    expected = rows_of(crawl_log.crawl_health(spark.createDataFrame(rows, SCHEMA)).select(
        "host", "id", "mean_response", "error_pressure", "signal", F.lit(False)))
    mixed = list(range(len(rows)))
    random.Random(1).shuffle(mixed)
    ordered = [range(k, min(k + 70, len(rows))) for k in range(0, len(rows), 70)]
    assert health_of(in_files(spark, rows, SCHEMA, [mixed[k::4] for k in range(4)]), 1e6, "health-mixed") == expected
    assert health_of(in_files(spark, rows, SCHEMA, ordered), 60.0, "health-ordered") == expected
    late = health_of(in_files(spark, rows, SCHEMA, [ordered[5], ordered[0]]), 5.0, "health-late")
    assert len(late) == 140 and 0 < sum(r[5] for r in late) <= 70


def test_health_state_is_short():
    health, said = HostHealth(), {}
    for k in range(500):
        health = HostHealth(health.stored())
        for i, *rest in health.take([[k * 1_000_000, k, 0.25, -1, False]], 20_000_000):
            said[i] = rest
    assert len(health.ring) == 50 and len(health.waiting) <= 21 and health.upto[1] >= 478
    assert said[8][0] is None and said[9][0] == 0.25 and all(v[2] == (2 if k >= 9 else 0) for k, v in said.items())


def test_first_records_over_restarts(spark):
    draw = random.Random(3)
    schema = "page_id long, name string, source_url string, price double"
    rows = [(k, draw.choice(["a", "b", "c", "", None, "d"]), f"u{draw.randrange(6)}", float(k)) for k in range(300)]
    draw.shuffle(rows)
    expected = rows_of(dedup_products(spark.createDataFrame(rows, schema), ["name", "source_url"]))
    landed, folder = work_path(spark, "records"), work_path(spark, "first")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{landed}/*")
    for first, last in ((0, 3), (3, 5), (5, 7)):               # three runs of the stream over one table
        for k in range(first, last):
            spark.createDataFrame(rows[k::7], schema).coalesce(1).write.parquet(f"{landed}/f{k}")
        table = run_first_records(stream, ["name", "source_url"], ["page_id"], folder, merge_every=3)
        seen = [r for k in range(last) for r in rows[k::7]]
        assert rows_of(table) == rows_of(dedup_products(spark.createDataFrame(seen, schema), ["name", "source_url"]))
    assert rows_of(table) == expected
    known = FirstRecords(spark, folder, spark.createDataFrame([], schema).schema, ["name", "source_url"], ["page_id"], 3)
    assert {line["kind"] for line in known.log()} == {"batch", "base"}
    known.add(spark.createDataFrame(rows[6::7], schema), 6)     # a batch that is repeated after a crash
    assert rows_of(known.read()) == expected
    assert rows_of(run_first_records(stream, ["name", "source_url"], ["page_id"], folder)) == expected


def test_nothing_landed(spark):
    folder = work_path(spark, "empty")
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(folder)
    for name in os.listdir(folder.removeprefix("file:")):
        os.remove(os.path.join(folder.removeprefix("file:"), name))
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    made = live.run_updates(live.stream_stats(stream, "1 day"), "window_start", "nothing")
    assert made.count() == 0 and made.columns == ["window_start", "requests", "errors", "mean_response"]
    assert run_first_records(stream.select("id", "host", "url"), "host", ["id"]).count() == 0


def test_a_run_is_published_as_a_whole(spark, sites, monkeypatch):
    pages, bases = sites
    folder = work_path(spark, "runs")
    urls = [r["url"] for r in pages.select("url").collect()]
    log = spark.createDataFrame([("r1", "h", k, STARTED + timedelta(seconds=k), "listing", u, 200, None, 0.5) for k, u in enumerate(urls)], SCHEMA)
    walk = dict(walk=catalog.site_catalog, max_pages=6)
    with monkeypatch.context() as crash:
        def stopped(*_):
            raise KeyboardInterrupt("between the sheets and the line that publishes them")
        crash.setattr(published, "publish", stopped)
        with pytest.raises(KeyboardInterrupt):
            catalog_run(pages, bases, folder, STARTED, log=log, **walk)
    with pytest.raises(FileNotFoundError):
        published.read_run(spark, folder, "scraped_products_20250922_005044")
    assert catalog_run(pages, bases, folder, STARTED, log=log, **walk) == "scraped_products_20250922_005044"
    made = published.read_run(spark, folder, "scraped_products_20250922_005044")
    assert set(made) == {"products", "summary", "completeness", "figures", "verdicts"}
    expected = run_sheets(pages, bases, STARTED, log, **walk)
    for name in made:
        assert rows_of(made[name]) == rows_of(expected[name]), name
    products = made["products"].collect()
    assert sorted(r.product_id for r in products) == list(range(1, len(products) + 1)) and len(products) > 10
    assert made["summary"].filter("place = 1").first()["value"] == str(len(products))
    assert made["figures"].first()["products_found"] == len(products) and made["figures"].first()["pages_processed"] == len(urls)
    with pytest.raises(FileExistsError):
        catalog_run(pages, bases, folder, STARTED, **walk)
    # Two attempts that got as far as publishing: the first line counts.
    sheets = {"products": spark.range(3).toDF("product_id")}
    first, second = published.write_attempt(sheets, folder), published.write_attempt({"products": spark.range(9).toDF("product_id")}, folder)
    published.publish(spark, folder, "again", first, sheets)
    published.publish(spark, folder, "again", second, sheets)
    assert published.read_run(spark, folder, "again")["products"].count() == 3


def test_crawls_merge_into_one_catalog(spark, monkeypatch):
    from shelfgrain.sinks import snapshots

    draw = random.Random(8)
    rows = [(k, draw.choice("abcdef"), f"u{draw.randrange(4)}", float(k)) for k in range(200)] + [(500, "", "u1", 0.0), (501, None, "u1", 0.0)]
    schema = "page_id long, name string, source_url string, price double"
    whole = rows_of(dedup_products(spark.createDataFrame(rows, schema), ["name", "source_url"]))
    draw.shuffle(rows)
    folder = work_path(spark, "merge")
    assert snapshots.read_snapshot(spark, folder) is None
    for k in range(3):
        assert snapshots.merge_catalog(spark.createDataFrame(rows[k::3], schema), folder, ["name", "source_url"]) == k + 1
    assert rows_of(snapshots.read_snapshot(spark, folder)) == whole
    assert snapshots.merge_catalog(spark.createDataFrame(rows[:50], schema), folder, ["name", "source_url"]) == 4
    assert rows_of(snapshots.read_snapshot(spark, folder)) == whole
    assert len(snapshots.read_snapshot(spark, folder, 1).collect()) <= len(whole)
    assert snapshots.changes(spark, folder, ["name", "source_url"], 3, 4).count() == 0
    # A crash before the switch leaves the old snapshot; another merge that is faster is built upon.
    with monkeypatch.context() as crash:
        crash.setattr(snapshots, "switch", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            snapshots.merge_catalog(spark.createDataFrame([(-1, "new", "u9", 1.0)], schema), folder, ["name", "source_url"])
    assert rows_of(snapshots.read_snapshot(spark, folder)) == whole
    switch, other = snapshots.switch, spark.createDataFrame([(-2, "other", "u9", 1.0)], schema)

    def overtaken(session, place, version, attempt):
        monkeypatch.setattr(snapshots, "switch", switch)
        snapshots.merge_catalog(other, place, ["name", "source_url"])
        switch(session, place, version, attempt)

    monkeypatch.setattr(snapshots, "switch", overtaken)
    version = snapshots.merge_catalog(spark.createDataFrame([(-1, "new", "u9", 1.0)], schema), folder, ["name", "source_url"])
    assert rows_of(snapshots.read_snapshot(spark, folder, version)) == sorted([*whole, (-1, "new", "u9", 1.0), (-2, "other", "u9", 1.0)], key=repr)


def test_states_of_no_run(spark):
    from shelfgrain.operators.summary import catalog_summary, completeness, completeness_of_states, summary_of_states, summary_state

    schema = "run string, page_id long, name string, price_kes double, sku string, brand string, images array<string>, primary_image string, source_url string"
    rows = [("x", 3, "n", 5.0, "s", None, ["i"], "i", "u3"), ("x", 2, None, None, "", "b", [], None, "u2"), ("y", 1, "m", 0.0, None, "b", None, "", None)]
    for given in (rows, rows[:1], []):
        products = spark.createDataFrame(given, schema)
        states = summary_state(products, ["run"])
        assert rows_of(summary_of_states(states)) == rows_of(catalog_summary(products))
        assert rows_of(completeness_of_states(states)) == rows_of(completeness(products))
