"""Order-dependent reports against their definitions."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfgrain.operators import crawl_log as L
from shelfgrain.operators import paging
from shelfgrain.operators.export import catalog_export
from shelfgrain.operators.summary import catalog_summary, completeness, coverage, summary_long

START = datetime(2024, 1, 1)
LOG = ("run_id string, host string, id long, ts timestamp, phase string, url string, status int, "
       "error string, elapsed_s double")


def make_log(rng, size, hosts):
    rows = []
    for n in range(size):
        host = rng.choices(hosts, [10] + [1] * (len(hosts) - 1))[0]
        mood = rng.random()
        status, error = (200, None) if mood < 0.6 else (0, "timeout") if mood < 0.8 else (404, None)
        rows.append(("r", host, n, START + timedelta(seconds=rng.randrange(size // 3)), "product",
                     f"u{n}", status, error, rng.randrange(1, 4000) / 1024 * (0.2 if host == "h1" else 1)))
    return rows


def defined_health(rows):
    """The same figures from their definitions, request by request, over whole prefixes.

    The pressure is the largest sum of steps over any stretch that ends at the request, or 0.
    """
    made = {}
    for host in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == host), key=lambda r: (r[3], r[2]))
        good = [r[6] == 200 and r[7] is None for r in own]
        for n, row in enumerate(own):
            recent = [r[8] for r in own[max(0, n - 49):n + 1]]
            mean = sum(recent) / len(recent) if n >= 9 else None
            stretch, pressure = 0, 0
            for fine in reversed(good[:n + 1]):
                stretch += -1 if fine else 1
                pressure = max(pressure, stretch)
            fast, slow = (mean is not None and mean < 0.5), (mean is not None and mean > 2.0)
            cases = [(not good[n] and pressure > 5, -3), (good[n] and fast and pressure == 0, 2), (good[n] and slow, -1)]
            made[row[2]] = (mean, pressure, next((signal for case, signal in cases if case), 0))
    return made


@pytest.mark.parametrize("block_rows", [49, 64, 1000, 1_000_000])
def test_health_over_blocks(spark, block_rows):
    rows = make_log(random.Random(block_rows), 900, ["h0", "h1", "h2", None])
    log = spark.createDataFrame(rows, LOG).repartition(5)
    got = {r.id: (r.mean_response, r.error_pressure, r.signal) for r in L.crawl_health(log, block_rows).collect()}
    expected = defined_health(rows)
    assert got.keys() == expected.keys()
    for key, (mean, pressure, signal) in expected.items():
        assert got[key][1:] == (pressure, signal)
        assert got[key][0] == (pytest.approx(mean) if mean is not None else None)


def test_health_refuses_blocks_smaller_than_the_frame(spark):
    with pytest.raises(ValueError):
        L.crawl_health(spark.createDataFrame([], LOG), 20)


def test_leaky_counter_case(spark):
    steps = [("r", "h", n, START + timedelta(seconds=n), "p", "u", 200 if ok else 500, None, 1.0)
             for n, ok in enumerate([False, False, True, True, True, False])]
    made = L.error_pressure(spark.createDataFrame(steps, LOG)).orderBy("id").collect()
    assert [r.error_pressure for r in made] == [1, 2, 1, 0, 0, 1]


def test_budget(spark):
    rows = [(f"r{n % 2}", "h", n, START + timedelta(seconds=7 * n), "p", "u", 200, None, 1.0) for n in range(40)]
    log = spark.createDataFrame(rows, LOG)
    got = {r.id for r in L.within_budget(log, 100).collect()}
    assert got == {n for n in range(40) if 7 * (n - n % 2) <= 100}
    # Rows come every 14 seconds per run; the limit is 40: 0, 14 and 28 are inside, 42 crosses.
    kept = {run + 2 * n for run in (0, 1) for n in range(4)}
    assert {r.id for r in L.within_budget(log, 100, 0.4).collect()} == kept


def defined_stop(found):
    """Pages up to the earliest one that ends three empty pages, or all of them."""
    ends = [page for page in range(3, len(found) + 1) if not any(found[page - 3:page])]
    return list(range(1, min(ends, default=len(found)) + 1))


def test_stop_rule_on_random_walks(spark):
    rng = random.Random(11)
    walks = {f"b{n}": [rng.choice([0, 0, 1, 5]) for _ in range(rng.randrange(1, 30))] for n in range(150)}
    walks["hand"] = [1, 1, 1, 0, 0, 0, 1]
    rows = [(base, page, count) for base, found in walks.items() for page, count in enumerate(found, 1)]
    yields = spark.createDataFrame(rows, "base_url string, page_no int, found long")
    got = defaultdict(list)
    for r in paging.stop_after_empty(yields, yields).orderBy("base_url", "page_no").collect():
        got[r.base_url].append(r.page_no)
    assert got == {base: defined_stop(found) for base, found in walks.items()}
    assert got["hand"] == [1, 2, 3, 4, 5, 6]


def test_progress(spark):
    walks = {"a": list(range(1, 36)), "b": [2] * 9, "c": [1] * 8}
    rows = [(base, page, count) for base, found in walks.items() for page, count in enumerate(found, 1)]
    got = {(r.base_url, r.page_label): r.total_products for r in
           paging.progress(spark.createDataFrame(rows, "base_url string, page_no int, found long")).collect()}
    assert got == {("a", 10): 45, ("a", 20): 190, ("a", 30): 435, ("b", 10): 18}


def test_run_stats(spark):
    rows = [("r", "h", 1, START, "listing", "u", 200, None, 1.0), ("r", "h", 2, START, "product", "u", 404, None, 1.0),
            ("r", "h", 3, START, "product", "u", 0, "boom", 1.0)]
    stats = L.run_stats(spark.createDataFrame(rows, LOG), spark.createDataFrame([("r",), ("r",)], "run_id string"))
    row = stats.collect()[0]
    assert (row.pages_processed, row.products_found, row.network_requests, row.errors) == (1, 2, 2, 1)
    assert row.products_per_second == 2000.0 and row.duration_s == 0.0
    verdict = L.run_verdict(stats).collect()[0]
    assert (verdict.rate_tier, verdict.time_target_met) == ("top", True)


PRODUCT = ("page_id long, product_id long, name string, price_kes double, original_currency string, sku string, "
           "brand string, category string, stock_status string, description string, primary_image string, "
           "images array<string>, source_url string, scraped_at timestamp, has_warranty boolean, "
           "has_shipping_info boolean, price_jpy double, exchange_rate double, specifications map<string,string>")


def test_summary_of_nothing(spark):
    none = spark.createDataFrame([], PRODUCT)
    rows = summary_long(catalog_summary(none), F.lit("20240101_000000")).orderBy("place").collect()
    assert [r.value for r in rows] == ["0", "0", "0", "0", "0", "0", "0", "0", "20240101_000000", ""]
    assert coverage(none, none).collect()[0].coverage_pct is None
    assert completeness(none).collect()[0].products == 0


def test_sheet_defaults_and_options(spark):
    empty = (1, 1) + (None,) * 17
    full = (2, 2, "n", 5.0, "KES", "s", "b", "c", "In Stock", "d" * 201, "i", ["i", "j"], "u",
            datetime(2024, 5, 6, 7, 8, 9, 999999), True, True, 10.0, None, {"k": "v", "a": "", "": "x", "b": "w"})
    rows = catalog_export(spark.createDataFrame([empty, full], PRODUCT), optional=True).orderBy("product_id").collect()
    assert tuple(rows[0]) == (1, "", 0.0, "", "", "", "", "", "", "", 0, "", "1970-01-01 00:00:00", False, False,
                              None, None, None)
    assert tuple(rows[1]) == (2, "n", 5.0, "KES", "s", "b", "c", "In Stock", "d" * 200 + "...", "i", 2, "u",
                              "2024-05-06 07:08:09", True, True, 10.0, 0.0, "b: w; k: v")


def test_unreadable_pages_are_errors(spark):
    rows = [("r", "h", 1, datetime(2025, 1, 1), "product", "u", 200, None, 0.5), ("r", "h", 2, datetime(2025, 1, 1, 0, 0, 4), "product", "v", 0, "timeout", 0.5)]
    log = spark.createDataFrame(rows, LOG)
    assert [tuple(r) for r in L.product_pages(log).collect()] == [("r", "u")]
    one = spark.createDataFrame([("r",)], "run_id string")
    stats = L.run_stats(log, one, one).first()
    assert (stats.products_found, stats.errors, stats.pages_processed, stats.products_per_second) == (1, 2, 1, 0.25)
