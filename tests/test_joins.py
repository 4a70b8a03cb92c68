"""Joins with one key that holds a third of all rows."""

import pytest
from pyspark.sql import functions as F

from shelfgrain import session
from shelfgrain.operators import crawl_log as L
from shelfgrain.operators import joins
from shelfgrain.plans import catalog
from shelfgrain.sources import tables
from test_walks import product


@pytest.fixture
def touchy(monkeypatch):
    """Everything is large: no lookup is small, 50 rows make a key hot."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "MIN_HOT_ROWS", 50)


def skewed(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 200))
    return spark.range(900).select("id", key.alias("key"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join(spark, touchy, how):
    rows = skewed(spark)
    lookup = spark.createDataFrame([("hot", 1)] + [(f"k{n}", n) for n in range(0, 200, 2)], "key string, value int")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"))
    assert [r.key for r in joins.hot_keys(counts, "key").collect()] == ["hot"]
    got = joins.lookup_join(rows, lookup, counts, "key", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(lookup, "key", how).collect()))


def test_hot_rows_stay_in_many_tasks(spark, touchy):
    rows = skewed(spark).repartition(8)
    lookup = rows.select("key").distinct().withColumn("value", F.lit(1))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"))
    per_task = (joins.lookup_join(rows, lookup, counts, "key").filter("key = 'hot'")
                .groupBy(F.spark_partition_id()).count().collect())
    assert len(per_task) >= 8 and max(r["count"] for r in per_task) < 100


def test_no_hot_key(spark):
    counts = spark.createDataFrame([("a", 3), (None, 10**9)], "key string, _rows long")
    assert joins.hot_keys(counts, "key") is None


def test_product_lookup_parses_each_page_once(spark, touchy):
    keys = ["hot"] + [f"k{n}" for n in range(200)]
    pages = spark.createDataFrame(
        [(f"https://s.example.com/product/{k}", product(f"Part {k}")) for k in keys], "url string, html string")
    link = F.concat(F.lit("https://s.example.com/product/"), F.col("key"))
    links = skewed(spark).select(link.alias("link"), F.col("id").cast("int").alias("page_no"))
    got = catalog.product_lookup(links, pages).select("page_no", "name")
    assert sorted(map(tuple, got.collect())) == sorted(
        (r.id, f"Part {r.key}") for r in skewed(spark).collect())


def test_budget_with_many_runs(spark, touchy):
    log = skewed(spark).select(
        F.col("key").alias("run_id"), "id", F.timestamp_seconds("id").alias("ts"))
    for share in (None, 0.25):
        got = {r.id for r in L.within_budget(log, 200, share).collect()}
        limit = 200 if share is None else 50
        inside = sum(n <= limit for n in range(0, 900, 3))
        expected = set(range(0, 3 * (inside if share is None else inside + 1), 3))
        assert {n for n in got if n % 3 == 0} == expected


def test_latest_pages_with_a_hot_url(spark, touchy):
    pages = skewed(spark).select(F.col("id").alias("page_id"), F.col("key").alias("url"), F.lit("h").alias("html"))
    newest = {}
    for r in skewed(spark).collect():
        newest[r.key] = max(r.id, newest.get(r.key, -1))
    assert {(r.url, r.page_id) for r in tables.latest_pages(pages).collect()} == set(newest.items())
    assert tables.latest_pages(pages).count() == len(newest)
