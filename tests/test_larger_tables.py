"""Queries against their SQL on what only larger tables hold."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from compare import compare
from shelfgrain import session
from shelfgrain.plans import registry
from shelfgrain.sources.tables import stream_table
from shelfgrain.streaming.health import HostHealth, Responses


def differs(spark, folder, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("events", "pages"):
        if (folder / f"{table}.parquet").exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    return compare(spark, connection, str(folder), name, queries()[name], oracle_sql()[name])[0]


def test_moments_beyond_the_year_9999(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.withColumn("event_id", F.col("event_id") * 5_987).write.parquet(str(tmp_path / "events.parquet"))
    assert differs(spark, tmp_path, "epoch_text") is None


@pytest.fixture
def versions(spark, folder, tmp_path):
    """Pages of which every third URL is stored three times, under other outcomes; versions share links, and one has a link more."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    again = pages.filter("page_id % 3 = 0").select(
        F.explode(F.array((F.col("page_id") + 1_000).alias("page_id"), F.col("page_id") * 7 + 2_002)).alias("page_id"), "url",
        F.concat(F.lit('<a href="/one/more">x</a>'), "html").alias("html"))
    pages.unionByName(again).write.parquet(str(tmp_path / "pages.parquet"))
    return tmp_path


@pytest.mark.parametrize("name", ["fetch_join", "fetch_join_lean"])
def test_lookup_of_repeated_urls(spark, versions, name):
    assert differs(spark, versions, name) is None


def test_failures_of_repeated_urls(spark, versions):
    assert differs(spark, versions, "fetch_failures") is None


def test_newest_copies_of_pages_that_share_a_url(spark, versions):
    assert differs(spark, versions, "latest_page_per_url") is None


@pytest.mark.parametrize("most", [500_000, 0])
@pytest.mark.parametrize("name", ["page_links", "page_links_capped", "cap_links"])
def test_links_of_repeated_urls(spark, versions, monkeypatch, name, most):
    monkeypatch.setattr(session, "BROADCAST_ROWS", most)
    assert differs(spark, versions, name) is None


def test_pages_are_rendered_where_they_are_parsed(spark, folder):
    """One split of a small file: a filter on the page must not go through an exchange to it."""
    frame = queries()["products_full"](spark, folder)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.index("MapInArrow"):]
    assert frame.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_small_file_is_streamed_in_many_tasks(spark, folder, monkeypatch):
    landed = []
    monkeypatch.setattr(registry, "stream_table", lambda *args: landed.append(args) or stream_table(*args))
    assert queries()["stream_products"](spark, folder).count() > 0
    read = spark.read.parquet(f"{landed[0][1]}/part.parquet")
    assert read.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_health_of_very_many_responses_takes_little_memory():
    """All responses of a host in one batch are held as arrays: some tens of bytes each, not hundreds."""
    n = 100_000
    rng = np.random.default_rng(1)
    rows = Responses([rng.permutation(n) * 1_000, np.arange(n), rng.integers(0, 9, n) / 4, rng.choice([-1, 1], n), np.zeros(n)])
    health, said, most = HostHealth(), 0, 0
    tracemalloc.start()
    for _ in health.said(rows, 1_000_000):
        said += 1
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert said == n and len(health.waiting) == 1_001
    assert most < 80 * n
