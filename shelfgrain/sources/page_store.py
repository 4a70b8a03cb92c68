"""Stored pages laid out by URL.

Written once in buckets of the URL, HTML is shuffled that one time.  After that the newest version of
each page and the pages that any number of links name are found where the pages lie: only
URLs are moved to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LAYOUT = "-layout"


def write_page_store(pages: DataFrame, path: str, buckets: int, table: str) -> DataFrame:
    """Write ``pages`` to ``path`` in ``buckets`` of the URL, a file each, sorted by URL; known as ``table`` from then on.

    A bucket is read by one task: choose as many as keep one at a few hundred megabytes.  All pages without URL
    share a bucket, and so do all versions of one page.
    """
    spark = pages.sparkSession
    (pages.repartition(buckets, "url").write.format("parquet").option("path", path)
     .bucketBy(buckets, "url").sortBy("url").saveAsTable(table))
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(path + LAYOUT)
    return spark.table(table)


def open_page_store(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The store at ``path`` as ``table`` of a session that does not know it yet."""
    if not spark.catalog.tableExists(table):
        known = spark.read.schema("buckets int").json(path + LAYOUT).first()
        schema = spark.read.parquet(path).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (url) SORTED BY (url) "
                  f"INTO {known.buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def newest_in_store(store: DataFrame) -> DataFrame:
    """The rows of ``latest_pages`` with their HTML, found where they lie: nothing is shuffled."""
    newest = store.groupBy(F.col("url").alias("_url")).agg(F.max("page_id").alias("_newest"))
    stale = (F.col("url") == F.col("_url")) & (F.col("page_id") < F.col("_newest"))
    return store.join(newest.hint("merge"), stale, "left_anti")


def asked_in_store(store: DataFrame, asked: DataFrame) -> DataFrame:
    """The pages that ``asked`` (url) names, however many these are; only its distinct URLs are shuffled."""
    return store.join(asked.select("url").distinct().hint("merge"), "url", "left_semi").select(*store.columns)
