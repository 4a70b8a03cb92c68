"""Stored tables: pages, parts, events and others, batch and stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..operators.joins import hot_keys
from ..session import fits, stage

SCHEMAS = {"pages": schemas.PAGES, "part": schemas.PARTS, "events": schemas.EVENTS}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of ``folder``; known tables are read without schema inference."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The same table as a stream of newly landed files.

    The path is a pattern because a stream takes a plain path for a directory, while a table
    may be a single file; the pattern matches either.
    """
    reader = spark.readStream.schema(SCHEMAS[name])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{name}.parque[t]")


def repeated_urls(pages: DataFrame) -> DataFrame:
    """URLs stored more than once, with their largest ``page_id`` and the number of versions; staged.

    Found on two narrow columns; in a usual crawl the list is short or empty.
    """
    versions = pages.groupBy("url").agg(
        F.max("page_id").alias("_newest"), F.count(F.lit(1)).alias("_versions"))
    return stage(versions.filter(F.col("_versions") > 1).select(
        F.col("url").alias("_url"), "_newest", "_versions"), "repeated-urls")


def drop_stale(rows: DataFrame, repeated: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` (``url``, ``page_id``, ...) without those of older versions of ``repeated_urls``.

    A short list is broadcast and rows stay where they are.  With a long one the rows are
    shuffled, so they should be narrow; URLs with very many versions are still dealt with by broadcast.
    """
    stale = (F.col(url) == F.col("_url")) & (F.col("page_id") < F.col("_newest"))
    newest = repeated.drop("_versions")
    if fits(repeated):
        return rows.join(F.broadcast(newest), stale, "left_anti")
    hot = hot_keys(repeated, "_url", "_versions")
    if hot is not None:  # leaves one row of each hot URL for the join below
        rows = rows.join(F.broadcast(newest.join(hot, "_url", "left_semi")), stale, "left_anti")
    return rows.join(newest.hint("merge"), stale, "left_anti")


def latest_pages(pages: DataFrame, facts: Mapping[str, Column] | None = None, by: Sequence[str] = ("url",)) -> DataFrame:
    """One row per URL: the one with the highest ``page_id``.

    ``facts`` names what is asked of a page; only that is carried, and the newest is found by one
    aggregation.  Without it whole pages are handed out: those of older versions are
    dropped where they are scanned while the list of repeated URLs is short, and a long list
    shuffles the HTML.  Walks do not use that form.  With ``facts``, ``by`` may name other columns that tell pages apart.
    """
    if facts is None:
        if tuple(by) != ("url",):
            raise ValueError("whole pages are told apart by their URL")
        return drop_stale(pages, repeated_urls(pages))
    asked = F.struct(*[column.alias(name) for name, column in facts.items()])
    newest = pages.groupBy(*by).agg(F.max("page_id").alias("page_id"), F.max_by(asked, "page_id").alias("_facts"))
    return newest.select("page_id", *by, "_facts.*")


def read_pages(spark: SparkSession, folder: str, latest: bool = True) -> DataFrame:
    """Stored crawl pages, one row per URL."""
    pages = read_table(spark, folder, "pages")
    return latest_pages(pages) if latest else pages


def crawl_log(events: DataFrame) -> DataFrame:
    """The event table read as a crawl log: one row per request.

    Hosts and outcomes come from the user and event type; response times are scaled so
    that hosts lie on both sides of the fast and slow limits.  The divisors are powers of
    two, which makes sums of response times exact in any order.
    """
    host = F.concat(F.lit("host"), F.col("user_id") % 8)
    slot = F.col("user_id") % 4
    divisor = (F.when(slot == 0, 2048.0).when(slot == 1, 4096.0).when(slot == 2, 8192.0).otherwise(16384.0))
    kind = F.col("event_type")
    return events.select(
        F.lit("run1").alias("run_id"),
        host.alias("host"),
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "view", "listing").otherwise("product").alias("phase"),
        F.concat(F.lit("https://"), host, F.lit(".example.com/"), F.col("event_id")).alias("url"),
        F.when(kind == "error", 0).when(kind == "signup", 404).otherwise(200).alias("status"),
        F.when(kind == "error", "timeout").alias("error"),
        (F.round(F.col("value") * 100) / divisor).alias("elapsed_s"),
    )
