"""Failures as they become known: asked and landed URLs as two streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.frontier import why_unusable

BEAT = ""   # the URL of rows that only move time on


def stream_outcomes(asked: DataFrame, landed: DataFrame, deadline: str, delay: str, keep_empty: bool = False) -> DataFrame:
    """What became of every request: a row per page that landed for it in time, or one without page.

    ``asked`` (url, asked_at) and ``landed`` (url, page_id, html, landed_at, perhaps status) are
    streams.  A page belongs to a request if it lands from the time of asking up to ``deadline``
    later (Spark interval texts).  A request without a page comes out once both streams have passed its deadline by
    ``delay``, the most by which rows of a stream may be out of order.  State: requests and pages (flags, not
    HTML) younger than deadline and delay.

    Time moves only with rows, so a stream that falls silent leaves its last requests open.  Rows with
    the URL ``""`` (a beat) in both streams move it on; ``fetch_ledger`` leaves them out.  They are not
    filtered here: the filter would be pushed below the watermarks, and time would stand still.
    """
    requests = asked.select("url", F.col("asked_at").cast("timestamp").alias("asked_at")).withWatermark("asked_at", delay)
    flags = landed.select(
        F.col("url").alias("_url"), F.col("landed_at").cast("timestamp").alias("landed_at"),
        F.col("page_id"), why_unusable(landed, keep_empty).alias("reason")).withWatermark("landed_at", delay)
    in_time = (
        (F.col("url") == F.col("_url")) & (F.col("landed_at") >= F.col("asked_at"))
        & (F.col("landed_at") <= F.col("asked_at") + F.expr(f"INTERVAL {deadline}")))
    return requests.join(flags, in_time, "left_outer").select("url", "asked_at", "landed_at", "page_id", "reason")


def fetch_ledger(outcomes: DataFrame) -> DataFrame:
    """One row per request (url, asked_at) of a table of ``stream_outcomes``, with ``reason``: null if it was fetched.

    As in ``fetch_failures``: a request has failed if no page that landed for it is usable, and the newest
    version (largest ``page_id``) says why.  A request that was repeated within the stream is one.  The
    table only grows; a request can appear with a failed page first and be fetched later.
    """
    no_page = F.col("landed_at").isNull()
    usable = F.max(~no_page & F.col("reason").isNull())
    newest: Column = F.max_by("reason", F.struct(F.col("page_id"), F.col("landed_at"), F.col("reason")))
    told = outcomes.filter(F.col("url").isNull() | (F.col("url") != BEAT)).groupBy("url", "asked_at").agg(
        usable.alias("_usable"),
        F.coalesce(newest, F.lit("not crawled")).alias("_reason"))
    return told.select("url", "asked_at", F.when(~F.col("_usable"), F.col("_reason")).alias("reason"))


def failures(outcomes: DataFrame) -> DataFrame:
    """The requests of ``fetch_ledger`` that failed."""
    return fetch_ledger(outcomes).filter(F.col("reason").isNotNull())
