"""A whole run in one call: walk, number, sheets, figures, publication."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..operators.crawl_log import run_stats, run_verdict
from ..operators.export import catalog_export
from ..operators.numbering import with_product_id
from ..operators.parse import parse_failures
from ..operators.summary import catalog_summary, completeness, summary_long
from ..session import stage
from ..sinks.catalog import run_path
from ..sinks.published import publish_run
from .catalog import ORDER, full_catalog_waves


def run_sheets(pages: DataFrame, bases: DataFrame, run_started: datetime, log: DataFrame | None = None,
               walk: Callable[..., DataFrame] = full_catalog_waves, optional: bool = False, **options) -> dict[str, DataFrame]:
    """The sheets of a run by name: ``products``, ``summary``, ``completeness``, and with the crawl log also ``figures`` and ``verdicts``.

    The pages are walked once: the numbered records are staged, and every sheet is made of them.
    ``log`` is the crawl log of these pages; its runs get the figures, in which pages that could not be parsed count as errors of
    the run that fetched them.
    """
    started = F.lit(f"{run_started:%Y-%m-%d %H:%M:%S}").cast("timestamp")
    products = stage(with_product_id(walk(pages, bases, run_ts=started, **options), ["base_url", *ORDER]), "run-products")
    stamp = F.lit(f"{run_started:%Y%m%d_%H%M%S}")
    sheets = {
        "products": catalog_export(products, optional),
        "summary": summary_long(catalog_summary(products, ("product_id",)), stamp),
        "completeness": completeness(products),
    }
    if log is not None:
        fetched = log.select("run_id", "url").distinct()
        found = fetched.join(products.select(F.col("source_url").alias("url")), "url").select("run_id")
        failed = fetched.join(parse_failures(pages).select("url").distinct(), "url").select("run_id")
        figures = stage(run_stats(log, found, failed), "run-figures")
        sheets |= {"figures": figures, "verdicts": run_verdict(figures)}
    return sheets


def catalog_run(pages: DataFrame, bases: DataFrame, folder: str, run_started: datetime, name: str | None = None,
                log: DataFrame | None = None, **options) -> str:
    """Make a run and publish all its sheets below ``folder`` at once; the name it is published under."""
    run = run_path("", run_started, name=name).lstrip("/")
    publish_run(run_sheets(pages, bases, run_started, log, **options), folder, run)
    return run
