"""Write the catalog and its summary as tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from ..fixed_values import FILE_PREFIX


def run_path(folder: str, run_ts: datetime, prefix: str = FILE_PREFIX, name: str | None = None) -> str:
    """``folder/prefix_yyyyMMdd_HHmmss``, or ``folder/name`` when a name is given.

    Spark makes missing folders when it writes.
    """
    return f"{folder.rstrip('/')}/{name or f'{prefix}_{run_ts:%Y%m%d_%H%M%S}'}"


def write_catalog(catalog: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write the product sheet below ``path``; an existing run is never overwritten."""
    target = f"{path}/products"
    writer = catalog.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(target)
    return target


def write_summary(summary: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write the summary sheet (ten rows, so one file) next to the product sheet."""
    target = f"{path}/summary"
    writer = summary.coalesce(1).write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(target)
    return target
