"""First record per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def dedup_products(
    products: DataFrame,
    key: str | Sequence[str] = "name",
    order: Sequence[str] = ("page_id",),
    within: Sequence[str] = (),
) -> DataFrame:
    """Keep the first record, in ``order``, of each key; rows with an empty key are dropped.

    Keys in use: ``name`` (full catalog: two parts of one title collapse), the pair
    ``["name", "source_url"]`` and ``source_url`` (lean).  ``within`` limits the search to
    one run, shop or base.  ``min_by`` aggregates in every task before the shuffle, so a key
    that holds a third of all rows still sends one record per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    groups = [*within, *[k for k in keys if k not in within]]
    others = [c for c in products.columns if c not in groups]
    filled = products
    for k in keys:
        filled = filled.filter(F.col(k).isNotNull() & (F.col(k) != ""))
    first = filled.groupBy(*groups).agg(
        F.min_by(F.struct(*others), F.struct(*order)).alias("_first"))
    return first.select(*[
        F.col(c) if c in groups else F.col(f"_first.{c}").alias(c) for c in products.columns])
