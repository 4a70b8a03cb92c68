"""Joins of many rows to a lookup with one row per key, safe against hot keys.

Adaptive skew splitting goes by compressed bytes, and a million rows of one key compress to
little, so it does not see them.  Keys are therefore counted: those with many rows are
joined by broadcast, where rows stay in their task, and the rest by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import fits, stage

MOST_HOT_KEYS = 10_000      # bounds what is broadcast
MIN_HOT_ROWS = 1_000_000    # fewer rows than this are no trouble for one task


def hot_keys(counts: DataFrame, key: str, rows: str = "_rows") -> DataFrame | None:
    """Keys holding too many rows, ready to be broadcast; None when there are none.

    A hot key has more than one ten-thousandth of all rows, so there are at most
    ``MOST_HOT_KEYS`` of them whatever the data.
    """
    known = counts.filter(F.col(key).isNotNull())
    total, largest = known.agg(F.sum(rows), F.max(rows)).first()
    least = max(MIN_HOT_ROWS, (total or 0) / MOST_HOT_KEYS)
    if (largest or 0) <= least:
        return None
    return F.broadcast(stage(known.filter(F.col(rows) > least).select(key), "hot-keys"))


def lookup_join(rows: DataFrame, lookup: DataFrame, counts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined on ``key`` to a stored ``lookup`` that has one narrow row per key.

    ``counts`` holds the rows per key.  A small lookup is broadcast whole.
    """
    if fits(lookup):
        return rows.join(F.broadcast(lookup), key, how)
    hot = hot_keys(counts, key)
    if hot is None:
        return rows.join(lookup.hint("merge"), key, how)
    few = F.broadcast(lookup.join(hot, key, "left_semi"))
    return (
        rows.join(hot, key, "left_semi").join(few, key, how)
        .unionByName(rows.join(hot, key, "left_anti").join(lookup.hint("merge"), key, how))
    )
