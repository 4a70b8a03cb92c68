"""Date functions on columns; the session zone is UTC (see ``session.tune``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp_text(moment: Column) -> Column:
    """Timestamp as text, fraction of the second cut; years beyond 9999 have five digits and no sign."""
    return F.ltrim(F.date_format(moment, STAMP), F.lit("+"))


def epoch_text(seconds: Column) -> Column:
    """Epoch seconds as text, fraction cut."""
    return stamp_text(F.timestamp_seconds(seconds))
