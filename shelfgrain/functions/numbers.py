"""Number functions on columns.

``format_number`` rounds the exact binary value half-even; ``format_string('%.2f')``
does not, so it is never used here.  Casts are ``try_cast``: under ANSI mode a plain cast
of bad text would abort the job.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V

NUMERIC = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def to_number(text: Column) -> Column:
    """Text to double, null when it is no number.

    The pattern is needed because ``try_cast`` also accepts Java forms such as ``1d``;
    ``nan`` and ``inf`` are no prices and become null as well.
    """
    return F.when(text.rlike(NUMERIC), F.trim(text).try_cast("double"))


def money_text(amount: Column) -> Column:
    """``KSh 1,234.50``."""
    return F.concat(F.lit(V.CURRENCY_MARKS[0] + " "), F.format_number(amount, 2))


def fixed_point(number: Column, digits: int) -> Column:
    return F.replace(F.format_number(number, digits), F.lit(","), F.lit(""))


def fmt2(number: Column) -> Column:
    """Two decimals, no thousands separator."""
    return fixed_point(number, 2)


def format_duration(seconds: Column) -> Column:
    """``12.3s`` below a minute, ``1.2m`` below an hour, else ``1.2h``."""
    return (
        F.when(seconds < 60, F.concat(fixed_point(seconds, 1), F.lit("s")))
        .when(seconds < 3600, F.concat(fixed_point(seconds / 60, 1), F.lit("m")))
        .otherwise(F.concat(fixed_point(seconds / 3600, 1), F.lit("h")))
    )
