"""Text functions on columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from .. import fixed_values as V


def without(text: Column, parts: Sequence[str]) -> Column:
    """``text`` with every occurrence of each part deleted, one part after the other."""
    return reduce(lambda done, part: F.replace(done, F.lit(part), F.lit("")), parts, text)


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda done, part: done | text.contains(part), parts, F.lit(False))


def clean_name(name: Column) -> Column:
    """Delete the noise words, collapse blanks, strip, cut.

    The words go wherever they occur, also inside other words.  ``(?U)`` makes ``\\s``
    cover no-break and other Unicode blanks; after the collapse a plain ``trim`` suffices.
    """
    collapsed = F.regexp_replace(without(name, V.NAME_NOISE), r"(?U)\s+", " ")
    return F.left(F.trim(collapsed), F.lit(V.NAME_LENGTH))


def ellipsize(text: Column, length: int) -> Column:
    """The first ``length`` characters, followed by ``...`` when something was cut."""
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def is_valid_url(url: Column) -> Column:
    """Start-URL check: an http(s) scheme, case-sensitive, and a dot somewhere."""
    return (url.startswith("http://") | url.startswith("https://")) & url.contains(".")


def is_product_url(
    url: Column,
    must_contain: str = V.PRODUCT_URL_PART,
    exclude: Sequence[str] = V.EXCLUDED_URL_PARTS,
) -> Column:
    """Product-URL test on an absolute URL.

    Exclusions are plain substrings, so ``/product/oil-filter`` is rejected by the
    default list; pass another ``exclude`` to keep such pages.
    """
    lowered = F.lower(url)
    return lowered.contains(must_contain) & ~contains_any(lowered, exclude)


def crumb_path(parts: Column, levels: int = V.CATEGORY_LEVELS) -> Column:
    """The first ``levels`` parts joined by `` > ``; null when there is none."""
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, levels), " > "))


def spec_text(specifications: Column) -> Column:
    """A map as ``key: value; key: value``, entries with an empty side left out.

    Spark maps keep no order across a shuffle, so entries are sorted by key.
    """
    entries = F.array_sort(F.map_entries(specifications))
    filled = F.filter(
        entries, lambda e: (e["key"] != "") & e["value"].isNotNull() & (e["value"] != ""))
    return F.array_join(F.transform(filled, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
