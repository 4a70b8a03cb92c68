"""HTML to page facts: the one step that runs Python, once per page.

``parse_pages`` ships Arrow batches of HTML to the Python workers and gets back a few
short, nested columns, one per requested field.  The HTML column ends here: no later
operator carries or shuffles it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .. import fixed_values as V, schemas
from ..session import ship_package
from .page_hits import REFERENCES, Matcher, PageHits

SELECTORS = {
    "link": V.LINK_SELECTORS,
    "name": V.NAME_SELECTORS,
    "price": V.PRICE_SELECTORS,
    "sku": V.SKU_SELECTORS,
    "brand": V.BRAND_SELECTORS,
    "category": V.CATEGORY_SELECTORS,
    "description": V.DESCRIPTION_SELECTORS,
    "stock": V.STOCK_SELECTORS,
    "image": V.IMAGE_SELECTORS,
}
# Hits kept per selector; fields that are not listed keep all of them.
TAKES = {
    "name": 1, "sku": 1, "brand": 1, "description": 1, "stock": 1,
    "image": V.IMAGES_PER_SELECTOR,
}
WATCH_WORDS = V.WARRANTY_WORDS + V.SHIPPING_WORDS
FULL_FIELDS = ("name", "price", "sku", "brand", "category", "description", "stock", "image",
               "jsonld", "words")
LEAN_FIELDS = ("name", "price", "image")


def parse_pages(
    pages: DataFrame,
    fields: tuple[str, ...] | list[str],
    selectors: dict[str, tuple[str, ...]] | None = None,
    min_text: int | None = None,
    with_text: bool = False,
    whole_prices: bool = True,
) -> DataFrame:
    """Parse each page once and return its facts.

    ``fields`` names the columns to produce (Catalyst cannot prune inside the Python
    step, so the caller does): any key of ``SELECTORS`` plus ``jsonld`` (scripts that are JSON) and
    ``words`` (which of the watched words the page text contains, so that the text itself
    need not come back).  ``selectors`` replaces the ranked selectors of single fields.

    Without ``whole_prices`` the text of a price hit is only what decides about its amount, see
    ``PageHits.amounts``; whole texts of elements inside each other repeat the page's text over and over.

    With ``min_text`` set, pages that cannot be products - no title, or less text - are
    dropped: those without any ``<title`` or with too little HTML never leave the JVM.  Pages that
    cannot be parsed are dropped as well; ``parse_failures`` lists them.

    All columns of ``pages`` other than ``html`` are passed through.  A page that cannot be
    parsed keeps its row, with ``error`` set and no hits.
    """
    used = {**SELECTORS, **(selectors or {})}
    unknown = [f for f in fields if f not in used and f not in ("jsonld", "words")]
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")
    hit_fields = [f for f in used if f in fields]
    ranked = {f: tuple(used[f]) for f in hit_fields}
    if "price" in ranked:
        ranked["area"] = V.AREA_SELECTORS
    takes = {f: TAKES.get(f) for f in hit_fields}

    kept = [f for f in pages.schema.fields if f.name != "html"]
    out = [
        T.StructField("has_title", T.BooleanType()),
        T.StructField("text_len", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
    if with_text:
        out.append(T.StructField("text", T.StringType()))
    if "words" in fields:
        out.append(T.StructField("words", T.ArrayType(T.StringType())))
    if "jsonld" in fields:
        out.append(T.StructField("jsonld", T.ArrayType(T.StringType())))
    out += [
        T.StructField(f, schemas.hits("url" if f in REFERENCES else "text", area=f == "price"))
        for f in hit_fields
    ]
    schema = T.StructType(kept + out)
    kept_names = [f.name for f in kept]

    def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(ranked, takes)
        for batch in batches:
            parsed = [
                _parse_one(html, url, matcher)
                for html, url in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist())
            ]
            columns = {name: batch.column(name) for name in kept_names}
            columns["has_title"] = pa.array([p is not None and p.has_title for p, _ in parsed], pa.bool_())
            columns["text_len"] = pa.array([p.text_len if p else 0 for p, _ in parsed], pa.int32())
            columns["error"] = pa.array([e for _, e in parsed], pa.string())
            if with_text:
                columns["text"] = pa.array([p.text if p else "" for p, _ in parsed], pa.string())
            if "words" in fields:
                columns["words"] = pa.array([_watched(p) for p, _ in parsed], pa.list_(pa.string()))
            if "jsonld" in fields:
                columns["jsonld"] = pa.array(
                    [list(filter(_is_json, p.jsonld)) if p else [] for p, _ in parsed], pa.list_(pa.string()))
            for field in hit_fields:
                columns[field] = _hit_column(field, [p for p, _ in parsed], whole_prices)
            made = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            if min_text is not None:
                made = made.filter(pa.array(
                    [p is not None and p.has_title and p.text_len >= min_text for p, _ in parsed]))
            yield made

    ship_package(pages.sparkSession)
    source = pages
    if min_text is not None:
        source = source.filter(F.col("html").rlike("(?i)<title") & (F.length("html") >= min_text))
    return source.mapInArrow(parse_batches, schema)


def _parse_one(html: str | None, url: str, matcher: Matcher) -> tuple[PageHits | None, str | None]:
    if html is None:
        return None, "no body"
    try:
        return PageHits(html, url, matcher, V.JSONLD_TYPE), None
    except Exception as problem:  # one bad page must not fail the task
        return None, f"{type(problem).__name__}: {problem}"


def _is_json(script: str) -> bool:
    """Whether a whole script is JSON; ``from_json`` alone would accept text after it."""
    try:
        json.loads(script)
    except (ValueError, RecursionError):
        return False
    return True


def _watched(page: PageHits | None) -> list[str]:
    if page is None:
        return []
    text = page.text.lower()
    return [word for word in WATCH_WORDS if word in text]


def _hit_column(field: str, pages: list[PageHits | None], whole_prices: bool) -> pa.Array:
    offsets, ranks, ords, areas, values = [0], [], [], [], []
    for page in pages:
        if page is None:
            hits = ()
        else:
            hits = page.found(field) if field != "price" or whole_prices else page.amounts(field, V.CURRENCY_MARKS)
        for rank, order, area, value in hits:
            if field == "price":
                inside = page.area is not None and bool(area >> page.area & 1)
                if not inside and order > V.LEAN_PRICES_PER_SELECTOR:
                    continue
                areas.append(inside)
            ranks.append(rank)
            ords.append(order)
            values.append(value)
        offsets.append(len(values))
    parts = [pa.array(ranks, pa.int32()), pa.array(ords, pa.int32())]
    names = ["rank", "ord"]
    if field == "price":
        parts.append(pa.array(areas, pa.bool_()))
        names.append("in_area")
    parts.append(pa.array(values, pa.string()))
    names.append("url" if field in REFERENCES else "text")
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, names))


def parse_failures(pages: DataFrame) -> DataFrame:
    """Pages that hold no HTML or could not be parsed, with the reason: all columns but the HTML, and ``error``.

    The ledger to the records of ``extract_products``, which leaves such pages out.
    """
    kept = [c for c in pages.columns if c != "html"]
    return parse_pages(pages, ()).filter(F.col("error").isNotNull()).select(*kept, "error")


def valid_page(min_text: int = V.MIN_PAGE_TEXT):
    """Page validity: it has a title and enough text."""
    return F.col("has_title") & (F.col("text_len") >= min_text)
