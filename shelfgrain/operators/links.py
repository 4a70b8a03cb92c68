"""Product links of listing pages.

All links of a page come from one row, so ranking, the per-selector and per-page caps
and the per-page distinct are array expressions: no shuffle, no window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.text import is_product_url
from ..session import fits


def product_links(
    facts: DataFrame,
    variant: str = "full",
    per_page: int | None = None,
    must_contain: str = V.PRODUCT_URL_PART,
    exclude: Sequence[str] = V.EXCLUDED_URL_PARTS,
    carried: Sequence[str] = (),
    selectors: Sequence[str] = V.LINK_SELECTORS,
) -> DataFrame:
    """One row per page and distinct product URL, at its best selector rank.

    ``facts`` needs the ``link`` column of ``parse_pages``.  The lean variant uses fewer
    selectors, in its own order, and reads a limited number of hits per selector *before*
    the URL test.  ``per_page`` keeps the first links of each page.  ``selectors`` are those the
    pages were parsed with; own ones are used by the lean variant in the order given.
    """
    hits: Column = F.col("link")
    if variant == "lean":
        lean = V.LEAN_LINK_SELECTORS if tuple(selectors) == tuple(V.LINK_SELECTORS) else selectors
        order = F.create_map(*[
            F.lit(n) for rank, selector in enumerate(lean) for n in (list(selectors).index(selector), rank)])
        hits = F.transform(
            F.filter(hits, lambda h: F.map_contains_key(order, h["rank"])
                     & (h["ord"] <= V.LEAN_LINKS_PER_SELECTOR)),
            lambda h: F.struct(order[h["rank"]].alias("rank"), h["ord"].alias("ord"), h["url"].alias("url")))
    wanted = F.filter(hits, lambda h: is_product_url(h["url"], must_contain, exclude))
    by_url = F.array_sort(F.transform(wanted, lambda h: F.struct(
        h["url"].alias("url"), h["rank"].alias("rank"), h["ord"].alias("ord"))))
    kept = facts.select(*carried, F.col("url").alias("page_url"), by_url.alias("_sorted"))
    # After the sort equal URLs are neighbours, best rank first.
    first_of_each = F.filter(F.col("_sorted"), lambda h, i: (i == 0)
                             | (F.get(F.col("_sorted"), i - 1)["url"] != h["url"]))
    ranked = F.array_sort(F.transform(first_of_each, lambda h: F.struct(
        h["rank"].alias("selector_rank"), h["ord"].alias("ord"), h["url"].alias("link"))))
    if per_page is not None:
        ranked = F.slice(ranked, 1, per_page)
    return (
        kept.select(*carried, "page_url", F.explode(ranked).alias("_l"))
        .select(*carried, "page_url", "_l.link", "_l.selector_rank", "_l.ord")
    )


def cap_links(links: DataFrame, limit: int = V.LINKS_PER_PAGE) -> DataFrame:
    """The first links per page of any link table, by selector rank and document order.

    For tables that are already exploded; ``product_links(per_page=...)`` does the same
    without a shuffle.  Spark limits each group before the shuffle as well.
    """
    place = F.row_number().over(
        Window.partitionBy("page_url").orderBy("selector_rank", "ord", "link"))
    return links.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def of_each_url(pages: DataFrame, repeated: DataFrame, make: Callable[[DataFrame], DataFrame],
                per_page: int | None = None) -> DataFrame:
    """``make(pages)`` (``page_url``, ``link``, ...) with the stored versions of a URL put together as one page.

    Each link once per URL, at its best place in any version.  ``repeated`` is that of ``repeated_urls``: while it is short, only
    links of its URLs are shuffled, and the others stay in the row they were found in.  ``per_page`` says that ``make`` keeps
    the first links of each version; those of all versions hold the first ones of the URL.
    """
    def together(links: DataFrame) -> DataFrame:
        best = links.groupBy("page_url", "link").agg(F.min(F.struct("selector_rank", "ord")).alias("_place"))
        best = best.select("page_url", "link", "_place.selector_rank", "_place.ord")
        return best if per_page is None else cap_links(best, per_page)

    if repeated.isEmpty():
        return make(pages)
    if not fits(repeated):
        return together(make(pages))
    urls = F.broadcast(repeated.select(F.col("_url").alias("url")))
    return make(pages.join(urls, "url", "left_anti")).unionByName(
        together(make(pages.join(urls, "url", "left_semi"))))


def distinct_links(*links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Union of link tables, each URL once (per ``by``)."""
    keys = [*by, "link"]
    together = links[0].select(*keys)
    for more in links[1:]:
        together = together.unionByName(more.select(*keys))
    return together.distinct()


def limit_links(links: DataFrame, limit: int = V.LEAN_LINKS_TOTAL, by: Sequence[str] = ()) -> DataFrame:
    """The first ``limit`` URLs in URL order, overall or per ``by`` columns.

    Both forms cut in every task before anything is shuffled.
    """
    if not by:
        return links.orderBy("link").limit(limit)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("link"))
    return links.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def first_distinct_links(*links: DataFrame, limit: int = V.LEAN_LINKS_TOTAL) -> DataFrame:
    """The first ``limit`` distinct URLs of link tables, in URL order.

    The same rows as ``limit_links(distinct_links(...))``, but not every URL is shuffled to keep a few:
    each task holds its ``limit`` smallest URLs and no more, and only these are merged.  Links
    without URL are none.
    """
    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            urls = batch.column(0)
            if kept is not None:
                if len(kept) == limit:  # most batches of a long task end here
                    urls = urls.filter(pc.less(urls, kept[-1]))
                urls = pa.concat_arrays([kept, urls])
            urls = pc.unique(urls)
            kept = urls.take(pc.array_sort_indices(urls)[:limit])
        if kept is not None:
            yield pa.RecordBatch.from_arrays([kept], ["link"])

    if limit <= 0:
        return links[0].select("link").limit(0)
    together = links[0].select("link")
    for more in links[1:]:
        together = together.unionByName(more.select("link"))
    few = together.filter(F.col("link").isNotNull()).mapInArrow(smallest, "link string")
    return few.distinct().orderBy("link").limit(limit)
