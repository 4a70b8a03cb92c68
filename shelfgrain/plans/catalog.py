"""The three catalog walks, end to end.

Each takes stored pages and a table of base URLs and returns product records with
``base_url`` and the order columns.  A walk reads its listing pages, follows their product
links, extracts the linked pages and removes duplicates - set at a time, for all bases at
once.  Pages are parsed where they are scanned; only links and records are shuffled.  Of several
stored versions of a page, the newest usable one counts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.text import is_product_url
from ..operators.crawl_log import within_budget
from ..operators.dedup import dedup_products
from ..operators.joins import hot_keys
from ..operators.links import limit_links, product_links
from ..operators.paging import last_page, page_yield, stop_after_empty
from ..operators.parse import parse_pages
from ..operators.products import extract_products
from ..session import fits, gathered, sized, stage
from ..sources.frontier import fetch_join, listing_frontier, listings_of, usable
from ..sources.page_store import asked_in_store
from ..sources.tables import drop_stale, repeated_urls

ORDER = ("page_no", "selector_rank", "ord", "source_url")
FIRST_WAVE = 8               # listing pages of a base read in the first wave
BROADCAST_BYTES = 64 << 20   # of linked URLs sent to the tasks that scan pages


@dataclass(frozen=True)
class Rules:
    """Which links of a listing page are followed, and own selectors by field (``link`` among them)."""

    must_contain: str = V.PRODUCT_URL_PART
    exclude: Sequence[str] = V.EXCLUDED_URL_PARTS
    selectors: Mapping[str, tuple[str, ...]] | None = None


USUAL = Rules()


def within_time(frontier: DataFrame, pages: DataFrame, seconds: float, share: float | None = None,
                keep_empty: bool = False) -> DataFrame:
    """Frontier rows whose page was fetched within the time budget of its base.

    Needs ``fetched_at``.  Only the frontier's own columns and the time are compared, so the
    HTML takes no part; see ``within_budget`` for what ``share`` means.
    """
    times = fetch_join(frontier, pages, keep_empty, {"fetched_at": F.col("fetched_at")})
    reached = times.groupBy("base_url", "page_no", "url").agg(F.max("fetched_at").alias("ts")).select(
        F.col("base_url").alias("run_id"), F.col("page_no").alias("id"), "ts", "url")
    kept = within_budget(stage(reached, "reached-pages"), seconds, share)
    return stage(kept.select(
        F.col("run_id").alias("base_url"), F.col("id").alias("page_no"), "url"), "pages-in-time")


def newest(pages: DataFrame, stored: DataFrame, made_url: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make(pages)`` for the newest version of each URL of ``stored``; ``page_id`` does not come out.

    While few URLs are stored more than once, old versions are dropped before they are parsed,
    else afterwards: what is shuffled is then what ``make`` has made, by its column ``made_url``.
    """
    if "page_id" not in pages.columns:
        return make(pages)
    repeated = repeated_urls(stored)
    if fits(repeated):
        return make(drop_stale(pages, repeated)).drop("page_id")
    return drop_stale(make(pages), repeated, made_url).drop("page_id")


def listing_links(bases: DataFrame, pages: DataFrame, max_pages: int, style: str = "auto", variant: str = "full",
                  per_page: int | None = None, rules: Rules = USUAL, in_time: DataFrame | None = None, first_page: int = 1) -> DataFrame:
    """Product links of the listing pages of all bases, from ``first_page`` to ``max_pages``.

    ``in_time`` (base_url, page_no) limits the pages that are walked.
    """
    place = ["base_url", "page_no"]
    found = usable(pages, keep_empty=variant == "lean")
    version = ["page_id"] if "page_id" in pages.columns else []
    listings, open_bases = listings_of(bases, found.select(*version, "url", "html"), max_pages, style)
    if first_page > 1:   # a filter on the URL, before anything is parsed
        listings = listings.filter(F.col("page_no") >= first_page)
    selectors = (rules.selectors or {}).get("link", V.LINK_SELECTORS)

    def links(of: DataFrame) -> DataFrame:
        facts = parse_pages(of, ["link"], {"link": tuple(selectors)})
        return product_links(facts, variant, per_page, rules.must_contain, rules.exclude, [*place, *version], selectors)

    made = newest(listings, found, "page_url", links)
    if open_bases is not None:
        made = made.join(open_bases.hint("merge"), "base_url", "left_semi")
    if in_time is not None:
        made = made.join(sized(in_time.select(*place)), place, "left_semi")
    return made


def wanted_pages(pages: DataFrame, asked: DataFrame, by_url: bool = False) -> DataFrame:
    """Those of ``pages`` that ``asked`` (source_url) names if these are few enough to be broadcast, else all.

    Pages of a store laid out ``by_url`` meet any number of URLs where they lie.
    """
    urls = stage(gathered(asked.select(F.col("source_url").alias("url")).distinct()), "asked-urls")
    size = urls.agg(F.sum(F.octet_length("url"))).first()[0] or 0
    if fits(urls) and size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(urls), "url", "left_semi")
    return asked_in_store(pages, urls) if by_url else pages


def product_lookup(links: DataFrame, pages: DataFrame, variant: str = "full",
                   run_ts: Column | None = None, rules: Rules = USUAL, by_url: bool = False, **options) -> DataFrame:
    """Product records of the linked pages, with the columns of ``links``.

    Pages that no link names are not parsed: while the linked URLs are few they are broadcast to
    the scan of the pages; beyond that they are shuffled to pages that a store holds ``by_url``, and of
    any other pages those are parsed that pass the URL test of ``rules``, which all links have passed.  Records, not pages, go through the join.  A product that is linked from very
    many pages is joined by broadcast, its rows staying where they are.  The links are staged
    because they are counted first.
    """
    asked = stage(gathered(links.withColumnRenamed("link", "source_url")), "links")
    stored = usable(pages, keep_empty=variant == "lean").filter(
        is_product_url(F.col("url"), rules.must_contain, rules.exclude))
    columns = [c for c in ("page_id", "url", "html", "fetched_at") if c in pages.columns]
    candidates = wanted_pages(stored.select(*columns), asked, by_url)
    selectors = dict(rules.selectors) if rules.selectors else None

    def records(of: DataFrame) -> DataFrame:
        return newest(of, stored, "source_url",
                      lambda some: extract_products(some, variant, run_ts, selectors=selectors, **options))

    hot = hot_keys(asked.groupBy("source_url").agg(F.count(F.lit(1)).alias("_rows")), "source_url")
    if hot is None:
        return asked.join(records(candidates), "source_url")
    is_hot = F.col("url") == F.col("source_url")
    often = asked.join(hot, "source_url", "left_semi").join(  # one record per hot URL: older versions are gone
        F.broadcast(records(candidates.join(hot, is_hot, "left_semi"))), "source_url")
    rest = asked.join(hot, "source_url", "left_anti").join(
        records(candidates.join(hot, is_hot, "left_anti")), "source_url")
    return often.unionByName(rest)


def first_links(links: DataFrame) -> DataFrame:
    """Each link once per base, at its first place; a page linked twice is looked up once.

    The place (page, selector, order on the page) is packed into one number: its minimum is
    a hash aggregate, where the minimum of a struct would have to sort all links.  A place that
    does not fit (256 selectors, 8 million pages of a base) raises an error.
    """
    packed = (
        F.shiftleft(F.col("page_no").cast("long"), 40)
        + F.shiftleft(F.col("selector_rank").cast("long"), 32) + F.col("ord"))
    fitting = (F.col("page_no") < 1 << 23) & (F.col("selector_rank") < 1 << 8)
    place = F.when(fitting, packed).otherwise(F.raise_error(F.lit("the place of a link is out of range")).cast("long"))
    first = links.groupBy("base_url", "link").agg(F.min(place).alias("_place"))
    return first.select(
        "base_url", "link",
        F.shiftright("_place", 40).cast("int").alias("page_no"),
        F.shiftright("_place", 32).bitwiseAND(F.lit(255)).cast("int").alias("selector_rank"),
        F.col("_place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("ord"))


def site_catalog(
    pages: DataFrame, bases: DataFrame, max_pages: int = V.FULL_LISTING_PAGES,
    per_page: int = V.LINKS_PER_PAGE, run_ts: Column | None = None, rules: Rules = USUAL, **options,
) -> DataFrame:
    """The usual walk: ``max_pages`` listing pages per base, duplicates by name."""
    links = first_links(listing_links(bases, pages, max_pages, per_page=per_page, rules=rules))
    products = product_lookup(links, pages, run_ts=run_ts, rules=rules, **options)
    return dedup_products(products, "name", ORDER, within=["base_url"])


def full_catalog(
    pages: DataFrame, bases: DataFrame, per_page: int = V.LINKS_PER_PAGE,
    max_pages: int = V.FULL_LISTING_PAGES, run_ts: Column | None = None, max_time: float | None = None,
    rules: Rules = USUAL, **options,
) -> DataFrame:
    """The full walk: listing pages until three in a row give no product.

    With ``max_time``, listing pages fetched later than that many seconds after the first one
    of their base are not walked.

    The stop page is found from the yield of all pages, so the records (one per listing
    page and link: a product listed twice counts on both pages) are staged and used twice.
    """
    frontier = listing_frontier(bases, max_pages, style="full")
    in_time = None if max_time is None else within_time(frontier, pages, max_time)
    links = listing_links(bases, pages, max_pages, "full", per_page=per_page, rules=rules, in_time=in_time)
    products = stage(gathered(product_lookup(links, pages, run_ts=run_ts, rules=rules, **options)), "walked-products")
    kept = stop_after_empty(products, page_yield(products, frontier))
    return dedup_products(kept, "name", ORDER, within=["base_url"]).drop("page_url")


def full_catalog_waves(
    pages: DataFrame, bases: DataFrame, per_page: int = V.LINKS_PER_PAGE,
    max_pages: int = V.FULL_LISTING_PAGES, run_ts: Column | None = None, max_time: float | None = None,
    rules: Rules = USUAL, first_wave: int = FIRST_WAVE, **options,
) -> DataFrame:
    """The full walk in waves of listing pages, each twice as wide as the one before.

    The same records as ``full_catalog``, but a base takes part only until it has stopped: a wave parses
    its own listing pages of the bases that are still open, looks up the products these link, and the
    bases that have met enough empty pages are closed.  So at most about as many pages are
    parsed beyond the stop of a base as before it, whatever ``max_pages`` is, and the number of waves grows with its logarithm.
    The state is one row per open base: how many empty pages its walk ends with so far.  Each wave scans the
    stored pages again, so this walk pays where parsing outweighs scanning: many pages beyond the stops, or a store that prunes by URL.
    """
    in_time = None
    if max_time is not None:
        in_time = within_time(listing_frontier(bases, max_pages, style="full"), pages, max_time)
    state = stage(bases.select("base_url").distinct().withColumn("_streak", F.lit(0)), "open-bases")
    low, width, walked = 1, max(first_wave, 1), []
    while low <= max(max_pages, 1) and not state.isEmpty():
        high = min(low + width - 1, max(max_pages, 1))
        links = listing_links(state.select("base_url"), pages, high, "full", per_page=per_page, rules=rules, in_time=in_time, first_page=low)
        products = stage(gathered(product_lookup(links, pages, run_ts=run_ts, rules=rules, **options)), "wave-products")
        numbers = F.explode(F.sequence(F.lit(low), F.lit(high)))
        yields = stage(page_yield(products, state.select("base_url", numbers.alias("page_no"))), "wave-yields")
        stops = stage(last_page(yields.unionByName(streaks(state, low))), "stops")
        closed = sized(stops)
        kept = products.join(closed, "base_url", "left").filter(F.col("last_page").isNull() | (F.col("page_no") <= F.col("last_page")))
        walked.append(kept.select(*products.columns))
        ends = yields.groupBy("base_url").agg(F.max(F.when(F.col("found") > 0, F.col("page_no"))).alias("_full"))
        state = stage(state.join(closed, "base_url", "left_anti").join(ends, "base_url").select(
            "base_url", (F.lit(high) - F.coalesce("_full", F.lit(low - 1) - F.col("_streak"))).alias("_streak")), "open-bases")
        low, width = high + 1, 2 * width
    return dedup_products(reduce(DataFrame.unionByName, walked), "name", ORDER, within=["base_url"]).drop("page_url")


def streaks(state: DataFrame, low: int) -> DataFrame:
    """The empty pages just before page ``low`` that the walk of each open base ends with."""
    pages = F.explode(F.sequence(F.lit(low) - F.col("_streak"), F.lit(low - 1)))
    return state.filter("_streak > 0").select("base_url", pages.alias("page_no"), F.lit(0).cast("long").alias("found"))


def lean_catalog(
    pages: DataFrame, bases: DataFrame, max_pages: int = V.LEAN_LISTING_PAGES,
    limit: int = V.LEAN_LINKS_TOTAL, run_ts: Column | None = None,
    key: str | tuple[str, ...] = ("name", "source_url"), max_time: float | None = None, rules: Rules = USUAL,
) -> DataFrame:
    """The lean walk: few listing pages, a limited number of links per base, few fields.

    With ``max_time``, reading links may use its share of that time; the listing page that
    crosses the share is still read.
    """
    in_time = None
    if max_time is not None:
        in_time = within_time(listing_frontier(bases, max_pages), pages, max_time, V.LINK_BUDGET_SHARE, keep_empty=True)
    links = first_links(listing_links(bases, pages, max_pages, variant="lean", rules=rules, in_time=in_time))
    products = product_lookup(limit_links(links, limit, by=["base_url"]), pages, "lean", run_ts, rules)
    return dedup_products(products, key, ORDER, within=["base_url"])
