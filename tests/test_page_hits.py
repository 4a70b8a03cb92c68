"""The parse helper on hand-made markup, and against the standard tokenizer."""

import re
import time
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from hypothesis import given, settings, strategies as st

from shelfgrain import fixed_values as V
from shelfgrain.operators.page_hits import Matcher, PageHits, absolute
from shelfgrain.operators.parse import SELECTORS, TAKES

URL = "https://shop.example.com/product/x"


def parse(html, selectors=None, url=URL):
    used = dict(selectors or SELECTORS)
    takes = {f: TAKES.get(f) for f in used}
    if "price" in used:
        used["area"] = V.AREA_SELECTORS
    return PageHits(html, url, Matcher(used, takes), V.JSONLD_TYPE)


def values(html, field, **kwargs):
    return [hit[3] for hit in parse(html, **kwargs).hits[field]]


def test_hit_text_glues_stripped_nodes():
    assert values("<h1> Front <b> Bumper </b></h1>", "name") == ["FrontBumper"]
    assert values("<h1>Front <!-- x --> Bumper</h1>", "name") == ["FrontBumper"]
    assert values("<h1>Front </i> Bumper</h1>", "name") == ["Front  Bumper"]  # stray end tag


def test_tag_soup():
    page = parse('<html><head><title>t</title></head><body><p><b>one<br>two<p>three<script>var t="</p>";'
                 "</script><div>four<style>p{}</style></div><!-- no --></body></html>")
    assert page.text == "tonetwothreefour"
    assert page.has_title and page.text_len == 16


def test_blank_runs_collapse_and_template_is_no_text():
    page = parse("\n <html>\n  \n<body><p>a</p>  <p>b</p><template>hidden</template></body></html>\n\n")
    assert page.text == "\na b"


def test_entities():
    assert parse("<p>a &amp; b &lt;c&gt; &#233; &copy x &nosuch;</p>").text == "a & b <c> é &copy x &nosuch;"
    assert values('<a href="/product/a?x=1&amp;copy=2&reg=3">', "link") == [
        "https://shop.example.com/product/a?x=1&copy=2&reg=3"]


def test_attribute_forms():
    html = ("<a HREF='/product/1'>x</a><a href=/product/2/>x</a><a href = \"/product/3?a=>\">x</a>"
            "<a href='/product/4' href='/product/5'>x</a><a href>x</a>")
    assert values(html, "link", selectors={"link": SELECTORS["link"][:1]}) == [
        f"https://shop.example.com/product/{n}" for n in ("1", "2/", "3?a=>", "4")]


def test_first_hit_per_selector_and_rank_order():
    html = '<h1>Last</h1><h1 class="entry-title">abc</h1><h1 class="x product_title">Real</h1>'
    assert parse(html).hits["name"] == [
        [0, 1, 0, "abc"], [1, 1, 0, "Real"], [3, 1, 0, "Real"], [4, 1, 0, "abc"], [5, 1, 0, "Last"]]


def test_descendant_selectors_need_ancestors_in_order():
    html = ('<div class="product_meta"><span class="posted_in"><a>In</a></span></div>'
            '<span class="posted_in"><div class="product_meta"><a>Out</a></div></span>'
            '<div class="breadcrumb"><p><a>Deep</a></p></div><a class="category">No</a>')
    assert values(html, "category") == ["In", "Deep"]


def test_class_tokens_are_whole_words():
    assert values('<p class="prices">KSh 5</p><p class="a price b">KSh 6</p>', "price") == ["KSh 6"]


def test_area_is_first_element_of_best_selector():
    html = ('<div class="summary"><p class="price">KSh 1</p></div>'
            '<div class="entry-summary"><p class="price">KSh 2</p></div>'
            '<div class="entry-summary"><p class="price">KSh 3</p></div>')
    page = parse(html)
    assert page.area == 2
    assert [(h[2] >> page.area & 1, h[3]) for h in page.hits["price"]] == [
        (0, "KSh 1"), (1, "KSh 2"), (0, "KSh 3")]


def test_area_element_is_not_inside_itself():
    page = parse('<div class="summary price">KSh 5<span class="price">KSh 6</span></div>')
    assert [(h[2] >> page.area & 1, h[3]) for h in page.hits["price"]] == [(0, "KSh 5KSh 6"), (1, "KSh 6")]


def test_images_take_first_filled_address_and_keep_their_order_number():
    html = ('<div class="product-image"><img src=""><img src="" data-src="b.jpg"><img src="/c.jpg">'
            '<img src="d.jpg"></div>')
    assert parse(html).hits["image"] == [
        [1, 2, 0, "https://shop.example.com/product/b.jpg"], [1, 3, 0, "https://shop.example.com/c.jpg"]]


def test_jsonld_scripts_only_of_exact_type():
    html = ('<script type="application/ld+json">{"a":"</p>"}</script><script type="text/x">1</script>'
            '<SCRIPT TYPE="application/ld+json">2</SCRIPT><script type="application/ld+json"></script>')
    assert parse(html).jsonld == ['{"a":"</p>"}', "2"]


def test_end_tags_do_not_reach_across_blocks():
    assert values('<span class="sku">A<div>B</span>C</div>D', "sku") == ["ABCD"]
    assert values('<div class="sku">A<b>B</div>C', "sku") == ["AB"]


def test_self_closed_elements_are_empty():
    assert values('<span class="sku"/>x<span class="brand">y</span>', "brand") == ["y"]
    assert values('<span class="sku"/>x', "sku") == [""]


def test_unfinished_markup():
    assert parse("<p>a <!-- never closed").text == "a "
    assert parse("<script>var a = 1;").text == ""
    assert parse("a < b and <3").text == "a < b and <3"
    assert parse("<p>a <!-- open > b").text == "a "
    assert parse("<p>a<!-- x > y --> b <!-- <p> --><i>c</i> d <!doctype").text == "a b c d "
    assert parse("<p>a</p> > b <i c").text == "a > b <i c"
    assert parse("<p>a</p> b </").text == "a b "
    assert parse("<!---->a<!-->b-->c").text == "ac"
    assert parse("").text_len == 0


def test_selectors_outside_the_grammar_are_refused():
    with pytest.raises(ValueError):
        parse("", {"name": ("h1 > b",)})


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.links, self.raw = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.raw += tag in ("script", "style")
        if tag == "a" and dict(attrs).get("href"):
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        self.raw -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.raw:
            self.nodes.append(data)


WORD = st.text("abcdé&;<>'\"= /\n", min_size=1, max_size=8)
ESCAPED = WORD.map(lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))


@st.composite
def trees(draw, depth=3):
    tag = draw(st.sampled_from(["div", "span", "section", "b", "script", "a", "br"]))
    if tag == "script":
        return "<script>var a = '<b>' + \"x\";</script>"
    if tag == "br":
        return "<br>"
    attribute = ""
    if tag == "a":
        target = draw(st.text("abc/?=&'", min_size=1, max_size=6)).replace("&", "&amp;")
        attribute = f' href="{target}"'
    inner = draw(st.lists(ESCAPED if depth == 0 or tag in ("a", "b") else st.one_of(ESCAPED, trees(depth - 1)),
                          max_size=4))
    return f"<{tag}{attribute}>{''.join(inner)}</{tag}>"


@settings(max_examples=300, deadline=None)
@given(st.lists(trees(), min_size=1, max_size=5))
def test_agrees_with_the_standard_tokenizer(parts):
    html = "<html><body>" + "".join(parts) + "</body></html>"
    plain = Plain()
    plain.feed(html)
    plain.close()
    page = parse(html, {"link": ("a[href]",)}, url="")
    strip = lambda text: "".join(text.split())
    assert strip(page.text) == strip("".join(plain.nodes))
    assert [h[3] for h in page.hits["link"]] == plain.links


PARTS = st.sampled_from(
    ["http://", "https://", "HTTPS://", "//", "/", "a", "B-1", "..", ".", ";", "?", "#", "=", "&", "%20", "é", " ", "\t",
     "shop.example.com", "x_y", ":80", "mailto:", "@"])


@settings(max_examples=3000, deadline=None)
@given(st.lists(PARTS, max_size=4), st.lists(PARTS, max_size=7))
def test_absolute_agrees_with_urljoin(base, reference):
    for url in ("https://shop.example.com/shop/?page=2", "http://a-b.c", "".join(base)):
        reference_text = "".join(reference)
        try:
            expected = urljoin(url, reference_text)
        except ValueError:
            continue
        assert absolute(url, reference_text) == expected


HOSTILE = {
    "unclosed tags": lambda n: "<p>x</p>" + "<a " * n,
    "unclosed tags before text": lambda n: "<a " * n + " > x",
    "blocked end tags": lambda n: "<i><div>" + "<b>" * n + "</i>" * n,
    "blocked cells": lambda n: "<table><tr><td><table>" + "<div>" * n + "</td>" * n,
    "open comments": lambda n: "<!-- " * n + ">",
    "quotes": lambda n: "<a =\'\"" * n + ">\'\"",
    "stray end tags": lambda n: "<div>" * n + "</p>" * n,
    "script ends": lambda n: "<script>" + "</" * n,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    """Four times the page may take some four times as long; quadratic work takes sixteen."""
    def seconds(n):
        page, best = HOSTILE[name](n), 9e9
        for _ in range(3):
            start = time.perf_counter()
            parse(page)
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(24_000) < 10 * max(seconds(6_000), 0.002)


def nested(n, text="KSh 5 "):
    return '<div class="summary">' + ("<b class=price>" + text) * n + "</b>" * n + "</div>"


def flat(n, text="KSh 5 "):
    return '<div class="summary">' + ("<b class=price>" + text + "</b>") * n + "</div>"


def test_nested_prices_cost_no_more_than_flat_ones():
    def seconds(page):
        best = 9e9
        for _ in range(5):
            start = time.perf_counter()
            list(parse(page).amounts("price", V.CURRENCY_MARKS))
            best = min(best, time.perf_counter() - start)
        return best

    for text in ("KSh 5 ", "five ", ""):
        assert seconds(nested(10_000, text)) < 2 * seconds(flat(10_000, text))


PRICE_TEXT = st.lists(st.sampled_from(
    ["KSh", "KES", "K", "S", "h", "E", ",", ".", "5", "12", "0", " ", "\n", "x", "é", "٣", "$", "<b class=price>", "</b>", "<i>", "</i>"]),
    max_size=25).map("".join)


def amount(text, removed, pattern):
    for part in removed:
        text = text.replace(part, "")
    found = re.search(pattern, text)
    return found and found[0]


@settings(max_examples=1500, deadline=None)
@given(PRICE_TEXT)
def test_amounts_are_those_of_the_whole_texts(text):
    """Both price rules find the same in what is kept of a text as in the whole of it."""
    page = parse(f'<div class="summary"><b class=price>{text}</div>')
    short = list(page.amounts("price", V.CURRENCY_MARKS))
    assert [h[:3] for h in short] == [h[:3] for h in page.hits["price"]]
    for (*_, kept), (*_, whole) in zip(short, page.hits["price"]):
        assert any(m in kept for m in V.CURRENCY_MARKS) == any(m in whole for m in V.CURRENCY_MARKS)
        for removed, pattern in ((V.CURRENCY_MARKS + (",",), r"[0-9]+(\.[0-9]+)?"), ((",",), r"[0-9]+\.?[0-9]*")):
            assert amount(kept, removed, pattern) == amount(whole, removed, pattern)
