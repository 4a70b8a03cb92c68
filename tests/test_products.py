"""Extraction of hand-made pages through Spark."""

import pytest
from pyspark.sql import functions as F

from shelfgrain.operators.parse import parse_failures, parse_pages
from shelfgrain.operators.products import extract_products, named_only
from shelfgrain.functions import text

FILL = "<footer>" + "x" * 100 + "</footer>"
SPEC = '{"@graph":[{"@type":"Product","offers":[{"priceSpecification":[{"price":%s}]}]}]}'


def page(body, title="<title>t</title>", fill=FILL):
    return f"<html><head>{title}</head><body>{body}{fill}</body></html>"


def area(price):
    return f'<h1>Part name</h1><div class="summary"><p class="price">{price}</p></div>'


def ld(script, rest="KSh 777"):
    return page(f'<script type="application/ld+json">{script}</script>' + area(rest))


PAGES = {
    "noise": page("<h1>RENEWED  Used Pump</h1>"),
    "nbsp": page("<h1>a  b pump</h1>"),
    "short_name": page('<h1 class="entry-title">abc</h1><h1 class="product_title">Real name</h1>'),
    "glued": page("<h1>Front<b>Bumper</b></h1>"),
    "all_noise": page("<h1>NEW SALE</h1>"),
    "long_name": page(f"<h1>{'n' * 300}</h1>"),
    "struck": page('<h1>Name</h1><div class="summary"><p class="price"><del><span class="amount">KSh 2,000</span></del>'
                   '<ins><span class="amount">KSh 1,500</span></ins></p></div>'),
    "range": page(area("KSh 1,200 - KSh 1,900")),
    "small": page(area("KSh 90")),
    "tiny": page(area("KSh 9")),
    "foreign": page(area("$ 500")),
    "kes": page(area("KES 1,234.567")),
    "second_ok": page('<h1>Name</h1><div class="summary"><p class="price">KSh 50</p><p class="price">KSh 500</p></div>'),
    "third_hit": page('<h1>Name</h1><p class="price">$1</p><p class="price">$2</p><p class="price">KSh 300</p>'),
    "outside": page('<h1>Name</h1><p class="price">KSh 400</p><div class="summary"></div>'),
    "no_area": page('<h1>Name</h1><p class="price">KSh 400</p>'),
    "bad_json": ld("{oops"),
    "trailing": ld(SPEC % "5" + " tail"),
    "comment": ld("<!-- " + SPEC % "5" + " -->"),
    "good_json": ld(SPEC % '"1234.5"'),
    "number_json": ld(SPEC % "42"),
    "offers_object": ld('{"@graph":[{"@type":"Product","offers":{"price":1}}]}'),
    "spec_object": ld('{"@graph":[{"@type":"Product","offers":[{"priceSpecification":{"price":"1"}}]}]}'),
    "nan": ld(SPEC % '"NaN"'),
    "java_double": ld(SPEC % '"1d"'),
    "comma": ld(SPEC % '"1,200"'),
    "negative": ld(SPEC % "-3"),
    "zero_then": ld('{"@graph":[{"@type":"Product","offers":[{"priceSpecification":[{"price":0},{"price":"8"}]}]}]}'),
    "list_json": ld("[" + SPEC % "5" + "]"),
    "other_type": ld((SPEC % "5").replace("Product", "Offer")),
    "no_title": page("<h1>Name here</h1>", title=""),
    "empty_title": page("<h1>Name here</h1>", title="<title></title>"),
    "short_page": page("<h1>Name here</h1>", fill=""),
    "no_h1": page("<p>nothing</p>"),
    "crumbs": page('<h1>Name</h1><div class="product_meta"><span class="posted_in"><a>Oils</a></span></div>'
                   '<div class="breadcrumb"><a>HOME</a><a>Shop</a><a>Engine</a><a>Oils</a><a>Filters</a></div>'),
    "stock_in": page('<h1>Name</h1><p class="stock">12 IN STOCK</p><p class="stock">Out of stock</p>'),
    "stock_out": page('<h1>Name</h1><p class="stock">Now out of stock</p>'),
    "stock_none": page('<h1>Name</h1><p class="stock">On order</p>'),
    "description": page(f'<h1>Name</h1><div class="product-short-description">too short</div>'
                        f'<div class="summary"><p>{"d" * 400}</p></div>'),
    "sku_empty": page('<h1>Name</h1><span class="sku"> </span><b data-sku="A1">from text</b>'),
    "images": page('<h1>Name</h1><div class="woocommerce-product-gallery"><img><img src="/a.jpg"><img src="/b.jpg"></div>'
                   '<img class="wp-post-image" data-src="https://cdn.example.com/c.jpg">'),
    "flags": page("<h1>Name</h1><p>GUARANTEE and Shipping</p>"),
    "script_flags": page("<h1>Name</h1><script>warranty delivery</script>"),
}


@pytest.fixture(scope="module")
def records(spark):
    rows = [(name, f"https://shop.example.com/product/{name}", html) for name, html in PAGES.items()]
    pages = spark.createDataFrame(rows, "case string, url string, html string")
    return {variant: {r.case: r for r in extract_products(pages, variant).collect()}
            for variant in ("full", "lean")}


def field(records, name, variant="full"):
    return {case: row[name] for case, row in records[variant].items()}


def test_names(records):
    names = field(records, "name")
    assert names["noise"] == "REED Pump"
    assert names["nbsp"] == "a b pump"
    assert names["short_name"] == "Real name"
    assert names["glued"] == "FrontBumper"
    assert names["long_name"] == "n" * 200
    assert "all_noise" not in names and "no_h1" not in names
    lean = field(records, "name", "lean")
    assert lean["noise"] == "RENEWED  Used Pump"
    assert lean["long_name"] == "n" * 150
    assert lean["all_noise"] == "NEW SALE"


def test_validity_gate(records):
    for variant in ("full", "lean"):
        assert not {"no_title", "short_page"} & set(records[variant])
        assert "empty_title" in records[variant]


def test_area_prices(records):
    full, lean = field(records, "price_kes"), field(records, "price_kes", "lean")
    expected = {  # case: (full, lean)
        "struck": (2000.0, 2000.0), "range": (1200.0, 1200.0), "small": (None, 90.0), "tiny": (None, None),
        "foreign": (None, None), "kes": (1234.567, 1234.567), "second_ok": (500.0, 50.0),
        "third_hit": (None, None), "outside": (None, 400.0), "no_area": (None, 400.0),
    }
    assert {case: (full[case], lean[case]) for case in expected} == expected


def test_structured_prices(records):
    full = field(records, "price_kes")
    assert {c: full[c] for c in ("good_json", "number_json", "zero_then")} == {
        "good_json": 1234.5, "number_json": 42.0, "zero_then": 8.0}
    for case in ("bad_json", "trailing", "comment", "offers_object", "spec_object", "nan", "java_double",
                 "comma", "negative", "list_json", "other_type"):
        assert full[case] == 777.0, case


def test_price_companions(records):
    row = records["full"]["good_json"]
    assert (row.original_currency, row.raw_price_text) == ("KES", "KSh 1,234.50")
    row = records["full"]["small"]
    assert (row.original_currency, row.raw_price_text) == (None, None)


def test_other_fields(records):
    full = records["full"]
    assert full["crumbs"].category == "Oils > Engine > Oils"
    assert full["noise"].category is None
    assert [full[c].stock_status for c in ("stock_in", "stock_out", "stock_none", "noise")] == [
        "In Stock", "Out of Stock", None, None]
    assert full["description"].description == "d" * 300
    assert full["sku_empty"].sku == "from text"
    assert full["images"].images == ["https://shop.example.com/a.jpg", "https://cdn.example.com/c.jpg"]
    assert full["images"].primary_image == "https://shop.example.com/a.jpg"
    # The lean variant looks at the very first hit of each selector only.
    assert records["lean"]["images"].primary_image == "https://cdn.example.com/c.jpg"
    assert full["noise"].images == [] and full["noise"].primary_image is None
    assert (full["flags"].has_warranty, full["flags"].has_shipping_info) == (True, True)
    assert (full["script_flags"].has_warranty, full["script_flags"].has_shipping_info) == (False, False)


def test_switches(spark):
    rows = [("https://s.example.com/product/i", PAGES["images"]), ("https://s.example.com/product/d", PAGES["description"])]
    pages = spark.createDataFrame(rows, "url string, html string")
    made = extract_products(pages, images=False, descriptions=False)
    assert all(r.images == [] and r.primary_image is None and r.description is None for r in made.collect())


def test_own_selectors(spark):
    pages = spark.createDataFrame([("u", page('<b class="title">Other shop</b><h1>Wrong</h1>'))], "url string, html string")
    assert [r.name for r in extract_products(pages, selectors={"name": (".title",)}).collect()] == ["Other shop"]


def test_bad_pages_keep_their_row(spark):
    rows = [(1, "https://s.example.com/", '<a href="http://[bad/product/">x</a>'), (2, "https://s.example.com/", None),
            (3, "https://s.example.com/", '<a href="/product/ok">x</a>')]
    facts = parse_pages(spark.createDataFrame(rows, "id int, url string, html string"), ("link",), with_text=True)
    got = {r.id: r for r in facts.collect()}
    assert got[1].error is None and [h.url for h in got[1].link] == [None] and not got[1].has_title
    assert got[2].error == "no body" and got[2].text == ""
    assert got[3].error is None and [h.url for h in got[3].link] == ["https://s.example.com/product/ok"]


def test_unknown_field_is_refused(spark):
    with pytest.raises(ValueError):
        parse_pages(spark.createDataFrame([("u", "h")], "url string, html string"), ("colour",))


def test_named_only(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "id int, name string")
    assert [r.id for r in named_only(rows).collect()] == [3]


def test_clean_name_and_urls(spark):
    cases = [("BARGAIN PRICE", ""), ("NEWNEW used", "used"), ("a \t\n b ", "a b"), (None, None), ("SALSALEE", "SALE")]
    made = spark.createDataFrame(cases, "raw string, expected string")
    assert all(r.made == r.expected for r in made.withColumn("made", text.clean_name(F.col("raw"))).collect())
    urls = {"http://a.b": True, "https://ab": False, "HTTP://a.b": False, "ftp://a.b": False, "": False}
    made = spark.createDataFrame([(u,) for u in urls], "u string").select("u", text.is_valid_url(F.col("u")).alias("v"))
    assert {r.u: r.v for r in made.collect()} == urls
    urls = {"https://x.y/product/oil-filter": False, "https://x.y/PRODUCT/a": True, "https://x.y/product/a?page=2": False,
            "https://x.y/products/a": False, "https://x.y/product/a?orderby=p": False}
    made = spark.createDataFrame([(u,) for u in urls], "u string").select("u", text.is_product_url(F.col("u")).alias("v"))
    assert {r.u: r.v for r in made.collect()} == urls


def test_a_bad_address_loses_no_product(spark):
    """The reference reads the first image with an address; a malformed one further on does not matter."""
    html = page('<h1>Part</h1><div class="product-image"><img src="/ok.jpg"><img src="http://[bad"></div>')
    got = extract_products(spark.createDataFrame([("https://s.example.com/p", html)], "url string, html string")).first()
    assert got.name == "Part" and got.primary_image == "https://s.example.com/ok.jpg"


def test_parse_failures(spark):
    rows = [(1, "u", None), (2, "u", "<title>t</title>")]
    got = parse_failures(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert [tuple(r) for r in got] == [(1, "u", "no body")]


def test_more_image_selectors_than_usual(spark):
    html = page("<h1>Part</h1>" + "".join(f'<i class="i{k}" src="/{k}.jpg"></i>' for k in (4, 6)))
    pages = spark.createDataFrame([("https://s.example.com/p", html)], "url string, html string")
    got = extract_products(pages, selectors={"image": tuple(f".i{k}" for k in range(8))}).first()
    assert got.images == ["https://s.example.com/4.jpg", "https://s.example.com/6.jpg"]


def test_only_asked_columns_are_parsed_for(spark):
    pages = spark.createDataFrame([("https://s.example.com/p", page("<h1>Part</h1>"))], "url string, html string")
    few = extract_products(pages, columns=())
    assert few.columns == ["source_url", "scraped_at", "name"]
    plan = few._jdf.queryExecution().analyzed().toString()
    assert "name#" in plan and not any(f"{field}#" in plan for field in ("jsonld", "words", "image", "price"))
    both = extract_products(pages, columns=("primary_image", "raw_price_text", "has_warranty"))
    assert both.columns == ["source_url", "scraped_at", "name", "raw_price_text", "primary_image", "has_warranty"]
    assert both.first().name == "Part"
    with pytest.raises(ValueError):
        extract_products(pages, columns=("colour",))
