"""Page extraction: one page per branch and fallback."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from catalith.functions.dom import Probe, parse, select
from catalith.operators import extract
from catalith.plans import queries as plans

BASE = """<html><head><meta name="keywords" content="Keyword Brand, more"><meta name="title" content="Meta title"></head><body>
<span id="glow-ingress-line1">Deliver to 90210</span><span id="productTitle"> A  fine thing </span><a id="bylineInfo">Visit the Acme Store</a>
<div id="corePrice_feature_div"><span class="a-price"><span class="a-offscreen">$19.99</span></span><span data-a-strike="true"><span class="a-offscreen">$29.99</span></span></div>
<div id="buybox"><span class="a-offscreen">$18.50</span></div>
<div id="deliveryBlockMessage"><b>FREE delivery</b> on orders over $35</div>
<div data-csa-c-delivery-time="x"><span>Friday, Nov 29 or Tomorrow</span></div>
<div id="availability"><span> Only 3 left in stock </span></div><input id="add-to-cart-button">
<select name="quantity"><option value="1">1<option value="12">12</select>
<div id="tabular-buybox"><table><tr><td>Ships from</td><td><span class="a-color-base">Other shop</span></td></tr></table></div>
<div id="feature-bullets"><ul><li><span class="a-list-item">Good bullet</span></li><li><span class="a-list-item">x</span></li><li><span class="a-list-item">Full refund always</span></li></ul></div>
<div id="productDescription"><p>A long description text.</p></div>
<table><tr><th>Item model number</th><td>M-1</td></tr><tr><th>Package Dimensions</th><td>1 x 2 x 3 inches; 4 pounds</td></tr><tr><th>Manufacturer</th><td>Maker</td></tr><tr><th>Manufacturer</th><td>Last maker</td></tr></table>
<ul><li><span><span class="a-text-bold">Date First Available:</span><span>May 1, 2020</span></span></li></ul>
<div id="wayfinding-breadcrumbs_feature_div"><a href="/b?node=11">Home</a><a href="/b?node=22">Kitchen</a></div>
<script>var colorImages = {"hiRes":"https://i/b.jpg"}, {"hiRes":"https://i/a.jpg"}; "parentAsin":"B000000009" "asin":"B000000001" "asin":"B000000002" "gtin13":"0012345678905" "upc":"123" "gl_product_group_type":"gl_kitchen"</script>
</body></html>"""
LD = '<script type="application/ld+json">{"@graph":1}</script><script type="application/ld+json">[{"@type":"Thing"},{"@type":["Product"],"name":" LD name ","brand":{"name":"LD brand"},"image":["u1","u2"],"offers":[{"priceCurrency":"EUR","price":1},{"price":"1234.5","availability":"http://schema.org/InStock"}],"gtin13":"99","description":"long enough text","aggregateRating":{"ratingValue":4.5,"reviewCount":7}}]</script>'

PAGES = {
    "base": BASE,
    "ld": f"<html><body>{LD}</body></html>",
    "ld_broken": '<html><body><script type="application/ld+json">{"@type": "Product", </script><h1><span>Head title</span></h1></body></html>',
    "script": '<html><body><h1><span>T</span></h1><script>"displayPrice":"$7.00" "stockStatus":"Maybe"</script></body></html>',
    "parts": '<html><body><div id="price"><span class="a-price-whole">1,234.</span><span class="a-price-fraction">05</span></div></body></html>',
    "euro": '<html><body><span id="productTitle">T</span><div id="price"><span class="a-offscreen">EUR 12.00</span></div></body></html>',
    "gone": '<html><body><span id="productTitle">T</span><div id="availability"><span>Currently unavailable.</span></div></body></html>',
    "no_offer": '<html><body><span id="productTitle">T</span><p>No featured offer available</p></body></html>',
    "all_options": '<html><body><span id="productTitle">T</span><a>See All Buying Options</a></body></html>',
    "in_cart": '<html><body><span id="productTitle">T</span><a>See price in cart</a></body></html>',
    "blocked": "<html>validateCaptcha</html>",
    "empty": "",
    "missing": None,
    "broken": "<div><p>a<p>b</div></span><li>x<li>y <b>z",
}


@pytest.fixture(scope="module")
def records(spark):
    pages = spark.createDataFrame([(f"B00000{k}", html) for k, html in PAGES.items()], "asin string, html string")
    return {r.asin[6:]: r for r in extract.products(pages, F.lit(datetime.date(2024, 11, 28))).collect()}


def test_full_page(records):
    r = records["base"]
    wanted = {
        "title": "A  fine thing", "brand": "Acme", "current_price": "$19.99", "buybox_price": "$18.50", "original_price": "$29.99", "buybox_shipping": "N/A",
        "is_fba": "FBM", "stock_status": "Only 3 left in stock", "stock_count": "3", "delivery_date": "Nov 29", "delivery_time": "1", "zip_code": "90210",
        "bullet_points": "Good bullet", "long_description": "A long description text.", "model_number": "M-1", "package_dimensions": "1 x 2 x 3 inches",
        "manufacturer": "Last maker", "first_available_date": "May 1, 2020", "category_ids": "11,22", "root_category_id": "11", "category_tree": "Home > Kitchen",
        "image_urls": "https://i/a.jpg\nhttps://i/b.jpg", "parent_asin": "B000000009", "variation_asins": "B000000001,B000000002", "ean_list": "0012345678905",
        "upc_list": "123", "product_type": "gl_kitchen", "is_customized": "No", "brand": "Acme",
    }
    assert {k: r[k] for k in wanted} == wanted


def test_json_record(records):
    r = records["ld"]
    assert (r.title, r.brand, r.current_price, r.stock_status, r.image_urls, r.ean_list, r.long_description) == ("LD name", "LD brand", "$1,234.50", "In Stock", "u1\nu2", "99", "long enough text")


def test_fallbacks(records):
    assert records["ld_broken"].title == "Head title"
    assert (records["script"].current_price, records["script"].stock_status) == ("$7.00", "Maybe")
    assert records["parts"].current_price == "$1,234.05"
    assert records["euro"].current_price == "[非USD]EUR 12.00"


def test_branches(records):
    assert (records["gone"].current_price, records["gone"].stock_status, records["gone"].stock_count) == ("不可售", "Currently unavailable", "0")
    for name in ("no_offer", "all_options"):
        assert (records[name].current_price, records[name].buybox_price, records[name].is_fba) == ("No Featured Offer", "N/A", "N/A")
    assert (records["in_cart"].current_price, records["in_cart"].stock_status, records["in_cart"].stock_count) == ("See price in cart", "In Stock", "999")


def test_pages_without_a_product(records):
    assert records["blocked"].title == "[验证码拦截]" and records["empty"].title == records["missing"].title == "[页面为空]"
    assert records["empty"].current_price == "N/A" and records["empty"].image_urls == "" and records["broken"].title == "N/A"


def test_a_missing_page_is_a_default_record(spark):
    r = extract.missing_products(spark.createDataFrame([("B1",)], "asin string")).first()
    assert (r.title, r.current_price, r.stock_count, r.parent_asin, r.image_urls, r.product_url) == ("[商品不存在]", "N/A", "0", "B1", "", "https://www.amazon.com/dp/B1")


def test_descriptions_in_page_order():
    page = parse('<div class="aplus"><h2>Heading text</h2><div><p>First text</p><img src="a.jpg"><p>tiny</p></div><img src="pixel.gif"><img data-src="b.jpg"><ul><li>List item <b>bold</b></li></ul></div>')
    assert Probe(("#aplus", "div.aplus"), leaves=True).run(page) == ["Heading text", "First text", "\n[Image: a.jpg]\n", "\n[Image: b.jpg]\n", "List itembold"]
    assert Probe(("#none",), leaves=True).run(page) == []


def test_images_of_the_first_script_alone(spark):
    page = '<html><script>colorImages "large":"https://1"</script><script>colorImages "hiRes":"https://2"</script></html>'
    assert extract.products(spark.createDataFrame([("B1", page)], "asin string, html string"), F.current_date()).first().image_urls == "https://1"


def test_end_tags_without_starts_take_no_time():
    began = time.perf_counter()
    parse("<b>" * 50_000 + "</i>" * 50_000)
    assert time.perf_counter() - began < 5


def test_offers(spark, records):
    page = '<div id="aod-offer"><span class="a-price"><span class="a-offscreen">$5.00</span></span><div data-csa-c-delivery-price="FREE" data-csa-c-delivery-time="z">FREE delivery Mon, Dec 2. Details</div><div id="aod-offer-soldBy"><a>Shop</a></div><div id="aod-offer-shipsFrom"><span class="a-color-base">Shop</span></div></div>'
    pages = spark.createDataFrame([("B00000no_offer", page), ("B00000gone", page), ("x", "<p>nothing"), ("y", "validateCaptcha"), ("z", None)], "asin string, html string")
    found = extract.offers(pages)
    got = {r.asin: r for r in found.collect()}
    assert set(got) == {"B00000no_offer", "B00000gone"}
    assert tuple(got["B00000gone"])[1:] == ("$5.00", "FREE", "Mon, Dec 2", "Shop", "Shop", "FBM")
    rows = spark.createDataFrame([(k, p) for k, p in (("B00000no_offer", PAGES["no_offer"]), ("B00000gone", PAGES["gone"]))], "asin string, html string")
    after = {r.asin: r for r in extract.with_offers(extract.products(rows, F.current_date()), found).collect()}
    assert (after["B00000no_offer"].current_price, after["B00000no_offer"].stock_count) == ("$5.00", "5")
    assert after["B00000gone"].current_price == "不可售"


@pytest.mark.parametrize(("selector", "wanted"), [("p", ["a", "b"]), ("div p.x", ["a"]), ("#d > p", ["a"]), ("[data-q]", ["a"]), ('p[data-q="1"]', ["a"]), ("section p", ["b"]), ("div > section", [])])
def test_selectors(selector, wanted):
    root = parse('<div id="d"><p class="x y" data-q="1">a</p></div><section><b><p>b</p></b></section>')
    assert [n.text() for n in select(root, selector)] == wanted
    assert Probe((selector,), every=True).run(root) == wanted


LONG = ("word " * 5_000).strip()
LONG_SOURCES = {
    "selector": f'<div id="productDescription"><p>{LONG}</p></div>',
    "script": f'<script>"description":"{LONG}"</script>',
    "block": f'<div id="productDescription_feature_div"><b>{LONG}</b></div>',
    "json": f'<script type="application/ld+json">{{"@type":"Product","description":"{LONG}"}}</script>',
}


def test_descriptions_of_any_source_are_whole(spark):
    pages = [(k, f'<html><body><span id="productTitle">T</span>{v}</body></html>') for k, v in LONG_SOURCES.items()]
    got = extract.products(spark.createDataFrame(pages, "asin string, html string"), F.current_date()).collect()
    assert {r.asin: r.long_description for r in got} == dict.fromkeys(LONG_SOURCES, LONG)


def test_offer_texts_are_whole(spark):
    shipping, delivery = "about " * 20 + "five", "between now and " * 20 + "then"
    page = f'<div id="aod-offer"><span class="a-price"><span class="a-offscreen">$5.00</span></span><div id="aod-offer-price"><span data-csa-c-delivery-price="">{shipping}</span></div><div data-csa-c-delivery-time="z">{delivery}</div></div>'
    only = '<div id="aod-offer"><span class="a-price"><span class="a-offscreen">$5.00</span></span><div data-csa-c-delivery-time="z">Details.</div></div>'
    got = {r.asin: r for r in extract.offers(spark.createDataFrame([("a", page), ("b", only)], "asin string, html string")).collect()}
    assert (got["a"].shipping, got["a"].delivery, got["b"].delivery) == (shipping, delivery, "Details.")


def test_long_pages_are_read_whole(spark):
    """The reference looks at the first 50,000 characters and keeps 10,000 of the description."""
    page = "<html><body><span id=\"productTitle\">T</span><div id=\"productDescription\"><p>" + "word " * 12_000 + "end</p></div><p>No featured offers available</p></body></html>"
    pages = spark.createDataFrame([("asin-1", page)], "asin string, html string")
    r = extract.products(pages, F.lit(datetime.date(2024, 11, 28))).first()
    assert r.current_price == extract.NO_OFFER and r.long_description.endswith("end")


@pytest.mark.parametrize(("written", "title"), [("a &amp; b&amp", "a & b&amp"), ("x&lt", "x&lt"), ("x&am", "x&am"), ("&amp;lt; &quot;q&quot; &lt;", '&lt; "q" <'), ("\U000f0000&amp;", "\U000f0000&"), ("plain", "plain")])
def test_a_title_cut_inside_a_reference_keeps_its_rest(spark, tmp_path, written, title):
    page = f'<html lang="en"><title>{written}</title><body><a href="/a?b=1&copy=2">x</a><a href="/a?b=1&copy;=2">y</a></body></html>'
    spark.createDataFrame([(1, page)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert tuple(plans.page_extract(spark, str(tmp_path)).first()) == (1, title, "en", 2)
