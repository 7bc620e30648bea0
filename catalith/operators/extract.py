"""Product pages to records: probes, embedded JSON and script data, joined by fallbacks in order of trust.

One Arrow-batched lookup per page (``functions.dom``); everything after it is column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions import quality
from catalith.functions import scalars as X
from catalith.functions.dom import Probe, probed

NA = "N/A"
# Where pages carry each text, in order of trust.
_PRICE_BOXES = ("#corePrice_feature_div", "#corePriceDisplay_desktop_feature_div", "#corePrice_desktop", "#price", "#apex_offerDisplay_desktop")
_OFFERS = ("#aod-pinned-offer", "#aod-offer", "#aod-offer-list")
PROBES = {
    "title": Probe(("span#productTitle", "h1 > span")),
    "title_meta": Probe(('meta[name="title"]',), attr="content"),
    "zip": Probe(("span#glow-ingress-line1",)),
    "brand": Probe(("a#bylineInfo", "a#brand", "span#bylineInfo", "#bylineInfo_feature_div a", "#brand-snapshot-link")),
    "price": Probe((
        "#corePrice_feature_div span.a-offscreen", "#corePriceDisplay_desktop_feature_div span.a-offscreen", "#corePrice_desktop span.a-offscreen",
        "#price span.a-offscreen", "#priceblock_ourprice", "#priceblock_dealprice", "#priceToPay span.a-offscreen", "#apex_offerDisplay_desktop span.a-offscreen",
    )),
    "price_whole": Probe(tuple(f"{b} span.a-price-whole" for b in _PRICE_BOXES)),
    "price_fraction": Probe(tuple(f"{b} span.a-price-fraction" for b in _PRICE_BOXES)),
    "buybox": Probe((
        "#tabular-buybox span.a-offscreen", "#buybox span.a-offscreen", "#newBuyBoxPrice", "#priceToPay span.a-offscreen", "#price_inside_buybox",
        "#corePrice_feature_div span.a-offscreen", "#corePriceDisplay_desktop_feature_div span.a-offscreen", "#apex_offerDisplay_desktop span.a-offscreen",
    ), every=True),
    "original": Probe(tuple(f'{b} span[data-a-strike="true"] span.a-offscreen' for b in ("#corePrice_feature_div", "#corePriceDisplay_desktop_feature_div", "#price"))),
    "delivery_block": Probe(("div#deliveryBlockMessage",), between=" "),
    "delivery_price": Probe(("span[data-csa-c-delivery-price]",), attr="data-csa-c-delivery-price"),
    "shipping_row": Probe(("div#mir-layout-loaded-comparison-row-2 span",)),
    "delivery": Probe(("[data-csa-c-delivery-time]", "div.delivery-message"), every=True, between=" "),
    "availability": Probe(("div#availability span",)),
    "availability_all": Probe(("div#availability",), between=" "),
    "cart_button": Probe(("#add-to-cart-button",), attr="id"),
    "wish_button": Probe(("#add-to-wishlist-button-submit",), attr="id"),
    "price_box": Probe(("#corePrice_feature_div", "#corePriceDisplay_desktop_feature_div"), attr="id"),
    "links": Probe(("a",), every=True, phrases=("see all buying", "see price in cart")),
    "spans": Probe(("span",), every=True, phrases=("see all buying",)),
    "cart_help": Probe(("#a-popover-map_help_pop_",), attr="id"),
    "lines": Probe(("table.a-lineitem",), between=" "),
    "ships_rows": Probe(("div#tabular-buybox tr",), every=True, between=" "),
    "right_column": Probe(("div#rightCol",), between=" "),
    "buybox_table": Probe(("div#tabular-buybox",), between=" "),
    "quantity": Probe(('select[name="quantity"] option', "select#quantity option"), attr="value", every=True),
    "all_text": Probe(("html", "body"), between=" ", phrases=("customize",)),
    "bullets": Probe(("div#feature-bullets ul > li span.a-list-item", "div.a-expander-content ul > li span.a-list-item"), every=True),
    "description": Probe(("div.aplus", "#aplus", "#aplusProductDescription", "#productDescription"), leaves=True),
    "main_image": Probe(("div#imgTagWrapperId img",), attr="src"),
    "crumbs": Probe(("div#wayfinding-breadcrumbs_feature_div a",), every=True),
    "crumb_links": Probe(("div#wayfinding-breadcrumbs_feature_div a",), attr="href", every=True),
}
OFFER_PROBES = {
    "price": Probe(tuple(f"{b} span.a-price span.a-offscreen" for b in _OFFERS)),
    "whole": Probe(tuple(f"{b} span.a-price-whole" for b in _OFFERS)),
    "fraction": Probe(tuple(f"{b} span.a-price-fraction" for b in _OFFERS)),
    "shipping": Probe(tuple(f"{b} [data-csa-c-delivery-price]" for b in _OFFERS), attr="data-csa-c-delivery-price"),
    "shipping_text": Probe(tuple(f"{b} [data-csa-c-delivery-price]" for b in _OFFERS)),
    "delivery": Probe(tuple(f"{b} [data-csa-c-delivery-time]" for b in _OFFERS)),
    "seller": Probe(("#aod-offer-soldBy a.a-link-normal", "#aod-offer-soldBy a")),
    "ships_from": Probe(("#aod-offer-shipsFrom .a-color-base",)),
    "block": Probe(_OFFERS, between=" "),
}
BULLET_BLACKLIST = (
    "go to your orders", "start the return", "free shipping option", "drop off", "leave!", "return this item", "money back", "customer service",
    "full refund", "eligible for return",
)
PRODUCT_PAGE = "https://www.amazon.com/dp/"
NO_OFFER, UNAVAILABLE, IN_CART = "No Featured Offer", "不可售", "See price in cart"


def _filled(c: Column) -> Column:
    """NULL for texts that stand for nothing."""
    return F.when(~c.isin("", NA), c)


def _first_of(*columns: Column) -> Column:
    return F.coalesce(*[_filled(c) for c in columns])


def _match(html: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def _match_set(html: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))))


def kept_bullets(bullets: Column) -> Column:
    """Bullets of two characters or more that speak of the product and not of orders and returns."""
    return F.filter(bullets, lambda b: (F.length(b) >= 2) & ~reduce(lambda x, y: x | y, [F.lower(b).contains(w) for w in BULLET_BLACKLIST]))


def json_product(html: Column) -> Column:
    """The first Product among a page's JSON-LD blocks (objects, or lists of them), as a variant."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?s)<script\s+type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    items = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.try_variant_get(F.try_parse_json(b), "$", "array<variant>"), F.array(F.try_parse_json(b)))))

    def is_product(v: Column) -> Column:
        one, several = F.try_variant_get(v, '$["@type"]', "string"), F.try_variant_get(v, '$["@type"]', "array<string>")
        return F.coalesce(one == "Product", F.lit(False)) | F.coalesce(F.array_contains(several, "Product"), F.lit(False))

    return F.get(F.filter(items, is_product), F.lit(0))


def json_fields(product: Column) -> dict[str, Column]:
    """Fields of a JSON-LD Product; the first offer in US dollars has the price."""
    text = lambda path: X.strip(F.try_variant_get(product, path, "string"))
    offers = F.coalesce(F.try_variant_get(product, "$.offers", "array<variant>"), F.array(F.try_variant_get(product, "$.offers", "variant")))
    dollars = F.filter(offers, lambda o: F.coalesce(F.try_variant_get(o, "$.priceCurrency", "string"), F.lit("USD")) == "USD")
    offer = F.get(dollars, F.lit(0))
    price = F.coalesce(F.try_variant_get(offer, "$.price", "string"), F.try_variant_get(offer, "$.lowPrice", "string")).try_cast("decimal(18,2)")
    stock = F.try_variant_get(offer, "$.availability", "string")
    brand = F.coalesce(F.try_variant_get(product, "$.brand.name", "string"), F.try_variant_get(product, "$.brand", "string"))
    ean = F.try_variant_get(product, "$.gtin13", "string")
    return {
        "title": F.when(F.length(text("$.name")) > 1, text("$.name")),
        "brand": F.when(F.length(X.strip(brand)).between(1, 80), X.strip(brand)),
        "images": F.coalesce(F.array_join(F.try_variant_get(product, "$.image", "array<string>"), "\n"), F.try_variant_get(product, "$.image", "string")),
        "price": F.concat(F.lit("$"), F.format_number(price, 2)),
        "stock": F.when(stock.contains("InStock"), "In Stock").when(stock.contains("OutOfStock"), "Out of Stock"),
        "ean": F.when(ean.rlike(r"^\d+$"), ean),
        "description": F.when(F.length(text("$.description")) > 10, text("$.description")),
        "rating": F.try_variant_get(product, "$.aggregateRating.ratingValue", "double"),
        "reviews": F.try_variant_get(product, "$.aggregateRating.reviewCount", "long"),
    }


def script_fields(html: Column) -> dict[str, Column]:
    """What scripts and meta tags repeat of the record."""
    dollars = lambda c: F.coalesce(F.when(c.contains("$"), c), F.concat(F.lit("$"), c.try_cast("decimal(18,2)").cast("string")))
    keyword = X.strip(F.get(F.split(_match(html, r'(?i)<meta\s+name="keywords"\s+content="([^"]+)"'), ","), F.lit(0)))
    block = X.plain_text(_match(html, r'(?s)<div\s+id="productDescription_feature_div"[^>]*>(.*?)</div>'))
    return {
        "price": F.coalesce(dollars(_match(html, r'"displayPrice"\s*:\s*"([^"]+)"')), dollars(_match(html, r'"priceAmount":([\d.]+)')), dollars(_match(html, r'"sp_detail_page_ssp_meta"\s*:\s*\{[^}]*"price"\s*:\s*"?([^",}]+)'))),
        "stock": _match(html, r'"stockStatus"\s*:\s*"([^"]+)"'),
        "brand": F.when(F.length(keyword).between(1, 60), keyword),
        "description": F.when(F.length(block) > 20, block),
        "long_text": X.plain_text(_match(html, r'"description"\s*:\s*"((?![^"]*(?i:ai-optimized|search submission|noindex|sponsored))[^"]{20,})"')),
    }


def detail_map(details: Column) -> Column:
    """map<field, value> of labelled details; the last of a field counts."""
    named = F.transform(details, lambda d: F.struct(X.detail_field(d["k"]).alias("k"), X.detail_value(d["k"], d["v"]).alias("v")))
    kept = F.filter(named, lambda d: d["k"].isNotNull())
    last = F.filter(kept, lambda d, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda e: e["k"] == d["k"]))
    return F.map_from_entries(last)


def availability_branch(no_offer: Column, gone: Column, in_cart: Column) -> Column:
    return F.when(no_offer, "no_offer").when(gone, "unavailable").when(in_cart, "in_cart").otherwise("normal")


def products(pages: DataFrame, as_of: Column, default_zip: str = "10001") -> DataFrame:
    """One record per page (columns asin, html); every field is a text, ``N/A`` or empty where nothing is found.

    A block page keeps only its title; an empty page is titled so. ``as_of`` is the day from which deliveries count.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    looked = pages.select("asin", html.alias("html"), probed(html, PROBES).alias("p"), json_product(html).alias("json"))
    one = lambda name: F.get(F.col("p.found")[name], F.lit(0))
    every = lambda name: F.coalesce(F.col("p.found")[name], F.array().cast("array<string>"))
    says = lambda name, phrase: F.exists(every(name), lambda t: F.lower(t).contains(phrase))
    there = lambda name: one(name).isNotNull()
    html = F.col("html")
    ld, js = json_fields(F.col("json")), script_fields(html)
    d = looked.withColumn("d", detail_map(F.col("p.details")))

    no_offer = (F.lower(html).contains("no featured offer") & ~there("cart_button")) | (
        (says("links", "see all buying") | says("spans", "see all buying")) & ~there("price_box")
    )
    gone = says("availability_all", "currently unavailable")
    in_cart = says("links", "see price in cart") | there("cart_help") | says("lines", "see price in cart")
    branch = F.col("branch")
    shown = F.when(one("price").contains("$"), one("price")).when(one("price").rlike(r"(?:CNY|EUR|GBP|JPY|¥|€|£)\s*[\d,]+"), F.concat(F.lit(X.FOREIGN), one("price")))
    price = F.coalesce(_first_of(shown, X.price_of_parts(one("price_whole"), one("price_fraction")), ld["price"], js["price"]), F.lit(NA))
    buybox = F.get(F.filter(every("buybox"), lambda t: t.rlike(r"\d")), F.lit(0))
    shipping = X.shipping_cost(says("delivery_block", "prime members get free delivery"), one("delivery_block"), F.when(branch != "in_cart", F.col("price")), _first_of(one("delivery_price"), one("shipping_row")))
    stock = F.coalesce(_first_of(one("availability"), ld["stock"], js["stock"]), F.when(there("cart_button"), "In Stock").when(there("wish_button"), "Currently unavailable"), F.lit(NA))
    stock = F.when(branch == "in_cart", F.coalesce(one("availability"), F.lit("In Stock"))).otherwise(stock)
    phrases = F.regexp_extract_all(F.array_join(every("delivery"), " "), F.lit(X.DELIVERY_PHRASE), F.lit(1))
    delivery = X.first_delivery(phrases, as_of)
    ships = F.concat_ws(" ", one("right_column"), one("buybox_table"))
    from_row = F.get(F.filter(every("ships_rows"), lambda t: F.lower(t).rlike("ships from|shipper")), F.lit(0))
    sells = branch.isin("in_cart", "normal")
    only = lambda c: F.when(sells, c).otherwise(NA)
    named = lambda key: F.coalesce(F.col("d")[key], F.lit(NA))
    bullets = kept_bullets(every("bullets"))
    scripts = F.transform(F.slice(F.split(html, "(?i)<script"), 2, 1 << 30), lambda s: F.get(F.split(s, "(?i)</script", 2), F.lit(0)))
    with_images = F.get(F.filter(scripts, lambda s: s.contains("colorImages")), F.lit(0))  # the first such script alone
    hi, large = _match_set(with_images, r'"hiRes":"(https://[^"]+)"'), _match_set(with_images, r'"large":"(https://[^"]+)"')
    script_images = F.array_join(F.when(F.size(hi) > 0, hi).otherwise(large), "\n")
    upc = F.array_sort(F.array_distinct(F.concat(_match_set(html, r'"upc":"(\d+)"'), _match_set(html, r"UPC\s*[:#]?\s*(\d{12})"), F.array_compact(F.array(F.col("d")["upc"])))))
    ean = F.array_join(_match_set(html, r'"gtin13":"(\d+)"'), ",")
    parent = F.coalesce(_match(html, r'"parentAsin":"(\w+)"'), F.col("asin"))
    category = F.array_compact(F.transform(every("crumb_links"), lambda h: _match(h, r"node=(\d+)")))
    custom = says("all_text", "customize now") | F.lower(ships).rlike("needs to be customized|customization required")

    d = d.withColumn("branch", availability_branch(no_offer, gone, in_cart)).withColumn("price", price)
    d = d.withColumn("stock", F.when(branch == "no_offer", NO_OFFER).when(branch == "unavailable", "Currently unavailable").otherwise(stock))
    d = d.withColumn("block", quality.block_page(html))
    record = {
        "title": F.coalesce(_first_of(ld["title"], one("title"), one("title_meta")), F.lit(NA)),
        "brand": F.coalesce(_first_of(ld["brand"], F.col("d")["brand"], X.clean_brand(one("brand")), js["brand"]), F.lit(NA)),
        "product_type": F.coalesce(_match(html, r'"gl_product_group_type":"([^"]+)"'), F.lit(NA)),
        **{name: named(name) for name in ("manufacturer", "model_number", "part_number", "country_of_origin", "best_sellers_rank", "first_available_date", "package_dimensions", "package_weight", "item_dimensions", "item_weight")},
        "is_customized": F.when(custom, "Yes").otherwise("No"),
        "original_price": only(F.coalesce(one("original"), F.lit(NA))),
        "current_price": F.when(branch == "no_offer", NO_OFFER).when(branch == "unavailable", UNAVAILABLE).when(branch == "in_cart", IN_CART).otherwise(F.col("price")),
        "buybox_price": F.when(branch == "normal", F.coalesce(buybox, F.col("price"))).otherwise(NA),
        "buybox_shipping": only(shipping),
        "is_fba": only(F.when(from_row.isNotNull(), X.fulfillment(from_row)).otherwise(X.fulfillment(_match(F.lower(ships), r"(?:ships from|shipper / seller)\s*[:\s]*([a-z0-9.\s]+)")))),
        "stock_status": F.col("stock"),
        "stock_count": F.when(sells, X.stock_count(F.col("stock"), every("quantity")).cast("string")).otherwise("0"),
        "delivery_date": only(delivery["phrase"]),
        "delivery_time": only(F.when(delivery["days"] < 999, delivery["days"].cast("string")).otherwise(NA)),
        "image_urls": F.coalesce(_first_of(script_images, one("main_image"), ld["images"]), F.lit("")),
        "bullet_points": F.array_join(bullets, "\n"),
        "long_description": F.coalesce(_first_of(F.array_join(every("description"), "\n"), js["long_text"], js["description"], ld["description"]), F.lit("")),
        "upc_list": F.array_join(upc, ","),
        "ean_list": F.when(ean == "", F.coalesce(ld["ean"], F.lit(""))).when(~ean.contains(F.coalesce(ld["ean"], F.lit(""))), F.concat_ws(",", ean, ld["ean"])).otherwise(ean),
        "parent_asin": parent,
        "variation_asins": F.array_join(F.array_sort(F.array_except(_match_set(html, r'"asin":"(\w+)"'), F.array(F.col("asin"), parent))), ","),
        "root_category_id": F.coalesce(F.get(category, F.lit(0)), F.lit(NA)),
        "category_ids": F.array_join(category, ","),
        "category_tree": F.array_join(every("crumbs"), " > "),
        "zip_code": F.coalesce(X.zip5(one("zip")), F.lit(default_zip)),
        "site": F.lit("US"),
        "product_url": F.concat(F.lit(PRODUCT_PAGE), F.col("asin")),
    }
    # Pages that carry no product keep the default record with a title that says why.
    bare = {"title": F.when(html == "", quality.EMPTY_PAGE).otherwise(X.labelled(F.col("block"), quality.BLOCK_TITLES)), "is_customized": F.lit("No"), "parent_asin": F.col("asin"), "zip_code": F.lit(default_zip), "site": F.lit("US"), "stock_count": F.lit("0"), "product_url": record["product_url"]}
    empty = set("image_urls bullet_points long_description upc_list ean_list variation_asins category_ids category_tree".split())
    shell = (html == "") | F.col("block").isNotNull()
    columns = [F.when(shell, bare.get(n, F.lit("" if n in empty else NA))).otherwise(c).alias(n) for n, c in record.items()]
    return d.select("asin", *columns)


def missing_products(asins: DataFrame, default_zip: str = "10001") -> DataFrame:
    """Records of pages that the site does not have (column asin): the default one under a title that says so, a success."""
    bare = products(asins.select("asin", F.lit("").alias("html")), F.current_date(), default_zip)
    return bare.withColumn("title", F.lit(quality.NOT_FOUND))


def offers(pages: DataFrame) -> DataFrame:
    """The first priced offer of each offer-list page (columns asin, html); pages without one give no row."""
    block = F.col("html").contains("validateCaptcha")
    looked = pages.where(F.col("html").isNotNull() & ~block).select("asin", probed(F.col("html"), OFFER_PROBES).alias("p"))
    one = lambda name: F.get(F.col("p.found")[name], F.lit(0))
    price = F.coalesce(F.when(one("price").contains("$"), one("price")), X.price_of_parts(one("whole"), one("fraction")))
    free = F.when(F.lower(one("block")).rlike("free delivery|free shipping"), "FREE")
    stated = F.coalesce(_match(one("shipping_text"), r"^(FREE|\$[\d.]+)"), one("shipping_text"))
    day = _match(one("delivery"), r"(?i)(Tomorrow|Today|(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\w*,?\s+)?(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\.?\s+\d+(?:\s*-\s*\d+)?)")
    return looked.select(
        "asin",
        price.alias("price"),
        F.coalesce(one("shipping"), stated, free).alias("shipping"),
        F.coalesce(day, F.nullif(X.strip(F.regexp_replace(one("delivery"), r"Details|Or fastest|FREE delivery|\.", "")), F.lit("")), one("delivery")).alias("delivery"),
        one("seller").alias("seller"),
        one("ships_from").alias("ships_from"),
        F.when(F.lower(one("ships_from")).contains(X.OWN_SENDER), "FBA").otherwise("FBM").alias("is_fba"),
    ).where(F.col("price").isNotNull())


def with_offers(records: DataFrame, offer_rows: DataFrame) -> DataFrame:
    """Records without a featured offer take price, shipping, delivery and fulfillment from their first listed offer."""
    named = offer_rows.select("asin", *[F.col(c).alias(f"o_{c}") for c in ("price", "shipping", "delivery", "is_fba")])
    hit = (F.col("current_price") == NO_OFFER) & F.col("o_price").isNotNull()
    new = {
        "current_price": F.col("o_price"), "buybox_price": F.col("o_price"), "is_fba": F.col("o_is_fba"), "buybox_shipping": F.coalesce("o_shipping", "buybox_shipping"),
        "delivery_date": F.coalesce("o_delivery", "delivery_date"), "stock_status": F.lit("In Stock (via offer-listing)"),
        "stock_count": F.when(F.col("stock_count").isin("0", "", NA), "5").otherwise(F.col("stock_count")),
    }
    joined = records.join(named, "asin", "left")
    return joined.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}).select(*records.columns)
