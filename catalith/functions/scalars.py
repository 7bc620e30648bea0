"""Scalar functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith.schemas import CONTENT_FIELDS, TITLE_FIELDS

NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


#: All that counts as white space at the ends of a text (a fixed value).
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim all Unicode white space; a set of characters, so no regular expression runs."""
    return F.btrim(c, F.lit(WHITE))


def parse_price(c: Column) -> Column:
    """The number of a price text; NULL where the text after its leading marks is not one number."""
    s = F.regexp_replace(F.replace(strip(c), F.lit(","), F.lit("")), r"^[^\d.-]+", "")
    s = strip(s)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def parse_int(c: Column) -> Column:
    """The first run of digits, thousands separators dropped."""
    return F.nullif(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"(\d+)", 1), F.lit("")).try_cast("bigint")


def compare(old: Column, new: Column) -> Column:
    """up, down, or NULL for equal or missing numbers."""
    return F.when(new > old, "up").when(new < old, "down")


def normal_status(c: Column) -> Column:
    v = F.lower(strip(c))
    return F.when(~v.isin("", "n/a", "none"), v)


def compare_status(old: Column, new: Column) -> Column:
    return F.when(normal_status(old) != normal_status(new), "changed")


def joined_hash(columns: list[Column]) -> Column:
    """MD5 of the values joined by a bar; a NULL counts as empty and keeps its place."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def content_hash() -> Column:
    return joined_hash([F.col(f) for f in CONTENT_FIELDS])


def title_bullets_hash() -> Column:
    return joined_hash([F.col(f) for f in TITLE_FIELDS])


def normal_path(c: Column) -> Column:
    """A stored path, or NULL for placeholders."""
    v = strip(c)
    return F.when((v != "") & ~F.lower(v).isin("none", "null"), v)


def money(value: Column) -> Column:
    """$ and two decimals; cents are made exact first, so that no tie is left to binary fractions."""
    return F.concat(F.lit("$"), F.round(value, 2).cast("decimal(18,2)").cast("string"))


def total_price(buybox: Column, shipping: Column) -> Column:
    """Buy-box price plus shipping; empty without a price, shipping that is free or unreadable costs nothing."""
    price, ship = parse_price(buybox), parse_price(shipping)
    ship = F.when(F.upper(strip(shipping)) == "FREE", 0.0).otherwise(F.coalesce(ship, F.lit(0.0)))
    return F.when(price.isNull(), "").otherwise(money(price + ship))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, ties to even; 0 for an empty whole."""
    return F.when(whole > 0, F.bround(part / whole * 100, 1)).otherwise(F.lit(0.0))


def rounded(c: Column, places: int = 6) -> Column:
    """Rounded in binary, as SQL engines round a double: what lies between two values goes to where the scaled double lies."""
    return F.round(c * 10.0**places) / 10.0**places


def bounded_percent(a: Column, b: Column) -> Column:
    return F.coalesce(F.least(F.lit(100.0), a / F.nullif(b, F.lit(0)) * 100), F.lit(0.0))


def change_detail(parts: dict[str, Column]) -> Column:
    """name:change of the parts that changed, joined by comma and space."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{k}:"), v) for k, v in parts.items()])


def rendered(values: dict[str, Column]) -> Column:
    """k=v of all values; a missing one reads None."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("None"))) for k, v in values.items()])


def truncated(c: Column, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def split_dimension_weight(c: Column) -> Column:
    """struct(dimensions, weight) of a text like ``10 x 5 x 3 in; 2 pounds``."""
    parts = F.split(c, ";")
    return F.struct(
        strip(F.try_element_at(parts, F.lit(1))).alias("dimensions"),
        F.coalesce(strip(F.try_element_at(parts, F.lit(2))), F.lit("")).alias("weight"),
    )


# What a detail label must contain, in order of precedence, and the field it fills.
DETAIL_LABELS = (
    (("model number",), "model_number"), (("part number",), "part_number"), (("country of origin",), "country_of_origin"),
    (("best sellers rank",), "best_sellers_rank"), (("manufacturer",), "manufacturer"), (("date first available",), "first_available_date"),
    (("upc",), "upc"), (("weight", "item"), "item_weight"), (("weight", "package"), "package_weight"),
    (("dimensions", "package"), "package_dimensions"), (("dimensions",), "item_dimensions"),
)


def detail_field(label: Column) -> Column:
    """Field that a labelled detail fills, or NULL; a brand label must stand alone."""
    low = F.lower(label)
    out = F.when(strip(low) == "brand", "brand")
    for parts, name in DETAIL_LABELS:
        out = out.when(reduce(lambda a, b: a & b, [low.contains(p) for p in parts]), name)
    return out


def detail_value(label: Column, value: Column) -> Column:
    """Dimensions and package weights stand in one text, parted by a semicolon."""
    name = detail_field(label)
    parts = split_dimension_weight(value)
    return (
        F.when(name.isin("package_dimensions", "item_dimensions"), parts["dimensions"])
        .when(name == "package_weight", F.coalesce(F.nullif(parts["weight"], F.lit("")), F.lit("N/A")))
        .otherwise(value)
    )


def clean_brand(c: Column) -> Column:
    """Store phrases taken off; NULL where nothing or over 80 characters are left."""
    v = strip(F.regexp_replace(c, r"(?i)Visit the |Brand:\s*| Store$", ""))
    return F.when((v != "") & (F.length(v) <= 80), v)


def zip5(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d{5})", 1), F.lit(""))


def shipping_cost(prime: Column, text: Column, price: Column, stated: Column) -> Column:
    """FREE for prime; where delivery is free on orders over N, FREE if the price reaches N, else N/A; else what is
    stated; else FREE."""
    over = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?is)free delivery.*?on orders over \$(\d+(?:\.\d+)?)", 1).try_cast("double")
    return (
        F.when(prime, "FREE")
        .when(over.isNotNull(), F.when(parse_price(price) >= over, "FREE").otherwise("N/A"))
        .otherwise(F.coalesce(F.nullif(strip(stated), F.lit("")), F.lit("FREE")))
    )


#: Sender's name that marks orders fulfilled by the marketplace itself (a fixed value).
OWN_SENDER = "amazon"


def fulfillment(ships_from: Column) -> Column:
    low = F.lower(F.coalesce(ships_from, F.lit("")))
    return F.when((low == "") | low.contains(OWN_SENDER), "FBA").otherwise("FBM")


def stock_count(status: Column, options: Column) -> Column:
    """Units in stock: a stated remainder, 0 when unavailable, the largest quantity option, else 999 (unknown)."""
    low = F.lower(F.coalesce(status, F.lit("")))
    left = F.coalesce(F.regexp_extract(low, r"(\d+)", 1).try_cast("int"), F.lit(999))
    most = F.array_max(F.transform(options, lambda o: F.when(strip(o).rlike(r"^\d+$"), strip(o)).try_cast("int")))
    gone = low.contains("out of stock") | low.contains("unavailable")
    return F.when(low.contains("only"), left).when(gone, 0).otherwise(F.coalesce(most, F.lit(999)))


#: Phrases that name a day of delivery.
DELIVERY_PHRASE = r"(?i)(Tomorrow|Today|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d+)"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def delivery_days(phrase: Column, as_of: Column) -> Column:
    """Days from ``as_of`` to a delivery phrase (today, tomorrow, overnight, month and day); NULL if none is found."""
    low = F.lower(phrase)
    month = F.regexp_extract(low, r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}\b", 1)
    day = F.regexp_extract(low, r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{1,2})\b", 1).try_cast("int")
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month).cast("int")
    this = F.try_to_date(F.concat_ws("-", F.year(as_of), number, day), "y-M-d")
    days = F.datediff(this, as_of)
    ahead = F.when(days < -180, F.datediff(F.add_months(this, 12), as_of)).otherwise(days)
    return F.when(low.contains("today") | low.contains("overnight"), 0).when(low.contains("tomorrow"), 1).otherwise(F.when(number > 0, ahead))


def first_delivery(phrases: Column, as_of: Column) -> Column:
    """struct(days, phrase) of the earliest phrase not in the past; the first wins ties; days 999 if none."""
    indexed = F.transform(phrases, lambda p, i: F.struct(delivery_days(p, as_of).alias("days"), i.alias("at"), p.alias("phrase")))
    best = F.array_min(F.filter(indexed, lambda x: x["days"] >= 0))
    return F.struct(F.coalesce(best["days"], F.lit(999)).alias("days"), F.coalesce(best["phrase"], F.lit("N/A")).alias("phrase"))


def price_of_parts(whole: Column, fraction: Column) -> Column:
    """The price that a page shows in two parts; NULL unless both are there."""
    return F.when((whole != "") & (fraction != ""), F.concat(F.lit("$"), F.replace(whole, F.lit("."), F.lit("")), F.lit("."), fraction))


#: Tag that marks a price in another currency (a fixed value).
FOREIGN = "[非USD]"


def tag_foreign(price: Column) -> Column:
    v = strip(price)
    foreign = v.rlike(r"(?i)(CNY|EUR|GBP|JPY|CAD|AUD|INR|MXN|[€£¥₹])") & ~v.contains("$")
    return F.when(foreign, F.concat(F.lit(FOREIGN), v)).otherwise(v)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9_\-]", "_")


def batch_name(at: Column, auto: Column | None = None) -> Column:
    """Default names of manual and scheduled batches."""
    if auto is None:
        return F.concat(F.lit("batch_"), F.date_format(at, "yyyyMMdd_HHmmss"))
    return F.concat(F.lit("auto_"), auto, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmm"))


def valid_clock(c: Column) -> Column:
    """Whether HH:MM names a minute of the day."""
    parts = F.split(c, ":")
    h, m = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    return F.coalesce((F.size(parts) == 2) & h.between(0, 23) & m.between(0, 59), F.lit(False))


def plain_text(markup: Column) -> Column:
    """Tags out, white space collapsed, the whole text."""
    return strip(F.regexp_replace(F.regexp_replace(markup, r"<[^>]+>", " "), r"(?U)\s+", " "))


def duration(seconds: Column) -> Column:
    return F.format_string("%dh %dm", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60))


def band_success(pct: Column) -> Column:
    return F.when(pct >= 95, "good").when(pct >= 85, "warn").otherwise("bad")


def band_block(pct: Column) -> Column:
    return F.when(pct == 0, "good").when(pct < 5, "warn").otherwise("bad")


def escaped_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def labelled(code: Column, labels: dict[str, str]) -> Column:
    """Label of a code; unknown codes stay."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code) if pairs else code


def error_class(name: Column) -> Column:
    return F.when(F.lower(name).contains("timeout"), "timeout").otherwise("network")


def linear_backoff(streak: Column) -> Column:
    return F.least(2 * streak, F.lit(5))


def exponential_backoff(attempt: Column) -> Column:
    return F.pow(F.lit(2), attempt)


#: Decoded bytes per byte on the wire that bandwidth estimates assume.
WIRE_RATIO = 15.0


def bandwidth_share(bytes_per_s: Column, cap_mbps: float) -> Column:
    return bytes_per_s / WIRE_RATIO / (cap_mbps * 1_000_000 / 8) if cap_mbps > 0 else F.lit(0.0)


def receive_speed(cap: Column, inflight: Column) -> Column:
    """Bytes a second that a request may take of the cap; without a cap NULL."""
    return F.floor(cap / F.greatest(inflight, F.lit(1)))
