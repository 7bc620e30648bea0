"""Record and response classification: missing values, parse failures, block pages, the post-parse ladder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts that stand for a missing value, one set per use.
MISSING = ["", "N/A", "n/a", "None", "none"]
MISSING_CORE = ["", "N/A", "n/a", "N/a", "None", "0"]
FOREIGN_MARKS = ["CNY", "¥", "€", "£"]
#: Prices that are states of a page and no amounts.
PRICE_STATES = ["N/A", "不可售", "See price in cart", "No Featured Offer"]
GATE_FIELDS = ["current_price", "buybox_price", "stock_count", "stock_status", "brand"]
NOT_FOUND, EMPTY_PAGE, UNPARSED = "[商品不存在]", "[页面为空]", "[HTML解析失败]"
#: Titles of block pages by kind.
BLOCK_TITLES = {"captcha": "[验证码拦截]", "api_block": "[API封锁]"}
IDENTIFIER = r"^B[0-9A-Z]{9}$"
WORKER_ID = r"^[\w\-]{1,64}$"


def missing(c: Column) -> Column:
    return c.isNull() | c.isin(MISSING)


def missing_core(c: Column) -> Column:
    return c.isNull() | c.isin(MISSING_CORE)


def valid_identifier(c: Column) -> Column:
    from .scalars import strip

    return F.upper(strip(c)).rlike(IDENTIFIER)


def valid_worker_id(c: Column) -> Column:
    return F.coalesce(c.rlike(WORKER_ID), F.lit(False))


def foreign_price(price: Column, mark: str) -> Column:
    """Whether a price was read outside of the home region: marked so, in another currency, or digits without a dollar sign."""
    digits = F.btrim(F.translate(price, ",.", "")).rlike(r"^\p{Nd}+$")
    abroad = price.contains(mark) | reduce(lambda a, b: a | b, [price.contains(m) for m in FOREIGN_MARKS]) | (~price.contains("$") & digits)
    return F.coalesce((price != "") & ~price.isin(PRICE_STATES) & abroad, F.lit(False))


def parse_failure(columns: dict[str, Column] | None = None) -> Column:
    """A shell without data: no valid title with brand, and every gate field missing."""
    c = columns or {f: F.col(f) for f in ["title", *GATE_FIELDS]}
    titled = ~missing(c["title"]) & ~c["title"].startswith("[")
    return ~(titled & ~missing(c["brand"])) & reduce(lambda a, b: a & b, [missing(c[f]) for f in GATE_FIELDS])


def block_page(body: Column) -> Column:
    """Kind of block page a body is, or NULL."""
    return (
        F.when(body.contains("validateCaptcha"), "captcha")
        .when(body.contains("Robot Check"), "captcha")
        .when(body.contains("api-services-support@amazon.com") & (F.length(body) < 20_000), "api_block")
    )


def response_class(status: Column, body: Column) -> Column:
    """missing, blocked, empty or ok, from the stored status and body."""
    return (
        F.when(status == 404, "missing")
        .when(status.isin(403, 503), "blocked")
        .when(block_page(body).isNotNull(), "blocked")
        .when((status == 200) & (F.length(F.coalesce(body, F.lit(""))) < 1000), "empty")
        .otherwise("ok")
    )


def record_class(block: Column, title: Column, price: Column, core: list[Column], foreign: str) -> Column:
    """struct(class, error_type, retryable) of a parsed record, the first rule that holds. A missing page's record is a
    success."""

    def verdict(name: str, error: str | None, retry: bool) -> Column:
        return F.struct(F.lit(name).alias("class"), F.lit(error).cast("string").alias("error_type"), F.lit(retry).alias("retryable"))

    degraded = reduce(lambda a, b: a & b, [missing_core(c) for c in core])
    return (
        F.when(block == "captcha", verdict("captcha", "captcha", True))
        .when(block == "api_block", verdict("api_block", "blocked", True))
        .when(title.isin(EMPTY_PAGE, UNPARSED), verdict("parse_error", "parse_error", True))
        .when(title == NOT_FOUND, verdict("missing", None, False))
        .when(title.isNull() | title.isin("", "N/A"), verdict("blank_title", "parse_error", True))
        .when(foreign_price(price, foreign), verdict("foreign_price", "parse_error", True))
        .when(degraded, verdict("degraded", "parse_error", True))
        .otherwise(verdict("ok", None, False))
    )


def region_ok(widget: Column, body: Column, zip_code: str) -> Column:
    """Whether a page shows the home region: its location names the postal code, or without one no other currency stands in
    the first 50,000 characters (the rule's own limit)."""
    head = F.substring(body, 1, 50_000)
    abroad = reduce(lambda a, b: a | b, [head.contains(m) for m in FOREIGN_MARKS])
    return F.when(F.coalesce(widget, F.lit("")) != "", widget.contains(zip_code)).otherwise(~F.coalesce(abroad, F.lit(False)))
