"""Baseline change detection and current state over an observation log.

Observations hold one row per sighting of a key, with a sequence that totally orders the sightings of a key. The
baseline of a sighting is what the last scheduled sighting (or the first one) showed; a change is a difference from it.
The log is scanned in parts of a range over key and sequence, so no task holds a key (``scans``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions import quality
from catalith.functions import scalars as X

from .scans import with_earlier


def admitted(observations: DataFrame) -> DataFrame:
    """Sightings that count: a key is there and the record is no parse failure. Fields that the table lacks count as missing."""
    fields = {f: F.col(f) if f in observations.columns else F.lit(None).cast("string") for f in ["title", *quality.GATE_FIELDS]}
    return observations.where((X.strip(F.coalesce(F.col("asin").cast("string"), F.lit(""))) != "") & ~quality.parse_failure(fields))


def detect_changes(observations: DataFrame, values: bool = True, places: bool = True) -> DataFrame:
    """Change rows: asin, batch_id, change_type, change_detail, with ``places`` seq, and with ``values`` prev_value and new_value.
    What is not asked for passes neither the scan nor the store.

    Needs asin, seq, batch_id, is_auto, title, bullet_points, current_price, buybox_price, stock_count, stock_status.
    Only sightings that are ``admitted`` count. A scheduled sighting replaces the whole baseline, NULLs included, hence the
    struct; without one the key's first sighting is the baseline.
    """
    shown = ["current_price", "buybox_price", "stock_count", "stock_status"] if values else ["current_price"]
    parsed = {
        "tb_hash": X.title_bullets_hash(), "price_n": X.parse_price(F.col("current_price")), "buybox_n": X.parse_price(F.col("buybox_price")),
        "stock_n": X.parse_int(F.col("stock_count")), "status_n": X.normal_status(F.col("stock_status")),
    }
    states = {"now": F.struct(*shown, *[c.alias(n) for n, c in parsed.items()])}
    tracks = {"auto": (F.coalesce("is_auto", F.lit(False)), "now")}
    if values:
        states["said"] = F.struct(F.col("title"))
        tracks["told"] = (F.col("title").isNotNull(), "said")
    slim = admitted(observations).select("asin", "seq", "batch_id", "is_auto", "title", "bullet_points", "current_price", "buybox_price", "stock_count", "stock_status")
    base, now = lambda name: F.col("base")[name], lambda name: F.col("now")[name]
    parts = {
        "price": X.compare(base("price_n"), now("price_n")),
        "buybox": X.compare(base("buybox_n"), now("buybox_n")),
        "stock_qty": X.compare(base("stock_n"), now("stock_n")),
        "stock_status": F.when(base("status_n") != now("status_n"), "changed"),
    }
    known = ~F.col("first_seen") & base("current_price").isNotNull()
    found = [
        {"base": F.coalesce("auto", "origin"), "asin": F.col("_key")},
        {
            "is_new": F.col("first_seen") & F.col("batch_id").isNotNull(),
            "detail": F.nullif(F.when(known, X.change_detail(parts)), F.lit("")),
            "retitled": known & (base("tb_hash") != now("tb_hash")),
        },
    ]
    if values:
        fields = {"price": "current_price", "buybox": "buybox_price", "stock": "stock_count", "status": "stock_status"}
        texts = {n: X.rendered({k: of(v) for k, v in fields.items()}) for n, of in (("old_values", base), ("new_values", now))}
        titles = {n: F.concat(F.lit("title="), X.truncated(F.col(c), 100)) for n, c in (("old_title", "told.title"), ("new_title", "said.title"))}
        found.append({**{n: F.when(F.col("detail").isNotNull(), c) for n, c in texts.items()}, **{n: F.when(F.col("retitled"), c) for n, c in titles.items()}})
    scanned = with_earlier(slim, "asin", "seq", ["seq", "batch_id"] if places else ["batch_id"], states, tracks, ("origin", "now"), found, ("base",))

    def change(holds: Column, kind: str, detail: Column, prev: str | None, new: str | None) -> Column:
        said = [(F.col(c) if c else F.lit(None).cast("string")).alias(n) for n, c in (("prev_value", prev), ("new_value", new))] if values else []
        return F.struct(F.when(holds, kind).alias("change_type"), detail.alias("change_detail"), *said)

    kinds = F.array(
        change(F.col("is_new"), "new", F.lit("first_seen"), None, None),
        change(F.col("detail").isNotNull(), "price_stock", F.col("detail"), "old_values", "new_values"),
        change(F.col("retitled"), "title_bullets", F.lit("title_or_bullets_changed"), "old_title", "new_title"),
    )
    changed = scanned.where("is_new OR detail IS NOT NULL OR retitled")
    return changed.select("asin", *(["seq"] if places else []), "batch_id", F.inline(kinds)).where("change_type IS NOT NULL")


def current_state(observations: DataFrame, fields: list[str]) -> DataFrame:
    """Latest known value of each field: a NULL never overwrites. One pre-aggregated pass, no window."""
    latest = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    return observations.groupBy("asin").agg(*latest, F.max("seq").alias("seq"))


def change_stats(changes: DataFrame, batch_id: int | None = None) -> DataFrame:
    """Distinct changed keys per type; types without changes have no row."""
    some = changes if batch_id is None else changes.where(F.col("batch_id") == batch_id)
    return some.groupBy("change_type").agg(F.countDistinct("asin").alias("n_keys"))


def change_history(changes: DataFrame, asin: str) -> DataFrame:
    return changes.where(F.col("asin") == asin).orderBy(F.desc("seq"))

