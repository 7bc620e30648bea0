"""Result queries: search, facets, keyset pages, path lookup, deletion sets and export projections."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions import scalars as X

# The fields of the export preset.
PRICE_STOCK = frozenset(
    "asin title current_price buybox_price buybox_shipping stock_count stock_status is_fba delivery_date total_price crawl_time updated_at".split()
)
MAX_PAGE = 200


def terms(search: str | None) -> list[str]:
    """Search terms: cut at commas and line ends, trimmed, empty ones dropped."""
    return [t.strip() for t in re.split(r"[\n,]+", search or "") if t.strip()]


def matches(columns: list[str], words: list[str], wildcards: bool = False) -> Column:
    """Any term in any column, case-insensitive and literal; with ``wildcards``, % and _ keep their LIKE meaning."""
    if not words:
        return F.lit(True)

    def hit(c: str, t: str) -> Column:
        if wildcards:
            pattern = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in t.lower())
            return F.lower(F.col(c).cast("string")).rlike(f"(?s){pattern}")
        return F.lower(F.col(c).cast("string")).contains(t.lower())

    return F.coalesce(reduce(lambda a, b: a | b, [hit(c, t) for t in words for c in columns]), F.lit(False))


@dataclass(frozen=True)
class ResultQuery:
    """A filtered view of entities; pages and totals share its one declarative plan."""

    entities: DataFrame
    key: str = "asin"
    order: str = "id"
    search_columns: list[str] = field(default_factory=lambda: ["asin", "title", "brand"])
    filters: tuple[DataFrame | Column, ...] = ()

    def where(self, condition: Column) -> ResultQuery:
        return replace(self, filters=(*self.filters, condition))

    def having_key_in(self, keys: DataFrame) -> ResultQuery:
        """Semi join: entities whose key is among ``keys``."""
        return replace(self, filters=(*self.filters, keys))

    def search(self, text: str | None, wildcards: bool = False) -> ResultQuery:
        words = terms(text)
        return self.where(matches(self.search_columns, words, wildcards)) if words else self

    def in_batch(self, members: DataFrame, batch_id: int | None) -> ResultQuery:
        return self if batch_id is None else self.having_key_in(members.where(F.col("batch_id") == batch_id).select(self.key))

    def changed(self, kind: str, changes: DataFrame, members: DataFrame, batch_id: int | None = None) -> ResultQuery:
        """Facet by change type; ``new`` within a batch reads the membership flag; unknown kinds filter nothing."""
        if kind == "new" and batch_id is not None:
            return self.having_key_in(members.where((F.col("batch_id") == batch_id) & F.col("is_new")).select(self.key))
        if kind not in ("price_stock", "title_bullets", "new"):
            return self
        some = changes.where(F.col("change_type") == kind)
        return self.having_key_in((some if batch_id is None else some.where(F.col("batch_id") == batch_id)).select(self.key))

    def rows(self) -> DataFrame:
        df = self.entities
        for f in self.filters:
            df = df.where(f) if isinstance(f, Column) else df.join(f, self.key, "left_semi")
        return df

    def total(self) -> DataFrame:
        return self.rows().agg(F.count("*").alias("total"))

    def page(self, cursor: int | None = None, limit: int = 50, direction: str = "next") -> DataFrame:
        """A page newest first, with one row more than ``limit`` if there are more; a top-k, never a full sort."""
        limit = min(max(1, limit), MAX_PAGE)
        df, order = self.rows(), F.col(self.order)
        if direction == "prev":
            df = df if cursor is None else df.where(order > cursor)
            return df.orderBy(order.asc()).limit(limit + 1).orderBy(order.desc())
        df = df if cursor is None else df.where(order < cursor)
        return df.orderBy(order.desc()).limit(limit + 1)


def cursors(page: DataFrame, order: str = "id") -> DataFrame:
    return page.agg(F.min(order).alias("next_cursor"), F.max(order).alias("prev_cursor"))


def latest_paths(items: DataFrame, shots: DataFrame, key: str, batch: str, path: str, at: list[str]) -> DataFrame:
    """Path of each item: the newest valid one of its (key, batch), else the newest valid one of its key."""
    valid = shots.where(X.normal_path(F.col(path)).isNotNull())
    newest = F.max_by(F.struct(F.col(path).alias("p")), F.struct(*at))["p"]
    own = valid.groupBy(key, batch).agg(newest.alias("__own"))
    any_ = valid.groupBy(key).agg(newest.alias("__any"))
    return items.join(own, [key, batch], "left").join(any_, key, "left").withColumn(path, F.coalesce("__own", "__any")).drop("__own", "__any")


def deletion_targets(explicit: DataFrame | None, hits: DataFrame | None, members: DataFrame | None) -> DataFrame | None:
    """Keys to delete: explicit ones and search hits together, within the batch if one is given; the batch alone means
    all of its members. None if nothing was asked for."""
    asked = [d for d in (explicit, hits) if d is not None]
    if not asked:
        return members.distinct() if members is not None else None
    keys = reduce(DataFrame.union, asked).distinct()
    return keys if members is None else keys.intersect(members)


def cascade(tables: dict[str, DataFrame], targets: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the targets' rows."""
    return {name: df.join(targets, key, "left_anti") for name, df in tables.items()}


def delete_batch(tables: dict[str, DataFrame], batch_id: int) -> dict[str, DataFrame]:
    """Tasks, membership, shots and changes of a batch go; entities stay."""
    return {name: df.where(F.coalesce(F.col("batch_id") != batch_id, F.lit(True))) for name, df in tables.items()}


# --- export --------------------------------------------------------------------------------------------------------


def chosen_fields(wanted: str | None, known: list[str]) -> list[str]:
    """Known fields among a comma-separated list; all if none is valid."""
    some = [f.strip() for f in (wanted or "").split(",") if f.strip() in known]
    return some or list(known)


def price_stock_fields(known: list[str]) -> list[str]:
    """The fields of the preset for prices and stock among the known ones, in their order; internal columns are not known."""
    return [f for f in known if f in PRICE_STOCK]


def export_projection(df: DataFrame, fields: list[str], labels: dict[str, str], with_total: bool = True) -> DataFrame:
    """Texts under their labels, empty for missing values, the total price right after the shipping column."""
    columns: list[Column] = []
    total = X.total_price(F.col("buybox_price"), F.col("buybox_shipping")).alias(labels.get("total_price", "total_price"))
    for f in fields:
        columns.append(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(labels.get(f, f)))
        if with_total and f == "buybox_shipping":
            columns.append(total)
    if with_total and "buybox_shipping" not in fields:
        columns.append(total)
    return df.select(*columns)
