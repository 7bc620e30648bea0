"""Segmented scans and baseline change detection against row-by-row versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalith.operators import changes
from catalith.operators.scans import earlier_states


@pytest.fixture
def cut_up(spark):
    """Parts and Arrow batches of a few rows."""
    kept = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in kept}
    for k, v in kept.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def log(rng, n, keys):
    return [(rng.choice(keys), i, rng.random() < 0.1, rng.choice([None, "t", f"title {i}"]), rng.choice([None, i])) for i in range(n)]


@pytest.mark.parametrize("keys", [["hot"], ["hot"] * 6 + list("abcdefgh") + [None], [None, "x"], [f"k{i}" for i in range(200)]], ids=["one", "half", "null", "many"])
def test_earlier_states(spark, cut_up, keys):
    rng = random.Random(len(keys))
    rows = log(rng, 600, keys)
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, seq long, auto boolean, title string, n long")
    states = {"at": F.struct(F.col("n")), "said": F.struct(F.col("title"))}
    result = F.array(F.struct("k", "seq", "base", "told", "origin", "first_seen"))
    got = earlier_states(df, "k", "seq", ["k", "seq"], states, {"base": (F.col("auto"), "at"), "told": (F.col("title").isNotNull(), "said")}, ("origin", "at"), result)
    assert got.columns == ["k", "seq", "base", "told", "origin", "first_seen"]
    want, state = Counter(), {}
    for k, seq, auto, title, n in rows:
        seen = k in state
        base, told, origin = state.get(k, (None, None, (n,)))
        want[(k, seq, base, told, origin, not seen)] += 1
        state[k] = ((n,) if auto else base, (title,) if title is not None else told, origin)
    assert Counter((r.k, r.seq, r.base and tuple(r.base), r.told and tuple(r.told), tuple(r.origin), r.first_seen) for r in got.collect()) == want


def test_no_task_holds_a_hot_key(spark, cut_up):
    """A key with half of the log lies in several parts, and each part has about its share of the rows."""
    rng = random.Random(1)
    rows = log(rng, 4000, ["hot"] * 10 + [f"k{i}" for i in range(10)])
    df = spark.createDataFrame(rows, "k string, seq long, auto boolean, title string, n long")
    got = earlier_states(df, "k", "seq", ["k", "seq"], {"at": F.struct(F.col("n"))}, {"base": (F.col("auto"), "at")}, ("origin", "at"), F.array(F.struct("k", "seq", "base", "_part")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan.split("BroadcastExchange")[0]
    parts = got.where("k = 'hot'").groupBy("_part").count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 1500


def test_empty_log(spark):
    df = spark.createDataFrame([], "k string, seq long, auto boolean, n long")
    assert earlier_states(df, "k", "seq", ["k"], {"at": F.struct(F.col("n"))}, {"base": (F.col("auto"), "at")}, ("origin", "at"), F.array(F.struct("k"))).count() == 0


OBSERVED = "asin string, seq long, batch_id long, is_auto boolean, title string, brand string, bullet_points string, current_price string, buybox_price string, stock_count string, stock_status string"


def brute_changes(rows):
    """The rules row by row."""
    base, out = {}, Counter()
    title = {}
    number = lambda v: float(v[1:]) if v and v.startswith("$") else None
    whole = lambda v: int(v) if v and v.isdigit() else None
    side = lambda a, b: None if a is None or b is None or a == b else "up" if b > a else "down"
    gone = lambda v: v in (None, "", "N/A")
    for asin, seq, batch, auto, name, brand, bullets, price, buybox, stock, status in rows:
        if not (asin or "").strip():
            continue
        if not (not gone(name) and not name.startswith("[") and not gone(brand)) and all(map(gone, (price, buybox, stock, status, brand))):
            continue
        now = (price, buybox, stock, status, f"{name or ''}|{bullets or ''}")
        if asin not in base:
            base[asin] = now
            if batch is not None:
                out[(asin, seq, "new", "first_seen", None, None)] += 1
        else:
            old = base[asin]
            if old[0] is not None:
                parts = {"price": side(number(old[0]), number(price)), "buybox": side(number(old[1]), number(buybox)), "stock_qty": side(whole(old[2]), whole(stock))}
                parts["stock_status"] = "changed" if old[3] is not None and status is not None and old[3].strip().lower() != status.strip().lower() else None
                if any(parts.values()):
                    shown = ["price={}, buybox={}, stock={}, status={}".format(*v[:4]) for v in (old, now)]
                    out[(asin, seq, "price_stock", ", ".join(f"{k}:{v}" for k, v in parts.items() if v), *shown)] += 1
                if old[4] != now[4]:
                    out[(asin, seq, "title_bullets", "title_or_bullets_changed", f"title={title.get(asin) or ''}", f"title={name or ''}")] += 1
            if auto:
                base[asin] = now
        if name is not None:
            title[asin] = name
    return out


def test_changes_of_a_hot_key(spark, cut_up):
    rng = random.Random(9)
    some = lambda *v: rng.choice(v)
    rows = [
        (some("H", "H", "H", "A", "B", " ", None), i, some(None, 1, 2), rng.random() < 0.15, some("Title", "Title two", "[gone]", "N/A"), some("Brand", "Brand", "N/A"), some("x", None), some("$5", "$6.5", "N/A", None), some("$5", None), some("3", "4", "N/A"), some("In Stock", " in stock", "Gone", None))
        for i in range(700)
    ]
    rows += [("A", 700 + i, 1, True, "[captcha]", None, None, "N/A", None, "", None) for i in range(5)]  # parse failures leave the baseline
    rows += [("A", 710 + i, 1, False, "Title", "Brand", "x", f"${i}", None, None, None) for i in range(3)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), OBSERVED)
    got = Counter((r.asin, r.seq, r.change_type, r.change_detail, r.prev_value, r.new_value) for r in changes.detect_changes(df).collect())
    assert got == brute_changes(rows)
    slim = Counter((r.asin, r.seq, r.change_type, r.change_detail) for r in changes.detect_changes(df, values=False).collect())
    assert slim == Counter({k[:4]: n for k, n in got.items()})


def test_admitted(spark):
    rows = [("A", "Title", "Brand", None), ("A", "[x]", "Brand", "N/A"), ("A", "[x]", None, "N/A"), ("A", "[x]", None, "$1"), (" ", "Title", "Brand", "$1"), (None, "Title", "Brand", "$1")]
    df = spark.createDataFrame(rows, "asin string, title string, brand string, current_price string")
    assert [tuple(r) for r in changes.admitted(df).collect()] == [rows[0], rows[1], rows[3]]
