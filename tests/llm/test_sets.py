"""Decontamination, sharding and SimHash against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catalith.llm import decontam, sharding, simhash

from .samples import clashing, documents, odd_rows, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(UPPER)


# --- decontamination -----------------------------------------------------------------------------------------------


def brute_contamination(docs, items):
    wanted = defaultdict(set)
    for item, text in items:
        w = WORD.findall(low(text))
        for i in range(max(len(w) - 12, 1) if w else 0):
            wanted[tuple(w[i : i + 13])].add(str(item))
    sizes = {len(x) for x in wanted}
    out = []
    for doc, text, *_ in docs:
        w, hit, found = WORD.findall(low(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := wanted.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return Counter(out)


def planted():
    rng = random.Random(2)
    items = [(i, words(rng, n)) for i, n in enumerate([13, 14, 40, 12, 1, 5, 0, 30])] + [(8, None), (9, "repeat " * 20), (2, words(rng, 20)), (11, "Alone")]
    docs = odd_rows()
    for i, (_, text) in enumerate(items):
        docs.append((1000 + i, f"{words(rng, 30)} -- {(text or '').upper() if i % 2 else text} ** {words(rng, 30)}", None, None, None))
    docs.append((1100, "repeat " * 500, None, None, None))
    docs.append((1101, " ".join(items[2][1].split()[5:17]), None, None, None))  # 12 words of a longer item: clean
    docs.append((1102, items[2][1] + " " + " ".join(str(i) for i in range(800)), None, None, None))  # hit, under a twentieth
    return docs, items


def test_decontamination(spark):
    docs, items = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(documents(spark, docs), bench).drop("digest").collect()
    assert Counter(map(tuple, got)) == brute_contamination(docs, items)


@pytest.mark.parametrize("most_bits", [1 << 31, 1 << 15])
def test_decontamination_by_a_bitmap(spark, monkeypatch, most_bits):
    """A benchmark above the broadcast bounds, with a bitmap that passes few or many other shingles."""
    monkeypatch.setattr(decontam, "KNOWN_SHINGLES", 7)
    monkeypatch.setattr(decontam, "KNOWN_WINDOWS", 7)
    monkeypatch.setattr(decontam, "MOST_BITS", most_bits)
    docs, items = planted()
    got = decontam.decontaminate(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).drop("digest").collect()
    assert Counter(map(tuple, got)) == brute_contamination(docs, items)


def test_decontamination_keeps_no_positions_of_common_shingles(spark, monkeypatch):
    """A benchmark window of words that every document repeats, with a rare one: only the rare one's place is kept."""
    stored = {}
    write = decontam.written
    monkeypatch.setattr(decontam, "written", lambda df, name: stored.setdefault(name, write(df, name)))
    common = "to be or not to be or not"
    docs = [(i, f"{common} " * 50, None, None, None) for i in range(20)] + [(100, f"{common} rare words here that close", None, None, None)]
    items = [(1, f"{common} rare words here that close")]
    got = decontam.decontaminate(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).drop("digest").collect()
    assert Counter(map(tuple, got)) == brute_contamination(docs, items)
    assert stored["bench-positions"].where("pos IS NOT NULL").count() == 1


def test_decontamination_scans_the_documents_twice(spark, monkeypatch):
    """Once for counts, once for the positions of prefixes."""
    seen = []
    keyed = decontam._keyed
    monkeypatch.setattr(decontam, "_keyed", lambda docs: seen.append(1) or keyed(docs))
    docs, items = planted()
    got = decontam.decontaminate(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert len(seen) == 2 and got.count() == len(docs) and "ExistingRDD" not in got._jdf.queryExecution().toString()


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontam.decontaminate(clashing(spark), none).collect()
    assert [(r.n_hit, r.contaminated) for r in got] == [(0, False)] * 2
    assert decontam.decontaminate(documents(spark, []), none).count() == 0


def test_decontamination_oracle(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    got = decontam.decontaminate(read("documents"), read("benchmark")).drop("digest").collect()
    assert Counter(map(tuple, got)) == Counter(con.execute(decontam.ORACLE).fetchall())


# --- sharding ------------------------------------------------------------------------------------------------------


class Known(sharding.Groups):
    """Groups whose stops are in memory; buckets are made as the table would make them."""

    def __init__(self, stops, buckets):
        self.stops = stops
        self.buckets, self.total = buckets, stops[-1] if stops else 0
        self.ends = []
        if self.total:
            self.width = max(1, -(-self.total // buckets))
            self.ends = self._buckets([(1, self.total)])

    def _buckets(self, spans):
        out = defaultdict(list)
        for s in self.stops:
            for k, (a, z) in enumerate(spans):
                if a <= s <= z:
                    out[k, (s - 1) // self.width].append(s)
        return sorted((min(v), max(v)) for v in out.values())


def brute_minimax(sizes, shards):
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    now = list(total)  # least largest shard for so many groups
    for _ in range(shards - 1):
        now = [min([now[i], *(max(now[j], total[i] - total[j]) for j in range(i))]) for i in range(len(total))]
    return now[-1]


@settings(max_examples=200, deadline=None)
@given(sizes=st.lists(st.integers(1, 60), min_size=1, max_size=25), shards=st.integers(1, 7), buckets=st.sampled_from([1, 2, 3, 1000]))
def test_minimax_is_least(sizes, shards, buckets):
    stops = np.cumsum(sizes).tolist()
    capacity, ends = sharding.minimax_cuts(Known(stops, buckets), shards)
    parts = np.diff([0, *ends]).tolist()
    assert ends[-1] == stops[-1] and set(ends) <= set(stops) and len(ends) <= shards
    assert max(parts) == brute_minimax(sizes, shards) == max(capacity, max(sizes))  # a group above the capacity stands alone


def test_shards(spark):
    rows = odd_rows()
    got = sharding.shard(documents(spark), 5).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    of_text, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        of_text[r.text_crc32, r.size].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 5
    assert all(len(s) == 1 for s in of_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for _, t, *_ in rows:
        groups[t or ""] += size(t)
    assert max(load.values()) >= max(groups.values())


def test_shards_are_near_equal(spark):
    rows = [(i, f"text {i} " + "x" * (i % 50), None, None, None) for i in range(4000)]
    load = Counter()
    for r in sharding.shard(documents(spark, rows)).collect():
        load[r.shard] += r.size
    assert len(load) == 40 and max(load.values()) < 1.02 * sum(load.values()) / 40


def test_shards_of_few_and_no_rows(spark):
    assert sharding.shard(documents(spark, [])).count() == 0
    assert sorted(r.slot for r in sharding.shard(clashing(spark)).collect()) == [0, 0]


# --- SimHash -------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """(row, fingerprint) pairs: smallest id that each fingerprint reaches."""
    prints = sorted({f for _, f in fps})
    of = {f: f for f in prints}

    def root(f):
        while of[f] != f:
            f = of[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                of[root(a)] = root(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return {f: least.get(root(f)) for f in prints}


def test_fingerprints(spark):
    got = simhash.near_duplicates(documents(spark)).collect()
    rows = [(d, brute_fingerprint(t)) for d, t, *_ in odd_rows()]
    reach = brute_components(rows)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((d, f"{f:016x}", reach[f]) for d, f in rows)


def near_prints(rng, centres, each):
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        out.append(c)
        for _ in range(each):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("cell", [5_000, 3])
def test_links_of_close_prints(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(cell)
    prints = near_prints(rng, 12, 60)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    pairs = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    labels = {r.node & (2**64 - 1): r.label for r in simhash.components(pairs).collect()}
    got = defaultdict(set)
    for p in prints:
        got[labels.get(p, ("alone", p))].add(p)
    reach = brute_components(list(enumerate(prints)))
    wanted = defaultdict(set)
    for p in prints:
        wanted[reach[p]].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_one_document_of_each_component_survives(spark):
    kept = simhash.survivors(documents(spark)).collect()
    components = {(r.label, r.component_id) for r in simhash.near_duplicates(documents(spark)).collect()}
    assert Counter(r.doc_id for r in kept) == Counter(c for _, c in components)


def test_simhash_of_few_and_no_rows(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.near_duplicates(clashing(spark)).count() == 2


def test_members_of_a_shared_half_are_cut_into_cells(spark, monkeypatch):
    """Prints that share a half which is no anchor crowd 16 anchors, 15 of them without a centre."""
    monkeypatch.setattr(simhash, "CELL", 50)
    prints = spark.createDataFrame([(int((i * 2654435761) % 2**31 << 31 | 1),) for i in range(1000)], "fp long")
    anchored = prints.mapInArrow(simhash._replicate, simhash.ANCHORED)
    sizes = [r["count"] for r in simhash._in_cells(anchored, prints).groupBy("anchor", "cell").count().collect()]
    assert max(sizes) <= 300
