"""One large file read by many tasks, and searches through an index, against the plain versions."""

import csv
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalith.operators import results, search_index
from catalith.sources import identifiers, ragged


@pytest.fixture
def small_ranges(spark):
    kept = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in kept}
    for k, v in kept.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def module_cells(content):
    return [c for row in csv.reader(io.StringIO(content.decode("utf-8-sig", "ignore"), newline="")) for c in row]


def ragged_text(rng, rows):
    """Quoted cells with quotes, commas and line ends, stray quotes, blank lines, all kinds of line ends."""
    some = ["B00000000A", "x", "", " padded ", 'say "hi"', "two\nlines", "a,b", "é", "cr\rlf\r\nend", 'lone"quote', "日本語", "long " * 30]
    out = []
    for _ in range(rows):
        cells = []
        for _ in range(rng.randrange(5)):
            c = rng.choice(some)
            cells.append('"' + c.replace('"', '""') + '"' if any(x in c for x in ",\n\r") or rng.random() < 0.3 else c)
        out.append(",".join(cells) + rng.choice(["\n", "\n", "\r\n", "\r"]))
    return "".join(out)


@pytest.mark.parametrize("seed", range(6))
def test_cells_of_a_file_in_many_ranges(spark, small_ranges, tmp_path, seed):
    rng = random.Random(seed)
    content = (b"\xef\xbb\xbf" if seed % 2 else b"") + ragged_text(rng, 200).encode() + [b"", b"a,\xff\xc3\n,b", b'open "at,"the end,x', b'"never\nclosed, x', b'"""', b"\n\n\n"][seed]
    (tmp_path / "x.csv").write_bytes(content)
    got = ragged.read_cells(spark, str(tmp_path / "x.csv"))
    assert [r.cell for r in got.orderBy("block", "at").collect()] == module_cells(content)
    assert got.select("block").distinct().count() > 20  # ranges, each read by itself


def test_a_record_over_many_ranges(spark, small_ranges, tmp_path):
    content = b"first\n" + b'"' + b"line of it\n" * 200 + b'end",next\nlast,"\n"\n'
    (tmp_path / "x.csv").write_bytes(content)
    (tmp_path / "y.csv").write_bytes(b'other,"file\n')
    got = ragged.read_cells(spark, str(tmp_path)).orderBy("path", "block", "at").collect()
    assert [r.cell for r in got] == [*module_cells(content), "other", "file"]


def test_identifiers_of_a_large_file_are_read_by_many_tasks(spark, small_ranges, tmp_path):
    ids = [f"B{i:09d}" for i in range(300)]
    (tmp_path / "x.csv").write_text("".join(f'"a\nb {i}",{a}\n' for i, a in enumerate(ids)) + f"{ids[0]}\n")
    got = identifiers.read_identifiers(spark, str(tmp_path / "x.csv")).orderBy("position").collect()
    assert [r.asin for r in got] == ids and len({r.position.block for r in got}) > 40


def test_empty_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"")
    assert ragged.read_cells(spark, str(tmp_path / "x.csv")).count() == 0


@pytest.mark.parametrize(("line", "inside", "after"), [("a,b", False, False), ('a,"b', False, True), ('b",c', True, False), ('x"y', False, False), ('a,"b""', False, True), ('""', True, True), ('"', True, False), ('","', True, True), ("", True, True)])
def test_states_of_lines(line, inside, after):
    assert ragged.inside_after(line, inside) is after


# --- search --------------------------------------------------------------------------------------------------------


def entities(spark, n=3000):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé#1 ") for _ in range(rng.randrange(1, 12)))
    rows = [(f"B{i:05d}", i, rng.choice([None, word() + " Ring", word()]), rng.choice([None, "Brand#1", word()])) for i in range(n)]
    return spark.createDataFrame(rows, "asin string, id long, title string, brand string")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return search_index.build(entities(spark), str(tmp_path_factory.mktemp("index")), block_rows=100)


@pytest.mark.parametrize("text", ["ring", "RING, #1", "abc", "a", "é#", "b0001", "nowhere at all", "", ",\n,", "b ri,dea,x", "ab\ncd", "B00017"])
def test_search_equals_a_scan(spark, index, text):
    want = results.ResultQuery(entities(spark)).search(text).rows()
    got = index.search(text)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_only_the_terms_buckets_and_grams_are_read(spark, index):
    kept = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = index.postings(["ring"])._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", kept)
    assert "PartitionFilters: [bucket" in plan and "In(gram, [ing,rin])" in plan
    asked = index.postings(["ring"])
    assert len(asked.inputFiles()) > 0 and {r.wanted for r in asked.collect()} == {2}
    read = spark.read.parquet(f"{index.folder}/postings")
    buckets = read.where(F.col("gram").isin("ing", "rin")).select("bucket").distinct().count()
    assert buckets <= 2 and read.select("bucket").distinct().count() == search_index.BUCKETS


def test_an_index_of_nothing(spark, tmp_path):
    made = search_index.build(entities(spark).limit(0), str(tmp_path / "index"))
    assert made.search("ring").count() == 0 and made.search(None).count() == 0


def test_the_grams_of_a_block_are_made_entity_by_entity():
    """Batches of a block, with a key of many rows, missing fields and a missing key."""
    rows = [(7, i % 3, f"Ab{i % 5}", "x" if i % 2 else None) for i in range(90)] + [(7, 50, "", None), (7, None, "zz", "zz"), (7, 51, "äöü", "ab")]
    schema = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("_0", pa.string()), ("_1", pa.string())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 20], strict=True), schema.types, strict=True)], schema=schema) for i in range(0, len(rows), 20)]
    (made,) = search_index._listed(pa.int64())((pa.scalar(7),), iter(batches))
    want = {}
    for _, key, *texts in rows:
        for t in texts if key is not None else []:
            for n in (1, 2, 3):
                for i in range(len(t or "") - n + 1):
                    want.setdefault(t[i : i + n], set()).add(key)
    assert {r["gram"]: (r["block"], r["keys"]) for r in made.to_pylist()} == {g: (7, sorted(k)) for g, k in want.items()}
