"""The pipeline stage by stage against brute force, and the guard of the driver entry."""

import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catalith.llm import common, quality, simhash, tokens

from .samples import documents, odd_rows
from .test_sets import brute_components, brute_contamination, brute_fingerprint, planted
from .test_tokens import check_packed

ROOT = Path(__file__).resolve().parent.parent.parent


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    from catalith.llm.tokens import tokenizer_path

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs, items = planted()
    documents(spark, docs).selectExpr("*", "1 AS label", "'x' AS digest").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    labels = [(i, int(i % 3 > 0)) for i in range(1200)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return at


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_in_turn(spark, tables, library):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    forest = quality.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    before = rows_of(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns
        after = rows_of(out)
        if name == "quality_gate":
            wanted = Counter(r for r in before if forest.score(quality.feature_rows([r[1]]))[0] >= quality.ACCEPT)
        elif name == "near_duplicate_removal":
            prints = [(r[0], brute_fingerprint(r[1])) for r in before]
            reach = brute_components(prints)
            assert len(after) == len({r.label for r in simhash.near_duplicates(docs).collect()})
            assert {(d, reach[brute_fingerprint(t)]) for d, t, *_ in after} == {(c, c) for c in {reach[f] for _, f in prints}}
            wanted = Counter(after)
            assert all(r in before for r in after)
        else:
            dirty = {(r[0]) for r in brute_contamination([(x[:2]) for x in before], [tuple(x) for x in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]) if r[5]}
            wanted = Counter(r for r in before if r[0] not in dirty)
            assert dirty
        assert Counter(after) == wanted
        docs, before = spark.createDataFrame(after, docs.schema), after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    check_packed(before, packed, library)
    run = corpus_pipeline.run(spark, tables).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in run if r.start == 0) == Counter((r.doc_id, r.doc_tokens) for r in packed if r.start == 0)


def test_repeated_rows_and_ids(spark, tables):
    """Rows equal in all columns leave one; the dedup keeps one row of each component of the odd documents."""
    docs = documents(spark, [*odd_rows(), *odd_rows()])
    kept = corpus_pipeline.near_duplicate_removal(spark, docs, tables)
    once = corpus_pipeline.near_duplicate_removal(spark, documents(spark), tables)
    assert Counter(rows_of(kept)) == Counter(rows_of(once))


def test_rows_equal_in_id_and_text_leave_a_defined_one(spark, tables):
    rows = [(1, "the same text of both", lang, source, None) for lang, source in (("en", "b"), ("de", "z"), ("en", "a"))] + [(1, "another text altogether, of the same id", "en", None, 4)]
    for order in (rows, rows[::-1]):
        kept = corpus_pipeline.near_duplicate_removal(spark, documents(spark, order).repartition(3).selectExpr("*", "'k' AS row_key", "1 AS `a.b`"), tables)
        assert kept.columns[-2:] == ["row_key", "a.b"]
        assert {tuple(r)[:4] for r in kept.collect()} == {(1, "the same text of both", "de", "z"), (1, "another text altogether, of the same id", "en", None)}


@pytest.mark.parametrize("kind", ["int", "decimal(10,1)", "double", "long"])
def test_ids_of_any_numeric_type_give_the_same_survivors(spark, tables, kind):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id IS NOT NULL")
    typed = docs.withColumn("doc_id", docs.doc_id.cast(kind))
    for stage in (corpus_pipeline.near_duplicate_removal, corpus_pipeline.benchmark_decontamination):
        want, got = stage(spark, docs, tables), stage(spark, typed, tables)
        assert dict(got.dtypes)["doc_id"] == {"long": "bigint"}.get(kind, kind)
        assert 0 < got.count() < docs.count() and Counter((int(r.doc_id), r.text) for r in got.collect()) == Counter((r.doc_id, r.text) for r in want.collect())


def test_rows_at_places_in_waves(spark, tables, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "BITMAPS", 1)
    spark.range(200).selectExpr("id", "id % 7 AS file", "'x' AS bits").repartition(5).write.parquet(f"{tmp_path}/t")
    placed = common.with_places(spark.read.parquet(f"{tmp_path}/t"), "place")
    wanted = placed.where("id % 3 = 0").select("place.file", "place.row")
    got = common.at_places(placed, "place", wanted)
    assert got.columns == ["id", "file", "bits"] and sorted(r.id for r in got.collect()) == list(range(0, 200, 3))
    assert common.at_places(placed, "place", wanted.limit(0)).count() == 0


def test_near_duplicate_removal_shuffles_no_text(spark, tables):
    """The texts pass a join with broadcast bitmaps only."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    plan = corpus_pipeline.near_duplicate_removal(spark, docs, tables)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_more_dirty_keys_than_are_broadcast(spark, tables, monkeypatch):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    want = Counter(rows_of(corpus_pipeline.benchmark_decontamination(spark, docs, tables)))
    monkeypatch.setattr(corpus_pipeline, "KNOWN_DIRTY", 0)
    assert Counter(rows_of(corpus_pipeline.benchmark_decontamination(spark, docs, tables))) == want


def test_stages_free_the_words_that_packing_kept(spark, tables, monkeypatch):
    """A worker that has packed and comes to the gate or to fingerprints holds no table of words any more."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    texts = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some text"])], names=["doc_id", "text"])
    forest = quality.grow(quality.feature_rows([]), quality.np.zeros(0))
    runs = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a: runs.append(f) or self)
    simhash.fingerprints(docs)
    monkeypatch.setattr(quality.F, "arrow_udf", lambda kind: lambda f: lambda text: f)
    for stage in (lambda: list(runs[0](iter([texts]))), lambda: quality.accepts(forest, None)(texts.column(1))):
        tokens.encode_with_end(tokens.tokenizer_path(), ["some text"])
        assert tokens.encoder.cache_info().currsize == 1
        stage()
        assert tokens.encoder.cache_info().currsize == 0


def test_ascii_texts_are_lowered_without_a_string_for_each_character(spark):
    """Only texts with characters of several bytes pass through translate; both ways change A-Z alone."""
    texts = ["", "ABC xyz @[`{", "ÀÉ Straße İI ſK Σ", "Δ ABC", "\x00A\x7f", None, "A\U0001f600Z"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    lowered = rows.select(common.ascii_lower(F.col("text")).alias("low"))
    assert [r.low for r in lowered.collect()] == [t and "".join(c.lower() if c.isascii() else c for c in t) for t in texts]
    assert "lower(text" in lowered._jdf.queryExecution().executedPlan().toString()


def test_intermediate_tables_go(spark, tmp_path):
    table = common.written(spark.range(3), "some")
    at = table.stored_at.removeprefix("file:").replace("//", "/")
    assert Path(at).exists() and table.count() == 3
    common.discard(table)
    assert not Path(at).exists()


def test_empty_documents(spark, tables):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0


def test_entry_lives_without_this_subpackage(tmp_path):
    """The rest imports and registers its queries when the subpackage, its tests and the pipeline are gone."""
    for name in ("catalith", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), any(x.startswith('op') for x in q))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)
    n, ops = said.stdout.split()
    assert int(n) > 30 and ops == "False"


def test_nothing_else_imports_this_subpackage():
    for path in (ROOT / "catalith").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "catalith.llm" not in path.read_text()
