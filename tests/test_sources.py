"""Identifier files, settings, stored pages and export sinks."""

import csv
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from catalith.sources import exports, identifiers, workbooks

A, B, C = "B000000001", "B00000000A", "BABCDEFGHI"


def test_text(spark, tmp_path):
    at = tmp_path / "ids.txt"
    at.write_bytes(f"\ufeff{A}\r\n  {B.lower()} \u0085{C}\u2028B123\nX{A} {A}\n\n\x1c{B}".encode() + b"\nB00000000\xffZ\n")
    got = identifiers.read_identifiers(spark, str(at)).orderBy("position").collect()
    assert [r.asin for r in got] == [A, B, C, "B00000000Z"]


def test_csv_reads_every_cell(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(f'name\nrow,"{A}","multi\nline {B}"\n{B},,,,,,," {C} "\n'.encode())
    got = identifiers.read_identifiers(spark, str(tmp_path / "x.csv")).orderBy("position").collect()
    assert [r.asin for r in got] == [A, B, C]


def test_xlsx_round_trip(spark, tmp_path):
    rows = [(A, "x<&>\"y\"", 1), (None, "é\x01", 2), (B.lower(), "", None)]
    made = exports.workbooks(spark.createDataFrame(rows, "asin string, `odd.name` string, n int").coalesce(1)).collect()
    assert [r.rows for r in made] == [3]
    (tmp_path / "w.xlsx").write_bytes(made[0].content)
    assert list(identifiers.xlsx_cells(made[0].content)) == ["asin", "odd.name", "n", A, 'x<&>"y"', "1", "é", "2", B.lower()]
    assert {r.asin for r in identifiers.read_identifiers(spark, str(tmp_path / "w.xlsx")).collect()} == {A, B}


def test_workbooks_are_cut(spark):
    made = exports.workbooks(spark.range(25).coalesce(1), rows_per_file=10).collect()
    assert [r.rows for r in made] == [10, 10, 5] and len({r.name for r in made}) == 3
    assert exports.workbooks(spark.range(0)).count() == 0


def test_shared_strings_and_active_sheet():
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="a" r:id="r1"/><sheet name="b" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData><row><c><v>9</v></c></row></sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {main}><sheetData><row><c t="s"><v>1</v></c><c/><c><v>4</v></c></row></sheetData></worksheet>')
    assert list(identifiers.xlsx_cells(buffer.getvalue())) == ["two", "4"]
    assert list(identifiers.xlsx_cells(b"not a zip")) == []


def parts(path):
    return [p.read_bytes() for p in sorted(path.glob("part-*"))]


def test_csv_export(spark, tmp_path):
    rows = [(i, f'say "{i}", please\nnow' if i % 2 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, `the text` string").repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the few rows of a test are put into one part
    try:
        exports.write_csv(df, str(tmp_path / "out"), order="id")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    raw = b"".join(parts(tmp_path / "out"))
    assert len(parts(tmp_path / "out")) > 1 and raw.startswith(b"\xef\xbb\xbf") and raw.endswith(b"\r\n") and raw.count(b"\xef\xbb\xbf") == 1
    lines = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline="")))
    assert lines == [["id", "the text"], *[[str(i), t or ""] for i, t in rows]]


def test_empty_csv_export_has_a_header(spark, tmp_path):
    exports.write_csv(spark.createDataFrame([], "a string, b string").coalesce(1), str(tmp_path / "none"))
    assert b"".join(parts(tmp_path / "none")) in (b"\xef\xbb\xbfa,b\r\n", b"")


def test_settings(spark, tmp_path):
    (tmp_path / "env").write_text("# note\nA = 1\n\nB='two=2'\nA=3\nbroken\n")
    assert identifiers.read_settings(spark, str(tmp_path / "env"), {"A": "0", "Z": "z"}) == {"A": "1", "B": "two=2", "Z": "z"}
    (tmp_path / "s.json").write_text('{"rate": 5,\n "odd": 1}')
    assert identifiers.read_json_settings(spark, str(tmp_path / "s.json"), {"rate": 1, "most": 2}) == {"rate": 5, "most": 2}


def test_settings_are_written_and_read(spark, tmp_path):
    at = str(tmp_path / "settings.json")
    for version in (1, 2):
        identifiers.write_json_settings(spark, at, {"a": "ü", "b": 2.5, "version": version})
    assert identifiers.read_json_settings(spark, at, {"a": "", "b": 0.0, "version": 0, "c": 9}) == {"a": "ü", "b": 2.5, "version": 2, "c": 9}
    assert not (tmp_path / "settings.json.new").exists()


def test_pending_pages(spark, tmp_path):
    for name in ("b1/B1.html", "b1/_tmp.html", "_x/B2.html", "b2/B3.html", "b1/note.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("<p>é</p>")
    got = identifiers.pending_pages(spark, str(tmp_path), spark.createDataFrame([("b2",)], "batch string")).collect()
    assert [tuple(r) for r in got] == [("b1", "B1", "<p>é</p>")]


@pytest.mark.parametrize(("text", "ok"), [(A, True), (f" {B.lower()}　", True), ("A000000001", False), (A + "1", False), ("", False), (None, None)])
def test_identifier_rule(spark, text, ok):
    from catalith.functions import quality

    row = spark.createDataFrame([(text,)], "c string").select(quality.valid_identifier(F.col("c")).alias("v")).first()
    assert row.v is ok


# --- the xlsx data source ------------------------------------------------------------------------------------------


def test_workbooks_as_a_data_source(spark, tmp_path):
    at = f"{tmp_path}/books"
    df = spark.range(25).selectExpr("id", "concat('t<', id, '>') AS title", "CAST(NULL AS double) AS none").repartition(3)
    workbooks.write_workbooks(df, at, rows_per_file=4)
    names = sorted(p.name for p in (tmp_path / "books").iterdir())
    assert all(n.endswith(".xlsx") for n in names) and len(names) >= 7
    read = spark.read.format("xlsx").load(at)
    assert read.rdd.getNumPartitions() == len(names)
    rows = [r.cells for r in read.where("row > 0").collect()]
    assert sorted(rows, key=lambda r: int(r[0])) == [[str(i), f"t<{i}>"] for i in range(25)]
    assert {tuple(r.cells) for r in read.where("row = 0").collect()} == {("id", "title", "none")}
    workbooks.write_workbooks(df.limit(2), f"file://{at}", mode="overwrite")
    assert spark.read.format("xlsx").load(f"file:{at}").where("row > 0").count() == 2
    one = next((tmp_path / "books").glob("*.xlsx"))
    assert spark.read.format("xlsx").load(str(one)).count() > 1
    workbooks.write_workbooks(df.limit(0), f"{tmp_path}/none")
    assert not list(tmp_path.glob("none/*"))


def test_an_aborted_job_leaves_no_file(spark, tmp_path):
    at = tmp_path / "books"
    good = spark.range(30).repartition(3)
    workbooks.write_workbooks(good, str(at))
    before = sorted(p.name for p in at.iterdir())
    bad = good.withColumn("v", F.when(F.col("id") == 17, F.raise_error(F.lit("bad row"))).otherwise(F.lit("x")))
    with pytest.raises(Exception, match="bad row"):
        workbooks.write_workbooks(bad, str(at), rows_per_file=2)
    assert sorted(p.name for p in at.iterdir()) == before


def test_settings_are_replaced_in_one_step(spark, tmp_path):
    at = str(tmp_path / "settings.json")
    for n in range(3):
        identifiers.write_json_settings(spark, at, {"a": n, "name": "é"})
        assert identifiers.read_json_settings(spark, at, {"a": None, "name": None}) == {"a": n, "name": "é"}
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["settings.json"]
