"""Workbooks and keyed stores: round trips, what is read, what a failed write leaves."""

import glob
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from threadloom.sources import keyed_store, workbook


def test_workbooks_of_several_sheets_round_trip(spark, tmp_path):
    texts = ["plain", None, "<&>\"' é你", " kept \n lines\r\n", "", "x" * 5000, "ctrl\x01gone"]
    notes = spark.createDataFrame([(i, texts[i % 7], [i, None]) for i in range(25)], "id int, text string, list array<int>")
    few = spark.createDataFrame([(1, "a")], "n int, `odd name` string")
    path = f"file://{tmp_path}/books"
    workbook.write_workbooks({"Contents": (notes, ["id"]), "Comments": (few, ["n"]), "Creators": (few.limit(0), ["n"])}, path, "all", most_rows=10)
    assert sorted(os.listdir(f"{tmp_path}/books")) == ["all-00000.xlsx", "all-00001.xlsx", "all-00002.xlsx"]
    got = workbook.read_workbook(spark, path, "Contents")
    assert got.columns == ["id", "text", "list", "_file", "_row"]
    want = [(str(i), (texts[i % 7] or "").replace("\x01", "").replace("\r\n", "\r\n"), f"[{i},null]", i % 10 + 2) for i in range(25)]
    assert sorted((tuple(r)[:3] + (r["_row"],) for r in got.collect()), key=lambda r: int(r[0])) == want
    assert [(r["n"], r["odd name"]) for r in workbook.read_workbook(spark, path, "Comments").collect()] == [("1", "a")]
    assert workbook.read_workbook(spark, path, "Creators").collect() == []
    with zipfile.ZipFile(f"{tmp_path}/books/all-00000.xlsx") as z:
        assert z.testzip() is None and len([n for n in z.namelist() if "sheet" in n]) == 3


def test_reads_shared_strings_gaps_numbers_and_other_files(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="/xl/worksheets/one.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        z.writestr("xl/worksheets/one.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>name</t></is></c></row>'
                   '<row r="2"/><row r="4"><c r="A4" t="s"><v>1</v></c><c r="AA4"><v>3.5</v></c></row><row r="5"><c r="C5" t="b"><v>1</v></c></row></sheetData></worksheet>')  # fmt: skip
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    got = workbook.read_workbook(spark, str(tmp_path)).orderBy("_row")
    assert got.columns[:3] == ["name", "Unnamed: 1", "name.1"] and [tuple(r)[:3] + (r["_row"],) for r in got.collect()] == [("two runs", "", "", 4), ("", "", "TRUE", 5)]
    assert [len(r["cells"]) for r in workbook.workbook_rows(spark, str(tmp_path)).orderBy("row").collect()] == [3, 27, 3]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(10).withColumn("x", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        workbook.write_workbooks({"S": (bad, ["id"])}, f"file://{tmp_path}/books")
    assert not glob.glob(f"{tmp_path}/books/*")


def test_keyed_store_merges_fields_and_reads_only_its_buckets(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert keyed_store.table(spark, path) is None and keyed_store.find(spark, path, ["a"]) is None
    keyed_store.upsert(path, spark.createDataFrame([(f"k{i}", i, "old") for i in range(100)] + [(None, 1, "x")], "id string, n int, s string"), "id", 16)
    keyed_store.upsert(path, spark.createDataFrame([("k1", "new", 5), ("new", "new", None), ("k2", None, 1), ("k2", "a", 1)], "id string, s string, extra int"), "id", 99)
    got = {r["id"]: (r["n"], r["s"], r["extra"]) for r in keyed_store.table(spark, path).collect()}
    assert len(got) == 101 and got["k1"] == (1, "new", 5) and got["new"] == (None, "new", None) and got["k2"] == (2, "a", 1) and got["k3"] == (3, "old", None)
    one = keyed_store.find(spark, path, ["k1"])
    assert [r["s"] for r in one.collect()] == ["new"] and len({f.split("bucket=")[1].split("/")[0] for f in one.inputFiles()}) == 1
    assert keyed_store.find(spark, path, ["nowhere"]).count() == 0
    assert [r["id"] for r in keyed_store.find_many(spark, path, "n >= 50 AND s = 'old'", 3).collect()] == ["k50", "k51", "k52"]
    # a version without a commit row is never seen
    spark.createDataFrame([("k1", 9, "torn")], "id string, n int, s string").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/data/version=3")
    assert keyed_store.table(spark, path).where("s = 'torn'").count() == 0
    keyed_store.upsert(path, spark.createDataFrame([("k1", 7)], "id string, n int"), "id")
    assert [tuple(r) for r in keyed_store.find(spark, path, ["k1"]).select("n", "s", "extra").collect()] == [(7, "new", 5)]
