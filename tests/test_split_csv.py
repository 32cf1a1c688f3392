"""CSV files split among tasks give the records that a walk along the whole file gives."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from threadloom.sources import readers, split_csv


def whole_file(text, fields):
    """(row, cells) by the standard library's reader over the whole text; blank lines and too long records are skipped."""
    n, out = 0, []
    for record in csv.reader(io.StringIO(text, newline="")):
        if not record or (len(record) == 1 and not record[0].strip()) or len(record) > fields:
            continue
        n += 1
        out.append((n, record + [""] * (fields - len(record))))
    return out[1:]


def some_csv(rng, n):
    cell = lambda: rng.choice(["", "plain", "two words", '5 inch" pipe', "x" * rng.randint(1, 30), "é你好"])
    quoted = lambda: '"' + rng.choice(["", "a,b", 'say ""hi""', "line\nfeed", "\n\n", ",\n,", "cr\r\nlf", '"",""', "q" * 40]) + '"'
    rows = ["id,text,more"]
    for i in range(n):
        k = rng.choices([3, 2, 4, 0], weights=[20, 2, 1, 1])[0]
        rows.append(",".join([str(i), *(rng.choice([cell, quoted])() for _ in range(k - 1))]) if k else rng.choice(["", "  "]))
    return "\n".join(rows) + "\n"


@pytest.mark.parametrize("block", ["64", "777", "1m"])
def test_split_equals_whole(spark, tmp_path, block):
    rng = random.Random(block)
    texts = [some_csv(rng, n) for n in (1, 40, 300)] + ["id,text,more\r\n1,\"a\r\nb\",c\r\n2,d,e", "id,text,more\n1,a,b\n2,\"never closes,c\n3,d,e\n"]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.csv").write_bytes((b"\xef\xbb\xbf" if i % 2 else b"") + text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = readers.read_csv(spark, str(tmp_path))
        assert got.columns == ["id", "text", "more", "_file", "_row"]
        found = {}
        for r in got.collect():
            found.setdefault(int(r["_file"].split("/")[-1][0]), []).append((r["_row"], [r["id"], r["text"], r["more"]]))
        if block == "64":
            assert split_csv.lines(spark, str(tmp_path / "2.csv")).rdd.getNumPartitions() > 50  # several tasks a file
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    for i, text in enumerate(texts[:4]):
        assert sorted(found.get(i, [])) == whole_file(text, 3), i
    assert found[4] == [(2, ["1", "a", "b"])]  # what follows a quote that never closes is no record


def test_other_encodings_headers_of_two_lines_and_equal_names(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("标题,text\n\"你\n好\",\"a,\"\"b\"\"\"\n第二,c\n".encode("gb18030"))
    charset = spark.conf.get("spark.sql.legacy.javaCharsets")
    got = {r["_row"]: (r["标题"], r["text"]) for r in readers.read_csv(spark, str(tmp_path)).collect()}
    assert got == {2: ("你\n好", 'a,"b"'), 3: ("第二", "c")} and spark.conf.get("spark.sql.legacy.javaCharsets") == charset
    (tmp_path / "g.csv").write_text('"two\nlines",x,x,\n1,2,3,4\n')
    got = readers.read_csv(spark, str(tmp_path))
    assert got.columns == ["two\nlines", "x", "x.1", "Unnamed: 3", "_file", "_row"] and tuple(got.first())[:4] == ("1", "2", "3", "4")
    (tmp_path / "g.csv").write_text("")
    assert readers.read_csv(spark, str(tmp_path)).collect() == []


def test_only_lines_of_long_records_are_shuffled(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n" + "".join(f"{i},plain {i}\n" for i in range(500)) + '500,"of\ntwo lines"\n')
    records = split_csv.csv_records(spark, [str(tmp_path / "a.csv")], 2)
    assert records.count() == 502 and records.where(F.contains("value", F.lit("\n"))).count() == 1
