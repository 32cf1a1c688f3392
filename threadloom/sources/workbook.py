"""Workbooks (.xlsx): sheets read as rows of cells wherever Spark reads files, and written book by book with a commit.

Reading goes through Spark's own file reader, a workbook a row, so any store that Spark reads will do. Writing is a data
source of two phases: a task writes its books under a name of its own, and they get their names when all tasks are done.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from threadloom.operators.ordered import numbered

#: Rows that a sheet of a workbook can hold, its header aside.
MOST_ROWS = (1 << 20) - 1
ROWS = "file string, sheet string, row long, cells array<string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


# --- reading ------------------------------------------------------------------------------------------------------


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot()]


def _cell(c: ElementTree.Element, shared: Sequence[str]) -> str:
    kind, value = c.get("t", "n"), c.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
    text = (value.text or "") if value is not None else ""
    if kind == "s":
        return shared[int(text)] if text else ""
    return {"1": "TRUE", "0": "FALSE"}.get(text, text) if kind == "b" else text


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of a workbook; gaps are empty cells, rows without cells are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared(book)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
        for sheet in ElementTree.parse(book.open("xl/workbook.xml")).getroot().iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_RELATION)].lstrip("/")
            nth = 0
            for _, e in ElementTree.iterparse(book.open(target if target.startswith("xl/") else f"xl/{target}")):
                if e.tag != f"{_MAIN}row":
                    continue
                nth = int(e.get("r", nth + 1))
                cells: list[str] = []
                for c in e.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = _cell(c, shared)
                if any(cells):
                    yield sheet.get("name"), nth, cells
                e.clear()


def workbook_rows(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, sheet, row, cells) of all sheets; a file that is no workbook gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = []
                try:
                    for sheet, n, cells in sheet_rows(content):
                        held.append({"file": path, "sheet": sheet, "row": n, "cells": cells})
                        if len(held) >= 5000:
                            yield pa.RecordBatch.from_pylist(held, _ROWS)
                            held = []
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    pass
                yield pa.RecordBatch.from_pylist(held, _ROWS)

    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return files.select("path", "content").mapInArrow(run, ROWS)


_ROWS = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string()))])


def read_workbook(spark: SparkSession, paths: str | Sequence[str], sheet: str | None = None) -> DataFrame:
    """A sheet of workbooks as a table: columns by the names in each first row, missing ones empty, ``_file`` and ``_row`` last.

    Without a name the sheets of all names are read. Later columns of an equal name get .1 and so on, unnamed ones their place.
    """
    rows = workbook_rows(spark, paths)
    rows = rows.where(F.col("sheet") == sheet) if sheet else rows
    heads = rows.groupBy("file", "sheet").agg(F.min_by("cells", "row").alias("names"), F.min("row").alias("first"))
    names: dict[tuple[str, ...], list[str]] = {}
    for r in heads.select("names").distinct().collect():  # one row for each different header
        seen: dict[str, int] = {}
        own = []
        for i, n in enumerate(r["names"]):
            n = n.strip() or f"Unnamed: {i}"
            k = seen[n] = seen.get(n, -1) + 1
            own.append(f"{n}.{k}" if k else n)
        names[tuple(r["names"])] = own
    columns = list(dict.fromkeys(c for own in names.values() for c in own))
    body = rows.join(heads, ["file", "sheet"]).where("row > first")
    place = {c: F.coalesce(*[F.when(F.col("names") == F.array(*[F.lit(x) for x in head]), F.try_element_at("cells", F.lit(own.index(c) + 1))) for head, own in names.items() if c in own], F.lit("")) for c in columns}
    return body.select(*[v.alias(c) for c, v in place.items()], F.col("file").alias("_file"), F.col("row").alias("_row"))


# --- writing ------------------------------------------------------------------------------------------------------


class _Book:
    """A workbook written sheet after sheet, row after row; texts stand in their cells."""

    def __init__(self, out):
        self._zip, self._sheets, self._open, self._n = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), [], None, 0

    def row(self, sheet: str, cells: Sequence[str | None]) -> None:
        if not self._sheets or self._sheets[-1] != sheet:
            self._end_sheet()
            self._sheets.append(sheet)
            self._open, self._n = self._zip.open(f"xl/worksheets/sheet{len(self._sheets)}.xml", "w", force_zip64=True), 0
            self._open.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
        self._n += 1
        texts = "".join("<c/>" if not c else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_ILLEGAL.sub("", c), {chr(13): "&#13;"})}</t></is></c>' for c in cells)
        self._open.write(f'<row r="{self._n}">{texts}</row>'.encode())

    def _end_sheet(self) -> None:
        if self._open:
            self._open.write(b"</sheetData></worksheet>")
            self._open.close()
            self._open = None

    def close(self) -> None:
        self._end_sheet()
        office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        n = range(1, len(self._sheets) + 1)
        sheets = "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(n, self._sheets, strict=True))
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in n)
        links = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
        for name, xml in {
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{office}"><sheets>{sheets}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">{links}</Relationships>',
            "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>',
        }.items():
            self._zip.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{xml}')
        self._zip.close()


@dataclass
class _Written(WriterCommitMessage):
    books: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, name: str):
        self.path, self.name, self.attempt = path, name, uuid.uuid4().hex

    def write(self, iterator) -> _Written:
        fs, folder = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{folder}/_writing-{self.attempt}", recursive=True)
        books, book, out, at = [], None, None, None
        for r in iterator:
            if r.book != at:
                if book:
                    book.close()
                    out.close()
                at = r.book
                temporary = f"{folder}/_writing-{self.attempt}/{uuid.uuid4().hex}"  # of this attempt of this task
                books.append((temporary, f"{folder}/{self.name}-{at:05d}.xlsx"))
                out = fs.open_output_stream(temporary)
                book = _Book(out)
            book.row(r.sheet, r.cells)
        if book:
            book.close()
            out.close()
        return _Written(books)

    def commit(self, messages) -> None:
        fs, folder = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for temporary, final in m.books if m else ():
                fs.move(temporary, final)
        self._tidy(fs, folder)

    def abort(self, messages) -> None:
        self._tidy(*pafs.FileSystem.from_uri(self.path))

    def _tidy(self, fs, folder: str) -> None:
        own = f"{folder}/_writing-{self.attempt}"
        if fs.get_file_info(own).type != pafs.FileType.NotFound:
            fs.delete_dir(own)


class WorkbookSink(DataSource):
    """Rows (book, sheet, cells) in the order in which they are to stand; a task's books are its own."""

    @classmethod
    def name(cls) -> str:
        return "threadloom_workbook"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("name", "book"))


def write_workbooks(tables: dict[str, tuple[DataFrame, Sequence[str]]], path: str, name: str = "book", most_rows: int = MOST_ROWS) -> None:
    """Tables as the sheets of workbooks ``name-00000.xlsx`` and so on: a sheet's rows in the order of its key columns.

    ``tables`` are name -> (rows, columns that order them and tell them apart). Each book holds up to ``most_rows`` rows of
    each sheet, with a header; null is an empty cell, arrays and the like are JSON. Control characters, which XML can't
    hold, are left out. An empty table gives its header in the first book.
    """
    parts, spark = [], None
    for k, (sheet, (df, order)) in enumerate(tables.items()):
        spark = df.sparkSession
        text = [F.when(F.col(c).isNotNull(), F.to_json(c) if t.startswith(("array", "struct", "map")) else F.col(c).cast("string")).alias(c) for c, t in df.dtypes]
        keys = [F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]
        rows = numbered(df.select(F.array(*text).alias("cells"), *keys), [], [F.asc(f"__o{i}") for i in range(len(order))], "n")
        rows = rows.select(F.floor((F.col("n") - 1) / most_rows).cast("long").alias("book"), F.lit(k).alias("k"), F.lit(sheet).alias("sheet"), "n", "cells")
        books = rows.select("book").distinct().union(spark.createDataFrame([(0,)], "book long")).distinct()
        heads = books.select("book", F.lit(k).alias("k"), F.lit(sheet).alias("sheet"), F.lit(0).cast("long").alias("n"), F.array(*[F.lit(c) for c in df.columns]).alias("cells"))
        parts.append(rows.unionByName(heads))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    spark.dataSource.register(WorkbookSink)
    ordered = out.repartition("book").sortWithinPartitions("book", "k", "n").select("book", "sheet", "cells")
    ordered.write.format(WorkbookSink.name()).option("path", path).option("name", name).mode("append").save()
