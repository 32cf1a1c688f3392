"""CSV files read by many tasks each, quoted line feeds included.

A task that begins in the middle of a file can't tell whether its first line lies inside a quoted field. But each line is a
function of two values: the state it begins in (outside or inside quotes) gives the state it ends in and the number of
delimiters outside quotes. These functions are columns of the line. A first scan composes them block by block for both
states a block may begin in; walking the blocks of a file in order, one narrow row each, settles their states and numbers.
A second scan gives each line its record's number. Records of one line are parsed where they are; only the lines of longer
records are shuffled.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.scratch import materialise

#: Blocks up to which their states are broadcast, some 60 bytes each; beyond it they are joined by a shuffle.
BROADCAST_BLOCKS = 200_000
# Where the walk along a line stands: a quote would open a field, would be a character, would close it; has just closed it.
_OPENS, _PLAIN, _INSIDE, _CLOSED = range(4)


def lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(value, file, start): lines as bytes stand in the file, without a byte order mark, in file order within a task."""
    read = spark.read.text(paths if isinstance(paths, str) else list(paths), lineSep="\n")
    bare = F.when(F.startswith("value", F.lit("\ufeff")), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    return read.select(bare.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _commas(c: Column, sep: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(sep), F.lit("")))


def line_function(value: Column, sep: str = ",") -> list[Column]:
    """out_end, out_seps: whether the line ends inside quotes, and delimiters outside them, if it begins outside; in_end, in_seps likewise."""
    pieces = F.split(value, '"')

    def text(state: Column, piece: Column) -> Column:
        return F.when(piece == "", state).when(F.endswith(piece, F.lit(sep)), F.lit(_OPENS)).otherwise(F.lit(_PLAIN))

    def step(acc: Column, piece: Column) -> Column:
        state = F.element_at(F.array(F.lit(_INSIDE), F.lit(_PLAIN), F.lit(_CLOSED), F.lit(_INSIDE)), acc["state"] + 1)  # after the quote
        inside = state == _INSIDE
        return F.struct(F.when(inside, state).otherwise(text(state, piece)).alias("state"), (acc["seps"] + F.when(inside, 0).otherwise(_commas(piece, sep))).alias("seps"))

    first = F.element_at(pieces, 1)
    rest = F.slice(pieces, 2, F.size(pieces))
    begun = {"out": F.struct(text(F.lit(_OPENS), first).alias("state"), _commas(first, sep).alias("seps")), "in": F.struct(F.lit(_INSIDE).alias("state"), F.lit(0).alias("seps"))}
    plain = ~F.contains(value, F.lit('"'))
    out = []
    for name, init in begun.items():
        end = F.aggregate(rest, init, step)
        out.append(F.when(plain, F.lit(name == "in")).otherwise(end["state"] == _INSIDE).alias(f"{name}_end"))
        out.append(F.when(plain, F.lit(0) if name == "in" else _commas(value, sep)).otherwise(end["seps"]).alias(f"{name}_seps"))
    return out


def opens_quote(line: str, sep: str = ",") -> bool:
    """Whether a line that begins a record ends inside quotes, as ``line_function`` has it."""
    state = _OPENS
    for k, piece in enumerate(line.split('"')):
        if k:
            state = (_INSIDE, _PLAIN, _CLOSED, _INSIDE)[state]
        if state != _INSIDE and piece:
            state = _OPENS if piece.endswith(sep) else _PLAIN
    return state == _INSIDE


def _begins_inside(out_end: np.ndarray, in_end: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """For each line whether it begins inside quotes, and whether the last one ends there."""
    n = len(out_end)
    fixed, swap = out_end == in_end, out_end & ~in_end
    last = np.maximum.accumulate(np.where(fixed, np.arange(n), -1))
    swaps = np.cumsum(swap)
    known = last >= 0
    since = swaps - np.where(known, swaps[last], 0)
    ends = np.where(known, out_end[last], inside) ^ (since % 2 == 1)
    return np.concatenate([[inside], ends[:-1]]).astype(bool), bool(ends[-1]) if n else inside


class _Records:
    """Records of consecutive lines: which lines belong together, and which records count (not blank, not too long)."""

    def __init__(self, out_end, out_seps, in_end, in_seps, blank, inside: bool, most: int):
        self.inside, self.ends_inside = _begins_inside(out_end, in_end, inside)
        self.at = np.cumsum(~self.inside) - 1  # -1: lines of a record that began earlier
        seps = np.where(self.inside, in_seps, out_seps)
        self.n = int(self.at[-1]) + 1 if len(seps) else 0
        self.head = int(seps[self.at < 0].sum())
        sums = np.bincount(self.at[self.at >= 0], weights=seps[self.at >= 0], minlength=self.n).astype(np.int64)
        first = np.flatnonzero(~self.inside)
        self.open = self.ends_inside and self.n > 0  # the last one goes on
        self.tail = int(sums[-1]) if self.open else 0
        lone = np.diff(np.append(first, len(seps))) == 1
        self.counts = (sums <= most) & ~(lone & blank[first])
        if self.open:
            self.counts[-1] = False


_FUNCTION = ["out_end", "out_seps", "in_end", "in_seps", "blank"]


def _block_functions(most: int):
    """Per block: what it does if it begins outside, and if it begins inside quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[list[np.ndarray]]] = {}

        def close() -> pa.RecordBatch:
            rows = []
            for (file, start), parts in held.items():
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                row = {"file": file, "start": start}
                for name, inside in (("out", False), ("in", True)):
                    r = _Records(*columns, inside, most)
                    row |= {f"{name}_inside": r.ends_inside, f"{name}_n": int(r.counts.sum()), f"{name}_closes": r.n > 0 or not r.ends_inside, f"{name}_head": r.head, f"{name}_open": r.open, f"{name}_tail": r.tail}
                rows.append(row)
            held.clear()
            return pa.RecordBatch.from_pylist(rows, _BLOCK)

        for batch in batches:
            for file, start, own in _by_block(batch):
                if held and (file, start) not in held:
                    yield close()
                held.setdefault((file, start), []).append([own.column(own.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in _FUNCTION])
        if held:
            yield close()

    return run


_BLOCK = pa.schema([("file", pa.string()), ("start", pa.int64())] + [(f"{s}_{c}", k) for s in ("out", "in") for c, k in (("inside", pa.bool_()), ("n", pa.int64()), ("closes", pa.bool_()), ("head", pa.int64()), ("open", pa.bool_()), ("tail", pa.int64()))])
_BLOCK_DDL = "file string, start long, " + ", ".join(f"{s}_inside boolean, {s}_n long, {s}_closes boolean, {s}_head long, {s}_open boolean, {s}_tail long" for s in ("out", "in"))


def _by_block(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Neighbouring rows of one file and block."""
    if not batch.num_rows:
        return
    file, start = batch.column(batch.schema.get_field_index("file")).dictionary_encode(), batch.column(batch.schema.get_field_index("start")).to_numpy()
    code = file.indices.to_numpy()
    cuts = np.flatnonzero((code[1:] != code[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield file.dictionary[int(code[a])].as_py(), int(start[a]), batch.slice(a, b - a)


def _chained(most: int):
    """Along the blocks of a file: the state each begins in and the numbers of its records."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, inside, n, seps, waiting = [], False, 0, 0, []
        for b in pdf.sort_values("start").to_dict("records"):
            s = "in" if inside else "out"
            own = {"file": b["file"], "start": b["start"], "inside": inside, "head_row": 0, "before": 0, "tail_row": 0}
            if inside:
                seps += b["in_head"]
                waiting.append((own, "head_row"))
                if b["in_closes"]:
                    number = n + 1 if seps <= most else 0
                    n += number > 0
                    for row, field in waiting:
                        row[field] = number
            own["before"] = n
            n += b[f"{s}_n"]
            if b[f"{s}_open"]:
                seps, waiting = b[f"{s}_tail"], [(own, "tail_row")]
            inside = b[f"{s}_inside"]
            rows.append(own)
        return pd.DataFrame(rows)  # a record that never closes keeps number 0

    return run


def _numbered(most: int, encoding: str):
    """Lines of records that count, each with its record's number; ``part`` is null for records of one line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, inside, before, at, held = None, False, 0, 0, None
        head_row = tail_row = 0

        def out(own: pa.Table, rows: np.ndarray, alone: np.ndarray, first_line: int) -> pa.RecordBatch:
            kept = np.flatnonzero(rows > 0)
            own = own.take(pa.array(kept)).combine_chunks()
            values = own["value"].combine_chunks() if own.num_rows else pa.array([], pa.binary())
            texts = values.cast(pa.string()) if encoding == "utf-8" else pa.array([v.decode(encoding, "replace") for v in values.to_pylist()], pa.string())
            part = pa.array((first_line + kept).astype(np.int64), pa.int64(), mask=alone[kept])
            start = pa.array(np.full(len(kept), block[1] if block else 0, dtype=np.int64), pa.int64())
            return pa.RecordBatch.from_arrays([texts, pa.array([block[0]] * len(kept), pa.string()), pa.array(rows[kept], pa.int64()), start, part], ["value", "file", "row", "start", "part"])

        def passed(own: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """Give out what is settled; keep the lines of a record that is still open."""
            nonlocal inside, before, at, held
            columns = [own[c].to_numpy() for c in _FUNCTION]
            r = _Records(*columns, inside, most)
            number = before + np.cumsum(r.counts)
            rows = np.where(r.at < 0, head_row, np.where(r.counts[r.at], number[r.at], 0)) if r.n else np.full(len(own), head_row)
            alone = np.bincount(r.at[r.at >= 0], minlength=r.n)[r.at] == 1 if r.n else np.zeros(len(own), dtype=bool)
            alone &= r.at >= 0
            upto = int(np.flatnonzero(~r.inside)[-1]) if r.open else len(own)
            if r.open and last:
                rows[upto:], alone[upto:], upto = tail_row, False, len(own)
            yield out(own.slice(0, upto), rows[:upto], alone[:upto], at)
            at += upto
            before = int(number[-1]) if r.n else before
            inside = r.ends_inside and not r.open
            held = own.slice(upto) if r.open and not last else None

        for batch in batches:
            for file, start, own in _by_block(batch):
                if (file, start) != block:
                    if held is not None:
                        yield from passed(held, True)
                    get = lambda c: own.column(own.schema.get_field_index(c))[0].as_py()  # noqa: B023, E731
                    block, inside, before, at, held = (file, start), get("inside"), get("before"), 0, None
                    head_row, tail_row = get("head_row"), get("tail_row")
                table = pa.Table.from_batches([own])
                yield from passed(pa.concat_tables([held, table]) if held is not None else table, False)
        if held is not None:
            yield from passed(held, True)

    return run


def csv_records(spark: SparkSession, files: Sequence[str], fields: int, encoding: str = "utf-8", sep: str = ",") -> DataFrame:
    """(value, file, row): whole records of CSV files, numbered from 1 in each file, the header's included.

    Blank lines and records of more than ``fields`` fields are no records; nor is what follows a quote that never closes.
    """
    most = fields - 1
    blank = F.length(F.trim(F.translate("value", "\t\r\x0b\x0c", "    "))) == 0
    own = lines(spark, files).select("*", *line_function(F.col("value"), sep), blank.alias("blank"))
    blocks = own.drop("value").mapInArrow(_block_functions(most), _BLOCK_DDL)
    shape = "file string, start long, inside boolean, head_row long, before long, tail_row long"
    states = materialise(blocks.groupBy("file").applyInPandas(_chained(most), shape), "csv-blocks")
    if states.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS:
        placed = own.join(F.broadcast(states), ["file", "start"])
    else:
        placed = own.withColumn("nth", F.monotonically_increasing_id()).join(states, ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "nth").drop("nth")
    placed = placed.withColumn("value", F.col("value").cast("binary"))
    found = placed.mapInArrow(_numbered(most, encoding), "value string, file string, row long, start long, part long")
    lone = found.where(F.col("part").isNull()).select("value", "file", "row")
    parts = F.array_sort(F.collect_list(F.struct("start", "part", "value")))
    long = found.where(F.col("part").isNotNull()).groupBy("file", "row").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value")).select("value", "file", "row")
    return lone.union(long).withColumn("value", F.when(F.endswith("value", F.lit("\r")), F.substring("value", 1, F.length("value") - 1)).otherwise(F.col("value")))


def header_names(record: str, sep: str = ",") -> list[str]:
    """Names of a header; later equal ones get .1, .2 and so on, empty ones their place."""
    seen: dict[str, int] = {}
    names = []
    for i, name in enumerate(next(csv.reader(io.StringIO(record), delimiter=sep), [])):
        name = name or f"Unnamed: {i}"
        k = seen[name] = seen.get(name, -1) + 1
        names.append(f"{name}.{k}" if k else name)
    return names


def parsed(records: DataFrame, names: Sequence[str], sep: str = ",") -> DataFrame:
    """The columns of records under their names, as strings; what a record lacks is empty."""
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    row = F.from_csv("value", schema, {"sep": sep, "escape": '"', "mode": "PERMISSIVE"})
    cells = [F.coalesce(F.col(f"__r.c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)]
    return records.where("row > 1").select(row.alias("__r"), "file", "row").select(*cells, F.col("file").alias("_file"), F.col("row").alias("_row"))
