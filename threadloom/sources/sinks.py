"""Sinks: tables by format, partitioned results, rewrites without some ids, labelled exports, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

FORMATS = {"csv": {"header": "true", "escape": '"'}, "json": {}, "jsonl": {}, "parquet": {}, "orc": {}}


def write_table(df: DataFrame, path: str, kind: str = "parquet", *, by: Sequence[str] = (), mode: str = "append") -> None:
    """Write by format, partitioned by columns. Spark's commit protocol makes the files visible together."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    flat = df if kind not in ("csv",) else df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
    writer = flat.write.mode(mode).format("json" if kind == "jsonl" else kind).options(**FORMATS[kind])
    (writer.partitionBy(*by) if by else writer).save(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **properties: str) -> None:
    df.write.jdbc(url, table, mode=mode, properties=properties)


def export_by_source(results: DataFrame, path: str, source: str) -> DataFrame:
    """Results partitioned by their source, and per source the numbers that a summary file of it holds."""
    results.withColumn("source_dir", F.col(source)).repartition("source_dir", F.pmod(F.xxhash64(*results.columns), F.lit(8))).write.mode("overwrite").partitionBy("source_dir").parquet(path)
    return results.sparkSession.read.parquet(path).groupBy("source_dir").agg(F.count(F.lit(1)).alias("rows"))


def rewrite_without(rows: DataFrame, gone: DataFrame, key: str, path: str) -> None:
    """All rows but those of some keys, written to a new path; the caller swaps paths."""
    rows.join(gone.select(key).distinct(), key, "left_anti").write.mode("overwrite").parquet(path)


def labelled(c: Column, labels: Mapping[str, str]) -> Column:
    """Display label of a key, the key itself without one."""
    if not labels:
        return c
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), c), c)


def joined_labels(c: Column, labels: Mapping[str, str], separator: str = "，") -> Column:
    return F.array_join(F.transform(c, lambda x: labelled(x, labels)), separator)


def flat_export(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """The export's columns in order; null as empty."""
    return df.select(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in columns.items()])


def markdown_table(df: DataFrame, most: int = 50) -> str:
    """A small result as a Markdown table: at most ``most`` rows reach the driver."""
    rows = df.limit(most).collect()
    clean = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *["| " + " | ".join(map(clean, r)) + " |" for r in rows]])
