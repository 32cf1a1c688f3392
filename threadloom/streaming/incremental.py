"""Incremental input: new files as a stream, duplicates dropped by state, merges batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.dedupe import last_wins


def file_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(path)


def first_seen(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; state older than the watermark is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, width: str, *groups: str, delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), *groups).agg(F.count(F.lit(1)).alias("n"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop; the checkpoint makes the next run go on from here."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def merge_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append each batch below ``path`` as ``batch=k``; a batch that runs again replaces itself, so the merge is idempotent.

    Keys are merged when the table is read (``merged``), so a batch costs what it holds, not what the table holds.
    """

    def append(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={k}")

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append).trigger(availableNow=True).start().awaitTermination()


def merged(spark: SparkSession, path: str, key: str, seq: str) -> DataFrame:
    """The last row of each key over all batches, by ``seq``, then by batch."""
    rows = spark.read.parquet(path).withColumn("__order", F.struct(seq, "batch"))
    return last_wins(rows, [key], "__order").drop("__order", "batch")


def compact(spark: SparkSession, path: str, into: str, key: str, seq: str) -> None:
    """The merged rows as the only batch of a new table, from which later streams may go on."""
    merged(spark, path, key, seq).write.parquet(f"{into}/batch=-1")
