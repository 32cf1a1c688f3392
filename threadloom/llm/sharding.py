"""Minimax contiguous partition of documents into shards.

Documents with equal texts form atomic groups. Groups are ordered by their text's digest and gathered into units, the
groups that share the digest's first ``unit_bits`` bits. Only the bounded list of unit sizes reaches the driver, which
binary-searches the smallest shard capacity for which a greedy pass needs no more than the wanted shards, and cuts there.
Everything a row needs afterwards is an expression on its own digest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import doc_columns, utf8

#: Rows of a slot bucket, about. Buckets spread a shard's numbering over tasks.
BUCKET_ROWS = 5_000
#: Equal rows that are numbered from one array.
RUN = 4_096


def greedy_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends (exclusive unit positions) of at most ``shards`` runs that hold no more than ``capacity``; None if they can't."""
    cuts, done, at = [], 0, 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, done + capacity, side="right"))
        cuts.append(at)
        if at == len(ends):
            return cuts
        done = int(ends[at - 1]) if at else 0
    return None


def minimax_cuts(sizes: list[int] | np.ndarray, shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity for contiguous runs over ``sizes``, and the runs' ends."""
    sizes = np.asarray(sizes, dtype=np.int64)
    if not len(sizes):
        return 0, []
    ends = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low, greedy_cuts(ends, low, shards)


def assign_shards(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", unit_bits: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null: this law promises nothing for growth).

    size: UTF-8 bytes of the text plus 1; a null text has none and shares the empty text's group. Slots run from 0 without
    gaps within a shard, ordered by a hash bucket, doc_id (null first) and digest; rows equal in both have neighbouring
    slots. Very long texts are one group like any other. Shards at the end stay
    empty when there are fewer groups than shards. An empty table gives an empty table. Other columns are not read.
    Driver: at most 2**unit_bits sizes, whatever the input. A shard exceeds the best cut over single groups by less than
    one unit, which is one group when the groups are few and 1/65536 of the bytes when they are many.
    """
    rows = (
        doc_columns(docs, id_col, text_col)
        .withColumn("__b", utf8("text"))
        .select(
            "doc_id",
            (F.length("__b") + 1).cast("long").alias("size"),
            F.crc32("__b").alias("text_crc32"),
            F.md5("__b").alias("__digest"),
        )
        .withColumn("__unit", F.shiftright(F.conv(F.substring("__digest", 1, 8), 16, 10).cast("long"), 32 - unit_bits).cast("int"))
    )
    units = sorted(rows.groupBy("__unit").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect())
    _, cuts = minimax_cuts([u.s for u in units], shards)
    lasts = [units[end - 1]["__unit"] for end in cuts[:-1] if end]
    shard = sum(((F.col("__unit") > u).cast("int") for u in lasts), F.lit(0))
    buckets = max(1, -(-sum(u.n for u in units) // (BUCKET_ROWS * shards)))
    named = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__digest"))
    bucket = F.pmod(F.conv(F.substring(named, 1, 8), 16, 10).cast("long"), F.lit(buckets))
    keyed = rows.select("doc_id", "size", "text_crc32", "__digest", shard.alias("shard"), bucket.alias("__bucket"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("shard", "__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    # Rows equal in id and text are one row with their number here, and are numbered apart by arithmetic.
    equal = keyed.groupBy("shard", "__bucket", "doc_id", "__digest", "size", "text_crc32").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy("shard", "__bucket").orderBy("doc_id", "__digest").rowsBetween(Window.unboundedPreceding, -1)
    runs = F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(RUN).cast("long"))
    return (
        equal.withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
        .join(starts, ["shard", "__bucket"])
        .select("*", F.explode(runs).alias("__run"))
        .select("*", F.explode(F.sequence(F.col("__run"), F.least(F.col("__run") + RUN, F.col("__n")) - 1)).alias("__nth"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("__start") + F.col("__ahead") + F.col("__nth")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
