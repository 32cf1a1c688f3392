"""Joins of comments with what is known of them. Small sides get no hint: statistics and AQE decide on broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Tiers of a range join up to which every task holds them all.
BROADCAST_TIERS = 1_000


def full_merge(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Both sides' rows by key; of the named columns the right side's value wins where it has one."""
    joined = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer")
    rest = [F.col(f"l.{c}") for c in left.columns if c != key and c not in columns]
    return joined.select(F.coalesce(f"l.{key}", f"r.{key}").alias(key), *[F.coalesce(f"r.{c}", f"l.{c}").alias(c) for c in columns], *rest)


def pending(rows: DataFrame, done: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    return rows.join(done, keys, "left_anti")


def restricted(rows: DataFrame, wanted: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    return rows.join(wanted, keys, "left_semi")


def with_tier(rows: DataFrame, tiers: DataFrame, value: str) -> DataFrame:
    """Each row with the tier (low inclusive, high exclusive, null: open) that its value falls in.

    A range join. A handful of tiers is held by every task; more than ``BROADCAST_TIERS`` are left to the optimizer.
    """
    v = F.col(value)
    held = F.broadcast(tiers) if tiers.limit(BROADCAST_TIERS + 1).count() <= BROADCAST_TIERS else tiers
    return rows.join(held, (v >= F.col("low")) & (F.col("high").isNull() | (v < F.col("high"))), "left").drop("low", "high")


def thread_context(replies: DataFrame, *, id_col: str, parent_col: str, text_col: str, seq_col: str, levels: int = 3, most: int = 8, length: int = 120) -> DataFrame:
    """Per comment with replies: up to ``most`` texts below it, nearest level first, then by sequence.

    ``levels`` self joins on the parent key. Ranks are cut at ``most`` on each level already, which partial top-k windows
    apply before the shuffle, so a root with very many replies stays small.
    """
    edge = replies.select(F.col(parent_col).alias("__p"), F.col(id_col).alias("__c"), F.substring(text_col, 1, length).alias("__t"), F.col(seq_col).alias("__s"))
    level = edge.select(F.col("__p").alias("root"), "__c", "__t", "__s", F.lit(1).alias("level"))
    found = level
    for k in range(2, levels + 1):
        level = level.select("root", F.col("__c").alias("__p")).join(edge, "__p").select("root", "__c", "__t", "__s", F.lit(k).alias("level"))
        found = found.union(level)
    order = Window.partitionBy("root").orderBy("level", "__s")
    cut = found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)
    return cut.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__t"))), lambda x: x["__t"]).alias("context"))


def resolve_references(claims: DataFrame, items: DataFrame) -> DataFrame:
    """claims (claim_id, record_id, item_id) with ``verdict``: kept, unknown record, or unknown item, and the item's columns."""
    records = items.select("record_id").distinct().withColumn("__record", F.lit(True))
    joined = claims.join(items.withColumn("__item", F.lit(True)), ["record_id", "item_id"], "left").join(records, "record_id", "left")
    verdict = F.when(F.col("__item"), "kept").when(F.col("__record"), "unknown_item").otherwise("unknown_record")
    return joined.withColumn("verdict", verdict).drop("__item", "__record")


def within_hours(events: DataFrame, origins: DataFrame, key: str, at: str, origin: str) -> DataFrame:
    """Events with their origin and the hours since, at or after it."""
    return events.join(origins, key).where(F.col(at) >= F.col(origin)).withColumn("gap_hours", (F.unix_timestamp(at) - F.unix_timestamp(origin)) / 3600.0)


def off_cooldown(rows: DataFrame, last_actions: DataFrame, key: str, now, hours: float) -> DataFrame:
    """Rows whose key has not been acted on within the hours before now."""
    last = last_actions.groupBy(key).agg(F.max("at").alias("__last"))
    return rows.join(last, key, "left").where(F.col("__last").isNull() | (now - F.col("__last") >= hours * 3600)).drop("__last")
