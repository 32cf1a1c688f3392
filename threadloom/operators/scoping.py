"""Conclusions of a whole run narrowed to some of its records, without asking a model again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kept(conclusions: DataFrame, key: str, array: str, record: str | None, allowed: DataFrame) -> DataFrame:
    """(key, __kept): the array's elements, in order, whose record is allowed."""
    of = F.col("__x") if record is None else F.col(f"__x.{record}")
    rows = conclusions.select(key, F.posexplode(array).alias("__pos", "__x")).withColumn("__id", of).join(allowed, F.col("__id") == F.col("__allowed"), "left_semi")
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__x"))), lambda x: x["__x"]).alias("__kept"))  # of one conclusion's own list


def scoped(conclusions: DataFrame, records: DataFrame, *, key: str, ids: str | None = "record_ids", refs: str = "refs", sources: int = 1) -> DataFrame:
    """Conclusions with only what rests on the given records (record_id, user_key).

    ``ids`` is an array of record ids, ``refs`` one of structs with a record_id. With ids, conclusions that lose all of them
    go, and comment_count, unique_user_count (a record without user counts for itself) and source_count are taken anew;
    without, those that lose all refs go. Order within the arrays stays; other columns are unchanged.
    """
    allowed = records.select(F.col("record_id").alias("__allowed")).distinct()
    left = conclusions
    if ids:
        counted = conclusions.select(key, F.explode(F.array_distinct(ids)).alias("__id")).join(records.select(F.col("record_id").alias("__id"), F.coalesce(F.nullif("user_key", F.lit("")), "record_id").alias("__user")), "__id")
        users = counted.groupBy(key).agg(F.count_distinct("__user").cast("long").alias("unique_user_count"))
        left = left.drop("comment_count", "unique_user_count", "source_count").join(_kept(conclusions, key, ids, None, allowed), key).withColumn(ids, F.col("__kept")).drop("__kept")
        left = left.withColumns({"comment_count": F.size(ids).cast("long"), "source_count": F.lit(sources)}).join(users, key)
    found = _kept(conclusions, key, refs, "record_id", allowed)
    left = left.join(found, key, "left" if ids else "inner")
    return left.withColumn(refs, F.coalesce("__kept", F.array().cast(conclusions.schema[refs].dataType))).drop("__kept")


def merged_documents(documents: DataFrame, sums: list[str], lists: list[str], order: str) -> DataFrame:
    """Theme documents as one: numbers added up, lists put together in the order of the documents."""
    one = documents.agg(*[F.sum(c).alias(c) for c in sums], *[F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c])).alias(c) for c in lists])  # of the few documents of a run
    return one.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in sums], *lists)
