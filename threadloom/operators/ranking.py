"""Ranks, quotas, samples and pages. Ties always end in a unique column, since Spark's sorts aren't stable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.operators.ordered import forward_filled, numbered


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Spark turns the filter on the rank into a per-task limit before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def top_ranked(df: DataFrame, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of all, ranked; only these meet in one task."""
    first = df.orderBy(*order).limit(n)
    return first.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, most: int = 500) -> DataFrame:
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_with_total(df: DataFrame, order: Sequence[Column], number: int, size: int, most: int = 500) -> DataFrame:
    """A page whose rows carry the exact count of all rows, taken by a second aggregate over the same filter."""
    return page(df, order, number, size, most).crossJoin(df.agg(F.count(F.lit(1)).alias("total")))


def round_robin(df: DataFrame, group: Sequence[str], order: Sequence[Column], place: str, n: int) -> DataFrame:
    """Groups take turns: first rows of all groups, then second rows, groups by where their best row stands.

    ``place`` is unique. No group holds more than n of the first n rows, so each is cut there before the global sort.
    """
    own = Window.partitionBy(*group).orderBy(*order)
    turned = df.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= n).withColumn("__first", F.first(place).over(own))
    return turned.orderBy("turn", "__first", place).limit(n).drop("__first")


def stratified_sample(df: DataFrame, strata: Sequence[str], key: Column, n: int) -> DataFrame:
    """n rows, strata taking turns in order of a hash; the same rows give the same sample whatever their order."""
    own = Window.partitionBy(*strata).orderBy("__h")
    turned = df.withColumn("__h", F.md5(key)).withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= n)
    return turned.orderBy("turn", "__h").limit(n).drop("__h")


def hash_sample(df: DataFrame, group: Sequence[str], key: Column, n: int) -> DataFrame:
    """n rows of each group by sha256 of the key."""
    return top_per_group(df.withColumn("__h", F.sha2(key, 256)), group, [F.col("__h")], n).drop("__h")


def quota_groups(df: DataFrame, conditions: Sequence[tuple[str, Column, int]], order: Sequence[Column], total: int) -> DataFrame:
    """``bucket`` and rows: each row belongs to its first true condition, buckets take their quota, others fill up to total."""
    bucket = F.when(F.lit(False), F.lit(None).cast("string"))
    quota = F.when(F.lit(False), F.lit(0))
    for name, condition, n in conditions:
        bucket, quota = bucket.when(condition, name), quota.when(F.col("bucket") == name, n)
    placed = df.withColumn("bucket", bucket.otherwise("rest"))
    ranked = placed.withColumn("__n", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where(F.col("__n") <= total)
    filled = ranked.withColumn("__in", F.coalesce(F.col("__n") <= quota.otherwise(0), F.lit(False)))
    fill = filled.where(~F.col("__in")).orderBy(*order).limit(total)
    chosen = filled.where("__in").withColumn("bucket", F.col("bucket")).unionByName(fill.withColumn("bucket", F.lit("backfill")))
    return chosen.orderBy(F.desc("__in"), *order).limit(total).drop("__n", "__in")


def hot_then_recent(df: DataFrame, key: str, hot: Sequence[Column], recent: Sequence[Column], n_hot: int, n_recent: int) -> DataFrame:
    first = df.orderBy(*hot).limit(n_hot)
    then = df.join(first.select(key), key, "left_anti").orderBy(*recent).limit(n_recent)
    return first.withColumn("pick", F.lit("hot")).unionByName(then.withColumn("pick", F.lit("recent")))


def capped_queue(df: DataFrame, key: str, group: str, order: Sequence[Column], cap: int, quota: int) -> DataFrame:
    """``state`` of each row: picked, video_cap (its group has its share), or deferred (the quota is full).

    A row of a picked group beyond the cap is video_cap; all others past the quota are deferred. Only the first ``cap``
    rows of a group are ranked; ``key`` is unique.
    """
    within = top_per_group(df, [group], order, cap, "__n")
    picked = within.orderBy(*order).limit(quota).select(F.col(key).alias("__picked"), F.col(group).alias("__group"))
    first = within.select(F.col(key).alias("__first"))
    groups = picked.select("__group").distinct()
    joined = df.join(first, F.col(key) == F.col("__first"), "left").join(picked.select("__picked"), F.col(key) == F.col("__picked"), "left").join(groups, F.col(group).eqNullSafe(F.col("__group")), "left")
    state = F.when(F.col("__picked").isNotNull(), "picked").when(F.col("__first").isNull() & F.col("__group").isNotNull(), "video_cap").otherwise("deferred")
    return joined.withColumn("state", state).select(*df.columns, "state")


def forward_fill(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    return forward_filled(df, group, order, value)


def chunked(df: DataFrame, group: Sequence[str], order: Sequence[Column], size: int) -> DataFrame:
    return numbered(df, group, order, "__n").withColumn("chunk", F.floor((F.col("__n") - 1) / size).cast("long")).drop("__n")
