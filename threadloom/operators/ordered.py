"""Numbers and carried values along an order, without any group in one task.

Rows are dealt over ranges of (group, order) and written once, so the ranges stay what they are. One narrow row for each
range and group carries what lies before it; the windows then run within a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.scratch import materialise


def _dealt(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return materialise(df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("__part", F.spark_partition_id()), "ordered")


def _joined(rows: DataFrame, parts: DataFrame, group: Sequence[str]) -> DataFrame:
    keys = ["__part", *group]
    named = parts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in parts.columns if c not in keys])
    same = [rows[k].eqNullSafe(named[f"__k{i}"]) for i, k in enumerate(keys)]
    return rows.join(named, same).drop(*[f"__k{i}" for i in range(len(keys))])


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "n", weight: str | None = None) -> DataFrame:
    """``name``: the row's number from 1 within its group, or the running sum of a weight, itself included.

    ``order`` must tell the rows of a group apart. A null group is a group.
    """
    rows = _dealt(df, group, order)
    step = F.col(weight) if weight else F.lit(1)
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("__part", *group).agg(F.sum(step).alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum")
    own = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _joined(rows, parts, group).withColumn(name, F.col("__before") + F.sum(step).over(own)).drop("__before", "__part")


def forward_filled(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """The last value that is not null up to each row of its group."""
    rows = _dealt(df, group, order)
    own = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__own", F.last(value, ignorenulls=True).over(own)).withColumn("__nth", F.row_number().over(own))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("__part", *group).agg(F.max_by("__own", "__nth").alias("__end"))
    parts = ends.withColumn("__before", F.last("__end", ignorenulls=True).over(earlier)).drop("__end")
    return _joined(rows, parts, group).withColumn(value, F.coalesce("__own", "__before")).drop("__own", "__nth", "__before", "__part")


def ranked_values(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Per group and different value: ``m`` rows have it, ``upto`` have it or less, of ``n``. Null values are left out.

    The q-quantile of a group is its first value with upto > q * (n - 1): values are counted, never gathered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("m"))
    placed = numbered(counts, group, [F.asc(value)], "upto", "m")
    sizes = placed.groupBy(*group).agg(F.max("upto").alias("n"))
    named = sizes.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], "n")
    same = [placed[g].eqNullSafe(named[f"__g{i}"]) for i, g in enumerate(group)]
    joined = placed.join(named, same) if group else placed.crossJoin(named)
    return joined.drop(*[f"__g{i}" for i in range(len(group))])


def nearest(value: str, q: float) -> Column:
    """Aggregate over ranked_values: the element at round-half-even(q * (n - 1)), no interpolation."""
    return F.min(F.when(F.col("upto") > F.bround(F.lit(q) * (F.col("n") - 1), 0), F.col(value)))


def middle(value: str) -> Column:
    """Aggregate over ranked_values: the median, the mean of the two middle values for an even number."""
    low = F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) / 2), F.col(value)))
    high = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col(value)))
    return (low + high) / 2.0
