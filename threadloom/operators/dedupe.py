"""One row a key, by an explicit sequence column: rows have no order of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _one(df: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """The filter on the rank becomes a limit of each key before the shuffle, so a hot key is no more than any other."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def first_wins(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    return _one(df, keys, F.asc(seq))


def last_wins(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    return _one(df, keys, F.desc(seq))


def last_wins_at_first_place(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The last row of each key with ``position``, where the key first stood: a later version replaces in place."""
    others = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("__last"), F.min(seq).alias("position"))
    return last.select(*keys, "__last.*", "position").select(*df.columns, "position")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], stamp: str | None = None, now=None) -> DataFrame:
    """New values over old by key: given (not null) values win, others stay; stamp, if named, is renewed for touched rows."""
    touched = new.withColumn("__new", F.lit(True))
    joined = old.withColumn("__old", F.lit(True)).alias("o").join(touched.alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    out = []
    for c in dict.fromkeys([*old.columns, *new.columns]):
        if c == stamp:
            continue
        both = [F.col(f"{side}.{c}") for side, df in (("n", new), ("o", old)) if c in df.columns]
        out.append(F.coalesce(*both).alias(c))
    if stamp:
        out.append(F.when(F.col("n.__new"), now).otherwise(F.col(f"o.{stamp}") if stamp in old.columns else now).alias(stamp))
    return joined.select(*out)


def merge_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """before, after, added: distinct keys of the old rows, of both, and the difference."""
    before = old.agg(F.count_distinct(key).alias("before"))
    after = old.select(key).union(new.select(key)).agg(F.count_distinct(key).alias("after"))
    return before.crossJoin(after).withColumn("added", F.col("after") - F.col("before"))
