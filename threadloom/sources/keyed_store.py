"""A store of rows by key, in buckets: an upsert rewrites the buckets that it touches, a lookup reads those of its keys.

Below the store's path lie ``data/version=v/bucket=b`` and ``commits``, one row for each bucket that a version wrote. Data
is written first and its commit row last, so a reader sees whole upserts only; what an upsert that failed has written is
never read. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

_COMMITS = "version long, buckets int, bucket int, key string, schema string"


def _commits(spark: SparkSession, path: str) -> list:
    """The last commit of each bucket, one row a bucket at most; none before the first upsert."""
    try:
        found = spark.read.schema(_COMMITS).parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    last = F.max_by(F.struct("version", "buckets", "key", "schema"), "version").alias("c")
    return found.groupBy("bucket").agg(last).select("bucket", "c.*").collect()


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, commits: Sequence) -> DataFrame | None:
    """Rows of the given buckets; a field that a bucket's version does not know is null."""
    by_schema: dict[str, list[str]] = {}
    for c in commits:
        by_schema.setdefault(c["schema"], []).append(f"{path}/data/version={c['version']}/bucket={c['bucket']}")
    read = [spark.read.schema(schema).parquet(*paths) for schema, paths in by_schema.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read) if read else None


def upsert(path: str, updates: DataFrame, key: str, buckets: int = 64) -> None:
    """Set the fields of updates on the rows of their keys; rows of new keys are added, other fields stay as they are.

    Of several updates of a key the greatest by all fields counts; a null key is no key. ``buckets`` counts for a new store;
    at least as many as the store's bytes by those of a task.
    """
    spark = updates.sparkSession
    commits = _commits(spark, path)
    buckets = commits[0]["buckets"] if commits else buckets
    fields = [c for c in updates.columns if c != key]
    new = updates.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*fields)).alias("__set")) if fields else updates.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__set", F.struct())
    new = new.withColumn("__bucket", bucket_of(F.col(key), buckets))
    touched = [r["__bucket"] for r in new.select("__bucket").distinct().collect()]  # as many as buckets at most
    if not touched:
        return
    old = _read(spark, path, [c for c in commits if c["bucket"] in set(touched)])
    if old is None:
        merged = new.select(key, *[F.col(f"__set.{f}").alias(f) for f in fields], "__bucket")
    else:
        both = old.withColumn("__old", F.lit(True)).join(new.withColumnRenamed(key, "__key"), F.col(key) == F.col("__key"), "full")
        own = {c: F.col(c) for c in old.columns if c != key}
        for f in fields:
            own[f] = F.when(F.col("__key").isNotNull(), F.col(f"__set.{f}")).otherwise(own[f] if f in own else F.lit(None))
        name = F.coalesce(F.col(key), F.col("__key"))
        merged = both.select(name.alias(key), *[c.alias(f) for f, c in own.items()], bucket_of(name, buckets).alias("__bucket"))
    version = 1 + max((c["version"] for c in commits), default=0)
    data = merged.withColumnRenamed("__bucket", "bucket")
    data.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    schema = merged.drop("__bucket").schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    rows = [(version, buckets, b, key, ddl) for b in touched]
    spark.createDataFrame(rows, _COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def table(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows; None before the first upsert."""
    return _read(spark, path, _commits(spark, path))


def find_many(spark: SparkSession, path: str, condition: Column | str, limit: int = 0) -> DataFrame | None:
    """Rows that meet a condition, which goes down to the scan; at most ``limit``, if it is not 0, in the order of the key."""
    commits = _commits(spark, path)
    found = _read(spark, path, commits)
    if found is None:
        return None
    found = found.where(condition)
    return found.orderBy(commits[0]["key"]).limit(limit) if limit else found


def find(spark: SparkSession, path: str, keys: Sequence | DataFrame) -> DataFrame | None:
    """Rows of the given keys (values, or a table with the key's column): only the buckets of these keys are read."""
    commits = _commits(spark, path)
    if not commits:
        return None
    key, buckets = commits[0]["key"], commits[0]["buckets"]
    if not isinstance(keys, DataFrame):
        keys = spark.createDataFrame([(k,) for k in keys], [key]) if len(keys) else spark.createDataFrame([], f"`{key}` string")
    keys = keys.select(key).distinct()
    wanted = {r["b"] for r in keys.select(bucket_of(F.col(key), buckets).alias("b")).distinct().collect()}
    found = _read(spark, path, [c for c in commits if c["bucket"] in wanted])
    return table(spark, path).limit(0) if found is None else found.join(keys, key, "left_semi")
