"""Mix sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document gets the exponential key -ln(u) / q from a uniform u (a hash of seed, doc_id and text) and its quality
weight q; ascending keys are a weighted sample without replacement. A source whose target is k whole times its size plus
a rest takes every document k times, then documents in key order while the running sum of words stays nearest the rest.

No source is ever sorted as a whole: keys are bucketed monotonically, bucket sums locate the bucket in which a source's
budget ends, and only that bucket's few thousand rows are prefix-summed. The outcome is one small cut per source, so a
row's decision is an expression on the row itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.llm.common import WORD, Scratch

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: Rows of a key bucket, about.
BUCKET_ROWS = 2_000
#: Sources up to which the plan (one narrow row a source) is broadcast; with more it is joined by a shuffle.
BROADCAST_SOURCES = 50_000

SYMBOLS = r"[0-9#$%&*|<>{}@=_~^\\/+]"


def quality_weight(text: Column) -> Column:
    """1 less the share of symbol characters and digits, at least 0.5; 1 for empty and null texts."""
    share = F.regexp_count(text, F.lit(SYMBOLS)) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.5), F.lit(1.0) - share), F.lit(1.0))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> list[Column]:
    text = F.col(text_col)
    digest = F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    drawn = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), digest))
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return [
        F.col(id_col).alias("__id"),
        F.col(source_col).alias("__source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("__size"),
        (-F.log(u) / quality_weight(text)).alias("__key"),
        digest.alias("__digest"),
    ]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From (__source, __source_size, __rows) the plan with __target, __epochs and __rest.

    Weights repeat over the sources in code-point order, null last. Targets share the whole; one above cap times its
    source's size stops there and the excess is reshared by weight. That fixed point is min(cap * size, level * weight):
    in ascending order of cap * size / weight the stopped sources come first, and the level follows from the others.
    The plan has one row a source, so its two windows run over the sources, not the documents.
    """
    order = Window.orderBy(F.asc_nulls_last("__source"))
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))
    ranked = Window.orderBy("__ratio", F.asc_nulls_last("__source"))
    earlier, later = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("__source_size").over(whole)
    plan = (
        sizes.withColumn("__weight", weight)
        .withColumn("__ratio", F.lit(float(cap)) * F.col("__source_size") / F.col("__weight"))
        .withColumn("__level", (total - cap * F.coalesce(F.sum("__source_size").over(earlier), F.lit(0))).cast("double") / F.sum("__weight").over(later))
        .withColumn("__free_level", F.min(F.when(F.col("__ratio") > F.col("__level"), F.struct("__ratio", "__level"))).over(whole)["__level"])
    )
    target = F.least(F.lit(float(cap)) * F.col("__source_size"), F.coalesce(F.col("__free_level") * F.col("__weight"), F.lit(float(cap)) * F.col("__source_size")))
    epochs = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0).cast("long")
    return (
        plan.withColumn("__target", target)
        .withColumn("__epochs", epochs)
        .select("__source", "__source_size", "__rows", "__target", "__epochs", (F.col("__target") - F.col("__epochs") * F.col("__source_size")).alias("__rest"))
    )


def _bucket() -> Column:
    n = F.ceil(F.col("__rows") / BUCKET_ROWS)
    return F.floor((F.lit(1.0) - F.exp(-F.col("__key"))) * n).cast("long")


def mixing_plan(rows: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row a source: target, epochs and where in key order the fractional epoch ends (__cut bucket, __last key in it)."""
    sizes = rows.groupBy("__source").agg(F.sum("__size").alias("__source_size"), F.count(F.lit(1)).alias("__rows"))
    plan = scratch.keep(source_targets(sizes, weights, cap), "plan")
    placed = join_plan(rows, plan).withColumn("__bucket", _bucket())
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        placed.groupBy("__source", "__bucket", "__rest")
        .agg(F.sum("__size").alias("__sum"))
        .withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    )
    # The first bucket whose end lies beyond the rest; without one every bucket is taken whole.
    cut = (
        sums.where(F.col("__before") + F.col("__sum") > F.col("__rest"))
        .groupBy("__source")
        .agg(F.min(F.struct("__bucket", "__before")).alias("c"))
        .select("__source", F.col("c.__bucket").alias("__cut"), F.col("c.__before").alias("__cut_before"))
    )
    plan = scratch.keep(plan.join(cut, plan["__source"].eqNullSafe(cut["__source"]), "left").drop(cut["__source"]), "cut")
    running = Window.partitionBy("__source").orderBy("__key", "__id", "__digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (
        join_plan(rows, plan)
        .withColumn("__bucket", _bucket())
        .where(F.col("__bucket") == F.col("__cut"))
        .groupBy("__source", "__key", "__id", "__digest", "__cut_before", "__rest")  # rows equal in id and text as one
        .agg(F.sum("__size").alias("__own"))
        .withColumn("__end", F.col("__cut_before") + F.sum("__own").over(running))
        .withColumn("__start", F.col("__end") - F.col("__own"))
        .where((F.col("__end") <= F.col("__rest")) | ((F.col("__start") < F.col("__rest")) & (F.col("__end") - F.col("__rest") <= F.col("__rest") - F.col("__start"))))
        .groupBy("__source")
        .agg(F.max(F.struct("__key", "__id", "__digest")).alias("__last"))
    )
    return scratch.keep(plan.join(edge, plan["__source"].eqNullSafe(edge["__source"]), "left").drop(edge["__source"]), "edge")


def join_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's plan; the plan is broadcast when its counted rows are few."""
    small = F.broadcast(plan) if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else plan
    return rows.join(small, rows["__source"].eqNullSafe(plan["__source"])).drop(plan["__source"])


def _times() -> Column:
    """How often the mix takes a row: whole epochs, and once more if its key comes before the cut; one without words once."""
    key = F.struct("__key", "__id", "__digest")
    bucket = _bucket()
    once_more = F.when(F.col("__cut").isNull(), F.col("__rest") > 0).otherwise((bucket < F.col("__cut")) | ((bucket == F.col("__cut")) & F.coalesce(key <= F.col("__last"), F.lit(False))))
    return F.when(F.col("__size") == 0, 1).otherwise(F.col("__epochs") + F.coalesce(once_more, F.lit(False)).cast("long")).cast("long")


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document doc_id, source, size (words), source_size, target, times, taken (size * times).

    Texts without words (null, empty) have size 0, take no words and count once; null is a source of its own, and null an
    id; very long texts count whole; rows equal in id and text stand or fall together; ties of keys go by id, then text;
    an empty table gives an empty table. Other columns are not read. A source's taken words differ from its
    target by at most half of one document (or of one group of equal rows). The same rows give the same mix.
    """
    with Scratch(docs.sparkSession, "mix") as scratch:
        rows = scratch.keep(docs.select(*_keyed(docs, id_col, text_col, source_col, seed)), "rows")
        return scratch.result(
            join_plan(rows, mixing_plan(rows, scratch, weights, cap))
            .withColumn("times", _times())
            .select(
                F.col("__id").alias("doc_id"),
                F.col("__source").alias("source"),
                F.col("__size").alias("size"),
                F.col("__source_size").alias("source_size"),
                F.col("__target").alias("target"),
                "times",
                (F.col("__size") * F.col("times")).alias("taken"),
            )
        )


def mixed_documents(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document's own columns, as many rows as the mix takes it times.

    Rows without words (null, empty) cost no words and come once each. Repeated rows are repeated alike; an empty table
    gives an empty table; no column name can clash, as a row's own columns travel as one.
    """
    columns = docs.columns
    own = docs.select(F.struct(*[docs[c] for c in columns]).alias("__doc"), *_keyed(docs, id_col, text_col, source_col, seed))
    with Scratch(docs.sparkSession, "mix") as scratch:
        plan = scratch.result(mixing_plan(scratch.keep(own.drop("__doc"), "rows"), scratch, weights, cap))
    return (
        join_plan(own, plan)
        .withColumn("__times", _times())
        .where("__times > 0")
        .select("__doc", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__nth"))
        .select("__doc.*")
    )
