"""Aggregates over comments, users, signals, themes and costs. All combine partially before their shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.functions.columns import PLAY_TIERS, is_root, percent
from threadloom.operators.ordered import middle, nearest, numbered, ranked_values


def filled(c: Column) -> Column:
    """Null for the empty string, so that distinct counts leave it out."""
    return F.when(c.cast("string") != "", c)


def run_statistics(df: DataFrame, *, user: Column, conditions: dict[str, Column], distinct: dict[str, Column]) -> DataFrame:
    """One row: total, distinct users, a count for each condition and a distinct count for each expression."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(filled(user)).alias("users"),
        *[F.count_if(c).alias(n) for n, c in conditions.items()],
        *[F.count_distinct(filled(c)).alias(n) for n, c in distinct.items()],
    )


def group_summary(df: DataFrame, group: Sequence[str], *, distinct: dict[str, Column], sums: dict[str, Column], tops: dict[str, Column]) -> DataFrame:
    """Rows of each group (``n``), with distinct counts of filled values, sums and maxima."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_distinct(filled(c)).alias(n) for n, c in distinct.items()], *[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in tops.items()]
    )


def quantiles(df: DataFrame, value: str, at: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """Per group n and, as p10, p25 and so on, the element at round-half-even(q * (n - 1)) of the filled values in order."""
    ranked = ranked_values(df, list(group), value)
    return ranked.groupBy(*group).agg(F.max("n").alias("n"), *[nearest(value, q).alias(f"p{round(100 * q)}") for q in at])


def reply_structure(df: DataFrame, thread: str, *, reply: Column, parent: str) -> DataFrame:
    """Per thread: rows, replies, and roots, whose parent is empty or zero."""
    return df.groupBy(thread).agg(F.count(F.lit(1)).alias("turns"), F.count_if(reply).alias("replies"), F.count_if(is_root(F.col(parent))).alias("roots"))


def label_percentages(df: DataFrame, label: str) -> DataFrame:
    """n and pct of each label; percentages of the labelled rows, so they sum to 100."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.crossJoin(total).withColumn("pct", percent(F.col("n"), F.col("__total"))).drop("__total")


def coverage(df: DataFrame, labels: str) -> DataFrame:
    """For an array column: rows that have each label, once a row, and their share of all rows; shares may pass 100 together."""
    counts = df.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    return counts.crossJoin(total).withColumn("pct", percent(F.col("n"), F.col("__total"))).drop("__total")


def zero_filled(df: DataFrame, label: str, labels: Sequence[str]) -> DataFrame:
    """A count for each label of a given list, 0 where it doesn't occur; labels outside the list are left out."""
    wanted = df.sparkSession.createDataFrame([(x,) for x in labels], f"{label} string")
    counts = df.where(F.col(label).isin(*labels)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))


def pivoted_counts(df: DataFrame, group: Sequence[str], kind: str, kinds: Sequence[str]) -> DataFrame:
    """One column a kind; the kinds are given, so the pivot needs no extra scan."""
    return df.groupBy(*group).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def contradictions(df: DataFrame, group: str, relation: str) -> DataFrame:
    """weakens and supports a group, with importance: high from 5 or from a tenth of all."""
    counts = df.groupBy(group).agg(F.count_if(F.col(relation) == "weakens").alias("weakens"), F.count_if(F.col(relation) == "supports").alias("supports"), F.count(F.lit(1)).alias("n"))
    important = (F.col("weakens") >= 5) | (F.col("weakens") * 10 >= F.col("n"))
    return counts.where("weakens > 0").withColumn("importance", F.when(important, "important").otherwise("minor"))


def user_leads(df: DataFrame, *, user: str, seq: str, score: str, quote: str, quotes: int = 5) -> DataFrame:
    """Per user: comments, best score, its first row's sequence, and the first few distinct quotes in order.

    A quote's first place is a plain minimum per (user, quote); ranking then keeps the first few, so no group's texts are
    gathered whole.
    """
    best = df.groupBy(user).agg(F.count(F.lit(1)).alias("comments"), F.max(score).alias("best_score"), F.max(F.struct(F.col(score), (-F.col(seq)).alias("s"))).alias("b"))
    firsts = df.where(F.coalesce(F.col(quote), F.lit("")) != "").groupBy(user, quote).agg(F.min(seq).alias("at"))
    ranked = firsts.withColumn("n", F.row_number().over(Window.partitionBy(user).orderBy("at"))).where(F.col("n") <= quotes)
    gathered = ranked.groupBy(user).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", quote))), lambda x: x[quote]).alias("quotes"))
    return best.join(gathered, user, "left").select(user, "comments", "best_score", (-F.col("b.s")).alias("best_seq"), F.coalesce("quotes", F.array().cast("array<string>")).alias("quotes"))


def signal_frequencies(signals: DataFrame, *, kind: str, text: Column, seq: str) -> DataFrame:
    """Distinct signals (kind, normalised text) with frequency and first row's sequence, numbered by (-frequency, key)."""
    keyed = signals.withColumn("signal_key", F.concat_ws("|", F.col(kind), text))
    counted = keyed.groupBy("signal_key").agg(F.count(F.lit(1)).alias("frequency"), F.min(seq).alias("first_seq"))
    placed = numbered(counted, [], [F.desc("frequency"), F.asc("signal_key")])
    number = F.when(F.col("n") >= 10_000, F.col("n").cast("string")).otherwise(F.lpad(F.col("n").cast("string"), 4, "0"))
    return placed.select(F.concat(F.lit("s"), number).alias("signal_id"), "signal_key", "frequency", "first_seq")


def theme_members(themes: DataFrame) -> DataFrame:
    """(theme_id, signal_id) of themes that list their signals in an array."""
    return themes.select("theme_id", F.explode(F.array_distinct("signal_ids")).alias("signal_id"))


def theme_statistics(members: DataFrame, signals: DataFrame) -> DataFrame:
    """members (theme_id, signal_id) with distinct records, users and videos of their signals."""
    return members.join(signals, "signal_id").groupBy("theme_id").agg(
        F.count_distinct("record_id").alias("records"), F.count_distinct(filled(F.col("user_key"))).alias("users"), F.count_distinct(filled(F.col("video_id"))).alias("videos")
    )


def prefix_themes(signals: DataFrame, *, text: Column, prefix: int = 24, merged_prefix: int = 16) -> DataFrame:
    """Two rounds of grouping by normalised prefixes: theme_id, theme_name (of the last signal), members."""
    first = signals.withColumn("k", F.substring(text, 1, prefix)).groupBy("k").agg(F.max_by(F.substring("text", 1, 20), "signal_id").alias("name"), F.count(F.lit(1)).alias("n"), F.min("signal_id").alias("s"))
    key = F.substring(F.lower(F.regexp_replace(F.trim("name"), r"\s+", " ")), 1, merged_prefix)
    second = first.withColumn("k2", key).groupBy("k2").agg(F.min_by("name", "s").alias("theme_name"), F.sum("n").alias("members"))
    return second.select(F.concat(F.lit("t_"), F.substring(F.sha1("k2"), 1, 8)).alias("theme_id"), "theme_name", "members")


def majority(df: DataFrame, group: str, label: str, seq: str) -> DataFrame:
    """The commonest label of each group; among equals the one seen first."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("at"))
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "at"))
    return counts.withColumn("r", best).where("r = 1").select(group, label, "n")


def rollup_counts(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Counts of every level and the total; ``depth`` tells how many levels a row is split by."""
    return df.rollup(*levels).agg(F.count(F.lit(1)).alias("n"), (F.lit(len(levels)) - sum(F.grouping(c) for c in levels)).cast("int").alias("depth"))


def cost_summary(df: DataFrame, *, feature: str, model: str, tokens: str, today: Column) -> DataFrame:
    """Calls and tokens in all, by feature and by model, each with today's share: grouping sets in one pass."""
    return df.groupingSets([[], [feature], [model]], feature, model).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(tokens).alias("tokens"), F.count_if(today).alias("calls_today"), F.coalesce(F.sum(F.when(today, F.col(tokens))), F.lit(0)).alias("tokens_today")
    )


def competition(videos: DataFrame, comments: DataFrame, *, min_play: int = 1000, cold: int = 10, multiple: float = 2.0, floor: int = 50, open_ratio: float = 0.5, min_sample: int = 5) -> DataFrame:
    """videos (video_id, play, reported) and comments (video_id, likes): how taken the comment section is, and the route."""
    seen = comments.groupBy("video_id").agg(F.count(F.lit(1)).alias("sampled"), F.max("likes").alias("top1"))
    joined = videos.join(seen, "video_id", "left").withColumns({"sampled": F.coalesce("sampled", F.lit(0)), "top1": F.coalesce("top1", F.lit(0))})
    median = F.when(F.lit(False), 0)
    for limit, _, m in PLAY_TIERS:
        median = median.when(F.col("play") < limit, m) if limit is not None else median.otherwise(m)
    joined = joined.withColumn("tier_median", median).withColumn("comments", F.greatest("reported", "sampled"))
    kind = (
        F.when(F.col("play") < min_play, "too_small")
        .when((F.col("sampled") < min_sample) & (F.col("reported") >= cold), "unknown_coverage")
        .when((F.col("comments") < cold) & (F.col("top1") < cold), "cold")
        .when(F.col("top1") >= F.greatest(F.floor(F.col("tier_median") * multiple), F.lit(floor)), "crowded")
        .when(F.col("top1") <= F.greatest(F.floor(F.col("tier_median") * open_ratio), F.lit(5)), "open")
        .otherwise("contested")
    )
    route = F.when(F.col("competition") == "too_small", "skip").when(F.col("competition").isin("cold", "open"), "hot_comment").otherwise("reply")
    return joined.withColumn("competition", kind).withColumn("route", route)


def tier_baseline(df: DataFrame, tier: str, value: str) -> DataFrame:
    """Per tier: n, nearest-rank quartiles, whole-number median and maximum."""
    return ranked_values(df, [tier], value).groupBy(tier).agg(
        F.max("n").alias("n"), nearest(value, 0.25).alias("p25"), F.floor(middle(value)).alias("median"), nearest(value, 0.75).alias("p75"), F.max(value).alias("top")
    )


def shares_within(df: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    """n and for each bound the share of rows at or below it."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.col(value) <= b).cast("double")).alias(f"within_{b:g}") for b in bounds])


def medians(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """n, median and maximum of a value for each group."""
    return ranked_values(df, group, value).groupBy(*group).agg(F.max("n").alias("n"), middle(value).alias("median"), F.max(value).alias("top"))


def feature_lift(df: DataFrame, value: str, flags: Sequence[str]) -> DataFrame:
    """For each flag the median of the flagged rows over that of all."""
    base = medians(df, [], value).select(F.col("median").alias("base"))
    stacked = df.select(value, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("on")) for f in flags])).alias("x")).where("x.on").select(value, "x.feature")
    return medians(stacked, ["feature"], value).drop("top").crossJoin(base).withColumn("lift", F.col("median") / F.col("base")).drop("base")


def confusion(df: DataFrame, said: str, true: str) -> DataFrame:
    return df.groupBy(said, true).agg(F.count(F.lit(1)).alias("n")).withColumn("right", F.col(said).eqNullSafe(F.col(true)))


def funnel(df: DataFrame, checks: Sequence[tuple[str, Column]], passed: str = "passed") -> DataFrame:
    """Rows by the first check that they fail, in the checks' order."""
    reason = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, fails in checks:
        reason = reason.when(fails, name)
    return df.withColumn("reason", reason.otherwise(passed)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def latency_profile(df: DataFrame, group: Sequence[str], ms: str) -> DataFrame:
    """n, mean, median and nearest-rank 95th percentile."""
    total = F.sum(F.col(ms) * F.col("m"))
    return ranked_values(df, group, ms).groupBy(*group).agg(F.max("n").alias("n"), (total / F.max("n")).alias("mean"), middle(ms).alias("median"), nearest(ms, 0.95).alias("p95"))


def keyword_counts(df: DataFrame, text: Column, patterns: Sequence[str]) -> DataFrame:
    """Rows that each of a stated list of patterns is found in, whatever its case: one scan."""
    counts = df.agg(*[F.count_if(F.regexp_like(text, F.lit(f"(?i){p}"))).alias(f"k{i}") for i, p in enumerate(patterns)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("keyword"), F.col(f"k{i}").alias("n")) for i, p in enumerate(patterns)])).alias("x")).select("x.*")


def blank_share(df: DataFrame) -> DataFrame:
    """Share of videos (top1, tier_median) whose best comment lies below a quarter of its tier's median, and their number."""
    return df.agg(F.avg((F.col("top1") < F.col("tier_median") / 4.0).cast("double")).alias("blank_share"), F.count(F.lit(1)).alias("n"))


def group_hits(df: DataFrame, group: str, hit: Column, *, least: int, share: float = 0.1) -> DataFrame:
    """Per group its hits, and whether they are enough: a least number, or a share of the group's rows."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), F.count_if(hit).alias("hits"))
    return counts.select(group, "hits", ((F.col("hits") >= least) | (F.col("hits") >= F.col("__n") * share)).alias("passes"))


def batches(df: DataFrame, group: str, size: int) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / size).cast("long").alias("batches"))


def gate(df: DataFrame, *, expected: Column, found: Column, agrees: Column) -> DataFrame:
    """total, expected rows, the share of them that was found, and the share of rows that agree."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(expected).alias("expected"), F.avg(F.when(expected, found.cast("double"))).alias("recall"), share(agrees).alias("agreement"))


def set_sizes(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many different keys only the left side has, only the right, and both."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(key, F.lit(0), F.lit(1)))
    each = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    part = F.when(F.col("l") > F.col("r"), "left").when(F.col("l") < F.col("r"), "right").otherwise("both")
    return each.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
