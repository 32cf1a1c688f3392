"""Whom and what to answer next: candidate queues with quotas, caps, cooldowns and freshness."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from threadloom.functions.columns import is_root, sane_epoch
from threadloom.operators.aggregates import competition
from threadloom.operators.ranking import round_robin, top_per_group, top_ranked


def silence(videos: DataFrame, comments: DataFrame, now: int, earliest: float = 1e9) -> DataFrame:
    """Videos (video_id, created) with ``silence_hours`` since their last comment; without one since they appeared."""
    last = comments.withColumn("created", sane_epoch(F.col("created"), earliest, now + 86_400)).groupBy("video_id").agg(F.max("created").alias("__last"))
    age = F.when(F.coalesce("created", F.lit(0)) > 0, F.greatest(F.lit(0.0), (F.lit(now) - F.col("created")) / 3600.0)).otherwise(0.0)
    since = F.when(F.col("__last").isNotNull(), F.greatest(F.lit(0.0), (F.lit(now) - F.col("__last")) / 3600.0))
    return videos.join(last, "video_id", "left").withColumn("silence_hours", F.coalesce(since, age)).drop("__last")


def hot_comment_candidates(videos: DataFrame, comments: DataFrame, busy: DataFrame, now: int, *, max_silence_hours: float = 720, fresh_hours: float = 48, quota: int = 2, earliest: float = 1e9) -> DataFrame:
    """Videos worth a root comment, most played first: open sections that are still alive, none of the busy ones.

    videos: video_id, play, reported, created. comments: video_id, parent_comment_id, likes, created. busy: video_id.
    """
    roots = comments.where(is_root(F.col("parent_comment_id")))
    own = videos.where("video_id <> ''").join(busy.select("video_id"), "video_id", "left_anti")
    open_ = silence(competition(own, roots).where("route = 'hot_comment'"), roots, now, earliest).where(F.col("silence_hours") <= max_silence_hours)
    picked = top_ranked(open_, [F.desc("play"), F.asc("video_id")], quota)
    return picked.withColumn("tier", F.when(F.col("silence_hours") <= fresh_hours, "A").otherwise("B"))


def funnel_of_videos(videos: DataFrame, comments: DataFrame, busy: DataFrame, now: int, max_silence_hours: float = 720, earliest: float = 1e9) -> DataFrame:
    """Videos by why they are no candidates (or are): one row a reason."""
    roots = comments.where(is_root(F.col("parent_comment_id")))
    marked = silence(competition(videos, roots), roots, now, earliest).join(busy.select("video_id").withColumn("__busy", F.lit(True)), "video_id", "left")
    reason = (
        F.when(F.col("__busy"), "cooldown")
        .when(F.col("route") != "hot_comment", F.when(F.col("competition").isin("too_small", "unknown_coverage", "crowded"), F.col("competition")).otherwise("contested"))
        .when(F.col("silence_hours") > max_silence_hours, "cooldown")
        .otherwise("hot_candidates")
    )
    return marked.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def screening_budget(quota: int, least: int = 150, times: int = 10, most: int = 1000) -> int:
    return min(max(least, times * quota), most)


def reply_queue(rows: DataFrame, screened: Column, *, key: str, video: str, order: Sequence[Column], quota: int, per_video: int = 1) -> DataFrame:
    """The queue of replies: videos take turns up to the screening budget, rows that pass are capped a video, then the quota.

    ``screened``: whether a row passes; it is asked of the rows within the budget only.
    """
    turned = round_robin(rows, [video], order, key, screening_budget(quota)).where(screened)
    capped = top_per_group(turned, [video], order, per_video, "__nth").drop("__nth")
    return top_ranked(capped, order, quota)


def full_queue(hot: DataFrame, replies: DataFrame, order: Sequence[Column], quota: int) -> DataFrame:
    """Hot comments first, then replies up to what is left of the quota: columns action, id, rank."""
    both = hot.select(F.lit(0).alias("__first"), F.lit("hot_comment").alias("action"), F.col("video_id").cast("string").alias("id"), "rank").unionByName(
        replies.select(F.lit(1).alias("__first"), F.lit("reply").alias("action"), F.col("id").cast("string").alias("id"), "rank")
    )
    return top_ranked(both.withColumnRenamed("rank", "__own"), [F.asc("__first"), F.asc("__own"), *order], quota).drop("__first", "__own")


def routes(candidates: DataFrame) -> DataFrame:
    """video_id and its route: both where it has several different actions, else its action."""
    return candidates.groupBy("video_id").agg(F.when(F.count_distinct("action") > 1, "both").otherwise(F.min("action")).alias("route"))


def family_quotas(rows: DataFrame, families: Sequence[str], *, key: str, hot: Sequence[Column], recent: Sequence[Column], eligible: Column, n_hot: int, n_recent: int) -> DataFrame:
    """Per family, in order, its hottest and then its most recent eligible rows; a key taken once is not taken again.

    The hot list is cut first and then loses what is taken; the recent pool loses it first. All that can be taken is
    ``n_hot + n_recent`` a family, so no recent row beyond that many more can count: rows are ranked once, and only the few
    that the quotas bound are dealt out one after another.
    """
    turn = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family"))
    own = rows.withColumn("__turn", turn).where(F.col("__turn") > 0)
    most = n_recent + len(families) * (n_hot + n_recent)
    ranked = []
    for kind, (order, n, pool) in enumerate(((hot, n_hot, own), (recent, most, own.where(eligible)))):
        place = F.row_number().over(Window.partitionBy("__turn").orderBy(*order))
        ranked.append(pool.withColumns({"__kind": F.lit(kind), "__place": place}).where(F.col("__place") <= n))
    shape = T.StructType([*rows.schema.fields, T.StructField("pick", T.StringType())])
    names, width, at_key = rows.columns, len(rows.columns), rows.columns.index(key)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, count = set(), Counter()
        for batch in batches:
            keys, turns, kinds = (batch.column(i).to_pylist() for i in (at_key, width, width + 1))
            kept = []
            for i, (k, t, kind) in enumerate(zip(keys, turns, kinds, strict=True)):
                if k not in taken and (kind == 0 or count[t] < n_recent):
                    taken.add(k)
                    count[t] += kind
                    kept.append(i)
            own = batch.take(pa.array(kept, pa.int64()))
            picks = pa.array([("hot", "recent")[kinds[i]] for i in kept], pa.string())
            yield pa.RecordBatch.from_arrays([*own.columns[:width], picks], [*names, "pick"])

    few = ranked[0].unionByName(ranked[1]).repartition(1).sortWithinPartitions("__turn", "__kind", "__place")  # as many as the quotas allow
    return few.mapInArrow(deal, shape)


def keyword_plan(keywords: DataFrame, day: date, limit: int) -> DataFrame:
    """keywords (keyword, position from 0) with ``now``: those of today's batch; the start moves by a batch each day."""
    n = keywords.agg(F.count(F.lit(1)).alias("__n"))
    start = F.pmod(F.lit(day.timetuple().tm_yday * limit), F.col("__n"))
    turn = F.pmod(F.col("position") - start, F.col("__n"))
    return keywords.crossJoin(n).select("keyword", turn.alias("turn"), (turn < limit).alias("now"))


def recent_drafts(items: DataFrame, now: Column, days: float, statuses: Sequence[str]) -> DataFrame:
    """Own texts of the last days that count for likeness: of some statuses, by when they were sent, decided or made."""
    at = F.coalesce("sent_at", "decided_at", "created_at")
    return items.where(F.col("status").isin(*statuses) & (F.coalesce("draft", F.lit("")) != "") & ((now - at) <= days * 86_400))


def decided(items: DataFrame, condition: Column, status: str, now: Column) -> DataFrame:
    """Pending items that meet a condition get a status; all others stay."""
    hit = (F.col("status") == "pending_review") & F.coalesce(condition, F.lit(False))
    return items.withColumn("decided_at", F.when(hit, now).otherwise(F.col("decided_at"))).withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status")))


def marked(items: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks (comment_id, status) reach every item of the same comment; the last of several marks counts (seq)."""
    last = marks.groupBy("comment_id").agg(F.max_by("status", "seq").alias("__status"))
    return items.join(last, "comment_id", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")
