"""Catalogues, reports and small lists over comments, files, runs and sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.functions.columns import fuzzy_hit, strip
from threadloom.functions.evidence import contains_any
from threadloom.operators.aggregates import filled
from threadloom.operators.dedupe import first_wins
from threadloom.operators.ranking import top_per_group, top_ranked

# --- Fixed values: signals that weigh in the choice of quotes. ---------------------------------------------------------

PROCESS_SIGNALS = (
    "howto_uncertainty", "cannot_complete", "expected_effect_missing", "physical_discomfort", "needs_alternative", "needs_simpler", "needs_advanced",
    "needs_plan", "pace_problem", "instruction_unclear", "started_using", "continued_using", "positive_result", "negative_result",
)
MOTIVATION_SIGNALS = ("motivation_or_accountability", "stopped_using", "skipped_step")


def quote_score(hypothesis: Column, relation: Column, quote: Column, intent: Column, signals: Column, video: Column, confidence: Column) -> Column:
    """How well a quote stands for a hypothesis: points for signals and words that fit it, less for thanks and off-topic."""
    some = lambda names: F.coalesce(F.arrays_overlap(signals, F.array(*[F.lit(n) for n in names])), F.lit(False))
    has = lambda *words: contains_any(quote, words)
    points = lambda n, c: F.when(F.coalesce(c, F.lit(False)), float(n)).otherwise(0.0)
    process, motive = some(PROCESS_SIGNALS), some(MOTIVATION_SIGNALS)
    common = points(-0.5, intent.isin("invalid_or_unclear", "other_valid") & ~has("谢谢")) + points(-1.5, intent == "gratitude_recognition") + points(-1, has("谢谢", "感谢", "多谢"))
    own = {
        ("H1", "supports"): points(2, process) + points(1, intent.isin("difficulty_help_request", "result_feedback", "check_in")) + points(-1.5, (intent == "question") & ~process),
        ("H1", "weakens"): points(2, motive) + points(1.5, has("懒", "坚持不", "没动力", "不想开始", "提不起")) + points(-1.5, process & ~motive) + points(-3, has("真的有用", "有效", "改善", "缓解", "谢谢")),
        ("H2", "supports"): points(2.5, video.isin("personalized_judgment_needed", "realtime_observation_needed")) + points(1.5, some(("howto_uncertainty", "asks_creator_reply", "recorded_self_for_review")))
        + points(-2, (intent == "question") & video.isin("one_reply_sufficient", "video_sufficient", "unclear")) + points(2, has("帮我看", "看看我", "哪里不对", "做得对不对")),
        ("H2", "weakens"): points(2, video.isin("video_sufficient", "one_reply_sufficient")) + points(1.5, has("看懂了", "照着做", "看第二遍", "就会了"))
        + points(-3, (intent == "gratitude_recognition") | has("谢谢", "感谢", "真的有用", "有效")),
        ("H3", "supports"): points(2, some(("needs_plan", "needs_advanced", "needs_simpler", "changed_plan"))) + points(1.5, has("怎么安排", "做计划", "怎么做", "进阶", "帮我安排"))
        + points(-1, (intent == "question") & ~has("安排", "计划")),
        ("H3", "weakens"): points(1.5, has("自己安排", "自己计划", "随便做")),
    }
    chosen = F.when(F.lit(False), F.lit(0.0))
    for (h, r), p in own.items():
        chosen = chosen.when((hypothesis == h) & (relation == r), p)
    whole = F.coalesce(confidence, F.lit(0.0)) + F.least(F.length(quote), F.lit(60)) / 60.0 + common + chosen.otherwise(0.0)
    return F.when(F.length(strip(F.coalesce(quote, F.lit("")))) < 4, -10.0).otherwise(whole)


def representative_quotes(rows: DataFrame, most: int = 5) -> DataFrame:
    """rows (hypothesis_id, relation, quote, score): of each relation the best different quotes, longer ones first among equals."""
    key = ["hypothesis_id", "relation"]
    once = rows.where("score >= 0 AND quote <> ''").groupBy(*key, "quote").agg(F.max("score").alias("score"))
    return top_per_group(once, key, [F.desc("score"), F.desc(F.length("quote")), F.asc("quote")], most)


def contact_reason(evidence: Column, help_seeking: Column, problems: Column, score: Column, matches: Column) -> Column:
    """Why a person is worth asking, in words; prices named in it are marked as no proof."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    parts = F.concat_ws(
        "；",
        F.when(some(matches), F.concat(F.lit("符合调研对象："), F.array_join(matches, "、"))),
        F.when(evidence.isin("tried", "continued"), "有真实行为证据"),
        F.when(help_seeking, "主动求助"),
        F.when(some(problems), F.concat(F.lit("具体问题："), F.array_join(F.slice(problems, 1, 2), "；"))),
        F.when(score >= 5, "可供调研的具体线索较多（不代表产品匹配）"),
    )
    text = F.when(parts == "", "暂无足够线索判断调研价值，需核对原评论").otherwise(parts)
    return F.when(contains_any(text, ("付费意愿", "强烈付费", "购买意向", "询价")), F.concat(text, F.lit("；价格相关表述不能证明实际购买行为"))).otherwise(text)


def research_matches(targets: Sequence[str], comment: Column, pool: Column, hints: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Those of a short stated list of targets of which the comment or the pool has a word, or a pair of its characters."""
    low, wide = F.lower(F.coalesce(comment, F.lit(""))), F.lower(F.coalesce(pool, F.lit("")))
    found = []
    for target in targets:
        words = [w.lower() for w in [*(hints or {}).get(target, ()), target] if len(w) >= 2]
        hit = F.lit(False)
        for w in words:
            hit = hit | fuzzy_hit(F.lit(w), low) | fuzzy_hit(F.lit(w), wide)
        found.append(F.when(hit, F.lit(target)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def relevance(matches: Column, help_seeking: Column, problems: Column, evidence: Column) -> Column:
    return F.size(matches) * 3 + F.when(help_seeking, 2).otherwise(0) + F.when(F.size(problems) > 0, 1).otherwise(0) + F.when(evidence.isin("tried", "continued"), 1).otherwise(0)


def comment_summary(df: DataFrame) -> DataFrame:
    """One row over comments (channel, video_id, user_id, parent_comment_id): totals, channels, videos, authors, replies."""
    reply = F.coalesce("parent_comment_id", F.lit("")) != ""
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("channel").alias("channels"), F.count_distinct("video_id").alias("videos"), F.count_distinct(filled(F.col("user_id"))).alias("authors"), F.count_if(reply).alias("replies")
    )


def top_comments_of_top_videos(df: DataFrame, seq: str, videos: int = 8, comments: int = 8) -> DataFrame:
    """The best liked comments of the videos with most comments: video_rank and rank from 1."""
    largest = top_ranked(df.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc("video_id")], videos, "video_rank")
    own = df.join(largest.select("video_id", "video_rank"), "video_id")
    return top_per_group(own, ["video_id"], [F.desc("likes"), F.asc(seq)], comments)


def file_statistics(files: DataFrame, platforms: Sequence[str]) -> DataFrame:
    """files (path, size): number and bytes by kind (the suffix) and by the first platform whose name stands in the path."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    platform = F.coalesce(*[F.when(F.contains("path", F.lit(p)), F.lit(p)) for p in platforms], F.lit("other"))
    rows = files.select(kind.alias("kind"), platform.alias("platform"), "size")
    return rows.groupBy("kind", "platform").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def browsable(files: DataFrame, folders: Sequence[str], suffixes: Sequence[str], secret: Sequence[str]) -> DataFrame:
    """Files (path) below the allowed folders, of allowed suffixes, without a sensitive word in their name."""
    under = F.lit(False)
    for folder in folders:
        under = under | F.startswith("path", F.lit(folder.rstrip("/") + "/"))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return files.where(under & F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*suffixes) & ~contains_any(name, secret))


def notes_page(notes: DataFrame, needle: str, order: Sequence[Column], limit: int, offset: int) -> DataFrame:
    """Notes whose title, author or keyword holds the needle, whatever its case: a slice of 1 to 500 rows."""
    low = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("author", F.lit("")), F.coalesce("keyword", F.lit(""))))
    kept = notes.where(F.contains(low, F.lit(needle.lower()))) if needle else notes
    return kept.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, 500)))


def status_counts(df: DataFrame, statuses: Sequence[str], column: str = "status") -> DataFrame:
    return df.agg(*[F.count_if(F.col(column) == s).alias(s) for s in statuses])


def engagement_ratios(notes: DataFrame, *, least_likes: int = 200, top: int = 12, bottom: int = 6) -> DataFrame:
    """notes (id, likes, comments): the highest and lowest comments a like among well liked notes, by side."""
    rated = notes.where(F.col("likes") >= least_likes).withColumn("ratio", F.col("comments") / F.col("likes"))
    sides = [top_ranked(rated, [order("ratio"), F.asc("id")], n).withColumn("side", F.lit(side)) for side, order, n in (("top", F.desc, top), ("bottom", F.asc, bottom))]
    return sides[0].unionByName(sides[1])


def axis_coverage(keywords: DataFrame) -> DataFrame:
    """keywords (axis, keyword, verdict): per axis its keywords, different ones, repeated ones, and those with a signal."""
    each = keywords.groupBy("axis", F.lower(F.trim("keyword")).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "signal").alias("s"))
    return each.groupBy("axis").agg(F.sum("n").alias("keywords"), F.count(F.lit(1)).alias("different"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum("s").alias("signals"))


def top_findings(findings: DataFrame, most: int = 5) -> DataFrame:
    """findings (finding_id, user_key, record_id, ref): those with most users, then records, then references."""
    counts = findings.groupBy("finding_id").agg(F.count_distinct(filled(F.col("user_key"))).alias("users"), F.count_distinct("record_id").alias("records"), F.count_distinct("ref").alias("refs"))
    return top_ranked(counts, [F.desc("users"), F.desc("records"), F.desc("refs"), F.asc("finding_id")], most)


def first_new_signals(signals: DataFrame, seq: str, most: int = 10) -> DataFrame:
    """Different signals (type, text) in order of their first appearance."""
    once = signals.groupBy("type", "text").agg(F.min(seq).alias("first_seq"))
    return top_ranked(once, [F.asc("first_seq"), F.asc("type"), F.asc("text")], most)


def session_rows(now: DataFrame, before: DataFrame, started: Column) -> DataFrame:
    """Rows that a session added: per file (path, rows, modified) what exceeds the snapshot; new or shrunk files count whole.

    Files untouched since the start are left out; the result is at least the rows of the newest file.
    """
    live = now.where(F.col("modified") >= started).join(before.select("path", F.col("rows").alias("__before")), "path", "left")
    base = F.when(F.col("__before").isNull() | (F.col("rows") < F.col("__before")), 0).otherwise(F.col("__before"))
    return live.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.col("rows") - base)), F.lit(0)).alias("added"), F.coalesce(F.max_by("rows", F.struct("modified", "path")), F.lit(0)).alias("newest")).select(
        F.greatest("added", "newest").alias("rows"), "added", "newest"
    )


def restart_wanted(collected: DataFrame, targets: DataFrame, share: float = 0.95) -> DataFrame:
    """Per video: distinct comments collected, the target, and whether collecting has to start again (less than a share of it)."""
    have = collected.groupBy("video_id").agg(F.count_distinct("comment_id").alias("have"))
    joined = targets.join(have, "video_id", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return joined.withColumn("restart", F.col("have") < F.col("target") * share)


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with those of the rows whose key it does not have yet, each key once."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti").dropDuplicates([key]))


def runs_with_files(runs: DataFrame, files: Sequence[str]) -> DataFrame:
    """Unfinished runs over exactly these files, newest first."""
    wanted = F.array(*[F.lit(f) for f in sorted(set(files))])
    return runs.where((F.array_sort(F.array_distinct("files")) == wanted) & (F.col("status") != "completed")).orderBy(F.desc("created_at"))


def runs_list(index: DataFrame, found: DataFrame) -> DataFrame:
    """Runs of the index, then those found beside it, each id once, newest first."""
    both = index.withColumn("__from", F.lit(0)).unionByName(found.withColumn("__from", F.lit(1)), allowMissingColumns=True)
    return first_wins(both, ["run_id"], "__from").drop("__from").orderBy(F.desc("created_at"), F.asc("run_id"))


def parent_folders(files: DataFrame) -> DataFrame:
    """Folders of files (path) with their number."""
    return files.groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("files"))


def eta(done: Column, total: Column, mean_seconds: Column, default: float) -> Column:
    """struct(pct, seconds): percent done (99 at most until all are) and seconds left by the mean so far or a default."""
    pct = F.when(total <= 0, 0).when(done >= total, 100).otherwise(F.least(F.lit(99), F.floor(done * 100.0 / total)))
    left = F.greatest(F.lit(0), total - done)
    return F.struct(pct.cast("long").alias("pct"), F.ceil(left * F.coalesce(mean_seconds, F.lit(default))).cast("long").alias("seconds"))


def top_label(counts: DataFrame, label: str, seq: str) -> DataFrame:
    """The label with most rows; among equals the one seen first."""
    return top_ranked(counts, [F.desc("n"), F.asc(seq)], 1).select(label, "n")


def reorganised(videos: DataFrame, comments: DataFrame, creators: DataFrame) -> DataFrame:
    """Comments with the folder of their video and its creator's name, for a write partitioned by ``folder``."""
    slug = F.concat_ws("_", F.nullif(F.substring(F.regexp_replace(F.col("title"), r'[\\/:*?"<>|\s]+', "_"), 1, 40), F.lit("")), F.col("video_id"))
    named = videos.withColumn("folder", slug).join(creators.select("user_id", F.col("nickname").alias("creator")), "user_id", "left").drop("user_id")
    return comments.join(named.select("video_id", "folder", "creator"), "video_id")


def blind_rows(legacy: DataFrame, evidence: DataFrame, key: str, seed: str) -> DataFrame:
    """Two results of each row side by side under the names a and b, swapped by a hash; ``swapped`` is the code to undo it."""
    joined = legacy.select(key, F.to_json(F.struct(*[c for c in legacy.columns if c != key])).alias("__l")).join(evidence.select(key, F.to_json(F.struct(*[c for c in evidence.columns if c != key])).alias("__e")), key)
    swap = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), 1, 1).isin(*"01234567")
    return joined.select(key, F.when(swap, F.col("__e")).otherwise(F.col("__l")).alias("a"), F.when(swap, F.col("__l")).otherwise(F.col("__e")).alias("b"), swap.alias("swapped"))


def cached_results(rows: DataFrame, cache: DataFrame, fingerprint: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with a cached result, rows to compute): by fingerprint; empty results in the cache do not count."""
    keyed = rows.withColumn("fingerprint", fingerprint)
    usable = cache.where("result IS NOT NULL AND result <> ''").select("fingerprint", "result").dropDuplicates(["fingerprint"])
    return keyed.join(usable, "fingerprint"), keyed.join(usable, "fingerprint", "left_anti")


def newest_first_ledger(ledger: DataFrame, limit: int) -> DataFrame:
    """The last entries of a ledger (seq), newest first: 1 to 5000."""
    return top_ranked(ledger, [F.desc("seq")], max(1, min(limit, 5000)))


def refreshed_catalogue(new: DataFrame, old: DataFrame, key: str, fields: Sequence[str], early: int = 20) -> DataFrame:
    """A new catalogue (key, published, views) with fields it lacks taken from the old; ranks by views and date, early ones marked."""
    named = old.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = new.join(named, key, "left").withColumns({f: F.coalesce(F.col(f), F.col(f"__{f}")) for f in fields}).drop(*[f"__{f}" for f in fields])
    first = top_ranked(joined.where("published IS NOT NULL"), [F.asc("published"), F.asc(key)], early, "rank_early").select(key, "rank_early")
    return joined.join(first, key, "left").withColumn("early", F.col("rank_early").isNotNull())


def chosen_profile(profiles: DataFrame, wanted: str) -> DataFrame:
    """The profile of an id, else the active one, else the built-in."""
    rank = F.when(F.col("profile_id") == wanted, 0).when(F.col("active"), 1).when(F.col("built_in"), 2)
    return top_ranked(profiles.withColumn("__rank", rank).where("__rank IS NOT NULL"), [F.asc("__rank"), F.asc("profile_id")], 1).drop("__rank", "rank")
