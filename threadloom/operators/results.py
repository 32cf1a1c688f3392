"""Results, candidates and evidence cards of a run: filters, orders, merges, counts and progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.functions.evidence import card_projection, is_participating_status, record_status


def keyword_in(keyword: str, *texts: Column) -> Column:
    """Whether the keyword stands in the texts joined by spaces, whatever its case; the empty one always does."""
    if not keyword:
        return F.lit(True)
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    return F.contains(joined, F.lit(keyword.lower()))


def matching_results(
    results: DataFrame,
    *,
    keyword: str = "",
    primary_intent: str = "",
    valid_intents: Sequence[str] = (),
    signal: str = "",
    single_video_relation: str = "",
    product_fit: str = "",
    hypothesis_id: str = "",
    hypothesis_relation: str = "",
    has_new_signal: bool | None = None,
    record_ids: DataFrame | None = None,
) -> DataFrame:
    """Rows that meet all given conditions; those not given hold for every row.

    Columns: record_id, comment_text, username, video_title, primary_intent, signals, single_video_relation, product_fit,
    hypothesis_relations (array of struct(hypothesis_id, relation)), new_signals.
    """
    holds = [keyword_in(keyword, F.col("comment_text"), F.col("username"), F.col("video_title"))]
    for name, value in (("primary_intent", primary_intent), ("single_video_relation", single_video_relation), ("product_fit", product_fit)):
        if value:
            holds.append(F.coalesce(F.col(name), F.lit("")) == value)
    if valid_intents:
        holds.append(F.coalesce(F.col("primary_intent").isin(*valid_intents), F.lit(False)))
    if signal:
        holds.append(F.coalesce(F.array_contains("signals", signal), F.lit(False)))
    if hypothesis_id:
        same = lambda h: (h["hypothesis_id"] == hypothesis_id) & ((h["relation"] == hypothesis_relation) if hypothesis_relation else F.lit(True))
        holds.append(F.coalesce(F.exists("hypothesis_relations", same), F.lit(False)))
    if has_new_signal is not None:
        holds.append((F.coalesce(F.size("new_signals"), F.lit(0)) > 0) == has_new_signal)
    kept = results
    for condition in holds:
        kept = kept.where(condition)
    return kept if record_ids is None else kept.join(record_ids.select("record_id"), "record_id", "left_semi")


def matching_candidates(candidates: DataFrame, *, research_matched: str = "", **equal: str) -> DataFrame:
    """Candidates whose named columns have the given values; research_matched yes or no asks for matches in research_target_matches."""
    kept = candidates
    for name, value in equal.items():
        if value:
            kept = kept.where(F.col(name) == value)
    if research_matched in ("yes", "no"):
        kept = kept.where((F.coalesce(F.size("research_target_matches"), F.lit(0)) > 0) == (research_matched == "yes"))
    return kept


def matching_cards(cards: DataFrame, *, status: str = "", expression: str = "", item_type: str = "", keyword: str = "") -> DataFrame:
    """Cards by status, expression, the type of any item, and a keyword in comment, user name or record id."""
    kept = cards.where(keyword_in(keyword, F.col("comment_text"), F.col("username"), F.col("record_id")))
    if status:
        kept = kept.where(record_status(F.col("record_status")) == status)
    if expression:
        kept = kept.where(F.col("primary_expression") == expression)
    if item_type:
        kept = kept.where(F.coalesce(F.exists("evidence_items", lambda x: x["type"] == item_type), F.lit(False)))
    return kept


#: Orders of lists, all ended by a unique column.
ORDERS = {
    "candidates": [F.desc, "relevance", F.desc, "score", F.desc, "comments", F.asc, "user_key"],
    "themes": [F.desc, "n", F.asc, "theme_name", F.asc, "theme_id"],
    "clusters": [F.desc, "comments", F.asc, "label", F.asc, "type", F.asc, "subtype"],
    "signals": [F.desc, "frequency", F.asc, "signal_key"],
    "rows": [F.desc, "score", F.asc, "record_id"],
    "manual": [F.desc, "worth", F.desc, "likes", F.asc, "id"],
    "batches": [F.desc, "date", F.asc, "source"],
}


def order_of(kind: str) -> list[Column]:
    steps = ORDERS[kind]
    return [by(name) for by, name in zip(steps[::2], steps[1::2], strict=True)]


def with_projection(results: DataFrame, cards: DataFrame, projected: Sequence[str]) -> DataFrame:
    """Results with their card's projection: a projected value wins, rows without a card stay as they are.

    Rows of an older policy without a card lose what that policy could not support.
    """
    made = cards.select("record_id", card_projection(F.col("evidence_items"), F.col("primary_expression"), F.col("record_status")).alias("__p"))
    joined = results.join(made, "record_id", "left")
    old = F.col("__p").isNull() & (F.coalesce(F.col("projection_policy_version"), F.lit(0)) != 2) if "projection_policy_version" in results.columns else F.lit(False)
    retired = {"product_fit": "unclear", "single_video_relation": "unclear"}
    kept = []
    for c in results.columns:
        own = F.coalesce(F.col(f"__p.{c}"), F.col(c)) if c in projected else F.col(c)
        kept.append((F.when(old, F.lit(retired[c])).otherwise(own) if c in retired else own).alias(c))
    return joined.select(*kept, *[F.col(f"__p.{c}").alias(c) for c in projected if c not in results.columns])


def done_ids(*tables: DataFrame) -> DataFrame:
    """Distinct record ids of results or cards."""
    out = tables[0].select("record_id")
    for t in tables[1:]:
        out = out.union(t.select("record_id"))
    return out.where(F.coalesce("record_id", F.lit("")) != "").distinct()


def progress(records: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """total, completed, failed (not done since), skipped: one row."""
    finished = done.select("record_id").distinct()
    own = records.select("record_id").distinct().join(finished.withColumn("done", F.lit(1)), "record_id", "left")
    still = failed.select("record_id").distinct().join(finished, "record_id", "left_anti").agg(F.count(F.lit(1)).alias("failed"))
    counts = own.agg(F.count(F.lit(1)).alias("total"), F.count("done").alias("completed")).crossJoin(still)
    return counts.withColumn("skipped", F.greatest(F.lit(0), F.col("total") - F.col("completed") - F.col("failed")))


def dataset_summary(records: DataFrame, cards: DataFrame, levels: Column, themed: DataFrame) -> DataFrame:
    """One row of counts over all records: by status and level, by item type, distinct users, files, videos; theme coverage.

    records: record_id, user_key, source_file, video, creator. cards: record_id, record_status, evidence_items; ``levels``
    gives a card's level. A record without a card counts as usable and weak.
    """
    has = lambda kind: F.coalesce(F.exists("evidence_items", lambda x: x["type"] == kind), F.lit(False))
    marked = cards.select("record_id", record_status(F.col("record_status")).alias("status"), levels.alias("level"), *[has(k).alias(f"__{k}") for k in ("problem", "behavior", "action_gap")])
    joined = records.join(marked.withColumn("__card", F.lit(True)), "record_id", "left").join(themed.select("record_id").distinct().withColumn("__themed", F.lit(True)), "record_id", "left")
    status, level = F.coalesce("status", F.lit("usable")), F.coalesce("level", F.lit("weak"))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    covered = F.col("__themed") & F.col("__card") & is_participating_status(F.col("status"))
    counts = joined.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(status == s).alias(s) for s in ("usable", "unclear", "off_topic", "machine_generated", "spam", "garbled")],
        *[F.count_if(level == v).alias(f"level_{v}") for v in ("strong", "medium", "weak", "none")],
        *[F.count_if(F.col(f"__{k}")).alias(f"{k}_comments") for k in ("problem", "behavior", "action_gap")],
        *[F.count_distinct(filled(c)).alias(n) for c, n in (("user_key", "users"), ("source_file", "files"), ("video", "videos"), ("creator", "creators"))],
        F.count_if(covered).alias("theme_covered"),
        F.count_if(F.col("__themed") & (F.col("status") == "usable")).alias("__themed_usable"),
    )
    participating = F.col("usable") + F.col("unclear")
    rate = F.when(participating > 0, F.floor(F.col("theme_covered") * 10000.0 / participating + 0.5) / 10000).otherwise(0.0)
    return counts.withColumns({"participating": participating, "theme_coverage_rate": rate, "unthemed_usable": F.greatest(F.lit(0), F.col("usable") - F.col("__themed_usable"))}).drop("__themed_usable")


def error_reasons(failures: DataFrame, message: Column) -> DataFrame:
    """Normalised messages with counts: validation errors by field and kind, others by their first line."""
    text = F.trim(F.coalesce(message, F.lit("")))
    field, kind = (F.regexp_extract(text, r"(?s)validation error for \w+\s+(\w+)\s+.*?\[type=(\w+)", k) for k in (1, 2))
    stopped = F.startswith(text, F.lit("用户已停止")) | F.startswith(text, F.lit("已达到预算上限"))
    reason = F.when(text == "", "未知错误").when(stopped, text).when(field != "", F.concat_ws(":", field, kind)).otherwise(F.substring(F.substring_index(text, "\n", 1), 1, 120))
    return failures.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def extrapolated(trial: DataFrame, total_records: int, *, safety: float = 1.2, enough: float = 0.72) -> DataFrame:
    """From trial rows (prompt_tokens, completion_tokens, seconds, confidence): averages, totals for all records, caution."""
    averages = trial.agg(
        F.count(F.lit(1)).alias("trial"),
        *[F.avg(c).alias(f"avg_{c}") for c in ("prompt_tokens", "completion_tokens", "seconds")],
        F.avg((F.col("confidence") < enough).cast("double")).alias("low_confidence"),
    )
    return averages.withColumns({f"total_{c}": F.ceil(F.col(f"avg_{c}") * total_records * safety) for c in ("prompt_tokens", "completion_tokens", "seconds")})
