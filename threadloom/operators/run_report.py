"""The statistics page and the lead list of a run, whole, from its analysed comments.

Input rows are flat: seq (their order), record_id, user_key (null or empty: nobody), username, user_id, platform, creator_type, creator_name,
video_title, source_file, homepage_url, comment_url, comment_text, contactability, and of the analysis primary_intent, signals,
evidence, relation, product_fit, problems, help_seeking, costs, gaps, impact, paid_help, hypotheses (hypothesis_id, relation).

All that is counted by label, and all that is counted once (users, videos, files ...), is one array of facts a row: the input
is expanded once, facts are added up before they are shuffled, and a value's many rows never meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.functions.columns import first_filled, lead_priority, lead_score, percent, strip
from threadloom.operators.listing import contact_reason
from threadloom.scratch import materialise

# Intents that count as valid, relations to one video, relations to a hypothesis, and ranks of enumerations.
INTENTS = ("gratitude_recognition", "check_in", "result_feedback", "question", "difficulty_help_request", "complaint", "other_valid")
VIDEO_RELATIONS = ("video_sufficient", "one_reply_sufficient", "personalized_judgment_needed", "realtime_observation_needed", "unclear")
HYPOTHESES = ("H1", "H2", "H3")
RELATIONS = ("supports", "weakens", "insufficient", "irrelevant")
FIT_ORDER = ("unclear", "low", "medium", "high")
EVIDENCE_ORDER = ("none", "planned", "tried", "continued")
CONTACT_ORDER = ("low", "medium", "high")
PAGE_INTENTS = {"check_in_count": "check_in", "result_feedback_count": "result_feedback", "question_count": "question", "difficulty_count": "difficulty_help_request"}


def ranked_max(value: Column, order: Sequence[str]) -> Column:
    """Aggregate: the greatest of values in a stated order; values outside it count as its first, as does none."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(o) for o in order]), value), F.lit(0))
    return F.element_at(F.array(*[F.lit(o) for o in order]), F.greatest(F.max(place), F.lit(1)).cast("int"))


def _score() -> Column:
    return lead_score(F.col("evidence"), F.col("problems"), F.col("help_seeking"), F.col("costs"), F.col("gaps"), F.col("impact"), F.col("paid_help"))


def _or(name: str, otherwise: str) -> Column:
    return first_filled(F.col(name), F.lit(otherwise))


def _text(name: str) -> Column:
    return strip(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _fact(kind: str, key: Column, value: Column | None = None, when: Column | None = None) -> Column:
    made = F.struct(F.lit(kind).alias("kind"), key.alias("key"), (F.lit(None).cast("string") if value is None else value.cast("string")).alias("value"))
    return made if when is None else F.when(when, made)


def page(df: DataFrame, *, total_records: int = 0, intents: Sequence[str] = INTENTS) -> DataFrame:
    """(section, key, n, pct, users) of the whole page.

    Sections: ``measure`` (some twenty counts), ``primary_intent`` (pct of the counted), ``signal`` (once a comment, pct of
    all), ``single_video`` and ``product_fit`` (pct of all), ``hypothesis`` (keys H1|supports and so on, with different
    users), ``hypothesis_by_creator`` (H1|creator|supports), ``contradiction`` (weakening counts; pct of the hypothesis).
    Fixed labels without comments have 0. Without rows all counts are 0.
    """
    user, intent, fit, relation, evidence = F.nullif(F.col("user_key"), F.lit("")), _or("primary_intent", ""), _or("product_fit", "unclear"), _or("relation", "unclear"), _or("evidence", "none")
    signals = F.array_distinct(F.coalesce("signals", F.array().cast("array<string>")))
    high = lead_priority(_score()) == "high"
    video = F.when(F.coalesce(F.col("video_title"), F.lit("")) != "", _text("video_title")).otherwise(_text("source_file"))
    once = lambda name, value, when=None: _fact("measure", F.lit(name), value, value.isNotNull() & (value != "") & (F.lit(True) if when is None else F.coalesce(when, F.lit(False))))
    said = F.filter(F.coalesce("hypotheses", F.array().cast("array<struct<hypothesis_id:string,relation:string>>")), lambda h: h["hypothesis_id"].isin(*HYPOTHESES) & h["relation"].isin(*RELATIONS))
    creator = _or("creator_type", "未知")
    facts = F.concat(
        F.array(
            once("unique_users", user), once("trained_users", user, evidence.isin("tried", "continued")), once("high_priority_user_count", user, high), once("source_video_count", video),
            once("source_creator_count", _text("creator_name")), once("source_file_count", _text("source_file")), _fact("primary_intent", intent), _fact("single_video", relation), _fact("product_fit", fit),
        ),
        F.transform(signals, lambda s: _fact("signal", s)),
        F.transform(said, lambda h: _fact("hypothesis", F.concat_ws("|", h["hypothesis_id"], h["relation"]), user)),
        F.transform(said, lambda h: _fact("hypothesis_by_creator", F.concat_ws("|", h["hypothesis_id"], creator, h["relation"]))),
    )
    counted = df.select(F.explode(F.array_compact(facts)).alias("f")).groupBy("f.kind", "f.key", "f.value").agg(F.count(F.lit(1)).alias("m"))
    labels = materialise(counted.groupBy("kind", "key").agg(F.sum("m").alias("m"), F.count("value").alias("different")), "page")  # a row a label
    has = lambda name: F.coalesce(F.array_contains(signals, name), F.lit(False))
    plain = {
        "total_analyzed": F.count(F.lit(1)), "valid_comments": F.count_if(intent.isin(*intents)), "gratitude_signal_count": F.count_if(has("gratitude")),
        **{name: F.count_if(intent == i) for name, i in PAGE_INTENTS.items()}, "personalized_needed_count": F.count_if(relation == "personalized_judgment_needed"),
        "realtime_needed_count": F.count_if(relation == "realtime_observation_needed"), "product_fit_high_count": F.count_if(fit == "high"), "high_priority_candidate_comment_count": F.count_if(high),
        "contactable_homepage_count": F.count_if(F.col("contactability") == "high"),
    }
    row = df.agg(*[c.alias(n) for n, c in plain.items()]).withColumns({"total_records": F.when(F.lit(total_records) > 0, F.lit(total_records)).otherwise(F.col("total_analyzed")), "product_fit_unassessed_count": F.col("total_analyzed")})
    row = materialise(row, "page-measures")  # one row
    spark = df.sparkSession
    wanted = [("measure", n) for n in ("unique_users", "trained_users", "high_priority_user_count", "source_video_count", "source_creator_count", "source_file_count")]
    wanted += [("single_video", v) for v in VIDEO_RELATIONS] + [("hypothesis", f"{h}|{r}") for h in HYPOTHESES for r in RELATIONS]
    rows = labels.join(spark.createDataFrame(wanted, "kind string, key string"), ["kind", "key"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = rows.crossJoin(F.broadcast(row.select(F.col("total_analyzed").alias("all"))))
    share = F.when(F.col("kind").isin("primary_intent", "signal", "single_video", "product_fit"), percent(zero("m"), F.col("all")))
    by_label = rows.select(
        F.col("kind").alias("section"), "key", F.when(F.col("kind") == "measure", zero("different")).otherwise(zero("m")).alias("n"), share.alias("pct"), F.when(F.col("kind") == "hypothesis", zero("different")).alias("users")
    )
    measures = row.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in row.columns]), F.array(*[F.col(c).cast("long") for c in row.columns]))).alias("key", "n"))
    parts = rows.where("kind = 'hypothesis'").select(F.substring_index("key", "|", 1).alias("h"), F.substring_index("key", "|", -1).alias("r"), zero("m").alias("m"))
    against = parts.groupBy("h").agg(F.sum(F.when(F.col("r") == "weakens", F.col("m")).otherwise(0)).alias("n"), F.sum("m").alias("whole")).where("n > 0")
    none = F.lit(None).cast("long")
    out = by_label.unionByName(measures.select(F.lit("measure").alias("section"), "key", "n", F.lit(None).cast("double").alias("pct"), none.alias("users")))
    return out.unionByName(against.select(F.lit("contradiction").alias("section"), F.col("h").alias("key"), "n", percent(F.col("n"), F.col("whole")).alias("pct"), none.alias("users")))


def leads(df: DataFrame, *, quotes: int = 5, links: int = 20) -> DataFrame:
    """One row a user (or a record without one): what all their comments together show.

    Single values are the first filled by ``seq``; score and reason are those of the best comment (of equals the first).
    problems and relations are sorted; quotes and comment_urls are the first different ones, n_comment_urls and n_records
    count all; ``lead_comments`` lists every comment. Rows without a record id are left out.
    """
    own = df.where(F.coalesce("record_id", F.lit("")) != "").withColumn("user_key", F.coalesce(F.nullif(F.col("user_key"), F.lit("")), F.concat(F.lit("record:"), "record_id"))).withColumn("score", _score())
    first = lambda c: F.coalesce(F.min_by(c, F.when(c != "", F.col("seq"))), F.lit(""))
    begun = lambda n: F.coalesce(F.min_by(n, "seq"), F.lit(""))
    shown = F.struct("evidence", "help_seeking", "problems", "score")
    facts = F.concat(
        F.transform(F.coalesce("problems", F.array().cast("array<string>")), lambda p: F.when(p != "", F.struct(F.lit("problem").alias("kind"), p.alias("value")))),
        F.array(*[F.when(c != "", F.struct(F.lit(k).alias("kind"), c.alias("value"))) for k, c in {"relation": F.col("relation"), "url": F.col("comment_url"), "record": F.col("record_id"), "quote": strip(F.substring("comment_text", 1, 80))}.items()]),
    )
    once = own.select("user_key", "seq", F.explode(F.array_compact(facts)).alias("f")).groupBy("user_key", "f.kind", "f.value").agg(F.min("seq").alias("at"))
    once = materialise(once, "leads")
    counts = once.groupBy("user_key").agg(F.count_if(F.col("kind") == "url").alias("n_comment_urls"), F.count_if(F.col("kind") == "record").alias("n_records"))
    order = Window.partitionBy("user_key", "kind").orderBy("at", "value")
    few = once.where("kind IN ('url', 'quote')").withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.when(F.col("kind") == "url", links).otherwise(quotes))
    listed = few.groupBy("user_key").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("k", "value")))), lambda x: x["value"]).alias(n) for k, n in {"url": "comment_urls", "quote": "quotes"}.items()])
    sets = once.where("kind IN ('problem', 'relation')").groupBy("user_key").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("value")))).alias(n) for k, n in {"problem": "problems", "relation": "relations"}.items()])
    rows = own.groupBy("user_key").agg(
        first(first_filled(F.col("username"), F.col("user_id"))).alias("username"), begun("platform").alias("platform"), begun("creator_type").alias("creator_type"), first(F.col("homepage_url")).alias("homepage_url"),
        F.max("score").alias("candidate_score"), ranked_max(F.col("product_fit"), FIT_ORDER).alias("product_fit"), ranked_max(F.col("evidence"), EVIDENCE_ORDER).alias("evidence"), ranked_max(F.col("contactability"), CONTACT_ORDER).alias("contactability"),
        F.bool_or(F.coalesce("help_seeking", F.lit(False))).alias("help_seeking"), F.max_by(shown, F.struct("score", (-F.col("seq")).alias("s"))).alias("b"),
    )
    empty = F.array().cast("array<string>")
    joined = rows.join(counts, "user_key").join(listed, "user_key", "left").join(sets, "user_key", "left")
    reason = contact_reason(F.col("b.evidence"), F.col("b.help_seeking"), F.col("b.problems"), F.col("candidate_score"), empty)
    return joined.select(
        "user_key", "username", "platform", "creator_type", "homepage_url", "candidate_score", lead_priority(F.col("candidate_score")).alias("priority"), "contactability", "product_fit", "evidence", "help_seeking",
        *[F.coalesce(c, empty).alias(c) for c in ("problems", "relations", "comment_urls", "quotes")], "n_comment_urls", "n_records", reason.alias("contact_reason"),
    )


def lead_comments(df: DataFrame) -> DataFrame:
    """Every comment of every lead: (user_key, seq, record_id, comment_text, video_title, creator_name, comment_url)."""
    own = df.where(F.coalesce("record_id", F.lit("")) != "")
    key = F.coalesce(F.nullif(F.col("user_key"), F.lit("")), F.concat(F.lit("record:"), "record_id"))
    return own.select(key.alias("user_key"), "seq", "record_id", "comment_text", "video_title", "creator_name", "comment_url")
