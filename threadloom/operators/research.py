"""Groups of evidence over a whole run, claims about them, and the review of claims. Numbers come from rows, never from texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.evidence import contains_any, group_label, has_paid_action, has_paid_failure, with_item_ids
from threadloom.operators.ordered import numbered

# --- Fixed values: words by which a claim is judged, and the groups of behaviour. ----------------------------------------

PAID_CLAIM = ("已付费", "实际付费", "付费购买", "付费但", "花钱", "成交", "充值", "报名购买")
FAILURE_CLAIM = ("无结果", "没结果", "无效果", "失败")
WILLING_CLAIM = ("付费意愿", "愿意付费", "愿意购买")
WILLING_EVIDENCE = ("我愿意付费", "愿意付费", "愿意购买", "多少钱", "怎么买")
PREVALENCE = ("大部分", "多数", "普遍", "广泛", "绝大多数")
CAUSAL = ("证明", "必然", "一定会", "导致", "造成", "提升付费", "提高付费", "市场空白")
MEDICAL = ("治愈", "确诊", "治疗有效", "康复成功", "医学证明")
ACTION_CLAIM = ("已经行动", "持续进行", "真实行为")
SELF_CLAIM = ("本人", "用户自己", "亲身")
RESULT_CLAIM = ("明显改善", "有效果", "获得结果")
POSITIVE = ("有效", "改善", "舒服", "缓解", "好转", "成功", "回正", "省钱", "不疼", "没以前")
NEGATIVE_CLAIM = ("无效", "没有改善", "负向结果")
NEGATIVE = ("没效果", "没有效果", "无效", "更疼", "加重", "没改善", "没有改善", "放弃", "做不到", "不会", "困难", "太难")
NOISE = ("哈哈", "支持", "沙发", "第一", "点赞", "路过", "签到")
PAID_SUBTYPES = ("sought_paid_help", "paid_but_no_result", "paid_but_not_used")
#: Group: subtypes of its items; a record belongs to the first group that has it.
BEHAVIOR_GROUPS = {
    "有计划但未执行": ("planned", "planned_but_not_started"),
    "付费但无结果": ("paid_but_no_result", "paid_but_not_used"),
    "收藏/观看但未行动": ("saved_but_not_started", "watched_but_not_practiced"),
}


def item_rows(cards: DataFrame) -> DataFrame:
    """One row an item: record_id, place, and the item's fields, ids assigned."""
    return cards.select("record_id", F.posexplode(with_item_ids(F.col("evidence_items"), F.col("record_id"))).alias("place", "x")).select("record_id", "place", "x.*", group_label(F.col("x")).alias("label"))


def research_clusters(cards: DataFrame, users: DataFrame, subtypes: Sequence[str]) -> DataFrame:
    """Items grouped by (label, type, subtype of a stated list): comments, users, speakers, certainty and the best references.

    users: record_id, user_key; a record of no known user counts as a user of its own. A group refers to one item of each of
    its best records (own experience, then certainty, then order): three from 15 comments on, two from 5, else one.
    """
    subtype = F.when(F.col("subtype").isin(*subtypes), F.col("subtype")).otherwise("") if subtypes else F.lit("")
    rows = item_rows(cards).withColumn("subtype", subtype)
    key = ["label", "type", "subtype"]
    rank = F.struct(
        F.when(F.col("speaker_scope") == "self", 0).otherwise(1).alias("a"), F.when(F.col("certainty") == "high", 0).when(F.col("certainty") == "medium", 1).otherwise(2).alias("b"), F.col("record_id").alias("c"), F.col("place").alias("d")
    )
    flags = {"own": ("speaker_scope", "self"), "general": ("speaker_scope", "general_observation"), "others": ("speaker_scope", "other_user"), "high_certainty": ("certainty", "high"), "medium_certainty": ("certainty", "medium")}
    # A record counts once a group, whatever it holds, so all but users are counts of these rows.
    best = rows.groupBy(*key, "record_id").agg(F.min(F.struct(rank.alias("rank"), "evidence_item_id")).alias("__best"), *[F.max(F.coalesce(F.col(c) == v, F.lit(False))).alias(n) for n, (c, v) in flags.items()])
    own = users.select("record_id", "user_key").groupBy("record_id").agg(F.collect_set("user_key").alias("__users"))  # of a record, one as a rule
    of_record = F.when(F.coalesce(F.size("__users"), F.lit(0)) > 0, F.col("__users")).otherwise(F.array(F.lit("")))
    by_user = best.join(own, "record_id", "left").select(*key, "record_id", *flags, F.posexplode(of_record).alias("__k", "__user"))
    first = F.col("__k") == 0
    counts = by_user.groupBy(*key).agg(
        F.count_if(first).alias("comments"),
        F.count_distinct(F.coalesce(F.nullif("__user", F.lit("")), "record_id")).alias("users"),
        *[F.count_if(first & F.col(n)).alias(n) for n in flags],
    )
    best = best.select(*key, F.col("__best.rank").alias("__rank"), F.col("__best.evidence_item_id").alias("item"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("__rank"))
    first = best.withColumn("__n", nth).where("__n <= 3").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "item"))), lambda x: x["item"]).alias("refs"))
    most = F.when(F.col("comments") >= 15, 3).when(F.col("comments") >= 5, 2).otherwise(1)
    return counts.join(first, key).withColumn("refs", F.slice("refs", F.lit(1), most))


def behavior_groups(cards: DataFrame) -> DataFrame:
    """(group, records): each record under the first group one of whose subtypes it has."""
    subs = F.transform("evidence_items", lambda x: F.coalesce(x["subtype"], F.lit("")))
    group = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, names in BEHAVIOR_GROUPS.items():
        group = group.when(F.arrays_overlap(subs, F.array(*[F.lit(n) for n in names])), name)
    return cards.select(group.alias("group"), "record_id").where("group IS NOT NULL").groupBy("group").agg(F.count_distinct("record_id").alias("records"))


def recounted(members: DataFrame, users: DataFrame, stated: DataFrame) -> DataFrame:
    """stated (theme_id, ...) with comments and users counted from members (theme_id, record_id), whatever was stated."""
    counts = members.join(users, "record_id", "left").groupBy("theme_id").agg(F.count_distinct("record_id").alias("comments"), F.count_distinct(F.coalesce("user_key", "record_id")).alias("users"))
    return stated.drop("comments", "users").join(counts, "theme_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("comments", "users")})


def claim_ledger(claims: Sequence[tuple[str, DataFrame]], items: DataFrame, most: int | None = 20) -> DataFrame:
    """Claims of several sections with what their references show.

    Each section: (name, rows of claim_id, text, record_count, refs) where refs is an array of item ids. Added: section,
    record_ids, evidence_quotes, evidence_types, evidence_subtypes, evidence_scopes (distinct, in order of the references).
    """
    union = reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(name).alias("section"), F.lit(k).alias("__section"), "claim_id", "text", "record_count", "refs") for k, (name, df) in enumerate(claims)])
    if most is not None:
        union = union.orderBy("__section", "claim_id").limit(most)
    refs = union.select("section", "claim_id", F.posexplode("refs").alias("at", "evidence_item_id"))
    known = refs.join(items.select("evidence_item_id", "record_id", "evidence_quote", "type", "subtype", "speaker_scope"), "evidence_item_id")
    taken = lambda c: F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce(c, F.lit("")).alias("v")))), lambda x: x["v"]), lambda v: v != ""))
    found = known.groupBy("section", "claim_id").agg(
        *[taken(c).alias(n) for c, n in (("record_id", "record_ids"), ("evidence_quote", "evidence_quotes"), ("type", "evidence_types"), ("subtype", "evidence_subtypes"), ("speaker_scope", "evidence_scopes"))]
    )
    empty = F.array().cast("array<string>")
    arrays = ("record_ids", "evidence_quotes", "evidence_types", "evidence_subtypes", "evidence_scopes")
    return union.drop("__section").join(found, ["section", "claim_id"], "left").withColumns({c: F.coalesce(c, empty) for c in arrays})


def hard_review(claims: DataFrame, total_comments: int, allowed: DataFrame) -> DataFrame:
    """``verdict`` and ``reasons`` of claims by rules alone; of several rules that apply the last decides, all are named.

    allowed: record_id of the records that may be referred to.
    """
    outside = (
        claims.select("section", "claim_id", F.explode("record_ids").alias("record_id")).join(allowed.select("record_id"), "record_id", "left_anti").select("section", "claim_id").distinct().withColumn("__outside", F.lit(True))
    )
    joined = claims.join(outside, ["section", "claim_id"], "left")
    text, evidence = F.coalesce("text", F.lit("")), F.array_join("evidence_quotes", " ")
    said = lambda words: contains_any(text, words)
    shown = lambda words: contains_any(evidence, words)
    kind, scope = (lambda c, v: F.array_contains(c, v)), F.array_contains("evidence_scopes", "self")
    only_planned = (F.size("evidence_subtypes") > 0) & (F.size(F.array_except("evidence_subtypes", F.array(F.lit("planned")))) == 0)
    paid = F.when(said(FAILURE_CLAIM), has_paid_failure(evidence)).otherwise(has_paid_action(evidence))
    rate = F.col("record_count") / F.lit(total_comments) if total_comments else F.lit(0.0)
    traced = (F.size("evidence_quotes") > 0) | ((F.col("section") == "open_theme") & (F.size("record_ids") > 0) & (F.col("record_count") >= 1))
    behavior = kind("evidence_types", "behavior")
    rules = [
        (~traced, "insufficient", "没有可追溯原文"),
        (F.coalesce("__outside", F.lit(False)), "contradicted", "引用跨出当前影片"),
        (said(PAID_CLAIM) & ~paid, "contradicted", "原文不支持实际付费或付费失败"),
        (said(WILLING_CLAIM) & ~shown(WILLING_EVIDENCE), "insufficient", "原文不支持付费意愿"),
        (said(PREVALENCE) & (rate <= 0.5), "contradicted", "覆盖率不足以支持多数或普遍表述"),
        (said(CAUSAL), "insufficient", "评论观察不能证明因果、市场或付费提升"),
        (said(MEDICAL), "insufficient", "评论自述不能支持医疗结论"),
        (said(ACTION_CLAIM) & ~behavior, "contradicted", "缺少行为类型证据"),
        (said(ACTION_CLAIM) & behavior & only_planned, "contradicted", "计划不能作为已经执行的证据"),
        (said(SELF_CLAIM) & ~scope, "contradicted", "他人或泛指经历不能归因给评论者本人"),
        (said(RESULT_CLAIM) & (~kind("evidence_types", "result") | ~shown(POSITIVE)), "contradicted", "缺少正向结果证据"),
        (said(NEGATIVE_CLAIM) & ~shown(NEGATIVE), "contradicted", "缺少负向结果证据"),
    ]
    verdict = F.when(F.lit(False), F.lit(None).cast("string"))
    for applies, name, _ in reversed(rules):
        verdict = verdict.when(applies, name)
    reasons = F.array_compact(F.array(*[F.when(applies, F.lit(reason)) for applies, _, reason in rules]))
    return joined.withColumn("verdict", verdict.otherwise("needs_review")).withColumn("reasons", reasons).drop("__outside")


def reviewed(claims: DataFrame, model: DataFrame, missing: str = "insufficient") -> DataFrame:
    """``verdict`` of hard-reviewed claims: the rules' own unless they need review, then the model's, then ``missing``."""
    joined = claims.join(model.select("claim_id", F.col("verdict").alias("__model")), "claim_id", "left")
    return joined.withColumn("verdict", F.when(F.col("verdict") != "needs_review", F.col("verdict")).otherwise(F.coalesce("__model", F.lit(missing)))).drop("__model")


def supported_only(section: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rows of a section (claim_id) whose verdict is supported; the others are not reported."""
    return section.join(reviews.where("verdict = 'supported'").select("claim_id"), "claim_id", "left_semi")


def downgraded(hypotheses: DataFrame, reviews: DataFrame) -> DataFrame:
    """Hypotheses (claim_id, conclusion) whose conclusion falls to insufficient where the verdict is not supported."""
    joined = hypotheses.join(reviews.select("claim_id", "verdict"), "claim_id", "left")
    return joined.withColumn("conclusion", F.when(F.col("verdict") == "supported", F.col("conclusion")).otherwise("insufficient")).drop("verdict")


def scoped_themes(themes: DataFrame, reviews: DataFrame, scope: DataFrame) -> DataFrame:
    """Open themes (claim_id, record_ids) with a supported review, and of their records those of one source (record_id)."""
    kept = supported_only(themes, reviews)
    member = kept.select("claim_id", F.explode(F.array_distinct("record_ids")).alias("record_id")).join(scope.select("record_id").distinct(), "record_id", "left_semi")
    return kept.drop("record_ids").join(member.groupBy("claim_id").agg(F.array_sort(F.collect_list("record_id")).alias("record_ids")), "claim_id")


def structural_review(themes: DataFrame, hypotheses: DataFrame, records: DataFrame) -> DataFrame:
    """Issues (kind, subject, n): references to unknown records, conclusions without support, or with too little of it.

    themes: subject, record_ids. hypotheses: subject, conclusion, supporting, weakening (arrays of record ids).
    """
    known = records.select("record_id").distinct()
    unknown = lambda df, c: df.select("subject", F.explode(F.array_distinct(c)).alias("record_id")).join(known, "record_id", "left_anti").groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    issue = lambda df, kind: df.select(F.lit(kind).alias("kind"), "subject", F.col("n").cast("long").alias("n"))
    supports = F.coalesce(F.size("supporting"), F.lit(0))
    concluded = hypotheses.where("conclusion = 'supported'").withColumn("n", supports)
    return reduce(
        DataFrame.unionByName,
        [
            issue(unknown(themes, "record_ids"), "unsupported_claim"),
            issue(unknown(hypotheses.select("subject", F.concat("supporting", "weakening").alias("ids")), "ids"), "unsupported_claim"),
            issue(concluded.where("n = 0"), "unsupported_claim"),
            issue(concluded.where((F.col("n") > 0) & (F.col("n") <= 2) & (F.coalesce(F.size("weakening"), F.lit(0)) == 0)), "missing_counter_evidence"),
        ],
    )


def reportable_themes(themes: DataFrame, noise: Sequence[str] = NOISE, least: int = 8) -> DataFrame:
    """Themes (theme_name, definition, comments) fit for a report: enough comments, a real name, no noise; largest first."""
    text = F.lower(F.concat_ws(" ", F.coalesce("theme_name", F.lit("")), F.coalesce("definition", F.lit(""))))
    return themes.where((F.length("theme_name") >= 3) & ~contains_any(text, noise) & (F.col("comments") >= least))


def paid_claims_shown(findings: DataFrame, items: DataFrame) -> DataFrame:
    """Findings (finding_id, text, refs), without those that speak of paying while no referenced item shows it."""
    pool = F.concat_ws(" ", F.coalesce("items.text", F.lit("")), F.coalesce("items.evidence_quote", F.lit("")))
    refs = findings.where(F.contains("text", F.lit("付费"))).select("finding_id", F.explode("refs").alias("evidence_item_id")).join(items.alias("items"), "evidence_item_id")
    shown = refs.where(F.col("items.subtype").isin(*PAID_SUBTYPES) | has_paid_action(pool)).select("finding_id").distinct().withColumn("__shown", F.lit(True))
    return findings.join(shown, "finding_id", "left").where(~F.contains("text", F.lit("付费")) | F.coalesce("__shown", F.lit(False))).drop("__shown")


def aliased(refs: DataFrame, seq: str) -> DataFrame:
    """(evidence_item_id, alias): short names E1, E2, ... by where an item is first referred to."""
    firsts = refs.groupBy("evidence_item_id").agg(F.min(seq).alias("__at"))
    return numbered(firsts, [], [F.asc("__at"), F.asc("evidence_item_id")], "__n").select("evidence_item_id", F.concat(F.lit("E"), F.col("__n").cast("string")).alias("alias"))


def known_ids(stated: DataFrame, records: DataFrame) -> DataFrame:
    """(claim_id, at, record_id): stated ids that exist; a number that is no id stands for the record of that position (from 0)."""
    direct = stated.join(records.select("record_id", "position"), stated["stated"] == records["record_id"], "left")
    named = records.select(F.col("record_id").alias("__by_place"), F.col("position").alias("__place"))
    placed = direct.drop("position").join(named, F.col("stated").try_cast("long") == F.col("__place"), "left")
    return placed.select("claim_id", "at", F.coalesce("record_id", "__by_place").alias("record_id")).where("record_id IS NOT NULL").groupBy("claim_id", "record_id").agg(F.min("at").alias("at"))
