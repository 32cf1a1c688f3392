"""Evidence cards: what a comment shows, as an array of items, and everything that is derived from it.

An item is struct(type, text, evidence_quote, speaker_scope, certainty, subtype, evidence_item_id). All functions take and
return Columns: a card's items never leave their row, so nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.functions.columns import let, strip

ITEM = "struct<type:string,text:string,evidence_quote:string,speaker_scope:string,certainty:string,subtype:string,evidence_item_id:string>"

# --- Fixed values: codes and vocabularies whose spelling results depend on. --------------------------------------------

RECORD_STATUS = {
    "usable": "usable", "off_topic": "off_topic", "machine_generated": "machine_generated", "spam": "spam", "garbled": "garbled", "unclear": "unclear",
    "spam_or_garbled": "spam", "valid": "usable", "meaningful_evidence": "usable", "low_information_but_valid": "usable", "invalid": "spam",
}
EVIDENCE_LEVEL = {
    "strong": "strong", "medium": "medium", "weak": "weak", "none": "none", "meaningful_evidence": "strong", "low_information_but_valid": "weak", "valid": "medium",
}
VALIDITY = {
    "valid": "meaningful_evidence", "meaningful_evidence": "meaningful_evidence", "low_information_but_valid": "low_information_but_valid", "invalid": "spam_or_garbled",
    "spam_or_garbled": "spam_or_garbled", "spam": "spam_or_garbled", "garbled": "spam_or_garbled", "machine_generated": "spam_or_garbled", "unclear": "unclear",
    "usable": "low_information_but_valid", "off_topic": "spam_or_garbled",
}
SPEAKER_SCOPE = {
    "self": "self", "other_user": "other_user", "general_observation": "general_observation", "general_people": "general_observation",
    "creator_or_content": "creator_or_content", "unclear": "unclear",
}
CERTAINTY = {"high": "high", "medium": "medium", "low": "low", "explicit": "high", "implied": "medium", "uncertain": "low"}
INTENT_OF_EXPRESSION = {
    "question": "question", "help_request": "difficulty_help_request", "complaint": "complaint", "result_feedback": "result_feedback", "check_in": "check_in",
    "praise": "gratitude_recognition",
}
STRONG_BEHAVIOR = ("attempted", "completed_once", "continued", "progress", "stopped", "changed_plan", "sought_paid_help")
MEDIUM_TYPES = ("problem", "solution", "barrier", "behavior", "action_gap", "result")
CONTINUED = ("continued", "sustained_practice", "persistence", "completed_repeated", "completed_repeatedly", "ongoing_period")
TRIED = ("attempted", "completed_once", "sought_paid_help", "progress", "completed", "attempted_self_correction", "self_reported_ability")
SKIPPED_GAPS = ("saved_but_not_started", "watched_but_not_practiced", "planned_but_not_started")
PAID_GAPS = ("paid_but_no_result", "paid_but_not_used")
NEW_SIGNAL_OF_TYPE = {"problem": "new_problem", "barrier": "new_barrier", "action_gap": "new_barrier", "context": "new_user_segment", "solution": "new_current_solution"}
PAID_ACTION = ("我报了", "我报名", "我买了", "我购买", "我付了", "我花了", "我充值", "我充了值", "我订阅", "我请了", "我找了专业人士", "我做了付费")
PAID_ACTION_PATTERN = r"我.{0,10}(报了|报名|买了|购买|付了|花了|充值|订阅|请了|找了.{0,5}(专业人士|顾问|医生))"
PAID_FAILURE = ("没效果", "没有效果", "无效果", "没用", "没有用", "没改善", "没有改善", "没结果", "没有结果", "白花", "浪费钱", "没有一点改变")
COST_SAVING = ("省钱", "省了钱", "不用花", "没花钱", "避免花")
REALTIME_REQUEST = ("帮我看下操作", "看看我的操作", "看我的视频", "看一下我的动作", "帮我检查动作")
PERSONAL_REQUEST = ("根据我的情况", "适合我的", "结合我的情况", "我的具体情况")
#: Subtype of a behaviour: signal.
BEHAVIOR_SIGNALS = {
    "planned": "saved_or_plan_to_try", "attempted": "started_using", "completed_once": "started_using", "continued": "continued_using", "ongoing_period": "continued_using",
    "stopped": "stopped_using", "changed_plan": "changed_plan", "sought_paid_help": "paid_professional_help",
}
GAP_SIGNALS = {"saved_but_not_started": "skipped_step", "watched_but_not_practiced": "skipped_step", "started_but_stopped": "stopped_using", "planned_but_not_started": "skipped_step"}
ENGAGEMENT_SIGNALS = {"saved": "saved_or_plan_to_try", "bookmarked": "saved_or_plan_to_try", "searched": "searched_other_content", "searched_other": "searched_other_content"}
#: Results: the first signal one of whose words stands in the item; any other words are a positive result.
RESULT_SIGNALS = (
    ("negative_result", ("无效", "没变化", "没用", "更疼", "更痛", "没改善")),
    ("expected_effect_missing", ("没感觉", "无感", "感受不到", "没效果")),
)
PROBLEM_SIGNALS = (
    ("howto_uncertainty", ("标准", "对不对", "是不是我", "姿势", "做得不", "方法不")),
    ("applicability_question", ("怎么", "为什么", "正常吗", "区别", "是否")),
    ("cannot_complete", ("做不了", "太难", "做不到", "学不会")),
    ("expected_effect_missing", ("没感觉", "感受不到", "没效果")),
    ("physical_discomfort", ("疼", "痛", "伤", "不适")),
    ("needs_alternative", ("替代", "换成", "没有器械", "没工具", "没有条件")),
    ("needs_advanced", ("进阶", "加大", "提高难度")),
    ("needs_simpler", ("退阶", "简化", "降低难度")),
    ("needs_plan", ("计划", "安排", "怎么练", "怎么做", "从哪开始")),
)
BARRIER_SIGNALS = (
    ("physical_discomfort", ("疼", "痛", "伤")),
    ("cannot_complete", ("太难", "做不到", "做不了")),
    ("resource_constraint", ("空间", "器械", "设备", "工具", "条件")),
    ("privacy_concern", ("隐私", "尴尬")),
)
CARD_SIGNALS = (
    ("asks_creator_reply", ("回复", "看看我", "帮我看看", "博主回", "作者回")),
    ("recorded_self_for_review", ("录像", "拍视频", "录自己", "拍下来")),
    ("motivation_or_accountability", ("坚持", "签到", "动力", "懒", "自律")),
    ("instruction_unclear", ("看不懂", "讲不清楚", "太快", "数错")),
    ("pace_problem", ("太快", "跟不上", "节奏", "数")),
    ("special_condition", ("旧伤", "受伤", "手术", "慢性病", "过敏")),
)
HOWTO_QUESTION = ("标准", "对不对", "是不是")
#: Semantic label of an item for research groups: the first whose words stand in it.
GROUP_WORDS = (
    ("方向/判断困难", ("方向", "判断", "怎么测", "怎么看", "分不清")),
    ("执行方式不确定", ("标准", "做得不", "感觉不到", "找不到感觉", "方法不")),
    ("特殊身体状况与适用性", ("受伤", "损伤", "术后", "身体", "适合我", "可不可以")),
    ("安排与下一步疑问", ("怎么", "下一步", "多久", "几次", "先做", "降级")),
    ("短期正向结果", ("立竿见影", "改善", "好转", "有效果", "变好")),
    ("无效或负向结果", ("没效果", "无效", "没有改善", "更严重", "加重")),
)

# --- helpers ----------------------------------------------------------------------------------------------------------


def code(c: Column, codes: Mapping[str, str], otherwise: str) -> Column:
    """A value by its code, stripped; the default for unknown and missing ones."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, strip(F.coalesce(c, F.lit("")))), F.lit(otherwise))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether one of the words stands in the text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words], F.lit(False))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _has(items: Column, test) -> Column:
    return F.coalesce(F.exists(items, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


# --- codes ------------------------------------------------------------------------------------------------------------


def record_status(c: Column) -> Column:
    return code(c, RECORD_STATUS, "unclear")


def evidence_level(c: Column) -> Column:
    return code(c, EVIDENCE_LEVEL, "none")


def is_meaningful_level(c: Column) -> Column:
    return evidence_level(c).isin("strong", "medium")


def is_participating_status(c: Column) -> Column:
    return record_status(c).isin("usable", "unclear")


def is_excluded_status(c: Column) -> Column:
    return ~is_participating_status(c)


def is_participating_validity(c: Column) -> Column:
    """Record statuses as themselves, everything else as a validity."""
    raw = _text(c)
    own = raw.isin("usable", "off_topic", "machine_generated", "spam", "garbled", "unclear", "spam_or_garbled")
    return F.when(own, is_participating_status(raw)).otherwise(code(c, VALIDITY, "unclear") != "spam_or_garbled")


# --- a card -----------------------------------------------------------------------------------------------------------


def has_paid_action(text: Column) -> Column:
    return contains_any(text, PAID_ACTION) | F.regexp_like(_text(text), F.lit(PAID_ACTION_PATTERN))


def has_paid_failure(text: Column) -> Column:
    return has_paid_action(text) & contains_any(text, PAID_FAILURE)


def is_cost_saving(text: Column) -> Column:
    return contains_any(text, COST_SAVING)


def level_of_items(items: Column, status: Column) -> Column:
    """strong, medium or weak by what the items are; of no items weak if the record is usable, else none."""

    def strong(x: Column) -> Column:
        own = x["speaker_scope"] == "self"
        acted = x["subtype"].isin(*STRONG_BEHAVIOR)
        return (
            ((x["type"] == "quantitative") & (x["certainty"] != "low"))
            | ((x["type"] == "behavior") & (acted | (own & (x["certainty"] == "high"))))
            | ((x["type"] == "action_gap") & (x["certainty"] == "high"))
            | ((x["type"] == "result") & own)
        )

    none = F.when(record_status(status) == "usable", "weak").otherwise("none")
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, none).when(_has(items, strong), "strong").when(_has(items, lambda x: x["type"].isin(*MEDIUM_TYPES)), "medium").otherwise("weak")


def validity_of(status: Column, level: Column) -> Column:
    """The older field that mirrors status and level."""
    s = record_status(status)
    return (
        F.when(s.isin("spam", "garbled", "machine_generated", "off_topic"), "spam_or_garbled")
        .when(s == "unclear", "unclear")
        .when(level.isin("strong", "medium"), "meaningful_evidence")
        .otherwise("low_information_but_valid")
    )


def with_item_ids(items: Column, record: Column) -> Column:
    """Items named {record}::e{place}, but for those already named for this record."""
    rid = F.coalesce(F.nullif(strip(_text(record)), F.lit("")), F.lit("unknown"))

    def named(own: Column) -> Column:
        kept = lambda x: F.startswith(strip(_text(x["evidence_item_id"])), F.concat(own, F.lit("::")))
        return F.transform(items, lambda x, i: x.withField("evidence_item_id", F.when(kept(x), x["evidence_item_id"]).otherwise(F.concat(own, F.lit("::e"), i.cast("string")))))

    return let(rid, named)


def items_of(items: Column, *types: str) -> Column:
    """The items of some types: the older arrays are these, one by one."""
    return F.filter(items, lambda x: x["type"].isin(*types))


def item_texts(items: Column, *types: str) -> Column:
    return F.filter(F.transform(items_of(items, *types), lambda x: _text(x["text"])), lambda t: t != "")


def legacy_items(arrays: Mapping[str, Column]) -> Column:
    """From older arrays of struct(text, evidence_quote, subtype), by item type, one array of items in that order."""
    none = F.array().cast("array<struct<text:string,evidence_quote:string,subtype:string>>")

    def made(kind: str):
        fields = ("speaker_scope", "unclear"), ("certainty", "medium")
        return lambda x: F.struct(
            F.lit(kind).alias("type"), _text(x["text"]).alias("text"), _text(x["evidence_quote"]).alias("evidence_quote"), *[F.lit(v).alias(n) for n, v in fields],
            _text(x["subtype"]).alias("subtype"), F.lit("").alias("evidence_item_id"),
        ).cast(ITEM)

    return F.concat(*[F.transform(F.coalesce(c, none), made(kind)) for kind, c in arrays.items()])


def behavior_evidence(items: Column) -> Column:
    """continued, tried, planned or none: the most that the behaviours show."""
    acts = F.transform(items_of(items, "behavior"), lambda x: x["subtype"])
    some = lambda names: F.arrays_overlap(acts, F.array(*[F.lit(n) for n in names]))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(some(CONTINUED)), "continued").when(yes(some(TRIED)), "tried").when(yes(some(("planned",))), "planned").otherwise("none")


def video_relation(items: Column, status: Column) -> Column:
    """What kind of answer the quotes ask for; unclear unless they say so, and for records that are not usable."""
    pool = F.array_join(F.transform(items, lambda x: _text(x["evidence_quote"])), "\n")
    asked = F.when(contains_any(pool, REALTIME_REQUEST), "realtime_observation_needed").when(contains_any(pool, PERSONAL_REQUEST), "personalized_judgment_needed")
    return F.when(record_status(status) == "usable", asked.otherwise("unclear")).otherwise("unclear")


def paid_help(items: Column) -> Column:
    return _has(items, lambda x: (x["type"] == "behavior") & (x["subtype"] == "sought_paid_help"))


def impact(items: Column) -> Column:
    """paid_help, stopped, skipped or none, by the action gaps."""
    gap = lambda *names: _has(items, lambda x: (x["type"] == "action_gap") & x["subtype"].isin(*names))
    return F.when(paid_help(items) | gap(*PAID_GAPS), "paid_help").when(gap("started_but_stopped"), "stopped").when(gap(*SKIPPED_GAPS), "skipped").otherwise("none")


def card_signals(items: Column, expression: Column) -> Column:
    """Sorted signals of a card: keyword rules by item type, and over all its texts together."""
    texts = F.array_join(F.flatten(F.transform(items, lambda x: F.array(strip(_text(x["evidence_quote"])), strip(_text(x["text"]))))), "\n")
    of = lambda x: F.concat(_text(x["text"]), _text(x["evidence_quote"]))
    by_subtype = lambda kind, codes: F.transform(items_of(items, kind), lambda x: F.try_element_at(F.create_map(*[F.lit(v) for p in codes.items() for v in p]), _text(x["subtype"])))
    said = lambda kind: F.transform(items_of(items, kind), of)

    def by_words(kind: str, rules) -> Column:
        return F.array_compact(F.flatten(F.transform(said(kind), lambda t: F.array(*[F.when(contains_any(t, words), F.lit(name)) for name, words in rules]))))

    def of_result(t: Column) -> Column:
        found = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, words in RESULT_SIGNALS:
            found = found.when(contains_any(t, words), name)
        return found.when(strip(t) != "", "positive_result")

    def of_card(pool: Column, problems: Column) -> Column:
        asked = F.arrays_overlap(problems, F.array(*[F.lit(name) for name, _ in PROBLEM_SIGNALS[:2]]))
        question = F.when((expression == "question") & ~asked, F.when(contains_any(pool, HOWTO_QUESTION), "howto_uncertainty").otherwise("applicability_question"))
        return F.concat(problems, F.array(question, *[F.when(contains_any(pool, words), F.lit(name)) for name, words in CARD_SIGNALS]))

    found = F.concat(
        by_subtype("behavior", BEHAVIOR_SIGNALS),
        by_subtype("engagement", ENGAGEMENT_SIGNALS),
        by_subtype("action_gap", GAP_SIGNALS),
        F.transform(said("result"), of_result),
        by_words("barrier", BARRIER_SIGNALS),
        F.array(F.when(expression == "praise", F.lit("gratitude"))),
        let(texts, lambda pool: let(by_words("problem", PROBLEM_SIGNALS), lambda problems: of_card(pool, problems))),
    )
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def new_signals(items: Column, most: int = 5) -> Column:
    """struct(type, text, evidence_quote) of the first items of types that hint at something new, each text once."""
    wanted = F.filter(
        F.transform(
            F.filter(items, lambda x: x["type"].isin(*NEW_SIGNAL_OF_TYPE) & ~((x["type"] == "context") & (x["certainty"] == "low"))),
            lambda x: F.struct(code(x["type"], NEW_SIGNAL_OF_TYPE, "other").alias("type"), strip(_text(x["text"])).alias("text"), strip(_text(x["evidence_quote"])).alias("quote")),
        ),
        lambda x: (x["text"] != "") | (x["quote"] != ""),
    )
    key = lambda x: F.lower(F.regexp_replace(F.when(x["text"] != "", x["text"]).otherwise(x["quote"]), r"(?U)\s+", " "))
    once = lambda own: let(F.transform(own, key), lambda keys: F.filter(own, lambda x, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1))
    return F.slice(
        F.transform(
            let(wanted, once),
            lambda x: F.struct(
                x["type"].alias("type"),
                F.when(x["text"] != "", x["text"]).otherwise(F.substring(x["quote"], 1, 40)).alias("text"),
                F.when(x["quote"] != "", x["quote"]).otherwise(F.substring(x["text"], 1, 80)).alias("evidence_quote"),
            ),
        ),
        1,
        most,
    )


def card_projection(items: Column, expression: Column, status: Column) -> Column:
    """The analysis that a card stands for: intent, signals, problems, impact, quotes."""
    problems = item_texts(items, "problem")
    quotes = F.filter(F.transform(items, lambda x: _text(x["evidence_quote"])), lambda q: q != "")
    return F.struct(
        code(expression, INTENT_OF_EXPRESSION, "other_valid").alias("primary_intent"),
        card_signals(items, expression).alias("signals"),
        problems.alias("specific_problems"),
        behavior_evidence(items).alias("actual_training_evidence"),
        ((expression == "help_request") | (F.size(problems) > 0)).alias("help_seeking"),
        item_texts(items, "action_gap").alias("behavior_costs"),
        impact(items).alias("training_impact"),
        video_relation(items, status).alias("single_video_relation"),
        F.lit("unclear").alias("product_fit"),
        F.lit("not_assessed").alias("product_fit_source"),
        F.lit(2).alias("projection_policy_version"),
        F.slice(quotes, 1, 5).alias("evidence_quotes"),
        paid_help(items).alias("paid_help"),
        F.transform(items_of(items, "context"), lambda x: _text(x["text"])).alias("explicit_user_context"),
    )


def research_summary(items: Column, record: Column, length: int = 24) -> Column:
    """Items with ids and short texts, without quotes."""
    return F.transform(
        with_item_ids(items, record),
        lambda x: F.struct(x["evidence_item_id"].alias("evidence_item_id"), x["type"].alias("type"), x["subtype"].alias("subtype"), F.substring(_text(x["text"]), 1, length).alias("text"), x["speaker_scope"].alias("speaker_scope"), x["certainty"].alias("certainty")),
    )


def group_label(x: Column) -> Column:
    """Semantic label of an item by its words; without any, its subtype, else its type."""
    text = F.concat_ws(" ", _text(x["text"]), _text(x["evidence_quote"]))
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, words in GROUP_WORDS:
        found = found.when(contains_any(text, words), label)
    return found.otherwise(F.coalesce(F.nullif(_text(x["subtype"]), F.lit("")), F.nullif(_text(x["type"]), F.lit("")), F.lit("其他证据")))


def limited_items(items: Column, priority: Sequence[str]) -> Column:
    """Items in order of their type's priority, each quote once: two of them, or four where they show something complex."""
    rank = lambda x: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]), _text(x["type"])), F.lit(0)), F.lit(99))
    placed = F.transform(items, lambda x, i: F.struct(rank(x).cast("int").alias("rank"), i.alias("i"), x.alias("item")))
    ordered = F.filter(F.array_sort(placed), lambda p: _text(p["item"]["evidence_quote"]) != "")

    def once(own: Column) -> Column:
        quotes = F.transform(own, lambda p: p["item"]["evidence_quote"])
        return let(quotes, lambda all_of: F.transform(F.filter(own, lambda p, i: F.array_position(all_of, p["item"]["evidence_quote"]) == i + 1), lambda p: p["item"]))

    def first(own: Column) -> Column:
        kind = lambda *names: _has(own, lambda x: x["type"].isin(*names))
        sub = lambda name: _has(own, lambda x: x["subtype"] == name)
        complex_ = (
            (kind("problem") & kind("behavior") & kind("result"))
            | (sub("sought_paid_help") & sub("paid_but_no_result"))
            | (kind("quantitative") & kind("problem", "barrier"))
            | (F.size(F.array_distinct(F.transform(own, lambda x: _text(x["type"])))) >= 4)
        )
        return F.slice(own, F.lit(1), F.when(complex_, 4).otherwise(2))

    return let(let(ordered, once), first)


def grounded_items(items: Column, *, self_marks: Sequence[str], other_marks: Sequence[str], action_marks: Sequence[str]) -> Column:
    """Items with a quote, their text set to it; a speaker's own acts and results need marks of the self in the quote, acts marks of an act."""

    def grounded(x: Column) -> Column:
        quote = strip(_text(x["evidence_quote"]))
        unsure = (x["speaker_scope"] == "self") & x["type"].isin("behavior", "result") & (contains_any(quote, other_marks) | ~contains_any(quote, self_marks))
        idle = (x["type"] == "behavior") & x["subtype"].isin("attempted", "completed_once", "continued", "stopped", "sought_paid_help") & ~contains_any(quote, action_marks)
        return (
            x.withField("text", quote)
            .withField("speaker_scope", F.when(unsure, "unclear").otherwise(x["speaker_scope"]))
            .withField("certainty", F.when(unsure | idle, "low").otherwise(x["certainty"]))
            .withField("subtype", F.when(idle, "").otherwise(x["subtype"]))
        )

    return F.transform(F.filter(items, lambda x: strip(_text(x["evidence_quote"])) != ""), grounded)


def has_type(items: Column, *types: str) -> Column:
    return _has(items, lambda x: x["type"].isin(*types))


def all_quotes_found(items: Column, text: Column) -> Column:
    """Whether every quote stands in the text, verbatim or once spaces are gone."""
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    quote = lambda x: strip(_text(x["evidence_quote"]))
    return F.coalesce(F.forall(items, lambda x: (quote(x) == "") | F.contains(text, quote(x)) | F.contains(bare(text), bare(quote(x)))), F.lit(True))
