"""Cards from the words of a comment alone: rules as data, each adding items and perhaps naming what the comment expresses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.functions.columns import strip
from threadloom.functions.evidence import ITEM, contains_any, with_item_ids
from threadloom.functions.rules import short_circuit

QUOTE = 48


@dataclass(frozen=True)
class Item:
    type: str
    text: str
    subtype: str = ""
    certainty: str = "high"
    scope: str = "self"


@dataclass(frozen=True)
class CardRule:
    """Applies where one of ``words`` (or ``pattern``) stands in the text and, if given, one of ``also`` too."""

    words: tuple[str, ...]
    items: tuple[Item, ...]
    also: tuple[str, ...] = ()
    pattern: str = ""
    expression: str = ""
    only_if_other: bool = False  # the expression is named only where no rule before has


# The rules in their order. Of several that name an expression the last decides, but for those marked.
CARD_RULES = (
    CardRule(("谢谢", "感谢", "太帅", "名不虚传"), (Item("opinion", "赞赏或感谢", certainty="medium"),), expression="praise"),
    CardRule((), (Item("engagement", "签到天数", "checked_in"), Item("behavior", "连续进行暗示", "continued", "medium")), pattern=r"(?i)\bday\s*\d+\b", expression="check_in"),
    CardRule(("签到", "已签到"), (Item("engagement", "评论区签到", "checked_in"),), expression="check_in", only_if_other=True),
    CardRule(("收藏",), (Item("engagement", "收藏", "saved"),)),
    CardRule(("收藏",), (Item("action_gap", "改变意愿与行动落差", "saved_but_not_started"),), also=("不做", "从不开始", "退出", "只是看看", "只看看", "看看就算")),
    CardRule(("关注了收藏了", "关注收藏就学会"), (Item("action_gap", "对普遍不行动现象的观察", "saved_but_not_started", "medium", "general_observation"),)),
    CardRule(("?", "？", "吗", "怎么", "为什么", "正常吗", "有什么区别", "请加入"), (Item("problem", "提出疑问"),), expression="question"),
    CardRule(("帮我", "求教", "怎么办"), (Item("problem", "主动求助"),), expression="help_request"),
    CardRule(("看不懂", "分不清", "搞不清楚", "弄不明白"), (Item("problem", "理解困难"),), expression="help_request"),
    CardRule(("计划", "打算", "准备做", "明天继续"), (Item("behavior", "计划执行", "planned"),)),
    CardRule(("我可以", "我会做", "我能做"), (Item("behavior", "自报能力", "self_reported_ability", "medium"),)),
    CardRule(("做完", "刚做完"), (Item("behavior", "完成一次", "completed_once"),), expression="result_feedback"),
    CardRule(("做了", "试了", "用了", "刚刚试", "试过"), (Item("behavior", "已尝试", "attempted"),), expression="result_feedback", only_if_other=True),
    CardRule(("就会了", "学会了", "看第二遍就会"), (Item("result", "理解或学会"),), expression="result_feedback"),
    CardRule(("坚持", "每天", "继续做"), (Item("behavior", "持续进行", "continued"),), also=("周", "月", "年", "现在", "一周")),
    CardRule(("充值", "会员", "购买", "订阅"), (Item("behavior", "付费购买", "sought_paid_help"),)),
    CardRule(("充值", "会员", "购买", "订阅"), (Item("action_gap", "付费后无结果", "paid_but_no_result"),), also=("没有一点改变", "没变化", "无效果")),
    CardRule(("换成", "还不如", "改用"), (Item("behavior", "调整方案", "changed_plan", "medium"), Item("solution", "替代方案", certainty="medium"))),
    CardRule(("麻烦", "太难", "做不到", "做不了", "学不会", "搞不定"), (Item("barrier", "难度或障碍"),), expression="complaint", only_if_other=True),
    CardRule(("自己搜", "其他办法", "替代"), (Item("solution", "自行方案或建议", certainty="medium", scope="general_observation"),)),
    CardRule(("过敏", "预算", "身体", "年龄", "地区"), (Item("context", "用户提及个人背景", certainty="medium"),)),
    *(CardRule((n,), (Item("quantitative", n, "reps"),)) for n in ("10个", "20个", "25个", "50个", "80个", "100")),
    *(CardRule((n,), (Item("quantitative", n, "duration"),)) for n in ("45秒", "7个多月", "两个月", "九分钟", "一个月")),
    CardRule(("从", "到"), (Item("quantitative", "能力进步", "progress"), Item("behavior", "能力进步", "progress")), also=("个", "次")),
)


def _applies(text: Column, rule: CardRule) -> Column:
    found = contains_any(text, rule.words)
    if rule.pattern:
        found = found | F.regexp_like(text, F.lit(rule.pattern))
    return found & contains_any(text, rule.also) if rule.also else found


def rule_card(text: Column, record: Column) -> Column:
    """struct(record_status, primary_expression, evidence_items) of a comment; those that need no reading have no items."""
    skipped = short_circuit(text)
    t = strip(F.coalesce(text, F.lit("")))
    expression: Column = F.lit("other")
    added = []
    for rule in CARD_RULES:
        applies = _applies(t, rule)
        if rule.expression:
            expression = F.when(applies & (expression == "other") if rule.only_if_other else applies, rule.expression).otherwise(expression)
        for item in rule.items:
            made = F.struct(
                F.lit(item.type).alias("type"), F.lit(item.text).alias("text"), F.substring(t, 1, QUOTE).alias("evidence_quote"), F.lit(item.scope).alias("speaker_scope"),
                F.lit(item.certainty).alias("certainty"), F.lit(item.subtype).alias("subtype"), F.lit("").alias("evidence_item_id"),
            )
            added.append(F.when(applies, made.cast(ITEM)))
    items = with_item_ids(F.array_compact(F.array(*added)), record)
    read = skipped.isNull()
    return F.struct(
        F.coalesce(skipped["status"], F.lit("usable")).alias("record_status"),
        F.when(read, expression).otherwise("other").alias("primary_expression"),
        F.when(read, items).otherwise(F.array().cast(f"array<{ITEM}>")).alias("evidence_items"),
    )
