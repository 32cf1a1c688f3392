"""Text rules as data, compiled to columns: ordered first-match classes and sets of labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.functions.columns import strip
from threadloom.functions.evidence import contains_any


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str  # a regular expression that is searched for


def first_match(text: Column, rules: Sequence[Rule], otherwise: str) -> Column:
    """Label of the first rule whose pattern is found; a null text matches none."""
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in rules:
        found = found.when(F.regexp_like(text, F.lit(rule.pattern)), rule.label)
    return found.otherwise(otherwise)


def all_matches(text: Column, rules: Sequence[Rule]) -> Column:
    """Sorted distinct labels of all rules whose pattern is found."""
    hits = [F.when(F.regexp_like(text, F.lit(r.pattern)), F.lit(r.label)) for r in rules]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))


def any_and_none(text: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Whether some wanted word stands in the text and no unwanted one."""
    has = lambda ws: F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(True)) for w in ws], F.lit(False)) if ws else F.lit(False)
    return has(include) & ~has(exclude)


# Marks of advertising in short texts, of texts that a machine made, and of jokes beside the topic.
SPAM = ("加微信", "代刷", "免费领取", "点击链接", "http://", "https://")
SPAM_BELOW = 80
MACHINE_MADE = ("本内容由AI视频小助理生成", "AI视频小助理", "由AI视频助理生成", "--本内容由AI")
KEEPS_SPAM = ("谢谢", "收藏", "太难", "开始")
JOKES, JOKE_UNLESS = ("啤酒鸭", "连人带盒"), "做"
ASIDES, ASIDE_UNLESS = ("纹身", "门什么时候"), ("做", "完成", "开始")


def _stripped(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit("")))


def looks_like_spam(text: Column) -> Column:
    """A short text with a mark of advertising; the empty text is none."""
    t = _stripped(text)
    return contains_any(t, SPAM) & (F.length(t) < SPAM_BELOW)


def looks_garbled(text: Column) -> Column:
    """Nothing but signs and underscores, in any script; the empty text too."""
    return ~F.regexp_like(_stripped(text), F.lit(r"[\p{L}\p{N}]"))


def looks_machine_made(text: Column) -> Column:
    return contains_any(text, MACHINE_MADE)


def short_circuit(text: Column) -> Column:
    """struct(status, reason) of a text that needs no reading: the first of these tests that it meets; null for others."""
    t = _stripped(text)
    said = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    return (
        F.when(t == "", said("garbled", "empty"))
        .when(looks_machine_made(t), said("machine_generated", "machine_generated"))
        .when(looks_garbled(t), said("garbled", "garbled"))
        .when(contains_any(t, JOKES) & ~F.contains(F.substring(t, 1, 10), F.lit(JOKE_UNLESS)), said("off_topic", "off_topic_joke"))
        .when(contains_any(t, ASIDES) & ~contains_any(t, ASIDE_UNLESS), said("off_topic", "off_topic"))
        .when(looks_like_spam(t) & ~contains_any(t, KEEPS_SPAM), said("spam", "spam"))
    )


# What excludes a comment, in order, and what makes it worth an answer.
EXCLUDING = (
    Rule("垃圾广告", r"成品号|出售|低价出|代充|加[vV薇微]|微信号|带赚|稳赚|项目私|求关注|免费(分享|领取)|私我|滴滴"),
    Rule("使用渠道类", r"用上|怎么用gpt|怎么用claude|如何用gpt|注册|翻墙|科学上网|镜像|账号|会员|充值|买.{0,4}号|支付|报销|订阅|低价pro|直充|封了|封号|中转"),
    Rule("个案报错", r"报错|错误|崩了|闪退|无法|检测不到|安装失败|装不上|黑屏|白屏|内存不足|跑不动|加载器|工作流.{0,6}(失败|不行)|一直(卡|转|等)"),
    Rule("求UP私有资源", r"求skill|求知识库|求资源|求资料|球球skill|三连.{0,10}求|已?三连.{0,8}(求|蹲)|求(提示词|模板|打包|整合包|参数文档|操作手册)|蹲一波|求发|求分享|需要.{0,4}(skill|知识库|资料)"),
    Rule("导演式提问", r"您的|你的|你(这|那)个|up你|楼主你|老师你|k神|ksr桑"),
    Rule("反问/抒情", r"没人(夸|说|提|注意)|我从没觉得|多愁善感|破防|泪目|哭死"),
    Rule("AI水评", r"值得琢磨|值得深思|这道选择题|也挺直观|从某种角度|某种意义|确实也"),
    Rule("AI装饰符", r"^[❖❀✦✿❆◈★☆].{4,}[❖❀✦✿❆◈★☆]$|✨|💫"),
    Rule("纯感叹", r"^(好的|谢谢|感谢|厉害|绝了|哇|牛|冲|收藏了|mark|马克|支持|好看|太|确实|哈哈|笑死|打卡|前排|来了|222|hhh|666|顶|赞)[!！。～~\s]*$|^\d+$"),
)
HOWTO = r"什么(软件|工具|app|模型|程序|网站)|哪个(软件|工具|app|平台)|怎么(做|弄|用|生成|实现|做到|衔接|设置|入门|开始|学)|如何(做|用|实现|生成|入门)|用什么|求(教|指导|推荐)|怎么做同款|怎么才能"
NEWBIE = r"新手|小白|零基础|入坑|萌新|手残|想学|想试|我也想|入门"
ASKS = r"？|\?|吗|呢|什么|怎么|哪|求|请教|能不能|有没有"
SEEKS = r"想学|想做|想试|想用|想了解|想知道|好奇|请教|请问|求教|求助|打算|想上手|想入|能不能|可不可以|有没有办法|怎么才能|能实现|能做"
SEEKS_WHAT = r"提示词|skill|软件|工具|模型|视频|动画|修图|配音"
TOPIC = (
    r"(?i)(?<![a-zA-Z])ai(?![a-zA-Z])|人工智能|大模型|llm|智能体|agent|生成式|gpt|claude|gemini|opus|astra|deepseek|sora|veo|"
    r"可灵|即梦|seedance|千问|qwen|豆包|智谱|nano banana|提示词|数字人|ai视频|ai动画|ai修图|ai绘图|ai画|ai配音|ai生成"
)


def comment_class(text: Column, platform: Column) -> Column:
    """struct(state, label): target_a, target_b, target_c or excluded, by the first rule that applies."""
    t = _stripped(text)
    found = lambda pattern: F.regexp_like(t, F.lit(pattern))
    said = lambda state, label: F.struct(F.lit(state).alias("state"), F.lit(label).alias("label"))
    short, brief = F.length(t) < 8, platform.isin("xhs", "dy")
    chain = F.when(short & ~(brief & found(ASKS)), said("excluded", "太短"))
    for rule in EXCLUDING:
        chain = chain.when(found(rule.pattern), said("excluded", rule.label))
    return (
        chain.when(found(HOWTO), said("target_a", "问工具/怎么做"))
        .when(found(NEWBIE) & found(ASKS), said("target_b", "新手求路径"))
        .when(found(ASKS) & found(SEEKS) & found(SEEKS_WHAT), said("target_b", "想动手求路径"))
        .when((F.length(t) >= 12) & found(TOPIC), said("target_c", "AI相关观点/讨论"))
        .when(short & brief, said("target_b", "短疑问(购买/工具线索)"))
        .otherwise(said("excluded", "无提问"))
    )
