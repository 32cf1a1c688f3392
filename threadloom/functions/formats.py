"""Values as people and platforms write them: durations, sizes, dates, ids in links, failure classes, locations, prices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.functions.columns import first_filled, strip
from threadloom.functions.rules import Rule, first_match

# --- Fixed values: classes of failures in order, archetypes of titles in order, ids in links. ----------------------------

#: Names of exceptions that say by themselves that the platform blocks.
BLOCKING = ("CaptchaError", "IPBlockError", "PlatformAccessError", "LoginError", "NeedLoginError")
FAILURES = (
    Rule("RATE_LIMITED", r"(?i)频繁|风控|过快|限制|拦截|稍后再试|操作太|try again|rate.?limit"),
    Rule("PLATFORM_BLOCKED", r"(?i)captcha|verifytype|verifyuuid|验证码|人机验证|滑块|账号异常|account blocked|\bblocked\b|ip.?block|拒绝访问|forbidden"),
    Rule("NEED_LOGIN", r"(?i)未登录|请登录|请先登录|登录已|登录失效|登录过期|重新登录|无权限|\blogin\b|\blogged out\b|not logged in|unauthori[sz]ed|token (?:expired|invalid)|sessdata|401"),
    Rule("TIMEOUT", r"(?i)timeout"),
    Rule("NOT_FOUND", r"(?i)not.?found|不存在|已删除|404"),
    Rule("NEED_SETUP", r"(?i)executable doesn't exist|playwright install|not installed|missing dependenc|no such file or directory"),
    Rule("UPSTREAM_BROKEN", r"(?i)playwright|selector|target closed|browser has been closed|decode json|unreadable|空页面|页面结构"),
    Rule("BAD_INPUT", r"^(ValueError|TypeError|KeyError)\b"),
)
ARCHETYPES = (
    Rule("资讯简报/日报", r"(日间版|早报|日报|每日动态|要闻速览|资讯｜|资讯\|)"),
    Rule("提问/求推荐", r"(求推|求推荐|大家.*怎么|该不该|严肃请教|有.*吗[？?]?$|吗$)"),
    Rule("清单/资源", r"(TOP|top|\d+\s*(个|件|期|步)|清单|盘点|合集|推荐|newsletter)"),
    Rule("个人体验/复盘", r"(亲测|\d+\s*(天|个月)|之后|我得到|我从不|我开始|我的)"),
)
#: What a text that is sent out must not hold.
OUTBOUND = (
    ("含链接或站外账号指向", r"https?://|www\.|[a-zA-Z0-9-]+\.(?:com|cn|net|org|io|me|xyz|top)\b|小红书号|抖音号|公众号|视频号|快手号|B站[号名]|知乎号"),
    ("含联系方式", r"加\s*[vV薇微❤]|微信号|[vVxX][：:]\s*[a-zA-Z0-9_-]{3,}|[qQ]{1,2}\s*[：: ]\s*\d{5,}|扣扣|企鹅号|飞机号"),
    ("含引流话术", r"私我|私信我|滴滴我|看我主页|主页有|简介有|关注我|带你(?:做|赚|飞)|收徒|上车|私聊"),
)
IDS = {
    "bili_video": r"(BV[0-9A-Za-z]{10})",
    "bili_space": r"space\.bilibili\.com/(\d+)",
    "dy_video": r"/(?:video|note)/(\d+)|modal_id=(\d+)",
    "dy_user": r"/user/([^?/#]+)",
    "ks_video": r"/short-video/([A-Za-z0-9_-]+)",
    "ks_user": r"/profile/([A-Za-z0-9_-]+)",
    "xhs_note": r"/(?:explore|discovery/item)/([0-9a-f]+)",
    "xhs_user": r"/user/profile/([0-9a-f]+)",
    "wb_user": r"weibo\.(?:com|cn)/(?:u/|profile/)?(\d+)",
    "zhihu_user": r"zhihu\.com/people/([^/?#]+)",
}


def id_of(url: Column, kind: str) -> Column:
    """The id of one kind in a link; empty without one. A bare id of digits stands for itself."""
    u = strip(F.coalesce(url, F.lit("")))
    groups = [F.regexp_extract(u, IDS[kind], k + 1) for k in range(IDS[kind].count("(") - IDS[kind].count("(?:"))]
    return first_filled(*groups, F.when(F.regexp_like(u, F.lit(r"^\d+$")), u).otherwise(""))


def zhihu_kind(url: Column) -> Column:
    """answer, article, video or empty, by the shape of a link."""
    u = F.coalesce(url, F.lit(""))
    return F.when(F.contains(u, F.lit("/answer/")), "answer").when(F.contains(u, F.lit("/p/")), "article").when(F.contains(u, F.lit("/zvideo/")), "zvideo").otherwise("")


def failure_class(message: Column, exception: Column | None = None) -> Column:
    """The class of a failure by the exception's name, if given, and its message: the first that applies."""
    name = F.coalesce(exception, F.lit("")) if exception is not None else F.lit("")
    said = strip(F.concat_ws(" ", F.nullif(name, F.lit("")), F.coalesce(message, F.lit(""))))
    return F.when(name.isin(*BLOCKING), "PLATFORM_BLOCKED").otherwise(first_match(said, FAILURES, "UPSTREAM_BROKEN"))


def archetype(title: Column) -> Column:
    return first_match(F.coalesce(title, F.lit("")), ARCHETYPES, "观点/诊断")


def duration(seconds: Column) -> Column:
    """'9 秒', '3 分 5 秒', '3 分钟', '1 小时 2 分', '1 小时'."""
    s = F.greatest(F.bround(seconds, 0), F.lit(0)).cast("long")
    hours, minutes, rest = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), (s % 60).cast("long")
    return (
        F.when(s < 60, F.format_string("%d 秒", rest))
        .when(s < 3600, F.when(rest > 0, F.format_string("%d 分 %d 秒", minutes, rest)).otherwise(F.format_string("%d 分钟", minutes)))
        .otherwise(F.when(minutes > 0, F.format_string("%d 小时 %d 分", hours, minutes)).otherwise(F.format_string("%d 小时", hours)))
    )


def byte_size(n: Column) -> Column:
    """Bytes with one decimal in the largest of B, KB, MB and GB that is not below one."""
    scaled = lambda k, unit: F.format_string(f"%.1f{unit}", n / 1024.0**k)
    return F.when(n < 1024, scaled(0, "B")).when(n < 1024**2, scaled(1, "KB")).when(n < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))


def epoch_date(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def day_range(first: Column, last: Column) -> Column:
    """struct(start, stop) in seconds of an inclusive range of days; null where the first is after the last."""
    start, stop = F.unix_timestamp(first.cast("timestamp")), F.unix_timestamp(last.cast("timestamp")) + 86_399
    return F.when(first <= last, F.struct(start.alias("start"), stop.alias("stop")))


def seconds_until(minute_now: Column, opens: int, closes: int) -> Column:
    """Seconds until a daily window (minutes of the day, may pass midnight) opens; 0 inside it."""
    inside = (minute_now >= opens) & (minute_now < closes) if opens <= closes else (minute_now >= opens) | (minute_now < closes)
    return F.when(inside, 0).otherwise(F.pmod(F.lit(opens) - minute_now, F.lit(1440)) * 60)


def rfc_epoch(c: Column) -> Column:
    """Seconds of a time such as 'Sat Dec 23 17:12:54 +0800 2023'; null where it is none."""
    parts = F.regexp_extract(c, r"^\w{3} (\w{3} \d{2} \d{2}:\d{2}:\d{2} [+-]\d{4} \d{4})$", 1)
    return F.unix_timestamp(F.try_to_timestamp(F.nullif(parts, F.lit("")), F.lit("MMM dd HH:mm:ss Z yyyy")))


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def trace_id(url: Column) -> Column:
    """The token of a link's query that tells where it was shared from; empty without one."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"[?&](?:xsec_token|trace_id|share_id)=([^&#]*)", 1)


def price_of(model: Column, prices: Mapping[str, tuple[float, float]], otherwise: tuple[float, float]) -> Column:
    """struct(input, output) prices a million tokens by the first provider name that stands in the model's name."""
    value = lambda p: F.struct(F.lit(float(p[0])).alias("input"), F.lit(float(p[1])).alias("output"))
    found = F.when(F.lit(False), value(otherwise))
    for name, p in prices.items():
        found = found.when(F.contains(F.lower(model), F.lit(name.lower())), value(p))
    return found.otherwise(value(otherwise))


def token_cost(prompt: Column, cached: Column, completion: Column, price: Column, cached_share: float = 0.1) -> Column:
    """Cost of a call: cached prompt tokens at a share of the price, others whole; 4 decimals."""
    fresh = F.greatest(prompt - cached, F.lit(0))
    cost = (fresh * price["input"] + cached * price["input"] * cached_share + completion * price["output"]) / 1_000_000.0
    return F.floor(cost * 10_000 + 0.5) / 10_000


def estimate(pending: Column, *, seconds: float = 4.0, concurrency: int = 8, tokens_in: int = 900, tokens_out: int = 350) -> Column:
    """struct(seconds, prompt_tokens, completion_tokens) that a run over so many comments will take, about."""
    return F.struct(F.ceil(pending * seconds / concurrency).alias("seconds"), (pending * tokens_in).alias("prompt_tokens"), (pending * tokens_out).alias("completion_tokens"))


def folder_slug(title: Column, content_id: Column, most: int = 40) -> Column:
    """A folder's name: the title without signs that paths forbid, shortened, and the id."""
    bare = F.regexp_replace(strip(F.coalesce(title, F.lit(""))), r'[\\/:*?"<>|\s]+', "_")
    return F.concat_ws("_", F.nullif(F.substring(bare, 1, most), F.lit("")), content_id)


def path_label(path: Column) -> Column:
    """The name of a file's folder without its trailing video id."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -2), r"_BV[0-9A-Za-z]{10}$", "")


# A platform's domains, and the link of a content by its id.
DOMAINS = {"bili": ("bilibili.com",), "dy": ("douyin.com",), "xhs": ("xiaohongshu.com", "xhslink.com")}
CONTENT_LINK = {"dy": "https://www.douyin.com/video/", "xhs": "https://www.xiaohongshu.com/explore/"}


def reply_url(platform: Column, comment_url: Column, video_url: Column, video_id: Column, comment_id: Column) -> Column:
    """Where a reply is written: the first link on the platform's own domain, else the content's; with an anchor on bili."""
    vid, cid = F.url_encode(F.coalesce(video_id, F.lit(""))), F.url_encode(F.coalesce(comment_id, F.lit("")))

    def own(url: Column, names: Sequence[str]) -> Column:
        pattern = r"^https?://([A-Za-z0-9.-]+\.)?(" + "|".join(n.replace(".", r"\.") for n in names) + r")([:/?#]|$)"
        return F.when(F.regexp_like(F.coalesce(url, F.lit("")), F.lit(pattern)), url)

    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, domains in DOMAINS.items():
        stated = F.coalesce(own(comment_url, domains), own(video_url, domains))
        if name == "bili":
            by_id = F.when(vid != "", F.concat(F.lit("https://www.bilibili.com/video/"), F.when(F.startswith(vid, F.lit("BV")), vid).otherwise(F.concat(F.lit("av"), vid))))
            base = F.coalesce(stated, by_id)
            link = F.concat(F.substring_index(base, "#", 1), F.lit("#reply"), cid)
        else:
            link = F.coalesce(stated, F.when(vid != "", F.concat(F.lit(CONTENT_LINK[name]), vid)))
        found = found.when(platform == name, F.coalesce(link, F.lit("")))
    return found.otherwise("")


def violations(text: Column, rules: Sequence[tuple[str, str]], most: int = 2) -> Column:
    """Labels of the rules that a text breaks, each with up to ``most`` of the pieces that break it."""
    hits = [F.struct(F.lit(label).alias("label"), F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), 1), 1, most).alias("pieces")) for label, pattern in rules]
    return F.filter(F.array(*hits), lambda h: F.size(h["pieces"]) > 0)
