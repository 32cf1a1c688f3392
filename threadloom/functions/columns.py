"""Column functions: text clean-up, count parsers, times, keys, labels, links and ids.

Each takes and returns Columns, so Catalyst sees plain expressions. Where the sources of such data disagree on a rule
(there are six ways to read a count), each rule has its own function; they are never merged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import functions as F
from pyspark.sql.column import Column

# --- text ---------------------------------------------------------------------------------------------------------


#: Fixed value: all characters that Unicode calls white space.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row, however often it stands there; Spark repeats what a lambda encloses for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def strip(c: Column) -> Column:
    """Strip all Unicode white space; without a list of characters, Spark's own trim strips spaces only."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def collapse(c: Column) -> Column:
    """Lower case, stripped, white-space runs as one space."""
    return F.lower(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))


def squeeze(c: Column) -> Column:
    """Lower case, all white space gone."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))


def first_filled(*cs: Column) -> Column:
    """The first value that is neither null nor empty; untrimmed."""
    return F.coalesce(*[F.when(c != "", c) for c in cs], F.lit(""))


def html_to_text(c: Column) -> Column:
    """Scripts and styles with their content gone, then all tags, then stripped."""
    bare = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    return strip(F.regexp_replace(bare, r"(?s)<[^>]+>", ""))


def without_marks(c: Column, tag: str = "em") -> Column:
    """Search highlights removed: the tags of one name, whatever their attributes."""
    return F.regexp_replace(c, rf"(?i)</?{tag}\b[^>]*>", "")


def fold_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*\n+\s*", " ")


def tail_sentence(c: Column) -> Column:
    """The last sentence, end marks aside."""
    bare = F.regexp_replace(strip(c), r"[。！？!?.~～…\s]+$", "")
    return F.element_at(F.split(bare, r"[。！？!?\n]"), -1)


def bigrams(c: Column) -> Column:
    """Distinct character pairs of the squeezed text; none below two characters."""
    s = squeeze(c)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))
    return F.when(F.length(s) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def fuzzy_hit(target: Column, text: Column) -> Column:
    """Whether any pair of neighbouring characters of the target stands in the text; a single character must itself."""
    t = strip(target)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    return F.when(F.length(t) == 0, F.lit(False)).when(F.length(t) == 1, F.contains(text, t)).otherwise(F.exists(pairs, lambda g: F.contains(text, g)))


def quote_exists(quote: Column, text: Column) -> Column:
    """Verbatim, or verbatim once spaces are gone from both; the empty quote always exists."""
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return (F.length(quote) == 0) | F.contains(text, quote) | F.contains(bare(text), bare(quote))


def keyword_tokens(c: Column, stop: Sequence[str] = ()) -> Column:
    """Pieces of two characters or more between white space and punctuation, less stop words, in order, distinct."""
    pieces = F.transform(F.split(c, r"[\s、/|,，。?？!！:：;；（）()\[\]\"']+"), strip)
    kept = F.filter(F.array_distinct(pieces), lambda x: F.length(x) >= 2)
    return F.array_except(kept, F.array(*[F.lit(s) for s in stop])) if stop else kept


# --- counts -------------------------------------------------------------------------------------------------------

# Fixed value: how a count of ten thousands is written.
_TEN_THOUSANDS = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*[wW万]\s*\+?\s*$"


def _whole(c: Column) -> Column:
    """Toward zero; null where it is no number."""
    n = c.try_cast("double")
    return F.when(n < 0, F.ceil(n)).otherwise(F.floor(n))


def play_count(c: Column) -> Column:
    """'5305', '10万+', '1.2w', '1,234' to a number; digits at the start else; 0 otherwise, negatives included."""
    s = F.regexp_replace(strip(c.cast("string")), "[,，]", "")
    wan = F.regexp_extract(s, _TEN_THOUSANDS, 1)
    lead = F.regexp_extract(s, r"^\s*([0-9]+)", 1)
    return F.coalesce(F.when(wan != "", F.floor(wan.try_cast("double") * 10_000)), F.when(lead != "", lead.try_cast("long")), F.lit(0)).cast("long")


def digits_count(c: Column) -> Column:
    """As play_count for 万 and w; else all digits of the text together."""
    s = strip(c.cast("string"))
    wan = F.regexp_extract(s, _TEN_THOUSANDS, 1)
    digits = F.regexp_replace(s, "[^0-9]", "")
    return F.coalesce(F.when(wan != "", F.floor(wan.try_cast("double") * 10_000)), F.when(digits != "", digits.try_cast("long")), F.lit(0)).cast("long")


def display_count(c: Column) -> Column:
    """A number, or one followed by 万; 0 else."""
    s = strip(F.coalesce(c.cast("string"), F.lit("0")))
    return F.coalesce(F.when(F.endswith(s, F.lit("万")), _whole(F.regexp_replace(s, "万$", "").try_cast("double") * 10_000)).otherwise(_whole(s)), F.lit(0)).cast("long")


def strict_count(c: Column) -> Column:
    """A plain whole number; 0 else."""
    s = strip(c.cast("string"))
    return F.coalesce(F.when(F.regexp_like(s, F.lit(r"^[+-]?[0-9]+$")), s.try_cast("long")), F.lit(0)).cast("long")


def lenient_int(c: Column, default: int = 0) -> Column:
    """Any number, cut toward zero; links and anything else give the default."""
    s = strip(c.cast("string"))
    return F.when(F.regexp_like(s, F.lit("^https?://")), F.lit(default)).otherwise(F.coalesce(_whole(s), F.lit(default))).cast("long")


def first_digits(c: Column) -> Column:
    """The first run of digits anywhere; 0 without."""
    return F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("long"), F.lit(0)).cast("long")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, half up on the double itself, so that other engines can take the same steps; 0 of nothing."""
    scale = float(10**digits)
    return F.when(whole > 0, F.floor(part * 100.0 / whole * scale + 0.5) / scale).otherwise(F.lit(0.0))


# --- times --------------------------------------------------------------------------------------------------------


def to_epoch(c: Column, millis_above: float = 1e10) -> Column:
    """Seconds from seconds, milliseconds (numbers above the bound) or ISO text; null else. Times are UTC."""
    n = c.cast("string").try_cast("double")
    number = F.when(n > millis_above, n / 1000).otherwise(n)
    return F.coalesce(F.floor(number), F.unix_timestamp(F.try_to_timestamp(c.cast("string")))).cast("long")


def sane_epoch(c: Column, low: float = 1e9, high: float = 2e9) -> Column:
    """Null outside the open window; corrupt times of far years exist."""
    return F.when((c > low) & (c < high), c)


def age_hours(ts: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (now - ts) / 3600.0)


def freshness(ts: Column, now: Column, a_hours: float = 48, b_hours: float = 168) -> Column:
    """A, B or stale by age; an unknown time (null, 0) is stale."""
    age = age_hours(ts, now)
    return F.when(ts.isNull() | (ts == 0), "stale").when(age <= a_hours, "A").when(age <= b_hours, "B").otherwise("stale")


def clock_minutes(c: Column, default: int) -> Column:
    """Minutes of the day of HH:MM."""
    hour, minute = F.split(c, ":")[0].try_cast("int"), F.try_element_at(F.split(c, ":"), F.lit(2)).try_cast("int")
    return F.coalesce(F.when((hour >= 0) & (hour < 24) & (minute >= 0) & (minute < 60), hour * 60 + minute), F.lit(default))


# --- identity, platform, links ------------------------------------------------------------------------------------

# The platforms, in the order in which they are looked for.
PLATFORMS = ("xhs", "dy", "ks", "bili", "wb", "tieba", "zhihu")
# Fixed value: names that many people share.
PLACEHOLDER_NAME = r"(?i)^(用户\d*|bilibili用户|哔哩哔哩用户|默认用户|匿名用户|未知用户|网友|游客)$"


def mergeable_name(name: Column) -> Column:
    n = strip(F.coalesce(name, F.lit("")))
    return (F.length(n) > 1) & ~F.regexp_like(n, F.lit(PLACEHOLDER_NAME)) & ~F.regexp_like(n, F.lit(r"^\d+$"))


# Fixed value: the id of a video within a path or link.
VIDEO_ID = r"(BV[0-9A-Za-z]{10})"


def derived_links(platform: Column, user_id: Column, content_id: Column, comment_id: Column, homepage: Column, comment_url: Column) -> Column:
    """struct(homepage, comment_url): what the row states, else what its ids stand for on its platform, else empty."""
    p, user, content, comment, home, link = (strip(F.coalesce(c.cast("string"), F.lit(""))) for c in (platform, user_id, content_id, comment_id, homepage, comment_url))
    xhs, bili = (p == "xhs") & (content != "") & ((user != "") | (comment != "")), p.isin("bili", "unknown")
    own_home = F.when(user == "", "").when(xhs, F.concat(F.lit("https://www.xiaohongshu.com/user/profile/"), user)).when(bili, F.concat(F.lit("https://space.bilibili.com/"), user))
    own_link = F.when((content == "") | (comment == ""), "").when(xhs, F.concat(F.lit("https://www.xiaohongshu.com/explore/"), content, F.lit("#comment-"), comment)).when(
        bili, F.concat(F.lit("https://www.bilibili.com/video/"), content, F.lit("#reply"), comment)
    )
    return F.struct(first_filled(home, own_home).alias("homepage"), first_filled(link, own_link).alias("comment_url"))


def user_key(user_id: Column, platform: Column, homepage: Column, name: Column) -> Column:
    """id, else homepage, else a name that may be merged; null where nothing tells a user. Ids count per platform."""
    uid, home, n = (strip(F.coalesce(c, F.lit(""))) for c in (user_id, homepage, name))
    place = first_filled(strip(F.coalesce(platform, F.lit(""))), F.lit("unknown"))
    return (
        F.when(uid != "", F.concat(F.lit("id:"), place, F.lit(":"), uid))
        .when(home != "", F.concat(F.lit("home:"), home))
        .when(mergeable_name(n), F.concat(F.lit("user:"), place, F.lit(":"), n))
    )


def user_key_anywhere(user_id: Column, homepage: Column, name: Column) -> Column:
    """As user_key, but equal ids on two platforms are one user."""
    return user_key(user_id, F.lit("unknown"), homepage, name)


def contactability(homepage: Column, comment_url: Column, name: Column, user_id: Column) -> Column:
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(filled(homepage), "high").when(filled(comment_url) & (filled(name) | filled(user_id)), "medium").otherwise("low")


def platform_of_row(note_id: Column, aweme_id: Column, video_id: Column) -> Column:
    """By which id is there, in fixed order."""
    filled = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    return F.when(filled(note_id), "xhs").when(filled(aweme_id), "dy").when(filled(video_id), "bili")


def platform_of_path(path: Column, otherwise: Column) -> Column:
    """The first known platform among the path's parts, BV ids, then the row's own word."""
    parts = F.split(path, r"[/\\]")
    found = F.coalesce(*[F.when(F.array_contains(parts, p), p) for p in PLATFORMS], F.when(F.contains(path, F.lit("BV")), "bili"))
    return F.coalesce(found, F.when(F.lower(otherwise).isin(*PLATFORMS), F.lower(otherwise)), F.lit("unknown"))


def is_root(parent: Column) -> Column:
    return F.coalesce(parent.cast("string"), F.lit("")).isin("", "0")


def last_per_key(entries: Column) -> Column:
    """Map of an array of struct(k, v): of equal keys the last wins; entries without a key are left out."""
    known = F.filter(entries, lambda e: e["k"].isNotNull())
    keys = F.transform(known, lambda e: e["k"])
    return F.map_from_entries(F.filter(known, lambda e, i: F.array_position(F.reverse(keys), e["k"]) == F.size(keys) - i))


def url_parameters(url: Column) -> Column:
    """Map of the query's parameters, decoded; those without a value are left out, and of equal names the last wins."""
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    pairs = F.filter(F.split(query, "&"), lambda p: F.instr(p, F.lit("=")).between(1, F.length(p) - 1))
    decoded = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%20")))
    return last_per_key(F.transform(pairs, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.substr(p, F.instr(p, F.lit("=")) + 1)).alias("v"))))


def cookies(c: Column) -> Column:
    """Map of a cookie header: name=value between semicolons, the last of equal names wins; pieces without = are left out."""
    pairs = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip), lambda p: F.instr(p, F.lit("=")) > 0)
    return last_per_key(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substr(p, F.instr(p, F.lit("=")) + 1).alias("v"))))


def link_ids(url: Column) -> Column:
    """struct(content_id, comment_id) of a link that points at a comment below a video or a note; empty where it has none."""
    u = F.coalesce(url, F.lit(""))
    return F.struct(
        first_filled(F.regexp_extract(u, r"/video/([^/?#]+)", 1), F.regexp_extract(u, r"(?i)/explore/([a-f0-9]+)", 1), F.regexp_extract(u, VIDEO_ID, 1)).alias("content_id"),
        first_filled(F.regexp_extract(u, r"#reply(\d+)", 1), F.regexp_extract(u, r"(?i)#comment-([a-f0-9]+)", 1)).alias("comment_id"),
    )


# --- classes and scores -------------------------------------------------------------------------------------------


def length_bucket(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n < 20, "short").when(n <= 80, "medium").otherwise("long")


# Upper bound (exclusive) of plays, label, usual likes of the top comment.
PLAY_TIERS: tuple[tuple[int | None, str, int], ...] = (
    (1_000, "冷启动(<1k)", 0),
    (5_000, "小流量(1k-5k)", 2),
    (20_000, "中流量(5k-2w)", 9),
    (50_000, "中高流量(2w-5w)", 75),
    (200_000, "高流量(5w-20w)", 252),
    (1_000_000, "大流量(20w-100w)", 431),
    (None, "爆款(>100w)", 2380),
)


def play_tier(play: Column) -> Column:
    """struct(label, median) of the tier that the number of plays falls in."""
    found = None
    for limit, label, median in PLAY_TIERS:
        value = F.struct(F.lit(label).alias("label"), F.lit(median).alias("median"))
        found = (F.when(play < limit, value) if found is None else found.when(play < limit, value)) if limit is not None else found.otherwise(value)
    return found


# Points of a research lead.
LEAD_POINTS = {"continued": 2, "tried": 1, "problems": 2, "help": 1, "costs": 1}
IMPACT_POINTS = {"skipped": 1, "stopped": 2, "changed_plan": 1, "paid_help": 2}


def lead_score(evidence: Column, problems: Column, help_seeking: Column, costs: Column, gaps: Column, impact: Column, paid_help: Column) -> Column:
    """Sum of the points of what a comment shows; paid help counts once."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    points = F.when(evidence == "continued", LEAD_POINTS["continued"]).when(evidence == "tried", LEAD_POINTS["tried"]).otherwise(0)
    points += F.when(some(problems), LEAD_POINTS["problems"]).otherwise(0)
    points += F.when(help_seeking, LEAD_POINTS["help"]).otherwise(0)
    points += F.when(some(costs) | some(gaps), LEAD_POINTS["costs"]).otherwise(0)
    by_impact = F.when(F.lit(False), 0)
    for name, n in IMPACT_POINTS.items():
        by_impact = by_impact.when(impact == name, n)
    return points + by_impact.when(paid_help, IMPACT_POINTS["paid_help"]).otherwise(0)


def lead_priority(score: Column) -> Column:
    return F.when(score >= 5, "high").when(score >= 4, "medium").otherwise("low")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def truthy(c: Column) -> Column:
    """Booleans as models write them: true, 1, yes and 是 and 有 are true; lists, maps and all else are not."""
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("true", "1", "yes", "y", "是", "有"), F.lit(False))


# --- ids ----------------------------------------------------------------------------------------------------------


def fingerprint(*cs: Column) -> Column:
    """sha1 over the values, null as empty, line feeds between: concat_ws alone would skip nulls."""
    return F.sha1(F.concat_ws("\n", *[F.coalesce(c.cast("string"), F.lit("")) for c in cs]))


def short_id(prefix: str, c: Column, length: int = 24) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, length))


def signal_id(c: Column) -> Column:
    """'7', 's7' and 's0007' as 's0007'; null where there is no number."""
    n = F.regexp_extract(F.lower(strip(c.cast("string"))), r"^s?(\d+)$", 1)
    return F.when(n != "", F.concat(F.lit("s"), F.when(F.length(n) >= 4, n).otherwise(F.lpad(n, 4, "0"))))
