"""Items of platforms' interfaces, whose shape is not known beforehand, as flat rows: VARIANT columns, paths kept as data.

A path that is missing, or leads to something of another kind, gives null; so does text that is no JSON. Numbers and texts
of either spelling are read as the field's kind. What an item holds many of (fans, dynamics, pictures) is exploded or joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.functions.columns import first_filled, html_to_text, strip

# Where each platform's items hold a row's fields; of several paths the first that is filled. `#` marks whole numbers.
PATHS: dict[tuple[str, str], str] = {
    ("bili", "video"): """video_id View.aid | bvid View.bvid | title View.title | desc View.desc | create_time# View.pubdate | user_id View.owner.mid | nickname View.owner.name
        | avatar View.owner.face | liked_count View.stat.like | disliked_count View.stat.dislike | video_play_count View.stat.view | video_favorite_count View.stat.favorite
        | video_share_count View.stat.share | video_coin_count View.stat.coin | video_danmaku View.stat.danmaku | video_comment View.stat.reply | video_cover_url View.pic""",
    ("bili", "comment"): """comment_id rpid | parent_comment_id parent | create_time# ctime | content content.message | user_id member.mid | nickname member.uname | sex member.sex
        | sign member.sign | avatar member.avatar | sub_comment_count rcount | like_count# like""",
    ("bili", "creator"): """user_id Card.card.mid | nickname Card.card.name | sex Card.card.sex | sign Card.card.sign | avatar Card.card.face | total_fans# Card.card.fans
        | total_liked# Card.like_num | user_rank# Card.card.level_info.current_level | is_official# Card.card.official_verify.type""",
    ("bili", "search"): "bvid bvid | aid aid | title title | author author | play# play | like# like | favorites# favorites | comments# review | pubdate# pubdate | duration duration",
    ("dy", "video"): """aweme_id aweme_id | aweme_type aweme_type | title desc | desc desc | create_time# create_time | user_id author.uid | sec_uid author.sec_uid
        | short_user_id author.short_id | user_unique_id author.unique_id | user_signature author.signature | nickname author.nickname | avatar author.avatar_thumb.url_list[0]
        | liked_count statistics.digg_count | collected_count statistics.collect_count | comment_count statistics.comment_count | share_count statistics.share_count
        | ip_location ip_label | music_download_url music.play_url.uri""",
    ("dy", "comment"): """comment_id cid | create_time# create_time | ip_location ip_label | aweme_id aweme_id | content text | user_id user.uid | sec_uid user.sec_uid
        | nickname user.nickname | avatar user.avatar_medium.url_list[0],user.avatar_300x300.url_list[0],user.avatar_168x168.url_list[0],user.avatar_thumb.url_list[0]
        | sub_comment_count reply_comment_total | like_count# digg_count | parent_comment_id reply_id""",
    ("xhs", "video"): """note_id note_id | type type | title title,desc | desc desc | time# time | last_update_time# last_update_time | user_id user.user_id | nickname user.nickname
        | avatar user.avatar | liked_count interact_info.liked_count | collected_count interact_info.collected_count | comment_count interact_info.comment_count
        | share_count interact_info.share_count | ip_location ip_location | xsec_token xsec_token""",
    ("xhs", "comment"): """comment_id id | create_time# create_time | ip_location ip_location | content content | user_id user_info.user_id | nickname user_info.nickname
        | avatar user_info.image | sub_comment_count sub_comment_count | parent_comment_id target_comment.id | like_count like_count""",
    ("weibo", "video"): """note_id mblog.id | content mblog.text | created_at mblog.created_at | liked_count mblog.attitudes_count | comments_count mblog.comments_count
        | shared_count mblog.reposts_count | ip_location mblog.region_name | user_id mblog.user.id | nickname mblog.user.screen_name | gender mblog.user.gender
        | profile_url mblog.user.profile_url | avatar mblog.user.profile_image_url""",
    ("weibo", "comment"): """comment_id id | created_at created_at | content text | sub_comment_count total_number | comment_like_count like_count | ip_location source
        | parent_comment_id rootid | user_id user.id | nickname user.screen_name | gender user.gender | profile_url user.profile_url | avatar user.profile_image_url""",
    ("ks", "video"): """video_id photo.id | video_type type | title photo.caption | desc photo.caption | create_time# photo.timestamp | user_id author.id | nickname author.name
        | avatar author.headerUrl | liked_count photo.realLikeCount | viewd_count photo.viewCount | video_cover_url photo.coverUrl | video_play_url photo.photoUrl""",
    ("ks", "comment"): """comment_id comment_id,commentId | create_time# timestamp | content content | user_id author_id,authorId | nickname author_name,authorName
        | avatar headurl | sub_comment_count commentCount,subCommentCount""",
}
# What a platform cuts, and what it takes away.
LONGEST = {("bili", "video"): {"title": 500, "desc": 6000}, ("ks", "video"): {"title": 500, "desc": 500}}
IN_FRONT = {("weibo", "video"): {"ip_location": "发布于 "}, ("weibo", "comment"): {"ip_location": "来自"}}
LINKS = {
    ("bili", "video"): ("video_url", "https://www.bilibili.com/video/av", "video_id"),
    ("bili", "search"): ("url", "https://www.bilibili.com/video/", "bvid"),
    ("dy", "video"): ("aweme_url", "https://www.douyin.com/video/", "aweme_id"),
    ("weibo", "video"): ("note_url", "https://m.weibo.cn/detail/", "note_id"),
    ("ks", "video"): ("video_url", "https://www.kuaishou.com/short-video/", "video_id"),
}
QUERY_CARDS = ("rec_query", "hot_query")
XHS_VIDEOS = "http://sns-video-bd.xhscdn.com/"


def at(item: Column, path: str, kind: str = "string") -> Column:
    """The value at a path, as the kind; null where it is not. Empty texts are no values."""
    found = F.try_variant_get(item, f"$.{path}", kind)
    return F.nullif(found, F.lit("")) if kind == "string" else found


def picked(item: Column, paths: str, kind: str = "string") -> Column:
    return F.coalesce(*[at(item, p, kind) for p in paths.split(",")])


def fields_of(platform: str, what: str) -> list[tuple[str, str, str]]:
    """(name, paths, kind) of a platform's rows."""
    out = []
    for entry in PATHS[platform, what].split("|"):
        name, paths = entry.split()
        out.append((name.rstrip("#"), paths, "bigint" if name.endswith("#") else "string"))
    return out


def item_rows(df: DataFrame, json_column: str, platform: str, what: str, *kept: str) -> DataFrame:
    """A row for each item (``video``, ``comment``, ``creator`` or ``search``), with further columns to keep.

    Texts of weibo lose their tags, long texts are cut where the platform's are, links are made of ids. Missing is null.
    """
    key, item = (platform, what), F.col("__item")
    own = df.select(*kept, F.try_parse_json(json_column).alias("__item"))
    columns = {name: picked(item, paths, kind) for name, paths, kind in fields_of(platform, what)}
    for name, most in LONGEST.get(key, {}).items():
        columns[name] = F.substring(columns[name], 1, most)
    for name, word in IN_FRONT.get(key, {}).items():
        columns[name] = F.replace(columns[name], F.lit(word), F.lit(""))
    if platform == "weibo":
        columns["content"] = F.regexp_replace(columns["content"], "<.*?>", "")
    if key == ("xhs", "video"):
        columns["title"] = F.coalesce(at(item, "title"), F.substring(at(item, "desc"), 1, 255))
        columns |= {"video_url": note_videos(item), "image_list": note_images(item), "tag_list": note_tags(item)}
    if key == ("xhs", "comment"):
        columns["pictures"] = _joined(item, "pictures", lambda x: at(x, "url_default"))
    if key == ("dy", "video"):
        columns |= {"cover_url": cover(item), "video_download_url": video_download(item), "note_download_url": _joined(item, "images", lambda x: _last(_urls(x, "url_list")))}
    if key == ("dy", "comment"):
        columns["pictures"] = _joined(item, "image_list", lambda x: F.try_element_at(_urls(x, "origin_url.url_list"), F.lit(2)))
    if key == ("bili", "search"):
        columns["title"] = html_to_text(F.coalesce(columns["title"], F.lit("")))
    if key in LINKS:
        name, site, of = LINKS[key]
        columns[name] = F.concat(F.lit(site), columns[of])
    rows = own.select(*kept, *[c.alias(n) for n, c in columns.items()])
    return rows.where("video_id IS NOT NULL") if key == ("ks", "video") else rows


def comments_of(df: DataFrame, json_column: str, platform: str, video: str) -> DataFrame:
    """Comment rows of a requested video, whose id is the column ``video``; of dy, those of other videos are dropped."""
    rows = item_rows(df, json_column, platform, "comment", video)
    return rows.where(F.col("aweme_id") == F.col(video)) if platform == "dy" else rows


# --- lists within an item -----------------------------------------------------------------------------------------


def _urls(item: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(item, f"$.{path}", "array<string>"), F.array().cast("array<string>"))


def _last(urls: Column) -> Column:
    return F.try_element_at(urls, F.lit(-1))


def _joined(item: Column, path: str, url) -> Column:
    """What ``url`` finds in each element of a list, joined by commas; elements without are left out."""
    return F.array_join(F.transform(F.try_variant_get(item, f"$.{path}", "array<variant>"), url), ",")


def cover(item: Column) -> Column:
    """The second of the raw, else the original cover's links."""
    raw, own = (_urls(item, f"video.{n}.url_list") for n in ("raw_cover", "origin_cover"))
    there = F.try_variant_get(item, "$.video.raw_cover", "variant").isNotNull()
    return F.coalesce(F.try_element_at(F.when(there, raw).otherwise(own), F.lit(2)), F.lit(""))


def video_download(item: Column) -> Column:
    """The last link of the first filled list of encodings, if it has two or more."""
    lists = [_urls(item, f"video.{n}.url_list") for n in ("play_addr_h264", "play_addr_256", "play_addr")]
    first = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    return F.coalesce(F.when(F.size(first) > 1, _last(first)), F.lit(""))


def note_videos(item: Column) -> Column:
    """Links of a note's video: by its origin key, else the h264 streams' masters; empty for other notes."""
    key = picked(item, "video.consumer.origin_video_key,video.consumer.originVideoKey")
    masters = _joined(item, "video.media.stream.h264", lambda v: at(v, "master_url"))
    return F.when(at(item, "type") == "video", F.coalesce(F.concat(F.lit(XHS_VIDEOS), key), masters, F.lit(""))).otherwise("")


def note_images(item: Column) -> Column:
    return _joined(item, "image_list", lambda x: picked(x, "url_default,url"))


def note_tags(item: Column) -> Column:
    """Names of a note's topics."""
    return _joined(item, "tag_list", lambda x: F.when(at(x, "type") == "topic", F.coalesce(at(x, "name"), F.lit(""))))


def elements(df: DataFrame, json_column: str, path: str | None, *kept: str) -> DataFrame:
    """One row for each element of a list within the JSON (or of the JSON itself): the columns to keep, ``pos``, ``element``.

    An item without the list gives no row.
    """
    own = df.select(*kept, F.try_parse_json(json_column).alias("__v"))
    if path:
        own = own.withColumn("__v", F.try_variant_get("__v", f"$.{path}", "variant"))
    lists = own.where(F.schema_of_variant("__v").startswith("ARRAY"))
    found = lists.lateralJoin(lists.sparkSession.tvf.variant_explode(F.col("__v").outer()))
    return found.select(*kept, "pos", F.col("value").alias("element"))


def contacts(df: DataFrame, json_column: str, up: dict[str, str], path: str | None = None, *, followings: bool = False) -> DataFrame:
    """Edges between creators: the fans of the row's creator, or, of ``followings``, the creators whose fan it is.

    ``up`` names the row's columns of id, name, sign and avatar.
    """
    rows = elements(df, json_column, path, *up.values())
    other = {"id": at(F.col("element"), "mid"), "name": at(F.col("element"), "uname"), "sign": at(F.col("element"), "sign"), "avatar": at(F.col("element"), "face")}
    own = {n: F.col(c) for n, c in up.items()}
    top, fan = (other, own) if followings else (own, other)
    return rows.select(*[c.alias(f"{side}_{n}") for n in ("id", "name", "sign", "avatar") for side, c in (("up", top[n]), ("fan", fan[n]))])


def dynamics(df: DataFrame, json_column: str, user: str, name: str, path: str | None = None) -> DataFrame:
    """A creator's dynamics: id, text (empty without one), the last word of the type, time and counts."""
    rows = elements(df, json_column, path, user, name)
    e = F.col("element")
    count = lambda n: at(e, f"modules.module_stat.{n}.count", "bigint")
    return rows.select(
        at(e, "id_str").alias("dynamic_id"), F.col(user).alias("user_id"), F.col(name).alias("user_name"), F.coalesce(at(e, "modules.module_dynamic.desc.text"), F.lit("")).alias("text"),
        F.element_at(F.split(at(e, "type"), "_"), -1).alias("type"), at(e, "modules.module_author.pub_ts", "bigint").alias("pub_ts"), count("comment").alias("total_comments"), count("forward").alias("total_forwards"), count("like").alias("total_liked"),
    )


def search_notes(df: DataFrame, json_column: str, *kept: str) -> DataFrame:
    """Notes among search hits: suggestion cards and hits without id or card go; a title may come from the first line of the text."""
    item = F.col("__item")
    card = F.try_variant_get(item, "$.note_card", "variant")
    own = df.select(*kept, F.try_parse_json(json_column).alias("__item")).where(~F.coalesce(at(item, "model_type"), F.lit("")).isin(*QUERY_CARDS))
    own = own.select(*kept, strip(at(item, "id")).alias("note_id"), card.alias("__card"), at(item, "xsec_token").alias("xsec_token")).where("note_id <> '' AND __card IS NOT NULL")
    c = F.col("__card")
    text = lambda paths: strip(F.coalesce(picked(c, paths), F.lit("")))
    title = first_filled(text("display_title,title"), strip(F.split(text("desc"), r"\R")[0]))
    link = F.concat(F.lit("https://www.xiaohongshu.com/explore/"), F.col("note_id"))
    url = F.when(F.col("xsec_token").isNotNull(), F.concat(link, F.lit("?xsec_token="), F.col("xsec_token"), F.lit("&xsec_source=pc_search"))).otherwise(link)
    whole = lambda paths: F.coalesce(picked(c, paths), F.lit(""))
    return own.select(
        *kept, "note_id", F.substring(title, 1, 120).alias("title"), text("user.nickname,user.nick_name").alias("author"), whole("user.user_id").alias("author_id"), whole("type").alias("note_type"),
        whole("interact_info.liked_count").alias("liked_count"), whole("interact_info.collected_count").alias("collected_count"), whole("interact_info.comment_count").alias("comment_count"),
        F.coalesce("xsec_token", F.lit("")).alias("xsec_token"), url.alias("url"), whole("cover.url_default,cover.url").alias("cover_url"),
    )
