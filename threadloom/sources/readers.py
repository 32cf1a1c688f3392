"""Scans: comment files of several shapes as one record table, catalogues, previews, platform items as flat rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from threadloom.functions.columns import (
    PLATFORMS,
    VIDEO_ID,
    contactability,
    derived_links,
    first_filled,
    html_to_text,
    is_root,
    last_per_key,
    lenient_int,
    platform_of_path,
    play_count,
    strip,
    to_epoch,
    url_parameters,
    user_key,
)
from threadloom.operators.dedupe import first_wins, last_wins
from threadloom.operators.ordered import forward_filled
from threadloom.sources import split_csv
from threadloom.sources.split_csv import lines

# Names under which a column is looked for, in order of preference.
FIELD_NAMES: dict[str, tuple[str, ...]] = {
    "comment_text": ("content", "comment_text", "comment", "text", "评论内容", "评论", "正文"),
    "username": ("nickname", "user_name", "username", "author_name", "用户昵称", "昵称"),
    "user_id": ("user_id", "author_id", "uid", "用户id"),
    "user_homepage_url": ("user_homepage_url", "homepage", "profile_url", "用户主页"),
    "comment_url": ("comment_url", "comment_link", "评论链接"),
    "video_title": ("video_title", "title", "content_title", "视频标题", "标题"),
    "creator_name": ("creator_name", "up_name", "author_name", "up主", "博主"),
}


def field_mapping(columns: Sequence[str]) -> dict[str, str | None]:
    """Column for each field: the first candidate that some column equals (case aside), else that some column contains."""
    lowered = {c: c.lower().strip() for c in columns}

    def find(names: Sequence[str]) -> str | None:
        for same in (lambda low, n: low == n, lambda low, n: n in low):
            for name in names:
                for column, low in lowered.items():
                    if same(low, name.lower()):
                        return column
        return None

    found = {field: find(names) for field, names in FIELD_NAMES.items()}
    if not found["comment_text"]:
        raise ValueError("no column holds the comment text")
    return found


def csv_groups(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[str, str, list[str]]]:
    """(encoding, header line, files) of files that can be read together: one header and one encoding, UTF-8 or else GB18030.

    One scan of the lines, of which two values a file come back: its first filled line's bytes, and whether all are valid UTF-8.
    """
    own = lines(spark, paths).withColumn("nth", F.monotonically_increasing_id())
    at = F.when(F.trim("value") != "", F.struct("start", "nth"))
    found = own.groupBy("file").agg(F.min_by(F.hex(F.col("value").cast("binary")), at).alias("header"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    groups: dict[tuple[bool, str], list[str]] = {}
    for r in found.orderBy("file").collect():  # one row a file, as the driver lists them anyway
        if r["header"]:
            groups.setdefault((r["utf8"], r["header"]), []).append(r["file"])
    encoding = lambda utf8: "utf-8" if utf8 else "gb18030"
    return [(encoding(utf8), bytes.fromhex(header).decode(encoding(utf8), "replace"), files) for (utf8, header), files in groups.items()]


def csv_tables(spark: SparkSession, paths: str | Sequence[str]) -> list[DataFrame]:
    """One table for each group of ``csv_groups``, with the columns of its header, ``_file`` and ``_row``."""
    found = []
    for encoding, header, files in csv_groups(spark, paths):
        if split_csv.opens_quote(header):  # a header of several lines
            first = split_csv.csv_records(spark, files[:1], 1 << 30, encoding).where("row = 1").first()
            header = first["value"] if first else header
        names = split_csv.header_names(header)
        found.append(split_csv.parsed(split_csv.csv_records(spark, files, len(names), encoding), names))
    return found


def read_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All columns as strings, bound by name across files, empty strings kept; a file without a column has it empty.

    Files are split among tasks, quoted line feeds or not (``split_csv``). Records with more fields than the header and
    blank lines are skipped, missing fields are empty, a leading BOM is dropped. ``_file`` and ``_row`` (the row's number in
    its file, from 2, as the header is row 1) come last.
    """
    read = csv_tables(spark, paths)
    if not read:
        return spark.createDataFrame([], "_file string, _row long")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)
    return out.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in out.columns if c not in ("_file", "_row")], "_file", "_row")


def ingest_files(spark: SparkSession, paths: str | Sequence[str], **how: str) -> DataFrame:
    """The records (``ingest``) of CSV files of any layouts: fields are found in each file's own header. At least one file must be filled."""
    return reduce(DataFrame.unionByName, [ingest(t, **how) for t in csv_tables(spark, paths)])


def read_json_lines(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType) -> DataFrame:
    """One object a line under a stated schema; a broken line is skipped alone. Lines end at line feeds only."""
    return spark.read.json(paths, schema=schema, mode="DROPMALFORMED", lineSep="\n")


def read_json_array(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType | None = None) -> DataFrame:
    return spark.read.json(paths, schema=schema, multiLine=True)


def ingest(df: DataFrame, *, creator_type: str = "未知", platform: str | None = None) -> DataFrame:
    """Rows of any such file as records: fields by name, empty comments dropped, links derived, ids from file and content.

    ``_file`` and ``_row``, as read_csv gives them, become source_file and source_row_number; without them these are empty
    and null. The record id is a hash of file, row number and values, so a second read gives the same ids.
    """
    own = [c for c in df.columns if c not in ("_file", "_row")]
    mapping = field_mapping(own)
    pick = lambda field: strip(F.coalesce(F.col(f"`{mapping[field]}`").cast("string"), F.lit(""))) if mapping[field] else F.lit("")
    raw = F.map_from_arrays(F.array(*[F.lit(c) for c in own]), F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in own]))
    place = [F.col("_file") if "_file" in df.columns else F.lit("").alias("_file"), F.col("_row") if "_row" in df.columns else F.lit(None).cast("long").alias("_row")]
    rows = df.select(*[pick(f).alias(f) for f in FIELD_NAMES], raw.alias("raw_data"), *place).where("comment_text <> ''").withColumnsRenamed({"_file": "source_file", "_row": "source_row_number"})
    given = F.lit(platform) if platform else platform_of_path(F.col("source_file"), F.try_element_at("raw_data", F.lit("platform")))
    of_raw = lambda *names: first_filled(*[F.coalesce(F.try_element_at("raw_data", F.lit(n)), F.lit("")) for n in names])
    content = first_filled(of_raw("video_id", "note_id", "aweme_id"), F.regexp_extract("source_file", VIDEO_ID, 1))
    links = derived_links(F.col("platform"), F.col("user_id"), content, of_raw("comment_id", "id"), F.col("user_homepage_url"), F.col("comment_url"))
    key = F.concat_ws("#", "source_file", F.coalesce(F.col("source_row_number").cast("string"), F.lit("")), F.array_join(F.map_values("raw_data"), "\u001f"))
    return (
        rows.withColumn("platform", given)
        .withColumn("creator_type", F.lit(creator_type))
        .withColumn("__links", links)
        .withColumns({"user_homepage_url": F.col("__links.homepage"), "comment_url": F.col("__links.comment_url")})
        .drop("__links")
        .withColumn("record_id", F.sha2(key, 256))
        .withColumn("user_key", user_key(F.col("user_id"), F.col("platform"), F.col("user_homepage_url"), F.col("username")))
        .withColumn("contactability", contactability(F.col("user_homepage_url"), F.col("comment_url"), F.col("username"), F.col("user_id")))
    )


def catalogue(rows: DataFrame, file_column: str = "source_file") -> DataFrame:
    """Per file: its rows with a comment, and category, creator and leaf from the path."""
    parts = F.split(F.col(file_column), "/")
    at = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit(""))
    return rows.groupBy(file_column).agg(F.count_if(F.col("comment_text") != "").alias("comments")).withColumns({"category": at(-4), "creator": at(-3), "folder": at(-2), "leaf": at(-1)})


def preview(df: DataFrame, limit: int = 20) -> DataFrame:
    """The first rows with the exact number of all."""
    return df.limit(limit).crossJoin(df.agg(F.count(F.lit(1)).alias("total_rows")))


def normalized(df: DataFrame, platform: str) -> DataFrame:
    """Comment rows of any platform under common names; ids as strings, the root marker as null, times in seconds."""
    has = set(df.columns)
    pick = lambda *names: first_filled(*[F.col(n).cast("string") for n in names if n in has]) if has & set(names) else F.lit("")
    parent = pick("parent_comment_id", "rootid")
    return df.select(
        F.lit(platform).alias("platform"),
        pick("note_id", "aweme_id", "video_id", "content_id").alias("content_id"),
        pick("comment_id", "id").alias("comment_id"),
        F.when(~is_root(parent), parent).alias("parent_comment_id"),
        pick("content", "text", "comment_text").alias("text"),
        pick("user_id", "author_id", "uid").alias("user_id"),
        pick("nickname", "username", "user_name").alias("username"),
        lenient_int(pick("like_count", "digg_count", "liked_count")).alias("likes"),
        to_epoch(pick("create_time", "publish_time", "time")).alias("created"),
    )


def only_platform(df: DataFrame, platform: str) -> DataFrame:
    """Rows whose id column is that platform's own: note_id, aweme_id or video_id."""
    if platform not in PLATFORMS:
        raise ValueError(f"unknown platform {platform}")
    own = {"xhs": "note_id", "dy": "aweme_id"}.get(platform, "video_id")
    return df.where(F.coalesce(F.col(own).cast("string"), F.lit("")) != "") if own in df.columns else df.limit(0)


POST_SCHEMA = "post_list array<struct<id:string,author_id:string,content:array<struct<type:string,text:string,c:string>>>>, user_list array<struct<id:string,name:string>>"


def thread_posts(df: DataFrame, json_column: str) -> DataFrame:
    """Posts of a forum API answer: exploded, authors joined within the answer, the parts of a body put together."""
    parsed = df.withColumn("__j", F.from_json(json_column, POST_SCHEMA)).withColumn("__names", last_per_key(F.transform("__j.user_list", lambda u: F.struct(u["id"].alias("k"), u["name"].alias("v")))))
    body = F.array_join(F.transform("p.content", lambda x: F.coalesce(F.nullif(x["text"], F.lit("")), x["c"], F.lit(""))), "")
    return parsed.select("*", F.explode("__j.post_list").alias("p")).select(F.col("p.id").alias("comment_id"), F.try_element_at("__names", F.col("p.author_id")).alias("author"), body.alias("content"))


def search_cards(df: DataFrame, cards: str) -> DataFrame:
    """Cards of type 9, on the top level or within groups, one a row."""
    top = F.filter(cards, lambda c: c["card_type"] == 9)
    return df.select(F.explode(F.concat(F.transform(top, lambda c: c["mblog"]), F.flatten(F.transform(F.filter(cards, lambda c: c["card_group"].isNotNull()), lambda c: F.transform(F.filter(c["card_group"], lambda g: g["card_type"] == 9), lambda g: g["mblog"]))))).alias("mblog"))


def forward_filled_sheet(df: DataFrame, category: str, order: str) -> DataFrame:
    """A sheet whose merged first column is filled downward; rows without any other value are skipped."""
    others = [c for c in df.columns if c not in (category, order)]
    some = F.coalesce(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.lit(True)) for c in others], F.lit(False))
    return forward_filled(df.withColumn(category, F.nullif(F.col(category), F.lit(""))), [], [F.asc(order)], category).where(some)


# Id and link column of a platform's contents.
PAIR_COLUMNS = {"xhs": ("note_id", "note_url"), "dy": ("aweme_id", "aweme_url"), "bili": ("video_id", "video_url")}


def reshaped(df: DataFrame, platform: str, kind: str, *kept: str) -> DataFrame:
    """Collected ``contents`` or ``comments`` of one platform under common names, with further columns to keep."""
    own, url = PAIR_COLUMNS[platform]
    has = set(df.columns)
    text = lambda *names: first_filled(*[F.col(n).cast("string") for n in names if n in has]) if has & set(names) else F.lit("")
    parent = text("parent_comment_id")
    fields = {
        "comments": {
            "comment_id": text("comment_id"), "video_id": text(own, "video_id"), "parent_comment_id": F.when(~is_root(parent), parent), "content": text("content"),
            "likes": lenient_int(text("like_count")), "created": to_epoch(text("create_time", "time")), "user_id": text("user_id"), "username": text("nickname"),
        },
        "contents": {
            "video_id": text(own), "video_url": text(url, "video_url"), "title": first_filled(text("title"), F.substring(text("desc"), 1, 80)),
            "play": play_count(text("video_play_count", "liked_count")), "created": to_epoch(text("create_time", "time")),
        },
    }[kind]
    return only_platform(df, platform).select(F.lit(platform).alias("platform"), *[c.alias(n) for n, c in fields.items()], *kept)


def collected_pair(contents: DataFrame, comments: DataFrame, platform: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """(comments, videos) of one platform: of each video the last row by ``seq``, of comments all."""
    return reshaped(comments, platform, "comments"), last_wins(reshaped(contents, platform, "contents", seq), ["video_id"], seq).drop(seq)


def last_of_sources(*sources: DataFrame, key: str) -> DataFrame:
    """Rows of several sources by key; a later source's row replaces an earlier one's."""
    marked = [df.withColumn("__nth", F.lit(k)) for k, df in enumerate(sources)]
    return last_wins(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked), [key], "__nth").drop("__nth")


def channel_name(c: Column) -> Column:
    """A channel's name as directories spell it: lower case, without hyphens and underscores."""
    return F.lower(F.regexp_replace(c, "[-_]", ""))


def channels(first: DataFrame, second: DataFrame, seq: str) -> DataFrame:
    """Videos (channel, id, ...) of two schemas already brought together, each id once (the first by ``seq``), channels merged by name."""
    return first_wins(first.unionByName(second, allowMissingColumns=True).withColumn("channel_key", channel_name(F.col("channel"))), ["channel_key", "id"], seq)


ANSWER = "id:string,type:string,content:string,title:string,description:string,excerpt:string,created_time:long,created:long,updated_time:long,updated:long,voteup_count:long,comment_count:long"
PERSON = "id:string,url_token:string,name:string,avatar_url:string"
AUTHOR = f"author:struct<{PERSON},member:struct<{PERSON}>>"
SEARCH_SCHEMA = f"data array<struct<type:string,object:struct<{ANSWER},question:struct<id:string>,{AUTHOR}>>>, paging struct<next:string>"
COMMENTS_SCHEMA = f"data array<struct<id:string,type:string,content:string,created_time:long,like_count:long,child_comment_count:long,{AUTHOR},comment_tag:array<struct<type:string,text:string>>>>"
# Fixed value: the site that questions and articles are linked at.
QA_SITE = "https://www.zhihu.com"


def _person(author: Column) -> list[Column]:
    """An author's id, name and token; where these lie under member, from there."""
    field = lambda n: F.coalesce(author[n], author["member"][n])
    return [field("id").alias("user_id"), field("name").alias("username"), field("url_token").alias("url_token")]


def qa_contents(df: DataFrame, json_column: str) -> DataFrame:
    """Search hits of a Q&A site as flat rows: answers, articles and videos, their texts without HTML, links by kind."""
    hits = df.withColumn("__j", F.from_json(json_column, SEARCH_SCHEMA)).select(F.explode("__j.data").alias("h")).where(F.col("h.type").isin("search_result", "zvideo") & F.col("h.object").isNotNull()).select("h.object.*")
    text = lambda *cs: html_to_text(first_filled(*[F.coalesce(F.col(c), F.lit("")) for c in cs]))
    link = (
        F.when(F.col("type") == "answer", F.concat(F.lit(f"{QA_SITE}/question/"), F.col("question.id"), F.lit("/answer/"), F.col("id")))
        .when(F.col("type") == "article", F.concat(F.lit("https://zhuanlan.zhihu.com/p/"), F.col("id")))
        .otherwise(F.concat(F.lit(f"{QA_SITE}/zvideo/"), F.col("id")))
    )
    nonzero = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in cs], F.lit(0))
    return hits.where(F.col("type").isin("answer", "article", "zvideo")).select(
        F.col("id").alias("content_id"), F.col("type").alias("content_type"), text("content").alias("content_text"), link.alias("content_url"), text("title").alias("title"), text("description", "excerpt").alias("desc"),
        nonzero("created_time", "created").alias("created_time"), nonzero("updated_time", "updated").alias("updated_time"), F.coalesce("voteup_count", F.lit(0)).alias("voteup_count"),
        F.coalesce("comment_count", F.lit(0)).alias("comment_count"), *_person(F.col("author")),
    )


def qa_comments(df: DataFrame, json_column: str) -> DataFrame:
    """Comments of a Q&A site as flat rows; the first ip_info tag is the place."""
    rows = df.withColumn("__j", F.from_json(json_column, COMMENTS_SCHEMA)).select(F.explode("__j.data").alias("c")).where("c.type = 'comment'").select("c.*")
    place = F.try_element_at(F.transform(F.filter("comment_tag", lambda t: t["type"] == "ip_info"), lambda t: t["text"]), F.lit(1))
    return rows.select(F.col("id").alias("comment_id"), html_to_text(F.coalesce("content", F.lit(""))).alias("content"), "created_time", F.coalesce("like_count", F.lit(0)).alias("likes"), F.coalesce("child_comment_count", F.lit(0)).alias("replies"), F.coalesce(place, F.lit("")).alias("place"), *_person(F.col("author")))


def next_offset(url: Column) -> Column:
    """The offset parameter of the next page's link; empty without one."""
    return F.coalesce(F.try_element_at(url_parameters(url), F.lit("offset")), F.lit(""))
