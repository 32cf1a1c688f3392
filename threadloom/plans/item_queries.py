"""Queries over items of unknown shape: given tables nested as the platforms' interfaces nest them, read back through VARIANT."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.plans.registry import query
from threadloom.sources import items


@query("""SELECT event_id::VARCHAR AS video_id, CASE WHEN event_id % 4 > 0 THEN repeat(event_type || ' ', 80)[1:500] END AS title, user_id::VARCHAR AS user_id, CASE WHEN event_id % 3 = 0 THEN (props->>'$.k')::BIGINT::VARCHAR ELSE props->>'$.k' END AS liked_count,
(props->>'$.k')::BIGINT AS create_time, 'https://www.bilibili.com/video/av' || event_id AS video_url FROM events WHERE event_id % 11 > 0 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL FROM events WHERE event_id % 11 = 0""")
def variant_items(spark, table):
    """Events as video items; titles are missing or too long, counts come as numbers or texts, some items are broken."""
    k = F.get_json_object("props", "$.k").cast("long")
    title = F.when(F.col("event_id") % 4 > 0, F.repeat(F.concat("event_type", F.lit(" ")), F.lit(80)))
    like = lambda c: F.struct(c.alias("like"))
    view = lambda stat: F.to_json(F.struct(F.struct(F.col("event_id").alias("aid"), title.alias("title"), k.cast("string").alias("pubdate"), F.struct(F.col("user_id").alias("mid")).alias("owner"), stat.alias("stat")).alias("View")))
    item = F.when(F.col("event_id") % 11 == 0, F.lit("{broken")).when(F.col("event_id") % 3 == 0, view(like(k))).otherwise(view(like(k.cast("string"))))
    rows = items.item_rows(table("events").select(item.alias("j")), "j", "bili", "video")
    return rows.select("video_id", "title", "user_id", "liked_count", "create_time", "video_url")


@query("""SELECT o_custkey AS up_id, 'c' || o_custkey AS up_name, o_orderkey::VARCHAR AS fan_id, nullif(o_orderstatus, 'P') AS fan_name FROM orders WHERE o_custkey % 10 > 0""")
def variant_fans(spark, table):
    """A customer's orders as fans, listed within one answer; some answers have no list."""
    fan = F.struct(F.col("o_orderkey").alias("mid"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("uname"))
    lists = table("orders").groupBy("o_custkey").agg(F.collect_list(fan).alias("l"))
    answers = lists.select(F.col("o_custkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), F.lit("s").alias("sign"), F.lit("a").alias("avatar"), F.when(F.col("o_custkey") % 10 > 0, F.to_json(F.struct(F.struct("l").alias("data")))).otherwise('{"data": {"l": 3}}').alias("j"))
    return items.contacts(answers, "j", {n: n for n in ("id", "name", "sign", "avatar")}, "data.l").select("up_id", "up_name", "fan_id", "fan_name")


@query("""SELECT event_id::VARCHAR AS dynamic_id, user_id, CASE WHEN event_id % 3 > 0 THEN event_type ELSE '' END AS text, upper(event_type) AS type, (props->>'$.k')::BIGINT AS pub_ts, event_id % 7 AS total_comments FROM events""")
def variant_dynamics(spark, table):
    """A user's events as dynamics; a third of them have no description."""
    text = F.when(F.col("event_id") % 3 > 0, F.struct(F.col("event_type").alias("text")))
    stat = F.struct(F.struct((F.col("event_id") % 7).alias("count")).alias("comment"))
    modules = F.struct(F.struct(text.alias("desc")).alias("module_dynamic"), F.struct(F.get_json_object("props", "$.k").cast("long").alias("pub_ts")).alias("module_author"), stat.alias("module_stat"))
    one = F.struct(F.col("event_id").cast("string").alias("id_str"), F.concat(F.lit("DYNAMIC_TYPE_"), F.upper("event_type")).alias("type"), modules.alias("modules"))
    answers = table("events").groupBy("user_id").agg(F.to_json(F.collect_list(one)).alias("j")).withColumn("name", F.lit("n"))
    return items.dynamics(answers, "j", "user_id", "name").select("dynamic_id", "user_id", "text", "type", "pub_ts", "total_comments")


@query("""SELECT l_orderkey::VARCHAR AS note_id, string_agg(CASE WHEN l_linenumber % 2 = 0 THEN 'd' ELSE 'u' END || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS image_list, coalesce(string_agg('t' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) FILTER (l_returnflag = 'N'), '') AS tag_list,
CASE WHEN l_orderkey % 2 > 0 THEN '' WHEN l_orderkey % 4 = 0 THEN 'http://sns-video-bd.xhscdn.com/k' || l_orderkey ELSE string_agg('m' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) END AS video_url FROM lineitem GROUP BY l_orderkey""")
def variant_media(spark, table):
    """An order's lines as a note's pictures, topics and streams: links from lists within the item."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    lines = table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("l"))
    part = lambda x, c: F.concat(F.lit(c), x["l_partkey"].cast("string"))
    images = F.transform("l", lambda x: F.struct(part(x, "u").alias("url"), F.when(x["l_linenumber"] % 2 == 0, part(x, "d")).alias("url_default")))
    tags = F.transform("l", lambda x: F.struct(F.when(x["l_returnflag"] == "N", "topic").otherwise("other").alias("type"), F.concat(F.lit("t"), x["l_suppkey"].cast("string")).alias("name")))
    key = F.when(F.col("l_orderkey") % 4 == 0, F.concat(F.lit("k"), F.col("l_orderkey").cast("string")))
    stream = F.struct(F.transform("l", lambda x: F.struct(part(x, "m").alias("master_url"))).alias("h264"))
    video = F.struct(F.struct(key.alias("origin_video_key")).alias("consumer"), F.struct(stream.alias("stream")).alias("media"))
    item = F.struct(F.col("l_orderkey").alias("note_id"), F.when(F.col("l_orderkey") % 2 == 0, "video").otherwise("normal").alias("type"), images.alias("image_list"), tags.alias("tag_list"), video.alias("video"))
    return items.item_rows(lines.select(F.to_json(item).alias("j")), "j", "xhs", "video").select("note_id", "image_list", "tag_list", "video_url")
