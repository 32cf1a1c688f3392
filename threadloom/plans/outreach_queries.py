"""Queries over queues, progress, quotes, sources and sinks."""

from __future__ import annotations

import os
from datetime import date

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.functions import columns as C
from threadloom.functions import formats as M
from threadloom.functions.rules import comment_class, short_circuit
from threadloom.operators import aggregates as A
from threadloom.operators import queue as Q
from threadloom.operators import quotes as X
from threadloom.operators import results as T
from threadloom.plans.registry import query
from threadloom.scratch import Scratch
from threadloom.sources import sinks
from threadloom.streaming import incremental

NOW = 996_624_000  # 2001-08-01 00:00:00 UTC
VIDEOS_SQL = f"""v AS (SELECT o_orderkey AS video_id, floor(o_totalprice)::BIGINT AS play, (o_custkey % 20)::BIGINT AS reported, floor(epoch(o_orderdate))::BIGINT AS created FROM orders),
c AS (SELECT l_orderkey AS video_id, l_quantity::BIGINT AS likes, floor(epoch(l_shipdate))::BIGINT AS created FROM lineitem WHERE l_linenumber % 2 = 1),
s AS (SELECT video_id, count(*) AS sampled, max(likes) AS top1 FROM c GROUP BY 1),
k AS (SELECT v.*, coalesce(sampled, 0) AS sampled, coalesce(top1, 0) AS top1, greatest(reported, coalesce(sampled, 0)) AS comments, CASE WHEN play < 1000 THEN 0 WHEN play < 5000 THEN 2
  WHEN play < 20000 THEN 9 WHEN play < 50000 THEN 75 WHEN play < 200000 THEN 252 WHEN play < 1000000 THEN 431 ELSE 2380 END AS med FROM v LEFT JOIN s USING (video_id)),
a AS (SELECT *, CASE WHEN play < 1000 THEN 'too_small' WHEN sampled < 5 AND reported >= 10 THEN 'unknown_coverage' WHEN comments < 10 AND top1 < 10 THEN 'cold'
  WHEN top1 >= greatest(floor(med * 2.0), 50) THEN 'crowded' WHEN top1 <= greatest(floor(med * 0.5), 5) THEN 'open' ELSE 'contested' END AS competition FROM k)"""


def _videos(table):
    orders, lines = table("orders"), table("lineitem")
    videos = orders.select(F.col("o_orderkey").cast("string").alias("video_id"), F.floor("o_totalprice").alias("play"), (F.col("o_custkey") % 20).alias("reported"), F.unix_timestamp("o_orderdate").alias("created"))
    comments = lines.select(
        F.col("l_orderkey").cast("string").alias("video_id"), F.when(F.col("l_linenumber") % 2 == 1, "0").otherwise("7").alias("parent_comment_id"), F.col("l_quantity").cast("long").alias("likes"), F.unix_timestamp("l_shipdate").alias("created")
    )
    busy = orders.where("o_custkey % 13 = 0").select(F.col("o_orderkey").cast("string").alias("video_id"))
    return videos, comments, busy


SILENCE_SQL = f"""q AS (SELECT *, CASE WHEN last_sane IS NOT NULL THEN greatest(0, ({NOW} - last_sane) / 3600.0::DOUBLE) WHEN created > 0 THEN greatest(0, ({NOW} - created) / 3600.0::DOUBLE) ELSE 0 END AS silence
  FROM a LEFT JOIN (SELECT video_id, max(created) AS last_sane FROM c WHERE created > 800000000 AND created < {NOW} + 86400 GROUP BY 1) USING (video_id)),
b AS (SELECT o_orderkey AS video_id FROM orders WHERE o_custkey % 13 = 0)"""


@query(f"""WITH {VIDEOS_SQL}, {SILENCE_SQL} SELECT CASE WHEN video_id IN (SELECT video_id FROM b) THEN 'cooldown' WHEN competition NOT IN ('cold', 'open') THEN competition
  WHEN silence > 20000 THEN 'cooldown' ELSE 'hot_candidates' END AS reason, count(*) AS n FROM q GROUP BY 1""")
def video_funnel(spark, table):
    return Q.funnel_of_videos(*_videos(table), NOW, max_silence_hours=20_000, earliest=8e8)


@query(f"""WITH {VIDEOS_SQL}, {SILENCE_SQL} SELECT video_id::VARCHAR AS video_id, play, CASE WHEN silence <= 48 THEN 'A' ELSE 'B' END AS tier FROM q
WHERE competition IN ('cold', 'open') AND silence <= 20000 AND video_id NOT IN (SELECT video_id FROM b) ORDER BY play DESC, video_id::VARCHAR LIMIT 10""")
def hot_candidates(spark, table):
    return Q.hot_comment_candidates(*_videos(table), NOW, max_silence_hours=20_000, quota=10, earliest=8e8).select("video_id", "play", "tier")


REPLIES_SQL = """t AS (SELECT o_orderkey AS id, o_custkey AS video, o_totalprice AS likes, o_orderpriority AS priority, row_number() OVER w AS turn, first_value(o_orderkey) OVER w AS f
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)),
b AS (SELECT * FROM t ORDER BY turn, f, id LIMIT 200), p AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY likes DESC, id) AS nth FROM b WHERE priority <> '5-LOW'),
r AS (SELECT id, row_number() OVER (ORDER BY likes DESC, id) AS rank FROM p WHERE nth <= 1 ORDER BY rank LIMIT 20)"""


def _replies(table):
    rows = table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("video"), F.col("o_totalprice").alias("likes"), F.col("o_orderpriority").alias("priority"))
    return Q.reply_queue(rows, F.col("priority") != "5-LOW", key="id", video="video", order=[F.desc("likes"), F.asc("id")], quota=20)


@query(f"""WITH {REPLIES_SQL} SELECT id, rank FROM r""")
def reply_queue(spark, table):
    return _replies(table).select("id", "rank")


@query(f"""WITH {REPLIES_SQL} SELECT 'reply' AS action, id::VARCHAR AS id, rank + 1 AS rank FROM r WHERE rank <= 19 UNION ALL SELECT 'hot_comment', 'h1', 1""")
def full_queue(spark, table):
    hot = spark.createDataFrame([("h1", 1)], "video_id string, rank int")
    return Q.full_queue(hot, _replies(table), [F.asc("id")], 20).select("action", "id", "rank")


@query("""SELECT o_custkey AS video_id, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'both' ELSE min(o_orderstatus) END AS route FROM orders GROUP BY 1""")
def video_routes(spark, table):
    return Q.routes(table("orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderstatus").alias("action")))


@query("""WITH h1 AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5),
r1 AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 1000 AND o_orderkey NOT IN (FROM h1) ORDER BY o_orderdate DESC, o_orderkey LIMIT 4),
h2 AS (SELECT * FROM (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) WHERE o_orderkey NOT IN (FROM h1 UNION ALL FROM r1)),
r2 AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 1000 AND o_orderkey NOT IN (FROM h1 UNION ALL FROM r1 UNION ALL FROM h2) ORDER BY o_orderdate DESC, o_orderkey LIMIT 4)
SELECT o_orderkey, 'hot' AS pick FROM (FROM h1 UNION ALL FROM h2) UNION ALL SELECT o_orderkey, 'recent' FROM (FROM r1 UNION ALL FROM r2)""")
def family_quotas(spark, table):
    rows = table("orders").withColumn("family", F.col("o_orderpriority"))
    picked = Q.family_quotas(
        rows, ["1-URGENT", "2-HIGH"], key="o_orderkey", hot=[F.desc("o_totalprice"), F.asc("o_orderkey")], recent=[F.desc("o_orderdate"), F.asc("o_orderkey")], eligible=F.col("o_totalprice") > 1000, n_hot=5, n_recent=4
    )
    return picked.select("o_orderkey", "pick")


@query("""SELECT n_name AS keyword, (((n_nationkey - (213 * 7) % 25) % 25 + 25) % 25)::BIGINT AS turn, ((n_nationkey - (213 * 7) % 25) % 25 + 25) % 25 < 7 AS now FROM nation""")
def keyword_plan(spark, table):
    keywords = table("nation").select(F.col("n_name").alias("keyword"), F.col("n_nationkey").cast("long").alias("position"))
    return Q.keyword_plan(keywords, date(2026, 8, 1), 7)


@query(f"""SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND {NOW} - floor(epoch(o_orderdate)) <= 365 * 86400""")
def recent_drafts(spark, table):
    items = table("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit("x").alias("draft"), F.unix_timestamp("o_orderdate").alias("sent_at"), F.lit(None).cast("long").alias("decided_at"), F.lit(0).alias("created_at"))
    return Q.recent_drafts(items, F.lit(NOW), 365, ["F", "O"]).select("o_orderkey")


@query("""WITH d AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 'rejected' WHEN o_orderstatus = 'O' THEN 'pending_review' ELSE o_orderstatus END AS status FROM orders)
SELECT CASE WHEN o_custkey % 10 = 0 THEN 'done' ELSE status END AS status, count(*) AS n FROM d GROUP BY 1""")
def bulk_decisions(spark, table):
    status = F.when(F.col("o_orderstatus") == "O", "pending_review").otherwise(F.col("o_orderstatus"))
    items = table("orders").select(F.col("o_custkey").alias("comment_id"), status.alias("status"), "o_totalprice", F.lit(None).cast("long").alias("decided_at"))
    decided = Q.decided(items, F.col("o_totalprice") > 100_000, "rejected", F.lit(NOW))
    keys = table("customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("comment_id"))
    marks = keys.withColumns({"status": F.lit("seen"), "seq": F.lit(1)}).union(keys.withColumns({"status": F.lit("done"), "seq": F.lit(2)}))
    return Q.marked(decided, marks).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS completed,
(SELECT count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 7 = 0) AS failed,
(SELECT count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 7 <> 0) AS skipped""")
def run_progress(spark, table):
    rows = table("orders").withColumn("record_id", F.col("o_orderkey").cast("string"))
    done = T.done_ids(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'F' AND o_custkey > 5"))
    return T.progress(rows, done, rows.where("o_custkey % 7 = 0"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE event_type WHEN 'error' THEN 'help_seeking:bool_type' WHEN 'click' THEN '用户已停止 1' WHEN 'view' THEN '未知错误' ELSE 'line of ' || event_type END AS reason FROM events) GROUP BY 1""")
def error_reasons(spark, table):
    kind = F.col("event_type")
    message = (
        F.when(kind == "error", F.concat(F.lit("1 validation error for Row\nhelp_seeking\n Input should be ["), F.lit("[type=bool_type, input "), F.col("event_id").cast("string")))
        .when(kind == "click", " 用户已停止 1")
        .when(kind == "view", " ")
        .otherwise(F.concat(F.lit("line of "), kind, F.lit("\nmore")))
    )
    return T.error_reasons(table("events"), message)


@query("""WITH t AS (SELECT l_quantity AS p, l_tax * 100 AS c, l_discount AS s, l_discount * 10 AS conf FROM lineitem) SELECT count(*) AS trial, avg(p) AS avg_prompt_tokens, avg((conf < 0.72)::INT::DOUBLE) AS low_confidence,
ceil(avg(p) * 5000 * 1.2::DOUBLE)::BIGINT AS total_prompt_tokens FROM t""")
def trial_extrapolation(spark, table):
    trial = table("lineitem").select(F.col("l_quantity").alias("prompt_tokens"), (F.col("l_tax") * 100).alias("completion_tokens"), F.col("l_discount").alias("seconds"), (F.col("l_discount") * 10).alias("confidence"))
    return T.extrapolated(trial, 5000).select("trial", "avg_prompt_tokens", "low_confidence", "total_prompt_tokens")


@query("""SELECT status, reason, count(*) AS n FROM (SELECT CASE WHEN trim(p, E' \n\t') = '' THEN ['garbled', 'empty'] WHEN contains(p, 'AI视频小助理') THEN ['machine_generated', 'machine_generated'] WHEN NOT regexp_matches(p, '[\\p{L}\\p{N}]') THEN ['garbled', 'garbled']
WHEN contains(p, '啤酒鸭') AND NOT contains(substr(p, 1, 10), '做') THEN ['off_topic', 'off_topic_joke'] WHEN contains(p, 'https://') AND length(p) < 80 AND NOT contains(p, '谢谢') THEN ['spam', 'spam'] END AS s, s[1] AS status, s[2] AS reason
FROM (SELECT CASE doc_id % 9 WHEN 0 THEN ' ' WHEN 1 THEN '——AI视频小助理 ' || doc_id WHEN 2 THEN '!!! __ …' WHEN 3 THEN '啤酒鸭' WHEN 4 THEN '我做啤酒鸭' WHEN 5 THEN 'https://a.b ' || source WHEN 6 THEN '谢谢 https://a.b' ELSE text END AS p FROM documents)) GROUP BY 1, 2""".replace("\\\\", "\\"))
def short_circuits(spark, table):
    k = F.col("doc_id") % 9
    text = (
        F.when(k == 0, " ").when(k == 1, F.concat(F.lit("——AI视频小助理 "), F.col("doc_id").cast("string"))).when(k == 2, "!!! __ …").when(k == 3, "啤酒鸭").when(k == 4, "我做啤酒鸭")
        .when(k == 5, F.concat(F.lit("https://a.b "), "source")).when(k == 6, "谢谢 https://a.b").otherwise(F.col("text"))
    )
    said = short_circuit(text)
    return table("documents").select(said.alias("s")).groupBy(F.col("s.status").alias("status"), F.col("s.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


#: Comments, and the class and label that the rules give them.
COMMENTS = (
    ("太短了", "excluded", "太短"), ("求问各位这个是什么软件做的", "target_a", "问工具/怎么做"), ("我是新手小白请问能不能学会", "target_b", "新手求路径"), ("出售成品号低价出联系", "excluded", "垃圾广告"),
    ("我觉得人工智能会改变很多行业的格局", "target_c", "AI相关观点/讨论"), ("今天天气很好适合出去走走", "excluded", "无提问"), ("运行的时候一直报错怎么做", "excluded", "个案报错"), ("老师你的视频真好看啊", "excluded", "导演式提问"),
)


@query("WITH k(k, state, label) AS (VALUES " + ", ".join(f"({i}, '{s}', '{name}')" for i, (_, s, name) in enumerate(COMMENTS)) + ") SELECT state, label, count(*) AS n FROM events JOIN k ON event_id % 8 = k GROUP BY 1, 2")
def comment_classes(spark, table):
    text = F.element_at(F.array(*[F.lit(t) for t, _, _ in COMMENTS]), (F.col("event_id") % 8 + 1).cast("int"))
    said = table("events").select(comment_class(text, F.lit("bili")).alias("c"))
    return said.groupBy(F.col("c.state").alias("state"), F.col("c.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand, count(*) AS n, median(p_size) AS median, max(p_size) AS top FROM part GROUP BY 1""")
def keyword_supply(spark, table):
    return A.medians(table("part"), ["p_brand"], "p_size")


@query("""WITH t AS (SELECT CASE l_suppkey % 5 WHEN 0 THEN '早报' WHEN 1 THEN '求推荐耳机' WHEN 2 THEN '10个工具盘点' WHEN 3 THEN '亲测30天' ELSE '为什么这样' END AS title, l_quantity AS likes, l_returnflag AS keyword FROM lineitem),
k AS (SELECT CASE title WHEN '早报' THEN '资讯简报/日报' WHEN '求推荐耳机' THEN '提问/求推荐' WHEN '10个工具盘点' THEN '清单/资源' WHEN '亲测30天' THEN '个人体验/复盘' ELSE '观点/诊断' END AS archetype, likes, keyword FROM t)
SELECT archetype, keyword, count(*) AS n, median(likes) AS median, max(likes) AS top FROM k GROUP BY 1, 2""")
def archetype_medians(spark, table):
    k = F.col("l_suppkey") % 5
    title = F.when(k == 0, "早报").when(k == 1, "求推荐耳机").when(k == 2, "10个工具盘点").when(k == 3, "亲测30天").otherwise("为什么这样")
    rows = table("lineitem").select(M.archetype(title).alias("archetype"), F.col("l_returnflag").alias("keyword"), F.col("l_quantity").alias("likes"))
    return A.medians(rows, ["archetype", "keyword"], "likes")


@query("""SELECT keyword, (SELECT count(*) FROM documents WHERE regexp_matches(text, '(?i)' || keyword)) AS n FROM (VALUES ('licen[cs]e'), ('contact'), ('zzzz')) k(keyword)""")
def gap_keywords(spark, table):
    return A.keyword_counts(table("documents"), F.col("text"), ["licen[cs]e", "contact", "zzzz"])


@query("""SELECT avg((top1 < med / 4.0)::INT::DOUBLE) AS blank_share, count(*) AS n FROM (SELECT o_orderkey, (o_custkey % 100) AS top1, CASE WHEN p < 1000 THEN 0 WHEN p < 5000 THEN 2 WHEN p < 20000 THEN 9 WHEN p < 50000 THEN 75 WHEN p < 200000 THEN 252
WHEN p < 1000000 THEN 431 ELSE 2380 END AS med FROM (SELECT *, floor(o_totalprice) AS p FROM orders))""")
def blank_competition(spark, table):
    rows = table("orders").select((F.col("o_custkey") % 100).alias("top1"), C.play_tier(F.floor("o_totalprice"))["median"].alias("tier_median"))
    return A.blank_share(rows)


@query("""WITH h AS (SELECT l_orderkey, count(*) AS rows, count(*) FILTER (l_returnflag = 'R') AS hits FROM lineitem GROUP BY 1) SELECT l_orderkey, hits, hits >= 3 OR hits * 10 >= rows AS passes FROM h""")
def need_groups(spark, table):
    return A.group_hits(table("lineitem"), "l_orderkey", F.col("l_returnflag") == "R", least=3)


@query("""SELECT source, count(*) AS n, ceil(count(*) / 40.0)::BIGINT AS batches FROM documents GROUP BY 1""")
def signal_batches(spark, table):
    return A.batches(table("documents"), "source", 40)


@query("""SELECT count(*) AS total, count(*) FILTER (quality = 1) AS expected, avg((toxic = 1)::INT::DOUBLE) FILTER (quality = 1) AS recall, avg((quality IS NOT DISTINCT FROM toxic)::INT::DOUBLE) AS agreement FROM labels""")
def gate_recall(spark, table):
    return A.gate(table("labels"), expected=F.col("quality") == 1, found=F.col("toxic") == 1, agrees=F.col("quality").eqNullSafe(F.col("toxic")))


@query("""SELECT 'left' AS part, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'right', count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT 'both', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def id_sets(spark, table):
    orders = table("orders")
    return A.set_sizes(orders.where("o_orderstatus = 'F'").select("o_custkey"), orders.where("o_orderstatus = 'P'").select("o_custkey"), "o_custkey")


@query("""SELECT page_id, CASE WHEN n < 60 THEN n || ' 秒' WHEN n < 3600 AND n % 60 > 0 THEN (n // 60) || ' 分 ' || (n % 60) || ' 秒' WHEN n < 3600 THEN (n // 60) || ' 分钟' WHEN (n % 3600) // 60 > 0 THEN (n // 3600) || ' 小时 ' || ((n % 3600) // 60) || ' 分'
ELSE (n // 3600) || ' 小时' END AS took, strftime(make_timestamp(n * 1000000), '%Y-%m-%d') AS day FROM (SELECT page_id, page_id * 37 AS n FROM pages)""")
def formatted_values(spark, table):
    n = F.col("page_id") * 37
    return table("pages").select("page_id", M.duration(n).alias("took"), M.epoch_date(n).alias("day"))


@query("""SELECT "class", count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'RATE_LIMITED' WHEN 'click' THEN 'NEED_LOGIN' WHEN 'error' THEN 'TIMEOUT' WHEN 'purchase' THEN 'PLATFORM_BLOCKED' ELSE 'UPSTREAM_BROKEN' END AS "class" FROM events) GROUP BY 1""")
def failure_classes(spark, table):
    kind = F.col("event_type")
    message = F.when(kind == "view", "操作太频繁").when(kind == "click", "请先登录").when(kind == "error", "Read Timeout").when(kind == "purchase", "限制").otherwise("???")
    return table("events").groupBy(M.failure_class(message, F.when(kind == "purchase", "PlatformAccessError")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, 'https://www.bilibili.com/video/' || CASE WHEN o_custkey % 2 = 0 THEN 'BV' ELSE 'av' END || o_custkey || '#reply' || o_orderkey AS url, CASE WHEN o_custkey % 2 = 0 THEN 'BV' ELSE 'av' END || o_custkey AS content_id, o_orderkey::VARCHAR AS comment_id FROM orders""")
def reply_links(spark, table):
    vid = F.concat(F.when(F.col("o_custkey") % 2 == 0, "BV").otherwise(""), F.col("o_custkey").cast("string"))
    url = M.reply_url(F.lit("bili"), F.lit("https://elsewhere.example/1"), F.lit(None).cast("string"), vid, F.col("o_orderkey").cast("string"))
    rows = table("orders").select("o_orderkey", url.alias("url"))
    ids = C.link_ids(F.col("url"))
    return rows.select("o_orderkey", "url", ids["content_id"].alias("content_id"), ids["comment_id"].alias("comment_id"))


@query("""SELECT l_suppkey, count(*) AS calls, sum(floor(((l_quantity - 1) * 2.0 + 1 * 2.0 * 0.1 + l_linenumber * 8.0) / 1000000.0 * 10000 + 0.5) / 10000) AS cost FROM lineitem GROUP BY 1""")
def model_costs(spark, table):
    price = M.price_of(F.lit("Provider-X large"), {"provider-x": (2.0, 8.0)}, (1.0, 1.0))
    cost = M.token_cost(F.col("l_quantity"), F.lit(1.0), F.col("l_linenumber"), price)
    return table("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("calls"), F.sum(cost).alias("cost"))


@query("""SELECT turn, role, count(*) AS n FROM conversations GROUP BY 1, 2""")
def json_repair(spark, table):
    """Objects taken out of model answers: fenced, cut off, or between words."""
    body = F.format_string('{"turn": %d, "role": "%s", "rest": [1, {"a": "b', F.col("turn").cast("int"), F.col("role"))
    whole = F.format_string('{"turn": %d, "role": "%s"}', F.col("turn").cast("int"), F.col("role"))
    k = F.col("turn") % 3
    answer = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Here:\n```json\n"), whole, F.lit("\n```"))).otherwise(F.concat(F.lit("sure "), whole, F.lit(" {")))
    parsed = table("conversations").select(F.from_json(X.json_object(answer), "turn long, role string").alias("j")).select("j.*")
    return parsed.groupBy("turn", "role").agg(F.count(F.lit(1)).alias("n"))


#: Each document with one benchmark item, in turn; parts of the item by place and length, longest first.
QUOTES_SQL = """b AS (SELECT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS q, row_number() OVER (ORDER BY item_id) - 1 AS k FROM benchmark), d AS (SELECT doc_id, replace(coalesce(text, ''), ' ', '') AS bare, doc_id % (SELECT count(*) FROM benchmark) AS k FROM documents),
f AS (SELECT k, q, i, n, replace(regexp_replace(q[i:i+n-1], '^\\s+|\\s+$', '', 'g'), ' ', '') AS part FROM (SELECT k, q, i, unnest(range(4, 49)) AS n FROM (SELECT k, q, unnest(range(1, length(q) - 2)) AS i FROM b)) WHERE i + n - 1 <= length(q)),
found AS (SELECT doc_id, arg_max(q[i:i+n-1], n * 100000 - i) AS quote FROM d JOIN f USING (k) WHERE contains(bare, part) GROUP BY 1)"""


@query(f"""WITH {QUOTES_SQL} SELECT doc_id, CASE WHEN contains(bare, replace(q, ' ', '')) THEN q[1:48] ELSE coalesce(quote, '') END AS quote FROM d JOIN b USING (k) LEFT JOIN found USING (doc_id)""")
def longest_quote(spark, table):
    """The longest part of a benchmark item that a whole document holds, each document with one item in turn."""
    items = table("benchmark").withColumn("k", F.row_number().over(Window.orderBy("item_id")) - 1).select("k", F.col("text").alias("item"))  # the few items of a benchmark
    n = items.count()
    docs = table("documents").select("doc_id", "text", (F.col("doc_id") % n).alias("k"))
    return docs.join(items, "k").select("doc_id", X.longest_quote(F.col("item"), F.col("text")).alias("quote"))


@query("""SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def quote_check(spark, table):
    quotes = table("benchmark").select("item_id", F.col("text").alias("quote"))
    return X.verbatim_quotes(quotes, table("documents").select("doc_id", "text")).select("doc_id", "item_id")


@query("""SELECT turn, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations WHERE length(text) % 10 >= 6 GROUP BY 1""")
def model_hook(spark, table):
    """A stand-in model answers batch by batch with the second half of each text; answers count whose quote is in the text and that are worth enough."""
    rows = table("conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "turn", "text")

    def make():
        def answer(batch: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"id": batch["id"], "worth": batch["text"].fillna("").str.len() % 10, "quote": [t[len(t) // 2 :] for t in batch["text"].fillna("")]})

        return answer

    kept = X.guarded(X.with_model(rows, make, "id string, worth int, quote string"), rows, "id")
    return kept.join(rows, "id").groupBy("turn").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT source AS source_dir, count(*) AS rows FROM documents GROUP BY 1""")
def partitioned_export(spark, table):
    with Scratch(spark, "export") as scratch:
        found = sinks.export_by_source(table("documents").select("doc_id", "source", "lang"), f"{scratch.root}/by_source", "source")
        return scratch.result(found)


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY 1""")
def stream_available_now(spark, table):
    """Events as a file stream that processes what is there and stops, counted from what it wrote."""
    events = table("events")
    folder = os.path.dirname(events.inputFiles()[0])
    pattern = f"{folder}/*.parquet" if os.path.basename(folder) == "events.parquet" else f"{folder}/events.parq*"
    with Scratch(spark, "stream") as scratch:
        stream = incremental.file_stream(spark, pattern, events.schema, "parquet")
        incremental.run_available(stream, f"{scratch.root}/out", f"{scratch.root}/checkpoint")
        return scratch.result(spark.read.schema(events.schema).parquet(f"{scratch.root}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
