"""Registered queries: each runs one operator over whole tables; beside it the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import columns as C
from threadloom.functions.rules import Rule, all_matches, first_match, looks_garbled, looks_like_spam, looks_machine_made
from threadloom.operators import aggregates as A
from threadloom.operators import dedupe as D
from threadloom.operators import joins as J
from threadloom.operators import ranking as R
from threadloom.operators import segment as S
from threadloom.operators import text as X
from threadloom.operators import vocabulary as V
from threadloom.plans import evidence_queries, item_queries, listing_queries, outreach_queries, reader_queries, report_queries, stream_queries
from threadloom.plans.registry import QUERIES, SQL, query

SCENARIOS = {"widgets": ["widget", "gadget"], "small": ["small"], "metal": ["ring", "bolt", "gear"]}
TEXT_RULES = [
    Rule("license", "(?i)license"),
    Rule("contact", r"[A-Za-z0-9.]@[A-Za-z0-9.]"),
    Rule("markup", r"[&$%#*]{3}"),
    Rule("table", r" \| "),
    Rule("question", r"\?"),
]


@query("""SELECT count(*) AS total, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases,
count(*) FILTER (value >= 10) AS large, count(DISTINCT event_type) AS kinds, count(DISTINCT CAST(ts AS DATE)) AS days FROM events""")
def activity_statistics(spark, table):
    kinds = {"errors": F.col("event_type") == "error", "purchases": F.col("event_type") == "purchase", "large": F.col("value") >= 10}
    return A.run_statistics(table("events"), user=F.col("user_id"), conditions=kinds, distinct={"kinds": F.col("event_type"), "days": F.to_date("ts")})


@query("""SELECT event_type, n, floor(n * 100.0::DOUBLE / sum(n) OVER () * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS pct FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def intent_percentages(spark, table):
    return A.label_percentages(table("events"), "event_type")


@query("""WITH l AS (SELECT list_filter([CASE WHEN regexp_matches(text, '(?i)license') THEN 'license' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9.]@[A-Za-z0-9.]') THEN 'contact' END,
CASE WHEN regexp_matches(text, '[&$%#*]{3}') THEN 'markup' END, CASE WHEN regexp_matches(text, ' \\| ') THEN 'table' END, CASE WHEN regexp_matches(text, '\\?') THEN 'question' END], lambda x: x IS NOT NULL) AS labels FROM documents)
SELECT label, count(*) AS n, floor(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS pct FROM (SELECT unnest(labels) AS label FROM l) GROUP BY 1""".replace("\\\\", "\\"))
def signal_coverage(spark, table):
    return A.coverage(table("documents").select(all_matches(F.col("text"), TEXT_RULES).alias("labels")), "labels")


@query("""SELECT l.event_type, count(e.event_id) AS n FROM (VALUES ('view'), ('click'), ('refund'), ('purchase')) l(event_type) LEFT JOIN events e ON e.event_type = l.event_type GROUP BY 1""")
def zero_filled_labels(spark, table):
    return A.zero_filled(table("events"), "event_type", ["view", "click", "refund", "purchase"])


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def pivot_relations(spark, table):
    return A.pivoted_counts(table("orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


@query("""SELECT c_mktsegment AS hypothesis, weakens, supports, n, CASE WHEN weakens >= 5 OR weakens * 10 >= n THEN 'important' ELSE 'minor' END AS importance
FROM (SELECT c_mktsegment, count(*) FILTER (c_acctbal < 0) AS weakens, count(*) FILTER (c_acctbal >= 5000) AS supports, count(*) AS n FROM customer GROUP BY 1) WHERE weakens > 0""")
def hypothesis_contradictions(spark, table):
    relation = F.when(F.col("c_acctbal") < 0, "weakens").when(F.col("c_acctbal") >= 5000, "supports").otherwise("unclear")
    return A.contradictions(table("customer").select(F.col("c_mktsegment").alias("hypothesis"), relation.alias("relation")), "hypothesis", "relation")


@query("""SELECT r_name, n_name, count(*) AS n, (2 - GROUPING(r_name) - GROUPING(n_name))::INT AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def source_tree_rollup(spark, table):
    df = table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.rollup_counts(df, ["r_name", "n_name"])


@query("""SELECT l_returnflag, l_linestatus, count(*) AS calls, sum(l_quantity) AS tokens, count(*) FILTER (l_shipdate >= DATE '2000-01-01') AS calls_today, coalesce(sum(l_quantity) FILTER (l_shipdate >= DATE '2000-01-01'), 0) AS tokens_today
FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))""")
def cost_grouping_sets(spark, table):
    return A.cost_summary(table("lineitem"), feature="l_returnflag", model="l_linestatus", tokens="l_quantity", today=F.col("l_shipdate") >= F.lit("2000-01-01").cast("date"))


@query("""SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def inventory_pivot(spark, table):
    return A.pivoted_counts(table("orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")), ["day"], "o_orderstatus", ["F", "O", "P"])


@query("""WITH b AS (SELECT user_id, count(*) AS comments, max(value) AS best_score FROM events GROUP BY 1), s AS (SELECT e.user_id, min(event_id) AS best_seq FROM events e JOIN b USING (user_id) WHERE e.value = b.best_score GROUP BY 1),
q AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS n FROM events GROUP BY user_id, event_type)
SELECT b.user_id, comments, best_score, best_seq, (SELECT string_agg(event_type, '|' ORDER BY n) FROM q WHERE q.user_id = b.user_id AND n <= 3) AS quotes FROM b JOIN s USING (user_id)""")
def candidates_by_user(spark, table):
    return A.user_leads(table("events"), user="user_id", seq="event_id", score="value", quote="event_type", quotes=3).withColumn("quotes", F.array_join("quotes", "|"))


@query("""SELECT user_key, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'id:unknown:' || c_custkey WHEN c_custkey % 3 = 1 THEN 'home:http://h/' || (c_custkey % 10) WHEN length(c_mktsegment) > 1 THEN 'user:unknown:' || c_mktsegment END AS user_key FROM customer) GROUP BY 1""")
def user_key_merge(spark, table):
    third = F.col("c_custkey") % 3
    uid = F.when(third == 0, F.col("c_custkey").cast("string"))
    home = F.when(third == 1, F.concat(F.lit("http://h/"), (F.col("c_custkey") % 10).cast("string")))
    keyed = table("customer").select(C.user_key(uid, F.lit(None).cast("string"), home, F.col("c_mktsegment")).alias("user_key"))
    return keyed.groupBy("user_key").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, lang, source, (SELECT count(*) FROM documents WHERE contains(lower(text), 'license')) AS total FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 20 OFFSET 20""")
def row_page_filtered(spark, table):
    rows = table("documents").where(F.contains(F.lower("text"), F.lit("license"))).select("doc_id", "lang", "source")
    return R.page_with_total(rows, [F.asc("doc_id")], 2, 20)


@query("""SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top_n_per_group(spark, table):
    return R.top_per_group(table("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("""SELECT l_suppkey, n, row_number() OVER (ORDER BY n DESC, l_suppkey) AS rank FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY rank LIMIT 10""")
def creator_rank(spark, table):
    return R.top_ranked(table("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc("l_suppkey")], 10)


@query("""WITH t AS (SELECT o_orderkey, o_orderpriority, row_number() OVER w AS turn, first_value(o_orderkey) OVER w AS f FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)) SELECT o_orderkey, o_orderpriority, turn FROM t ORDER BY turn, f, o_orderkey LIMIT 50""")
def round_robin(spark, table):
    return R.round_robin(table("orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], "o_orderkey", 50).select("o_orderkey", "o_orderpriority", "turn")


@query("""WITH s AS (SELECT doc_id, source, lang, CASE WHEN length(text) < 20 THEN 'short' WHEN length(text) <= 80 THEN 'medium' ELSE 'long' END AS bucket, md5('42|' || doc_id) AS h FROM documents), t AS (SELECT *, row_number() OVER (PARTITION BY source, lang, bucket ORDER BY h) AS turn FROM s) SELECT doc_id, source, lang, bucket, turn FROM t ORDER BY turn, h LIMIT 100""")
def stratified_sample(spark, table):
    rows = table("documents").select("doc_id", "source", "lang", C.length_bucket(F.col("text")).alias("bucket"))
    return R.stratified_sample(rows, ["source", "lang", "bucket"], F.concat(F.lit("42|"), F.col("doc_id").cast("string")), 100)


@query("""SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(source || '|' || doc_id)) AS rank FROM documents) WHERE rank <= 30""")
def hash_audit_sample(spark, table):
    return R.hash_sample(table("documents").select("doc_id", "source"), ["source"], F.concat_ws("|", "source", F.col("doc_id").cast("string")), 30)


@query("""WITH b AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 'invalid' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'rest' END AS bucket FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY o_totalprice DESC, o_orderkey) AS n FROM b), c AS (SELECT *, (bucket = 'invalid' AND n <= 15) OR (bucket = 'urgent' AND n <= 10) AS chosen FROM r)
SELECT o_orderkey, CASE WHEN chosen THEN bucket ELSE 'backfill' END AS bucket FROM c ORDER BY chosen DESC, o_totalprice DESC, o_orderkey LIMIT 50""")
def quota_buckets(spark, table):
    conditions = [("invalid", F.col("o_orderstatus") == "P", 15), ("urgent", F.col("o_orderpriority") == "1-URGENT", 10)]
    return R.quota_groups(table("orders"), conditions, [F.desc("o_totalprice"), F.asc("o_orderkey")], 50).select("o_orderkey", "bucket")


@query("""WITH h AS (SELECT o_orderkey, 'hot' AS pick FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20), r AS (SELECT o_orderkey, 'recent' AS pick FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM h) ORDER BY o_orderdate DESC, o_orderkey LIMIT 20) SELECT * FROM h UNION ALL SELECT * FROM r""")
def hot_and_recent(spark, table):
    return R.hot_then_recent(table("orders"), "o_orderkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], [F.desc("o_orderdate"), F.asc("o_orderkey")], 20, 20).select("o_orderkey", "pick")


@query("""WITH n AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders), p AS (SELECT * FROM n WHERE nth <= 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100), s AS (
SELECT n.o_orderkey, n.o_custkey, CASE WHEN p.o_custkey IS NOT NULL AND n.nth <= 1 THEN 'picked' WHEN p.o_custkey IS NOT NULL THEN 'video_cap' ELSE 'deferred' END AS state FROM n LEFT JOIN p ON n.o_custkey = p.o_custkey) SELECT state, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM s GROUP BY 1""")
def video_cap_quota(spark, table):
    queue = R.capped_queue(table("orders"), "o_orderkey", "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 1, 100)
    return queue.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def last_wins(spark, table):
    return D.last_wins(table("events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1""")
def first_wins(spark, table):
    return D.first_wins(table("events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("""SELECT user_id, event_id, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, min(event_id) OVER (PARTITION BY user_id) AS position FROM events) WHERE n = 1""")
def keep_first_position(spark, table):
    return D.last_wins_at_first_place(table("events"), ["user_id"], "event_id").select("user_id", "event_id", "position")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.lang, l.quality, l.toxic FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def full_outer_merge(spark, table):
    labels = table("labels").select("doc_id", "quality", "toxic")
    docs = table("documents").select("doc_id", "lang", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    return J.full_merge(docs, labels, "doc_id", ["quality", "toxic"])


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def anti_done(spark, table):
    done = table("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.pending(table("orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def semi_failed(spark, table):
    failed = table("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.restricted(table("orders").select("o_orderkey", "o_custkey"), failed, "o_orderkey")


TIERS = [(0, 50_000, "small"), (50_000, 200_000, "medium"), (200_000, 400_000, "large"), (400_000, None, "top")]


@query("""SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'medium' WHEN o_totalprice < 400000 THEN 'large' ELSE 'top' END AS tier FROM orders""")
def tier_range_join(spark, table):
    return J.with_tier(table("orders").select("o_orderkey", "o_totalprice"), spark.createDataFrame(TIERS, "low long, high long, tier string"), "o_totalprice")


@query("""WITH t AS (SELECT a.conv_id, a.turn AS root, substr(b.text, 1, 120) AS text, b.turn - a.turn AS level FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.turn <= a.turn + 3)
SELECT conv_id, root, string_agg(text, '|' ORDER BY level) AS context FROM t GROUP BY 1, 2""")
def thread_expand(spark, table):
    turns = table("conversations")
    node = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    edges = turns.select(node(F.col("turn")).alias("id"), node(F.col("turn") - 1).alias("parent"), "text", "turn")
    found = J.thread_context(edges, id_col="id", parent_col="parent", text_col="text", seq_col="turn", levels=3)
    known = turns.select("conv_id", F.col("turn").alias("root"), node(F.col("turn")).alias("node"))
    return known.join(found.withColumnRenamed("root", "node"), "node").select("conv_id", "root", F.array_join("context", "|").alias("context"))


@query("""WITH s AS (SELECT l_orderkey, count(*) AS sampled, max(l_quantity)::BIGINT AS top1 FROM lineitem GROUP BY 1), j AS (SELECT o_orderkey AS video_id, o_totalprice::BIGINT AS play, (o_custkey % 20) AS reported, coalesce(sampled, 0) AS sampled, coalesce(top1, 0) AS top1 FROM orders LEFT JOIN s ON o_orderkey = l_orderkey),
m AS (SELECT *, CASE WHEN play < 1000 THEN 0 WHEN play < 5000 THEN 2 WHEN play < 20000 THEN 9 WHEN play < 50000 THEN 75 WHEN play < 200000 THEN 252 WHEN play < 1000000 THEN 431 ELSE 2380 END AS tier_median, greatest(reported, sampled) AS comments FROM j)
SELECT video_id, top1, CASE WHEN play < 1000 THEN 'too_small' WHEN sampled < 5 AND reported >= 10 THEN 'unknown_coverage' WHEN comments < 10 AND top1 < 10 THEN 'cold' WHEN top1 >= greatest(floor(tier_median * 2.0), 50) THEN 'crowded' WHEN top1 <= greatest(floor(tier_median * 0.5), 5) THEN 'open' ELSE 'contested' END AS competition FROM m""".replace("o_totalprice::BIGINT", "floor(o_totalprice)::BIGINT"))
def competition_class(spark, table):
    videos = table("orders").select(F.col("o_orderkey").alias("video_id"), F.floor("o_totalprice").alias("play"), (F.col("o_custkey") % 20).alias("reported"))
    comments = table("lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_quantity").cast("long").alias("likes"))
    return A.competition(videos, comments).select("video_id", "top1", "competition")


@query("""WITH t AS (SELECT o_orderpriority AS tier, list_sort(list(floor(o_totalprice)::BIGINT)) AS v, count(*) AS n FROM orders GROUP BY 1) SELECT tier, n, v[round_even(0.25 * (n - 1), 0)::BIGINT + 1] AS p25, floor((v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2.0)::BIGINT AS median, v[round_even(0.75 * (n - 1), 0)::BIGINT + 1] AS p75, v[n] AS top FROM t""")
def tier_baseline(spark, table):
    return A.tier_baseline(table("orders").select(F.col("o_orderpriority").alias("tier"), F.floor("o_totalprice").alias("value")), "tier", "value")


@query("""WITH g AS (SELECT (epoch(l_shipdate) - epoch(o_orderdate)) / 3600.0::DOUBLE AS gap_hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate) SELECT count(*) AS n, avg((gap_hours <= 24)::INT::DOUBLE) AS within_24, avg((gap_hours <= 168)::INT::DOUBLE) AS within_168, avg((gap_hours <= 8760)::INT::DOUBLE) AS within_8760 FROM g""")
def arrival_distribution(spark, table):
    lines = table("lineitem").select(F.col("l_orderkey").alias("k"), "l_shipdate")
    gaps = J.within_hours(lines, table("orders").select(F.col("o_orderkey").alias("k"), "o_orderdate"), "k", "l_shipdate", "o_orderdate")
    return A.shares_within(gaps, "gap_hours", [24, 168, 8760])


@query("""WITH g AS (SELECT o_orderpriority, ((epoch(l_shipdate) - epoch(o_orderdate)) / 3600.0::DOUBLE) AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate), t AS (SELECT o_orderpriority, list_sort(list(h)) AS v, count(*) AS n FROM g GROUP BY 1)
SELECT o_orderpriority, n, """ + ", ".join(f"v[round_even({q} * (n - 1), 0)::BIGINT + 1] AS p{round(100 * q)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + """ FROM t""")
def arrival_quantiles(spark, table):
    """When lines arrive after their order, in hours, by priority: tenths, quarters and the median."""
    lines = table("lineitem").select(F.col("l_orderkey").alias("k"), "l_shipdate")
    gaps = J.within_hours(lines, table("orders").select(F.col("o_orderkey").alias("k"), "o_orderdate", "o_orderpriority"), "k", "l_shipdate", "o_orderdate")
    return A.quantiles(gaps, "gap_hours", (0.1, 0.25, 0.5, 0.75, 0.9), ["o_orderpriority"])


@query("""WITH d AS (SELECT length(text) AS n_text, contains(text, '?') AS question, contains(text, '***') AS starred, contains(text, '@') AS contact FROM documents), b AS (SELECT median(n_text) AS base FROM d),
s AS (SELECT 'question' AS feature, n_text FROM d WHERE question UNION ALL SELECT 'starred', n_text FROM d WHERE starred UNION ALL SELECT 'contact', n_text FROM d WHERE contact) SELECT feature, count(*) AS n, median(n_text) AS median, median(n_text) / any_value(base) AS lift FROM s, b GROUP BY 1""")
def feature_lift(spark, table):
    flags = {"question": "?", "starred": "***", "contact": "@"}
    rows = table("documents").select(F.length("text").alias("n_text"), *[F.contains("text", F.lit(m)).alias(f) for f, m in flags.items()])
    return A.feature_lift(rows, "n_text", list(flags))


@query("""SELECT p_brand, count(*) FILTER (p_type = 'ECONOMY') AS "ECONOMY", count(*) FILTER (p_type = 'SMALL') AS "SMALL", count(*) FILTER (p_type = 'STANDARD') AS "STANDARD" FROM part GROUP BY 1""")
def segment_grid(spark, table):
    return A.pivoted_counts(table("part"), ["p_brand"], "p_type", ["ECONOMY", "SMALL", "STANDARD"])


@query("""SELECT quality, toxic, count(*) AS n, quality IS NOT DISTINCT FROM toxic AS "right" FROM labels GROUP BY 1, 2""")
def confusion_pairs(spark, table):
    return A.confusion(table("labels"), "quality", "toxic")


@query("""SELECT label, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, '(?i)license') THEN 'license' WHEN regexp_matches(text, '[A-Za-z0-9.]@[A-Za-z0-9.]') THEN 'contact' WHEN regexp_matches(text, '[&$%#*]{3}') THEN 'markup' WHEN regexp_matches(text, ' \\| ') THEN 'table' WHEN regexp_matches(text, '\\?') THEN 'question' ELSE 'none' END AS label FROM documents) GROUP BY 1""".replace("\\\\", "\\"))
def keyword_rules(spark, table):
    return table("documents").select(first_match(F.col("text"), TEXT_RULES, "none").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(text, '(?i)license') THEN 'license' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9.]@[A-Za-z0-9.]') THEN 'contact' END, CASE WHEN regexp_matches(text, '[&$%#*]{3}') THEN 'markup' END, CASE WHEN regexp_matches(text, ' \\| ') THEN 'table' END, CASE WHEN regexp_matches(text, '\\?') THEN 'question' END], lambda x: x IS NOT NULL)), ',') AS labels FROM documents""".replace("\\\\", "\\"))
def multi_label_rules(spark, table):
    return table("documents").select("doc_id", F.array_join(all_matches(F.col("text"), TEXT_RULES), ",").alias("labels"))


@query("""SELECT count(*) FILTER ((contains(text, '加微信') OR contains(text, '代刷') OR contains(text, '免费领取') OR contains(text, '点击链接') OR contains(text, 'http://') OR contains(text, 'https://'))
  AND length(trim(text, E' \n\t\r')) < 80) AS spam, count(*) FILTER (NOT regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}]')) AS garbled,
count(*) FILTER (contains(text, 'AI视频小助理') OR contains(text, '由AI视频助理生成') OR contains(text, '--本内容由AI')) AS machine_made, count(*) AS total FROM documents""")
def spam_filters(spark, table):
    text = F.col("text")
    counts = {"spam": looks_like_spam(text), "garbled": looks_garbled(text), "machine_made": looks_machine_made(text)}
    return table("documents").agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.count(F.lit(1)).alias("total"))


@query("""WITH w AS (SELECT unnest(['license', 'contact', 'apache', 'example.com', 'the', 'zzzz']) AS token), p AS (SELECT lower(regexp_replace(text, '\\s+', '', 'g')) AS t FROM documents),
n AS (SELECT token, (SELECT count(*) FROM p WHERE contains(t, token)) AS hits, (SELECT count(*) FROM p) AS total FROM w)
SELECT token, hits, CASE WHEN total < 200 THEN 1.0 WHEN hits / total > 0.2 THEN 0.0 WHEN hits / total > 0.05 THEN 0.4 ELSE 1.0 END::DOUBLE AS weight FROM n""")
def df_weights(spark, table):
    return V.rarity_weights(table("documents"), F.col("text"), ["license", "contact", "apache", "example.com", "the", "zzzz"])


@query("""WITH t AS (SELECT * FROM (VALUES ('licenses', 'license'), ('licenses', 'apache'), ('mail', 'example.com'), ('nothing', 'zzzz')) v(scenario, token)), p AS (SELECT lower(regexp_replace(text, '\\s+', '', 'g')) AS t, lang, source FROM documents), n AS (SELECT token, (SELECT count(*) FROM p WHERE contains(p.t, token)) AS hits, (SELECT count(*) FROM p) AS total FROM (SELECT DISTINCT token FROM t)),
ok AS (SELECT t.scenario, t.token FROM t JOIN n USING (token) WHERE total < 200 OR hits / total <= 0.05), h AS (SELECT scenario, count(*) AS hits, count(DISTINCT source) AS users, count(DISTINCT lang) AS videos FROM (SELECT DISTINCT ok.scenario, rid, source, lang FROM (SELECT *, row_number() OVER () AS rid FROM p) q JOIN ok ON contains(q.t, ok.token)) GROUP BY 1)
SELECT s.scenario, coalesce(hits, 0) AS hits, coalesce(users, 0) AS users, coalesce(videos, 0) AS videos, CASE WHEN coalesce(hits, 0) >= 8 AND users >= 5 THEN 'signal' WHEN coalesce(hits, 0) > 0 THEN 'weak' ELSE 'none' END AS verdict FROM (SELECT DISTINCT scenario FROM t) s LEFT JOIN h USING (scenario)""".replace("\\\\", "\\"))
def scenario_verify(spark, table):
    asked = {"licenses": ["license", "apache"], "mail": ["example.com"], "nothing": ["zzzz"]}
    return V.scenario_check(table("documents"), text=F.col("text"), user=F.col("source"), video=F.col("lang"), scenarios=asked).drop("tokens", "quotes")


@query("""WITH w AS (SELECT doc_id, unnest(m) AS word, generate_subscripts(m, 1) AS p FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]{2,4}') AS m FROM documents)), c AS (SELECT word, count(*) AS n, min(doc_id * 10000000 + p) AS f FROM w GROUP BY 1)
SELECT row_number() OVER (ORDER BY n DESC, f) AS rank, word, n FROM c ORDER BY n DESC, f LIMIT 8""")
def frequent_runs(spark, table):
    """The most frequent runs of two to four letters, as a profile without a model is begun with."""
    return S.frequent_runs(table("documents"), F.col("text"), "doc_id", "[a-z]{2,4}")


@query()
def segmented_words(spark, table):
    """Words of whole documents without their spaces, by a dictionary learnt from the conversations; tests try all splits."""
    said = X.word_counts(table("conversations"), F.col("text"))
    return S.segmented_counts(table("documents"), F.replace("text", F.lit(" "), F.lit("")), S.learnt(said))


#: The words of benchmark items and user turns, as tokens.
TOKENS_SQL = """SELECT DISTINCT token FROM (SELECT unnest(regexp_split_to_array(text, '[\\s、/|,，。?？!！:：;；（）()\\[\\]"'']+')) AS token FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations WHERE role = 'user')) WHERE length(token) >= 2"""


@query(f"""WITH t AS ({TOKENS_SQL}), n AS (SELECT token, lower(token) AS needle FROM t), p AS (SELECT doc_id, lower(regexp_replace(text, '\\s+', '', 'g')) AS t FROM documents), h AS (SELECT needle, count(*) AS hits FROM (SELECT DISTINCT needle FROM n) JOIN p ON contains(t, needle) GROUP BY 1)
SELECT token, coalesce(hits, 0) AS hits, (SELECT count(*) FROM documents) AS total FROM n LEFT JOIN h USING (needle)""")
def vocabulary_frequency(spark, table):
    """Document frequencies over whole texts of all words of the benchmark items and user turns, by one walk along each text."""
    own = table("benchmark").select("text").union(table("conversations").where("role = 'user'").select("text"))
    return V.document_frequency(table("documents"), F.col("text"), V.tokens_of(own, F.col("text")))


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents) WHERE length(word) > 0 GROUP BY 1""".replace("\\\\", "\\"))
def word_count(spark, table):
    return X.word_counts(table("documents"), F.col("text"))


@query("""WITH t AS (SELECT role, text, min(conv_id * 1000 + turn) AS id FROM conversations GROUP BY 1, 2), s AS (SELECT role, id, lower(regexp_replace(text, '\\s+', '', 'g')) AS t FROM t),
g AS (SELECT role, id, list_distinct(list_transform(range(1, length(t)), lambda i: t[i:i+1])) AS g FROM s WHERE length(t) > 1)
SELECT a.role, a.id AS a, b.id AS b, len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))) AS similarity FROM g a JOIN g b ON a.role = b.role AND a.id < b.id
WHERE len(a.g) >= 0.75 * len(b.g) AND len(b.g) >= 0.75 * len(a.g) AND len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))) >= 0.75""")
def jaccard_near_dup(spark, table):
    """Different texts of one role; equal ones count once, under their first place."""
    once = table("conversations").groupBy("role", "text").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return X.similar_texts(once, id_col="id", text=F.col("text"), group=["role"], least=0.75)


@query("""WITH t AS (SELECT unnest(['licence', 'widgets', 'q', 'xq']) AS target) SELECT target, count(*) FILTER (CASE WHEN length(target) = 1 THEN contains(text, target)
  ELSE len(list_filter(range(1, length(target)), lambda i: contains(text, target[i:i+1]))) > 0 END) AS hits FROM documents, t GROUP BY 1""")
def fuzzy_target(spark, table):
    targets = ["licence", "widgets", "q", "xq"]
    hits = table("documents").agg(*[F.count_if(C.fuzzy_hit(F.lit(t), F.col("text"))).alias(t) for t in targets])
    return hits.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("hits")) for t in targets])).alias("x")).select("x.*")


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?s)<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages""")
def html_to_text(spark, table):
    return table("pages").select("page_id", C.html_to_text(F.col("html")).alias("text"))


@query(r"""SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages""")
def url_params(spark, table):
    params = C.url_parameters(F.col("url"))
    return table("pages").select("page_id", F.nullif(F.try_element_at(params, F.lit("page")), F.lit("")).alias("page"), F.nullif(F.try_element_at(params, F.lit("ref")), F.lit("")).alias("ref"))


@query("""SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1""")
def json_props(spark, table):
    return table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("k"))


@query("""SELECT doc_id, 'd_' || substr(sha256(source || '|' || doc_id), 1, 24) AS short_id, sha1(coalesce(source, '') || chr(10) || coalesce(lang, '')) AS fingerprint FROM documents""")
def sha_ids(spark, table):
    return table("documents").select("doc_id", C.short_id("d_", F.concat_ws("|", "source", F.col("doc_id").cast("string"))).alias("short_id"), C.fingerprint(F.col("source"), F.col("lang")).alias("fingerprint"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderpriority <> '5-LOW'), n AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 2 = 0 THEN 'N' END AS status, o_totalprice + 1 AS price FROM orders WHERE o_orderstatus <> 'F') SELECT coalesce(n.k, o.k) AS k, coalesce(n.status, o.status) AS status, coalesce(n.price, o.price) AS price FROM o FULL JOIN n ON o.k = n.k""")
def upsert_merge(spark, table):
    orders = table("orders")
    old = orders.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_custkey") % 2 == 0, "N").alias("status"), (F.col("o_totalprice") + 1).alias("price"))
    return D.upsert(old, new, ["k"])


@query("""WITH k AS (SELECT lang || '|' || source AS signal_key, count(*) AS frequency, min(doc_id) AS first_seq FROM documents GROUP BY 1) SELECT 's' || lpad((row_number() OVER (ORDER BY frequency DESC, signal_key))::VARCHAR, 4, '0') AS signal_id, signal_key, frequency, first_seq FROM k""")
def signal_frequency(spark, table):
    return A.signal_frequencies(table("documents"), kind="lang", text=F.col("source"), seq="doc_id")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2) SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_id) AS r FROM c) WHERE r = 1""")
def majority_label(spark, table):
    return A.majority(table("events"), "user_id", "event_type", "event_id")


@query("""SELECT c_mktsegment AS theme_id, count(*) AS records, count(DISTINCT c_nationkey) AS users, count(DISTINCT c_custkey % 7) AS videos FROM customer GROUP BY 1""")
def theme_statistics(spark, table):
    customers = table("customer")
    themes = customers.select(F.col("c_mktsegment").alias("theme_id"), F.array("c_custkey").alias("signal_ids"))
    members = A.theme_members(themes)
    signals = customers.select(F.col("c_custkey").alias("signal_id"), F.col("c_custkey").alias("record_id"), F.col("c_nationkey").alias("user_key"), (F.col("c_custkey") % 7).alias("video_id"))
    return A.theme_statistics(members, signals)


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_totalprice < 20000 THEN 'too_small' WHEN o_orderstatus = 'F' THEN 'processed' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'passed' END AS reason FROM orders) GROUP BY 1""")
def funnel_reasons(spark, table):
    return A.funnel(table("orders"), [("too_small", F.col("o_totalprice") < 20000), ("processed", F.col("o_orderstatus") == "F"), ("low", F.col("o_orderpriority") == "5-LOW")])


@query("""SELECT o_orderkey, CASE WHEN age <= 48 THEN 'A' WHEN age <= 168 THEN 'B' ELSE 'stale' END AS lane FROM (SELECT o_orderkey, greatest(0, (epoch(TIMESTAMP '2001-08-01') - epoch(o_orderdate)) / 3600.0) AS age FROM orders)""")
def freshness_lanes(spark, table):
    now = F.unix_timestamp(F.lit("2001-08-01 00:00:00"))
    return table("orders").select("o_orderkey", C.freshness(F.unix_timestamp("o_orderdate"), now).alias("lane"))


@query("""WITH c AS (SELECT 'claim' || l_linenumber AS claim_id, l_orderkey AS record_id, l_linenumber AS item_id FROM lineitem), i AS (SELECT o_orderkey AS record_id, n AS item_id FROM orders, (VALUES (1), (2), (3)) v(n) WHERE o_orderstatus <> 'P') SELECT CASE WHEN i.item_id IS NOT NULL THEN 'kept' WHEN r.record_id IS NOT NULL THEN 'unknown_item' ELSE 'unknown_record' END AS verdict, count(*) AS n FROM c LEFT JOIN i ON c.record_id = i.record_id AND c.item_id = i.item_id LEFT JOIN (SELECT DISTINCT record_id FROM i) r ON c.record_id = r.record_id GROUP BY 1""")
def reference_resolution(spark, table):
    claims = table("lineitem").select(F.concat(F.lit("claim"), F.col("l_linenumber").cast("string")).alias("claim_id"), F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("item_id"))
    items = table("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("record_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("item_id"))
    return J.resolve_references(claims, items).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, score, CASE WHEN score >= 5 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS priority FROM (SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 2 WHEN c_nationkey % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN c_acctbal > 5000 THEN 2 ELSE 0 END + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END + CASE WHEN c_mktsegment = 'MACHINERY' THEN 2 WHEN c_acctbal > 9000 THEN 2 ELSE 0 END AS score FROM customer)""")
def lead_scores(spark, table):
    some = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    third = F.col("c_nationkey") % 3
    evidence = F.when(third == 0, "continued").when(third == 1, "tried").otherwise("none")
    score = C.lead_score(evidence, some(F.col("c_acctbal") > 5000), F.col("c_acctbal") < 0, some(F.col("c_mktsegment") == "BUILDING"), some(F.lit(False)), F.when(F.col("c_mktsegment") == "MACHINERY", "stopped").otherwise("none"), F.col("c_acctbal") > 9000)
    return table("customer").select("c_custkey", score.alias("score")).withColumn("priority", C.lead_priority(F.col("score")))


@query("""SELECT p_partkey, last_value(tag IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tag FROM (SELECT p_partkey, p_brand, CASE WHEN p_size > 40 THEN p_name END AS tag FROM part)""")
def forward_fill(spark, table):
    rows = table("part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 40, F.col("p_name")).alias("tag"))
    return R.forward_fill(rows, ["p_brand"], [F.asc("p_partkey")], "tag").select("p_partkey", "tag")


@query("""SELECT source, chunk, count(*) AS n, min(doc_id) AS first_id FROM (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 100 AS chunk FROM documents) GROUP BY 1, 2""")
def batch_chunks(spark, table):
    rows = R.chunked(table("documents").select("source", "doc_id"), ["source"], [F.asc("doc_id")], 100)
    return rows.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING epoch(TIMESTAMP '2024-01-31') - max(floor(epoch(ts))) < 24 * 3600)""")
def cooldown_filter(spark, table):
    actions = table("events").select(F.col("user_id").alias("o_custkey"), F.unix_timestamp("ts").alias("at"))
    return J.off_cooldown(table("orders").select("o_orderkey", "o_custkey"), actions, "o_custkey", F.unix_timestamp(F.lit("2024-01-31 00:00:00")), 24)


@query("""SELECT l_shipmode, count(*) AS n, avg(v) AS mean, median(v) AS median, list_sort(list(v))[round_even(0.95 * (count(*) - 1), 0)::BIGINT + 1] AS p95 FROM (SELECT l_returnflag AS l_shipmode, l_quantity AS v FROM lineitem) GROUP BY 1""".replace("l_shipmode", "flag"))
def latency_profile(spark, table):
    return A.latency_profile(table("lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity"), ["flag"], "l_quantity")


@query("""SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, sum(length(coalesce(text, '')))::BIGINT AS chars, max(n_chars) AS longest FROM documents GROUP BY 1""")
def channel_summary(spark, table):
    return A.group_summary(table("documents"), ["lang"], distinct={"sources": F.col("source")}, sums={"chars": F.length(F.coalesce("text", F.lit("")))}, tops={"longest": F.col("n_chars")})


@query("""SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') AS before, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus IN ('F', 'P')) AS after, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus IN ('F', 'P')) - (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') AS added""")
def merge_growth(spark, table):
    orders = table("orders")
    return D.merge_counts(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"), "o_custkey")


@query("""SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS replies, count(*) FILTER (turn = 0) AS roots FROM conversations GROUP BY 1""")
def reply_structure(spark, table):
    return A.reply_structure(table("conversations"), "conv_id", reply=F.col("role") == "assistant", parent="turn")


for _module in (evidence_queries, item_queries, listing_queries, outreach_queries, reader_queries, report_queries, stream_queries):
    assert _module  # importing them registers their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
