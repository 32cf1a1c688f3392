"""Queries over catalogues, reports and small lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import listing as L
from threadloom.plans.registry import query

SIGNALS = ("needs_plan", "stopped_using", "howto_uncertainty", "gratitude")
QUOTES = ("谢谢 真的有用", "怎么安排 做计划", "我太懒 坚持不", "帮我看 哪里不对", "短")
SCORED_SQL = f"""s AS (SELECT 'H' || (l_suppkey % 3 + 1) AS hypothesis_id, CASE WHEN l_linenumber % 2 = 0 THEN 'supports' ELSE 'weakens' END AS relation,
  {list(QUOTES)}[l_partkey % 5 + 1] || CASE WHEN l_partkey % 5 < 4 THEN ' ' || (l_partkey % 9) ELSE '' END AS quote, {list(SIGNALS)}[l_orderkey % 4 + 1] AS signal,
  CASE l_returnflag WHEN 'A' THEN 'question' WHEN 'N' THEN 'check_in' ELSE 'gratitude_recognition' END AS intent, CASE l_linestatus WHEN 'F' THEN 'video_sufficient' ELSE 'unclear' END AS video FROM lineitem),
p AS (SELECT *, CASE WHEN length(trim(quote)) < 4 THEN -10 ELSE 0.5::DOUBLE + least(length(quote), 60) / 60.0::DOUBLE
  - CASE WHEN intent = 'gratitude_recognition' THEN 1.5 ELSE 0 END - CASE WHEN contains(quote, '谢谢') THEN 1 ELSE 0 END
  + CASE WHEN hypothesis_id = 'H1' AND relation = 'supports' THEN CASE WHEN signal IN ('needs_plan', 'howto_uncertainty') THEN 2 ELSE 0 END + CASE WHEN intent = 'check_in' THEN 1 ELSE 0 END
        - CASE WHEN intent = 'question' AND signal NOT IN ('needs_plan', 'howto_uncertainty') THEN 1.5 ELSE 0 END
    WHEN hypothesis_id = 'H1' THEN CASE WHEN signal = 'stopped_using' THEN 2 ELSE 0 END + CASE WHEN contains(quote, '懒') THEN 1.5 ELSE 0 END
        - CASE WHEN signal IN ('needs_plan', 'howto_uncertainty') THEN 1.5 ELSE 0 END - CASE WHEN contains(quote, '谢谢') THEN 3 ELSE 0 END
    WHEN hypothesis_id = 'H2' AND relation = 'supports' THEN CASE WHEN signal = 'howto_uncertainty' THEN 1.5 ELSE 0 END - CASE WHEN intent = 'question' THEN 2 ELSE 0 END + CASE WHEN contains(quote, '帮我看') THEN 2 ELSE 0 END
    WHEN hypothesis_id = 'H2' THEN CASE WHEN video = 'video_sufficient' THEN 2 ELSE 0 END - CASE WHEN intent = 'gratitude_recognition' OR contains(quote, '谢谢') THEN 3 ELSE 0 END
    WHEN relation = 'supports' THEN CASE WHEN signal = 'needs_plan' THEN 2 ELSE 0 END + CASE WHEN contains(quote, '怎么安排') THEN 1.5 ELSE 0 END - CASE WHEN intent = 'question' AND NOT contains(quote, '安排') THEN 1 ELSE 0 END
    ELSE 0 END END AS score FROM s)"""


@query(f"""WITH {SCORED_SQL}, o AS (SELECT hypothesis_id, relation, quote, max(score) AS score FROM p WHERE score >= 0 GROUP BY 1, 2, 3)
SELECT hypothesis_id, relation, quote, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY hypothesis_id, relation ORDER BY round(score, 9) DESC, length(quote) DESC, quote) AS rank FROM o) WHERE rank <= 5""")
def hypothesis_quotes(spark, table):
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    kind = F.col("l_partkey") % 5
    rows = table("lineitem").select(
        F.concat(F.lit("H"), (F.col("l_suppkey") % 3 + 1).cast("string")).alias("hypothesis_id"),
        F.when(F.col("l_linenumber") % 2 == 0, "supports").otherwise("weakens").alias("relation"),
        F.concat(pick(QUOTES, kind), F.when(kind < 4, F.concat(F.lit(" "), (F.col("l_partkey") % 9).cast("string"))).otherwise("")).alias("quote"),
        F.array(pick(SIGNALS, F.col("l_orderkey") % 4)).alias("signals"),
        F.when(F.col("l_returnflag") == "A", "question").when(F.col("l_returnflag") == "N", "check_in").otherwise("gratitude_recognition").alias("intent"),
        F.when(F.col("l_linestatus") == "F", "video_sufficient").otherwise("unclear").alias("video"),
    )
    score = L.quote_score(F.col("hypothesis_id"), F.col("relation"), F.col("quote"), F.col("intent"), F.col("signals"), F.col("video"), F.lit(0.5))
    found = L.representative_quotes(rows.withColumn("score", F.round(score, 9)))
    return found.select("hypothesis_id", "relation", "quote", F.round("score", 6).alias("score"), "rank")


@query("""SELECT c_custkey, CASE WHEN p = '' THEN '暂无足够线索判断调研价值，需核对原评论' ELSE p END AS reason FROM (SELECT c_custkey, concat_ws('；', CASE WHEN c_nationkey % 3 = 0 THEN '有真实行为证据' END, CASE WHEN c_acctbal < 0 THEN '主动求助' END,
CASE WHEN c_mktsegment = 'BUILDING' THEN '具体问题：a；b' END, CASE WHEN c_acctbal > 9000 THEN '可供调研的具体线索较多（不代表产品匹配）' END) AS p FROM customer)""")
def contact_reasons(spark, table):
    none = F.array().cast("array<string>")
    problems = F.when(F.col("c_mktsegment") == "BUILDING", F.array(*[F.lit(x) for x in "abc"])).otherwise(none)
    reason = L.contact_reason(F.when(F.col("c_nationkey") % 3 == 0, "tried").otherwise("none"), F.col("c_acctbal") < 0, problems, F.when(F.col("c_acctbal") > 9000, 5).otherwise(0), none)
    return table("customer").select("c_custkey", reason.alias("reason"))


@query("""WITH m AS (SELECT doc_id, list_filter(['licence', 'zq'], lambda t: len(list_filter(range(1, length(t)), lambda i: contains(lower(text), t[i:i+1]))) > 0) AS m FROM documents)
SELECT doc_id, array_to_string(m, ',') AS matches, (len(m) * 3 + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END)::INT AS relevance FROM m""")
def research_targets(spark, table):
    matches = L.research_matches(["licence", "zq"], F.col("text"), F.lit(""))
    rows = table("documents").select("doc_id", matches.alias("m"))
    score = L.relevance(F.col("m"), F.col("doc_id") % 2 == 0, F.array().cast("array<string>"), F.lit("none"))
    return rows.select("doc_id", F.array_join("m", ",").alias("matches"), score.alias("relevance"))


@query("""SELECT count(*) AS total, count(DISTINCT event_type) AS channels, count(DISTINCT user_id % 50) AS videos, count(DISTINCT CASE WHEN user_id % 4 > 0 THEN user_id END) AS authors, count(*) FILTER (event_id % 3 = 0) AS replies FROM events""")
def comment_totals(spark, table):
    user = F.col("user_id")
    rows = table("events").select(
        F.col("event_type").alias("channel"), (user % 50).alias("video_id"), F.when(user % 4 > 0, user.cast("string")).otherwise("").alias("user_id"), F.when(F.col("event_id") % 3 == 0, "p").otherwise("").alias("parent_comment_id")
    )
    return L.comment_summary(rows)


@query("""WITH n AS (SELECT user_id AS video_id, count(*) AS n FROM events GROUP BY 1), v AS (SELECT video_id, row_number() OVER (ORDER BY n DESC, video_id) AS video_rank FROM n ORDER BY video_rank LIMIT 8)
SELECT event_id, video_id, video_rank, rank FROM (SELECT event_id, video_id, video_rank, row_number() OVER (PARTITION BY video_id ORDER BY value DESC, event_id) AS rank FROM events JOIN v ON user_id = video_id) WHERE rank <= 8""")
def top_video_comments(spark, table):
    rows = table("events").select("event_id", F.col("user_id").alias("video_id"), F.col("value").alias("likes"))
    return L.top_comments_of_top_videos(rows, "event_id").select("event_id", "video_id", "video_rank", "rank")


FILES_SQL = """f AS (SELECT '/data/' || CASE doc_id % 3 WHEN 0 THEN 'bili' WHEN 1 THEN 'xhs' ELSE 'misc' END || '/' || source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'secret_' ELSE 'f' END || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.JSONL' ELSE '.csv' END AS path,
  n_chars AS size, doc_id % 3 AS k, doc_id FROM documents)"""


def _files(table):
    k = F.col("doc_id") % 3
    path = F.concat(
        F.lit("/data/"), F.when(k == 0, "bili").when(k == 1, "xhs").otherwise("misc"), F.lit("/"), "source", F.lit("/"), F.when(F.col("doc_id") % 7 == 0, "secret_").otherwise("f"),
        F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".JSONL").otherwise(".csv"),
    )
    return table("documents").select(path.alias("path"), F.col("n_chars").alias("size"))


@query(f"""WITH {FILES_SQL} SELECT lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS kind, CASE k WHEN 0 THEN 'bili' WHEN 1 THEN 'xhs' ELSE 'other' END AS platform, count(*) AS files, sum(size)::BIGINT AS bytes FROM f WHERE path IS NOT NULL GROUP BY 1, 2""")
def file_statistics(spark, table):
    return L.file_statistics(_files(table).where("path IS NOT NULL"), ["xhs", "bili"])


@query(f"""WITH {FILES_SQL} SELECT path FROM f WHERE k = 0 AND doc_id % 2 = 1 AND doc_id % 7 <> 0 AND path IS NOT NULL""")
def browsable_files(spark, table):
    return L.browsable(_files(table), ["/data/bili"], ["csv"], ["secret"]).select("path")


@query(f"""WITH {FILES_SQL} SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS files FROM f WHERE path IS NOT NULL GROUP BY 1""")
def parent_folders(spark, table):
    return L.parent_folders(_files(table).where("path IS NOT NULL"))


@query("""SELECT doc_id FROM documents WHERE contains(lower(source || chr(10) || lang || chr(10)), 'en') ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 10""")
def notes_page(spark, table):
    notes = table("documents").select("doc_id", "n_chars", F.col("source").alias("title"), F.col("lang").alias("author"), F.lit(None).cast("string").alias("keyword"))
    return L.notes_page(notes, "EN", [F.desc("n_chars"), F.asc("doc_id")], 50, 10).select("doc_id")


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders""")
def status_counts(spark, table):
    return L.status_counts(table("orders"), ["F", "O", "P"], "o_orderstatus")


@query("""WITH r AS (SELECT o_orderkey AS id, (o_custkey % 97)::DOUBLE / floor(o_totalprice / 1000) AS ratio FROM orders WHERE floor(o_totalprice / 1000) >= 200)
SELECT * FROM (SELECT id, ratio, row_number() OVER (ORDER BY ratio DESC, id) AS rank, 'top' AS side FROM r ORDER BY rank LIMIT 12)
UNION ALL SELECT * FROM (SELECT id, ratio, row_number() OVER (ORDER BY ratio, id) AS rank, 'bottom' AS side FROM r ORDER BY rank LIMIT 6)""")
def engagement_ratios(spark, table):
    notes = table("orders").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 1000).alias("likes"), (F.col("o_custkey") % 97).alias("comments"))
    return L.engagement_ratios(notes).select("id", "ratio", "rank", "side")


@query("""WITH e AS (SELECT p_brand AS axis, lower(trim(p_name)) AS k, count(*) AS n, count(*) FILTER (p_size > 25) AS s FROM part GROUP BY 1, 2)
SELECT axis, sum(n)::BIGINT AS keywords, count(*) AS different, count(*) FILTER (n > 1) AS repeated, sum(s)::BIGINT AS signals FROM e GROUP BY 1""")
def axis_coverage(spark, table):
    keywords = table("part").select(F.col("p_brand").alias("axis"), F.col("p_name").alias("keyword"), F.when(F.col("p_size") > 25, "signal").otherwise("none").alias("verdict"))
    return L.axis_coverage(keywords)


@query("""WITH c AS (SELECT l_suppkey AS finding_id, count(DISTINCT l_orderkey % 101) AS users, count(DISTINCT l_orderkey) AS records, count(DISTINCT l_partkey) AS refs FROM lineitem GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY users DESC, records DESC, refs DESC, finding_id) AS rank FROM c ORDER BY rank LIMIT 5""")
def top_findings(spark, table):
    rows = table("lineitem").select(F.col("l_suppkey").alias("finding_id"), (F.col("l_orderkey") % 101).alias("user_key"), F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("ref"))
    return L.top_findings(rows)


@query("""WITH f AS (SELECT event_type AS type, (user_id % 20)::VARCHAR AS text, min(event_id) AS first_seq FROM events GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY first_seq, type, text) AS rank FROM f ORDER BY rank LIMIT 10""")
def first_new_signals(spark, table):
    rows = table("events").select(F.col("event_type").alias("type"), (F.col("user_id") % 20).cast("string").alias("text"), "event_id")
    return L.first_new_signals(rows, "event_id")


@query("""WITH n AS (SELECT s_suppkey, s_nationkey * 10 AS rows, s_suppkey % 10 AS modified FROM supplier), b AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey * 7 WHEN s_suppkey % 3 = 1 THEN 10000 END AS before FROM supplier WHERE s_suppkey % 3 < 2),
l AS (SELECT n.*, CASE WHEN before IS NULL OR rows < before THEN 0 ELSE before END AS base FROM n LEFT JOIN b USING (s_suppkey) WHERE modified >= 4)
SELECT greatest(sum(greatest(0, rows - base)), arg_max(rows, {'m': modified, 'k': lpad(s_suppkey::VARCHAR, 9, '0')}))::BIGINT AS rows, sum(greatest(0, rows - base))::BIGINT AS added, arg_max(rows, {'m': modified, 'k': lpad(s_suppkey::VARCHAR, 9, '0')})::BIGINT AS newest FROM l""")
def session_rows(spark, table):
    key = F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("path")
    now = table("supplier").select(key, (F.col("s_nationkey") * 10).cast("long").alias("rows"), (F.col("s_suppkey") % 10).alias("modified"))
    third = F.col("s_suppkey") % 3
    before = table("supplier").where(third < 2).select(key, F.when(third == 0, F.col("s_nationkey") * 7).otherwise(10_000).cast("long").alias("rows"))
    return L.session_rows(now, before, F.lit(4))


@query("""SELECT o_orderkey AS video_id, 4 AS target, coalesce(have, 0) AS have, coalesce(have, 0) < 4 * 0.95 AS restart FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS have FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def restart_decisions(spark, table):
    collected = table("lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_partkey").alias("comment_id"))
    return L.restart_wanted(collected, table("orders").select(F.col("o_orderkey").alias("video_id"), F.lit(4).alias("target")))


@query("""SELECT c_custkey AS id, 'old' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0""")
def insert_if_new(spark, table):
    own = lambda n, origin: table("customer").where(f"c_custkey % {n} = 0").select(F.col("c_custkey").alias("id"), F.lit(origin).alias("origin"))
    return L.insert_new(own(2, "old"), own(3, "new").union(own(3, "new")), "id")


@query("""SELECT s_suppkey AS run_id, CASE WHEN s_suppkey % 2 = 0 THEN 'index' ELSE 'folder' END AS origin FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0""")
def runs_list(spark, table):
    own = lambda n, origin: table("supplier").where(f"s_suppkey % {n} = 0").select(F.col("s_suppkey").alias("run_id"), F.lit(origin).alias("origin"), F.col("s_nationkey").alias("created_at"))
    return L.runs_list(own(2, "index"), own(3, "folder")).select("run_id", "origin")


@query("""SELECT o_orderkey, CASE WHEN done >= 40 THEN 100 ELSE least(99, done * 100 // 40) END AS pct, (greatest(0, 40 - done) * 3)::BIGINT AS seconds FROM (SELECT o_orderkey, o_custkey % 50 AS done FROM orders)""")
def eta_seconds(spark, table):
    left = L.eta(F.col("o_custkey") % 50, F.lit(40), F.lit(None).cast("double"), 3.0)
    return table("orders").select("o_orderkey", left["pct"].alias("pct"), left["seconds"].alias("seconds"))


@query("""SELECT event_type, n FROM (SELECT event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1) ORDER BY n DESC, f LIMIT 1""")
def top_label(spark, table):
    return L.top_label(table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("f")), "event_type", "f")


@query("""SELECT regexp_replace(p_name, '\\s+', '_', 'g') || '_' || p_partkey AS folder, s_name AS creator, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = p_size GROUP BY 1, 2""")
def reorganised_folders(spark, table):
    videos = table("part").select(F.col("p_partkey").alias("video_id"), F.col("p_name").alias("title"), F.col("p_size").cast("long").alias("user_id"))
    creators = table("supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("nickname"))
    rows = L.reorganised(videos, table("lineitem").select(F.col("l_partkey").alias("video_id")), creators)
    return rows.groupBy("folder", "creator").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT c_custkey, substr(md5('seed|' || c_custkey), 1, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') AS swapped, '{"v":"' || c_mktsegment || '"}' AS l, '{"v":"' || c_name || '"}' AS e FROM customer)
SELECT c_custkey, CASE WHEN swapped THEN e ELSE l END AS a, CASE WHEN swapped THEN l ELSE e END AS b, swapped FROM r""")
def blind_rows(spark, table):
    own = lambda c: table("customer").select("c_custkey", F.col(c).alias("v"))
    return L.blind_rows(own("c_mktsegment"), own("c_name"), "c_custkey", "seed")


@query("""SELECT 'hit' AS kind, count(*) AS n FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT 'compute', count(*) FROM orders WHERE o_custkey % 2 = 1""")
def result_cache(spark, table):
    orders = table("orders")
    cache = orders.select(F.sha1(F.col("o_custkey").cast("string")).alias("fingerprint"), F.when(F.col("o_custkey") % 2 == 0, "card").otherwise("").alias("result"))
    hit, rest = L.cached_results(orders, cache, F.sha1(F.col("o_custkey").cast("string")))
    return hit.agg(F.count(F.lit(1)).alias("n")).select(F.lit("hit").alias("kind"), "n").union(rest.agg(F.count(F.lit(1)).alias("n")).select(F.lit("compute"), "n"))


@query("""SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS rank FROM events ORDER BY event_id DESC LIMIT 25""")
def ledger_tail(spark, table):
    return L.newest_first_ledger(table("events").select("event_id", F.col("event_id").alias("seq")), 25).select("event_id", "rank")


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size END AS published, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS title FROM part), o AS (SELECT p_partkey, p_brand AS title FROM part WHERE p_partkey % 3 = 0),
f AS (SELECT p_partkey, row_number() OVER (ORDER BY published, p_partkey) AS rank_early FROM n WHERE published IS NOT NULL ORDER BY rank_early LIMIT 20)
SELECT n.p_partkey, coalesce(n.title, o.title) AS title, rank_early, rank_early IS NOT NULL AS early FROM n LEFT JOIN o USING (p_partkey) LEFT JOIN f USING (p_partkey)""")
def refreshed_catalogue(spark, table):
    part = table("part")
    new = part.select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size")).alias("published"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("title"))
    old = part.where("p_partkey % 3 = 0").select("p_partkey", F.col("p_brand").alias("title"))
    return L.refreshed_catalogue(new, old, "p_partkey", ["title"]).select("p_partkey", "title", "rank_early", "early")


@query("""SELECT n_name AS profile_id FROM nation WHERE n_nationkey = 7""")
def chosen_profile(spark, table):
    profiles = table("nation").select(F.col("n_name").alias("profile_id"), (F.col("n_nationkey") == 7).alias("active"), (F.col("n_nationkey") == 0).alias("built_in"))
    return L.chosen_profile(profiles, "none of these").select("profile_id")
