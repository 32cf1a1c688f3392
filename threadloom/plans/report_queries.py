"""The statistics page and the lead list over the events, read as analysed comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import run_report as P
from threadloom.operators import scoping
from threadloom.plans.reader_queries import AS_IS
from threadloom.plans.registry import query
from threadloom.scratch import Scratch
from threadloom.sources import exports, readers

#: Events as analysed comments: labels by type and by the number k of their properties.
ANALYSED = """a AS (SELECT event_id AS seq, event_id::VARCHAR AS record_id, user_id, (props->>'$.k')::BIGINT AS k, event_type FROM events), r AS (SELECT *,
CASE WHEN user_id % 7 > 0 THEN 'id:bili:' || user_id END AS user_key, CASE WHEN k % 2 = 0 THEN 'n' || user_id ELSE '' END AS username, CASE WHEN k % 3 > 0 THEN 'video ' || k ELSE '' END AS video_title, 'f' || (user_id % 11) AS source_file,
CASE WHEN k % 5 > 0 THEN 'c' || (k % 9) ELSE '' END AS creator_name, CASE WHEN k % 4 > 0 THEN event_type ELSE '' END AS creator_type, CASE WHEN k % 6 = 0 THEN 'h' || user_id ELSE '' END AS homepage_url, 'u' || (k % 40) AS comment_url, event_type || ' said ' || k AS comment_text,
['low', 'medium', 'high'][k % 3 + 1] AS contactability, CASE event_type WHEN 'view' THEN 'question' WHEN 'click' THEN 'check_in' WHEN 'error' THEN 'difficulty_help_request' WHEN 'purchase' THEN 'result_feedback' ELSE 'unknown' END AS primary_intent,
CASE WHEN k % 8 = 0 THEN [] WHEN k % 3 = 0 THEN ['gratitude', 'needs_plan', 'gratitude'] ELSE ['needs_plan'] END AS signals, ['none', 'planned', 'tried', 'continued'][k % 4 + 1] AS evidence,
['video_sufficient', 'personalized_judgment_needed', 'realtime_observation_needed', ''][k % 4 + 1] AS relation, ['unclear', 'low', 'medium', 'high'][(k // 4) % 4 + 1] AS product_fit, CASE WHEN k % 2 = 0 THEN ['p' || (k % 12), ''] ELSE [] END AS problems, k % 5 = 0 AS help_seeking,
CASE WHEN k % 7 = 0 THEN 'stopped' ELSE 'none' END AS impact, CASE WHEN k % 3 = 0 THEN 'supports' WHEN k % 3 = 1 THEN 'weakens' ELSE 'odd' END AS h1, CASE WHEN k % 4 = 0 THEN 'irrelevant' ELSE 'insufficient' END AS h2 FROM a),
s AS (SELECT *, CASE evidence WHEN 'continued' THEN 2 WHEN 'tried' THEN 1 ELSE 0 END + CASE WHEN len(problems) > 0 THEN 2 ELSE 0 END + help_seeking::INT + CASE WHEN impact = 'stopped' THEN 2 ELSE 0 END AS score, coalesce(nullif(creator_type, ''), '未知') AS maker FROM r)"""


def _analysed(table) -> DataFrame:
    k, text = F.col("k"), lambda *cs: F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in cs])
    of = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    pick = lambda c, v: F.when(c, v).otherwise("")
    none = F.array().cast("array<string>")
    rows = table("events").select(F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("record_id"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")
    intents = F.create_map(*[F.lit(x) for kv in {"view": "question", "click": "check_in", "error": "difficulty_help_request", "purchase": "result_feedback"}.items() for x in kv])
    relation = F.when(k % 3 == 0, "supports").when(k % 3 == 1, "weakens").otherwise("odd")
    said = F.array(F.struct(F.lit("H1").alias("hypothesis_id"), relation.alias("relation")), F.struct(F.lit("H2").alias("hypothesis_id"), F.when(k % 4 == 0, "irrelevant").otherwise("insufficient").alias("relation")))
    return rows.select(
        "seq", "record_id", F.when(F.col("user_id") % 7 > 0, text("id:bili:", F.col("user_id"))).alias("user_key"), F.lit("").alias("user_id"), pick(k % 2 == 0, text("n", F.col("user_id"))).alias("username"),
        F.lit("bili").alias("platform"), pick(k % 3 > 0, text("video ", k)).alias("video_title"), text("f", F.col("user_id") % 11).alias("source_file"), pick(k % 5 > 0, text("c", k % 9)).alias("creator_name"),
        pick(k % 4 > 0, F.col("event_type")).alias("creator_type"), pick(k % 6 == 0, text("h", F.col("user_id"))).alias("homepage_url"), text("u", k % 40).alias("comment_url"), text(F.col("event_type"), " said ", k).alias("comment_text"),
        of(("low", "medium", "high"), k % 3).alias("contactability"), F.coalesce(F.try_element_at(intents, F.col("event_type")), F.lit("unknown")).alias("primary_intent"),
        F.when(k % 8 == 0, none).when(k % 3 == 0, F.array(F.lit("gratitude"), F.lit("needs_plan"), F.lit("gratitude"))).otherwise(F.array(F.lit("needs_plan"))).alias("signals"),
        of(P.EVIDENCE_ORDER, k % 4).alias("evidence"), of(("video_sufficient", "personalized_judgment_needed", "realtime_observation_needed", ""), k % 4).alias("relation"), of(P.FIT_ORDER, F.floor(k / 4) % 4).alias("product_fit"),
        F.when(k % 2 == 0, F.array(text("p", k % 12), F.lit(""))).otherwise(none).alias("problems"), (k % 5 == 0).alias("help_seeking"), none.alias("costs"), none.alias("gaps"),
        F.when(k % 7 == 0, "stopped").otherwise("none").alias("impact"), F.lit(False).alias("paid_help"), said.alias("hypotheses"),
    )


PCT = "floor(n * 100.0::DOUBLE / (SELECT count(*) FROM s) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE"
MEASURES = {
    "total_analyzed": "count(*)", "total_records": "count(*)", "product_fit_unassessed_count": "count(*)", "valid_comments": "count(*) FILTER (primary_intent <> 'unknown')", "gratitude_signal_count": "count(*) FILTER (list_contains(signals, 'gratitude'))",
    "check_in_count": "count(*) FILTER (primary_intent = 'check_in')", "result_feedback_count": "count(*) FILTER (primary_intent = 'result_feedback')", "question_count": "count(*) FILTER (primary_intent = 'question')",
    "difficulty_count": "count(*) FILTER (primary_intent = 'difficulty_help_request')", "personalized_needed_count": "count(*) FILTER (relation = 'personalized_judgment_needed')", "realtime_needed_count": "count(*) FILTER (relation = 'realtime_observation_needed')",
    "product_fit_high_count": "count(*) FILTER (product_fit = 'high')", "high_priority_candidate_comment_count": "count(*) FILTER (score >= 5)", "contactable_homepage_count": "count(*) FILTER (contactability = 'high')",
    "unique_users": "count(DISTINCT user_key)", "trained_users": "count(DISTINCT user_key) FILTER (evidence IN ('tried', 'continued'))", "high_priority_user_count": "count(DISTINCT user_key) FILTER (score >= 5)",
    "source_video_count": "count(DISTINCT coalesce(nullif(video_title, ''), source_file))", "source_creator_count": "count(DISTINCT nullif(creator_name, ''))", "source_file_count": "count(DISTINCT source_file)",
}
_LABELS = " UNION ALL ".join(
    f"SELECT '{section}', key, count(*) AS n FROM (SELECT {value} AS key FROM s) GROUP BY 2"
    for section, value in (("primary_intent", "primary_intent"), ("signal", "unnest(list_distinct(signals))"), ("single_video", "coalesce(nullif(relation, ''), 'unclear')"), ("product_fit", "product_fit"))
)


@query(
    f"WITH {ANALYSED}, l(section, key, n) AS ({_LABELS}), h AS (SELECT 'H1' AS hid, h1 AS rel, user_key, maker FROM s UNION ALL SELECT 'H2', h2, user_key, maker FROM s), g AS (SELECT hid, rel FROM (VALUES ('H1'), ('H2'), ('H3')) a(hid), (VALUES ('supports'), ('weakens'), ('insufficient'), ('irrelevant')) b(rel)),"
    f" c AS (SELECT g.hid, g.rel, count(h.hid) AS n, count(DISTINCT user_key) AS users FROM g LEFT JOIN h ON g.hid = h.hid AND g.rel = h.rel GROUP BY 1, 2) SELECT section, key, n, {PCT} AS pct, NULL::BIGINT AS users FROM l"
    " UNION ALL SELECT 'single_video', key, 0, 0.0::DOUBLE, NULL FROM (VALUES ('video_sufficient'), ('one_reply_sufficient'), ('personalized_judgment_needed'), ('realtime_observation_needed'), ('unclear')) v(key) WHERE key NOT IN (SELECT key FROM l WHERE section = 'single_video')"
    " UNION ALL SELECT 'hypothesis', hid || '|' || rel, n, NULL, users FROM c UNION ALL SELECT 'hypothesis_by_creator', h.hid || '|' || maker || '|' || h.rel, count(*), NULL, NULL FROM h JOIN g ON h.hid = g.hid AND h.rel = g.rel GROUP BY 2"
    " UNION ALL SELECT 'contradiction', hid, w, floor(w * 100.0::DOUBLE / a * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE, NULL FROM (SELECT hid, sum(n) FILTER (rel = 'weakens')::BIGINT AS w, sum(n)::BIGINT AS a FROM c GROUP BY 1) WHERE w > 0"
    + "".join(f" UNION ALL SELECT 'measure', '{name}', {value}, NULL, NULL FROM s" for name, value in MEASURES.items())
)
def statistics_page(spark, table):
    """The whole statistics page of a run, a row for each of its numbers."""
    return P.page(_analysed(table))


@query(f"""WITH {ANALYSED}, u AS (SELECT *, coalesce(user_key, 'record:' || record_id) AS who FROM s), b AS (SELECT who, arg_max(problems, score::BIGINT * 1000000000 - seq) AS bp, arg_max(evidence, score::BIGINT * 1000000000 - seq) AS be, arg_max(help_seeking, score::BIGINT * 1000000000 - seq) AS bh FROM u GROUP BY 1),
q AS (SELECT who, comment_text AS v, min(seq) AS f FROM u GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY who ORDER BY min(seq), v) <= 5), l AS (SELECT who, comment_url AS v, min(seq) AS f FROM u GROUP BY 1, 2), l20 AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY who ORDER BY f, v) <= 20),
g AS (SELECT who, coalesce(arg_min(username, seq) FILTER (username <> ''), '') AS username, arg_min(creator_type, seq) AS creator_type, coalesce(arg_min(homepage_url, seq) FILTER (homepage_url <> ''), '') AS homepage_url, max(score) AS candidate_score, ['low', 'medium', 'high'][max(list_position(['low', 'medium', 'high'], contactability))] AS contactability,
['unclear', 'low', 'medium', 'high'][max(list_position(['unclear', 'low', 'medium', 'high'], product_fit))] AS product_fit, ['none', 'planned', 'tried', 'continued'][max(list_position(['none', 'planned', 'tried', 'continued'], evidence))] AS evidence, bool_or(help_seeking) AS help_seeking, count(DISTINCT record_id) AS n_records FROM u GROUP BY 1)
SELECT g.who AS user_key, username, creator_type, homepage_url, candidate_score, CASE WHEN candidate_score >= 5 THEN 'high' WHEN candidate_score >= 4 THEN 'medium' ELSE 'low' END AS priority, contactability, product_fit, evidence, help_seeking, n_records, (SELECT count(*) FROM l WHERE l.who = g.who) AS n_comment_urls,
coalesce((SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT who, unnest(problems) AS p FROM u) d WHERE d.who = g.who AND p <> ''), '') AS problems, coalesce((SELECT string_agg(relation, ',' ORDER BY relation) FROM (SELECT DISTINCT who, relation FROM u WHERE relation <> '') d WHERE d.who = g.who), '') AS relations,
(SELECT string_agg(v, ',' ORDER BY f, v) FROM l20 WHERE l20.who = g.who) AS comment_urls, (SELECT string_agg(v, ',' ORDER BY f, v) FROM q WHERE q.who = g.who) AS quotes,
coalesce(nullif(concat_ws('；', CASE WHEN be IN ('tried', 'continued') THEN '有真实行为证据' END, CASE WHEN bh THEN '主动求助' END, CASE WHEN len(bp) > 0 THEN '具体问题：' || array_to_string(bp[1:2], '；') END, CASE WHEN candidate_score >= 5 THEN '可供调研的具体线索较多（不代表产品匹配）' END), ''), '暂无足够线索判断调研价值，需核对原评论') AS contact_reason
FROM g JOIN b USING (who)""")
def lead_list(spark, table):
    """A lead for each user, with everything that their comments show; lists as text."""
    found = P.leads(_analysed(table)).drop("platform")
    lists = ("problems", "relations", "comment_urls", "quotes")
    return found.select(*[F.array_join(c, ",").alias(c) if c in lists else F.col(c) for c in found.columns])


def _case(value: str, labels: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE {value} END"


@query(
    f"""WITH {ANALYSED} SELECT record_id, comment_text AS "评论", username AS "用户", homepage_url AS "用户主页", 'bili' AS "平台", video_title AS "视频标题", creator_name AS "博主", creator_type AS "分类", {_case("primary_intent", exports.INTENT_LABELS)} AS "主要目的",
array_to_string(list_transform(signals, lambda x: {_case("x", exports.SIGNAL_LABELS)}), '，') AS "信息信号", {_case("evidence", exports.EVIDENCE_LABELS)} AS "行为证据", array_to_string(problems, '；') AS "具体问题", {_case("relation", exports.VIDEO_LABELS)} AS "单向内容关系",
CASE WHEN k % 2 = 0 THEN 's' || k || '（question）；alone' ELSE '' END AS "新发现", {_case("product_fit", exports.FIT_LABELS)} AS "产品适配", (k % 10)::VARCHAR AS "置信度", '' AS "分析时间" FROM s"""
)
def results_export(spark, table):
    """Analysed comments as the results CSV, written and read back: labels for keys, lists joined."""
    k = F.regexp_extract("comment_text", r"(\d+)$", 1).cast("long")
    new = F.array(F.struct(F.lit("question").alias("type"), F.concat(F.lit("s"), k.cast("string")).alias("text")), F.struct(F.lit(" ").alias("type"), F.lit(" alone").alias("text")), F.struct(F.lit("t").alias("type"), F.lit("").alias("text")))
    rows = _analysed(table).withColumns({"new_signals": F.when(k % 2 == 0, new), "confidence": k % 10, "analyzed_at": F.lit(None).cast("string")})
    with Scratch(spark, "export") as scratch:
        exports.result_rows(rows).write.csv(f"{scratch.root}/results", **AS_IS)
        return scratch.result(readers.read_csv(spark, f"{scratch.root}/results").drop("_file", "_row"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_custkey % 4 > 0 THEN o_custkey::VARCHAR ELSE o_orderkey::VARCHAR END AS who FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderpriority AS theme, count(*) AS comment_count, count(DISTINCT who) AS unique_user_count, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS ids, count(*) FILTER (o_custkey % 3 = 0) AS refs FROM o GROUP BY 1""")
def scoped_themes(spark, table):
    """Themes over all orders (by priority) narrowed to those of one status: ids, references and counts taken anew."""
    orders = table("orders").withColumn("id", F.col("o_orderkey").cast("string"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "id"))), lambda x: x["id"])
    refs = F.collect_list(F.when(F.col("o_custkey") % 3 == 0, F.struct(F.col("id").alias("record_id"), F.lit("i").alias("item"))))
    themes = orders.groupBy(F.col("o_orderpriority").alias("theme")).agg(ids.alias("record_ids"), refs.alias("refs"))
    records = orders.where("o_orderstatus = 'F'").select(F.col("id").alias("record_id"), F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey").cast("string")).alias("user_key"))
    found = scoping.scoped(themes, records, key="theme")
    return found.select("theme", "comment_count", "unique_user_count", F.md5(F.encode(F.array_join("record_ids", ","), "UTF-8")).alias("ids"), F.size("refs").cast("long").alias("refs"))


@query("""SELECT count(*) - 2 AS rows, true AS within FROM events""")
def line_counts(spark, table):
    """Rows of two folders of text files (a header each) counted from a few files: here whole, as they are few; and within the bounds from one."""
    with Scratch(spark, "lines") as scratch:
        for part in range(2):
            table("events").where(F.col("event_id") % 2 == part).select(F.col("event_id").cast("string")).coalesce(1).write.text(f"{scratch.root}/{part}")
        paths = [f"{scratch.root}/0", f"{scratch.root}/1"]
        whole, guess = exports.line_counts(spark, paths), exports.line_counts(spark, paths, whole_below=0, sample=1, sigmas=3.0)
        close = F.abs(guess.first()["rows"] - F.col("rows")) <= F.col("rows") * 0.01
        return scratch.result(whole.select("rows", (close & (F.col("low") == F.col("rows")) & (F.col("high") == F.col("rows"))).alias("within")))
