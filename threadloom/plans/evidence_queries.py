"""Queries over evidence cards, research groups and claims. The SQL goes item by item where the columns go by arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import evidence as V
from threadloom.functions.card_rules import rule_card
from threadloom.operators import research as S
from threadloom.operators import results as T
from threadloom.plans.cards import CARDS_SQL, cards, records
from threadloom.plans.registry import query

LEVEL_SQL = """levels AS (
  SELECT h.record_id, status, CASE
    WHEN bool_or((type = 'quantitative' AND certainty <> 'low')
      OR (type = 'behavior' AND (subtype IN ('attempted', 'completed_once', 'continued', 'progress', 'stopped', 'changed_plan', 'sought_paid_help') OR (scope = 'self' AND certainty = 'high')))
      OR (type = 'action_gap' AND certainty = 'high') OR (type = 'result' AND scope = 'self')) THEN 'strong'
    WHEN bool_or(type IN ('problem', 'solution', 'barrier', 'behavior', 'action_gap', 'result')) THEN 'medium' ELSE 'weak' END AS level
  FROM heads h JOIN items USING (record_id) GROUP BY 1, 2)"""


@query(f"""WITH {CARDS_SQL}, {LEVEL_SQL}
SELECT record_id, level, CASE WHEN status IN ('spam', 'off_topic') THEN 'spam_or_garbled' WHEN status = 'unclear' THEN 'unclear'
  WHEN level IN ('strong', 'medium') THEN 'meaningful_evidence' ELSE 'low_information_but_valid' END AS validity,
  status IN ('usable', 'valid', 'unclear') AS participating, level IN ('strong', 'medium') AS meaningful
FROM levels""")
def card_levels(spark, table):
    level = V.level_of_items(F.col("evidence_items"), F.col("record_status"))
    return cards(table).select(
        "record_id",
        level.alias("level"),
        V.validity_of(F.col("record_status"), level).alias("validity"),
        V.is_participating_status(F.col("record_status")).alias("participating"),
        V.is_meaningful_level(level).alias("meaningful"),
    )


@query(f"""WITH {CARDS_SQL} SELECT record_id, string_agg(record_id || '::e' || place, ',' ORDER BY place) AS ids,
  string_agg(substr(text, 1, 3), '|' ORDER BY place) AS short FROM items GROUP BY 1""")
def card_item_ids(spark, table):
    summary = V.research_summary(F.col("evidence_items"), F.col("record_id"), 3)
    return cards(table).select("record_id", F.array_join(F.transform(summary, lambda x: x["evidence_item_id"]), ",").alias("ids"), F.array_join(F.transform(summary, lambda x: x["text"]), "|").alias("short"))


@query(f"""WITH {CARDS_SQL}, a AS (SELECT h.record_id, status, expression,
  count(*) FILTER (type = 'problem') AS problems,
  bool_or(type = 'behavior' AND subtype = 'continued') AS goes_on,
  bool_or(type = 'behavior' AND subtype IN ('attempted', 'sought_paid_help')) AS tried,
  bool_or(type = 'behavior' AND subtype = 'planned') AS planned,
  bool_or(type = 'behavior' AND subtype = 'sought_paid_help') AS paid,
  bool_or(type = 'action_gap' AND subtype = 'paid_but_no_result') AS paid_gap,
  bool_or(type = 'action_gap' AND subtype = 'started_but_stopped') AS stopped,
  bool_or(type = 'action_gap' AND subtype IN ('saved_but_not_started', 'planned_but_not_started')) AS skipped,
  list(quote ORDER BY place) FILTER (quote <> '') AS quotes
  FROM heads h JOIN items USING (record_id) GROUP BY 1, 2, 3)
SELECT record_id, CASE expression WHEN 'question' THEN 'question' WHEN 'help_request' THEN 'difficulty_help_request' ELSE 'gratitude_recognition' END AS intent,
  CASE WHEN goes_on THEN 'continued' WHEN tried THEN 'tried' WHEN planned THEN 'planned' ELSE 'none' END AS evidence,
  CASE WHEN paid OR paid_gap THEN 'paid_help' WHEN stopped THEN 'stopped' WHEN skipped THEN 'skipped' ELSE 'none' END AS impact,
  expression = 'help_request' OR problems > 0 AS help_seeking, paid AS paid_help, problems, coalesce(array_to_string(quotes[1:5], '|'), '') AS quotes
FROM a""")
def card_projection(spark, table):
    p = V.card_projection(F.col("evidence_items"), F.col("primary_expression"), F.col("record_status"))
    return cards(table).select("record_id", p.alias("p")).select(
        "record_id",
        F.col("p.primary_intent").alias("intent"),
        F.col("p.actual_training_evidence").alias("evidence"),
        F.col("p.training_impact").alias("impact"),
        "p.help_seeking",
        "p.paid_help",
        F.size("p.specific_problems").cast("long").alias("problems"),
        F.array_join("p.evidence_quotes", "|").alias("quotes"),
    )


def _words(column: str, words: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words.split()) + ")"


@query(f"""WITH {CARDS_SQL}, t AS (SELECT *, text || quote AS said FROM items), pool AS (SELECT record_id, string_agg(quote || chr(10) || text, chr(10)) AS pool FROM items GROUP BY 1),
s AS (
  SELECT record_id, CASE subtype WHEN 'planned' THEN 'saved_or_plan_to_try' WHEN 'attempted' THEN 'started_using' WHEN 'continued' THEN 'continued_using' WHEN 'stopped' THEN 'stopped_using'
    WHEN 'sought_paid_help' THEN 'paid_professional_help' END AS signal FROM t WHERE type = 'behavior'
  UNION ALL SELECT record_id, 'saved_or_plan_to_try' FROM t WHERE type = 'engagement' AND subtype = 'saved'
  UNION ALL SELECT record_id, CASE WHEN subtype = 'started_but_stopped' THEN 'stopped_using' ELSE 'skipped_step' END FROM t
    WHERE type = 'action_gap' AND subtype IN ('started_but_stopped', 'saved_but_not_started', 'planned_but_not_started')
  UNION ALL SELECT record_id, CASE WHEN {_words("said", "无效 没变化 没用 更疼 更痛 没改善")} THEN 'negative_result'
    WHEN {_words("said", "没感觉 无感 感受不到 没效果")} THEN 'expected_effect_missing' ELSE 'positive_result' END FROM t WHERE type = 'result'
  UNION ALL SELECT record_id, 'howto_uncertainty' FROM t WHERE type = 'problem' AND {_words("said", "标准 对不对 是不是我 姿势 做得不 方法不")}
  UNION ALL SELECT record_id, 'applicability_question' FROM t WHERE type = 'problem' AND {_words("said", "怎么 为什么 正常吗 区别 是否")}
  UNION ALL SELECT record_id, 'cannot_complete' FROM t WHERE type IN ('problem', 'barrier') AND {_words("said", "做不了 太难 做不到")}
  UNION ALL SELECT record_id, 'physical_discomfort' FROM t WHERE type IN ('problem', 'barrier') AND {_words("said", "疼 痛 伤")}
  UNION ALL SELECT record_id, 'needs_plan' FROM t WHERE type = 'problem' AND {_words("said", "计划 安排 怎么练 怎么做 从哪开始")}
  UNION ALL SELECT record_id, 'resource_constraint' FROM t WHERE type = 'barrier' AND {_words("said", "空间 器械 设备 工具 条件")}
  UNION ALL SELECT record_id, 'gratitude' FROM heads WHERE expression = 'praise' AND record_id IN (SELECT record_id FROM items)
  UNION ALL SELECT h.record_id, CASE WHEN {_words("pool", "标准 对不对 是不是")} THEN 'howto_uncertainty' ELSE 'applicability_question' END FROM heads h JOIN pool USING (record_id)
    WHERE expression = 'question' AND record_id NOT IN (SELECT record_id FROM t WHERE type = 'problem' AND {_words("said", "标准 对不对 是不是我 姿势 做得不 方法不 怎么 为什么 正常吗 区别 是否")})
  UNION ALL SELECT record_id, 'asks_creator_reply' FROM pool WHERE {_words("pool", "回复 看看我 帮我看看 博主回 作者回")}
  UNION ALL SELECT record_id, 'recorded_self_for_review' FROM pool WHERE {_words("pool", "录像 拍视频 录自己 拍下来")}
  UNION ALL SELECT record_id, 'motivation_or_accountability' FROM pool WHERE {_words("pool", "坚持 签到 动力 懒 自律")}
)
SELECT h.record_id, coalesce(string_agg(DISTINCT signal, ',' ORDER BY signal), '') AS signals FROM heads h LEFT JOIN s USING (record_id) GROUP BY 1""")
def card_signals(spark, table):
    return cards(table).select("record_id", F.array_join(V.card_signals(F.col("evidence_items"), F.col("primary_expression")), ",").alias("signals"))


@query(f"""WITH {CARDS_SQL}, n AS (SELECT record_id, place, text, quote, CASE type WHEN 'problem' THEN 'new_problem' WHEN 'context' THEN 'new_user_segment' WHEN 'solution' THEN 'new_current_solution' ELSE 'new_barrier' END AS kind
  FROM items WHERE type IN ('problem', 'barrier', 'action_gap', 'solution') OR (type = 'context' AND certainty <> 'low')),
f AS (SELECT *, row_number() OVER (PARTITION BY record_id, text ORDER BY place) AS copy FROM n), g AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY place) AS nth FROM f WHERE copy = 1)
SELECT h.record_id, count(nth) AS n, coalesce(string_agg(kind || '|' || text || '|' || CASE WHEN quote <> '' THEN quote ELSE text END, ';' ORDER BY nth), '') AS signals
FROM heads h LEFT JOIN g ON h.record_id = g.record_id AND nth <= 5 GROUP BY 1""")
def card_new_signals(spark, table):
    found = V.new_signals(F.col("evidence_items"))
    joined = F.array_join(F.transform(found, lambda x: F.concat_ws("|", x["type"], x["text"], x["evidence_quote"])), ";")
    return cards(table).select("record_id", F.size(found).cast("long").alias("n"), joined.alias("signals"))


@query(f"""WITH {CARDS_SQL}, p AS (SELECT *, CASE type WHEN 'behavior' THEN 1 WHEN 'problem' THEN 2 WHEN 'result' THEN 3 WHEN 'quantitative' THEN 4 ELSE 99 END AS rank FROM items WHERE quote <> ''),
d AS (SELECT *, row_number() OVER (PARTITION BY record_id, quote ORDER BY rank, place) AS copy FROM p), o AS (SELECT * FROM d WHERE copy = 1),
c AS (SELECT record_id, (bool_or(type = 'problem') AND bool_or(type = 'behavior') AND bool_or(type = 'result')) OR (bool_or(subtype = 'sought_paid_help') AND bool_or(subtype = 'paid_but_no_result'))
  OR (bool_or(type = 'quantitative') AND bool_or(type IN ('problem', 'barrier'))) OR count(DISTINCT type) >= 4 AS complex FROM o GROUP BY 1),
n AS (SELECT o.*, complex, row_number() OVER (PARTITION BY record_id ORDER BY rank, place) AS nth FROM o JOIN c USING (record_id))
SELECT h.record_id, coalesce(string_agg(type || ':' || quote, ',' ORDER BY nth), '') AS items FROM heads h LEFT JOIN n ON h.record_id = n.record_id AND nth <= CASE WHEN complex THEN 4 ELSE 2 END GROUP BY 1""")
def card_item_limit(spark, table):
    kept = V.limited_items(F.col("evidence_items"), ("behavior", "problem", "result", "quantitative"))
    return cards(table).select("record_id", F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["type"], x["evidence_quote"])), ",").alias("items"))


@query(f"""WITH {CARDS_SQL}, g AS (SELECT *, scope = 'self' AND type IN ('behavior', 'result') AND (contains(quote, '他') OR NOT contains(quote, '我')) AS unsure,
  type = 'behavior' AND subtype IN ('attempted', 'continued', 'stopped', 'sought_paid_help') AND NOT {_words("quote", "试 坚持 买")} AS idle FROM items WHERE quote <> '')
SELECT CASE WHEN unsure THEN 'unclear' ELSE scope END AS scope, CASE WHEN unsure OR idle THEN 'low' ELSE certainty END AS certainty, CASE WHEN idle THEN '' ELSE subtype END AS subtype,
  count(*) AS n, count(DISTINCT quote) AS texts FROM g GROUP BY 1, 2, 3""")
def grounded_items(spark, table):
    kept = V.grounded_items(F.col("evidence_items"), self_marks=("我",), other_marks=("他",), action_marks=("试", "坚持", "买"))
    rows = cards(table).select(F.explode(kept).alias("x")).select("x.*")
    return rows.groupBy(F.col("speaker_scope").alias("scope"), "certainty", "subtype").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("texts"))


@query(f"""WITH {CARDS_SQL}, q AS (SELECT text || quote AS t FROM items) SELECT count(*) AS items,
  count(*) FILTER ({_words("t", "我报了 我报名 我买了 我购买 我付了 我花了 我充值 我充了值 我订阅 我请了 我找了专业人士 我做了付费")}) AS paid,
  count(*) FILTER ({_words("t", "我买了")} AND {_words("t", "没效果 没用 没改善")}) AS paid_failure, count(*) FILTER ({_words("t", "省钱 省了钱 不用花 没花钱 避免花")}) AS saving FROM q""")
def paid_predicates(spark, table):
    t = F.concat("x.text", "x.evidence_quote")
    rows = cards(table).select(F.explode("evidence_items").alias("x")).select(t.alias("t"))
    t = F.col("t")
    return rows.agg(F.count(F.lit(1)).alias("items"), F.count_if(V.has_paid_action(t)).alias("paid"), F.count_if(V.has_paid_failure(t)).alias("paid_failure"), F.count_if(V.is_cost_saving(t)).alias("saving"))


@query(f"""WITH {CARDS_SQL} SELECT type, count(*) AS n, count(DISTINCT record_id) AS cards FROM items WHERE type IN ('problem', 'solution', 'barrier') GROUP BY 1""")
def legacy_arrays(spark, table):
    """Items to the older arrays and back."""
    old = {k: V.items_of(F.col("evidence_items"), k) for k in ("problem", "solution", "barrier")}
    arrays = {k: F.transform(c, lambda x: F.struct(x["text"].alias("text"), x["evidence_quote"].alias("evidence_quote"), x["subtype"].alias("subtype"))) for k, c in old.items()}
    rows = cards(table).select("record_id", F.explode(V.legacy_items(arrays)).alias("x"))
    return rows.groupBy(F.col("x.type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("cards"))


RESULTS_SQL = f"""WITH {CARDS_SQL}, e AS (SELECT h.record_id, status, expression, list(DISTINCT type) AS types, bool_or(subtype = 'continued') AS goes_on, count(*) FILTER (type = 'context') AS news
  FROM heads h JOIN items USING (record_id) GROUP BY 1, 2, 3)"""


def _results(table):
    made = cards(table).join(records(table), "record_id")
    has = lambda test: F.coalesce(F.exists("evidence_items", test), F.lit(False))
    return made.select(
        "record_id",
        F.concat(F.lit("Comment "), "record_id").alias("comment_text"),
        F.col("user_key").alias("username"),
        F.col("video").alias("video_title"),
        F.col("primary_expression").alias("primary_intent"),
        F.array_distinct(F.transform("evidence_items", lambda x: x["type"])).alias("signals"),
        F.lit("unclear").alias("single_video_relation"),
        F.lit("unclear").alias("product_fit"),
        F.array(F.struct(F.lit("H1").alias("hypothesis_id"), F.when(has(lambda x: x["subtype"] == "continued"), "supports").otherwise("weakens").alias("relation"))).alias("hypothesis_relations"),
        F.filter("evidence_items", lambda x: x["type"] == "context").alias("new_signals"),
    )


@query(f"""{RESULTS_SQL} SELECT record_id FROM e JOIN records USING (record_id)
WHERE contains(lower('Comment ' || record_id || ' ' || user_key || ' ' || video), 'u1') AND expression = 'question' AND list_contains(types, 'problem') AND goes_on AND news > 0
  AND record_id IN (SELECT 'r' || o_orderkey FROM orders WHERE o_totalprice > 1000)""")
def result_filter(spark, table):
    wanted = table("orders").where("o_totalprice > 1000").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("record_id"))
    found = T.matching_results(
        _results(table), keyword="U1", primary_intent="question", valid_intents=("question", "praise"), signal="problem", single_video_relation="unclear",
        hypothesis_id="H1", hypothesis_relation="supports", has_new_signal=True, record_ids=wanted,
    )
    return found.select("record_id")


@query("""SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND c_nationkey % 2 = 0""")
def candidate_filter(spark, table):
    customers = table("customer").select(
        "c_custkey",
        F.col("c_mktsegment").alias("priority"),
        F.when(F.col("c_acctbal") > 0, "high").otherwise("low").alias("contactability"),
        F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("research_target_matches"),
    )
    return T.matching_candidates(customers, priority="BUILDING", contactability="high", platform="", research_matched="yes").select("c_custkey")


@query(f"""WITH {CARDS_SQL} SELECT record_id FROM heads h WHERE status IN ('usable', 'valid') AND expression = 'help_request' AND record_id IN (SELECT record_id FROM items WHERE type = 'barrier') AND contains(record_id, '1')""")
def card_filter(spark, table):
    rows = cards(table).withColumns({"comment_text": F.lit(""), "username": F.lit(None).cast("string")})
    return T.matching_cards(rows, status="usable", expression="help_request", item_type="barrier", keyword="1").select("record_id")


@query(f"""WITH {CARDS_SQL}, {LEVEL_SQL}, k AS (SELECT record_id, bool_or(type = 'problem') AS problem, bool_or(type = 'behavior') AS behavior, bool_or(type = 'action_gap') AS gap FROM items GROUP BY 1),
j AS (SELECT r.*, CASE status WHEN 'valid' THEN 'usable' ELSE coalesce(status, 'usable') END AS s, coalesce(level, 'weak') AS level, problem, behavior, gap, l.record_id IS NOT NULL AS card,
  r.video IN ('v1', 'v2', 'v3') AS themed FROM records r LEFT JOIN levels l USING (record_id) LEFT JOIN k USING (record_id))
SELECT count(*) AS total, count(*) FILTER (s = 'usable') AS usable, count(*) FILTER (s = 'unclear') AS unclear, count(*) FILTER (s = 'off_topic') AS off_topic, count(*) FILTER (s = 'spam') AS spam,
  count(*) FILTER (level = 'strong') AS level_strong, count(*) FILTER (level = 'medium') AS level_medium, count(*) FILTER (level = 'weak') AS level_weak,
  count(*) FILTER (problem) AS problem_comments, count(*) FILTER (behavior) AS behavior_comments, count(*) FILTER (gap) AS action_gap_comments,
  count(DISTINCT nullif(user_key, '')) AS users, count(DISTINCT source_file) AS files, count(DISTINCT video) AS videos, count(DISTINCT creator) AS creators,
  count(*) FILTER (themed AND card AND s IN ('usable', 'unclear')) AS theme_covered, count(*) FILTER (s IN ('usable', 'unclear')) AS participating,
  floor(count(*) FILTER (themed AND card AND s IN ('usable', 'unclear')) * 10000.0::DOUBLE / count(*) FILTER (s IN ('usable', 'unclear')) + 0.5::DOUBLE) / 10000.0::DOUBLE AS theme_coverage_rate,
  greatest(0, count(*) FILTER (s = 'usable') - count(*) FILTER (themed AND card AND s = 'usable')) AS unthemed_usable FROM j""")
def dataset_summary(spark, table):
    own = records(table)
    level = V.level_of_items(F.col("evidence_items"), F.col("record_status"))
    found = T.dataset_summary(own, cards(table), level, own.where("video IN ('v1', 'v2', 'v3')"))
    return found.drop("machine_generated", "garbled", "level_none")


CLUSTER_SUBTYPES = ("planned", "stopped", "sought_paid_help")
CLUSTERS_SQL = f"""WITH {CARDS_SQL}, l AS (SELECT i.record_id, place, type, scope, certainty, CASE WHEN subtype IN {CLUSTER_SUBTYPES} THEN subtype ELSE '' END AS subtype, nullif(user_key, '') AS user_key, CASE
  WHEN {_words("(text || ' ' || quote)", "方向 判断 怎么测 怎么看 分不清")} THEN '方向/判断困难' WHEN {_words("(text || ' ' || quote)", "标准 做得不 感觉不到 找不到感觉 方法不")} THEN '执行方式不确定'
  WHEN {_words("(text || ' ' || quote)", "受伤 损伤 术后 身体 适合我 可不可以")} THEN '特殊身体状况与适用性' WHEN {_words("(text || ' ' || quote)", "怎么 下一步 多久 几次 先做 降级")} THEN '安排与下一步疑问'
  WHEN {_words("(text || ' ' || quote)", "立竿见影 改善 好转 有效果 变好")} THEN '短期正向结果' WHEN {_words("(text || ' ' || quote)", "没效果 无效 没有改善 更严重 加重")} THEN '无效或负向结果'
  WHEN subtype <> '' THEN subtype ELSE type END AS label FROM items i LEFT JOIN records USING (record_id))"""


@query(f"""{CLUSTERS_SQL}, c AS (SELECT label, type, subtype, count(DISTINCT record_id) AS comments, count(DISTINCT coalesce(user_key, record_id)) AS users,
  count(DISTINCT record_id) FILTER (scope = 'self') AS own, count(DISTINCT record_id) FILTER (scope = 'general_observation') AS general, count(DISTINCT record_id) FILTER (scope = 'other_user') AS others,
  count(DISTINCT record_id) FILTER (certainty = 'high') AS high_certainty, count(DISTINCT record_id) FILTER (certainty = 'medium') AS medium_certainty FROM l GROUP BY 1, 2, 3),
o AS (SELECT *, CASE WHEN scope = 'self' THEN 0 ELSE 1 END AS a, CASE certainty WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS b FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY label, type, subtype, record_id ORDER BY a, b, place) AS own_nth FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY label, type, subtype ORDER BY a, b, record_id) AS nth FROM f WHERE own_nth = 1),
s AS (SELECT label, type, subtype, list(record_id || '::e' || place ORDER BY nth) AS refs FROM r WHERE nth <= 3 GROUP BY 1, 2, 3)
SELECT c.*, array_to_string(refs[1:CASE WHEN comments >= 15 THEN 3 WHEN comments >= 5 THEN 2 ELSE 1 END], ',') AS refs FROM c JOIN s USING (label, type, subtype)""")
def research_clusters(spark, table):
    return S.research_clusters(cards(table), records(table), CLUSTER_SUBTYPES).withColumn("refs", F.array_join("refs", ","))


@query(f"""WITH {CARDS_SQL}, g AS (SELECT record_id, CASE WHEN bool_or(subtype IN ('planned', 'planned_but_not_started')) THEN '有计划但未执行' WHEN bool_or(subtype = 'paid_but_no_result') THEN '付费但无结果'
  WHEN bool_or(subtype = 'saved_but_not_started') THEN '收藏/观看但未行动' END AS "group" FROM items GROUP BY 1) SELECT "group", count(*) AS records FROM g WHERE "group" IS NOT NULL GROUP BY 1""")
def behavior_groups(spark, table):
    return S.behavior_groups(cards(table))


@query(f"""WITH {CARDS_SQL}, m AS (SELECT DISTINCT type AS theme_id, record_id FROM items) SELECT theme_id, count(DISTINCT record_id) AS comments, count(DISTINCT coalesce(user_key, record_id)) AS users
FROM m JOIN records USING (record_id) GROUP BY 1 UNION ALL SELECT 'nobody', 0, 0""")
def recounted_themes(spark, table):
    members = S.item_rows(cards(table)).select(F.col("type").alias("theme_id"), "record_id").distinct()
    stated = members.select("theme_id").distinct().withColumn("comments", F.lit(1)).union(spark.createDataFrame([("nobody", 99)], "theme_id string, comments int"))
    return S.recounted(members, records(table), stated)


#: Claims: one for each customer, of a text by its key; it refers to the first items of the customer's first orders.
CLAIM_TEXTS = ("用户普遍反馈", "已经行动 持续进行", "证明 提升付费", "本人 明显改善", "愿意付费", "花钱 没结果", "用户感觉 太难")
CLAIMS_SQL = f"""WITH {CARDS_SQL}, t AS (SELECT c_custkey, (c_custkey // 100)::BIGINT AS n FROM customer),
o AS (SELECT o_custkey, record_id, place, quote, type, subtype, scope, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, place) AS pos FROM items JOIN orders ON record_id = 'r' || o_orderkey),
claims AS (SELECT 'c' || c_custkey AS claim_id, {list(CLAIM_TEXTS)}[c_custkey % 7 + 1] AS text, (c_custkey % 40)::BIGINT AS record_count, c_custkey FROM customer),
shown AS (SELECT c.*, coalesce(string_agg(DISTINCT quote, ' ') FILTER (quote <> ''), '') AS evidence, count(quote) FILTER (quote <> '') AS quotes, coalesce(bool_or(type = 'behavior'), false) AS behavior,
  coalesce(bool_or(type = 'result'), false) AS result, coalesce(bool_or(scope = 'self'), false) AS own, coalesce(bool_and(subtype IN ('planned', '')) AND bool_or(subtype = 'planned'), false) AS planned,
  coalesce(bool_or(substr(record_id, 2)::BIGINT % 11 = 0), false) AS outside
  FROM claims c LEFT JOIN (SELECT * FROM o WHERE pos <= 3) ON o_custkey = c_custkey GROUP BY ALL),
verdicts AS (SELECT *, CASE
  WHEN contains(text, '明显改善') AND (NOT result OR NOT {_words("evidence", "有效 改善 舒服 缓解 好转 成功 回正 省钱 不疼 没以前")}) THEN 'contradicted'
  WHEN contains(text, '本人') AND NOT own THEN 'contradicted'
  WHEN contains(text, '已经行动') AND (NOT behavior OR planned) THEN 'contradicted'
  WHEN contains(text, '证明') THEN 'insufficient'
  WHEN contains(text, '普遍') AND record_count / 60.0 <= 0.5 THEN 'contradicted'
  WHEN contains(text, '愿意付费') AND NOT {_words("evidence", "愿意付费 愿意购买 多少钱 怎么买")} THEN 'insufficient'
  WHEN contains(text, '花钱') AND NOT ({_words("evidence", "我买了")} AND {_words("evidence", "没效果 没用 没改善")}) THEN 'contradicted'
  WHEN outside THEN 'contradicted' WHEN quotes = 0 THEN 'insufficient' ELSE 'needs_review' END AS verdict FROM shown)"""


def _claims(table):
    orders = table("orders").select(F.col("o_custkey"), F.col("o_orderkey"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("record_id"))
    items = S.item_rows(cards(table))
    own = items.where("place < 3").select("record_id", "place", "evidence_item_id").join(orders, "record_id").groupBy("o_custkey").agg(F.slice(F.array_sort(F.collect_list(F.struct("o_orderkey", "place", "evidence_item_id"))), 1, 3).alias("r"))
    key = F.col("c_custkey")
    made = table("customer").join(own, key == F.col("o_custkey"), "left").select(
        F.concat(F.lit("c"), key.cast("string")).alias("claim_id"),
        F.element_at(F.array(*[F.lit(t) for t in CLAIM_TEXTS]), (key % 7 + 1).cast("int")).alias("text"),
        (key % 40).cast("long").alias("record_count"),
        F.coalesce(F.transform("r", lambda x: x["evidence_item_id"]), F.array().cast("array<string>")).alias("refs"),
    )
    allowed = table("orders").where("o_orderkey % 11 <> 0").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("record_id"))
    return S.hard_review(S.claim_ledger([("theme", made)], items, most=None), 60, allowed)


@query(f"""{CLAIMS_SQL} SELECT claim_id, verdict FROM verdicts""")
def claim_review(spark, table):
    return _claims(table).select("claim_id", "verdict")


@query(f"""{CLAIMS_SQL}, m AS (SELECT claim_id, CASE WHEN verdict <> 'needs_review' THEN verdict WHEN c_custkey % 3 = 0 THEN 'supported' WHEN c_custkey % 3 = 1 THEN 'contradicted' ELSE 'insufficient' END AS verdict FROM verdicts)
SELECT verdict, count(*) AS n, min(claim_id) AS first_claim FROM m GROUP BY 1""")
def model_review(spark, table):
    said = table("customer").where("c_custkey % 3 < 2").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("claim_id"), F.when(F.col("c_custkey") % 3 == 0, "supported").otherwise("contradicted").alias("verdict"))
    return S.reviewed(_claims(table), said).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.min("claim_id").alias("first_claim"))


@query("""SELECT c_mktsegment AS claim_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'supported' ELSE 'insufficient' END AS conclusion, count(*) AS n FROM customer GROUP BY 1""")
def downgraded_hypotheses(spark, table):
    hypotheses = table("customer").groupBy(F.col("c_mktsegment").alias("claim_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("conclusion", F.lit("supported"))
    reviews = hypotheses.select("claim_id", F.when(F.col("claim_id").isin("BUILDING", "MACHINERY"), "supported").otherwise("needs_review").alias("verdict"))
    return S.downgraded(hypotheses, reviews)


@query("""SELECT p_brand AS claim_id, count(*) AS n, min(p_partkey) AS first_id, max(p_partkey) AS last_id FROM part WHERE p_size > 10 AND p_brand <> 'Brand#1' GROUP BY 1""")
def scoped_themes(spark, table):
    members = table("part").select(F.col("p_brand").alias("claim_id"), F.array("p_partkey").alias("record_ids"))
    reviews = table("part").select(F.col("p_brand").alias("claim_id")).distinct().withColumn("verdict", F.when(F.col("claim_id") == "Brand#1", "contradicted").otherwise("supported"))
    scope = table("part").where("p_size > 10").select(F.col("p_partkey").alias("record_id"))
    numbered = members.withColumn("claim_id", F.concat_ws("/", "claim_id", F.element_at("record_ids", 1).cast("string")))
    own = numbered.select("claim_id").withColumn("verdict", F.when(F.startswith("claim_id", F.lit("Brand#1/")), "contradicted").otherwise("supported"))
    rows = S.scoped_themes(numbered, own, scope).select(F.substring_index("claim_id", "/", 1).alias("claim_id"), F.explode("record_ids").alias("id"))
    return S.supported_only(rows, reviews).groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("""WITH t AS (SELECT c_mktsegment AS subject, c_custkey AS record_id FROM customer), h AS (SELECT n_name AS subject, n_nationkey % 4 AS s FROM nation)
SELECT 'unsupported_claim' AS kind, subject, count(*) AS n FROM t WHERE record_id % 5 = 0 GROUP BY 2
UNION ALL SELECT 'unsupported_claim', subject, 0 FROM h WHERE s = 0 UNION ALL SELECT 'missing_counter_evidence', subject, s FROM h WHERE s IN (1, 2)""")
def structural_review(spark, table):
    known = table("customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").cast("string").alias("record_id"))
    themes = table("customer").select(F.col("c_mktsegment").alias("subject"), F.array(F.col("c_custkey").cast("string")).alias("record_ids"))
    n = (F.col("n_nationkey") % 4).cast("int")
    ids = F.slice(F.array(*[F.lit(x) for x in ("1", "2", "3")]), F.lit(1), n)
    hypotheses = table("nation").select(F.col("n_name").alias("subject"), F.lit("supported").alias("conclusion"), ids.alias("supporting"), F.array().cast("array<string>").alias("weakening"))
    issues = S.structural_review(themes, hypotheses, known)
    return issues.groupBy("kind", "subject").agg(F.sum("n").alias("n"))


@query("""SELECT p_name AS theme_name, count(*) AS comments FROM part WHERE NOT contains(p_name, 'hot') GROUP BY 1 HAVING count(*) >= 8""")
def reportable_themes(spark, table):
    themes = table("part").groupBy(F.col("p_name").alias("theme_name")).agg(F.count(F.lit(1)).alias("comments")).withColumn("definition", F.lit(None).cast("string"))
    return S.reportable_themes(themes, noise=("hot",)).select("theme_name", "comments")


@query(f"""WITH {CARDS_SQL}, i AS (SELECT record_id, count(*) FILTER (subtype IN ('sought_paid_help', 'paid_but_no_result') OR contains(text || ' ' || quote, '我买了')) AS paid FROM items GROUP BY 1)
SELECT record_id AS finding_id FROM i WHERE substr(record_id, 2)::BIGINT % 2 = 0 OR paid > 0""")
def paid_findings(spark, table):
    items = S.item_rows(cards(table))
    text = F.when(F.substring("record_id", 2, 20).cast("long") % 2 == 0, "用户反馈").otherwise("用户付费")
    findings = items.groupBy("record_id").agg(F.collect_list("evidence_item_id").alias("refs")).select(F.col("record_id").alias("finding_id"), text.alias("text"), "refs")
    return S.paid_claims_shown(findings, items).select("finding_id")


@query(f"""WITH {CARDS_SQL}, r AS (SELECT record_id || '::e' || place AS evidence_item_id, substr(record_id, 2)::BIGINT * 100 + place AS seq FROM items WHERE type = 'result')
SELECT evidence_item_id, 'E' || row_number() OVER (ORDER BY seq, evidence_item_id) AS alias FROM r""")
def reference_aliases(spark, table):
    seq = F.substring("record_id", 2, 20).cast("long") * 100 + F.col("place")
    return S.aliased(S.item_rows(cards(table)).where("type = 'result'").select("evidence_item_id", seq.alias("seq")), "seq")


@query("""WITH s AS (SELECT l_orderkey AS claim_id, l_linenumber AS pos, CASE WHEN l_quantity > 25 THEN 'k' || l_suppkey ELSE l_suppkey::VARCHAR END AS stated FROM lineitem),
r AS (SELECT 'k' || s_suppkey AS record_id, row_number() OVER (ORDER BY s_suppkey) - 1 AS position FROM supplier)
SELECT claim_id, record_id, min(pos) AS "at" FROM s JOIN r ON stated = record_id OR stated = position::VARCHAR GROUP BY 1, 2""")
def known_references(spark, table):
    from threadloom.operators.ordered import numbered

    stated = F.when(F.col("l_quantity") > 25, F.concat(F.lit("k"), F.col("l_suppkey").cast("string"))).otherwise(F.col("l_suppkey").cast("string"))
    claims = table("lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("at"), stated.alias("stated"))
    known = numbered(table("supplier"), [], [F.asc("s_suppkey")], "n").select(F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("record_id"), (F.col("n") - 1).alias("position"))
    return S.known_ids(claims, known)


#: Comments with the card that the rules give them: status, expression, and types of items in order.
RULE_CARDS = (
    ("谢谢老师", "usable", "praise", "opinion"),
    ("Day 3 打卡", "usable", "check_in", "engagement,behavior"),
    ("收藏了但是从不开始", "usable", "other", "engagement,action_gap"),
    ("这样正常吗", "usable", "question", "problem"),
    ("试了一下太难", "usable", "result_feedback", "behavior,barrier"),
    ("太难", "usable", "complaint", "barrier"),
    ("买了会员没变化怎么办", "usable", "help_request", "problem,problem,behavior,action_gap"),
    ("坚持两个月了", "usable", "other", "behavior,quantitative"),
    ("!!!", "garbled", "other", ""),
    ("加微信领资料", "spam", "other", ""),
)


@query("WITH k(k, record_status, primary_expression, types) AS (VALUES " + ", ".join(f"({i}, '{s}', '{e}', '{t}')" for i, (_, s, e, t) in enumerate(RULE_CARDS)) + """)
SELECT record_status, primary_expression, types, count(*) AS n FROM events JOIN k ON event_id % 10 = k GROUP BY 1, 2, 3""")
def rule_cards(spark, table):
    text = F.element_at(F.array(*[F.lit(t) for t, *_ in RULE_CARDS]), (F.col("event_id") % 10 + 1).cast("int"))
    made = table("events").select(rule_card(text, F.col("event_id").cast("string")).alias("c")).select("c.*")
    types = F.array_join(F.transform("evidence_items", lambda x: x["type"]), ",")
    return made.groupBy("record_status", "primary_expression", types.alias("types")).agg(F.count(F.lit(1)).alias("n"))
