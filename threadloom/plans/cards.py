"""Evidence cards over the order tables, for queries: an order is a record, its lines are the items of its card.

The same values twice: as columns, and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

TYPES = ("problem", "behavior", "result", "context", "solution", "barrier", "action_gap", "engagement", "opinion", "quantitative")
TEXTS = ("动作标准吗 怎么做", "太难 做不到", "更疼 没用", "有效 改善", "我买了 没用", "怎么安排 计划", "坚持 懒", "空间 器械 疼", "我试过 坚持了", "录像 回复")
SUBTYPES = ("planned", "attempted", "continued", "stopped", "sought_paid_help", "paid_but_no_result", "", "saved", "started_but_stopped", "saved_but_not_started", "planned_but_not_started")
SCOPES = {"A": "self", "N": "other_user", "R": "general_observation"}
STATUS = {"1-URGENT": "usable", "2-HIGH": "unclear", "3-MEDIUM": "spam", "4-NOT SPECIFIED": "valid", "5-LOW": "off_topic"}
EXPRESSIONS = {"F": "question", "O": "help_request", "P": "praise"}


def pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def by_code(values: dict[str, str], c: str) -> Column:
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in values.items():
        found = found.when(F.col(c) == k, v)
    return found


def records(table) -> DataFrame:
    """record_id, user_key, source_file, video, creator, username, comment_text of each order."""
    cust = F.col("o_custkey")
    return table("orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("record_id"),
        F.when(cust % 9 != 0, F.concat(F.lit("u"), cust.cast("string"))).otherwise("").alias("user_key"),
        F.concat(F.lit("f"), (cust % 50).cast("string")).alias("source_file"),
        F.concat(F.lit("v"), (cust % 20).cast("string")).alias("video"),
        F.concat(F.lit("c"), (cust % 5).cast("string")).alias("creator"),
    )


def cards(table) -> DataFrame:
    """record_id, record_status, primary_expression, evidence_items (in line order) of each order that has lines."""
    lines = table("lineitem")
    text = pick(TEXTS, F.col("l_suppkey") % len(TEXTS))
    item = F.struct(
        pick(TYPES, F.col("l_partkey") % len(TYPES)).alias("type"),
        text.alias("text"),
        F.when(F.col("l_linenumber") % 5 == 4, "").otherwise(F.concat(text, F.lit(" "), (F.col("l_partkey") % 3).cast("string"))).alias("evidence_quote"),
        by_code(SCOPES, "l_returnflag").alias("speaker_scope"),
        F.when(F.col("l_linestatus") == "F", "high").when(F.col("l_quantity") > 25, "medium").otherwise("low").alias("certainty"),
        pick(SUBTYPES, (F.col("l_partkey") + F.col("l_suppkey")) % len(SUBTYPES)).alias("subtype"),
        F.lit("").alias("evidence_item_id"),
    )
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", item.alias("x"))
    # An order has a handful of lines, so a row's array stays small.
    items = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["x"]).alias("evidence_items"))
    heads = table("orders").select("o_orderkey", by_code(STATUS, "o_orderpriority").alias("record_status"), by_code(EXPRESSIONS, "o_orderstatus").alias("primary_expression"))
    return heads.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("record_id"), "record_status", "primary_expression", "evidence_items")


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql_case(values: dict[str, str], c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} = '{k}' THEN '{v}'" for k, v in values.items()) + " END"


#: CTEs ``records``, ``heads`` (record_id, status, expression) and ``items`` (record_id, place from 0, the item's fields).
CARDS_SQL = f"""
records AS (
  SELECT 'r' || o_orderkey AS record_id, CASE WHEN o_custkey % 9 <> 0 THEN 'u' || o_custkey ELSE '' END AS user_key,
         'f' || (o_custkey % 50) AS source_file, 'v' || (o_custkey % 20) AS video, 'c' || (o_custkey % 5) AS creator
  FROM orders
), heads AS (
  SELECT 'r' || o_orderkey AS record_id, {_sql_case(STATUS, "o_orderpriority")} AS status, {_sql_case(EXPRESSIONS, "o_orderstatus")} AS expression
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
), lines AS (
  SELECT *, {_sql_list(TEXTS)}[l_suppkey % {len(TEXTS)} + 1] AS txt,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS place
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
), items AS (
  SELECT 'r' || l_orderkey AS record_id, place, {_sql_list(TYPES)}[l_partkey % {len(TYPES)} + 1] AS type, txt AS text,
         CASE WHEN l_linenumber % 5 = 4 THEN '' ELSE txt || ' ' || (l_partkey % 3) END AS quote,
         {_sql_case(SCOPES, "l_returnflag")} AS scope,
         CASE WHEN l_linestatus = 'F' THEN 'high' WHEN l_quantity > 25 THEN 'medium' ELSE 'low' END AS certainty,
         {_sql_list(SUBTYPES)}[(l_partkey + l_suppkey) % {len(SUBTYPES)} + 1] AS subtype
  FROM lines
)"""
