"""Exports as people read them: result rows and leads with their columns, labels and joined lists; row counts of files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.functions.columns import first_filled, strip
from threadloom.sources.sinks import flat_export, joined_labels, labelled

# What people read for each key.
INTENT_LABELS = {
    "gratitude_recognition": "感谢与认可", "check_in": "签到", "result_feedback": "结果反馈", "question": "提问", "difficulty_help_request": "困难求助", "complaint": "不满", "other_valid": "其他有效",
    "invalid_or_unclear": "无效/不明",
}
SIGNAL_LABELS = {
    "gratitude": "表达感谢", "saved_or_plan_to_try": "收藏或准备尝试", "started_using": "已开始使用", "continued_using": "持续使用", "positive_result": "正向结果反馈", "no_change": "无变化",
    "negative_result": "负向结果反馈", "applicability_question": "适用性提问", "howto_uncertainty": "执行方式不确定", "cannot_complete": "无法完成", "expected_effect_missing": "未达到预期效果",
    "physical_discomfort": "身体不适", "special_condition": "特殊身体状况", "needs_alternative": "需要替代方案", "needs_simpler": "需要降低难度/简化", "needs_advanced": "需要进阶", "needs_plan": "需要规划",
    "pace_problem": "节奏或操作问题", "instruction_unclear": "讲解不清楚", "resource_constraint": "设备/空间等条件限制", "privacy_concern": "隐私顾虑", "motivation_or_accountability": "需要督促或陪伴",
    "asks_creator_reply": "希望作者回复", "searched_other_content": "搜索其他内容", "recorded_self_for_review": "录像自我回看", "paid_professional_help": "付费专业帮助", "skipped_step": "跳过步骤",
    "stopped_using": "停止使用", "changed_plan": "调整方案", "other_new_signal": "其他新信号",
}
VIDEO_LABELS = {
    "video_sufficient": "历史推断：内容已足够（未验证）", "one_reply_sufficient": "历史推断：一次可解决（未验证）", "personalized_judgment_needed": "原文要求结合个人情况", "realtime_observation_needed": "原文请求查看操作",
    "unclear": "暂无法判断",
}
FIT_LABELS = {"high": "高", "medium": "中", "low": "低", "unclear": "不明"}
EVIDENCE_LABELS = {"none": "无行为证据", "planned": "计划尝试", "tried": "已尝试", "continued": "持续进行"}
CONTACT_LABELS = {
    "not_contacted": "未联系", "preparing": "准备中", "contacted": "已联系", "replied": "已回复", "interview_agreed": "已深度互动", "declined": "已拒绝", "no_reply": "无回复", "interview_completed": "已跟进",
}


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def result_rows(df: DataFrame, *, intents: Mapping[str, str] = INTENT_LABELS, signals: Mapping[str, str] = SIGNAL_LABELS) -> DataFrame:
    """The seventeen columns of a results export, of flat rows as ``run_report`` takes them and new_signals, confidence, analyzed_at.

    Keys without a label stay as they are, null and missing lists are empty. New signals read ``text（type）``.
    """
    new = F.transform("new_signals", lambda s: F.when((strip(F.coalesce(s["text"], F.lit(""))) != "") & (strip(F.coalesce(s["type"], F.lit(""))) != ""), F.concat(strip(s["text"]), F.lit("（"), strip(s["type"]), F.lit("）"))).otherwise(strip(F.coalesce(s["text"], F.lit("")))))
    return flat_export(df, {
        "record_id": F.col("record_id"), "评论": F.col("comment_text"), "用户": first_filled(F.col("username"), F.col("user_id")), "用户主页": F.col("homepage_url"), "平台": F.col("platform"), "视频标题": F.col("video_title"),
        "博主": F.col("creator_name"), "分类": F.col("creator_type"), "主要目的": labelled(F.col("primary_intent"), intents), "信息信号": joined_labels(F.col("signals"), signals), "行为证据": labelled(F.col("evidence"), EVIDENCE_LABELS),
        "具体问题": F.array_join("problems", "；"), "单向内容关系": labelled(F.col("relation"), VIDEO_LABELS), "新发现": F.array_join(F.filter(new, lambda x: x != ""), "；"), "产品适配": labelled(F.col("product_fit"), FIT_LABELS),
        "置信度": F.col("confidence"), "分析时间": F.col("analyzed_at"),
    })


def lead_rows(leads: DataFrame) -> DataFrame:
    """The eighteen columns of a leads export, of ``run_report.leads`` with contact_status and note, if these are there."""
    own = {c: F.col(c) if c in leads.columns else F.lit("") for c in ("contact_status", "note")}
    return flat_export(leads, {
        "user_key": F.col("user_key"), "用户名": F.col("username"), "平台": F.col("platform"), "主页": F.col("homepage_url"), "评分": F.col("candidate_score"), "优先级": F.col("priority"), "可联系性": F.col("contactability"),
        "联系状态": labelled(own["contact_status"], CONTACT_LABELS), "联系理由": F.col("contact_reason"), "产品适配": labelled(F.col("product_fit"), FIT_LABELS), "行为证据": labelled(F.col("evidence"), EVIDENCE_LABELS),
        "求助": F.when(F.col("help_seeking"), "是").otherwise("否"), "具体问题": F.array_join("problems", "；"), "一次回复能否解决": joined_labels(F.col("relations"), VIDEO_LABELS, "；"), "代表评论": F.array_join("quotes", " | "),
        "评论数": F.col("n_records"), "评论链接": F.array_join("comment_urls", "；"), "产品经理备注": own["note"],
    })


def line_counts(spark: SparkSession, paths: str | Sequence[str], *, whole_below: int = 512 * 1024, sample: int = 200, sigmas: float = 3.0) -> DataFrame:
    """One row: rows (of lines but a header a file), low, high, files, read_files.

    Files below a size are counted whole. Of larger ones a sample of so many, by hash of the path, is counted, and the rest
    by its lines a byte; low and high are so many standard errors of that guess away. If no file is left to guess, low
    and high are exact. Sizes come from the file listing; no content of a file that is not counted is read.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    large = F.col("length") >= whole_below
    chosen = files.where(large).orderBy(F.xxhash64("path")).limit(sample).select("path")
    counted = files.where(~large).select("path").union(chosen)
    read = [r["path"] for r in counted.collect()]  # paths, as the driver lists them anyway
    shape = "path string, lines long"
    lines = spark.read.text(read, lineSep="\n").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("lines")) if read else spark.createDataFrame([], shape)
    name = lambda c: F.regexp_replace(F.try_url_decode(c), "^file:/+", "/")
    found = files.withColumn("p", name("path")).join(lines.withColumn("p", name("path")).drop("path"), "p", "left").join(F.broadcast(counted.withColumn("read", F.lit(True))), "path", "left")
    rows = F.greatest(F.coalesce("lines", F.lit(0)) - 1, F.lit(0))
    some = F.col("read") & large
    r = found.agg(
        F.count(F.lit(1)).alias("files"), F.count("read").alias("read_files"), F.coalesce(F.sum(F.when(F.col("read"), rows)), F.lit(0)).alias("known"), F.coalesce(F.sum(F.when(F.col("read").isNull(), F.col("length"))), F.lit(0)).alias("rest"),
        *[F.coalesce(F.sum(F.when(some, c)), F.lit(0)).cast("double").alias(n) for n, c in {"n": F.lit(1), "x": F.col("length"), "y": rows, "xx": F.col("length").cast("double") ** 2, "xy": F.col("length").cast("double") * rows, "yy": rows.cast("double") ** 2}.items()],
    ).first()
    ratio = r["y"] / r["x"] if r["x"] else 0.0
    spread = max(0.0, r["yy"] - 2 * ratio * r["xy"] + ratio * ratio * r["xx"]) / max(1.0, r["n"] - 1)
    left = r["files"] - r["read_files"]
    # what the files left differ by themselves, and what the ratio may be wrong by
    error = sigmas * sqrt(spread * left + spread / r["n"] * (r["rest"] * r["n"] / r["x"]) ** 2) if r["n"] else 0.0
    guess = ratio * r["rest"]
    out = (round(r["known"] + guess), max(r["known"], int(r["known"] + guess - error)), int(r["known"] + guess + error + (r["rest"] > 0)), r["files"], r["read_files"])
    return spark.createDataFrame([out], "rows long, low long, high long, files long, read_files long")
