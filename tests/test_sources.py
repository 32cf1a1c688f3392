import json

import pytest
from pyspark.sql import functions as F

from threadloom.sources import exports, readers, sinks
from threadloom.streaming import incremental


def test_field_mapping_takes_exact_names_first():
    m = readers.field_mapping(["my_content_x", "Content", "NickName", "user_id"])
    assert (m["comment_text"], m["username"], m["user_id"], m["video_title"]) == ("Content", "NickName", "user_id", None)
    with pytest.raises(ValueError):
        readers.field_mapping(["a", "b"])


def test_csv_to_records(spark, tmp_path):
    d = tmp_path / "cat" / "maker" / "title_BV1xx"
    d.mkdir(parents=True)
    (d / "comments_2026-01-01.csv").write_text('﻿comment_id,content,user_id,nickname\n1,"a, b\nc",u1,n1\n2,,u2,n2\n3,q,,用户1\n', encoding="utf-8")
    got = readers.ingest(readers.read_csv(spark, str(d))).orderBy("source_row_number").collect()
    assert [r["comment_text"] for r in got] == ["a, b\nc", "q"]
    assert [r["user_key"] for r in got] == ["id:bili:u1", None] and got[0]["platform"] == "bili"
    again = readers.ingest(readers.read_csv(spark, str(d))).orderBy("source_row_number").collect()
    assert [r["record_id"] for r in got] == [r["record_id"] for r in again]
    assert [r["source_row_number"] for r in got] == [2, 4] and got[0]["user_homepage_url"] == "https://space.bilibili.com/u1"
    listed = readers.catalogue(readers.ingest(readers.read_csv(spark, str(d)))).first()
    assert (listed["creator"], listed["comments"]) == ("maker", 2)


def test_csv_of_several_headers_and_encodings_binds_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("content,user_id\nhello,u1\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("user_id,content,extra\nu2,world,x\n", encoding="utf-8-sig")
    (tmp_path / "c.csv").write_bytes("user_id,content\nu3,你好世界\n".encode("gb18030"))
    got = {r["user_id"]: (r["content"], r["extra"], r["_row"]) for r in readers.read_csv(spark, str(tmp_path)).collect()}
    assert got == {"u1": ("hello", "", 2), "u2": ("world", "x", 2), "u3": ("你好世界", "", 2)}
    records = {r["user_id"]: r["comment_text"] for r in readers.ingest(readers.read_csv(spark, str(tmp_path))).collect()}
    assert records == {"u1": "hello", "u2": "world", "u3": "你好世界"}


def test_collected_pair_and_sources(spark):
    contents = spark.createDataFrame([("v1", "old", 1), ("v1", "new", 2), ("", "other", 3)], "video_id string, title string, seq int")
    comments = spark.createDataFrame([("c1", "v1", "hi", "0", "3")], "comment_id string, video_id string, content string, parent_comment_id string, like_count string")
    rows, videos = readers.collected_pair(contents, comments, "bili", "seq")
    assert [(r["video_id"], r["title"]) for r in videos.collect()] == [("v1", "new")]
    assert [(r["comment_id"], r["parent_comment_id"], r["likes"]) for r in rows.collect()] == [("c1", None, 3)]
    both = readers.last_of_sources(comments, comments.withColumn("content", F.lit("later")), key="comment_id")
    assert [r["content"] for r in both.collect()] == ["later"]
    bench = spark.createDataFrame([("My-Chan_nel", "1", 1), ("mychannel", "1", 2), ("x", "1", 3)], "channel string, id string, seq int")
    assert readers.channels(bench.limit(0), bench, "seq").count() == 2


def test_json_lines_skip_broken_lines_and_keep_odd_separators(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"a": "x y"}, ensure_ascii=False) + "\n{broken\n" + json.dumps({"a": "z"}) + "\n", encoding="utf-8")
    assert sorted(r["a"] for r in readers.read_json_lines(spark, str(tmp_path), "a string").collect()) == ["x y", "z"]


def test_normalized_roots_and_times(spark):
    df = spark.createDataFrame([("v", "c1", "0", "hi", "3", "1700000000000"), ("v", "c2", "c1", "yo", "x", "1700000000")], "video_id string, comment_id string, parent_comment_id string, content string, like_count string, create_time string")
    got = {r["comment_id"]: (r["parent_comment_id"], r["likes"], r["created"]) for r in readers.normalized(df, "bili").collect()}
    assert got == {"c1": (None, 3, 1700000000), "c2": ("c1", 0, 1700000000)}


def test_thread_posts(spark):
    j = json.dumps({"post_list": [{"id": "1", "author_id": "u", "content": [{"text": "a"}, {"c": "b"}]}, {"id": "2", "author_id": "z", "content": []}], "user_list": [{"id": "u", "name": "Ann"}]})
    got = {r["comment_id"]: (r["author"], r["content"]) for r in readers.thread_posts(spark.createDataFrame([(j,)], "j string"), "j").collect()}
    assert got == {"1": ("Ann", "ab"), "2": (None, "")}


def test_partitioned_export_and_rewrite(spark, tmp_path):
    df = spark.createDataFrame([(1, "s"), (2, "t"), (3, "s")], "id int, source string")
    assert sorted((r["source_dir"], r["rows"]) for r in sinks.export_by_source(df, str(tmp_path / "x"), "source").collect()) == [("s", 2), ("t", 1)]
    sinks.rewrite_without(df, df.where("id = 1"), "id", str(tmp_path / "y"))
    assert spark.read.parquet(str(tmp_path / "y")).count() == 2
    for kind in ("csv", "jsonl", "orc", "parquet"):
        sinks.write_table(df, str(tmp_path / kind), kind, by=["source"])
    assert spark.read.orc(str(tmp_path / "orc")).count() == 3


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    schema = "id string, seq int, v string"
    spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], schema).write.mode("append").json(src)
    stream = lambda: incremental.file_stream(spark, src, spark.createDataFrame([], schema).schema)
    incremental.merge_available(stream(), out, chk)
    spark.createDataFrame([("a", 3, "z")], schema).write.mode("append").json(src)
    incremental.merge_available(stream(), out, chk)
    rows = lambda path: sorted((r["id"], r["v"]) for r in incremental.merged(spark, path, "id", "seq").collect())
    assert rows(out) == [("a", "z"), ("b", "y")] and len(list((tmp_path / "out").glob("batch=*"))) == 2
    incremental.compact(spark, out, str(tmp_path / "new"), "id", "seq")
    assert rows(str(tmp_path / "new")) == [("a", "z"), ("b", "y")]


def test_qa_site_rows(spark):
    hit = lambda kind, **o: {"type": kind, "object": o}
    search = {"data": [
        hit("search_result", id="1", type="answer", content="<p>hi <b>x</b></p>", question={"id": "9"}, author={"id": "u", "name": "Ann"}, created_time=5, excerpt="e"),
        hit("search_result", id="2", type="article", content="a", created=7, author={"member": {"id": "m", "name": "Bo", "url_token": "t"}}),
        hit("zvideo", id="3", type="zvideo"), hit("search_result", id="4", type="topic"), hit("ad", id="5", type="answer"),
    ]}
    rows = readers.qa_contents(spark.createDataFrame([(json.dumps(search),), ("broken",)], "j string"), "j").orderBy("content_id").collect()
    assert [(r["content_id"], r["content_text"], r["created_time"], r["user_id"], r["username"]) for r in rows] == [("1", "hi x", 5, "u", "Ann"), ("2", "a", 7, "m", "Bo"), ("3", "", 0, None, None)]
    assert rows[0]["content_url"].endswith("/question/9/answer/1") and rows[1]["content_url"].endswith("/p/2")
    comments = {"data": [{"id": "c", "type": "comment", "content": "<i>yes</i>", "author": {"member": {"id": "m"}}, "comment_tag": [{"type": "x", "text": "no"}, {"type": "ip_info", "text": "here"}]}, {"id": "d", "type": "ad"}]}
    got = readers.qa_comments(spark.createDataFrame([(json.dumps(comments),)], "j string"), "j").collect()
    assert [(r["comment_id"], r["content"], r["place"], r["user_id"]) for r in got] == [("c", "yes", "here", "m")]
    page = spark.range(1).select(readers.next_offset(F.lit("https://x/y?limit=5&offset=20")).alias("o")).first()
    assert page["o"] == "20"


def test_counts_of_lines_lie_within_their_bounds(spark, tmp_path):
    import random

    rng, total = random.Random(1), 0
    for i in range(40):
        n = rng.randint(50, 150)
        total += n
        (tmp_path / f"{i} x.csv").write_text("head\n" + "".join("y" * rng.randint(5, 40) + "\n" for _ in range(n)))
    (tmp_path / "empty.csv").write_text("")
    whole = exports.line_counts(spark, str(tmp_path)).first()
    assert tuple(whole) == (total, total, total, 40, 40)  # files without a byte are not listed
    few = exports.line_counts(spark, str(tmp_path), whole_below=100, sample=12, sigmas=5.0).first()  # which files are counted hangs on the folder's name
    assert few["read_files"] == 12 and few["low"] <= total <= few["high"] and abs(few["rows"] - total) < total * 0.1


def test_lead_rows_have_labels_and_joined_lists(spark):
    shape = "user_key string, username string, platform string, homepage_url string, candidate_score int, priority string, contactability string, contact_reason string, product_fit string, evidence string, help_seeking boolean, problems array<string>, relations array<string>, quotes array<string>, n_records int, comment_urls array<string>, contact_status string"
    df = spark.createDataFrame([("k", "n", "bili", None, 5, "high", "low", "why", "high", "tried", True, ["a", "b"], ["unclear", "odd"], ["q", "r"], 2, ["u"], "replied")], shape)
    r = exports.lead_rows(df).first()
    assert len(r) == 18 and (r["主页"], r["评分"], r["联系状态"], r["产品适配"], r["行为证据"], r["求助"], r["具体问题"], r["一次回复能否解决"], r["代表评论"], r["产品经理备注"]) == ("", "5", "已回复", "高", "已尝试", "是", "a；b", "暂无法判断；odd", "q | r", "")
