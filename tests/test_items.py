"""Items read through paths kept as data, against a plain walk along the same paths."""

import json
import re

from pyspark.sql import functions as F

from threadloom.sources import items


def walked(item, paths):
    for path in paths.split(","):
        v = item
        for step in re.findall(r"[^.\[\]]+", path):
            v = v[int(step)] if isinstance(v, list) and step.isdigit() and int(step) < len(v) else v.get(step) if isinstance(v, dict) else None
        if v not in (None, "") and not isinstance(v, (dict, list)):
            return v
    return None


def nested(paths, value):
    """The smallest item that holds the value at each of the paths."""
    item = {}
    for path in paths:
        at, steps = item, re.findall(r"[^.\[\]]+", path)
        for k, step in enumerate(steps[:-1]):
            at = at.setdefault(step, [None] if steps[k + 1].isdigit() else {})
        if isinstance(at, list):
            at[0] = value(path)
        else:
            at[steps[-1]] = value(path)
    return item


def test_every_path_of_every_platform(spark):
    for (platform, what), _ in items.PATHS.items():
        fields = items.fields_of(platform, what)
        first = [p.split(",")[0] for _, p, _ in fields]
        last = [p.split(",")[-1] for _, p, _ in fields]
        made = [nested(first, lambda p: len(p) * 7), nested(last, lambda p: f"{len(p)}"), {}, [1], "text"]
        df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(made)] + [(9, "{broken"), (10, None)], "i int, j string")
        got = {r["i"]: r.asDict() for r in items.item_rows(df, "j", platform, what, "i").collect()}
        for i, item in enumerate(made):
            if i not in got:
                assert (platform, what) == ("ks", "video") and walked(item, "photo.id") is None
                continue
            for name, paths, kind in fields:
                v = walked(item, paths)
                want = None if v is None else int(v) if kind == "bigint" else str(v)
                assert got[i][name] == (want if name != "title" or platform != "bili" or what != "search" else want or ""), (platform, what, name)
        assert all(got.get(i, {}).get(fields[0][0]) is None for i in (9, 10))


def test_media_lists_links_and_cuts(spark):
    aweme = {"aweme_id": 5, "images": [{"url_list": ["a", "b"]}, {"url_list": []}, {}], "video": {"raw_cover": {"url_list": ["x", "y"]}, "play_addr_256": {"url_list": ["p", "q", "r"]}, "play_addr": {"url_list": ["z", "z"]}}}
    one = {"aweme_id": 6, "video": {"origin_cover": {"url_list": ["x"]}, "play_addr": {"url_list": ["z"]}}}
    df = spark.createDataFrame([(json.dumps(aweme),), (json.dumps(one),)], "j string")
    got = [(r["note_download_url"], r["cover_url"], r["video_download_url"], r["aweme_url"]) for r in items.item_rows(df, "j", "dy", "video").collect()]
    assert got[0] == ("b", "y", "r", "https://www.douyin.com/video/5") and got[1][1:3] == ("", "")
    weibo = {"mblog": {"id": 1, "text": "<a href='x'>hi</a> there", "region_name": "发布于 北京"}}
    r = items.item_rows(spark.createDataFrame([(json.dumps(weibo),)], "j string"), "j", "weibo", "video").first()
    assert (r["content"], r["ip_location"], r["note_url"]) == ("hi there", "北京", "https://m.weibo.cn/detail/1")
    said = [{"cid": 1, "aweme_id": "7", "image_list": [{"origin_url": {"url_list": ["s", "t"]}}, {"origin_url": {"url_list": ["s"]}}]}, {"cid": 2, "aweme_id": "8"}]
    rows = items.comments_of(spark.createDataFrame([("7", json.dumps(x)) for x in said], "v string, j string"), "j", "dy", "v").collect()
    assert [(r["comment_id"], r["pictures"]) for r in rows] == [("1", "t")]


def test_edges_and_search_notes(spark):
    df = spark.createDataFrame([("u", "U", "s", "a", json.dumps([{"mid": 1, "uname": "x"}, {"mid": "2"}, 5]))], "id string, name string, sign string, avatar string, j string")
    up = {n: n for n in ("id", "name", "sign", "avatar")}
    assert [(r["up_id"], r["fan_id"], r["fan_name"]) for r in items.contacts(df, "j", up).collect()] == [("u", "1", "x"), ("u", "2", None), ("u", None, None)]
    assert [(r["up_id"], r["fan_id"]) for r in items.contacts(df, "j", up, followings=True).collect()][:2] == [("1", "u"), ("2", "u")]
    hits = [
        {"id": " n1 ", "xsec_token": "t", "note_card": {"display_title": " T ", "user": {"nick_name": "who"}, "cover": {"url": "c"}}},
        {"id": "n2", "note_card": {"desc": "first line\nsecond"}}, {"id": "n3", "model_type": "hot_query", "note_card": {"title": "x"}}, {"id": "", "note_card": {"title": "x"}}, {"id": "n5"},
    ]
    got = items.search_notes(spark.createDataFrame([(json.dumps(h),) for h in hits], "j string"), "j").collect()
    assert [(r["note_id"], r["title"], r["author"], r["url"], r["cover_url"]) for r in got] == [
        ("n1", "T", "who", "https://www.xiaohongshu.com/explore/n1?xsec_token=t&xsec_source=pc_search", "c"), ("n2", "first line", "", "https://www.xiaohongshu.com/explore/n2", ""),
    ]
    assert items.elements(df.withColumn("j", F.lit('{"a": 1}')), "j", "a").collect() == []
