import pytest
from pyspark.sql import functions as F

from threadloom.functions import columns as C
from threadloom.functions.rules import Rule, all_matches, any_and_none, comment_class, first_match, looks_garbled, looks_like_spam, short_circuit


def one(spark, c, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(c.alias("x")).first()["x"]


def many(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_play_count(spark):
    given = ["5305", "10万+", "1.2w", "2W", " 27152 ", "", None, "-5", "不详", "1,234", "true"]
    assert many(spark, C.play_count, given) == [5305, 100000, 12000, 20000, 27152, 0, 0, 0, 0, 1234, 0]


def test_the_count_parsers_differ(spark):
    given = ["1.2万", "-5", " 12.9 ", "http://x", "abc", "+7", "赞"]
    assert many(spark, C.digits_count, given) == [12000, 5, 129, 0, 0, 7, 0]
    assert many(spark, C.display_count, given) == [12000, -5, 12, 0, 0, 7, 0]
    assert many(spark, C.strict_count, given) == [0, -5, 0, 0, 0, 7, 0]
    assert many(spark, C.lenient_int, given) == [0, -5, 12, 0, 0, 7, 0]
    assert many(spark, C.first_digits, given) == [1, 5, 12, 0, 0, 7, 0]


def test_strip_takes_all_white_space(spark):
    assert many(spark, C.strip, ["　 a b\t\n", "", None]) == ["a b", "", None]
    assert many(spark, C.collapse, [" A 　\n b ", None]) == ["a b", ""]
    assert many(spark, C.squeeze, [" A 　\n b ", None]) == ["ab", ""]


def test_bigrams_and_jaccard(spark):
    assert many(spark, C.bigrams, ["ab c", "a", "", "aaa"]) == [["ab", "bc"], [], [], ["aa"]]
    assert one(spark, C.jaccard(C.bigrams(F.lit("abcd")), C.bigrams(F.lit("abce")))) == pytest.approx(0.5)
    assert one(spark, C.jaccard(C.bigrams(F.lit("a")), C.bigrams(F.lit("abce")))) == 0.0


def test_fuzzy_hit_and_quotes(spark):
    assert many(spark, lambda v: C.fuzzy_hit(v, F.lit("预算不太够")), ["预算有限", "够", "x", "", "时间"]) == [True, True, False, False, False]
    assert many(spark, lambda v: C.quote_exists(v, F.lit("a b c")), ["b c", "bc", "", "cb"]) == [True, True, True, False]


def test_html_links_and_parameters(spark):
    assert one(spark, C.html_to_text(F.lit("<p>a<script>x<y</script> b</p>\n<style>p{}</style>"))) == "a b"
    assert one(spark, C.url_parameters(F.lit("http://h/p?a=1&b=x%20y&c"))) == {"a": "1", "b": "x y"}
    assert one(spark, C.url_parameters(F.lit("http://h/p"))) == {}
    assert one(spark, C.without_marks(F.lit('<em class="k">a</em>b'))) == "ab"


def test_user_key_prefers_id_then_homepage_then_name(spark):
    rows = spark.createDataFrame([("u", "bili", "h", "n"), ("", "bili", "h", "n"), ("", "", "", "Ann"), ("", "", "", "用户12"), ("", "", "", "123"), (None, None, None, None)], "a string, p string, h string, n string")
    got = [r["x"] for r in rows.select(C.user_key(F.col("a"), F.col("p"), F.col("h"), F.col("n")).alias("x")).collect()]
    assert got == ["id:bili:u", "home:h", "user:unknown:Ann", None, None, None]


def test_times(spark):
    assert many(spark, C.to_epoch, ["1700000000", "1700000000000", "2024-01-01T00:00:00Z", "x", None]) == [1700000000, 1700000000, 1704067200, None, None]
    assert many(spark, C.sane_epoch, [5, 1_700_000_000, 9_000_000_000], "long") == [None, 1_700_000_000, None]
    now = F.lit(1_700_000_000)
    assert many(spark, lambda v: C.freshness(v, now), [1_700_000_000 - 3600, 1_700_000_000 - 50 * 3600, 1, 0, None], "long") == ["A", "B", "stale", "stale", "stale"]
    assert many(spark, lambda v: C.clock_minutes(v, 9), ["08:30", "24:00", "x", "7"]) == [510, 9, 9, 9]


def test_rules(spark):
    rules = [Rule("b", "b"), Rule("a", "a")]
    assert many(spark, lambda v: first_match(v, rules, "none"), ["ab", "a", "c", None]) == ["b", "a", "none", "none"]
    assert many(spark, lambda v: all_matches(v, rules), ["ab", "c", None]) == [["a", "b"], [], []]
    assert many(spark, lambda v: any_and_none(v, ["a"], ["b"]), ["a", "ab", "c"]) == [True, False, False]
    assert many(spark, looks_garbled, ["!!_", "你好", "a!", "", " \n", None]) == [True, False, False, True, True, True]
    assert many(spark, looks_like_spam, ["加微信 123", "好"]) == [True, False]


def test_tiers_and_scores(spark):
    assert [r["label"][:3] for r in many(spark, C.play_tier, [0, 1000, 60_000, 5_000_000], "long")] == ["冷启动", "小流量", "高流量", "爆款("]
    assert many(spark, C.lead_priority, [5, 4, 3], "int") == ["high", "medium", "low"]
    assert many(spark, C.signal_id, ["7", "s7", "s0007", "12345", "x"]) == ["s0007", "s0007", "s0007", "s12345", None]


def test_fingerprint_keeps_empty_places(spark):
    assert one(spark, C.fingerprint(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))) != one(spark, C.fingerprint(F.lit("a"), F.lit("b")))


def test_url_parameters_last_wins_and_blanks_go(spark):
    got = many(spark, C.url_parameters, ["http://h/p?a=1&a=2&b=&c=x%20y+z", "http://h/p", None, "http://h/?&=1&d"])
    assert got == [{"a": "2", "c": "x y z"}, {}, {}, {"": "1"}]
    assert many(spark, C.cookies, ["a=1; b=2;a=3; bad", "", None]) == [{"a": "3", "b": "2"}, {}, {}]


def test_spam_garbled_and_short_circuit(spark):
    texts = ["加微信 123", "看 https://x.y " + "长" * 80, "", "本内容由AI视频小助理生成", "___", "谢谢 https://a.b", "https://a.b", "普通的话"]
    assert many(spark, looks_like_spam, texts) == [True, False, False, False, False, True, True, False]
    said = [r and (r["status"], r["reason"]) for r in many(spark, short_circuit, texts)]
    assert said == [("spam", "spam"), None, ("garbled", "empty"), ("machine_generated", "machine_generated"), ("garbled", "garbled"), None, ("spam", "spam"), None]


def test_comment_classes(spark):
    texts = ["太短", "这个是什么软件做的呀", "新手小白求带，怎么入门", "出售成品号低价", "人工智能以后会改变世界的", "今天天气很好我们走吧"]
    got = [(r["state"], r["label"]) for r in many(spark, lambda v: comment_class(v, F.lit("bili")), texts)]
    assert got == [("excluded", "太短"), ("target_a", "问工具/怎么做"), ("target_a", "问工具/怎么做"), ("excluded", "太短"), ("target_c", "AI相关观点/讨论"), ("excluded", "无提问")]
    assert many(spark, lambda v: comment_class(v, F.lit("xhs"))["label"], ["要钱吗"]) == ["短疑问(购买/工具线索)"]


def test_links_by_platform(spark):
    row = spark.range(1).select(
        C.derived_links(F.lit("xhs"), F.lit("u"), F.lit("n1"), F.lit("c1"), F.lit(""), F.lit(None).cast("string")).alias("x"),
        C.derived_links(F.lit("bili"), F.lit("7"), F.lit("BV1"), F.lit("9"), F.lit("own"), F.lit("")).alias("b"),
        C.derived_links(F.lit("dy"), F.lit("7"), F.lit("v"), F.lit("9"), F.lit(""), F.lit("")).alias("d"),
        C.link_ids(F.lit("https://www.bilibili.com/video/BV1aa#reply12")).alias("ib"),
        C.link_ids(F.lit("https://www.xiaohongshu.com/explore/ab12#comment-cd34")).alias("ix"),
    ).first()
    assert tuple(row["x"]) == ("https://www.xiaohongshu.com/user/profile/u", "https://www.xiaohongshu.com/explore/n1#comment-c1")
    assert tuple(row["b"]) == ("own", "https://www.bilibili.com/video/BV1#reply9") and tuple(row["d"]) == ("", "")
    assert tuple(row["ib"]) == ("BV1aa", "12") and tuple(row["ix"]) == ("ab12", "cd34")


def test_strip_takes_all_that_unicode_calls_white_space(spark):
    by_regex = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    points = spark.range(1, 0x11000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, F.lit("0"))), "UTF-32").alias("c"))
    texts = points.select(F.explode(F.array(F.concat("c", F.lit("a"), "c", F.lit("b"), "c", "c"), F.col("c"))).alias("t")).union(spark.createDataFrame([("",), (None,)], "t string"))
    assert texts.where(~C.strip(F.col("t")).eqNullSafe(by_regex)).count() == 0


def test_what_a_card_needs_often_is_computed_once(spark):
    from threadloom.functions import evidence

    spark.createDataFrame([], f"items array<{evidence.ITEM}>, e string").createOrReplaceTempView("some_cards")
    plan = lambda c: spark.table("some_cards").select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
    items = F.col("items")
    assert plan(evidence.limited_items(items, ("behavior",))).count("array_sort") == 1  # before: 18
    assert plan(evidence.card_signals(items, F.col("e"))).count("array_join") == 1  # before: 30
    assert plan(evidence.new_signals(items)).count("context") == 3  # before: 6
