import json
import math
import statistics

import pyarrow as pa
from pyspark.sql import functions as F

from threadloom.functions import evidence as V
from threadloom.operators import aggregates as A
from threadloom.operators import dedupe as D
from threadloom.operators import joins as J
from threadloom.operators import matching
from threadloom.operators import ordered as O
from threadloom.operators import queue as Q
from threadloom.operators import quotes as K
from threadloom.operators import ranking as R
from threadloom.operators import results as T
from threadloom.operators import run_report
from threadloom.operators import scoping
from threadloom.operators import segment
from threadloom.operators import text as X
from threadloom.operators import vocabulary


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, seq int, v string")
    assert rows(D.first_wins(df, ["k"], "seq"), "k", "v") == [("a", "x"), ("b", "z")]
    assert rows(D.last_wins_at_first_place(df, ["k"], "seq"), "k", "v", "position") == [("a", "y", 1), ("b", "z", 3)]


def test_upsert_keeps_what_is_not_given(spark):
    old = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    got = {r["k"]: (r["v"], r["w"]) for r in D.upsert(old, new, ["k"]).collect()}
    assert got == {1: ("a", "p"), 2: ("b", "q"), 3: ("c", None)}
    assert D.upsert(D.upsert(old, new, ["k"]), new, ["k"]).count() == 3


def test_merge_twice_does_not_grow(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    r = D.merge_counts(df, df, "id").first()
    assert (r["before"], r["after"], r["added"]) == (2, 2, 0)


def test_round_robin_and_cap(spark):
    df = spark.createDataFrame([(i, "a" if i < 8 else "b") for i in range(10)], "i int, g string")
    assert [r["i"] for r in R.round_robin(df, ["g"], [F.asc("i")], "i", 4).collect()] == [0, 8, 1, 9]
    states = {r["i"]: r["state"] for r in R.capped_queue(df, "i", "g", [F.asc("i")], 1, 1).collect()}
    assert states[0] == "picked" and states[1] == "video_cap" and states[8] == "deferred"


def test_percentages_sum_to_a_hundred_and_coverage_may_pass_it(spark):
    df = spark.createDataFrame([("a", ["x", "x", "y"]), ("a", ["x"]), ("b", []), (None, None)], "l string, s array<string>")
    assert abs(sum(r["pct"] for r in A.label_percentages(df, "l").collect()) - 100) < 0.1
    assert rows(A.coverage(df, "s"), "label", "n", "pct") == [("x", 2, 50.0), ("y", 1, 25.0)]


def test_user_leads(spark):
    df = spark.createDataFrame([("u", 1, 2, "q"), ("u", 2, 5, "r"), ("u", 3, 5, "q"), ("v", 4, 0, "")], "u string, seq int, score int, quote string")
    got = {r["u"]: (r["comments"], r["best_score"], r["best_seq"], r["quotes"]) for r in A.user_leads(df, user="u", seq="seq", score="score", quote="quote").collect()}
    assert got == {"u": (3, 5, 2, ["q", "r"]), "v": (1, 0, 4, [])}


def test_tier_baseline_is_nearest_rank(spark):
    df = spark.createDataFrame([("t", v) for v in (1, 2, 3, 10)], "tier string, v long")
    r = A.tier_baseline(df, "tier", "v").first()
    assert (r["n"], r["p25"], r["median"], r["p75"], r["top"]) == (4, 2, 2, 3, 10)


def test_competition_follows_its_order(spark):
    videos = spark.createDataFrame([("a", 500, 0), ("b", 5000, 50), ("c", 5000, 3), ("d", 5000, 60)], "video_id string, play long, reported long")
    comments = spark.createDataFrame([("d", 90)] * 6, "video_id string, likes long")
    got = {r["video_id"]: (r["competition"], r["route"]) for r in A.competition(videos, comments).collect()}
    assert got == {"a": ("too_small", "skip"), "b": ("unknown_coverage", "reply"), "c": ("cold", "hot_comment"), "d": ("crowded", "reply")}


def test_thread_context_goes_down_three_levels(spark):
    df = spark.createDataFrame([("r", "0", "root", 0), ("a", "r", "A", 1), ("b", "a", "B", 2), ("c", "b", "C", 3), ("d", "c", "D", 4)], "id string, p string, t string, s int")
    got = {r["root"]: r["context"] for r in J.thread_context(df, id_col="id", parent_col="p", text_col="t", seq_col="s").collect()}
    assert got["r"] == ["A", "B", "C"] and got["c"] == ["D"]


def test_references_are_kept_or_named(spark):
    items = spark.createDataFrame([("r1", 1), ("r2", 1)], "record_id string, item_id int")
    claims = spark.createDataFrame([("c", "r1", 1), ("c", "r1", 9), ("c", "r9", 1)], "claim_id string, record_id string, item_id int")
    assert sorted(r["verdict"] for r in J.resolve_references(claims, items).collect()) == ["kept", "unknown_item", "unknown_record"]


def test_signal_ids_run_by_frequency_then_key(spark):
    df = spark.createDataFrame([("t", "b", 1), ("t", "a", 2), ("t", "c", 3), ("t", "c", 4)], "kind string, text string, seq int")
    assert rows(A.signal_frequencies(df, kind="kind", text=F.col("text"), seq="seq"), "signal_id", "signal_key", "frequency") == [("s0001", "t|c", 2), ("s0002", "t|a", 1), ("s0003", "t|b", 1)]


def test_small_corpus_has_no_common_words(spark):
    df = spark.createDataFrame([("ab",)] * 10, "t string")
    assert rows(vocabulary.rarity_weights(df, F.col("t"), ["a"]), "token", "hits", "weight") == [("a", 10, 1.0)]
    big = spark.createDataFrame([("ab" if i % 2 else "cd" if i % 10 == 0 else "",) for i in range(300)], "t string")
    assert rows(vocabulary.rarity_weights(big, F.col("t"), ["a", "c", "z"]), "token", "weight") == [("a", 0.0), ("c", 0.4), ("z", 1.0)]


def test_similar_texts_finds_what_all_pairs_find(spark):
    texts = ["hello world", "hello worlds", "hallo world", "other thing", "hello worldz", ""]
    df = spark.createDataFrame([(i, "g", t) for i, t in enumerate(texts)], "i int, g string, t string")

    def grams(t):
        s = t.replace(" ", "")
        return {s[k : k + 2] for k in range(len(s) - 1)}

    want = sorted((a, b) for a in range(6) for b in range(a + 1, 6) if grams(texts[a]) and grams(texts[b]) and len(grams(texts[a]) & grams(texts[b])) / len(grams(texts[a]) | grams(texts[b])) >= 0.6)
    assert rows(X.similar_texts(df, id_col="i", text=F.col("t"), group=["g"], least=0.6), "a", "b") == want


def test_draft_similarity(spark):
    df = spark.createDataFrame([("abcd",), ("zz",)], "t string")
    assert rows(X.draft_similarity(df, ["abce", "q"], "t"), "t", "similarity", "verdict") == [("abcd", 0.5, "block"), ("zz", 0.0, "ok")]


def test_numbers_without_whole_groups(spark):
    rows = [(i, "hot" if i % 3 else None, (i * 7) % 40) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, g string, v int").repartition(5)
    got = {r["i"]: r["n"] for r in O.numbered(df, ["g"], [F.desc("i")]).collect()}
    for g in ("hot", None):
        own = sorted((i for i, x, _ in rows if x == g), reverse=True)
        assert [got[i] for i in own] == list(range(1, len(own) + 1))
    sums = {r["i"]: r["s"] for r in O.numbered(df, [], [F.asc("i")], "s", "v").collect()}
    assert sums[299] == sum(v for *_, v in rows) and sums[0] == 0
    filled = {r["i"]: r["v"] for r in O.forward_filled(df.withColumn("v", F.when(F.col("i") % 50 == 10, F.col("i"))), [], [F.asc("i")], "v").collect()}
    assert all(filled[i] == (None if i < 10 else (i - 10) // 50 * 50 + 10) for i in range(300))
    for group in ([], ["g"]):
        found = A.medians(df, group, "v").collect()
        for r in found:
            own = sorted(v for _, g, v in rows if not group or g == r["g"])
            assert (r["n"], r["median"], r["top"]) == (len(own), statistics.median(own), own[-1])
    assert A.medians(df.limit(0), ["g"], "v").count() == 0


def longest(text, pool, limit, least):
    return matching.Pool(pool).longest(text, limit, least)


def longest_by_all_parts(text, pool, limit=48, least=4):
    text, bare = (text or "").strip(), (pool or "").replace(" ", "")
    there = lambda f: f.strip().replace(" ", "") in bare
    if not text or there(text):
        return text[:limit]
    for size in range(min(len(text), limit), least - 1, -1):
        for start in range(len(text) - size + 1):
            if there(text[start : start + size]):
                return text[start : start + size]
    return ""


def test_longest_parts_by_automaton_equal_all_parts(spark):
    import random

    rng = random.Random(6)
    for _ in range(2500):
        letters = rng.choice(["ab ", "abc \n", "abcdefgh  \t"])
        text, pool = ("".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(2))
        if rng.random() < 0.5 and text:
            i = rng.randrange(len(text))
            pool = pool[:5] + text[i : i + 12] + pool[5:]
        for limit in (48, 7):
            assert longest(text, pool, limit, 4) == longest_by_all_parts(text, pool, limit)
    long = "ab" * 40_000 + "c"
    assert longest("x" + long + "y", long + "z", 10**6, 4) == long and longest("q" * 50_000, long, 48, 4) == ""
    df = spark.createDataFrame([("mended part ofthe text", "a real part of the text"), (None, None)], "q string, p string")
    assert [r[0] for r in df.select(K.longest_quote(F.col("q"), F.col("p"))).collect()] == [" part ofthe text", ""]


def test_quotes_of_any_length_are_found_verbatim(spark):
    quotes = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "a"), (3, "of the\nold"), (4, ""), (5, None), (6, "a")], "q int, quote string")
    texts = spark.createDataFrame([("x", "x alpha beta gamma delta y"), ("y", "xof the\nolder"), ("z", None), ("w", "A")], "t string, text string")
    assert sorted((r["q"], r["t"]) for r in K.verbatim_quotes(quotes, texts).collect()) == [(1, "x"), (2, "x"), (3, "y"), (6, "x")]


def test_signals_problems_and_quotes_are_grounded(spark):
    item = "array<struct<type:string,text:string,evidence_quote:string,extra:int>>"
    signals = [("a", "x", "real words", 1), ("b", "these are real things", "made up", 2), ("c", "zz", "nor are real", 3), ("d", "zz", "no", 4), ("e", None, None, 5), ("f", "these are real words " * 3, "", 6)]
    df = spark.createDataFrame([(signals, ["real words", "zz", None, " are real "]), (None, None)], f"s {item}, q array<string>")
    pool = F.lit("these are real words")
    got, none = K.grounded_signals(df, "s", pool).collect()
    assert [(x["type"], x["evidence_quote"], x["extra"]) for x in got["s"]] == [("a", "real words", 1), ("b", "these are real ", 2), ("c", " are real", 3), ("f", " these are real words ", 6)] and none["s"] == []
    assert [r["x"] for r in df.select(K.grounded_quotes(F.col("q"), pool).alias("x")).collect()] == [["real words", "are real"], []]


def test_quotes_and_json(spark):
    assert longest("abcdef", "xxbcdezz", 48, 4) == "bcde" and longest("abc", "zabc", 48, 4) == "abc" and longest("abcd", "zz", 48, 4) == "" and longest("a b c d e", "zabcdz", 48, 4) == "a b c d "
    assert longest("x" * 60, "x" * 70, 48, 4) == "x" * 48 and longest(None, None, 48, 4) == ""
    answers = ['{"a": 1}', 'x ```json\n{"a": [1, 2]}\n``` y', 'see {"a": "}"} and {', '{"a": [1, {"b": "c', '{"a": 1, "b": ', "none", None, "[1]"]
    want = [{"a": 1}, {"a": [1, 2]}, {"a": "}"}, {"a": [1, {"b": "c"}]}, {"a": 1}, None, None, None]
    assert [json.loads(x) if (x := K._object(a)) else None for a in answers] == want
    df = spark.createDataFrame([("H1", "supports", "real words"), ("H1", "weakens", "made up"), ("H2", "irrelevant", "")], "hypothesis_id string, relation string, evidence_quote string")
    got = [(r["relation"], r["evidence_quote"]) for r in K.grounded_relations(df, F.lit("these are real words")).collect()]
    assert got == [("supports", "real words"), ("insufficient", ""), ("irrelevant", "")]
    compact = spark.createDataFrame([('[["p","quote a","s"],["quote b","b"],["z","w"]]',), ("broken",)], "c string")
    items = [r["i"] for r in compact.select(K.compact_cards(F.col("c"), {"p": "problem", "b": "behavior"}, {"s": "self"}).alias("i")).collect()]
    assert [(x["type"], x["evidence_quote"], x["speaker_scope"]) for x in items[0]] == [("problem", "quote a", "self"), ("behavior", "quote b", "unclear")] and not items[1]


def test_projection_retires_what_an_old_policy_said(spark):
    results = spark.createDataFrame([("r1", "high", "old", 1, "x"), ("r2", "high", "old", 2, "x"), ("r3", "high", "old", 1, "x")], "record_id string, product_fit string, single_video_relation string, projection_policy_version int, primary_intent string")
    items = f"array<{V.ITEM}>"
    cards = spark.createDataFrame([("r1", "usable", "praise", [("problem", "t", "q", "self", "high", "", "")])], f"record_id string, record_status string, primary_expression string, evidence_items {items}")
    got = {r["record_id"]: tuple(r)[1:] for r in T.with_projection(results, cards, ["primary_intent", "projection_policy_version"]).collect()}
    assert got == {"r1": ("high", "old", 2, "gratitude_recognition"), "r2": ("high", "old", 2, "x"), "r3": ("unclear", "unclear", 1, "x")}


def test_vocabulary_of_several_parts_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choices("abcé ", k=rng.randint(0, 60))) for _ in range(300)] + [None, "", "A b\tC" * 2000]
    tokens = ["".join(rng.choices("abcéA ", k=rng.randint(1, 5))) for _ in range(400)] + ["zzz", " ", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = lambda t: "".join((t or "").split()).lower()
    want = {t: sum(bare(t) in bare(x) for x in texts) for t in tokens if bare(t)}
    for chars in (50, 10**6):
        got = vocabulary.document_frequency(df, F.col("t"), tokens, part_chars=chars).collect()
        assert {r["token"]: r["hits"] for r in got} == want and {r["total"] for r in got} == {len(texts)}
    found = vocabulary.matches(df.withColumn("n", F.length("t")), F.col("t"), ["ab", "B C"], keep={"n": F.col("n")}, part_chars=1)
    assert sorted((r["n"], r["needle"]) for r in found.collect() if r["n"]) == sorted((len(x), n) for x in texts if x for n in ("ab", "bc") if n in bare(x))
    assert vocabulary.document_frequency(df.limit(0), F.col("t"), ["a"]).collect() == [("a", 0, 0)] and vocabulary.document_frequency(df, F.col("t"), []).collect() == []


def test_vocabulary_beyond_a_million_characters_is_one_scan(spark):
    tokens = spark.range(150_000).select(F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 9, "0"), F.lit("é世z")).alias("token"))
    df = spark.createDataFrame([("xw000000007é世zw000149999é 世Z",), ("w000000007é",), (None,)], "t string")
    assert len(vocabulary._parts(tokens.withColumn("needle", F.col("token")), vocabulary.PART_CHARS)) == 1
    got = vocabulary.document_frequency(df, F.col("t"), tokens)
    assert sorted(r["token"] for r in got.where("hits = 1").collect()) == ["w000000007é世z", "w000149999é世z"] and got.count() == 150_000


def test_needles_equal_brute_force(monkeypatch):
    import random

    from threadloom.operators import needles

    monkeypatch.setattr(needles, "BLOCK", 64)
    rng = random.Random(1)
    for most in (200, 30, 30, 30):  # texts longer than a block and shorter ones
        texts = ["".join(rng.choices("abcé\0世\U0001f600", k=rng.randint(0, most))) for _ in range(60)] + [None, ""]
        for n in (0, 1, 5, 200):
            asked = sorted({"".join(rng.choices("abcé\0世\U0001f600", k=rng.randint(1, 6))) for _ in range(n)})
            got = [(int(a), asked[b]) for at, found in needles.Needles(asked).in_texts(texts) for a, b in zip(at, found)]
            assert sorted(got) == sorted((k, x) for k, t in enumerate(texts) if t for x in asked if x in t)


def test_scenarios_name_tokens_and_quotes(spark):
    said = ["how to fix WiFi", "wi fi broken", "tea"] + ["nothing here"] * 60
    rows_ = [(i, f"u{i % 4}" if i else None, "v", t) for i, t in enumerate(said)]
    df = spark.createDataFrame(rows_, "i int, u string, v string, t string")
    asked = {"net": ["wifi", "router"], "tea": ["tea"], "none": ["xyz"], "empty": []}
    got = {r["scenario"]: r for r in vocabulary.scenario_check(df, text=F.col("t"), user=F.col("u"), video=F.col("v"), scenarios=asked, order=F.lpad(F.col("i").cast("string"), 9, "0"), min_hits=2, min_users=1).collect()}
    net = got["net"]
    assert (net["hits"], net["users"], net["videos"], net["verdict"]) == (2, 1, 1, "signal")
    assert [tuple(x) for x in net["tokens"]] == [("wifi", 2)] and net["quotes"] == ["how to fix WiFi", "wi fi broken"]
    assert (got["tea"]["verdict"], got["none"]["verdict"], got["none"]["hits"], got["empty"]["hits"]) == ("weak", "none", 0, 0)


def test_segmentation_equals_all_splits(spark):
    import random
    from collections import Counter

    rng = random.Random(9)
    counts = [("".join(rng.choices("abc", k=rng.randint(1, 4))), rng.randint(0, 50)) for _ in range(40)] + [("你好", 5), ("好", 9), ("", 3)]
    costs = {r["word"]: r["cost"] for r in segment.learnt(spark.createDataFrame(counts, "word string, n int")).collect()}
    unknown = segment.unknown_cost(max(costs.values()))
    total = sum(n for w, n in counts if w and n > 0)
    assert costs["你好"] == round(-1000 * math.log(5 / total)) and "" not in costs

    def all_splits(t):
        if not t:
            return [[]]
        return [[t[:k], *rest] for k in range(1, len(t) + 1) if k == 1 or t[:k] in costs for rest in all_splits(t[k:])]

    price = lambda split: sum(costs.get(w, unknown) for w in split)
    texts = ["".join(rng.choices("abcd你好", k=rng.randint(0, 9))) for _ in range(60)]
    want = Counter()
    for t in texts:
        own = min(all_splits(t), key=lambda s: (price(s), [-len(w) for w in s]))
        assert segment.cheapest(t, segment.trie(list(costs.items())), unknown) == own
        want.update(own)
    df = spark.createDataFrame([(f"{t}, {t.upper()}",) for t in texts] + [(None,)], "t string")
    words = spark.createDataFrame(list(costs.items()), "word string, cost long")
    for chars in (10**6, 1):
        got = {r["word"]: r["n"] for r in segment.segmented_counts(df, F.col("t"), words, stop=["a"], broadcast_chars=chars).collect()}
        assert got == {w: 2 * n for w, n in want.items() if w != "a"}


def test_a_dictionary_beyond_what_is_held_is_looked_for_in_parts(spark):
    costs = [(a + b + c, 900 + k) for k, (a, b, c) in enumerate((a, b, c) for a in "abcdefgh" for b in "abcdefgh" for c in ("", "a", "b"))]
    words = spark.createDataFrame(costs, "word string, cost long")
    df = spark.createDataFrame([("ab-" + "abcdefgh" * 2000,), ("",), (None,), ("häabz hhb",)], "t string")
    whole, parts = (segment.segmented_counts(df, F.col("t"), words, broadcast_chars=chars) for chars in (10**6, 40))
    assert rows(whole, "word", "n") == rows(parts, "word", "n")
    with_generate = parts._jdf.queryExecution().optimizedPlan().toString() + whole._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in with_generate  # no row a place and length of a text


def test_a_held_dictionary_gives_the_words_of_the_trie(spark):
    import random
    import re
    from collections import Counter

    rng = random.Random(5)
    for k in range(8):
        own = "abcdé漢𐐨"[: rng.randint(2, 7)]
        costs = {"".join(rng.choices(own, k=rng.randint(1, 6))): rng.choice([1, 2, 3, 100, 101, 102, rng.randint(0, 16_000_000)]) for _ in range(rng.randint(0, 40))}
        unknown = segment.unknown_cost(max(costs.values(), default=0))
        [pieces] = segment._pieces(iter([pa.RecordBatch.from_arrays([pa.array(list(costs), pa.string()), pa.array(list(costs.values()), pa.int64())], ["word", "cost"])]))
        model = segment.model_of(pieces.column(0).to_pylist(), [w for w in costs if len(w) == 1], unknown)
        held, top = segment.Held((model, unknown, sorted({len(w) for w in costs}))), segment.trie(list(costs.items()))
        for n in (0, 1, 7, 60, 900, 12_000 if k % 4 == 0 else 90):  # the longest cost far more than 2**24
            t = "".join(rng.choices(own + "z", k=n))
            t = t if n % 20 else f"-{t[:20]}, _{t[20:50]}\n{t[50:]} "
            want = [w for r in re.findall(r"\w+", t) for w in segment.cheapest(r, top, unknown)]
            words, counts = held.counts([(t, 1), (None, 4), (t, 2)])
            assert held.words(t) == want and dict(zip(words, counts.tolist(), strict=True)) == Counter(want * 3)


def test_a_dictionary_of_millions_of_characters_is_walked_at_once(spark):
    words = spark.range(250_000).select(F.lpad(F.lower(F.conv("id", 10, 36)), 10, "0").alias("word"), (F.col("id") % 7 + 900).alias("cost"))
    df = spark.createDataFrame([("00000000zz00000012AB-00000012abq",), (None,), ("00000000ZZ",), ("00000000zz",)], "t string").coalesce(1)
    got = segment.segmented_counts(df, F.col("t"), words)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan  # no scan for each part of it, no table of places
    assert rows(got, "word", "n") == [("00000000zz", 3), ("00000012ab", 2), ("q", 1)]


def test_twenty_families_are_dealt_once_each_key(spark):
    import random

    rng = random.Random(2)
    families = [f"f{i}" for i in range(20)]
    rows_ = [(rng.randint(0, 150), rng.choice([*families, "other"]), rng.randint(0, 10**6), rng.randint(0, 10**6), rng.random() < 0.7) for _ in range(1500)]
    taken, want = set(), []
    for f in families:
        own = [r for r in rows_ if r[1] == f]
        picked = [("hot", r) for r in sorted(own, key=lambda r: (-r[2], r[0]))[:4]]
        for kind, r in picked:
            if r[0] not in taken:
                taken.add(r[0])
                want.append((r[0], f, kind))
        n = 0
        for r in sorted((r for r in own if r[4]), key=lambda r: (-r[3], r[0])):
            if r[0] not in taken and n < 3:
                taken.add(r[0])
                n += 1
                want.append((r[0], f, "recent"))
    df = spark.createDataFrame(rows_, "id int, family string, likes int, at int, ok boolean")
    order = lambda c: [F.desc(c), F.asc("id")]
    got = Q.family_quotas(df, families, key="id", hot=order("likes"), recent=order("at"), eligible=F.col("ok"), n_hot=4, n_recent=3)
    assert got.columns == [*df.columns, "pick"] and sorted((r["id"], r["family"], r["pick"]) for r in got.collect()) == sorted(want)
    plans = [Q.family_quotas(df, f, key="id", hot=order("likes"), recent=order("at"), eligible=F.col("ok"), n_hot=4, n_recent=3)._jdf.queryExecution().optimizedPlan().toString() for f in (families[:2], families)]
    assert plans[0].count("Window") == plans[1].count("Window") and "Join" not in plans[1]  # it does not grow with the families
    assert Q.family_quotas(df.limit(0), families, key="id", hot=order("likes"), recent=order("at"), eligible=F.col("ok"), n_hot=4, n_recent=3).collect() == []


ROW = "seq long, record_id string, user_key string, user_id string, username string, platform string, creator_type string, creator_name string, video_title string, source_file string, homepage_url string, comment_url string, comment_text string, contactability string, primary_intent string, signals array<string>, evidence string, relation string, product_fit string, problems array<string>, help_seeking boolean, costs array<string>, gaps array<string>, impact string, paid_help boolean, hypotheses array<struct<hypothesis_id:string,relation:string>>"


def test_page_and_leads_of_nulls_and_of_nothing(spark):
    names = [f.split()[0] for f in ROW.split(", ")]
    made = lambda **own: tuple(own.get(n) for n in names)
    some = [
        made(seq=1, record_id="r1", user_key="u", username="", platform="bili", evidence="tried", problems=["b", "a"], comment_text="one", comment_url="l1", product_fit="low", contactability="medium"),
        made(seq=2, record_id="r2", user_key="u", username="name", evidence="continued", problems=["a"], help_seeking=True, costs=["c"], impact="stopped", comment_text=" one ", comment_url="l1", product_fit="odd", video_title=" v ", signals=["gratitude"]),
        made(seq=3, record_id="r3", hypotheses=[("H1", "weakens"), ("H9", "supports"), ("H1", "odd")]), made(seq=4, record_id="", user_key="x"), made(),
    ]
    df = spark.createDataFrame(some, ROW)
    page = {(r["section"], r["key"]): (r["n"], r["pct"], r["users"]) for r in run_report.page(df, total_records=9).collect()}
    count = lambda name: page["measure", name][0]
    assert [count(n) for n in ("total_analyzed", "total_records", "unique_users", "trained_users", "high_priority_user_count", "source_video_count", "source_file_count", "valid_comments")] == [5, 9, 2, 1, 1, 1, 0, 0]
    assert page["signal", "gratitude"][:2] == (1, 20.0) and page["hypothesis", "H1|weakens"] == (1, None, 0) and page["contradiction", "H1"][:2] == (1, 100.0) and page["hypothesis_by_creator", "H1|未知|weakens"][0] == 1
    leads = {r["user_key"]: r for r in run_report.leads(df).collect()}
    u = leads["u"]
    assert sorted(leads) == ["record:r3", "u", "x"][:2] and (u["username"], u["platform"], u["candidate_score"], u["priority"], u["product_fit"], u["evidence"], u["contactability"]) == ("name", "bili", 8, "high", "low", "continued", "medium")
    assert (u["problems"], u["quotes"], u["comment_urls"], u["n_records"], u["n_comment_urls"]) == (["a", "b"], ["one"], ["l1"], 2, 1) and run_report.lead_comments(df).count() == 3
    none = run_report.page(df.limit(0))
    assert {r["n"] for r in none.collect()} == {0} and run_report.leads(df.limit(0)).collect() == []


def test_scoped_conclusions(spark):
    shape = "theme string, record_ids array<string>, refs array<struct<record_id:string,n:int>>, comment_count int"
    df = spark.createDataFrame([("a", ["r3", "r1", "r9"], [("r9", 1), ("r1", 2), ("r3", 3)], 99), ("b", ["r9"], [("r1", 1)], 99), ("c", ["r2"], None, 99), ("d", None, None, 99)], shape)
    records = spark.createDataFrame([("r1", "u"), ("r2", None), ("r3", "u"), ("r3", "u")], "record_id string, user_key string")
    got = {r["theme"]: r for r in scoping.scoped(df, records, key="theme", sources=2).collect()}
    a, c = got["a"], got["c"]
    assert sorted(got) == ["a", "c"] and (a["record_ids"], [x["n"] for x in a["refs"]], a["comment_count"], a["unique_user_count"], a["source_count"]) == (["r3", "r1"], [2, 3], 2, 1, 2)
    assert (c["record_ids"], c["refs"], c["unique_user_count"]) == (["r2"], [], 1)
    assert sorted(r["theme"] for r in scoping.scoped(df, records, key="theme", ids=None).collect()) == ["a", "b"]
    docs = spark.createDataFrame([(2, 5, ["z"]), (1, 7, ["x", "y"])], "n int, tokens int, themes array<string>")
    assert tuple(scoping.merged_documents(docs, ["tokens"], ["themes"], "n").first()) == (12, ["x", "y", "z"])


def test_similar_texts_in_blocks_with_rare_pairs(spark, monkeypatch):
    import random

    monkeypatch.setattr(X, "_BLOCK", 7)
    r = random.Random(3)
    base = ["".join(r.choice("abcdef") for _ in range(40)) + "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(r.randrange(12))) for _ in range(12)]
    texts = [b[: r.randrange(1, 60)] if r.random() < 0.3 else b.replace(r.choice("abc"), r.choice("xyz"), r.randrange(3)) for b in base for _ in range(10)]
    df = spark.createDataFrame([(i, "gh"[i % 2], t) for i, t in enumerate(texts)] + [(900, None, texts[0]), (901, None, texts[0])], "i int, g string, t string")
    sets = [{t[k : k + 2] for k in range(len(t) - 1)} for t in texts]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] and sets[b] else 0
    for least in (0.5, 0.75, 1.0):
        want = sorted((a, b, like(a, b)) for a in range(len(texts)) for b in range(a + 1, len(texts)) if a % 2 == b % 2 and like(a, b) >= least)
        met = X.similar_texts(df, id_col="i", text=F.col("t"), group=["g"], least=least)
        assert want and rows(met, "a", "b", "similarity") == want
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "__p#" not in plan and "FlatMapGroupsInArrow" in plan  # no join on shared elements: pairs that only may be alike are never rows


def test_research_clusters_count_records_and_users_without_expansion(spark):
    from threadloom.functions.evidence import ITEM
    from threadloom.operators import research

    item = lambda scope, sure: ("problem", "t", "q", scope, sure, "", "")
    made = [("r1", [item("self", "high"), item("other_user", "low")]), ("r2", [item("self", "medium")]), ("r2", [item("self", "high")]), ("r3", [item(None, "low")])]
    cards = spark.createDataFrame(made, f"record_id string, evidence_items array<{ITEM}>")
    users = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "a"), ("r2", ""), ("r9", "z")], "record_id string, user_key string")
    got = research.research_clusters(cards, users, [])
    counts = got.select("comments", "users", "own", "general", "others", "high_certainty", "medium_certainty", "refs").collect()
    assert [tuple(r) for r in counts] == [(3, 4, 2, 0, 1, 2, 1, ["r1::e0"])]  # users a, b, the records r2 and r3
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
