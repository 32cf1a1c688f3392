"""Language identification, toxicity and language-model scores."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from threadloom.llm import language_id as L
from threadloom.llm import lm_scoring as M
from threadloom.llm import toxicity as T
from threadloom.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, score double, toxic int"
SYLLABLES = {"aa": ["ta", "ro", "mi", "ken"], "bb": ["sch", "ung", "ver", "heit"], "cc": ["eau", "oux", "elle", "que"]}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], int(rng.integers(1, 4)))) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(d, t, lang, 0.0, 0) for d, t, lang in rows], DOCS)


def test_languages(spark):
    rng = np.random.default_rng(0)
    rows = [(i, text_of(rng, lang, int(rng.integers(4, 60))), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    odd = [(1000, None, "aa"), (1001, "", None), (1002, "123 !!", "bb"), (1003, text_of(rng, "cc", 20_000), None), (5, rows[5][1], rows[5][2]), (None, "ta ro", None)]
    got = L.identify_held_out(docs(spark, rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    said = {r["doc_id"]: r for r in got}
    assert all(said[k]["lang_pred"] == "und" for k in (1000, 1001, 1002)) and said[1003]["lang_pred"] == "cc"
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in held)
    assert np.mean([r["lang_pred"] == rows[r["doc_id"]][2] for r in held]) > 0.95
    assert L.identify_held_out(docs(spark, [])).count() == 0
    assert {r["lang_pred"] for r in L.identify_held_out(docs(spark, [(1, "ta", None)])).collect()} == {"und"}


def test_rare_languages_and_ties(spark):
    rng = np.random.default_rng(7)
    hot = text_of(rng, "aa", 20)
    rows = [(i, hot, "aa") for i in range(600)] + [(1000 + i, text_of(rng, "aa", 20), "aa") for i in range(40)]
    rows += [(2000 + k, text_of(rng, "bb", 25), "bb") for k in range(3)] + [(3000, "zzz qqq", "yy"), (3001, "zzz qqq", "xx")]
    model = L.train(docs(spark, rows), sample_per_language=20)
    assert model.languages == ["aa", "bb", "xx", "yy"]
    said = {r["doc_id"]: r["lang_pred"] for r in L.identify(docs(spark, rows + [(1, text_of(rng, "bb", 40), None)]), model).collect()}
    assert said[1] == "bb" and said[0] == "aa" and said[3000] == said[3001] == "xx"  # a tie goes to the first
    again = L.train(docs(spark, rows).repartition(5), sample_per_language=20)
    assert np.array_equal(model.weights, again.weights)


def test_folded_weights_are_the_kernel_expansion():
    rng = np.random.default_rng(1)
    texts = [text_of(rng, lang, 30) for lang in ["aa", "bb"] * 20]
    sets = [set(L.places(t).tolist()) for t in texts]
    bits = []
    for s in sets:
        row = np.zeros(L.DIM, dtype=bool)
        row[list(s)] = True
        bits.append(np.packbits(row).tobytes())
    labels = ["aa", "bb"] * 20
    model = L.fit_kernel_ridge(bits, labels, landmarks=len(texts))
    kernel = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    y = np.where(np.array(labels)[:, None] == np.array(["aa", "bb"]), 1.0, -1.0)
    exact = kernel @ np.linalg.solve(kernel + L.RIDGE * len(texts) * np.eye(len(texts)), y)
    assert np.abs(model.scores(texts) - exact).max() < 0.02


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(2)
    stems = ["zork", "blarg"]

    def one(i):
        words = text_of(rng, "aa", int(rng.integers(20, 80))).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(stems)) + str(rng.choice(["", "ed", "ing", "er"])))
        return " ".join(words), int(toxic)

    made = [one(i) for i in range(900)]
    df = docs(spark, [(i, t, None) for i, (t, _) in enumerate(made)] + [(5000, None, None), (5001, "", None), (5002, "a" * 200_000, None)])
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(made)] + [(7777, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in T.score_held_out(df, labels).collect()}
    assert len(got) == 903 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    held = [i for i in range(900) if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(900))
    assert np.mean([got[i]["predicted"] == made[i][1] for i in held]) > 0.97
    assert got[5000]["score"] == got[5001]["score"] and got[5001]["predicted"] == 0
    model = T.train(df, labels)
    kept = T.without_toxic(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {5000, 5001, 5002}
    assert {r["score"] for r in T.score_held_out(df, labels.limit(0)).collect()} == {0.0}
    assert T.score(docs(spark, []), model).count() == 0


def test_repeated_ids_and_rows_do_not_change_the_model(spark):
    rng = np.random.default_rng(12)
    made = [(i, text_of(rng, "aa", 30) + (" zork%d zork" % (i % 7) if i % 3 == 0 else ""), None) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(240)], "doc_id long, toxic int, quality int")
    rows = made + [(i, text_of(rng, "bb", 30), None) for i in range(30)] + made[:5] * 3
    said = [sorted((r["doc_id"], round(r["score"], 9)) for r in T.score(df, T.train(df, labels)).collect()) for df in (docs(spark, rows), docs(spark, rows[::-1]).repartition(5))]
    assert said[0] == said[1] and len(said[0]) == len(rows)


def test_trees_split_where_brute_force_does():
    rng = np.random.default_rng(13)
    x = np.round(rng.normal(size=(80, 3)), 1)
    y = (x[:, 1] + 0.5 * x[:, 2] > 0.3).astype(float)
    weight = rng.uniform(0.5, 2, 80)
    trees = T.Trees(rounds=1, depth=2).fit(x, y, weight)
    p = np.full(80, np.average(y, weights=weight))
    g, h = weight * (y - p), weight * p * (1 - p)

    def grown(rows, depth):
        """Values of the rows by the best split over all features and cuts, searched one by one."""
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + trees.penalty)
        if depth == 0:
            return {i: trees.rate * g[rows].sum() / (h[rows].sum() + trees.penalty) for i in rows}
        best, halves = 1e-6, None
        for j, edges in enumerate(trees.edges):
            for e in edges:
                low = [i for i in rows if x[i, j] <= e]
                high = [i for i in rows if x[i, j] > e]
                gain = score(low) + score(high) - score(rows)
                if gain > best + 1e-12:
                    best, halves = gain, (low, high)
        return grown(rows, 0) if halves is None else grown(halves[0], depth - 1) | grown(halves[1], depth - 1)

    want = grown(list(range(80)), 2)
    base = np.log(p / (1 - p))
    assert np.allclose(trees.probability(x), 1 / (1 + np.exp(-(base + np.array([want[i] for i in range(80)])))))


def test_calibration_does_not_see_its_rows(spark):
    rng = np.random.default_rng(14)
    rows = spark.createDataFrame([(text_of(rng, "aa", 10) + (" only%d" % k if k % 2 else ""), k % 2, k % 4 + 1) for k in range(40)] + [("zork " + text_of(rng, "aa", 5) + " a zork b zork", 1, 1)] * 8, "text string, toxic int, fold int")
    with Scratch(spark, "lexicon-test") as scratch:
        wordless = spark.createDataFrame([("", 0, 2), ("!!!", 1, 3)], rows.schema).repartition(2)  # a part of its own without any word
        whole, *parts = T.learn_lexicons(rows.withColumn("text", F.regexp_replace("text", "only[0-9]+", "")).union(wordless), scratch)
    assert len(parts) == T.FOLDS and parts[0] <= parts[1] | frozenset(T.GIVEN)
    assert "zork" not in parts[0]  # marks of fold 1 alone


def test_obfuscated_words_and_second_person():
    tokens = T.Tokens(frozenset({"idiot", "zork*"}))
    assert tokens["Idiot,"] & T.HIT and tokens["zorked"] & T.HIT
    assert tokens["id1ot"] & T.HIDDEN_HIT and tokens["i.d.i.o.t"] & T.HIDDEN_HIT and not tokens["table"]
    x = dict(zip(T.FEATURES, T.features("YOU idiot! nice", tokens)[0], strict=True))
    assert x["near_you"] > 0 and x["caps_words"] > 0 and x["shouting"] > 0
    assert T.features("", tokens) == [[0.0] * len(T.FEATURES)]
    both = T.Tokens(frozenset({"idiot"}), frozenset({"zork*"}))
    own = [T.features("an id1ot zorked you, idiot", T.Tokens(x))[0] for x in both.lexicons]
    assert T.features("an id1ot zorked you, idiot", both) == own


def test_isotonic_is_the_least_squares_rising_fit():
    x, y = np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1])
    px, level = T.isotonic(x, y, np.ones(5))
    assert np.allclose(np.interp(x, px, level), [0, 0.5, 0.5, 1, 1])


def brute_base(rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = [(d, [*word.findall((t or "").translate(low)), "\n"]) for d, t, _ in rows]
    c = Counter()
    for d, w in own:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    return {d: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for d, w in own}


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(M, "HEAD", 40)  # so that many words lie beyond the head
    monkeypatch.setattr(M, "WORDS", 20)
    monkeypatch.setattr(M, "ENDINGS", 6)
    rng = np.random.default_rng(3)
    rows = [(i, text_of(rng, lang, int(rng.integers(0, 120))), None) for i, lang in enumerate(["aa", "bb", "cc"] * 100)]
    rows += [(500, None, None), (501, "ÄÖ \x1f\x0b TA\tta", None), (502, text_of(rng, "aa", 30_000), None)]
    got = {r["doc_id"]: r for r in M.score_held_out(docs(spark, rows)).collect()}
    want = brute_base(rows)
    for d, (n, known, total, base) in want.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and math.isclose(r["base_score"], base, rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"] and r["n_tokens"] > 10]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert M.score_held_out(docs(spark, [])).count() == 0


def small_model(spark, monkeypatch, scratch):
    """A trained model with a small head, 5 of whose words are symbols, and 3 endings; its counts."""
    rng = np.random.default_rng(4)
    texts = [text_of(rng, "bb", 40) for i in range(30)]
    counts = scratch.keep(M.word_counts(docs(spark, [(i, t, None) for i, t in enumerate(texts)]).select("text")), "counts")
    vocabulary, _ = M.build_vocabulary(counts, scratch, words=5, endings=3, head=30)
    assert vocabulary.own == 5 < len(vocabulary.counts) <= 30 and vocabulary.tail_words.sum() > 0
    rows = spark.createDataFrame([(i, vocabulary.numbers(t)[0].astype("<i4").tobytes()) for i, t in enumerate(texts)], "h long, ids binary")
    model = M.train_model(rows, vocabulary, scratch, group_tokens=300)
    return model, vocabulary, {r["word"]: r["c"] for r in counts.collect() if r["word"] != M.END}


def brute_log10(model, v, counts, text):
    """Score of a text word by word, each from whole softmaxes."""
    symbols, log = [], 0.0
    for word in [*text.split(), M.END]:
        key = word.encode()
        k = M.END_ID if word == M.END else int(v.symbols[v.head[key]]) if key in v.head else v.symbol_of(key)
        h1, h2 = ([0, 0, *symbols])[-2:]
        s = (model.R[h1] @ model.C[0] + model.R[h2] @ model.C[1]) @ model.Q.T + model.b
        log += math.log10(np.exp(s[k]) / np.exp(s[1:]).sum())
        if k >= v.first_class:
            units = v.unit_classes()
            t = np.exp(model.S[h2] @ model.U.T + model.c) * (units == k)
            own = v.head[key] - v.own if key in v.head else len(v.counts) - v.own + k - v.first_class
            log += math.log10(t[own] / t.sum())
            if key not in v.head:
                log += math.log10((counts.get(word, 0) + 1) / (v.tail_count[k] + v.tail_words[k] + 1))
        symbols.append(k)
    return log


def test_scores_are_those_of_whole_softmaxes_and_sum_to_one(spark, monkeypatch):
    with Scratch(spark, "lm-test") as scratch:
        model, v, counts = small_model(spark, monkeypatch, scratch)
    scorer = M.Scorer.of(model, v)

    def score(text):
        at, beyond = v.numbers(text)
        return scorer.parts(at)[3] + sum(math.log10(counts.get(w.decode(), 0) + 1) for w in beyond)

    rng = np.random.default_rng(5)
    for text in ("", "verung", "neu verung", *(text_of(rng, lang, 25) for lang in ("aa", "bb"))):
        assert math.isclose(score(text), brute_log10(model, v, counts, text), abs_tol=1e-3)
    # The chance of each next word is that of the text with it, without its end.
    given, end = "verung", lambda t: scorer.token_log10(*v.streams(v.numbers(t)[0]))[-1]
    chance = lambda w: 10 ** (score(f"{given} {w}") - end(f"{given} {w}") - score(given) + end(given))
    unseen = ["0" + e for e in v.endings] + ["00@@"]  # one for each class
    assert abs(sum(map(chance, [*counts, *unseen])) + 10 ** end(given) - 1) < 1e-3


def test_training_tells_words_of_a_class_apart(spark):
    rng = np.random.default_rng(6)
    pairs = [("aa", "xaing"), ("bb", "xbing")] * 2000
    text = " ".join(w for k in rng.permutation(len(pairs)) for w in pairs[k])
    with Scratch(spark, "lm-test") as scratch:
        counts = scratch.keep(M.word_counts(docs(spark, [(0, text, None)]).select("text")), "counts")
        v, _ = M.build_vocabulary(counts, scratch, words=2, endings=2)
        assert list(v.head) == [b"aa", b"bb", b"xaing", b"xbing"] and v.own == 2 and v.symbols[2] == v.symbols[3]
        ids = v.numbers(text)[0].astype("<i4").tobytes()
        model = M.train_model(spark.createDataFrame([(k, ids) for k in range(4)], "h long, ids binary"), v, scratch)
    scorer = M.Scorer.of(model, v)
    said = lambda t: scorer.parts(v.numbers(t)[0])[3]
    assert said("aa xaing") > said("aa xbing") + 0.3 and said("bb xbing") > said("bb xaing") + 0.3


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(M, "WORDS", 20)
    monkeypatch.setattr(M, "HEAD", 60)
    rng = np.random.default_rng(9)
    rows = [(i, text_of(rng, lang, int(rng.integers(0, 80))), None) for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [rows[3], rows[3], (None, "no id", None), (None, None, None)]
    frame = docs(spark, rows)
    clash = frame.selectExpr("doc_id", "text", "'x' AS h", "1 AS uid", "'y' AS ids", "2 AS learn", "3 AS base")
    results = []
    for df in (frame, frame.repartition(7), clash.orderBy(F.desc("text"))):
        results.append(sorted((r["doc_id"] or -1, r["n_tokens"], round(r["base_score"], 6), round(r["score"], 5)) for r in M.score_held_out(df).collect()))
    assert results[0] == results[1] == results[2] and len(results[0]) == len(rows)


def test_model_survives_packing():
    make = lambda seed: M.LogBilinear(np.ones(9), np.array([5, 5, 6, 7, 8]), np.ones(5), seed)
    a = make(1)
    b = make(2).load(a.packed())
    assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in M.LogBilinear.PARTS)
