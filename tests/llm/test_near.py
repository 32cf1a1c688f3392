"""N-gram Jaccard classes and benchmark copies, against brute force."""

import numpy as np
import pytest

from threadloom.llm import decontaminate as DC
from threadloom.llm import ngram_jaccard as J
from threadloom.llm.common import Scratch
from threadloom.llm.components import connected_components

FIELDS = "doc_id long, text string, lang string, sid int, a string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", 1, "x") for d, t in rows], FIELDS)


def words(rng, n, size=3000):
    return ["w%d" % k for k in rng.integers(0, size, n)]


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(40):
        texts.append(words(rng, int(rng.integers(30, 200))))
    base = words(rng, 120)
    for _ in range(60):  # near copies of one text: more than a small bucket holds
        t = list(base)
        for k in rng.integers(0, len(t), 2):
            t[k] = "new%d" % rng.integers(0, 10**6)
        texts.append(t)
    shared = words(rng, 60)
    texts += [words(rng, 60) + shared + words(rng, 30) for _ in range(40)]  # one passage in otherwise different texts
    texts += [texts[0], texts[0], texts[1][:-1], ["a", "b"], ["a", "b"], []]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "!!!"), (903, " ".join(texts[2]).upper() + "!")]
    return rows + [rows[5]]


def brute(rows):
    sets = [frozenset(J.shingle_set(t).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= J.THRESHOLD * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    classes = {}
    for i, (d, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(d)
    return {d: min(c) for c in classes.values() for d in c}


def brute_links(rows):
    """Other shingle sets that reach the threshold, for each row."""
    sets = {d: frozenset(J.shingle_set(t).tolist()) for d, t in rows}
    different = set(sets.values())
    return {d: sum(x != s and len(x & s) >= J.THRESHOLD * len(x | s) > 0 for x in different) for d, s in sets.items()}


def test_block_products_are_pairwise_jaccard():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(1, 40))), rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64)])) for _ in range(60)]
    for threshold in (0.3, 0.8):
        want = np.array([[J.jaccard(a, b) >= threshold for b in sets[25:]] for a in sets[:25]])
        assert np.array_equal(J.similar(sets[:25], sets[25:], threshold, chunk=16), want)
    assert J.similar(sets[:1], [np.array([5], dtype=np.uint64)], 0.8).tolist() == [[False]]


def test_counts_of_a_large_class_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "SMALL", 3)
    monkeypatch.setattr(J, "COUNT_BLOCK", 7)
    rng = np.random.default_rng(11)
    base = words(rng, 150)
    rows = []
    for i in range(60):
        t = list(base)
        for k in rng.integers(0, len(t), int(rng.integers(1, 5))):
            t[k] = "new%d" % rng.integers(0, 10**6)
        rows.append((i, " ".join(t)))
    rows += [(100, " ".join(words(rng, 20_000))), (None, rows[0][1]), (None, None)]
    got = J.jaccard_classes(frame(spark, rows)).collect()
    want = brute_links(rows)
    assert {r["doc_id"]: r["n_links"] for r in got if r["doc_id"] is not None} == {d: n for d, n in want.items() if d is not None}
    assert J.one_of_each_class(frame(spark, [*rows, (None, rows[0][1]), (None, rows[0][1])])).count() == len({r["class_id"] for r in got if r["class_id"] is not None}) + 1


@pytest.mark.parametrize("small", [2, 16])
def test_classes(spark, monkeypatch, small):
    monkeypatch.setattr(J, "SMALL", small)
    rows = corpus()
    got = J.jaccard_classes(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute(rows) and len(got) == len(rows)
    copies = {r["doc_id"]: (r["n_copies"], r["n_links"]) for r in got}
    assert copies[0][0] == 3 and copies[900] == (4, 0) and copies[1][1] == 1
    assert {d: n for d, (_, n) in copies.items()} == brute_links(rows)


def test_one_of_each_class(spark):
    rows = corpus(1)
    df = frame(spark, rows)
    out = J.one_of_each_class(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(brute(rows).values()))
    assert J.jaccard_classes(frame(spark, [])).count() == 0


def test_depth_reaches_the_recall():
    d = J.matched_depth()
    assert J.recall(d) >= J.TARGET_RECALL > J.recall(d + 1)


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 440)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    with Scratch(spark, "components-test") as scratch:
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {x: find(x) for x in parent}


def brute_score(item, text):
    h = np.zeros((len(item) + 1, len(text) + 1), dtype=int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            s = DC.MATCH if item[i - 1] == text[j - 1] and item[i - 1] else DC.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] - DC.GAP, h[i, j - 1] - DC.GAP)
    return h.max()


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(3)
    for _ in range(100):
        a, b = rng.integers(0, 5, int(rng.integers(1, 12))), rng.integers(0, 5, int(rng.integers(1, 20)))
        assert DC.align(a, b)[0] == brute_score(a, b)


def test_copies_of_items(spark):
    rng = np.random.default_rng(6)
    items = [words(rng, n, 500) for n in (15, 30, 59, 22)]
    bench = spark.createDataFrame([(i, " ".join(t).title(), "x") for i, t in enumerate(items)] + [(9, None, "x"), (10, "", "x"), (11, "two words", "x")], "item_id long, text string, doc_id string")
    edited = [w if k % 6 else "zz" for k, w in enumerate(items[1])]
    longer = [x for k, w in enumerate(items[2]) for x in ([w, "added"] if k % 7 == 3 else [w])]
    rows = [
        (1, " ".join(words(rng, 40) + items[0] + words(rng, 40))),
        (2, ", ".join(words(rng, 40) + edited)),
        (3, " ".join(longer + words(rng, 10))),
        (4, " ".join(words(rng, 400))),
        (5, " ".join(items[3][:6] + words(rng, 60))),
        (6, None),
        (7, ""),
        (8, "so two words here"),
        (1, " ".join(items[0])),
    ]
    df = frame(spark, rows)
    for chars in (DC.BLOCK_CHARS, 150):
        got = DC.contaminated(df, bench, block_chars=chars).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 0), (1, 0), (2, 1), (3, 2), (8, 11)]
        assert all(0.5 <= r["score"] <= 1 for r in got)
    exact = next(r for r in got if r["doc_id"] == 1 and r["first_word"] == 40)
    assert (exact["score"], exact["end_word"]) == (1.0, 55)
    clean = DC.decontaminated(df, bench)
    assert clean.columns == df.columns and sorted(r["doc_id"] for r in clean.collect()) == [4, 5, 6, 7]
    assert DC.contaminated(frame(spark, []), bench).count() == 0 and DC.contaminated(df, bench.limit(0)).count() == 0


def test_copies_with_edits_everywhere_against_full_alignment(spark):
    rng = np.random.default_rng(8)
    items = [words(rng, n, 400) for n in (15, 16, 24, 31, 40, 7)] + [["w1", "w2", "w1", "w2", "w1", "w3"]]
    rows = []
    for item in items:
        for every in (2, 3, 4):
            cut = lambda k, every=every: k % every == every - 1
            changed = ["zz" if cut(k) else w for k, w in enumerate(item)]
            longer = [x for k, w in enumerate(item) for x in ([w, "zz"] if cut(k) else [w])]
            shorter = [w for k, w in enumerate(item) if not cut(k)]
            rows += [words(rng, 30, 400) + t + words(rng, 30, 400) for t in (changed, longer, shorter)]
        rows.append([x for w in item for x in (w, "zz")])
        rows += [list(item), words(rng, 20, 400) + item[: len(item) // 2 + 1]]
    rows += [words(rng, 200, 30) for _ in range(20)]
    texts = frame(spark, [(d, " ".join(t)) for d, t in enumerate(rows)])
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    number = {w: k for k, w in enumerate(sorted({w for t in [*items, *rows] for w in t} - {"zz"}), 1)} | {"zz": 0}
    coded = lambda t: np.array([number[w] for w in t])
    for threshold in (0.5, 0.7):
        want = {}
        for d, t in enumerate(rows):
            for i, item in enumerate(items):
                score = DC.align(coded(item), coded(t))[0] / (DC.MATCH * len(item))
                if score >= threshold:
                    want[(d, i)] = score
        got = DC.contaminated(texts, bench, threshold=threshold).collect()
        assert {(r["doc_id"], r["item_id"]): r["score"] for r in got} == want and len(got) == len(want)
