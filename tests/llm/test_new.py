"""Centroids, periodic runs and near duplicates against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from threadloom.llm import centroids, language_id, near_dedup, periodic_runs


def lloyd(rows, k=8, rounds=10, dims=64):
    """(cluster, distance) of each kept row, the centroids, by Python integers."""
    kept = [(i, [math.floor(1024 * float(e)) for e in v]) for i, v in rows if v is not None and len(v) == dims and all(e is not None and math.isfinite(e) for e in v)]
    middle = [x for _, x in sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)[:k]]

    def place():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(middle)) for _, x in kept]

    for _ in range(rounds):
        placed = place()
        for n in range(len(middle)):
            own = [x for (_, x), (_, c) in zip(kept, placed) if c == n]
            if own:
                middle[n] = [sum(col) // len(own) for col in zip(*own)]
    return kept, place(), middle


VECTORS = "vec_id long, embedding array<float>, cluster string, x int"


def test_centroids_brute_force(spark):
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(5, 64))
    rows = [(i, [float(np.float32(e)) for e in heads[i % 5] + 0.4 * rng.normal(size=64)]) for i in range(180)]
    same = rows[7][1]
    rows += [(7, same), (7, same), (500, same), (None, same)]  # repeated rows, a common vector, a null id
    rows += [(600, None), (601, same[:63]), (602, same + [0.0]), (603, [None] + same[1:]), (604, [math.nan] + same[1:]), (605, [math.inf] + same[1:]), (606, [])]
    got = centroids.cluster_vectors(spark.createDataFrame([(*r, "clash", 1) for r in rows], VECTORS)).collect()
    kept, placed, middle = lloyd(rows)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    of = [sum(d for d, c in placed if c == n) for n in range(len(middle))]
    want = [(i, c, d, of[c], sum(of), names[c]) for (i, _), (d, c) in zip(kept, placed)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_centroids_few_equal_large_and_none(spark):
    assert centroids.cluster_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    assert centroids.cluster_vectors(spark.createDataFrame([(1, None, "", 0)], VECTORS)).collect() == []
    got = centroids.cluster_vectors(spark.createDataFrame([(i, [1.5] * 64, "", 0) for i in range(3)], VECTORS)).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in got] == [(0, 0, 0)] * 3  # of equal centroids the smaller number
    far = centroids.cluster_vectors(spark.createDataFrame([(1, [3e38] * 64, "", 0), (2, [-3e38] * 64, "", 0)], VECTORS)).collect()
    assert all(r.distance == 0 for r in far)


def test_partial_distances_equal_whole_ones():
    rng = np.random.default_rng(5)
    x, c = rng.integers(-9, 9, size=(400, 64)), rng.integers(-9, 9, size=(8, 64))
    c[5] = c[2]  # a tie for every vector
    whole = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    of, best = centroids.nearest(x, c)
    assert (of == whole.argmin(axis=1)).all() and (best == whole.min(axis=1)).all()


def all_runs(w):
    """(start, length, period) by trying every period at every place."""
    found, n = {}, len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(24, 3 * q):
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, m, q) for (s, m), q in found.items())


def some_words(rng, most):
    w = []
    while len(w) < most:
        kind, size = rng.random(), rng.randint(1, 40)
        if kind < 0.3:
            w += [f"w{rng.randint(0, 60)}" for _ in range(size)]
        elif kind < 0.5:
            w += [rng.choice("ab") for _ in range(size)]
        else:
            period = [f"p{rng.randint(0, rng.choice([0, 1, 3, 90]))}" for _ in range(rng.randint(1, 25))]
            w += (period * 9)[: rng.randint(1, 6 * len(period))]
    return w


def test_runs_equal_all_periods():
    rng = random.Random(11)
    for most in [1, 23, 24, 25, 60] * 40 + [300] * 60:
        w = some_words(rng, most)
        assert periodic_runs.document_runs(w) == all_runs(w)
    assert periodic_runs.minimum_overlap() == 16
    twelve = [str(i) for i in range(12)]
    assert periodic_runs.document_runs((twelve * 3)[:36]) == [(0, 36, 12)] and periodic_runs.document_runs((twelve * 3)[:35]) == []  # just a run, and not
    assert periodic_runs.document_runs(["x"] * 24) == [(0, 24, 1)] and periodic_runs.document_runs(["x"] * 23) == []


def contract_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, " ".join(kept))]
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], *digest)


def test_periodic_runs_whole_rows(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(some_words(rng, rng.choice([1, 20, 80, 200])))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n"), (3, rows[3][1]), (3, rows[3][1]), (203, "é\u00a0" * 20 + "b " * 30)]  # no-break spaces part no words
    rows += [(10**15 + 7, " ".join(some_words(rng, 300)))]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_runs string")
    got = sorted(map(str, map(tuple, periodic_runs.periodic_runs(docs, planted=True).collect())))
    assert got == sorted(str(contract_row(*r)) for r in rows)
    assert sum(1 for r in rows if zlib.crc32(str(r[0]).encode()) % 10 == 0) > 5
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []


def test_periodic_runs_of_a_long_text_and_a_null_id(spark):
    passage = [f"w{i}" for i in range(40_000)]
    long = " ".join([*passage, *["a", "b", "c"] * 20_000, *passage])  # the passage repeats without being a run
    docs = spark.createDataFrame([(None, long), (None, None)], "doc_id long, text string")
    found = {r.n_runs: r for r in periodic_runs.periodic_runs(docs, planted=True, with_text=True).collect()}
    assert [tuple(x) for x in found[1].runs] == [(40_000, 60_000, 3)] and found[1].exponent_milli == 20_000_000
    assert found[1].collapsed == " ".join([*passage, "a", "b", "c", *passage]) and found[0].collapsed == ""


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def near_classes(rows):
    """(doc_id, set size, least id of its class, kept) of each row: every pair of different sets is compared."""
    sets = [shingles(t) for _, t in rows]
    first, up = {}, list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        if s:
            up[root(i)] = root(first.setdefault(s, i))
    own = list(first.values())
    holders = defaultdict(list)
    for i in own:
        met = defaultdict(int)
        for g in sets[i]:
            for j in holders[g]:
                met[j] += 1
            holders[g].append(i)
        for j, both in met.items():
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        known = least.get(r)
        least[r] = doc_id if known is None else known if doc_id is None else min(known, doc_id)
    return sorted(str((d, len(s), least[root(i)], d == least[root(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_rows(rng, n):
    """Texts with copies, near copies at all likenesses, chains of small steps, and a passage that many share."""
    vocabulary = [f"v{i}" for i in range(3000)]
    passage, rows = " ".join(rng.choices(vocabulary, k=60)), []
    while len(rows) < n:
        w = rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 8, 30, 60, 200]))
        kind = rng.random()
        if kind < 0.3:
            rows.append(f"{' '.join(w)} {passage}")
        else:
            for _ in range(rng.randint(1, 12)):
                rows.append(" ".join(w))
                for _ in range(rng.randint(0, 1 + len(w) // 40)):
                    w = list(w)
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
    ids = rng.sample(range(10**12), len(rows))
    return list(zip(ids, rows))


DOCS = "doc_id long, text string, component_id string, nid int"


def test_near_duplicates_brute_force(spark):
    rng = random.Random(21)
    rows = near_rows(rng, 1200)
    head = rng.choices([f"u{i}" for i in range(500)], k=120)
    rows += [(i, " ".join(head[:k] + [f"edit{i}"] + head[k + 1 :])) for i, k in enumerate(rng.choices(range(120), k=300))]  # a large group of near copies
    mixes = [" ".join(rng.choices([f"m{i}" for i in range(2000)], k=25)) for _ in range(4)]
    rows += [(2000 + i, " ".join([*rng.sample(mixes, 3), f"own{i} " * 9])) for i in range(200)]  # crowded buckets, many likenesses near the threshold
    rows += [(5000, None), (5001, ""), (5002, " \t"), (5003, None), (5004, "One TWO"), (5005, "one two"), (5006, "ÉCOLE a b c"), (5007, "école a b c")]
    rows += [rows[0], rows[0], (rows[0][0], "other words of the same id")]
    got = near_dedup.near_duplicates(spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)).collect()
    assert sorted(str(tuple(r)) for r in got) == near_classes(rows)


def test_near_duplicates_null_ids_empty_and_long(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, "a b c d e"), (None, "a b c d e"), (9, long), (8, long + " tail"), (7, None), (None, None)]
    got = sorted(map(str, map(tuple, near_dedup.near_duplicates(spark.createDataFrame([(*r, "", 0) for r in rows], DOCS)).collect())))
    assert got == sorted(map(str, [(None, 2, None, True), (None, 2, None, True), (9, 59_997, 8, False), (8, 59_998, 8, True), (7, 0, 7, True), (None, 0, None, True)]))
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], DOCS)
    assert sorted(r.doc_id for r in near_dedup.one_of_each(docs).collect() if r.doc_id is not None) == [7, 8]


def test_superminhash_estimates_and_stops_early():
    rng = np.random.default_rng(8)
    for n in (1, 7, 90, 1500):
        pairs = []
        for _ in range(60):
            x = rng.integers(0, 1 << 62, size=n + n // 4, dtype=np.uint64)
            pairs += [x[:n], x[n // 4 :]]
        found = near_dedup.signatures(pairs)
        assert (found == near_dedup.signatures(pairs[::-1])[::-1]).all()  # no other set counts
        true = [len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in zip(pairs[::2], pairs[1::2])]
        assert abs((found[::2] == found[1::2]).mean() - np.mean(true)) < 0.02
        assert (found >> np.uint64(32)).max() < 180 and (n < 1500 or (found >> np.uint64(32)).max() <= 3)
    one = near_dedup.signatures([np.array([5], dtype=np.uint64)])[0] >> np.uint64(32)
    assert sorted(one.tolist()) == list(range(180))  # one element ranks every place once


def test_figures_are_no_letters():
    assert [language_id.has_letters(t) for t in ("² ½ ① 12_3 !", "", None, "²a", "你", "ª")] == [False, False, False, True, True, True]


def test_stores_go_with_the_results(spark):
    from threadloom import scratch
    from threadloom.llm import media, queries, token_store

    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    before = len(scratch._results)
    assert media.media_columns(docs).count() == 2 and token_store.store_and_read(docs, queries.tokenizer_file()).count() == 2
    assert {"media", "tokens"} <= {p.rsplit("/", 1)[1].split("-")[0] for p in scratch._results[before:]}
