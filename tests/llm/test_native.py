"""The operators in DataFrame operations: mixing, sharding, line runs."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import line_dedup, mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, size int, shard int, lines int, __key int"


def docs(spark, rows):
    """Rows of (doc_id, text, source) with extra columns of clashing names."""
    return spark.createDataFrame([(*r, 7, 7, 7, 7) for r in rows], DOCS)


ODD = [(1, "a b c", "s1"), (2, None, "s1"), (3, "", None), (None, "a b c", "s2"), (1, "a b c", "s1"), (4, "x " * 5000, "s2"), (5, "   \n\t", None), (6, "a b c", "s3")]


def reference_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > cap * sizes[s]]
        if not over:
            return fixed | t
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), f"s{min(int(rng.exponential(2)), 6)}" if i % 11 else None) for i in range(400)] + ODD
    got = mixing.mix_sources(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = reference_targets(dict(sizes))
    taken, longest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["times"]
        assert r["times"] >= math.floor(r["target"] / max(r["source_size"], 1)) or not r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= longest[s]
    again = mixing.mix_sources(docs(spark, rows).repartition(7)).collect()
    key = lambda r: str((r["doc_id"], r["source"], r["size"], r["taken"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_documents_repeat_rows(spark):
    rows = [(i, "w " * 10, "big" if i < 40 else "tiny") for i in range(44)]
    df = docs(spark, rows)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    want = {r["doc_id"]: r["times"] for r in mixing.mix_sources(df).collect()}
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: v for k, v in want.items() if v})


def test_rows_without_words_come_once(spark):
    rows = [(i, None if i % 2 else "", "tiny") for i in range(20)] + [(50 + i, "w w w", "tiny") for i in range(5)] + [(100 + i, "w " * 50, "big") for i in range(50)]
    times = Counter(r["doc_id"] for r in mixing.mixed_documents(docs(spark, rows)).collect())
    assert all(times[i] == 1 for i in range(20)) and times[50] >= 3
    assert all(r["taken"] == 0 and r["times"] == 1 for r in mixing.mix_sources(docs(spark, rows)).collect() if r["doc_id"] < 20)


def test_equal_rows_stand_or_fall_together(spark):
    rows = [(None, "w w w", "a")] * 300 + [(i, "w " * 7, "a") for i in range(300)] + [(1000 + i, "v " * 9, "b") for i in range(30)]
    got = mixing.mix_sources(docs(spark, rows)).collect()
    assert len({r["times"] for r in got if r["doc_id"] is None}) == 1 and len(got) == len(rows)


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    one = mixing.mix_sources(docs(spark, [(1, None, None)])).first()
    assert (one["size"], one["taken"], one["target"]) == (0, 0, 0.0)


def test_heavier_quality_is_drawn_more_often(spark):
    rows = [(i, ("w " if i % 2 else "#### ") * 10, "a") for i in range(2000)] + [(9000 + i, "w " * 10, "b") for i in range(4000)]
    picked = mixing.mix_sources(docs(spark, rows), weights=(1, 8)).where("source = 'a' AND times > 0").select(F.pmod("doc_id", F.lit(2)).alias("good")).groupBy("good").count().collect()
    n = {r["good"]: r["count"] for r in picked}
    assert n[1] > 1.3 * n[0]


def brute_capacity(sizes, shards):
    def fits(c):
        used, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


def test_minimax_cuts_are_least():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = rng.integers(1, 50, int(rng.integers(1, 40))).tolist()
        shards = int(rng.integers(1, 9))
        capacity, cuts = sharding.minimax_cuts(sizes, shards)
        assert capacity == brute_capacity(sizes, shards)
        runs = np.split(np.array(sizes), cuts[:-1]) if len(cuts) > 1 else [np.array(sizes)]
        assert len(cuts) <= shards and cuts[-1] == len(sizes) and max(int(r.sum()) for r in runs) <= capacity
    assert sharding.minimax_cuts([], 8) == (0, [])


def test_shards(spark):
    import zlib

    rng = np.random.default_rng(2)
    rows = [(i, " ".join(map(str, rng.integers(0, 9, int(rng.integers(1, 80))))), "s") for i in range(3000)] + ODD + [(10_000 + i, "copy of one text", "s") for i in range(500)]
    got = sharding.assign_shards(docs(spark, rows), 8).collect()
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == sorted(str((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for d, t, _ in rows)
    by_text, slots, load = {}, {}, Counter()
    for r in got:
        by_text.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for d, t, _ in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    assert max(load.values()) <= sum(load.values()) / 8 + max(groups.values()) and set(load) <= set(range(8))
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    assert sharding.assign_shards(docs(spark, []), 8).count() == 0


def brute_lines(rows, least):
    """Deleted lines by comparing every window of whole lines with all that begin before it."""
    seq = []
    for d, t in rows:
        lines = [(i, x, len(WORD.findall(x))) for i, x in enumerate((t or "").split("\n"))]
        seq.append((d, [x for x in lines if x[2]]))
    seen, gone = {}, {}
    place = 0
    for d, lines in seq:
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += lines[b][2]
                if n >= least:
                    key = tuple(x[1] for x in lines[a : b + 1])
                    if seen.setdefault(key, place + a) < place + a:
                        gone.setdefault(d, set()).update(x[0] for x in lines[a : b + 1])
        place += len(lines)
    return {d: sorted(s) for d, s in gone.items()}


@pytest.mark.parametrize("least", [1, 5, 12])
def test_line_runs_against_all_windows(spark, least):
    rng = np.random.default_rng(least)
    pool = [" ".join(["w%d" % k] * (1 + k % 4)) for k in range(12)]
    rows = []
    for d in range(30):
        lines = [pool[int(k)] if rng.random() < 0.8 else f"own {d} {j}" for j, k in enumerate(rng.integers(0, 12, int(rng.integers(0, 14))))]
        rows.append((d, "\n".join(lines)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "\n\n" + rows[4][1] + "\n \n"), (103, None), (104, "")]
    df = docs(spark, [(d, t, "s") for d, t in rows])
    want = brute_lines(rows, least)
    got = {r["doc_id"]: list(r["deleted"]) for r in line_dedup.line_decisions(df, min_words=least).collect() if r["n_deleted"]}
    assert got == want
    texts = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(df, min_words=least).collect()}
    assert texts == {d: t if d not in want else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d]) for d, t in rows}


def test_lines_of_nothing(spark):
    assert line_dedup.line_decisions(docs(spark, [])).count() == 0
    assert line_dedup.line_decisions(docs(spark, [(1, None, "s"), (2, "", "s"), (3, " ", "s")])).count() == 0
    long = [(i, "\n".join(f"line {k} of the long text" for k in range(400)), "s") for i in (1, 2)]
    got = {r["doc_id"]: r["n_deleted"] for r in line_dedup.line_decisions(docs(spark, long)).collect()}
    assert got == {1: 0, 2: 400}


def test_short_lines_that_recur_go_by_default(spark):
    rows = [(d, f"own line {d} of this text\n{'all rights reserved here'}\nyes\nother {d} text", "s") for d in range(50)]
    rows += [(60, "yes\nno", "s"), (61, "one two\nthree", "s"), (62, "x\none two\nthree", "s")]
    got = {r["doc_id"]: list(r["deleted"]) for r in line_dedup.line_decisions(docs(spark, rows)).collect() if r["n_deleted"]}
    assert got == brute_lines([r[:2] for r in rows], line_dedup.MIN_WORDS)
    assert all(1 in got[d] for d in range(1, 50)) and 0 not in got and 60 not in got and got[62] == [1, 2]


def test_equal_rows_have_slots_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    rows = [(None, None, "s")] * 500 + [(None, "", "s")] * 20 + [(3, "same", "s")] * 40 + [(i, "text %d" % i, "s") for i in range(100)]
    got = sharding.assign_shards(docs(spark, rows), 4).collect()
    assert len(got) == len(rows) and len({r["shard"] for r in got if r["size"] == 1}) == 1
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    again = sharding.assign_shards(docs(spark, rows).repartition(5), 4).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
