"""The whole run on a small corpus, stage by stage against brute force."""

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as P
from threadloom.llm import decontaminate, mixing, ngram_jaccard, toxicity
from threadloom.llm.common import Scratch
from threadloom.llm.queries import tokenizer_file


def test_run(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(0)
    vocabulary = ["w%d" % k for k in range(2000)]
    draw = lambda n: list(rng.choice(vocabulary, n))
    items = [draw(25) for _ in range(3)]
    texts = [draw(int(rng.integers(20, 120))) for _ in range(200)]
    for i in range(0, 80, 4):
        for _ in range(4):
            texts[i].insert(int(rng.integers(0, len(texts[i]))), str(rng.choice(["idiot", "moron"])))
    texts += [texts[1], texts[1][:-1] + ["other"], texts[2]]
    texts += [draw(30) + items[0] + draw(30), draw(5) + items[1]]
    rows = [(i, " ".join(t), "en", f"s{i % 5}", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 80 and i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = P.table(spark, str(tmp_path), "documents")
    held = {"": {r[0]: r[1] for r in rows}}
    frames = {"": docs}
    scratch = Scratch(spark, "test")
    before = ""
    for name, stage in P.STAGES[:4]:
        frames[name] = scratch.keep(stage(spark, frames[before], str(tmp_path)), name)
        assert frames[name].columns == docs.columns
        held[name] = {r["doc_id"]: r["text"] for r in frames[name].collect()}
        before = name
    model = toxicity.train(docs, P.table(spark, str(tmp_path), "labels"))
    assert set(held["toxicity"]) == {d for d, t in held[""].items() if model.score([t])[0] < toxicity.THRESHOLD}
    assert sum(i in held["toxicity"] for i in range(0, 80, 4)) <= 5 and all(i in held["toxicity"] for i in range(1, 200) if i % 4)
    sets = {d: frozenset(ngram_jaccard.shingle_set(t).tolist()) for d, t in held["toxicity"].items()}
    near = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert set(held["near_duplicates"]) == {d for d in sets if not any(e < d and near(d, e) for e in sets)}
    copies = {d for d, t in held["near_duplicates"].items() if any(" ".join(x) in (t or "") for x in items)}
    assert copies and set(held["decontamination"]) == set(held["near_duplicates"]) - copies
    times = {r["doc_id"]: r["times"] for r in mixing.mix_sources(frames["decontamination"]).collect()}
    mixed = frames["mixing"].collect()
    assert Counter(r["doc_id"] for r in mixed) == Counter({d: n for d, n in times.items() if n})
    assert decontaminate.THRESHOLD == 0.5
    out = P.run(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(tokenizer_file())
    want = Counter()
    for r in mixed:
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[(r["doc_id"], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
    ordered = sorted(out, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [0, *np.cumsum([r["n_tokens"] for r in ordered])[:-1].tolist()]


def write_tables(spark, folder, rows, fields, labels=(), items=()):
    spark.createDataFrame(rows, fields).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables(spark, tmp_path):
    write_tables(spark, tmp_path, [], FIELDS)
    docs = P.table(spark, str(tmp_path), "documents")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert P.run(spark, str(tmp_path)).count() == 0


def test_nulls_long_texts_repeats_and_clashing_columns(spark, tmp_path):
    rng = np.random.default_rng(1)
    draw = lambda n: " ".join("w%d" % k for k in rng.integers(0, 3000, n))
    rows = [(i, draw(60), "en", "s", 1, "k", 0.5, 7) for i in range(20)]
    rows += [(100, draw(30_000), "en", "long", 1, "k", 0.5, 7), rows[0], rows[0], (None, draw(40), None, None, None, None, None, None), (101, None, None, None, None, None, None, None), (102, "", "en", "s", 0, "k", 0.5, 7)]
    write_tables(spark, tmp_path, rows, FIELDS + ", digest string, score double, nid int")
    docs = P.table(spark, str(tmp_path), "documents")
    kept = {name: [r.asDict() for r in stage(spark, docs, str(tmp_path)).collect()] for name, stage in P.STAGES[:-1]}
    assert all(set(r) == set(docs.columns) for found in kept.values() for r in found)
    ids = {name: Counter(r["doc_id"] for r in found) for name, found in kept.items()}
    assert ids["toxicity"] == ids["decontamination"] == Counter(r[0] for r in rows)  # neither labels nor items: all stay
    assert ids["near_duplicates"] == Counter({*range(20), 100, 101, None})  # one of the equal rows, one of the empty texts
    assert ids["mixing"][101] == ids["mixing"][102] == 1 and ids["mixing"][0] % 3 == 0 and ids["mixing"][100] >= 1
    out = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= {*range(20), 100, 101, None} and sum(r["doc_id"] == 101 for r in out) == 1
