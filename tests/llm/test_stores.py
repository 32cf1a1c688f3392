"""Media shards and the token store, by exact round trips."""

import hashlib
import tarfile
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from threadloom.llm import media as ME
from threadloom.llm import token_store as TS
from threadloom.llm.common import Scratch, fresh_path
from threadloom.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, start long, digest string, uid int"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, 0, "x", 0) for d, t in rows], DOCS)


def rows_of(rng):
    rows = [(int(i), " ".join("w%d" % k for k in rng.integers(0, 50, int(rng.integers(0, 300))))) for i in rng.permutation(60)]
    return rows + [(100, None), (101, ""), (102, "é" * 64), (103, "x" * 64), (104, "y" * 200_000), (7, rows[3][1]), (7, rows[3][1]), (None, "no id"), (105, "a  b\n\n\nc <|endoftext|> d\t e　f ")]


def test_png_round_trip():
    for n in (0, 1, 63, 64, 65, 5000):
        payload = ME.padded(bytes(range(256)) * 20)[: max(64, n // 64 * 64)]
        stored = ME.encode_png(payload)
        assert ME.decode_png(stored) == payload and ME.png_header(stored[: ME.HEADER_BYTES])[:2] == (64, len(payload) // 64)
    with pytest.raises(ValueError):
        ME.decode_png(stored[:60] + b"\0\0" + stored[62:])


def test_media_columns(spark):
    rows = rows_of(np.random.default_rng(0))
    got = ME.media_columns(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for d, t in rows:
        by_id.setdefault(d, []).append((t or "").encode())
    for r in got:
        data = next(d for d in by_id[r["doc_id"]] if len(d) == r["n_bytes"])
        payload = ME.padded(data)
        assert r["payload_bytes"] == len(payload) and r["payload_bytes"] % 64 == 0 and r["payload_bytes"] > 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(ME.encode_png(payload)).hexdigest() and r["feature"] == ME.describe(payload)
    places = {(r["shard"], r["offset"]) for r in got}
    assert len(places) == len({ME.padded((t or "").encode()) for _, t in rows})  # stored once each
    fs, path = pafs.FileSystem.from_uri(got[0]["shard"])
    with tarfile.open(path) as tar:
        member = next(m for m in tar.getmembers() if m.offset_data == got[0]["offset"])
        assert member.name == f"{got[0]['payload_sha256']}.png" and member.size == got[0]["length"]
    assert ME.media_columns(docs(spark, [])).count() == 0


def test_payloads_that_moved_between_reads_are_stored(spark):
    rows = rows_of(np.random.default_rng(5))
    first, again = docs(spark, rows).repartition(5, "doc_id"), docs(spark, rows[::-1]).repartition(3, "text")
    with Scratch(spark, "media") as scratch:
        index = ME.store(again, scratch.keep(ME.digests(first), "rows"), scratch).collect()
    assert sorted(bytes(r["digest"]) for r in index) == sorted({hashlib.sha256(ME.padded((t or "").encode())).digest() for _, t in rows})


def expected_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_store(spark):
    rows = rows_of(np.random.default_rng(1))
    root = fresh_path(spark, "tokens")
    TS.write_store(docs(spark, rows).repartition(3), tokenizer_file(), root)
    recipes = spark.read.parquet(f"{root}/recipes")
    got = TS.read_store(spark, root, with_ids=True).collect()
    want = {}
    for (d, _), ids in zip(rows, expected_ids([t for _, t in rows]), strict=True):
        want.setdefault(d, []).append(ids)
    assert len(got) == len(rows)
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert list(r["ids"]) in want[r["doc_id"]] and r["start"] == start and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        start += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    refs = {}
    for r in recipes.select("refs").collect():
        for x in r["refs"]:
            refs.setdefault(bytes(x["hash"]), set()).add((x["uri"], x["frame"], x["at"]))
    assert all(len(p) == 1 for p in refs.values())  # each chunk lies in one place
    assert TS.store_and_read(docs(spark, []), tokenizer_file()).count() == 0


def test_damage_is_noticed(spark):
    root = fresh_path(spark, "tokens")
    TS.write_store(docs(spark, [(1, "some words to keep " * 50)]), tokenizer_file(), root)
    uri = spark.read.parquet(f"{root}/recipes").first()["refs"][0]["uri"]
    fs, path = pafs.FileSystem.from_uri(uri)
    with open(path, "rb") as f:
        data = bytearray(f.read())
    data[20] ^= 0xFF
    with open(path, "wb") as f:
        f.write(data)
    with pytest.raises(Exception):  # noqa: B017
        TS.read_store(spark, root).collect()


@pytest.mark.parametrize("fan", [2, 256])
def test_lost_and_moved_recipes_are_noticed(spark, monkeypatch, fan):
    monkeypatch.setattr(TS, "FAN", fan)
    whole = TS.write_store(docs(spark, [(d, "text number %d" % d) for d in range(9)]), tokenizer_file())
    assert TS.read_store(spark, whole).count() == 9
    manifest, recipes = spark.read.parquet(f"{whole}/manifest"), spark.read.parquet(f"{whole}/recipes")
    assert manifest.where("node = 0").orderBy(F.desc("level")).first()["documents"] == 9
    other = manifest.withColumn("root", F.when(F.col("level") == 0, F.sha2("root", 256)).otherwise(F.col("root")))
    for name, r, m in (("lost", recipes.where("nth <> 4"), manifest), ("moved", recipes.withColumn("start", F.col("start") + 1), manifest), ("other", recipes, other)):
        root = fresh_path(spark, f"tokens-{name}")
        r.write.partitionBy("part").parquet(f"{root}/recipes")
        m.write.parquet(f"{root}/manifest")
        with pytest.raises(ValueError, match="manifest"):
            TS.read_store(spark, root)


def test_scratch_goes_and_results_stay(spark):
    with Scratch(spark, "try") as s:
        kept = s.keep(spark.range(3), "kept")
        found = s.result(kept.selectExpr("id * 2 AS id"))
    assert sorted(r["id"] for r in found.collect()) == [0, 2, 4]
    fs, path = pafs.FileSystem.from_uri(s.root)
    assert fs.get_file_info(path).type == pafs.FileType.NotFound


def test_cuts_follow_content():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50_000, 60_000).astype("<u4")
    ends = TS.cut_points(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= TS.MOST and sizes[:-1].min() >= TS.LEAST
    moved = TS.cut_points(np.concatenate([ids[:7], ids]))
    assert len({e - 7 for e in moved} & set(ends)) > 0.8 * len(ends)
    assert TS.cut_points(ids[:0]) == [] and TS.cut_points(ids[:3]) == [3]


def test_merkle_root():
    a, b, c = (bytes([k]) * 16 for k in (1, 2, 3))
    h = lambda *x: hashlib.blake2b(b"".join(x), digest_size=16).digest()
    assert TS.merkle_root([a]) == a and TS.merkle_root([a, b, c]) == h(h(a, b), c) and TS.merkle_root([]) == bytes(16)


def test_encoder_equals_the_library():
    rng = np.random.default_rng(3)
    alphabet = list("ab zé.,'\n \t!0A_世") + ["  ", "\n\n", "don't ", "<|endoftext|>", " \n", "x y"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 60)))) for _ in range(1500)]
    got = TS.Encoder(tokenizer_file(), most_pieces=50).encode(texts)
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [e[:-1] for e in expected_ids(texts)]


def test_texts_are_drawn_and_cut_some_millions_of_characters_at_once():
    rng = np.random.default_rng(4)
    words = np.array(["w%d" % k for k in range(20_000)])
    texts, drawn = [" ".join(rng.choice(words, 50_000)) for _ in range(40)], []
    encoder = TS.Encoder(tokenizer_file())
    tracemalloc.start()
    try:
        got = encoder.encode(drawn.append(k) or t for k, t in enumerate(texts))
        sizes = [len(next(got))]
        assert len(drawn) < 8
        sizes += map(len, got)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40e6 and len(drawn) == 40
    assert sizes == [4 * len(e) - 4 for e in expected_ids(texts)]


def test_small_batches_last_as_long_as_asked(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, rows = spark.conf.get(name), spark.range(0, 8_000, 1, 1).selectExpr("id", "repeat('x', 2000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    with pytest.raises(ValueError, match="end"), TS.small_batches(spark):
        assert max(r["n"] for r in rows.mapInArrow(sizes, "n long").collect()) < 3 << 20
        raise ValueError("end")
    assert spark.conf.get(name) == before


def test_new_words_meet_the_model_alone_and_their_signs_once():
    encoder, wholes = TS.Encoder(tokenizer_file()), []
    whole = encoder.whole
    encoder.whole = lambda piece: wholes.append(piece) or whole(piece)
    words = ["".join(chr(97 + k // 26**j % 26) for j in range(3)) + sign for k in range(1000) for sign in ("***", ",.", "")]
    texts = [" ".join(words), "\n".join(words), "  ".join(words)]
    got = list(encoder.encode(texts)) + list(encoder.encode(texts))
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [e[:-1] for e in expected_ids(texts * 2)]
    assert len(wholes) < 20
