"""Near-duplicate classes by SuperMinHash signatures, banding, verification on whole sets and union-find grouping.

A document is its set of four-word shingles; documents of equal sets are one node, so copies never meet as pairs. In a
SuperMinHash signature each element ranks all places by a permutation of its own: at step j it offers j plus a fraction to
one place that it has not offered to before. Ranks of one element are thus correlated, which lowers the variance of the
estimate, and once every place holds an offer of an earlier step no later one can win, so a set of many elements ends after
a step or two. The steps of many sets run side by side in numpy.

Signatures are cut into bands. Members of a small bucket meet as pairs; those of a crowded one meet two of its members, and
what these links leave outside the bucket's main class meets all its members block by block, on a byte of each place of the
signature, and in the end of several signatures: pairs in different classes that can be at the threshold go on. Each pair is verified on its whole sets before it
is a link. Links shrink to a forest by union-find within a task; rounds over the forests give the classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import Scratch, give_back
from threadloom.llm.components import connected_components

SHINGLE, PERCENT = 4, 80
#: Rows of a band and bands: a pair at 0.8 misses all bands with a chance of 6 in ten million.
ROWS, BANDS = 5, 36
PLACES = ROWS * BANDS
#: Different texts up to which a bucket's members meet as pairs.
SMALL = 16
#: Standard deviations by which the likeness of two signatures may miss the threshold; members of a block.
SIGMAS, BLOCK = 5.0, 512
#: Signatures by which the last of a crowded bucket are compared.
LONG = 4
#: Shingles whose steps run side by side.
CHUNK = 1 << 16
#: Node ids up to which the texts to verify are picked by a broadcast of ids, 8 bytes each; beyond it by a shuffled semi join.
BROADCAST_IDS = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(np.iinfo(np.uint64).max)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _WordHash()


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of a UTF-8 text's shingles: A-Z lower-cased, words parted by 0x20 and 0x09 to 0x0D; of fewer words one."""
    found = (text or b"").lower().split()
    w = np.fromiter(map(_words.__getitem__, found), dtype=np.uint64, count=len(found))
    k = min(size, len(w))
    if not k:
        return w
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = h * _ODD + w[j : len(w) - k + 1 + j]
    return np.unique(_mixed(h))


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash of each set: step in the upper, fraction in the lower 32 bits of each place. ``places`` is at most 256."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full((len(sets), places), _EMPTY, dtype=np.uint64)
    order = np.argsort(-sizes, kind="stable")  # sets of like size end after like numbers of steps
    ends = np.cumsum(sizes[order])
    at = 0
    while at < len(order):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
        _offer([sets[i] for i in order[at:upto]], order[at:upto], out)
        at = upto
    return out


def _offer(sets: list[np.ndarray], rows: np.ndarray, out: np.ndarray) -> None:
    places = out.shape[1]
    x, owner = np.concatenate(sets), np.repeat(rows, [len(s) for s in sets])
    flat, rank = out.reshape(-1), None
    for j in range(places):
        if not len(x):
            return
        draw = _mixed(x + np.uint64((j + 1) * int(_ODD) & int(_EMPTY)))
        pick = j + (((draw >> np.uint64(32)) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)
        if rank is None:
            slot = pick
        else:
            each = np.arange(len(x))
            slot = rank[each, pick]
            rank[each, pick] = rank[:, j]
        np.minimum.at(flat, owner * places + slot, (np.uint64(j) << np.uint64(32)) | (draw & np.uint64(0xFFFFFFFF)))
        waiting = (out[rows] == _EMPTY).any(axis=1)
        rows = rows[waiting]
        stays = np.isin(owner, rows) if len(rows) else np.zeros(len(owner), dtype=bool)
        if rank is None:  # the first step swaps places 0 and pick
            x, owner, pick = x[stays], owner[stays], pick[stays]
            rank = np.tile(np.arange(places, dtype=np.uint8), (len(x), 1))
            rank[np.arange(len(x)), pick] = 0
        elif not stays.all():
            x, owner, rank = x[stays], owner[stays], rank[stays]


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    cut = signature.reshape(len(signature), -1, rows)
    key = np.arange(cut.shape[1], dtype=np.uint64)[None, :] + np.zeros((len(cut), 1), dtype=np.uint64)
    for r in range(rows):
        key = _mixed(key * _ODD + cut[:, :, r])
    return key.view(np.int64)


def place_bytes(signature: np.ndarray) -> np.ndarray:
    """A byte of each place."""
    return (_mixed(signature) >> np.uint64(56)).astype(np.uint8)


def spread_factor(union: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Variance of a SuperMinHash estimate against that of independent ranks, for unions of so many elements: below 1, rising."""
    u = np.maximum(np.asarray(union, dtype=np.float64), 2.0)[..., None]
    step = np.arange(1, places, dtype=np.float64)
    own = np.log(step / places)
    near = [np.log(np.maximum(step + d, 1e-300) / (places - 1)) for d in (1, -1, 0)]
    up, down, same = (np.exp(u * (own + x)) for x in near)
    return 1.0 - ((up + down - 2.0 * same).sum(axis=-1)) * (places - 1) / (u[..., 0] - 1.0)


_UNIONS = np.unique(np.geomspace(2, 1 << 22, 400).astype(np.int64))
_SPREAD = spread_factor(_UNIONS)


def least_like(union: np.ndarray, percent: int = PERCENT, rounds: int = 1) -> np.ndarray:
    """Equal places that so many signatures of sets at the threshold have at least, but for SIGMAS standard deviations of chance."""
    p, places = percent / 100.0, PLACES * rounds
    known = np.minimum(np.searchsorted(_UNIONS, union), len(_UNIONS) - 1)  # the next larger union, of larger variance
    return places * p - SIGMAS * np.sqrt(places * p * (1.0 - p) * _SPREAD[known])


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, set, n_shingles, keys, likeness) of each row; keys and likeness once a task for each set, for the empty one never."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                own = batch.slice(at, 1024)
                sets = [shingle_set(t) for t in own.column(1).cast(pa.binary()).to_pylist()]
                names = [_set_id(s) for s in sets]
                new = [i for i, s in enumerate(sets) if len(s) and names[i] not in seen and not seen.add(names[i])]
                keys, likeness = [None] * len(sets), [None] * len(sets)
                if new:
                    found = signatures([sets[i] for i in new])
                    for i, k, b in zip(new, band_keys(found), place_bytes(found), strict=True):
                        keys[i], likeness[i] = k, b.tobytes()
                columns = [pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(likeness, pa.binary())]
                yield pa.RecordBatch.from_arrays([own.column(0), *columns], ["doc_id", "set", "n_shingles", "keys", "likeness"])
        _words.clear()
        give_back()

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, set binary, n_shingles long, keys array<long>, likeness binary")


def _of_texts(docs: DataFrame, ends: DataFrame, nodes: DataFrame, made: Callable[[list[np.ndarray]], list[bytes]], scratch: Scratch) -> DataFrame:
    """(nid, made) of the given nodes: what ``made`` gives for the sets of whole texts, one row's text of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingle_set(t) for t in batch.slice(at, 512).column(0).cast(pa.binary()).to_pylist()]
                own = {n: s for n, s in zip(map(_set_id, sets), sets, strict=True) if n not in seen and len(s)}
                seen.update(own)
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(made(list(own.values())), pa.binary())], ["set", "made"])
        _words.clear()
        give_back()

    wanted = scratch.keep(ends.join(nodes.select("nid", "set", "rep"), "nid"), "wanted")
    ids = wanted.select(F.col("rep").alias("__rep")).distinct()
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"].eqNullSafe(F.col("__rep")), "left_semi").select("text")
    found = texts.mapInArrow(run, "set binary, made binary").dropDuplicates(["set"])
    return scratch.keep(found.join(wanted.select("nid", "set"), "set").select("nid", "made"), "made")


def _long_likeness(sets: list[np.ndarray]) -> list[bytes]:
    """Bytes of LONG signatures, each by permutations of its own."""
    if not sets:
        return []
    parts = [place_bytes(signatures([_mixed(s + np.uint64(0xA5A5A5A5 * (k + 1))) for s in sets])) for k in range(LONG)]
    return [row.tobytes() for row in np.hstack(parts)]


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes with 100 * intersection >= percent * union of their whole shingle sets."""
    ends = pairs.select(F.col("a").alias("nid")).union(pairs.select(F.col("b").alias("nid"))).distinct()
    found = _of_texts(docs, ends, nodes, lambda sets: [x.tobytes() for x in sets], scratch)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in zip(pdf["sa"], pdf["sb"], strict=True)]
            yield pdf.loc[ok, ["a", "b"]]

    left, right = found.select(F.col("nid").alias("a"), F.col("made").alias("sa")), found.select(F.col("nid").alias("b"), F.col("made").alias("sb"))
    return scratch.keep(pairs.join(left, "a").join(right, "b").mapInPandas(compare, "a long, b long"), "links")


def spanning_forest(links: DataFrame) -> DataFrame:
    """Fewer links of the same classes: a task passes on those that join two of its trees, by union-find."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent.get(x, x)
            return top

        for pdf in batches:
            kept = []
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                ra, rb = root(a), root(b)
                kept.append(ra != rb)
                parent[max(ra, rb)] = min(ra, rb)
            yield pdf.loc[kept]

    return links.select("a", "b").mapInPandas(run, "a long, b long")


def _candidates(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to verify, and the members (key, nid, n) of crowded buckets."""
    under = nodes.select("nid", F.explode("keys").alias("key"))
    buckets = under.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("nid").alias("low"), F.max("nid").alias("high")).where("n > 1")
    members = scratch.keep(under.join(buckets, "key"), "members")
    small, crowded = members.where(F.col("n") <= SMALL).select("key", "nid"), members.where(F.col("n") > SMALL)
    met = small.withColumnRenamed("nid", "a").join(small.withColumnRenamed("nid", "b"), "key").where("a < b").select("a", "b")
    spokes = crowded.select(F.col("low").alias("a"), F.col("nid").alias("b")).union(crowded.select(F.col("nid").alias("a"), F.col("high").alias("b")))
    pairs = met.union(spokes).where("a <> b").distinct()
    return scratch.keep(pairs, "pairs"), crowded.select("key", "nid", "n")


def _open_members(crowded: DataFrame, classes: DataFrame, nodes: DataFrame, scratch: Scratch, docs: DataFrame | None = None) -> DataFrame | None:
    """Members of crowded buckets that hold several classes, each marked stray if it is outside its bucket's main class.

    With the documents, their likeness is that of LONG signatures.
    """
    placed = crowded.join(classes, crowded["nid"] == classes["node"], "left").select("key", "nid", "n", F.coalesce("component", "nid").alias("component"))
    placed = scratch.keep(placed, "placed")
    parts = placed.groupBy("key", "n", "component").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("key", "n").agg(F.max(F.struct("m", "component")).alias("top")).where("top.m < n")
    main = scratch.keep(main.select("key", "n", F.col("top.component").alias("main"), (F.col("n") - F.col("top.m")).alias("outside")), "main")
    if not main.limit(1).count():
        return None
    members = scratch.keep(placed.drop("n").join(main, "key"), "open")
    buckets = members.groupBy("nid").agg(F.collect_set("key").alias("keys"))  # one a band at most
    sizes = nodes.select("nid", "n_shingles", *["likeness"] * (docs is None))
    seen = buckets.join(sizes, "nid")
    if docs is not None:
        seen = seen.join(_of_texts(docs, buckets.select("nid"), nodes, _long_likeness, scratch).withColumnRenamed("made", "likeness"), "nid")
    seen = scratch.keep(seen, "seen")
    of_rows, of_strays = F.ceil(F.col("n") / BLOCK), F.ceil(F.col("outside") / BLOCK)
    stray = (F.col("component") != F.col("main")).alias("stray")
    return scratch.keep(members.join(seen, "nid").select("key", "nid", "component", "keys", "likeness", "n_shingles", stray, of_rows.alias("of_rows"), of_strays.alias("of_strays")), "wide")


def _across(wide: DataFrame, percent: int, scratch: Scratch, best: int | None = None) -> DataFrame:
    """Pairs of one crowded bucket that lie in different classes and whose sizes and signatures allow the threshold.

    Strays meet all members of their bucket in blocks of bounded size. With ``best``, only so many of the likest members of
    each block come, which join most strays to their class; without it all come, a pair of several buckets from the least.
    """
    span = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    strays = wide.where("stray").select("*", F.pmod(F.xxhash64("nid"), "of_strays").alias("i"), span("of_rows").alias("j"))
    others = wide.select("*", span("of_strays").alias("i"), F.pmod(F.xxhash64("nid"), "of_rows").alias("j"))
    kept, by, rounds = ["key", "i", "j", "nid", "component", "stray", "keys", "likeness", "n_shingles"], ["key", "i", "j"], 1 if best else LONG

    def meet(key: tuple, own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        if len(own) and len(other):
            table = np.frombuffer(b"".join(other["likeness"]), dtype=np.uint8).reshape(len(other), -1)
            nids, classes, stray, sizes = (other[c].to_numpy() for c in ("nid", "component", "stray", "n_shingles"))
            shared = [frozenset(x) for x in other["keys"]]
            for r in own.itertuples(index=False):
                equal = (table == np.frombuffer(r.likeness, dtype=np.uint8)).sum(axis=1)
                small, large = np.minimum(sizes, r.n_shingles), np.maximum(sizes, r.n_shingles)
                found = np.flatnonzero((classes != r.component) & (100 * small >= percent * large) & (equal >= least_like(100 * small // percent + 1, percent, rounds)))
                if best:
                    found = found[np.argsort(-equal[found], kind="stable")[:best]]
                else:
                    mine = frozenset(r.keys)
                    found = [k for k in found if (not stray[k] or nids[k] > r.nid) and min(mine & shared[k]) == key[0]]
                a += [min(r.nid, nids[k]) for k in found]
                b += [max(r.nid, nids[k]) for k in found]
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    met = strays.select(kept).groupBy(*by).cogroup(others.select(kept).groupBy(*by)).applyInPandas(meet, "a long, b long")
    return scratch.keep(met.distinct(), "across")


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, n_shingles, component_id (least doc_id of its class), kept (doc_id = component_id).

    A set is the different four-word shingles of the whole text; with fewer words the whole sequence; null texts and texts
    without words have none, are linked with nothing and are classes of their own. Documents of equal sets are linked, pairs
    at exactly the threshold too. A null doc_id names a class only if the class has no other, and is kept then. Rows equal
    in id share their class if equal in text; each is kept or not by its own class. An empty table gives an empty table;
    other columns are not read. Shingles and sets are told apart by 64-bit and 128-bit hashes.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession, "near") as scratch:
        rows = scratch.keep(_rows(own), "rows")
        sets = rows.where("n_shingles > 0").groupBy("set")
        nodes = sets.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("keys", ignorenulls=True).alias("keys"), F.first("likeness", ignorenulls=True).alias("likeness"))
        nodes = scratch.keep(nodes.select(F.monotonically_increasing_id().alias("nid"), "*"), "nodes")  # written once, so numbers stay
        pairs, crowded = _candidates(nodes, scratch)
        links = spanning_forest(verified(own, pairs, nodes, percent, scratch))
        classes = connected_components(links, scratch)
        for best in (2, None):  # first the likest alone, which leaves few strays; then all that is left, by longer signatures
            wide = _open_members(crowded, classes, nodes, scratch, None if best else own)
            if wide is None:
                break
            more = verified(own, _across(wide, percent, scratch, best), nodes, percent, scratch)
            trees = classes.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            classes = connected_components(trees.union(spanning_forest(more)), scratch)
        named = nodes.select("nid", "set", "rep").join(classes.withColumnRenamed("node", "nid"), "nid", "left").withColumn("component", F.coalesce("component", "nid"))
        named = scratch.keep(named.select("set", "rep", "component"), "named")
        least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
        classed = named.join(least, "component").select("set", "component_id", F.lit(True).alias("has"))
        found = rows.select("doc_id", "n_shingles", "set").join(classed, "set", "left")
        component = F.when(F.col("has"), F.col("component_id")).otherwise(F.col("doc_id"))
        return scratch.result(found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def one_of_each(docs: DataFrame, *, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the least of its class, all columns unchanged; rows of equal id stay together."""
    kept = near_duplicates(docs, percent=percent, id_col=id_col, text_col=text_col).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept"]), "left_semi")
