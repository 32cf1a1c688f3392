"""N-gram Jaccard join by a MinHash LSH forest.

A text is its set of five-word shingles. Texts of equal sets form one node, so copies never meet as pairs. Each node has a
signature of ``TREES`` label sequences, and each tree of the forest is the sorted prefix trie of one of them: a trie node is
a prefix, and its bucket the texts below it. How long a prefix two texts must share to become candidates adapts to the data:

* It is shortened from ``MAX_DEPTH`` labels until a pair at the threshold meets in some tree with the target recall.
* A bucket of that depth with more than ``SMALL`` texts is followed down its trie again, to the depth where its parts are
  small: texts with a passage in common part there, near copies stay together.
* A bucket that is still large at ``MAX_DEPTH`` gives pairs with two of its members; the members which that leaves outside
  its main class meet all others, and those pairs go on whose bit sketches do not rule the threshold out.

Candidates are verified on their whole shingle sets, and links make classes. Within a class that reaches into a large
bucket, links are counted over all its pairs, block by block on the sets themselves; only the counts are written.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.llm.common import Scratch, give_back
from threadloom.llm.components import connected_components
from threadloom.llm.files import Ranges, Writer, make_dir

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
MAX_DEPTH = 8
TARGET_RECALL = 0.99999
SMALL = 16
#: Bits of a sketch, and standard deviations by which a pair at the threshold may miss its expected likeness.
SKETCH = 2048
SIGMAS = 4.5
#: Members outside the main class, and members, of a large bucket that one group compares, about.
STRAY_BLOCK, BLOCK = 256, 512
#: Texts, and bytes of their sets, of a block within which the links of a class are counted, about.
COUNT_BLOCK, COUNT_BYTES = 512, 1 << 22
#: Node ids up to which the wanted texts are picked by a broadcast of the ids; beyond it by a shuffled semi join.
BROADCAST_NODES = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _WordHash()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the whole text's five-word shingles; of fewer words one shingle, of none nothing."""
    found = _WORD.findall(text.lower()) if isinstance(text, str) else []
    w = np.fromiter(map(_words.__getitem__, found), dtype=np.uint64, count=len(found))
    size = min(SHINGLE, len(w))
    if not size:
        return w
    h = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        h = h * _ODD + w[j : len(w) - size + 1 + j]
    return np.unique(_mixed(h))


def recall(depth: int, threshold: float = THRESHOLD, trees: int = TREES) -> float:
    return 1.0 - (1.0 - threshold**depth) ** trees


def matched_depth(threshold: float = THRESHOLD, trees: int = TREES, target: float = TARGET_RECALL) -> int:
    """Shorten the matched prefix from the full depth until pairs at the threshold meet with the target recall."""
    depth = MAX_DEPTH
    while depth > 1 and recall(depth, threshold, trees) < target:
        depth -= 1
    return depth


def _draws(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = (_mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * _ODD) >> np.uint64(32)).astype(np.uint32)
    return x[:n] | np.uint32(1), x[n:]


def _minima(shingles: np.ndarray, factor: np.ndarray, shift: np.ndarray, step: int = 256) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factor), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(x), step):
        least = np.minimum(least, (x[at : at + step, None] * factor + shift).min(axis=0))
    return least


def signature(shingles: np.ndarray, trees: int = TREES) -> np.ndarray:
    """The labels of each tree's sequence, trees x MAX_DEPTH."""
    return _minima(shingles, *_draws(trees * MAX_DEPTH)).reshape(trees, MAX_DEPTH).astype(np.uint64)


def prefix_keys(labels: np.ndarray, depth: int) -> np.ndarray:
    """Per tree a hash of the first ``depth`` labels: the trie node that the text lies under."""
    key = np.arange(len(labels), dtype=np.uint64)
    for label in labels[:, :depth].T:
        key = _mixed(key * _ODD + label)
    return key.view(np.int64)


def tails(labels: np.ndarray, depth: int) -> np.ndarray:
    """Per tree 16 bits of each label from ``depth`` on, the last label lowest."""
    out = np.zeros(len(labels), dtype=np.uint64)
    for label in labels[:, depth:].T:
        out = (out << np.uint64(16)) | (_mixed(label * _ODD) >> np.uint64(48))
    return out.view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH bits as 64-bit words: one bit of each of as many minima. Two sets differ in about (1 - Jaccard) / 2 of them."""
    factor, shift = _draws(TREES * MAX_DEPTH + SKETCH)
    least = _minima(shingles, factor[-SKETCH:], shift[-SKETCH:], 64).astype(np.uint64)
    return np.packbits((_mixed(least * _ODD) >> np.uint64(63)).astype(bool)).view(np.int64)


def most_differing(threshold: float = THRESHOLD) -> int:
    """Bits in which sketches of sets at the threshold differ, but for SIGMAS standard deviations' worth of chance."""
    p = (1.0 - threshold) / 2.0
    return int(np.ceil(SKETCH * p + SIGMAS * np.sqrt(SKETCH * p * (1.0 - p))))


def set_id(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def _rows(docs: DataFrame, depth: int) -> DataFrame:
    """(doc_id, digest, set, keys, tails) of each row; keys and tails come once a task for each set, for the empty one never."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                own = pdf.iloc[at : at + 512]
                sets, keys, rest = [], [], []
                for text in own["text"]:
                    s = shingle_set(text)
                    sets.append(set_id(s))
                    labels = None if sets[-1] in seen or not len(s) else signature(s)
                    keys.append(None if labels is None else prefix_keys(labels, depth))
                    rest.append(None if labels is None else tails(labels, depth))
                    seen.add(sets[-1])
                yield pd.DataFrame({"doc_id": own["doc_id"].to_numpy(), "digest": own["digest"].to_numpy(), "set": sets, "keys": keys, "tails": rest})
        _words.clear()
        give_back()

    return docs.mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, digest string, set binary, keys array<long>, tails array<long>")


def _wanted(docs: DataFrame, nodes: DataFrame, made, field: str) -> DataFrame:
    """(nid, field) of nodes (nid, set, rep), from the whole text of one row of each: ``made`` gives the field's bytes of a set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for pdf in batches:
            sets, fields = [], []
            for text in pdf["text"]:
                s = shingle_set(text)
                name = set_id(s)
                if name not in seen:
                    seen.add(name)
                    sets.append(name)
                    fields.append(made(s))
            yield pd.DataFrame({"set": sets, field: fields})
        _words.clear()
        give_back()

    few = nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    ids = nodes.select(F.col("rep").alias("__rep")).distinct()
    texts = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"].eqNullSafe(F.col("__rep")), "left_semi").select("text")
    return texts.mapInPandas(run, f"set binary, {field} binary").dropDuplicates(["set"]).join(nodes.select("nid", "set"), "set").drop("set")


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have at least the threshold's Jaccard similarity."""
    ends = pairs.select(F.col("a").alias("nid")).union(pairs.select(F.col("b").alias("nid"))).distinct()
    wanted = scratch.keep(ends.join(nodes.select("nid", "set", "rep"), "nid"), "wanted")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sims = [jaccard(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(pdf["sa"], pdf["sb"], strict=True)]
            yield pdf[["a", "b"]].assign(similarity=sims)

    found = scratch.keep(_wanted(docs, wanted, np.ndarray.tobytes, "shingles"), "sets")
    left, right = found.select(F.col("nid").alias("a"), F.col("shingles").alias("sa")), found.select(F.col("nid").alias("b"), F.col("shingles").alias("sb"))
    compared = pairs.join(left, "a").join(right, "b").mapInPandas(compare, "a long, b long, similarity double")
    return scratch.keep(compared.where(F.col("similarity") >= threshold), "links")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def forest_candidates(nodes: DataFrame, depth: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From nodes (nid, keys, tails): pairs (a, b) to verify, buckets still large at MAX_DEPTH (key, nid, n), crowded nodes (nid).

    A node is crowded if its bucket at ``depth`` is large in some tree. Only such buckets are followed further down.
    """
    under = nodes.where("keys IS NOT NULL").select("nid", F.explode(F.arrays_zip("keys", "tails")).alias("t")).select("nid", F.col("t.keys").alias("key"), F.col("t.tails").alias("tail"))
    pairs, crowded = None, None
    while True:
        buckets = under.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("nid").alias("low"), F.max("nid").alias("high")).where("n > 1")
        members = scratch.keep(under.join(buckets, "key"), "members")
        small, large = members.where(F.col("n") <= SMALL).select("key", "nid"), members.where(F.col("n") > SMALL)
        met = small.withColumnRenamed("nid", "a").join(small.withColumnRenamed("nid", "b"), "key").where("a < b").select("a", "b")
        pairs = met if pairs is None else pairs.union(met)
        if crowded is None:
            crowded = large.select("nid").distinct()
        if depth >= MAX_DEPTH or not large.limit(1).count():
            break
        depth += 1
        label = F.shiftright("tail", 16 * (MAX_DEPTH - depth)).bitwiseAND(F.lit(0xFFFF))
        under = large.select("nid", F.xxhash64("key", label).alias("key"), "tail")
    spokes = large.select(F.col("low").alias("a"), F.col("nid").alias("b")).union(large.select(F.col("high").alias("a"), F.col("nid").alias("b")))
    return scratch.keep(_ordered(pairs.union(spokes)), "pairs"), large.select("key", "nid", "n"), crowded


def _rest(large: DataFrame, classes: DataFrame, docs: DataFrame, nodes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame | None:
    """Pairs of one large bucket that lie in different classes and whose sketches allow the threshold, each once.

    In each bucket the members outside its main class meet all members, block by block, so no group grows with a bucket. A
    pair that shares several buckets comes from the least of them: what is written grows with the pairs that may be links.
    """
    if not large.limit(1).count():
        return None
    placed = large.join(classes, large["nid"] == classes["node"], "left").select("key", "nid", "n", F.coalesce("component", "nid").alias("component"))
    placed = scratch.keep(placed, "placed")
    parts = placed.groupBy("key", "n", "component").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("key", "n").agg(F.max(F.struct("m", "component")).alias("main")).where("main.m < n")
    main = scratch.keep(main.select("key", "n", F.col("main.component").alias("main"), (F.col("n") - F.col("main.m")).alias("outside")), "main")
    if not main.limit(1).count():
        return None
    members = scratch.keep(placed.drop("n").join(main, "key"), "open")
    shared = members.groupBy("nid").agg(F.collect_set("key").alias("keys"))  # at most one bucket a tree
    wanted = scratch.keep(nodes.select("nid", "set", "rep").join(shared.select("nid"), "nid", "left_semi"), "wanted")
    sketches = scratch.keep(_wanted(docs, wanted, lambda s: sketch(s).tobytes(), "bits"), "sketches")
    members = members.join(shared.join(sketches, "nid"), "nid").withColumn("stray", F.col("component") != F.col("main"))
    members = scratch.keep(members.select("key", "nid", "component", "stray", "keys", "bits", _blocks("outside", STRAY_BLOCK), _blocks("n", BLOCK)), "sketched")
    strays = members.where("stray").select("*", F.pmod(F.xxhash64("nid"), "of_outside").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("of_n") - 1)).alias("j"))
    others = members.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of_outside") - 1)).alias("i"), F.pmod(F.xxhash64("nid"), "of_n").alias("j"))
    kept, by, most = ["key", "i", "j", "nid", "component", "stray", "keys", "bits"], ["key", "i", "j"], most_differing(threshold)

    def meet(key: tuple, own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        if len(own) and len(other):
            bits = np.frombuffer(b"".join(other["bits"]), dtype=np.uint64).reshape(len(other), -1)
            nids, classes, stray = other["nid"].to_numpy(), other["component"].to_numpy(), other["stray"].to_numpy()
            keys = [frozenset(x) for x in other["keys"]]
            for r in own.itertuples(index=False):
                differ = np.bitwise_count(bits ^ np.frombuffer(r.bits, dtype=np.uint64)).sum(axis=1, dtype=np.int64)
                mine = frozenset(r.keys)
                for k in np.flatnonzero((differ <= most) & (classes != r.component) & (~stray | (nids > r.nid))):
                    if min(mine & keys[k]) == key[0]:
                        a.append(r.nid)
                        b.append(nids[k])
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    met = strays.select(kept).groupBy(*by).cogroup(others.select(kept).groupBy(*by)).applyInPandas(meet, "a long, b long")
    pairs = scratch.keep(_ordered(met), "pairs")
    return pairs if pairs.limit(1).count() else None


def _blocks(rows: str, size: int) -> Column:
    return F.ceil(F.col(rows) / size).alias(f"of_{rows}")


def similar(a: list[np.ndarray], b: list[np.ndarray], threshold: float, chunk: int = 4096) -> np.ndarray:
    """a x b: whether the two sets reach the threshold, by products of presence matrices, ``chunk`` shingles at a time.

    A shingle that only one set has is left out, as it adds to no intersection.
    """
    sizes = np.array([len(x) for x in (*a, *b)], dtype=np.int64)
    values, rows = np.concatenate([*a, *b]), np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(values, kind="stable")
    first = np.concatenate([[True], values[order][1:] != values[order][:-1]])
    times = np.diff(np.append(np.flatnonzero(first), len(values)))
    column, rows = np.repeat(np.cumsum(times > 1) - 1, times), rows[order]
    shared = np.repeat(times > 1, times)
    column, rows = column[shared], rows[shared]
    both = np.zeros((len(a), len(b)), dtype=np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, chunk):
        s = slice(*np.searchsorted(column, (low, low + chunk)))
        present = np.zeros((len(sizes), chunk), dtype=np.float32)
        present[rows[s], column[s] - low] = 1.0
        both += present[: len(a)] @ present[len(a) :].T
    union = sizes[: len(a), None] + sizes[None, len(a) :] - both.astype(np.float64)
    return both / np.maximum(union, 1) >= threshold


def _counted(docs: DataFrame, nodes: DataFrame, classes: DataFrame, crowded: DataFrame, threshold: float, scratch: Scratch) -> DataFrame | None:
    """(nid, links) over all pairs of the classes of three or more nodes of which two are crowded.

    A class is cut into blocks of bounded size by a hash; each is written once, and a row stands for two blocks to compare.
    """
    marked = classes.join(crowded.withColumnRenamed("nid", "node").withColumn("crowded", F.lit(1)), "node", "left")
    open_classes = marked.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.count("crowded").alias("c")).where("m > 2 AND c > 1")
    wanted = scratch.keep(classes.join(open_classes, "component").select("component", F.col("node").alias("nid")).join(nodes.select("nid", "set", "rep"), "nid"), "wanted")
    if not wanted.limit(1).count():
        return None
    sets = scratch.keep(_wanted(docs, wanted.select("nid", "set", "rep"), np.ndarray.tobytes, "shingles").join(wanted.select("nid", "component"), "nid"), "sets")
    cuts = sets.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / COUNT_BLOCK, F.sum(F.length("shingles")) / COUNT_BYTES)).alias("blocks"))
    dealt = sets.join(cuts, "component").select("component", F.pmod(F.xxhash64("nid"), "blocks").alias("block"), "nid", "shingles")
    folder = f"{scratch.root}/blocks"
    make_dir(folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, open_block, held, placed = None, None, [], []
        uri = f"{folder}/{hashlib.blake2b(str(np.random.default_rng().integers(1 << 62)).encode(), digest_size=8).hexdigest()}"

        def close() -> None:
            nonlocal out
            out = out or Writer(uri)
            table = np.array([(n, len(s) // 8) for n, s in held], dtype="<i8")
            data = np.array([len(held)], dtype="<i8").tobytes() + table.tobytes() + b"".join(s for _, s in held)
            placed.append((*open_block, uri, out.write(data), len(data)))

        for pdf in batches:
            for own in zip(pdf["component"], pdf["block"], pdf["nid"], pdf["shingles"], strict=True):
                if own[:2] != open_block:
                    if held:
                        close()
                    open_block, held = own[:2], []
                held.append((own[2], bytes(own[3])))
        if held:
            close()
            out.close()
        yield pd.DataFrame(placed, columns=["component", "block", "uri", "at", "length"])

    blocks = dealt.repartition("component", "block").sortWithinPartitions("component", "block").mapInPandas(write, "component long, block long, uri string, at long, length long")
    blocks = scratch.keep(blocks, "blocks")
    place = F.struct("block", "uri", "at", "length")
    meetings = blocks.select("component", place.alias("x")).join(blocks.select("component", place.alias("y")), "component").where("x.block <= y.block")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges, found, last = Ranges(), Counter(), (None, None)

        def block(p) -> tuple[np.ndarray, list[np.ndarray]]:
            data = np.frombuffer(ranges.read(p["uri"], p["at"], p["length"]), dtype="<u8")
            n = int(data[0])
            table = data[1 : 1 + 2 * n].reshape(n, 2).astype(np.int64)
            return table[:, 0], np.split(data[1 + 2 * n :], np.cumsum(table[:, 1])[:-1])

        for pdf in batches:
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                key = (x["uri"], x["at"])
                if last[0] != key:
                    last = (key, block(x))
                nids, own = last[1]
                if x["block"] == y["block"]:
                    links = similar(own, own, threshold)
                    np.fill_diagonal(links, False)
                else:
                    others, other = block(y)
                    links = similar(own, other, threshold)
                    found.update(dict(zip(others.tolist(), links.sum(axis=0).tolist(), strict=True)))
                found.update(dict(zip(nids.tolist(), links.sum(axis=1).tolist(), strict=True)))
                if len(found) > 200_000:
                    yield pd.DataFrame({"nid": list(found), "links": list(found.values())})
                    found = Counter()
        yield pd.DataFrame({"nid": list(found), "links": list(found.values())})
        give_back()

    spread = meetings.repartition(F.xxhash64("component", "x.block", "y.block")).sortWithinPartitions("x.uri", "x.at")
    return scratch.keep(spread.select("x", "y").mapInPandas(count, "nid long, links long").groupBy("nid").agg(F.sum("links").alias("links")), "counted")


def _classed(docs: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Per row doc_id, digest, component, class_id, copies, links."""
    depth = matched_depth(threshold)
    own = docs.select("doc_id", "text", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("digest"))
    rows = scratch.keep(_rows(own, depth), "rows")
    nodes = rows.groupBy("set").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("keys", ignorenulls=True).alias("keys"), F.first("tails", ignorenulls=True).alias("tails")
    )
    nodes = scratch.keep(nodes.select(F.monotonically_increasing_id().alias("nid"), "*"), "nodes")  # written once, so numbers stay
    pairs, large, crowded = forest_candidates(nodes, depth, scratch)
    links = verified(own, pairs, nodes, threshold, scratch)
    classes = connected_components(links, scratch)
    rest = _rest(large, classes, own, nodes, threshold, scratch)
    if rest is not None:
        links = links.union(verified(own, rest, nodes, threshold, scratch)).distinct()
        classes = connected_components(links, scratch)
    named = nodes.select("nid", "set", "rep", "copies").join(classes.withColumnRenamed("node", "nid"), "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    degree = links.select(F.col("a").alias("nid")).union(links.select(F.col("b").alias("nid"))).groupBy("nid").agg(F.count(F.lit(1)).alias("links"))
    counted = _counted(own, nodes, classes, crowded, threshold, scratch)
    if counted is not None:
        degree = degree.join(counted.withColumnRenamed("links", "all_links"), "nid", "full").select("nid", F.coalesce("all_links", "links").alias("links"))
    named = scratch.keep(named.join(degree, "nid", "left"), "named")
    ids = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    classed = scratch.keep(named.join(ids, "component").select("set", "component", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links")), "classes")
    return rows.select("doc_id", "digest", "set").join(classed, "set").drop("set")


def jaccard_classes(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, class_id (least doc_id of its class), n_links, n_copies.

    n_links counts the other texts (sets of shingles) that its text is linked to; n_copies the rows of an equal set, itself
    included. Texts without words are copies of each other, null included. Very long texts are sets like any other; pairs
    at exactly the threshold are links. A null doc_id names a class only if it has no other. Repeated rows are copies. An
    empty table gives an empty table; other columns are not read. Sets are told apart by 128-bit digests.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession, "jaccard") as scratch:
        return scratch.result(_classed(own, threshold, scratch).select("doc_id", "class_id", F.col("links").alias("n_links"), F.col("copies").alias("n_copies")))


def one_of_each_class(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, one for each class: that of least (doc_id, text digest).

    A null doc_id comes first. Of rows equal in id and text one stays, whichever. All texts without words, null ones
    included, are one class, so one of them stays. An empty table gives an empty table; no column name can clash.
    """
    columns = docs.columns
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession, "jaccard") as scratch:
        least = _classed(own, threshold, scratch).groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("k"))
        kept = scratch.result(least.select(F.col("k.doc_id").alias("__id"), F.col("k.digest").alias("__kept")))
    text = F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8")
    packed = docs.select(F.struct(*[docs[c] for c in columns]).alias("__doc"), docs[id_col].alias("__own"), F.md5(text).alias("__digest"))
    found = packed.join(kept, packed["__own"].eqNullSafe(kept["__id"]) & (packed["__digest"] == kept["__kept"]), "left_semi")
    return found.dropDuplicates(["__own", "__digest"]).select("__doc.*")
