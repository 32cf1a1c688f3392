"""Token ids in a content-addressed store.

Tasks encode documents, cut each id stream into chunks where a rolling hash says so, and append the chunks that are new to
them to a pack file of compressed frames. Chunks that several packs hold get one owner; the packs are then rewritten with
owned chunks only, so each chunk is stored once. A document's recipe lists its chunk hashes under a Merkle root, with the
document's number and the place of its first id. Reading follows the recipes, checks every chunk and root, rebuilds the
manifest's tree from what it has read, and gives the ids back.

A store is a folder. ``packs``: frames, then the footer (little-endian u64 offset and u32 length a frame), then u32 bytes
an id, u32 frames and the magic; a frame is one zstd block of whole chunks, ids as little-endian u16, or u32 for larger
vocabularies. ``recipes``: Parquet in ascending doc_id order, ``part`` by ``part``; this order is the store's order of
documents, as packs hold a chunk once wherever it occurs. ``manifest``: the nodes of a Merkle tree over the documents.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from array import array
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.common import Scratch, give_back, small_batches
from threadloom.llm.files import Ranges, Writer, make_dir, remove_dir
from threadloom.scratch import result_path

END_ID = 2
MAGIC = b"TLPACK01"
FRAME_BYTES = 1 << 17
#: Chunk sizes in ids: least, mean of the rolling hash's cuts, most.
LEAST, MEAN_BITS, MOST = 256, 10, 4096
SPAN = 4
#: Children of a node of the manifest's tree.
FAN = 256
_STEP = 0x9E3779B97F4A7C15


def _id_weights(n: int = 1 << 16) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP)
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32)


_WEIGHTS = _id_weights()


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream: a hash of the last SPAN ids decides, within the least and most size."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    w = _WEIGHTS[ids & 0xFFFF]
    h = w.copy()
    for j in range(1, SPAN):
        h[j:] += w[:-j] * np.uint32(pow(_STEP, j, 1 << 32))
    candidates = np.flatnonzero(h < np.uint32(1 << (32 - MEAN_BITS))) + 1
    ends, start = [], 0
    for c in candidates.tolist():
        while c - start > MOST:
            start += MOST
            ends.append(start)
        if c - start >= LEAST:
            ends.append(c)
            start = c
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_hash(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4", copy=False).tobytes(), digest_size=16).digest()


def merkle_root(hashes: list[bytes]) -> bytes:
    """Root of the binary hash tree over the hashes, the last of an odd level carried up; zeros for none."""
    level = list(hashes) or [bytes(16)]
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class PackWriter:
    """Chunks in compressed frames; ``add`` says in which frame, and where in it, a chunk lies."""

    def __init__(self, uri: str, width: str):
        self._out, self._width, self._zip = Writer(uri), width, zstandard.ZstdCompressor(level=3)
        self._frame: list[bytes] = []
        self._held = 0
        self._table: list[tuple[int, int]] = []

    def add(self, ids: np.ndarray) -> tuple[int, int]:
        data = ids.astype(self._width).tobytes()
        place = (len(self._table), self._held)
        self._frame.append(data)
        self._held += len(data)
        if self._held >= FRAME_BYTES:
            self._flush()
        return place

    def _flush(self) -> None:
        packed = self._zip.compress(b"".join(self._frame))
        self._table.append((self._out.write(packed), len(packed)))
        self._frame, self._held = [], 0

    def close(self) -> None:
        if self._frame:
            self._flush()
        self._out.write(b"".join(struct.pack("<QI", *x) for x in self._table) + struct.pack("<II", np.dtype(self._width).itemsize, len(self._table)) + MAGIC)
        self._out.close()


class PackReader:
    """Chunks by place, with a bounded cache of opened frames and footers."""

    def __init__(self, frames: int = 96, footers: int = 64):
        self._ranges, self._unzip = Ranges(), zstandard.ZstdDecompressor()
        self._frames: OrderedDict[tuple[str, int], np.ndarray] = OrderedDict()
        self._tables: OrderedDict[str, tuple[int, np.ndarray]] = OrderedDict()
        self._most = (frames, footers)

    def _table(self, uri: str) -> tuple[int, np.ndarray]:
        """Bytes an id, and the frames' places."""
        if uri not in self._tables:
            size = self._ranges.size(uri)
            width, n, magic = struct.unpack("<II8s", self._ranges.read(uri, size - 16, 16))
            if magic != MAGIC:
                raise ValueError(f"{uri} is not a pack file")
            table = np.frombuffer(self._ranges.read(uri, size - 16 - 12 * n, 12 * n), dtype=[("at", "<u8"), ("n", "<u4")])
            self._tables[uri] = width, table
            if len(self._tables) > self._most[1]:
                self._tables.popitem(last=False)
        return self._tables[uri]

    def ids(self, uri: str, frame: int, at: int, n: int) -> np.ndarray:
        key = (uri, frame)
        if key in self._frames:
            self._frames.move_to_end(key)
        else:
            width, table = self._table(uri)
            data = self._unzip.decompress(self._ranges.read(uri, int(table[frame]["at"]), int(table[frame]["n"])))
            self._frames[key] = np.frombuffer(data, dtype=f"<u{width}")
            if len(self._frames) > self._most[0]:
                self._frames.popitem(last=False)
        first = at // self._frames[key].itemsize
        return self._frames[key][first : first + n]


def _byte_letters() -> str:
    """The letter of each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow 255."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


class Encoder:
    """Ids of whole texts by a byte-level tokenizers file, as little-endian u32 bytes.

    Its pre-tokenizer always breaks before a single space between two other characters, around a single line feed between
    two such, and between letters and the signs that follow them. Texts are cut there by Arrow, some millions of characters
    at once, and their pieces numbered; each new piece is encoded once, letters by the library's model alone, the rest by
    the whole tokenizer, and the ids of the texts are taken by number. The result is that of encoding the texts.
    """

    #: White space but for the space and the line feed, and neighbours that make a break depend on more than one character.
    _OTHER_SPACE = [chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    _JOINED_SPACE = ("  ", " \n", "\n ", "\n\n")
    _SAFE = re.compile(r"(?<=\S) (?=\S)")
    #: Signs that never go with the letters before them: all of ASCII but the apostrophe.
    _SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
    #: Characters that are cut at once; a worker needs some 20 bytes of memory for each of them.
    _AT_ONCE = 1_500_000

    def __init__(self, path: str, most_pieces: int = 200_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._letters = dict(enumerate(_byte_letters()))
        self._space = self._letters[ord(" ")]
        self._most = most_pieces
        self._feed = self.whole("\n")
        self._known = pa.array([], pa.large_string())
        self._ids, self._ends = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def vocabulary(self) -> int:
        return self._tokenizer.get_vocab_size(with_added_tokens=True)

    def whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def special_in(self, text: str) -> bool:
        return any(s in text for s in self._special)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text in turn; no more texts are drawn than are cut at once."""
        drawn, held = [], 0
        for t in texts:
            drawn.append(t)
            held += len(t)
            if held >= self._AT_ONCE:
                yield from self._together(drawn)
                drawn, held = [], 0
        if drawn:
            yield from self._together(drawn)

    def _together(self, texts: list[str]) -> list[bytes]:
        """Ids of these texts. Each is cut as if behind a line feed, whose ids are left out again."""
        plain, odd, cuts = [], [], []
        for k, t in enumerate(texts):
            if any(c in t for c in self._OTHER_SPACE) or any(c in t for c in self._JOINED_SPACE) or self.special_in(t):
                odd.append(k)
                cuts.append(self._SAFE.split("\n" + t))
            else:
                plain.append(k)
        cut = pc.split_pattern(pa.array([("\n" + texts[k]).replace("\n", " \n")[1:] for k in plain], pa.large_string()), " ")
        ids, ends = self._by_number([cut.flatten(), pa.array([x for c in cuts for x in c], pa.large_string())])
        bounds = ends[np.concatenate([[0], np.cumsum([*np.diff(cut.offsets.to_numpy()), *map(len, cuts)])])].tolist()
        out = [b""] * len(texts)
        for k, first, last in zip([*plain, *odd], bounds, bounds[1:]):
            out[k] = ids[first + len(self._feed) // 4 : last].tobytes()
        return out

    def _by_number(self, pieces: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces and their ends; pieces not known yet are learnt, those long unused and long ones forgotten."""
        had = len(self._known)
        coded = pa.chunked_array([self._known, *pieces]).combine_chunks().dictionary_encode()
        self._known, numbers = coded.dictionary, coded.indices[had:].to_numpy()
        ids, ends = self._new(self._known[had:].to_numpy(zero_copy_only=False).tolist())
        self._ids, self._ends = np.concatenate([self._ids, ids]), np.concatenate([self._ends, self._ends[-1] + ends[1:]])
        found = _ragged(self._ids, self._ends, numbers)
        if len(self._known) > self._most or self._known.nbytes > 64 * self._most:
            used = np.unique(numbers)
            used = used[pc.utf8_length(self._known.take(pa.array(used))).to_numpy() <= 64]
            self._known = self._known.take(pa.array(used))
            self._ids, self._ends = _ragged(self._ids, self._ends, used)
        return found

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and their ends: behind a line feed if they begin with one, else behind a space; signs behind letters go by themselves."""
        parts: list[str] = []
        for piece in pieces:
            feed, led = ("\n", piece[1:]) if piece[:1] == "\n" else ("", " " + piece)
            stem = led.rstrip(self._SIGNS)
            if not stem.removeprefix(" ").isalpha():
                stem = led
            parts += (feed, stem, led[len(stem) :])
        coded = pa.array(parts, pa.large_string()).dictionary_encode()
        ids, ends, tokenize = array("I"), [0], self._model.tokenize
        for part in coded.dictionary.to_numpy(zero_copy_only=False).tolist():
            if part.removeprefix(" ").isalpha():
                letters = part.replace(" ", self._space) if part.isascii() else part.encode().decode("latin-1").translate(self._letters)
                ids.extend([t.id for t in tokenize(letters)])
            else:
                ids.frombytes(self.whole(part))
            ends.append(len(ids))
        found, upto = _ragged(np.array(ids, dtype="<u4"), np.array(ends), coded.indices.to_numpy())
        return found, upto[::3]


def _ragged(values: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of these numbers one after another, number k from ends[k] to ends[k + 1], and their ends from 0 on."""
    sizes = np.diff(ends)[numbers]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    places = np.repeat(ends[:-1][numbers] - upto[:-1], sizes)
    places += np.arange(upto[-1])
    return values[places], upto


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a file; Spark reuses Python workers, so what it has learnt serves later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


RECIPE = "uid long, pack int, n_tokens long, root binary, refs array<struct<hash:binary,uri:string,frame:int,at:int,n:int>>"
_REF = pa.struct([("hash", pa.binary()), ("uri", pa.string()), ("frame", pa.int32()), ("at", pa.int32()), ("n", pa.int32())])
_RECIPE = {"uid": pa.int64(), "pack": pa.int32(), "n_tokens": pa.int64(), "root": pa.binary(), "refs": pa.list_(_REF)}


def write_store(docs: DataFrame, tokenizer_path: str, root: str | None = None, *, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode all rows into a store below ``root`` (packs, recipes, manifest); the folder's URI.

    Recipes: doc_id, uid (tells rows apart whatever their ids), n_tokens, root, refs, nth (number of the document), start
    (ids of all documents before it). A task that runs again writes a pack of another name.
    """
    spark = docs.sparkSession
    root = root or result_path(spark, "tokens")
    with Scratch(spark, "tokens") as scratch:
        recipes = _packed(docs, tokenizer_path, root, scratch, end_id, id_col, text_col)
        _in_order(recipes, root, scratch)
        merkle_tree(_leaves(spark.read.parquet(f"{root}/recipes")), scratch).write.parquet(f"{root}/manifest")
    return root


def _packed(docs: DataFrame, tokenizer_path: str, root: str, scratch: Scratch, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """Write the packs; recipes (doc_id, uid, n_tokens, root, refs to final places)."""
    loose, packs = f"{scratch.root}/loose", f"{root}/packs"
    make_dir(loose)
    make_dir(packs)
    id_type = dict(docs.dtypes)[id_col]
    width = "<u2" if encoder(tokenizer_path).vocabulary() <= 1 << 16 else "<u4"
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        uri, pack, encode_texts, placed, row = f"{loose}/{part:06d}-{uuid.uuid4().hex[:8]}.pack", None, encoder(tokenizer_path).encode, {}, 0
        for batch in batches:
            encoded = encode_texts(t.as_py() or "" for t in batch["text"])
            for at in range(0, batch.num_rows, 256):
                own = batch["doc_id"].slice(at, 256)
                out = []
                for data in islice(encoded, len(own)):
                    ids = np.frombuffer(data + end, dtype="<u4")
                    refs, start = [], 0
                    for stop in cut_points(ids):
                        h = chunk_hash(ids[start:stop])
                        if h not in placed:
                            pack = pack or PackWriter(uri, width)
                            placed[h] = pack.add(ids[start:stop])
                        refs.append({"hash": h, "uri": uri, "frame": placed[h][0], "at": placed[h][1], "n": stop - start})
                        start = stop
                    out.append(((part << 36) | row, part, len(ids), merkle_root([r["hash"] for r in refs]), refs))
                    row += 1
                yield pa.RecordBatch.from_arrays([own, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), _RECIPE.values(), strict=True))], ["doc_id", *_RECIPE])
        if pack:
            pack.close()
        give_back()

    with small_batches(docs.sparkSession):
        drafts = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, f"doc_id {id_type}, {RECIPE}"), "drafts")
    uses = drafts.select("uid", "pack", F.posexplode("refs").alias("seq", "ref")).select("uid", "pack", "seq", "ref.*")
    owners = uses.groupBy("hash").agg(F.min("pack").alias("pack"))
    owned = uses.select("hash", "pack", "uri", "frame", "at", "n").dropDuplicates(["hash", "pack"]).join(owners, ["hash", "pack"], "left_semi")

    def rewrite(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["frame", "at"])
        uri, reader = f"{packs}/{key[0]:06d}-{uuid.uuid4().hex[:8]}.pack", PackReader(frames=2)
        out = PackWriter(uri, width)
        places = [out.add(reader.ids(r.uri, r.frame, r.at, r.n)) for r in own.itertuples(index=False)]
        out.close()
        return pd.DataFrame({"hash": own["hash"].to_numpy(), "uri": uri, "frame": [p[0] for p in places], "at": [p[1] for p in places]})

    # A group is one pack's chunk list, no larger than an input split made it.
    index = scratch.keep(owned.groupBy("pack").applyInPandas(rewrite, "hash binary, uri string, frame int, at int"), "index")
    remove_dir(loose)
    found = uses.select("uid", "seq", "hash", "n").join(index, "hash")
    refs = (
        found.repartitionByRange("uid")
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "hash", "uri", "frame", "at", "n"))).alias("refs"))
    )
    return scratch.keep(drafts.drop("refs", "pack").join(refs, "uid", "left"), "recipes")


def _in_order(recipes: DataFrame, root: str, scratch: Scratch) -> None:
    """Write the recipes below ``root`` in ascending doc_id order, with nth and start.

    Rows of one doc_id go by Merkle root, then uid. Range partitions carry their counts, two numbers each, to the driver.
    """
    order = ["doc_id", "root", "uid"]
    dealt = recipes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    ranges = scratch.keep(dealt, "ranges")
    firsts, nth, upto = [], 0, 0
    for r in ranges.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("n")).orderBy("part").collect():
        firsts.append((r["part"], nth, upto))
        nth, upto = nth + r["rows"], upto + r["n"]
    part = Window.partitionBy("part").orderBy(*order)
    before = F.coalesce(F.sum("n_tokens").over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = recipes.sparkSession.createDataFrame(firsts, "part int, first_nth long, first_start long")
    numbered = (
        ranges.join(F.broadcast(offsets), "part")
        .withColumn("nth", F.col("first_nth") + F.row_number().over(part) - 1)
        .withColumn("start", F.col("first_start") + before)
    )
    writer = numbered.drop("first_nth", "first_start").write
    (writer.partitionBy("part") if nth else writer).parquet(f"{root}/recipes")  # without rows, partitions would lose the schema


def _leaves(documents: DataFrame) -> DataFrame:
    return documents.select("nth", F.lit(1).cast("long").alias("documents"), "n_tokens", "start", F.hex("root").alias("root"))


def merkle_tree(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """(level, node, documents, n_tokens, start, root) of a hash tree over leaves numbered by nth, up to a single root.

    A node covers the ``FAN`` next numbers of the level below, so no group exceeds that many rows.
    """
    found, below = [], leaves
    while True:
        children = F.transform(F.array_sort(F.collect_list(F.struct("nth", "start", "n_tokens", "root"))), lambda x: F.concat_ws("-", x["start"], x["n_tokens"], x["root"]))
        nodes = below.groupBy(F.floor(F.col("nth") / FAN).cast("long").alias("node")).agg(
            F.sum("documents").alias("documents"), F.sum("n_tokens").alias("n_tokens"), F.min("start").alias("start"), F.sha2(F.concat_ws(",", children), 256).alias("root")
        )
        nodes = scratch.keep(nodes.select(F.lit(len(found)).alias("level"), "*"), "tree")
        found.append(nodes)
        if nodes.count() <= 1:
            return reduce(DataFrame.union, found)
        below = nodes.select(F.col("node").alias("nth"), "documents", "n_tokens", "start", "root")


def read_store(spark: SparkSession, root: str, *, with_ids: bool = False) -> DataFrame:
    """All documents of a store: doc_id, uid, nth, start, n_tokens, ids_crc32 (and ids), from its files alone.

    A damaged chunk, document root or length raises, and so does a tree over what was read that differs from the manifest:
    a recipe that is lost, added or moved changes it.
    """
    recipes = spark.read.parquet(f"{root}/recipes")
    id_type = dict(recipes.dtypes)["doc_id"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = PackReader()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                hashes, parts = [], []
                for ref in r.refs if r.refs is not None else ():
                    ids = reader.ids(ref["uri"], ref["frame"], ref["at"], ref["n"]).astype("<u4")
                    h = hashlib.blake2b(ids.tobytes(), digest_size=16).digest()
                    if h != bytes(ref["hash"]):
                        raise ValueError(f"damaged chunk in {ref['uri']}")
                    hashes.append(h)
                    parts.append(ids)
                ids = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
                own = merkle_root(hashes)
                if own != bytes(r.root) or len(ids) != r.n_tokens:
                    raise ValueError(f"recipe {r.uid} does not give its document back")
                out.append((r.uid, r.nth, r.start, len(ids), own, zlib.crc32(ids.tobytes()), *([ids.astype(np.int64)] if with_ids else [])))
            frame = pd.DataFrame(out, columns=["uid", "nth", "start", "n_tokens", "root", "ids_crc32", *["ids"] * with_ids])
            frame.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield frame

    # Packs follow the input's splits, and so does uid: in its order a task opens few packs, whatever the order of ids.
    near = recipes.select("doc_id", "uid", "nth", "start", "n_tokens", "root", "refs").repartitionByRange("uid").sortWithinPartitions("uid")
    fields = f"doc_id {id_type}, uid long, nth long, start long, n_tokens long, root binary, ids_crc32 long" + ", ids array<long>" * with_ids
    with Scratch(spark, "token-rows") as scratch:
        with small_batches(spark):
            documents = scratch.result(near.mapInPandas(read, fields))
        tree, manifest = merkle_tree(_leaves(documents), scratch), spark.read.parquet(f"{root}/manifest")
        differing = tree.exceptAll(manifest).limit(1).count() + manifest.select(tree.columns).exceptAll(tree).limit(1).count()
        if differing:
            raise ValueError(f"the documents of {root} are not those of its manifest")
    return documents.drop("root")


def store_and_read(docs: DataFrame, tokenizer_path: str, *, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents, then per row doc_id, start, n_tokens, ids_crc32 as the files give them back.

    Null texts count as empty and hold the end id alone; very long ones are chunks like any other. Rows with one doc_id
    follow each other by content; a null doc_id comes first. Repeated rows share their chunks. An empty table gives an
    empty table; other columns are not read.
    """
    root = write_store(docs, tokenizer_path, end_id=end_id, id_col=id_col, text_col=text_col)
    return read_store(docs.sparkSession, root).select("doc_id", "start", "n_tokens", "ids_crc32")
