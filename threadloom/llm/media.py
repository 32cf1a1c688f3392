"""Media columns: payloads stored once under their digest in tar shards, rows that carry digest, offset and length.

A payload becomes an 8-bit grey PNG of 64 samples a row. Digests alone are shuffled, to choose one owner for each among the
input partitions that hold it; the owner's task encodes and writes it. Header-only range reads fill the metadata columns;
full range reads give the payload back.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.llm.common import Scratch, utf8
from threadloom.llm.files import Ranges, Writer, make_dir, open_fs
from threadloom.scratch import result_path

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and header chunk of a PNG file.
HEADER_BYTES = 33
LEVEL = 4
BLOCK = 512
INDEX = "digest binary, shard string, offset long, length long"


def padded(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of the row width."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), dtype=np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a file's first bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    return struct.unpack(">IIB", head[16:25])


def decode_png(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    packed, at = [], 8
    while at < len(data):
        (n,), kind, body = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8], data[at + 8 :]
        if zlib.crc32(kind + body[:n]) != struct.unpack(">I", body[n : n + 4])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            packed.append(body[:n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected PNG filter")
    return lines[:, 1:].tobytes()


def payload_column(text: str) -> Column:
    """The padded payload of a text column, made by Spark's own functions."""
    data = utf8(text)
    pad = F.greatest(F.lit(WIDTH), F.ceil(F.length(data) / WIDTH) * WIDTH) - F.length(data)
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), pad.cast("int"))))


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, digest, part) of every row, by Spark's own functions; part: the input partition it came from."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(utf8(text_col)).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(payload_column(text_col), 256)).alias("digest"),
        F.spark_partition_id().alias("part"),
    )


def _owned(root: str, part: int) -> set[bytes]:
    """The digests that an input partition is to store."""
    fs, path = open_fs(f"{root}/part={part}")
    found: set[bytes] = set()
    for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                found.update(pq.read_table(source, columns=["digest"])["digest"].to_pylist())
    return found


class _Shard:
    """A tar file of stored payloads, made when the first is added."""

    def __init__(self, root: str):
        self._uri = f"{root}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.tar"
        self._out: Writer | None = None

    def add(self, digest: bytes, payload: bytes) -> tuple[bytes, str, int, int]:
        self._out = self._out or Writer(self._uri)
        stored = encode_png(payload)
        member = tarfile.TarInfo(f"{digest.hex()}.png")
        member.size = len(stored)
        self._out.write(member.tobuf(tarfile.USTAR_FORMAT))
        place = (digest, self._uri, self._out.write(stored), len(stored))
        self._out.write(bytes(-len(stored) % BLOCK))
        return place

    def close(self) -> None:
        if self._out:
            self._out.write(bytes(2 * BLOCK))
            self._out.close()


def store(docs: DataFrame, rows: DataFrame, scratch: Scratch, root: str | None = None, *, text_col: str = "text") -> DataFrame:
    """Write the tar shards of all distinct payloads below ``root``; their index (digest, shard, offset, length) in scratch.

    ``rows``: the written ``digests`` of docs. Of them only digests are shuffled: each gets one owner, the least input
    partition that holds it, and that partition's task encodes and writes it straight into its shard. Should a partition
    hold other rows when it is read again, some digest is left without a file; such texts are dealt by digest and stored
    then. A task that runs again writes a shard of another name, so a lost executor damages nothing that is referred to.
    """
    root = root or result_path(docs.sparkSession, "media")
    make_dir(root)
    owners = rows.groupBy("digest").agg(F.min("part").alias("part"))
    owner_files = f"{scratch.root}/owners"
    owners.repartition("part").write.partitionBy("part").parquet(owner_files)
    texts = docs.select(F.col(text_col).alias("text"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owned, shard = _owned(owner_files, TaskContext.get().partitionId()), _Shard(root)
        for pdf in batches:
            found = []
            for text in pdf["text"]:
                payload = padded(text.encode("utf-8") if isinstance(text, str) else b"")
                digest = hashlib.sha256(payload).digest()
                if digest in owned:
                    owned.remove(digest)
                    found.append(shard.add(digest, payload))
            yield pd.DataFrame(found, columns=["digest", "shard", "offset", "length"])
        shard.close()

    def write_left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        shard = _Shard(root)
        for pdf in batches:
            found = []
            for digest, payload in zip(pdf["digest"], pdf["payload"], strict=True):
                if bytes(digest) not in seen:
                    seen.add(bytes(digest))
                    found.append(shard.add(bytes(digest), bytes(payload)))
            yield pd.DataFrame(found, columns=["digest", "shard", "offset", "length"])
        shard.close()

    index = scratch.keep(texts.mapInPandas(write, INDEX), "index")
    left = scratch.keep(owners.select("digest").join(index.select("digest"), "digest", "left_anti"), "left")
    if left.limit(1).count():
        payload = payload_column(text_col)
        again = docs.select(F.unhex(F.sha2(payload, 256)).alias("digest"), payload.alias("payload")).join(left, "digest", "left_semi")
        more = again.dropDuplicates(["digest"]).repartition("digest").mapInPandas(write_left, INDEX)
        index = scratch.keep(index.union(more), "index")
    return index


def metadata(index: DataFrame) -> DataFrame:
    """Width, height and bit depth of each stored file, from range reads of its header alone."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges = Ranges()
        for pdf in batches:
            heads = [png_header(ranges.read(s, o, HEADER_BYTES)) for s, o in zip(pdf["shard"], pdf["offset"], strict=True)]
            yield pdf.assign(width=[h[0] for h in heads], height=[h[1] for h in heads], bit_depth=[h[2] for h in heads])

    return index.repartitionByRange("shard", "offset").mapInPandas(read, INDEX + ", width int, height int, bit_depth int")


def describe(payload: bytes) -> str:
    """A feature of the samples: extent, mean, spread, share of zeros and a 16-level histogram in thousandths."""
    x = np.frombuffer(payload, dtype=np.uint8)
    levels = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"{len(x) // WIDTH}x{WIDTH};mean={x.mean():.4f};sd={x.std():.4f};zero={float((x == 0).mean()):.4f};hist={','.join(map(str, levels))}"


def read_back(described: DataFrame) -> DataFrame:
    """From the index with metadata, per stored file: what the shard's bytes hold. Damage raises."""
    fields = "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges = Ranges()
        for pdf in batches:
            found = []
            for r in pdf.itertuples(index=False):
                stored = ranges.read(r.shard, r.offset, r.length)
                payload = decode_png(stored)
                said = hashlib.sha256(payload).hexdigest()
                if said != bytes(r.digest).hex() or len(payload) != r.width * r.height:
                    raise ValueError(f"{r.shard} at {r.offset}: stored bytes do not give digest {bytes(r.digest).hex()}")
                found.append((r.digest, len(payload), said, zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(payload), r.width, r.height))
            yield pd.DataFrame(found, columns=[f.split()[0] for f in fields.split(", ")])

    return described.mapInPandas(read, fields)


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, n_bytes and the columns of its stored payload, with shard, offset and length.

    Null and empty texts have the payload of 64 zero bytes. Rows of equal texts share one stored file, however many they
    are; rows are never grouped, so a hot text is only a hot join key, which Spark splits. An empty table gives an empty
    table; other columns are not read.
    """
    with Scratch(docs.sparkSession, "media") as scratch:
        rows = scratch.result(digests(docs, id_col=id_col, text_col=text_col))
        index = store(docs, rows, scratch, text_col=text_col)
        features = read_back(metadata(index)).join(index.withColumnRenamed("digest", "__digest"), F.col("digest") == F.col("__digest")).drop("__digest")
        return rows.drop("part").join(scratch.result(features), "digest").drop("digest")
