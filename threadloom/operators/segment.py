"""Words out of texts without spaces: the cheapest way through a dictionary, with costs learnt from counts.

A word costs minus the logarithm of its share, in whole thousandths, so equal costs are equal; a character outside the
dictionary costs more than any word. From the end of a text backwards each place keeps its cheapest continuation (of equals
the longest word), found by walking a trie, so the time is linear in the text times the longest word. A worker holds the
dictionary as a model of sentencepiece, whose compiled search is the same one in the other direction. Of a dictionary too
large for that, the cheapest words are held as a trie; the rest are looked for part by part, and only where they stand is kept.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from math import log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.scratch import Scratch

try:  # without it every dictionary is looked for in parts
    from sentencepiece import SentencePieceProcessor
except ImportError:
    SentencePieceProcessor = None

#: Characters of a dictionary that each worker holds whole, as a model.
BROADCAST_CHARS = 24_000_000
#: Characters of a part of a larger dictionary, some 200 MB of a worker; words of a quarter of that are held as a trie.
PART_CHARS = 2_000_000
#: What a text is cut at first: all but letters, digits and the like.
_RUN, _APART = re.compile(r"\w+"), re.compile(r"\W+")
#: Whole numbers below this are exact in single precision, in which a model adds costs.
_EXACT = 1 << 24
#: Where a word of a part stands in a text, how long it is and what it costs.
_PLACE = np.dtype([("start", "<i4"), ("length", "<i4"), ("cost", "<i8")])

_held: dict[str, object] = {}


def learnt(counts: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """(word, cost) of counted words; words without characters or count are left out."""
    own = counts.where((F.col(n) > 0) & (F.length(word) > 0)).groupBy(F.col(word).alias("word")).agg(F.sum(n).alias("n"))
    total = own.agg(F.sum("n").alias("total"))
    return own.crossJoin(F.broadcast(total)).select("word", F.round(-1000.0 * F.log(F.col("n") / F.col("total"))).cast("long").alias("cost"))


def unknown_cost(total_cost: int) -> int:
    """Of a character outside the dictionary, given the dearest word's cost."""
    return total_cost + int(1000 * log(10)) + 1


def trie(words: Sequence[tuple[str, int]]) -> dict:
    top: dict = {}
    for w, cost in words:
        at = top
        for c in w:
            at = at.setdefault(c, {})
        at[""] = min(cost, at.get("", cost))
    return top


def cheapest(text: str, words: dict, unknown: int, more: dict[int, list[tuple[int, int]]] | None = None, at_start: int = 0) -> list[str]:
    """The words of one run of characters. ``more``: by place, counted from ``at_start`` before the run, (length, cost) of other words that stand there."""
    n = len(text)
    best, size = [0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        least, length = unknown + best[i + 1], 1
        at, j = words, i
        while j < n and text[j] in at:
            at = at[text[j]]
            j += 1
            if "" in at and at[""] + best[j] <= least:
                least, length = at[""] + best[j], j - i
        if more and at_start + i in more:
            for k, cost in more[at_start + i]:
                if cost + best[i + k] < least or cost + best[i + k] == least and k > length:
                    least, length = cost + best[i + k], k
        best[i], size[i] = least, length
    out, i = [], 0
    while i < n:
        out.append(text[i : i + size[i]])
        i += size[i]
    return out


def _field(number: int, own: bytes) -> bytes:
    """A field of a protocol buffer that holds bytes."""
    size, left = bytearray(), len(own)
    while left > 0x7F:
        size.append(left & 0x7F | 0x80)
        left >>= 7
    return bytes([number << 3 | 2, *size, left]) + own


def _piece(word: str, cost: int, kind: bytes = b"") -> bytes:
    """A word as a piece of a model, from its last character to its first; what costs less scores more."""
    return _field(1, _field(1, word[::-1].encode()) + b"\x15" + struct.pack("<f", -cost) + kind)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(_piece(w, cost) for w, cost in words if _RUN.fullmatch(w))], pa.binary())], ["pieces"])


def model_of(pieces: Sequence[bytes], singles: Iterable[str], unknown: int) -> bytes:
    """A unigram model of a dictionary's pieces. All other characters that words are made of are pieces that cost ``unknown``; ``singles`` are the dictionary's own."""
    own = set(singles)
    others = [_piece(c, unknown) for c in map(chr, range(0x110000)) if (c.isalnum() or c == "_") and c not in own]
    unigram, as_it_is = _field(2, b"\x18\x01"), _field(3, _field(1, b"identity") + b"\x18\x00\x20\x00\x28\x00")  # no prefix, white space neither removed nor replaced
    return b"".join([_piece(">knu<", 0, b"\x18\x02"), *pieces, *others, unigram, as_it_is])


def _together(text: str, most: int) -> Iterator[str]:
    """The runs of a text from its last character to its first, parted by line feeds: as many at once as ``most`` characters hold, or one longer run."""
    own, start = _APART.sub("\n", text).strip("\n")[::-1], 0
    while start < len(own):
        end = len(own) if len(own) - start <= most else own.rfind("\n", start, start + most + 1)
        if end < 0:
            end = own.find("\n", start + most)
            end = len(own) if end < 0 else end
        yield own[start:end]
        start = end + 1


class Held:
    """A dictionary as a model: (its bytes, the cost of an unknown character, the different lengths of its words).

    The model's search goes forwards and keeps of equals what begins first, so texts and words are turned round: then each
    place keeps its cheapest continuation, of equals the longest word. It adds in single precision, which is exact if the
    whole costs less than 2**24; places that cost more stay that dear and are not chosen. Runs are put together as long
    as they cannot cost so much; a longer run that does is walked here, with the words that it holds.
    """

    def __init__(self, own: tuple[bytes, int, list[int]]):
        model, self._unknown, lengths = own
        self._model, self._lengths = SentencePieceProcessor(model_proto=model), sorted(lengths)
        self._most = (_EXACT - 1) // (self._unknown + 10)  # a line feed costs 10 more than the dearest piece

    def _cost(self, piece: int) -> int:
        return -int(self._model.get_score(piece))

    def _walked(self, run: str) -> list[int]:
        """Pieces of a run that is turned round, in its order."""
        words, longest = {}, max(self._lengths, default=1)
        step = max(1, 4_000_000 // longest)
        for start in range(0, len(run), step):
            for window in {run[max(0, end - longest) : end] for end in range(start + 1, min(start + step, len(run)) + 1)}:
                for k in self._lengths:
                    if k > len(window):
                        break
                    if piece := self._model.piece_to_id(window[-k:]):
                        words[window[-k:]] = piece
        held = trie([(w[::-1], self._cost(piece)) for w, piece in words.items()])
        return [self._model.piece_to_id(w[::-1]) for w in reversed(cheapest(run[::-1], held, self._unknown))]

    def _of(self, text: str | None) -> Iterator[list[int]]:
        for run in _together(text or "", self._most):
            found = self._model.encode(run, out_type=int)
            yield self._walked(run) if len(run) > self._most and sum(map(self._cost, found)) >= _EXACT else found

    def _word(self, piece: int) -> str:
        return self._model.id_to_piece(piece)[::-1]

    def words(self, text: str | None) -> list[str]:
        """The words of a text in their order."""
        return [self._word(p) for found in self._of(text) for p in found if p][::-1]  # 0 parts runs

    def counts(self, texts: Iterable[tuple[str | None, int]]) -> tuple[list[str], np.ndarray]:
        """The words of texts that come so many times each, and how often each occurs."""
        n, waiting = np.zeros(self._model.vocab_size(), np.int64), []

        def add():
            nonlocal n
            n += np.bincount(np.array(waiting, np.int64), minlength=len(n))
            waiting.clear()

        for text, times in texts:
            for found in self._of(text):
                if times == 1:
                    waiting.extend(found)
                else:
                    np.add.at(n, found, times)
            if len(waiting) > 1 << 19:
                add()
        add()
        found = np.flatnonzero(n[1:]) + 1
        return [self._word(int(k)) for k in found], n[found]


def _counted(words: Iterator[list[str]], stop: frozenset[str]) -> Iterator[pa.RecordBatch]:
    own: Counter[str] = Counter()
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["word", "n"])
    for found in words:
        own.update(w for w in found if w not in stop)
        if len(own) > 200_000:
            yield batch()
            own.clear()
    yield batch()


def _of_worker(part: tuple[str, Broadcast], made):
    """What is made of a named broadcast list, kept while this worker works on the same list."""
    name, words = part
    if name not in _held:
        _held.clear()
        _held[name] = made(words.value)
    return _held[name]


def _automaton(words: Sequence[tuple[str, int]]):
    own = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for w, cost in words:
        own.add_word(w, cost << 16 | len(w))
    own.make_automaton()
    return own


def _places(part: tuple[str, Broadcast]):
    """(id, found): where the words of a part stand in the runs of texts (id, t), for those that hold any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _of_worker(part, _automaton)
        for batch in batches:
            at, found = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                places = [(r.start() + end + 1 - (v & 0xFFFF), v & 0xFFFF, v >> 16) for r in _RUN.finditer(t or "") for end, v in own.iter(r.group())]
                if places:
                    at.append(k)
                    found.append(np.array(places, _PLACE).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.binary())], ["id", "found"])

    return run


def _beyond(texts: DataFrame, dictionary: DataFrame, unknown: int, stop: frozenset[str], most_chars: int) -> DataFrame:
    """(word, n) with a dictionary of any size: the cheapest words as a trie, the others part by part; what is shuffled is where those stand."""
    spark, chars = texts.sparkSession, F.sum(F.length("word")).alias("chars")
    share = lambda words: (uuid.uuid4().hex, spark.sparkContext.broadcast([(r["word"], r["cost"]) for r in words.select("word", "cost").collect()]))
    dearest, total, rest = -1, 0, 0
    for r in dictionary.groupBy("cost").agg(chars).orderBy("cost").collect():  # as many rows as different costs
        total += r["chars"]
        if total <= most_chars // 4:
            dearest = r["cost"]
        else:
            rest += r["chars"]
    held, others, n = share(dictionary.where(F.col("cost") <= dearest)), dictionary.where(F.col("cost") > dearest), -(-rest // most_chars)
    with Scratch(spark, "segments") as scratch:
        texts = scratch.keep(texts.where("t IS NOT NULL").select(F.monotonically_increasing_id().alias("id"), "t"), "texts")
        others = scratch.keep(others.groupBy("word").agg(F.min("cost").alias("cost")).where(F.length("word") < 1 << 16), "words")
        parts = [share(others.where(F.pmod(F.xxhash64("word"), F.lit(n)) == k)) for k in range(n)]
        none = spark.createDataFrame([], "id long, found binary")
        found = reduce(DataFrame.union, [texts.mapInArrow(_places(p), none.schema) for p in parts if p[1].value], none)
        placed = texts.join(found.groupBy("id").agg(F.collect_list("found").alias("found")), "id", "left")  # of a text one a part at most

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _of_worker(held, trie)

            def words(t: str, found: list[bytes] | None) -> Iterator[list[str]]:
                more: dict[int, list[tuple[int, int]]] = {}
                for f in found or ():
                    for start, length, cost in np.frombuffer(f, _PLACE).tolist():
                        more.setdefault(start, []).append((length, cost))
                for r in _RUN.finditer(t):
                    yield cheapest(r.group(), own, unknown, more, r.start())

            rows = ((t, f) for b in batches for t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            yield from _counted((w for t, f in rows for w in words(t, f)), stop)

        return scratch.result(placed.select("t", "found").mapInArrow(walk, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def segmented_counts(df: DataFrame, text: Column, dictionary: DataFrame, *, stop: Sequence[str] = (), broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(word, n): how often each word of the cheapest segmentation occurs in all texts, lower case, less stop words.

    ``dictionary`` is (word, cost), as ``learnt`` gives it, in lower case. Null texts have no words. What is neither letter
    nor digit parts words.
    """
    lowered, left_out, spark = df.select(F.lower(text).alias("t")), frozenset(stop), df.sparkSession
    with Scratch(spark, "dictionary") as scratch:
        dictionary = scratch.keep(dictionary.groupBy("word").agg(F.min("cost").alias("cost")).where(F.length("word") > 0), "words")
        number = lambda c: F.coalesce(c, F.lit(0))
        size = dictionary.agg(number(F.sum(F.length("word"))).alias("chars"), number(F.max("cost")).alias("dearest"), number(F.min("cost")).alias("least"), F.collect_set(F.length("word")).alias("lengths")).first()
        unknown = unknown_cost(size["dearest"])
        if SentencePieceProcessor is None or size["chars"] > broadcast_chars or size["least"] < 0 or unknown + 10 >= _EXACT:
            return _beyond(lowered, dictionary, unknown, left_out, min(broadcast_chars, PART_CHARS))
        pieces = [r["pieces"] for r in dictionary.orderBy("cost", F.reverse("word")).mapInArrow(_pieces, "pieces binary").collect()]  # what is met often, or one after the other, lies together
        singles = [r["word"] for r in dictionary.where(F.length("word") == 1).collect()]
    held = uuid.uuid4().hex, spark.sparkContext.broadcast((model_of(pieces, singles, unknown), unknown, size["lengths"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((t.as_py(), times) for b in batches for t, times in zip(b.column(0), b.column(1).to_pylist(), strict=True))
        words, n = _of_worker(held, Held).counts(texts)
        kept = [k for k, w in enumerate(words) if w not in left_out]
        yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in kept], pa.string()), pa.array(n[kept], pa.int64())], ["word", "n"])

    different = lowered.where("t IS NOT NULL").groupBy("t").agg(F.count(F.lit(1)).alias("times"))  # also deals texts evenly, however few files hold them
    return different.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_runs(df: DataFrame, text: Column, order: str, pattern: str = r"[\x{4e00}-\x{9fff}]{2,4}", n: int = 8) -> DataFrame:
    """(rank, word, n): the most frequent matches of a pattern, of equals that which comes first by ``order`` and place."""
    found = df.select(F.col(order).alias("__o"), F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("__p", "word"))
    counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("__o", "__p")).alias("__first"))
    top = counts.orderBy(F.desc("n"), "__first").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "__first"))).select("rank", "word", "n")  # of at most n rows
