"""Benchmark decontamination: rare word seeds, then Smith-Waterman alignment of whole words.

Test items come in blocks of bounded size, each held by every task; the corpus is only scanned, never shuffled. No copy
that reaches the threshold is lost on the way to its alignment, wherever its words were edited:

* A score of s needs s / MATCH matched words, so of an item's words only so many can go unmatched. A bit more than that
  many are its seeds, those that fewest items hold; a text with too few of them (each counted as often as the item has it)
  can't reach the threshold.
* A stretch of text scores at most MATCH for each of its words that the item has, less one for each other word. Only
  where this bound reaches the threshold is the text aligned with the item, allowing changed, added and lost words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import give_back

MATCH, MISMATCH, GAP = 2, -1, 1
#: Least share of an item's full alignment score that counts as a copy of it.
THRESHOLD = 0.5
#: Characters of the items of one block, at most (but for a single item that is longer).
BLOCK_CHARS = 4_000_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if isinstance(text, str) else []


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two id sequences: score, and the end in each; id 0 matches nothing.

    Row by row: a gap within the row is a running maximum, since its cost is linear in its length.
    """
    steps = GAP * np.arange(len(text) + 1)
    row, best = np.zeros(len(text) + 1, dtype=np.int64), (0, 0, 0)
    for i, word in enumerate(item):
        gain = np.where((text == word) & (text != 0), MATCH, MISMATCH)
        fresh = np.zeros_like(row)
        fresh[1:] = np.maximum(0, np.maximum(row[:-1] + gain, row[1:] - GAP))
        row = np.maximum.accumulate(fresh + steps) - steps
        j = int(np.argmax(row))
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
    return best


@dataclass
class Block:
    """Items as word ids over their own vocabulary, and the items that have each word among their seeds."""

    ids: list
    items: list[np.ndarray]
    vocabulary: dict[str, int]
    need: np.ndarray  # least score of each item
    least: np.ndarray  # seeds of each item that a text must have
    first: np.ndarray  # place in holders of the first item of each word id, and one more
    holders: np.ndarray  # item places, by word
    times: np.ndarray  # how often the word is among that item's seeds

    @staticmethod
    def of(rows: list[tuple[object, str | None]], threshold: float) -> Block:
        vocabulary: dict[str, int] = {}
        items = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(t)], dtype=np.int64) for _, t in rows]
        held = np.zeros(len(vocabulary) + 1, dtype=np.int64)
        for x in items:
            held[np.unique(x)] += 1
        need, least, triples = [], [], []
        for k, x in enumerate(items):
            need.append(threshold * MATCH * len(x))
            matched = max(1, math.ceil(need[-1] / MATCH - 1e-9))
            spare = max(0, len(x) - matched)  # words that a copy may lack
            n = min(len(x), spare + 1 + len(x) // 4)
            least.append(max(1, n - spare))
            seeds, times = np.unique(x[np.lexsort((x, held[x]))[:n]], return_counts=True)
            triples.append((seeds, np.full(len(seeds), k), times))
        word, item, times = (np.concatenate(c).astype(np.int64) for c in zip(*triples, strict=True))
        order = np.argsort(word, kind="stable")
        first = np.searchsorted(word[order], np.arange(len(vocabulary) + 2))
        return Block([i for i, _ in rows], items, vocabulary, np.array(need), np.array(least), first, item[order], times[order])

    def word_ids(self, text: str | None) -> np.ndarray:
        found = words(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in found), dtype=np.int64, count=len(found))

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """Places of the items of which the text has enough seeds."""
        own, n = np.unique(ids[ids != 0], return_counts=True)
        low, size = self.first[own], self.first[own + 1] - self.first[own]
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        shared = np.minimum(self.times[at], np.repeat(n, size))
        return np.flatnonzero(np.bincount(self.holders[at], weights=shared, minlength=len(self.items)) >= self.least)

    def stretches(self, k: int, ids: np.ndarray) -> list[tuple[int, int]]:
        """Apart from each other, the stretches of text that hold every part whose words allow the score that item k needs."""
        mark = np.zeros(len(self.vocabulary) + 1, dtype=np.int64)
        mark[self.items[k]] = MATCH + 1
        upto = np.concatenate(([0], np.cumsum(mark[ids] - 1)))
        ends = np.flatnonzero(upto - np.minimum.accumulate(upto) >= self.need[k])
        if not len(ends):
            return []
        m = len(self.items[k])
        span = int((MATCH + 1) * m - self.need[k])  # a part with more words than this has too few of the item's
        cuts = np.flatnonzero(np.diff(ends) > span)
        lows, highs = ends[np.concatenate(([0], cuts + 1))] - span, ends[np.concatenate((cuts, [len(ends) - 1]))]
        return [(max(0, int(a)), int(b)) for a, b in zip(lows, highs, strict=True)]

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, end word) of the best copy of each item in the text that reaches the threshold."""
        ids = self.word_ids(text)
        found = []
        for k in self.candidates(ids):
            item, best = self.items[k], None
            for low, high in self.stretches(k, ids):
                score, end_item, end_text = align(item, ids[low:high])
                if score >= self.need[k] and (best is None or score > best[0]):
                    _, _, back = align(item[:end_item][::-1], ids[low : low + end_text][::-1])
                    best = (score, low + end_text - back, low + end_text)
            if best:
                found.append((int(k), best[0] / (MATCH * len(item)), best[1], best[2]))
        return found


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list]:
    """The items, block by block; blocks' sizes are summed before any of one is fetched."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL").dropDuplicates()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    while True:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        largest = items.groupBy(block.alias("b")).agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("k")).where("k > 1").agg(F.max("chars")).first()[0] or 0
        if largest <= block_chars:
            break
        n *= 2
    for k in range(n):
        rows = sorted(((r["item_id"], r["text"]) for r in items.where(block == k).collect()), key=str)
        if rows:
            yield rows


def prepared_blocks(benchmark: DataFrame, threshold: float, block_chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The blocks that hold any word."""
    for rows in _blocks(benchmark, block_chars):
        rows = [(i, t) for i, t in rows if words(t)]
        if rows:
            yield Block.of(rows, threshold)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): each row's best copy of each item that scores at least the threshold.

    score is the alignment's share of the item's full score: 1 for a copy of all its words, whatever case and
    punctuation. Of several copies in a text the best counts, of equally good ones the first. Very long texts are searched
    whole, an item longer than a block alone in its block. Null, empty and wordless texts and items match nothing; null ids
    are kept; repeated rows each have their own results, as have repeated items of different text. Empty tables give an
    empty result; other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = f"doc_id {dict(own.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, score double, first_word long, end_word long"
    found = own.sparkSession.createDataFrame([], fields)
    for block in prepared_blocks(benchmark, threshold, block_chars):
        shared = own.sparkSession.sparkContext.broadcast(block)

        def match(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            block = shared.value
            for pdf in batches:
                rows = [(d, block.ids[k], score, a, b) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for k, score, a, b in block.matches(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "first_word", "end_word"])
            give_back()

        found = found.union(own.mapInPandas(match, fields))
    return found


def _without_matches(shared):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([not shared.value.matches(t) for t in texts], dtype=bool)
        give_back()

    return clean


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns unchanged, that hold no copy of an item.

    Null and empty texts hold none and stay; repeated rows stay or go together; without items all stay; an empty table gives
    an empty table; no column name can clash, as a row's own columns travel as one.
    """
    columns = docs.columns
    kept = docs
    for block in prepared_blocks(benchmark, threshold, block_chars):
        clean = _without_matches(docs.sparkSession.sparkContext.broadcast(block))
        place = F.struct(*[kept[c] for c in columns]).alias("__doc")
        kept = kept.select(place, clean(kept[text_col]).alias("__clean")).where("__clean").select("__doc.*")
    return kept
