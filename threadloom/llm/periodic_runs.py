"""Runs of words that repeat with a period: found whole, named by their smallest period, collapsed to one period.

A run of length L and period q repeats L - q words at distance q. As L is at least max(MIN_LENGTH, MIN_EXPONENT * q), that
overlap is never below ``minimum_overlap()`` = k words, so both the first and the last L - q words of a run are made of
k-grams that occur twice in the document, and together they are the whole run. Words outside repeated k-grams therefore
cannot join runs. They cut the document into segments, and only segments long enough for a run go to Main and Lorentz's
search: halve, find what crosses the middle from four prefix tables, go on with both halves.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import give_back

MIN_LENGTH, MIN_EXPONENT = 24, 3
_ODD = 0x9E3779B97F4A7C15

Run = tuple[int, int, int]


def least_length(period: int) -> int:
    return max(MIN_LENGTH, MIN_EXPONENT * period)


def minimum_overlap() -> int:
    """The least number of words that a run of any period repeats at its period's distance."""
    return min(least_length(q) - q for q in range(1, MIN_LENGTH + 1))  # beyond, it only grows


def _gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """64 bits of each k-gram of ids; equal grams have equal bits."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD)
    part = x ^ (x >> np.uint64(29))
    n, size, have, out = len(ids) - k + 1, 1, 0, None
    power = _ODD  # to the size
    while True:
        if k & size:  # a part of `size` words, `have` words into the gram
            piece = part[have : have + n]
            out = piece.copy() if out is None else out * np.uint64(power) + piece
            have += size
        if have == k:
            return out
        part = part[: len(part) - size] * np.uint64(power) + part[size:]
        size, power = 2 * size, power * power & 0xFFFFFFFFFFFFFFFF


def surviving_segments(ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Stretches [start, end) of words inside repeated k-grams, long enough for a run. Equal bits of different grams only add words."""
    if len(ids) < MIN_LENGTH:
        return []
    grams = _gram_hashes(ids, k)
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return []
    twice = np.zeros(len(grams), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    inside = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1]).tolist()
    return [(a, b) for a, b in zip(turns[::2], turns[1::2], strict=True) if b - a >= MIN_LENGTH]


def prefix_table(s: Sequence[int]) -> list[int]:
    """For each place of s how many elements from it on equal the beginning of s."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        m = 0
        if i < right:
            m = z[i - left]
            if m < right - i:
                z[i] = m
                continue
            m = right - i
        while i + m < n and s[m] == s[i + m]:
            m += 1
        z[i] = m
        if i + m > right:
            left, right = i, i + m
    return z


def _crossing(u: list[int], v: list[int]) -> Iterator[Run]:
    """Repetitions of u + v, as (start, end, period), that hold a whole period at the beginning of v."""
    n = len(u)
    most = min(len(v), (n + len(v)) // MIN_EXPONENT)
    ahead = prefix_table(v)
    back = u[::-1]
    behind = prefix_table([*back, -1, *reversed(v[:most]), *back])
    for q in range(1, most + 1):
        right = ahead[q] if q < len(v) else 0
        left = behind[n + 1 + most - q]
        if left + q + right >= MIN_LENGTH and left + right >= (MIN_EXPONENT - 1) * q:
            yield n - left, n + q + right, q


def runs_of(ids: list[int], start: int, end: int) -> set[Run]:
    """(start, end, smallest period) of every run inside a segment, by divide and conquer."""
    found: dict[tuple[int, int], int] = {}
    open_blocks = [(start, end)]
    while open_blocks:
        lo, hi = open_blocks.pop()
        if hi - lo < MIN_LENGTH:
            continue
        mid = (lo + hi) // 2
        open_blocks += [(lo, mid), (mid, hi)]
        u, v = ids[lo:mid], ids[mid:hi]
        right = [(lo + a, lo + b, q) for a, b, q in _crossing(u, v)]
        left = [(hi - b, hi - a, q) for a, b, q in _crossing(v[::-1], u[::-1])]
        for a, b, q in right + left:
            # what goes on beyond the block was found whole when a larger block was halved
            if (a > start and ids[a - 1] == ids[a - 1 + q]) or (b < end and ids[b] == ids[b - q]):
                continue
            found[a, b] = min(q, found.get((a, b), q))  # a multiple of a period has the same ends
    return {(a, b, q) for (a, b), q in found.items()}


def document_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a document's words, by start, then period."""
    if len(words) < MIN_LENGTH:
        return []
    seen: dict = {}
    ids = [seen.setdefault(w, len(seen)) for w in words]
    segments = surviving_segments(np.array(ids, dtype=np.int64), minimum_overlap())
    return sorted((a, b - a, q) for lo, hi in segments for a, b, q in runs_of(ids, lo, hi))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that are in no run, or in the first period of each run that holds them."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; of equals that of smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def with_planted_tail(words: list, doc_id: object) -> list:
    """What the query's contract does to one document in ten, by its id: words from some place on repeat with a period."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", planted: bool = False, with_text: bool = False) -> DataFrame:
    """Per row doc_id, n_runs, the strongest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256.

    ``with_text`` adds runs (start, length, period) and the collapsed text, words joined by one space. Words are told apart
    exactly. Null and empty texts have no words, no runs and the digest of the empty text. A text of any length is taken
    whole. A null id has no planted tail. Repeated rows give repeated rows; an empty table gives an empty table; other
    columns are not read. ``planted`` applies ``with_planted_tail`` first.
    """
    id_type = dict(docs.dtypes)[id_col]
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    shape = f"doc_id {id_type}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    if with_text:
        names, kinds = [*names, "runs", "collapsed"], [*kinds, pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])), pa.string()]
        shape += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def one(doc_id: object, text: bytes | None) -> tuple:
        words = (text or b"").split()  # at 0x20 and 0x09 to 0x0D
        if planted:
            words = with_planted_tail(words, doc_id)
        runs = document_runs(words)
        best = strongest(runs)
        kept = b" ".join(collapsed(words, runs))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        own = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        return (*own, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], kept.decode("utf-8", "replace")) if with_text else own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                rows = [one(i, t) for i, t in zip(own.column(0).to_pylist(), own.column(1).cast(pa.binary()).to_pylist(), strict=True)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([own.column(0), *columns], ["doc_id", *names])
        give_back()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, shape)
