"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation, in numpy.

A word's probability has two log-bilinear factors, each normalised exactly. The first predicts its symbol from the two
symbols before it; symbols are the commonest words, one class of words for each common ending, one for all other words,
and the end. The second predicts which word of the class it is from the symbol before: every word of the vocabulary's head
(it grows with the corpus up to ``HEAD`` words) has a vector of its own, as has each class's tail, within which the words
beyond the head share by their counts. So probabilities over all words, unseen ones as one a class, sum to 1.

Contexts are symbols, so both normalisers are computed once, by batched matrix products, and a token costs a few look-ups
and two inner products. Counts come from the whole training corpus by shuffles. Texts become symbol and word numbers once;
training and scoring read these.

Training rows are dealt by a hash of id and text into groups of about ``GROUP_TOKENS`` tokens and sorted by it, so the
model does not depend on how the input is partitioned. Each group trains on all its rows from one starting point, and
parameters are averaged, weighted by tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from threadloom.llm.common import Scratch, crc_mod, give_back

#: Words that are symbols of their own, endings that are, and characters of an ending.
WORDS = 400
ENDINGS = 120
ENDING = 2
#: Words with a vector of their own and counts that every task holds, at most.
HEAD = 150_000
DIM = 20
NOISE = 48
WORD_NOISE = 1
BATCH = 8192
RATE = 0.15
#: Tokens of a training group, about, up to a number of groups beyond which they grow; texts of the warm start; parameter
#: sets averaged at once.
GROUP_TOKENS = 4_000_000
MOST_GROUPS = 20_000
WARM_TEXTS = 1_500
FAN_IN = 4
END = "\n"  # white space, so no word equals it
BEGIN_ID, END_ID = 0, 1
FLUSH = 500_000


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A to Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []


def _ending(word: bytes) -> str:
    return word.decode("utf-8", "replace")[-ENDING:]


@dataclass
class Vocabulary:
    """Units are what the second factor predicts: head words that are no symbols, then one tail for each class.

    A word's number is its place in the head; a word beyond it has the number -1 - class.
    """

    total: int  # N
    distinct: int  # V
    head: dict[bytes, int]  # word: number
    counts: np.ndarray  # of head words
    symbols: np.ndarray  # of head words
    endings: dict[str, int]  # ending: symbol
    rest: int  # symbol of words without a common ending
    first_class: int  # symbols from here on are classes
    frequency: np.ndarray  # a symbol's count
    tail_count: np.ndarray  # a symbol: counts of its words beyond the head
    tail_words: np.ndarray  # a symbol: number of these words

    def __len__(self) -> int:
        return len(self.frequency)

    @property
    def own(self) -> int:
        return self.first_class - 2

    def symbol_of(self, word: bytes) -> int:
        return self.endings.get(_ending(word), self.rest)

    def unit_classes(self) -> np.ndarray:
        return np.concatenate([self.symbols[self.own :], np.arange(self.first_class, len(self))])

    def unit_mass(self) -> np.ndarray:
        return np.concatenate([self.counts[self.own :], self.tail_count[self.first_class :] + 1.0])

    def numbers(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        """The words' numbers, and the words beyond the head."""
        found = tokens(text)
        get = self.head.get
        at = np.fromiter((get(w, -1) for w in found), dtype=np.int32, count=len(found))
        beyond = [found[i] for i in np.flatnonzero(at < 0)]
        at[at < 0] = [-1 - self.symbol_of(w) for w in beyond]
        return at, beyond

    def streams(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and units (-1: the symbol says all) of a text with its end."""
        ids, units = np.full(len(at) + 1, END_ID, dtype=np.int32), np.full(len(at) + 1, -1, dtype=np.int32)
        known = at >= 0
        ids[:-1] = np.where(known, self.symbols[np.maximum(at, 0)] if len(self.symbols) else 0, -1 - at)
        tails = len(self.counts) - self.own - self.first_class
        units[:-1] = np.where(known, np.where(at >= self.own, at - self.own, -1), tails - 1 - at)
        return ids, units


class LogBilinear:
    """score(symbol | h1 h2) = (R[h1] C1 + R[h2] C2) . Q[w] + b[w]; score(unit | h2) = S[h2] . U[u] + c[u]; h2 is nearer."""

    PARTS = ("R", "Q", "C", "b", "S", "U", "c")

    def __init__(self, frequency: np.ndarray, unit_classes: np.ndarray, unit_mass: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        symbols, draw = len(frequency), lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.R, self.Q, self.S, self.U = draw(symbols, DIM), draw(symbols, DIM), draw(symbols, DIM), draw(len(unit_classes), DIM)
        self.C = np.stack([np.eye(DIM), np.eye(DIM)]).astype(np.float32) * 0.5
        f = frequency + 0.5
        self.b = np.log(f / f.sum()).astype(np.float32)
        self.classes, mass = unit_classes, unit_mass + 0.5
        whole = np.bincount(unit_classes, weights=mass, minlength=symbols)
        self.c = np.log(mass / whole[unit_classes]).astype(np.float32) if len(mass) else np.zeros(0, np.float32)
        self.noise, self.share = f / f.sum(), self.c.copy()
        # Units in order of their class with running masses, so that noise of a class is one search.
        self.by_class = np.argsort(unit_classes, kind="stable")
        self.upto = np.cumsum(mass[self.by_class])
        self.class_upto = np.cumsum(whole)
        self.class_mass = whole

    def packed(self) -> bytes:
        return b"".join(getattr(self, k).astype("<f4").tobytes() for k in self.PARTS)

    def load(self, data: bytes) -> LogBilinear:
        x, at = np.frombuffer(data, dtype="<f4"), 0
        for k in self.PARTS:
            own = getattr(self, k)
            setattr(self, k, x[at : at + own.size].reshape(own.shape).copy())
            at += own.size
        return self

    def train(self, ids: np.ndarray, units: np.ndarray, starts: np.ndarray, rng: np.random.Generator, state: dict[str, np.ndarray]) -> None:
        """One pass over a stream in shuffled batches."""
        h1, h2 = contexts(ids, starts)
        order = rng.permutation(len(ids))
        for at in range(0, len(ids), BATCH):
            own = order[at : at + BATCH]
            self._symbols(ids[own], h1[own], h2[own], rng, state)
            own = own[units[own] >= 0]
            if len(own):
                self._units(units[own], h2[own], rng, state)

    def _symbols(self, w: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator, state: dict[str, np.ndarray]) -> None:
        log_kn = np.log(NOISE * self.noise).astype(np.float32)
        drawn = np.minimum(np.searchsorted(np.cumsum(self.noise), rng.random(NOISE)), len(self.noise) - 1)
        ra, rb = self.R[a], self.R[b]
        r = ra @ self.C[0] + rb @ self.C[1]
        qw, qn = self.Q[w], self.Q[drawn]
        good = _sigmoid(np.einsum("ij,ij->i", r, qw) + self.b[w] - log_kn[w])
        bad = _sigmoid(r @ qn.T + self.b[drawn] - log_kn[drawn])
        gw, gn = (1 - good).astype(np.float32), (-bad).astype(np.float32)  # ascent directions
        gr = gw[:, None] * qw + gn @ qn
        self._step("C0", self.C[0], ra.T @ gr / len(w), state)
        self._step("C1", self.C[1], rb.T @ gr / len(w), state)
        n = len(self.b)
        gR = _summed(a, gr @ self.C[0].T, n) + _summed(b, gr @ self.C[1].T, n)
        gQ = _summed(w, gw[:, None] * r, n) + _summed(drawn, gn.T @ r, n)
        gb = np.bincount(w, weights=gw, minlength=n) + np.bincount(drawn, weights=gn.sum(axis=0), minlength=n)
        self._step("R", self.R, gR / 64, state)
        self._step("Q", self.Q, gQ / 64, state)
        self._step("b", self.b, gb.astype(np.float32) / 64, state)

    def _units(self, u: np.ndarray, h: np.ndarray, rng: np.random.Generator, state: dict[str, np.ndarray]) -> None:
        """Each unit against noise of its own class; only the vectors that take part change."""
        k = self.classes[u]
        x = (self.class_upto[k] - self.class_mass[k])[:, None] + rng.random((len(u), WORD_NOISE)) * self.class_mass[k][:, None]
        drawn = self.by_class[np.minimum(np.searchsorted(self.upto, x), len(self.upto) - 1)]
        met = np.concatenate([u[:, None], drawn], axis=1)
        r, q = self.S[h], self.U[met]
        s = np.einsum("nd,nkd->nk", r, q) + self.c[met] - (self.share[met] + np.float32(math.log(WORD_NOISE)))
        g = -_sigmoid(s).astype(np.float32)
        g[:, 0] += 1
        self._step("S", self.S, _summed(h, np.einsum("nk,nkd->nd", g, q), len(self.S)) / 64, state)
        flat = met.ravel()
        sort = np.argsort(flat, kind="stable")
        where, first = np.unique(flat[sort], return_index=True)
        rows = (g[:, :, None] * r[:, None, :]).reshape(-1, DIM)[sort]
        self._step_at("U", self.U, where, np.add.reduceat(rows, first, axis=0) / 4, state)
        self._step_at("c", self.c, where, np.add.reduceat(g.ravel()[sort], first) / 4, state)

    def _step(self, name: str, x: np.ndarray, g: np.ndarray, state: dict[str, np.ndarray]) -> None:
        """Adagrad."""
        if name not in state:
            state[name] = np.full(x.shape, 0.1, dtype=np.float32)
        seen = state[name]
        seen += g * g
        x += RATE * g / np.sqrt(seen)

    def _step_at(self, name: str, x: np.ndarray, at: np.ndarray, g: np.ndarray, state: dict[str, np.ndarray]) -> None:
        if name not in state:
            state[name] = np.full(x.shape, 0.1, dtype=np.float32)
        seen = state[name]
        new = seen[at] + g * g
        seen[at] = new
        x[at] += RATE * g / np.sqrt(new)

    def normalisers(self) -> np.ndarray:
        """Natural log of the sum over all symbols but the beginning, for every context (h1, h2)."""
        far, near = self.R @ self.C[0], self.R @ self.C[1]
        q, b = self.Q[1:], self.b[1:]
        out = np.empty((len(far), len(near)), dtype=np.float32)
        for i in range(len(far)):
            out[i] = _log_sums((far[i] + near) @ q.T + b)
        return out

    def unit_normalisers(self) -> np.ndarray:
        """The same over the units of each class, for every symbol before: symbols x symbols, 0 where there are no units."""
        out = np.zeros((len(self.S), len(self.S)), dtype=np.float32)
        for k in np.unique(self.classes):
            own = np.flatnonzero(self.classes == k)
            for at in range(0, len(self.S), 64):
                out[at : at + 64, k] = _log_sums(self.S[at : at + 64] @ self.U[own].T + self.c[own])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.maximum(x, -30)
    np.negative(out, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def _log_sums(s: np.ndarray) -> np.ndarray:
    top = s.max(axis=1)
    return top + np.log(np.exp(s - top[:, None]).sum(axis=1))


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by place: sorted and summed run by run."""
    order = np.argsort(at, kind="stable")
    where, first = np.unique(at[order], return_index=True)
    out = np.zeros((n, rows.shape[1]), dtype=np.float32)
    out[where] = np.add.reduceat(rows[order], first, axis=0)
    return out


def contexts(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two symbols before each; the beginning before a text's first."""
    h2 = np.concatenate([[BEGIN_ID], ids[:-1]])
    h1 = np.concatenate([[BEGIN_ID, BEGIN_ID], ids[:-2]])[: len(ids)]
    h2[starts] = BEGIN_ID
    h1[starts] = BEGIN_ID
    second = starts + 1
    h1[second[second < len(ids)]] = BEGIN_ID
    return h1, h2


@dataclass
class Scorer:
    vocabulary: Vocabulary
    model: LogBilinear
    logZ: np.ndarray
    unit_logZ: np.ndarray
    far: np.ndarray
    near: np.ndarray
    beyond: np.ndarray  # a symbol: -log10(counts of its tail + number of these words + 1)

    @staticmethod
    def of(model: LogBilinear, vocabulary: Vocabulary) -> Scorer:
        beyond = -np.log10(vocabulary.tail_count + vocabulary.tail_words + 1.0)
        return Scorer(vocabulary, model, model.normalisers(), model.unit_normalisers(), model.R @ model.C[0], model.R @ model.C[1], beyond)

    def token_log10(self, ids: np.ndarray, units: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol and unit of one text given the symbols before."""
        m, out = self.model, np.empty(len(ids))
        h1, h2 = contexts(ids, np.zeros(1, dtype=np.int64))
        for at in range(0, len(ids), 1 << 14):
            s = slice(at, at + (1 << 14))
            r = self.far[h1[s]] + self.near[h2[s]]
            part = np.einsum("ij,ij->i", r, m.Q[ids[s]]) + m.b[ids[s]] - self.logZ[h1[s], h2[s]]
            own = np.flatnonzero(units[s] >= 0)
            h, u = h2[s][own], units[s][own]
            part[own] += np.einsum("ij,ij->i", m.S[h], m.U[u]) + m.c[u] - self.unit_logZ[h, ids[s][own]]
            out[s] = part / math.log(10)
        return out

    def parts(self, at: np.ndarray) -> tuple[int, int, float, float]:
        """Of a text's numbers: tokens, known ones, base and model sums but for the counts of words beyond the head."""
        v = self.vocabulary
        ids, units = v.streams(at)
        head, ends = at[at >= 0], v.frequency[END_ID]
        base = float(np.log10(v.counts[head] + 1.0).sum()) + math.log10(ends + 1.0) - len(ids) * math.log10(v.total + v.distinct + 1.0)
        model = float(self.token_log10(ids, units).sum() + self.beyond[-1 - at[at < 0]].sum())
        return len(ids), len(head) + int(ends > 0), base, model


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts, the end included under END."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        ends = 0
        for pdf in batches:
            for text in pdf["text"]:
                seen.update(tokens(text))
                ends += 1
                if len(seen) > FLUSH:
                    yield from _slices(seen)
                    seen = Counter()
        yield from _slices(seen)
        if ends:
            yield pd.DataFrame({"word": [END], "c": [ends]})

    return texts.mapInPandas(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _slices(seen: Counter[bytes]) -> Iterator[pd.DataFrame]:
    words, counts = list(seen.keys()), list(seen.values())
    for at in range(0, len(words), 100_000):
        yield pd.DataFrame({"word": [w.decode("utf-8", "replace") for w in words[at : at + 100_000]], "c": counts[at : at + 100_000]})


def head_floor(counts: DataFrame, most: int) -> int:
    """The least power of two that no more than ``most`` words reach."""
    levels = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("level")).count().orderBy(F.desc("level")).collect()
    total, floor = 0, 1 << 62
    for r in levels:
        total += r["count"]
        if total > most:
            break
        floor = 1 << r["level"]
    return floor


def build_vocabulary(counts: DataFrame, scratch: Scratch, *, words: int = WORDS, endings: int = ENDINGS, head: int = HEAD) -> tuple[Vocabulary, int]:
    """Vocabulary from the full counts, and the count from which a word is in the head."""
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    floor = head_floor(counts, head)
    top = sorted(((r["c"], r["word"]) for r in counts.where((F.col("c") >= floor) & (F.col("word") != END)).collect()), key=lambda x: (-x[0], x[1]))
    own = [w for _, w in top[:words]]
    others = counts.where((F.col("word") != END) & ~F.col("word").isin(own)) if own else counts.where(F.col("word") != END)
    low = F.col("c") < floor
    by_ending = others.groupBy(F.substring("word", -ENDING, ENDING).alias("e")).agg(
        F.sum("c").alias("c"), F.coalesce(F.sum(F.when(low, F.col("c"))), F.lit(0)).alias("tail_c"), F.count(F.when(low, 1)).alias("tail_v")
    )
    by_ending = scratch.keep(by_ending, "endings")
    common = by_ending.orderBy(F.desc("c"), "e").limit(endings).collect()
    sums = by_ending.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("c", "tail_c", "tail_v")]).first()
    first_class = 2 + len(own)
    named = {r["e"]: first_class + k for k, r in enumerate(common)}
    rest = first_class + len(common)
    ends = counts.where(F.col("word") == END).select("c").first()
    frequency, tail_count, tail_words = (np.zeros(rest + 1) for _ in range(3))
    frequency[END_ID] = ends["c"] if ends else 0
    frequency[2:first_class] = [c for c, _ in top[:words]]
    for array, k in ((frequency, "c"), (tail_count, "tail_c"), (tail_words, "tail_v")):
        array[first_class:rest] = [r[k] for r in common]
        array[rest] = sums[k] - sum(r[k] for r in common)
    place = {w.encode(): k for k, (_, w) in enumerate(top)}
    symbols = np.array([2 + k if k < len(own) else named.get(w[-ENDING:], rest) for k, (_, w) in enumerate(top)], dtype=np.int32)
    c = np.array([c for c, _ in top], dtype=np.float64)
    return Vocabulary(total["n"] or 0, total["v"] or 0, place, c, symbols, named, rest, first_class, frequency, tail_count, tail_words), floor


def encoded(rows: DataFrame, shared) -> DataFrame:
    """(doc_id, uid, learn, h, ids, beyond) of each row (doc_id, learn, h, text): its words' numbers, and those beyond the head."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, row, v = TaskContext.get().partitionId(), 0, shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                own = pdf.iloc[at : at + 512]
                found = [v.numbers(t) for t in own["text"]]
                yield pd.DataFrame({
                    "doc_id": own["doc_id"].to_numpy(),
                    "uid": (part << 36) + row + np.arange(len(own), dtype=np.int64),
                    "learn": own["learn"].to_numpy(),
                    "h": own["h"].to_numpy(),
                    "ids": [x.astype("<i4").tobytes() for x, _ in found],
                    "beyond": [[w.decode("utf-8", "replace") for w in words] for _, words in found],
                })
                row += len(own)
        give_back()

    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, uid long, learn boolean, h long, ids binary, beyond array<string>")


def train_model(texts: DataFrame, vocabulary: Vocabulary, scratch: Scratch, *, group_tokens: int = GROUP_TOKENS) -> LogBilinear:
    """From encoded training rows (h, ids): a warm start on those of least hash, then one pass over all groups, averaged.

    Rows of equal hash are equal in id and text, so their order does not matter.
    """
    spark = texts.sparkSession
    fresh = lambda v: LogBilinear(v.frequency, v.unit_classes(), v.unit_mass())
    shared = spark.sparkContext.broadcast(_without_words(vocabulary))
    groups = max(1, min(MOST_GROUPS, -(-vocabulary.total // group_tokens)))

    def runner(start: bytes):
        begun = spark.sparkContext.broadcast(start)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            v, group, held = shared.value, None, None
            for pdf in batches:
                for own, ids in zip(pdf["group"], pdf["ids"], strict=True):
                    if own != group:
                        if held:
                            yield held.row(group)
                        group, held = own, _Pass(fresh(v).load(begun.value), v)
                    held.add(np.frombuffer(ids, dtype="<i4"))
            if held:
                yield held.row(group)
            del held
            give_back()

        return run

    fields = "weight double, model binary, part int"
    start = fresh(vocabulary).packed()
    warm = texts.orderBy("h").limit(WARM_TEXTS).select(F.lit(0).alias("group"), "h", "ids").repartition(1).sortWithinPartitions("h")
    found = scratch.keep(warm.mapInPandas(runner(start), fields), "warm").first()
    if not found:
        return fresh(vocabulary)
    start = bytes(found["model"])
    dealt = texts.select(F.pmod(F.xxhash64("h"), F.lit(groups)).cast("int").alias("group"), "h", "ids").repartitionById(groups, F.col("group")).sortWithinPartitions("group", "h")
    models, parts = scratch.keep(dealt.mapInPandas(runner(start), fields), "models"), groups
    while parts > 1:
        parts = -(-parts // FAN_IN)
        # Rows of a group are at most FAN_IN parameter sets of bounded size.
        models = models.groupBy((F.col("part") % parts).cast("int").alias("part")).applyInPandas(_mean, fields)
        models = scratch.keep(models, "models")
    return fresh(vocabulary).load(bytes(models.first()["model"]))


def _without_words(v: Vocabulary) -> Vocabulary:
    return Vocabulary(**{**v.__dict__, "head": {}})


class _Pass:
    """A training pass over the rows of one group, in the order they come."""

    def __init__(self, model: LogBilinear, vocabulary: Vocabulary):
        self.model, self._v, self._state, self._rng = model, vocabulary, {}, np.random.default_rng(11)
        self._held: list[tuple[np.ndarray, np.ndarray]] = []
        self._size, self.seen = 0, 0

    def add(self, at: np.ndarray) -> None:
        self._held.append(self._v.streams(at))
        self._size += len(at) + 1
        if self._size >= 32 * BATCH:
            self._flush()

    def _flush(self) -> None:
        if self._held:
            sizes = np.array([len(x) for x, _ in self._held])
            ids, units = (np.concatenate([x[k] for x in self._held]) for k in (0, 1))
            self.model.train(ids, units, np.concatenate([[0], np.cumsum(sizes)[:-1]]), self._rng, self._state)
            self.seen += len(ids)
        self._held, self._size = [], 0

    def row(self, part: int) -> pd.DataFrame:
        self._flush()
        return pd.DataFrame({"weight": [float(self.seen)], "model": [self.model.packed()], "part": [part]})


def _mean(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Mean of parameter sets by weight, added up in an order that does not depend on that of the rows."""
    pdf = pdf.sort_values("part")
    total, whole = None, float(pdf["weight"].sum())
    for weight, model in zip(pdf["weight"], pdf["model"], strict=True):
        x = np.frombuffer(model, dtype="<f4") * np.float64(weight / whole)
        if total is None:
            total = x
        else:
            total += x
    found = pd.DataFrame({"weight": [whole], "model": [total.astype("<f4").tobytes()], "part": [key[0]]})
    del pdf, total
    give_back()
    return found


def score_texts(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs, learning from those where ``learn``.

    Null texts count as empty: their one token is the end. Texts of any length are scored whole. Repeated rows score
    alike; a null id is an id like any other; an empty training set gives scores of an untrained model and base scores of
    0; an empty table gives an empty table; other columns are not read, whatever their names. The same rows give the same
    scores, however they are partitioned (but for the last digits, which the order of sums may change).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    with Scratch(spark, "lm") as scratch:
        counts = scratch.keep(word_counts(rows.where("learn").select("text")), "counts")
        vocabulary, floor = build_vocabulary(counts, scratch)
        shared = spark.sparkContext.broadcast(vocabulary)
        texts = scratch.keep(encoded(rows.withColumn("h", F.xxhash64("doc_id", "text")), shared), "encoded")
        model = train_model(texts.where("learn"), vocabulary, scratch)
        return scratch.result(_scores(texts, Scorer.of(model, _without_words(vocabulary)), counts, floor))


def _scores(texts: DataFrame, scorer: Scorer, counts: DataFrame, floor: int) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [shared.value.parts(np.frombuffer(x, dtype="<i4")) for x in pdf["ids"]]
            frame = pd.DataFrame(found, columns=["n_tokens", "n_known", "base", "model"])
            frame.insert(0, "uid", pdf["uid"].to_numpy())
            frame.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield frame
        give_back()

    scored = texts.select("doc_id", "uid", "ids").mapInPandas(run, f"doc_id {dict(texts.dtypes)['doc_id']}, uid long, n_tokens long, n_known long, base double, model double")
    tail = counts.where((F.col("c") < floor) & (F.col("word") != END))
    sums = (
        texts.select("uid", F.explode("beyond").alias("word"))
        .join(tail, "word")
        .groupBy("uid")
        .agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count(F.lit(1)).alias("known"))
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(sums, "uid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(scorer.vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def score_held_out(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Learn from the rows outside one fold of crc32(doc_id), then score all rows."""
    scored = score_texts(docs, crc_mod("doc_id", folds) != held)
    return scored.select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
