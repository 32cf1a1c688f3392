"""Toxicity: gradient-boosted trees over dense text features, isotonic calibration.

Features are lexicon densities, nearness to second-person words, capitals, punctuation and obfuscation rates. The lexicon
holds given insults and the words and word stems that a bounded labelled sample shows to be marks of the toxic label.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import Scratch, crc_mod, give_back

#: Bounds of the labelled sample that the classifier is fitted on.
SAMPLE_TOXIC = 3_000
SAMPLE_CLEAN = 6_000
LEXICON_SIZE = 400
#: Partitions of the sample.
SAMPLE_PARTS = 32
#: Parts of the sample that calibration predicts in turn, by a lexicon and trees of the others.
FOLDS = 4
STEMS = (4, 5, 6)
THRESHOLD = 0.7
NEAR = 6  # words

GIVEN = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumbass", "bastard", "asshole", "jerk")
SECOND_PERSON = ("you", "your", "yours", "you're", "youre", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "te", "vous", "votre", "ton", "tú", "ti", "usted", "ustedes", "vosotros", "vuestro")
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

HIT, YOU, CAPS, OBFUSCATED, HIDDEN_HIT, STRETCHED = 1, 2, 4, 8, 16, 32
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_NON_LETTER = re.compile(r"[\W\d_]+")
_MIXED = re.compile(r"[^\W\d_][\d*@$!#_.\-]+[^\W\d_]")
_STRETCH = re.compile(r"([^\W\d_])\1\1")


def _stems(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class Tokens(dict):
    """Flags of a token as it stands between white space, worked out once: eight bits for each of some lexicons."""

    def __init__(self, *lexicons: frozenset[str]):
        self.lexicons, self.second = lexicons, frozenset(SECOND_PERSON)

    def __missing__(self, token: str) -> int:
        core = _EDGE.sub("", token)
        word, flags = core.lower(), 0
        plain: list[str] = []
        hidden: list[str] = []
        if word:
            plain = _stems(word)
            if word in self.second:
                flags |= YOU
            if len(core) > 2 and core.isupper():
                flags |= CAPS
            if _STRETCH.search(word):
                flags |= STRETCHED
            if _MIXED.search(token):
                flags |= OBFUSCATED
                hidden = _stems(_NON_LETTER.sub("", token.lower().translate(LEET))) + _stems(_NON_LETTER.sub("", word))
        packed = 0
        for k, lexicon in enumerate(self.lexicons):
            own = flags
            if not lexicon.isdisjoint(plain):
                own |= HIT
            elif hidden and not lexicon.isdisjoint(hidden):
                own |= HIDDEN_HIT
            packed |= own << (8 * k)
        if len(self) > 100_000:
            self.clear()
        self[token] = packed
        return packed


FEATURES = ("hit_density", "hits", "hidden_density", "hidden", "near_you", "near_you_rate", "you_density", "capitals", "caps_words", "shouting", "punctuation", "obfuscation", "stretched", "log_words")
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def features(text: str, tokens: Tokens) -> list[list[float]]:
    """Dense features of the whole text, for each lexicon; zeros for the empty one."""
    words = text.split()
    if not words:
        return [[0.0] * len(FEATURES) for _ in tokens.lexicons]
    packed = np.fromiter(map(tokens.__getitem__, words), dtype=np.int64, count=len(words))
    n = len(words)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    letters = max(1, upper + int(((raw >= 97) & (raw <= 122)).sum()))
    you = np.flatnonzero(packed & YOU)
    share = lambda flag: np.count_nonzero(packed & flag) / n
    common = [len(you) / n, upper / letters, share(CAPS), text.count("!") / n, float(_PUNCTUATION[raw].mean()), share(OBFUSCATED), share(STRETCHED), np.log1p(n)]
    found = []
    for k in range(len(tokens.lexicons)):
        flags = packed >> (8 * k)
        hit = np.flatnonzero(flags & (HIT | HIDDEN_HIT))
        near = 0
        if len(hit) and len(you):
            right = np.searchsorted(you, hit)
            gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - hit), np.abs(you[np.maximum(right - 1, 0)] - hit))
            near = int((gap <= NEAR).sum())
        hidden = int(np.count_nonzero(flags[hit] & HIDDEN_HIT))
        hits = len(hit) - hidden
        found.append([hits / n, np.log1p(hits), hidden / n, np.log1p(hidden), np.log1p(near), near / max(1, len(hit)), *common])
    return found


def feature_rows(texts: list[str | None], tokens: Tokens) -> np.ndarray:
    """texts x lexicons x features."""
    rows = [features(t if isinstance(t, str) else "", tokens) for t in texts]
    return np.array(rows, dtype=np.float64).reshape(-1, len(tokens.lexicons), len(FEATURES))


@dataclass
class Trees:
    """Boosted regression trees on binned features for the logistic loss: ``rounds`` trees of ``depth`` levels each."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    penalty: float = 1.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        p = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
        self.base, self.grown = float(np.log(p / (1 - p))), []
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._tree(b, weight * (y - p), weight * p * (1 - p))
            self.grown.append(tree)
            f += self._walk(tree, b)
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature and bin of each inner node in heap order (feature -1: none), value of each node."""
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, dtype=int), np.zeros(nodes)
        at = np.zeros(len(g), dtype=int)
        for node in range(nodes):
            own = np.flatnonzero(at == node)
            if not len(own):
                continue
            gs, hs = g[own].sum(), h[own].sum()
            value[node] = self.rate * gs / (hs + self.penalty)
            if node >= 2**self.depth - 1:
                continue
            best = 1e-6
            for j in range(b.shape[1]):
                gl = np.cumsum(np.bincount(b[own, j], weights=g[own], minlength=self.bins + 1))[:-1]
                hl = np.cumsum(np.bincount(b[own, j], weights=h[own], minlength=self.bins + 1))[:-1]
                gain = gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - gs**2 / (hs + self.penalty)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, feature[node], cut[node] = gain[k], j, k
            if feature[node] >= 0:
                at[own] = 2 * node + 1 + (b[own, feature[node]] > cut[node])
        return feature, cut, value

    def _walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(b), dtype=int), np.arange(len(b))
        for _ in range(self.depth):
            split = feature[at] >= 0
            at = np.where(split, 2 * at + 1 + (b[rows, np.maximum(feature[at], 0)] > cut[at]), at)
        return value[at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        f = self.base + sum((self._walk(t, b) for t in self.grown), np.zeros(len(x)))
        return 1 / (1 + np.exp(-f))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points (x, level) of the best rising fit, equal x pooled first."""
    xs, inverse = np.unique(x, return_inverse=True)
    w = np.bincount(inverse, weights=weight)
    v = np.bincount(inverse, weights=weight * y) / np.maximum(w, 1e-12)
    blocks: list[list[float]] = []  # level, weight, first x, last x
    for xi, vi, wi in zip(xs, v, w, strict=True):
        blocks.append([vi, wi, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            last = blocks.pop()
            own = blocks[-1]
            own[0], own[1], own[3] = (own[0] * own[1] + last[0] * last[1]) / (own[1] + last[1]), own[1] + last[1], last[3]
    return np.array([e for b in blocks for e in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in (0, 1)])


@dataclass
class ToxicityModel:
    lexicon: frozenset[str]
    trees: Trees
    levels: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[str | None], tokens: Tokens | None = None) -> np.ndarray:
        raw = self.trees.probability(feature_rows(texts, tokens if tokens is not None else Tokens(self.lexicon))[:, 0])
        # The calibrated level, with a thousandth of the raw probability to order rows of one level.
        return np.clip(0.999 * np.interp(raw, *self.levels) + 0.001 * raw, 0.0, 1.0)


def fit(features: np.ndarray, labels: np.ndarray, weight: np.ndarray, fold: np.ndarray, lexicon: frozenset[str]) -> ToxicityModel:
    """Trees on all rows; calibration on predictions by a lexicon and trees that did not see the row.

    features: sets of features x rows x features; the first by the whole lexicon, the k-th by that of the rows outside fold k.
    """
    y = labels.astype(float)
    out = np.zeros(len(y))
    for k in range(1, len(features)):
        own, seen = fold == k, fold != k
        if own.any():
            out[own] = Trees().fit(features[k][seen], y[seen], weight[seen]).probability(features[k][own]) if seen.any() else y.mean()
    return ToxicityModel(lexicon, Trees().fit(features[0], y, weight), isotonic(out, y, weight))


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task and fold: word or stem, texts with it by label, and which of 63 classes of preceding words toxic texts show."""
    counts: dict[tuple[int, int], Counter] = defaultdict(Counter)
    before: dict[tuple[int, str], int] = defaultdict(int)
    for pdf in batches:
        for text, toxic, fold in zip(pdf["text"], pdf["toxic"], pdf["fold"], strict=True):
            words = [w for w in (_EDGE.sub("", t) for t in text.lower().split()) if w and w.isalpha()]
            terms = set()
            last = ""
            for w in words:
                own = _stems(w)
                terms.update(own)
                if toxic:
                    bit = 1 << (sum(last.encode()) % 63)
                    for s in own:
                        before[fold, s] |= bit
                last = w
            counts[fold, int(toxic)].update(terms)
    for fold in {k for k, _ in list(counts)}:
        terms = list(counts[fold, 0].keys() | counts[fold, 1].keys())
        if not terms:  # texts without words
            continue
        yield pd.DataFrame({"term": terms, "fold": fold, "toxic": [counts[fold, 1][t] for t in terms], "clean": [counts[fold, 0][t] for t in terms], "before": [before.get((fold, t), 0) for t in terms]})


def learn_lexicons(sample: DataFrame, scratch: Scratch) -> list[frozenset[str]]:
    """Terms of a (text, toxic, fold) sample that mark the toxic label: of the whole sample, then of it without each fold.

    In toxic texts at least 20 times as common as in clean ones, in half a percent of them, and after many different words,
    which tells a term that recurs by itself from one that copies of a single text repeat.
    """
    totals = {(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    counted = sample.select("text", "toxic", "fold").mapInPandas(_term_counts, "term string, fold int, toxic long, clean long, before long")
    by_fold = [
        column
        for k in range(1, FOLDS + 1)
        for column in (
            F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("toxic"))), F.lit(0)).alias(f"toxic{k}"),
            F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("clean"))), F.lit(0)).alias(f"clean{k}"),
            F.coalesce(F.bit_or(F.when(F.col("fold") == k, F.col("before"))), F.lit(0)).alias(f"before{k}"),
        )
    ]
    terms = scratch.keep(counted.groupBy("term").agg(*by_fold).where(" + ".join(f"toxic{k}" for k in range(1, FOLDS + 1)) + " >= 4"), "terms")
    found = []
    for left_out in range(FOLDS + 1):
        others = [k for k in range(1, FOLDS + 1) if k != left_out]
        n1, n0 = (sum(totals.get((k, label), 0) for k in others) for label in (1, 0))
        toxic, clean = (reduce(lambda a, b: a + b, [F.col(f"{name}{k}") for k in others]) for name in ("toxic", "clean"))
        before = reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"before{k}") for k in others])
        own = (
            terms.select("term", toxic.alias("toxic"), clean.alias("clean"), before.alias("before"))
            .withColumn("odds", F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0)))
            .where((F.col("toxic") >= max(4, 0.005 * n1)) & (F.col("odds") > float(np.log(20))) & (F.bit_count("before") >= F.least(F.lit(10), F.col("toxic") * 0.6)))
            .orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "term")
            .limit(LEXICON_SIZE)
        )
        found.append(frozenset(GIVEN) | {r["term"] for r in own.collect()})
    return found


def train(docs: DataFrame, labels: DataFrame, *, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> ToxicityModel | None:
    """Fit on a bounded sample of ``labels`` (doc_id, toxic), by least hash in each class; None without both classes.

    Rows of unknown label are left out, an id labelled twice counts as toxic if once so marked, one with several texts has
    that of least hash, and the sample's ids are few enough by construction to be broadcast.
    """
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    share = {k: min(1.0, n / counts[k]) for k, n in ((0, sample_clean), (1, sample_toxic))}
    picked = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.when(F.col("toxic") == 1, share[1] * (1 << 30)).otherwise(share[0] * (1 << 30)))
    dealt = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))  # of the bounded sample
    with Scratch(docs.sparkSession, "toxicity") as scratch:
        one = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
        # Dealt within each label; in small parts, as long texts would else make one task long.
        sample = scratch.keep(one.withColumn("fold", (F.pmod(dealt, F.lit(FOLDS)) + 1).cast("int")).repartition(SAMPLE_PARTS), "sample")
        lexicons = learn_lexicons(sample, scratch)
        shared = docs.sparkSession.sparkContext.broadcast(lexicons)

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tokens = Tokens(*shared.value)
            for pdf in batches:
                x = feature_rows(list(pdf["text"]), tokens).reshape(len(pdf), -1)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "toxic": pdf["toxic"].to_numpy(), "fold": pdf["fold"].to_numpy(), "x": list(x)})

        found = sample.mapInPandas(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int, fold int, x array<double>").toPandas().sort_values("doc_id")
    y = found["toxic"].to_numpy()
    if len(set(y)) < 2:
        return None
    weight = np.where(y == 1, 1.0 / share[1], 1.0 / share[0])
    x = np.array(found["x"].tolist()).reshape(len(y), len(lexicons), len(FEATURES)).swapaxes(0, 1)
    return fit(x, y, weight / weight.mean(), found["fold"].to_numpy(), lexicons[0])


def score(docs: DataFrame, model: ToxicityModel | None, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row, from the whole text alone.

    A null text counts as empty, an empty one has zero features and the score these get; without a model (no labels of
    both kinds) scores are 0. Repeated rows score alike; an empty table gives an empty table; other columns aren't read.
    """
    id_type = dict(docs.dtypes)[id_col]
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .mapInPandas(_scorer(docs, model, ["doc_id"]), f"doc_id {id_type}, score double")
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def _scorer(docs: DataFrame, model: ToxicityModel | None, kept: list[str], text_col: str = "text"):
    shared = docs.sparkSession.sparkContext.broadcast(model)  # trees and a lexicon of bounded size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        tokens = Tokens(model.lexicon) if model else None
        for pdf in batches:
            scores = model.score(list(pdf[text_col]), tokens) if model and len(pdf) else np.zeros(len(pdf))
            yield pd.DataFrame({**{c: pdf[c].to_numpy() for c in kept}, "score": scores})
        del tokens
        give_back()

    return run


def score_held_out(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Learn from the labels outside one fold of crc32(doc_id), then score all rows."""
    model = train(docs, labels.where(crc_mod("doc_id", folds) != held))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, model: ToxicityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns unchanged, whose score stays below the threshold.

    A null text counts as empty; very long ones are scored whole; rows of equal text stay or go together; without a model
    all stay; an empty table gives an empty table; no column name can clash, as a row's own columns travel as one.
    """
    columns = docs.columns
    place = F.struct(*[docs[c] for c in columns])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        tokens = Tokens(model.lexicon) if model else None
        for texts in batches:
            yield pd.Series(model.score(list(texts), tokens) if model and len(texts) else np.zeros(len(texts)))
        del tokens
        give_back()

    return docs.select(place.alias("__doc"), scored(docs["text"]).alias("__score")).where(F.col("__score") < threshold).select("__doc.*")
