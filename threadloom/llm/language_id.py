"""Language identification by string kernels.

A text is the set of its character n-grams of 1 to 4 lower-case code points (a blended spectrum, presence only), hashed to
``DIM`` places. The kernel of two texts is the cosine of their sets. Landmark texts give Nystroem features, on which one
ridge regression per language is fitted against all others. A presence kernel is linear in the presence vector, so the
landmarks and coefficients fold exactly into one DIM x languages matrix and a batch of texts is scored by one product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import crc_mod

DIM_BITS = 15
DIM = 1 << DIM_BITS
MAX_N = 4
#: Bounds of the training sample: different texts a language, and in all (with many languages each has fewer); landmarks.
SAMPLE_PER_LANGUAGE = 200
SAMPLE = 40_000
LANDMARKS = 320
RIDGE = 1e-3
BATCH = 64
UNKNOWN = "und"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def places(text: str) -> np.ndarray:
    """Hashed places of all n-grams of the whole text, with repeats."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    found, g = [], np.zeros(len(c) + 1, dtype=np.uint64)
    for n in range(1, MAX_N + 1):
        if len(c) < n:
            break
        g = (g[:-1] + np.uint64(n)) * _STEP + c[n - 1 :]
        found.append(((g ^ (g >> np.uint64(29))) * _ODD) >> np.uint64(64 - DIM_BITS))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def has_letters(text: str | None) -> bool:
    """Whether some character is a letter (Unicode's L, as in training); figures such as ² or ½ are none."""
    return any(map(str.isalpha, text or ""))


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # DIM x languages, float32

    def scores(self, texts: list[str]) -> np.ndarray:
        """Regression outputs, texts x languages, by batched matrix products."""
        out = np.zeros((len(texts), len(self.languages)), dtype=np.float64)
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            present = np.zeros((len(part), DIM), dtype=np.float32)
            for i, t in enumerate(part):
                present[i, places(t)] = 1.0
            norm = np.sqrt(np.maximum(present.sum(axis=1), 1.0))
            out[at : at + BATCH] = (present @ self.weights) / norm[:, None]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        said = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if has_letters(t)] if self.languages else []
        s = self.scores([texts[i] for i in known])
        for i, row in zip(known, s, strict=True):
            k = int(np.argmax(row))
            said[i] = (self.languages[k], float(np.clip((1.0 + row[k]) / 2.0, 0.0, 1.0)))
        return said


def _unit(bits: list[bytes]) -> np.ndarray:
    """Presence vectors of unit length from packed bits."""
    x = np.unpackbits(np.frombuffer(b"".join(bits), dtype=np.uint8)).reshape(len(bits), DIM).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1.0))
    return x


def fit_kernel_ridge(bits: list[bytes], labels: list[str], ridge: float = RIDGE, landmarks: int = LANDMARKS) -> LanguageModel:
    """bits: packed presence of each text. Memory: the landmarks' vectors and one batch beside the packed bits.

    Ties between languages later go to the first by code point.
    """
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((DIM, 0), dtype=np.float32))
    y = np.array([languages.index(x) for x in labels])
    each = max(1, landmarks // len(languages))
    marks = _unit([bits[i] for k in range(len(languages)) for i in np.flatnonzero(y == k)[:each]])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # K_mm to the power -1/2 on its range
    features = np.concatenate([(_unit(bits[at : at + BATCH]) @ marks.T).astype(np.float64) @ root for at in range(0, len(bits), BATCH)])
    targets = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    w = np.linalg.solve(features.T @ features + ridge * len(y) * np.eye(features.shape[1]), features.T @ targets)
    return LanguageModel(languages, np.ascontiguousarray(marks.T @ (root @ w).astype(np.float32), dtype=np.float32))


def _training_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        bits = []
        for t in pdf["text"]:
            row = np.zeros(DIM, dtype=bool)
            row[places(t)] = True
            bits.append(np.packbits(row).tobytes())
        yield pd.DataFrame({"h": pdf["h"], "lang": pdf["lang"], "bits": bits})


def train(labelled: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, sample: int = SAMPLE) -> LanguageModel:
    """Fit on a bounded sample of (text, lang): of each language the different texts of least hash, whole, as presence bits.

    Every language that labels a text with letters can be predicted, however rare. A text repeated in a language counts
    once; one that several languages claim counts in each.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang", F.xxhash64("text").alias("h")).where(F.regexp_like("text", F.lit(r"\p{L}")))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row a language
    if not counts:
        return fit_kernel_ridge([], [])
    most = max(1, min(sample_per_language, sample // len(counts)))
    span = float(2**63)
    edges = [(r["lang"], float(min(1.0, (1.5 * most + 30) / r["n"]) * 2 * span - span)) for r in counts]
    near = rows.join(F.broadcast(rows.sparkSession.createDataFrame(edges, "lang string, edge double")), "lang").where(F.col("h").cast("double") <= F.col("edge"))
    once = near.dropDuplicates(["lang", "h"]).withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= most)
    bits = once.select("h", "lang", "text").mapInPandas(_training_bits, "h long, lang string, bits binary").collect()
    taken = sorted(bits, key=lambda r: (r["lang"], r["h"]))
    return fit_kernel_ridge([bytes(r["bits"]) for r in taken], [r["lang"] for r in taken])


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row: ``und`` and 0 where the text is null or has no letter.

    Repeated rows are scored alike; ties go to the first language by code point; a model without languages says ``und``
    throughout; an empty table gives an empty table. Only the text enters, whole; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x languages floats, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                said = shared.value.predict([t if isinstance(t, str) else None for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "lang_pred": [k for k, _ in said], "score": [v for _, v in said]})

    id_type = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {id_type}, lang_pred string, score double")


def identify_held_out(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learn from the labelled rows outside one fold of crc32(doc_id), then identify all rows."""
    model = train(docs.where(crc_mod("doc_id", folds) != held).select("text", "lang"))
    said = identify(docs, model)
    return said.select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
