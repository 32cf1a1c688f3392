"""Centroid clustering by partial-distance search, in whole numbers.

Each vector becomes integers once and is written with its components in the order of falling variance. A round reads that
table and sends back, per task and centroid, a count and the sums of the components; what the driver holds is k centroids.

The search for a vector's nearest centroid adds squared differences block by block, dimensions of high variance first. A
centroid is abandoned as soon as its partial sum is strictly above the best whole distance so far; survivors finish all
dimensions, so ties are seen and go to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import Scratch

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Components are held within +-LARGEST, so that no squared distance of two vectors leaves 63 bits.
LARGEST = 1 << 27
#: Dimensions that are added before centroids are looked at again.
BLOCK = 8


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, dimensions: int) -> DataFrame:
    """(vec_id, x): vectors of that many components, none null or not finite, as floor(SCALE * component)."""
    x = F.col(vec_col)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    part = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c.cast("double") * SCALE))).cast("int"))
    return vectors.where(x.isNotNull() & (F.size(x) == dimensions)).where(~odd).select(F.col(id_col).alias("vec_id"), part.alias("x"))


def first_centroids(whole: DataFrame, k: int) -> np.ndarray:
    """The k vectors of smallest sha256 of `3:<vec_id>`; ids that are equal, or null, go by their components."""
    name = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = whole.select(name.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in found], dtype=np.int64)


def variance_order(whole: DataFrame, dimensions: int) -> list[int]:
    """Dimensions by falling variance over all vectors."""
    spread = whole.agg(*[F.coalesce(F.var_pop(F.col("x")[i]), F.lit(0.0)).alias(f"v{i}") for i in range(dimensions)]).first()
    return sorted(range(dimensions), key=lambda i: (-spread[i], i))


def nearest(x: np.ndarray, centroids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each row; dimensions stand in the order in which they count.

    The first block alone names the centroid whose whole distance is the first best; the others are tried against it.
    """
    n, dims = x.shape
    first = ((x[:, None, :block] - centroids[None, :, :block]) ** 2).sum(axis=2)
    best_of = first.argmin(axis=1)
    best = ((x - centroids[best_of]) ** 2).sum(axis=1)
    guess = best_of.copy()
    for c in range(len(centroids)):
        left = np.flatnonzero((guess != c) & (first[:, c] <= best))
        part = first[left, c]
        for at in range(block, dims, block):
            if not len(left):
                break
            part = part + ((x[left, at : at + block] - centroids[c, at : at + block]) ** 2).sum(axis=1)
            stays = part <= best[left]
            left, part = left[stays], part[stays]
        wins = (part < best[left]) | (c < best_of[left])
        best[left[wins]], best_of[left[wins]] = part[wins], c
    return best_of, best


def _matrix(column: Iterable[bytes], dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<i4").reshape(-1, dimensions).astype(np.int64)


def _round(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: exact floors of the means of their vectors; those without vectors stay."""
    k, dims = centroids.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for pdf in batches:
            x = _matrix(pdf["x"], dims)
            of, _ = nearest(x, centroids)
            counts += np.bincount(of, minlength=k)
            for c in range(k):
                sums[c] += x[of == c].sum(axis=0)
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"cluster": seen.astype(np.int32), "sums": pd.Series([np.append(sums[c], counts[c]) for c in seen], dtype=object)})  # the count stands last

    parts = table.select("x").mapInPandas(run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "part"))
    totals = np.zeros((k, dims + 1), dtype=object)
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect():  # k x (dims + 1) rows
        totals[r["cluster"], r["at"]] = int(r["s"])
    out = centroids.copy()
    for c in np.flatnonzero(totals[:, -1]):
        out[c] = totals[c, :-1] // totals[c, -1]
    return out


def cluster_vectors(
    vectors: DataFrame, *, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Per vector vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length, or have a component that is null, NaN or infinite give no row. Components
    beyond +-LARGEST / SCALE count as that bound, and an inertia beyond 63 bits as the largest long. A null id gives a
    null id. Repeated rows and equal ids each count; with fewer vectors than k there are as many centroids; of equal
    centroids the smaller number has the vectors. An empty table gives an empty table; other columns are not read.
    """
    spark = vectors.sparkSession
    with Scratch(spark, "centroids") as scratch:
        own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("x"))
        whole = scratch.keep(whole_vectors(own, "vec_id", "x", dimensions), "whole")
        order = variance_order(whole, dimensions)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(-1, dimensions)[:, order]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in x], pa.binary())], ["vec_id", "x"])

        id_type = dict(whole.dtypes)["vec_id"]
        centroids = first_centroids(whole, k)
        table = scratch.keep(whole.mapInArrow(pack, f"vec_id {id_type}, x binary"), "packed")
        if not len(centroids):
            centroids = np.zeros((1, dimensions), dtype=np.int64)
        centroids = centroids[:, order]
        for _ in range(rounds):
            after = _round(table, centroids)
            if (after == centroids).all():  # all further rounds give the same
                break
            centroids = after

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of, distance = nearest(_matrix(batch.column(1).to_pylist(), dimensions), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

        placed = scratch.result(table.mapInArrow(assign, f"vec_id {id_type}, cluster int, distance long"))
    sums = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    back = np.argsort(order)
    most, total = (1 << 63) - 1, sum(sums.values())
    rows = [(c, min(d, most), min(total, most), hashlib.sha256(",".join(map(str, centroids[c][back].tolist())).encode()).hexdigest()) for c, d in sums.items()]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of the same rows: every distance in full, a pair of tables a round."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, x, row_number() OVER () AS r FROM (SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings"
        f" WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMENSIONS}))",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v.x AS x, min(({distance}, c.k)) AS m FROM v, c{i} c GROUP BY r, vec_id, v.x)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT m[2] AS k, u.d AS d, sum(u.e)::HUGEINT AS s, count(*) AS n FROM a{i}, unnest(list_zip(x, range(1, {DIMENSIONS + 1}))) t(z), LATERAL (SELECT z[1] AS e, z[2] AS d) u GROUP BY m[2], u.d)")
            steps.append(
                f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY d) AS x FROM s{i} GROUP BY k) n ON n.k = c.k)"
            )
    last = rounds
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, m[2]::INT AS cluster, m[1] AS distance, sum(m[1]) OVER (PARTITION BY m[2])::BIGINT AS cluster_inertia,"
        f" sum(m[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{last} a JOIN c{last} c ON c.k = a.m[2]"
    )
