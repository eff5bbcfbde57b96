"""Clustering around centroids in exact integers, with Hamerly's bounds.

A table per round holds each vector with its cluster, an upper bound of the distance to that centroid and a lower bound of
the distance to any other. Moved centroids loosen the bounds: the upper one by the drift of the vector's own centroid, the
lower one by the largest drift of the others. A vector whose upper bound is below its lower one, or below half the way from
its centroid to the next, stays without a look at its components; else its own distance is worked out, and only if that
does not settle it, all distances in whole numbers. Bounds are rounded outwards, so clusters are those of a full search.

Centroids and their sums are a few rows; vectors never leave their partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millcheck.llm.common import scratch

#: Components of a greater magnitude have squared distances beyond a long.
LIMIT = 1 << 27
#: Up to this magnitude products of vectors are exact in doubles.
EXACT = 1 << 22
#: How far bounds are rounded outwards, relative and absolute; double arithmetic errs by far less.
SLACK = 1e-9


def vectors(embeddings: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (whole numbers) of the rows that count."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LIMIT))
    # coalesce: a null inside makes the condition null
    kept = embeddings.where((F.size(vec_col) == dims) & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col(id_col).alias("vec_id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """All exact squared distances, a row per vector."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        x, c = v.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], axis=1)


def up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK) + SLACK


def down(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK) - SLACK


class Centroids:
    """Centroids of a round, how far each has moved since the round before, and half the way to its next neighbour."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None):
        self.now, k = now, len(now)
        moved = np.zeros(k) if before is None else up(np.sqrt(((now - before) ** 2).sum(1).astype(np.float64)))
        self.drift = moved
        self.others = np.array([np.delete(moved, j).max(initial=0) for j in range(k)])
        between = np.sqrt(squared(now, now).astype(np.float64))
        np.fill_diagonal(between, np.inf)
        self.half = down(between.min(axis=1) / 2) if k > 1 else np.full(k, np.inf)

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Brings cluster and bounds up to date, in place; says which vectors took a full search. Cluster -1: none yet."""
        old = cluster >= 0
        at = cluster[old]
        upper[old], lower[old] = up(upper[old] + self.drift[at]), down(lower[old] - self.others[at])
        settled = np.zeros(len(v), dtype=bool)
        settled[old] = upper[old] < np.maximum(lower[old], self.half[at])
        i = np.flatnonzero(old & ~settled)
        upper[i] = up(np.sqrt(((v[i] - self.now[cluster[i]]) ** 2).sum(1).astype(np.float64)))
        settled[i] = upper[i] < np.maximum(lower[i], self.half[cluster[i]])
        i = np.flatnonzero(~settled)
        if len(i):
            d = squared(v[i], self.now)
            cluster[i] = d.argmin(axis=1)  # of equal distances the smaller number
            upper[i] = up(np.sqrt(d.min(axis=1).astype(np.float64)))
            lower[i] = down(np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64))) if d.shape[1] > 1 else np.inf
        return ~settled


def step(state: DataFrame, now: np.ndarray, before: np.ndarray | None, last: bool) -> DataFrame:
    """The state under new centroids; with the exact squared distance if it is the last."""
    centroids = Centroids(now, before)
    dims = now.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b["v"].flatten().to_numpy().astype(np.int64).reshape(-1, dims)
            cluster, upper, lower = (b[c].to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower"))
            scans = b["scans"].to_numpy() + centroids.assign(v, cluster, upper, lower).astype(np.int32)
            out = {"vec_id": b["vec_id"], "v": b["v"], "cluster": cluster, "upper": upper, "lower": lower, "scans": scans}
            if last:
                out["distance"] = ((v - now[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_pydict(out)

    kind = state.schema["vec_id"].dataType.simpleString()
    return state.mapInArrow(run, f"vec_id {kind}, v array<int>, cluster int, upper double, lower double, scans int" + ", distance long" * last)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; a cluster without vectors keeps its centroid. A row per cluster comes to the driver."""
    dims = centroids.shape[1]
    new = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dims))).collect():
        new[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
    return new


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row per vector kept: vec_id, cluster, distance (squared), scans (full searches it took), cluster_inertia, inertia,
    centroid_sha256.

    Vectors with another number of components, or one that is null, not finite or of LIMIT and more after scaling are left
    out. Starts from the k vectors with the smallest sha256 of "seed:id" (null ids last, then by components); of fewer
    vectors all are centroids, so no vector gives an empty result. Repeated rows and ids are vectors each. Other columns are
    not looked at. An inertia beyond a long is null.
    """
    spark = embeddings.sparkSession
    rows = vectors(embeddings, dims, scale, id_col, vec_col)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    if not chosen:
        return rows.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("scans", "int"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    now, before = np.array([r.v for r in chosen], dtype=np.int64), None
    state = rows.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).alias("scans"))
    for r in range(rounds + 1):
        path = scratch(spark, f"clusters{r}")
        step(state, now, before, r == rounds).write.parquet(path)
        state = spark.read.parquet(path)
        if r < rounds:
            now, before = means(state, now), now
    exact = F.sum(F.col("distance").cast("decimal(20,0)"))
    sums = {r.cluster: int(r.s) for r in state.groupBy("cluster").agg(exact.alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    about = [(c, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for c, s in sums.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # a row per cluster, k at most
    return state.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "scans", "cluster_inertia", "inertia", "centroid_sha256")
