import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millcheck.llm import hamerly

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v string, distance int, upper string"


def brute(rows, k, rounds, dims, scale=256, seed=2):
    """Lloyd's rounds in Python's whole numbers."""
    kept = [(i, tuple(math.floor(scale * float(np.float32(x))) for x in e)) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        cents = [tuple(sum(col) // len(m) for col in zip(*m)) if (m := [v for (_, v), c in zip(kept, of) if c == j]) else old for j, old in enumerate(cents)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, c in found if c == j) for j in range(len(cents))}
    return sorted(((i is None, i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, d, c in found), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, "c", "v", 1, "u") for i, e in rows], SCHEMA)


def got(df):
    return sorted(((r.vec_id is None, r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_as_brute_force(spark, seed):
    r = random.Random(seed)
    mids = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.2 + 0.3 * seed) for x in r.choice(mids)]) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 480)]  # copies
    rows += [(7, rows[3][1]), (None, rows[4][1]), (None, [0.0] * 4), (500, None), (501, []), (502, [1.0] * 3), (503, [1.0, None, 0.0, 0.0]), (504, [math.nan] * 4), (505, [math.inf, 0.0, 0.0, 0.0])]
    assert got(hamerly.cluster(frame(spark, rows).repartition(5), k=9, rounds=4, dims=4)) == brute(rows, 9, 4, 4)


def test_ties_go_to_the_smaller_number(spark):
    """Points of a grid lie midway between centroids everywhere."""
    rows = [(i, [float(i % 5), float(i // 5 % 5)]) for i in range(75)]
    assert got(hamerly.cluster(frame(spark, rows), k=7, rounds=3, dims=2, scale=1)) == brute(rows, 7, 3, 2, scale=1)


def test_large_components(spark):
    rows = [(i, [float((i * 7919) % 1000 * 500), float(-i * 900)]) for i in range(120)]
    assert got(hamerly.cluster(frame(spark, rows), k=5, rounds=3, dims=2)) == brute(rows, 5, 3, 2)
    assert hamerly.cluster(frame(spark, [(1, [1e30, 0.0])]), k=2, rounds=1, dims=2).count() == 0


def test_bounds_hold_and_save_searches():
    """After every round the bounds enclose the true distances, and most vectors are settled by them."""
    r = np.random.default_rng(3)
    mids = r.integers(-400, 400, (12, 8))
    v = (mids[r.integers(0, 12, 5000)] + r.integers(-60, 60, (5000, 8))).astype(np.int64)
    now, before = v[:12].copy(), None
    cluster, upper, lower, full = np.full(5000, -1, dtype=np.int32), np.zeros(5000), np.zeros(5000), []
    for _ in range(8):
        full.append(hamerly.Centroids(now, before).assign(v, cluster, upper, lower).sum())
        d = np.sqrt(((v[:, None] - now) ** 2).sum(2))
        assert (cluster == d.argmin(1)).all() and (upper >= d.min(1)).all() and (lower <= np.partition(d, 1, axis=1)[:, 1]).all()
        before, now = now, np.array([v[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else now[j] for j in range(12)])
    assert full[0] == 5000 and full[-1] < 1000


def test_edges(spark):
    assert hamerly.cluster(frame(spark, [])).count() == 0
    one = hamerly.cluster(frame(spark, [(5, [0.5] * 64)])).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in one] == [(5, 0, 0, 0)]
    few = frame(spark, [(i, [float(i)] * 64) for i in range(3)])
    assert hamerly.cluster(few).agg(F.countDistinct("cluster")).first()[0] == 3
