"""Bit planes and centroid clustering against plain integer loops."""

import hashlib
import math
import random

import numpy as np
import pytest

from supplymetrics.llm import bits, centroids, queries

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, cluster string, planes string"


def test_planes_round_trip():
    rng = random.Random(3)
    for top in (1, 40, 2**27):
        rows = np.array([[rng.randint(-top, top) for _ in range(64)] for _ in range(50)] + [[0] * 64, [-top] * 64, [top] * 64])
        planes = bits.bit_planes(rows)
        assert planes.shape[1] == top.bit_length() + 1
        back = [[sum(w * (int(p) >> d & 1) for w, p in zip(bits.plane_weights(planes.shape[1]), row)) for d in range(64)] for row in planes]
        assert back == rows.tolist()
        assert bits.planes_dot(planes, bits.bit_planes(rows[:1])[0]).tolist() == (rows @ rows[0]).tolist()
        assert centroids.sum_of_squares(planes).tolist() == (rows * rows).sum(axis=1).tolist()
        assert bits.plane_sums(planes).tolist() == rows.sum(axis=0).tolist()


def plain(vectors, k=16, rounds=3):
    kept = [(i, [max(-2**27, min(2**27, math.floor(64 * x))) for x in v]) for i, v in vectors
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    ranked = sorted(kept, key=lambda t: (t[0] is None, hashlib.sha256(f"1:{t[0]}".encode()).hexdigest()))
    cents = [list(v) for _, v in ranked[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for n in range(len(cents)):
            own = [v for (_, v), a in zip(kept, at) if a == n]
            if own:
                cents[n] = [sum(c) // len(own) for c in zip(*own)]
    found = [(i, *nearest(v)) for i, v in kept]
    spread = {n: sum(d for _, d, m in found if m == n) for _, _, n in found}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, n, d, spread[n], sum(spread.values()), sha[n]) for i, d, n in found), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "p") for i, v in rows], VECTORS)


def test_matches_plain_rounds(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    want = plain([(r.vec_id, r.embedding) for r in df.collect()])
    found = queries.op11_centroid_clustering(spark, SMALL)
    assert got(found) == want
    assert got(centroids.cluster(df.repartition(5, "embedding"))) == want


def around(rng, centre, by):
    return [x + rng.uniform(-by, by) for x in centre]


def test_edges(spark):
    rng = random.Random(11)
    base = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, around(rng, base[i % 5], .05)) for i in range(60)] + [(200, base[0]), (200, base[0]), (None, base[1]), (None, base[1])]
    rows += [(100, None), (101, []), (102, base[0][:63]), (103, base[0] + [1.0]), (104, [None] * 64), (105, [float("nan")] + base[0][1:]),
             (106, [float("inf")] * 64), (107, [0.0] * 64), (108, [-0.0] * 64), (109, [1e300] + [0.0] * 63), (110, [-1e300] + [5.5] * 63), (-3, [-1 / 64] * 64)]
    assert got(centroids.cluster(table(spark, rows))) == plain(rows)
    assert got(centroids.cluster(table(spark, []))) == []
    assert got(centroids.cluster(table(spark, rows[-12:-5]))) == []


@pytest.mark.parametrize("n", [1, 16, 200])
def test_ties_and_hot_cluster(spark, n):
    """Copies of one vector start several equal centroids: the smaller number takes them all, the others stay empty."""
    rows = [(i, [.5] * 64) for i in range(n)] + [(1000 + i, [float(i % 3)] * 64) for i in range(3)]
    found = got(centroids.cluster(table(spark, rows)))
    assert found == plain(rows)
