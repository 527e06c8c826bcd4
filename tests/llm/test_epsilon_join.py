"""The epsilon grid order join against all pairs."""

import math
import random

import numpy as np
import pytest

from supplymetrics.llm import epsilon_join, queries

VECTORS = "vec_id long, embedding array<double>, label int, node string, rank string, key string"


def plain(vectors, threshold=.95):
    """All pairs: (id, links, smallest id reachable, kept)."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in vectors]
    unit = [None] * len(vectors)
    for k, (_, v) in enumerate(vectors):
        if ok[k]:
            v = np.array(v, np.float64) / np.abs(v).max()
            unit[k] = v / np.sqrt(v @ v)
    root = list(range(len(vectors)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [0] * len(vectors)
    by = {}
    for k in range(len(vectors)):
        if ok[k]:
            by.setdefault(len(unit[k]), []).append(k)
    for own in by.values():
        near = np.stack([unit[k] for k in own])
        near = near @ near.T >= threshold - 1e-12
        for x, y in zip(*np.nonzero(np.triu(near, 1))):
            links[own[x]] += 1
            links[own[y]] += 1
            root[find(own[y])] = find(own[x])
    low = {}
    for k, (i, _) in enumerate(vectors):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted(((i, links[k], low.get(find(k)), i == low.get(find(k))) for k, (i, _) in enumerate(vectors)), key=repr)


def got(df, **settings):
    return sorted((tuple(r) for r in epsilon_join.near_vectors(df, **settings).collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n", "r", "k") for i, v in rows], VECTORS)


def near(rng, centre, by):
    return [x + rng.gauss(0, by) for x in centre]


def clustered(n, dims, seed, by=.03):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    rows = []
    for i in range(n):
        k = rng.random()
        rows.append((i, near(rng, centres[0], by) if k < .33 else near(rng, rng.choice(centres), 10 * by * rng.random()) if k < .8 else near(rng, [0] * dims, 1)))
    rng.shuffle(rows)
    return rows


def test_matches_all_pairs_of_the_table(spark):
    for sf in ("sf0.001", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        found = queries.op13_embedding_near_dedup(spark, f"/root/testdata/{sf}")
        assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
        assert sorted((tuple(r) for r in found.collect()), key=repr) == plain([(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("dims,by,block,fan,leaf", [(3, .02, 1, 2, 8), (20, .05, 1, 3, 16), (20, .2, 1 << 13, 8, 64), (64, .01, 1 << 21, 8, 256)])
def test_intervals_blocks_and_leaves(spark, monkeypatch, dims, by, block, fan, leaf):
    """Small blocks and leaves: several levels of intervals, some far, some near as a whole, some open."""
    monkeypatch.setattr(epsilon_join, "FAN_OUT", fan)
    monkeypatch.setattr(epsilon_join, "LEAF", leaf)
    rows = clustered(500, dims, dims, by)
    want = plain(rows)
    assert sum(r[1] for r in want) > 1000
    assert got(table(spark, rows), block_bytes=block) == want


def test_intervals_near_as_a_whole(spark, monkeypatch):
    monkeypatch.setattr(epsilon_join, "FAN_OUT", 2)
    monkeypatch.setattr(epsilon_join, "LEAF", 8)
    rng = random.Random(5)
    rows = [(i, near(rng, [1, 0, 0, 0], .001)) for i in range(150)] + [(1000 + i, near(rng, [0, 1, 1, 0], .5)) for i in range(60)]
    assert got(table(spark, rows), block_bytes=1) == plain(rows)
    assert got(table(spark, rows[:150]), block_bytes=1) == plain(rows[:150])


def test_edges(spark):
    rng = random.Random(2)
    base = [rng.gauss(0, 1) for _ in range(64)]
    rows = [(10, base), (4, base), (4, base), (11, [2 * x for x in base]), (12, [-x for x in base]), (13, near(rng, base, .01)), (None, base), (None, [0.0] * 63 + [1.0]),
            (20, None), (21, []), (22, [0.0] * 64), (22, [-0.0] * 64), (23, [None] * 64), (24, [float("nan")] + base[1:]), (25, [float("inf")] * 64), (26, [None] + base[1:]),
            (30, base[:3]), (31, base[:3]), (32, [1e300, 1e300, 1e-300]), (33, [1.0, 1.0, 0.0]), (34, [5e-324, 0.0]), (35, [1.0, 0.0]), (36, [7.0]), (37, [-7.0])]
    assert got(table(spark, rows)) == plain(rows)
    assert got(table(spark, [])) == []
    assert got(table(spark, rows[8:16])) == plain(rows[8:16])
    assert got(spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.01]), (None, [0.0, 1.0])], "vec_id string, embedding array<float>")) == [
        ("a", 1, "a", True), ("b", 1, "a", False), (None, 0, None, True)]


def test_at_the_threshold(spark):
    """Cosines of exactly .95 by the exact sum link, whatever the order of the sum."""
    a = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, a), (2, [.96, .28, 0.0, 0.0]), (3, [.8, .6, 0.0, 0.0]), (4, [.5, .5, .5, .5])]
    assert got(table(spark, rows), threshold=.96) == plain(rows, .96)
    assert got(table(spark, rows), threshold=.8) == plain(rows, .8)


def test_hot_group_of_copies(spark):
    rng = random.Random(9)
    base = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(5000 - i, base) for i in range(400)] + [(i, near(rng, [0] * 8, 1)) for i in range(200)]
    assert got(table(spark, rows)) == plain(rows)
