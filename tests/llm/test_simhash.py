"""Fingerprints and groups against brute force, on both kinds of index lists."""

import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from supplymetrics.llm import simhash

from .conftest import EDGE, documents

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    pieces = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """pairs: (id, fingerprint); the smallest id reachable over links of at most 3 bits."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    low = {}
    for i, f in pairs:
        if i is not None:
            low[find(f)] = min(i, low.get(find(f), i))
    return [(i, f, low.get(find(f))) for i, f in pairs]


def key(t):
    return tuple((x is None, x or 0) for x in t)


def got(df, **kw):
    found = simhash.near_duplicates(df, **kw).select("doc_id", simhash.hex_digits(F.col("fp")).alias("h"), "component_id").collect()
    return sorted(((r.doc_id, int(r.h, 16), r.component_id) for r in found), key=key)


def test_position_sets_cover():
    for bits in range(8):
        sets = simhash.position_sets(bits)
        assert all(any(set(s) <= set(g) for s in sets) for g in combinations(range(8), 8 - bits))
    assert len(simhash.position_sets(3)) == 14


def test_matches_brute_force(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in df.collect()])
    assert got(df) == sorted(want, key=key)


def clustered(n=300, seed=1):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)] + [0xFFFFFFFF00000000]
    fps = set()
    while len(fps) < n:
        f = rng.choice(centres)
        for _ in range(rng.randint(0, 7)):
            f ^= 1 << rng.randrange(64) if rng.random() < .3 else 1 << rng.randrange(16)
        fps.add(f)
    return sorted(fps)


def test_long_and_short_lists_give_the_same_components(spark):
    fps = clustered()
    want = plain_components([(i, f) for i, f in enumerate(fps)])
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for long_list in (1, 4, 10_000):
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, 3, long_list)).collect()}
        groups = {}
        for i, f, c in want:
            s = int(np.uint64(f).astype(np.int64))
            groups.setdefault(c, set()).add(roots.get(s, s))
        assert all(len(v) == 1 for v in groups.values())
        assert len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_long_path_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_edges(spark, edge, none):
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in EDGE])
    assert got(edge) == sorted(want, key=key)
    assert got(none) == []
    assert simhash.drop_near_duplicates(none).count() == 0


def test_hot_group_of_copies_and_drop(spark):
    rows = [(1000 - i, "a b c d e f g", "en", "s") for i in range(300)] + [(i, f"word{i} other{i} third{i} x{i} y{i}", "en", "s") for i in range(20)]
    df = documents(spark, rows + rows[:2], extra=True)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = {c for _, _, c in plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted(want)


def test_nothing_with_an_id_is_lost_for_one_without(spark):
    df = documents(spark, [(None, "a b c d"), (5, "a b c d"), (None, "solo words of a kind")])
    assert sorted((r.doc_id or 0, r.text) for r in simhash.drop_near_duplicates(df).collect()) == [(0, "solo words of a kind"), (5, "a b c d")]
