"""The mix against a plain Sainte-Laguë loop, its bounds, hot sources and edge cases."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from supplymetrics.llm import mixing
from supplymetrics.llm.common import cut

from .conftest import EDGE, documents


def plain_targets(sizes, cap=3):
    """Reshare the excess by weight, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, stopped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in stopped]
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in open_)) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return {**{s: Fraction(v) for s, v in stopped.items()}, **share}
        for s in over:
            stopped[s] = cap * sizes[s]
            left -= stopped[s]


def plain_quotas(target, names, seats, most):
    got = dict.fromkeys(names, 0)
    for _ in range(seats):
        free = [s for s in names if got[s] < most[s]]
        if not free:
            break
        best = max(free, key=lambda s: (target[s] / (2 * got[s] + 1), -names.index(s)))
        got[best] += 1
    return got


def sample(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < .4 else rng.choice(["a", "b", "ä", "tiny", "z", None])
        rows.append((i, " ".join("w" for _ in range(0 if i % 17 == 0 else rng.randint(1, 60 if source != "tiny" else 3))), "en", source))
    return rows


def test_targets_quotas_and_bounds(spark):
    rows = sample(spark)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    got = mixing.mix(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    target = plain_targets(sizes)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    most = {s: math.ceil(3 * sizes[s] / mixing.BLOCK_WORDS) for s in names}
    seats = round(sum(target.values()) / mixing.BLOCK_WORDS)
    quota = plain_quotas(target, names, seats, most)
    of = {r[0]: r[3] for r in rows}
    taken, by_shard = defaultdict(int), defaultdict(int)
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - float(target[s])) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        per_shard = [int(x) for x in r.shard_words.split(",")]
        assert len(per_shard) == mixing.SHARDS and sum(per_shard) == r.taken
        for k, n in enumerate(per_shard):
            by_shard[s, k] += n
    # every shard takes of every source the words of its quota, in whole blocks of the house's award sequence
    upto = {(s, 0): 0 for s in names}
    for k in range(1, mixing.SHARDS + 1):
        house = plain_quotas(target, names, seats * k // mixing.SHARDS, most)
        for s in names:
            upto[s, k] = min(house[s] * mixing.BLOCK_WORDS, 3 * sizes[s])
            assert by_shard[s, k - 1] == upto[s, k] - upto[s, k - 1]
    for s in names:
        assert taken[s] == min(quota[s] * mixing.BLOCK_WORDS, 3 * sizes[s])
        assert abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS


def test_quotas_per_shard_are_whole_and_monotone(spark):
    rows = sample(spark, seed=5)
    parts = mixing.sized(documents(spark, rows)).groupBy("skey", "source", "bucket").agg(F.sum("size").alias("words"))
    src = mixing.targets(mixing.cycling_weights(parts.groupBy("source", "skey").agg(F.sum("words").alias("source_size"))))
    q = mixing.quotas(src).collect()
    per_shard = Counter()
    for r in q:
        assert r.quota >= 0
        per_shard[r.shard] += r.quota
    assert max(per_shard.values()) - min(per_shard.values()) <= 1
    by_source = defaultdict(list)
    for r in sorted(q, key=lambda r: r.shard):
        assert r.first_block == sum(by_source[r.rank])
        by_source[r.rank].append(r.quota)


def test_rerun_and_partitioning_do_not_matter(spark):
    df = documents(spark, sample(spark, seed=7))
    a, b = ({(r.doc_id, r.taken) for r in mixing.mix(x).collect()} for x in (df, df.repartition(13, "text")))
    assert a == b


def test_edges(spark, edge, none):
    got = mixing.mix(edge).collect()
    assert len(got) == len(EDGE) and all(r.taken <= 3 * r.size for r in got)
    assert {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(none).collect() == []
    assert mixing.apply_mix(none).columns == none.columns and mixing.apply_mix(none).count() == 0
    assert mixing.apply_mix(edge).columns == edge.columns
    only_empty = mixing.mix(documents(spark, [(1, None, None, "a"), (2, "", None, None)])).collect()
    assert [(r.target, r.taken) for r in only_empty] == [(0.0, 0), (0.0, 0)]


def test_applied_mix_repeats_documents(spark):
    rows = [(i, "w " * 50, "en", "big") for i in range(60)] + [(100 + i, "w " * 50, "en", "c") for i in range(6)]
    df = documents(spark, rows)
    copies = Counter(r.doc_id for r in mixing.apply_mix(df).collect())
    for r in mixing.mix(df).collect():
        assert copies[r.doc_id] == math.floor(r.taken / r.size + .5)
    assert max(copies.values()) == 3


def test_groups_follow_the_number_of_rows():
    assert [mixing.bucket_digits(n) for n in (0, 1, 10**6, 16**3 * 4096, 16**3 * 4096 + 1, 10**10)] == [3, 3, 3, 3, 4, 6]


def test_plan_is_kept_in_few_files(spark, monkeypatch):
    """The sums of a small table don't take a checkpoint file for every shuffle partition."""
    files = []

    def counted(df):
        kept = cut(df)
        files.append(kept.rdd.getNumPartitions())
        return kept

    df = documents(spark, sample(spark))
    expected = {(r.doc_id, r.taken, r.shard_words) for r in mixing.mix(df).collect()}
    monkeypatch.setattr(mixing, "cut", counted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {(r.doc_id, r.taken, r.shard_words) for r in mixing.mix(df).collect()} == expected
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) == 2 and max(files) <= 8
    assert [mixing.plan_tasks(n) for n in (0, 10**5, 10**7, 10**9)] == [8, 8, 153, 15259]
