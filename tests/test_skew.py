"""Skew checks: one key holds a third of all rows (spread over every task), and the operators that
guard against hot groups — two-stage ordered listagg, semi-additive latest pick, dense surrogate
key, one-pass signal combination, duplicate detection — still give the brute-force answer."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from supplymetrics.operators.builders import surrogate_key
from supplymetrics.operators.relational import combine_signals, duplicates, listagg, semi_additive

N = 12_000
HOT = "hot"


def _key(i: int) -> str:
    # every third row belongs to the hot key; the rest spread over 50 cold keys
    return HOT if i % 3 == 0 else f"k{i % 50:02d}"


@pytest.fixture(scope="module")
def rows():
    # (key, ord, val, day, qty): ord is unique, day cycles over 40 snapshot days
    return [(_key(i), (i * 7919) % N, f"v{i}", i % 40, float(i % 13)) for i in range(N)]


@pytest.fixture(scope="module")
def df(spark, rows):
    d = spark.createDataFrame(rows, "k string, o long, v string, day int, q double")
    return d.repartition(8)       # the hot key lands in every task


def test_hot_key_is_a_third(rows):
    assert Counter(r[0] for r in rows)[HOT] == N // 3


def test_two_stage_listagg_matches_brute_force(df, rows):
    got = {r.k: (r.listagg, r.n) for r in
           listagg(df, ["k"], F.col("v"), F.col("o"), chunk=F.floor(F.col("o") / 512),
                   extra=[("n", F.count(F.lit(1)), "sum")]).collect()}
    by_key = defaultdict(list)
    for k, o, v, _, _ in rows:
        by_key[k].append((o, v))
    want = {k: (", ".join(v for _, v in sorted(xs)), len(xs)) for k, xs in by_key.items()}
    assert got == want


def test_semi_additive_picks_each_groups_latest_date(df, rows):
    got = {r.k: r.total for r in semi_additive(df, ["k"], "day", {"total": F.sum("q")}).collect()}
    latest = defaultdict(int)
    for k, _, _, day, _ in rows:
        latest[k] = max(latest[k], day)
    want = defaultdict(float)
    for k, _, _, day, q in rows:
        if day == latest[k]:
            want[k] += q
    assert got == dict(want)


def test_surrogate_key_dense_and_ordered_under_skew(df, rows):
    out = surrogate_key(df, ["k", "o"], "sk", prefix="R", width=6).select("k", "o", "sk").collect()
    got = {(r.k, r.o): r.sk for r in out}
    want = {ko: f"R{i + 1:06d}" for i, ko in enumerate(sorted((k, o) for k, o, _, _, _ in rows))}
    assert got == want


def test_combine_signals_with_hot_product(spark, df, rows):
    a = df.select("k", F.col("q").alias("_a"))
    b = df.filter(F.col("day") % 2 == 0).select("k", F.lit(1).alias("_b"))
    got = {r.k: (r.sa, r.nb) for r in
           combine_signals([a, b], ["k"], [F.sum("_a").alias("sa"), F.count("_b").alias("nb")]).collect()}
    sa, nb = defaultdict(float), Counter()
    for k, _, _, day, q in rows:
        sa[k] += q
        nb[k] += day % 2 == 0
    assert got == {k: (sa[k], nb[k]) for k in sa}


def test_duplicates_on_hot_key(df, rows):
    got = {r.k: r.row_count for r in duplicates(df.select("k"), ["k"]).collect()}
    assert got == {k: n for k, n in Counter(r[0] for r in rows).items() if n > 1}
