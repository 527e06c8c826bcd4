"""Positional popcounts and the filter audit against plain counting."""

import random
from itertools import permutations

import numpy as np
import pytest

from supplymetrics.llm import audit, bits, queries

from .conftest import EDGE, documents

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("width,n", [(32, 0), (32, 1), (32, 2), (32, 3), (32, 1000), (64, 4097)])
def test_positional_popcount(width, n):
    rng = random.Random(n)
    words = [rng.getrandbits(width) for _ in range(n)]
    got = bits.positional_popcount(np.array(words, f"uint{width}"))
    assert got.tolist() == [sum(w >> b & 1 for w in words) for b in range(width)]


def test_survival_words():
    words = audit.survival_words()
    assert words[0] == 2**32 - 1 and words[31] == 1
    for mask in range(32):
        for s in range(32):
            assert bool(int(words[mask]) >> s & 1) == all(not (s >> f & 1 and mask >> f & 1) for f in range(5))


def spaces(text):
    out, word = [], ""
    for ch in text:
        if ch in " \t\n\x0b\x0c\r":
            out, word = out + [word] * bool(word), ""
        else:
            word += ch
    return out + [word] * bool(word)


def plain(docs, labels):
    """docs: (id, text, part); labels: (id, quality, toxic). Filters applied one after the other, as the contract says."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, _ in docs:
        text = text or ""
        words = spaces(text)
        fails.append({"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                      "C": 100 * sum("A" <= ch <= "Z" for ch in text) > 3 * len(text), "D": any(ch in "#$%&*|" for ch in text),
                      "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)})
    rows = []
    for part in {p or "" for _, _, p in docs}:
        own = [(docs[k][0], fails[k]) for k in range(len(docs)) if (docs[k][2] or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                out = [x for x in left if x[1][f]]
                redundant = sum(x[1][f] for x in gone)
                left, gone = [x for x in left if not x[1][f]], gone + out
                removed_by[f] += len(out)
                unique = sum(x[1][f] and sum(x[1].values()) == 1 for x in own)
                found.append((f, (part, "".join(order), step, len(left), len(out), redundant, unique, sum(i in good for i, _ in out), sum(i in toxic for i, _ in out))))
        rows += [(*r, removed_by[f]) for f, r in found]
    return sorted(rows)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_matches_plain_counting(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    want = plain([(r.doc_id, r.text, r.lang) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    found = queries.op12_filter_interaction_audit(spark, SMALL)
    assert ", ".join(f"{f.name} {f.dataType.simpleString().replace('bigint', 'long')}" for f in found.schema) == audit.REPORT
    assert got(found) == want


LABELS = [(1, 1, 1), (5, 1, 0), (5, 0, None), (8, None, 1), (8, 1, 0), (None, 1, 1), (99, 1, 1), (10, None, None)]


def test_edges(spark, edge, none):
    assert got(audit.audit(edge, labelled(spark, LABELS))) == plain([r[:3] for r in EDGE], LABELS)
    assert got(audit.audit(edge, labelled(spark, []))) == plain([r[:3] for r in EDGE], [])
    assert audit.audit(none, labelled(spark, LABELS)).collect() == []


def test_hot_text_and_thresholds(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1000 - i, "one text " * 100, "en") for i in range(300)] + [(2000 + i, " ".join(words[:n]), f"l{i % 40}") for i, n in enumerate([199, 200, 100] * 20)]
    rows += [(3000, " ".join(words[:100] * 2), "b"), (3001, " ".join(words[:99] * 2 + ["w1", "w2"]), "b"), (3002, "A" * 3 + "x" * 97, "c"), (3003, "A" * 4 + "x" * 96, "c"),
             (3004, "ÀÉ" * 50, "c"), (3005, "a|b", "d"), (3006, "a b c", "d")]
    labels = [(1000 - i, i % 2, (i + 1) % 2) for i in range(300)]
    assert got(audit.audit(documents(spark, rows, extra=True), labelled(spark, labels))) == plain(rows, labels)
