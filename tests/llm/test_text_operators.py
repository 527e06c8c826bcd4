"""Line dedup, decontamination, quality rules: against plain Python, and on edge cases."""

import hashlib
import random
import re
import weakref
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from supplymetrics.llm import decontam, linededup, quality_rules

from .conftest import EDGE, documents

SPACES = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain_line_dedup(rows, min_docs=10):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[lower(line.strip(SPACES))].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not x.strip(SPACES) or len(held[lower(x.strip(SPACES))]) < min_docs]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


def line_result(df, **kw):
    found = linededup.dedup_lines(df, **kw).select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("h"))
    return Counter(tuple(r) for r in found.collect())


def test_line_dedup(spark):
    rng = random.Random(2)
    hot = "  Share THIS\t"
    rows = [(i, "\n".join([hot] * rng.randint(0, 2) + [f"own {i}"] + rng.sample(["a", "A ", "É", "é", "", " "], 3)
                          + (["rare"] if i < 9 else []) + (["ten"] if i < 10 else [])), "en", "s") for i in range(60)]
    want = Counter(plain_line_dedup([r[:2] for r in rows]))
    assert line_result(documents(spark, rows)) == want
    assert line_result(documents(spark, rows).repartition(9)) == want


def test_line_dedup_edges(spark, edge, none):
    assert line_result(none) == Counter()
    assert line_result(edge) == Counter(plain_line_dedup([r[:2] for r in EDGE]))
    assert line_result(edge, min_docs=2) == Counter(plain_line_dedup([r[:2] for r in EDGE], 2))
    # rows repeating an id are one document
    same = documents(spark, [(1, f"x\n{i}") for i in range(20)])
    assert sum(r.n_dropped for r in linededup.dedup_lines(same).collect()) == 0


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 4, 5, 6, 9, 30, 80])))) for i in range(40)] + [(90, None), (91, ""), (92, "...")]
    docs = []
    for i in range(200):
        words = [word() for _ in range(rng.choice([5, 50, 2000]))]
        if i % 3 == 0:
            own = items[rng.randrange(40)][1].split()
            own = own[:max(2, int(len(own) * rng.choice([1, .9, .85, .8, .5])))]
            words[len(words) // 2:len(words) // 2] = [w.upper() + rng.choice(["", ",", "!!"]) for w in own]
        docs.append((i, " ".join(words), "en", "s"))
    want = set()
    for d, t, *_ in docs:
        for j, it in items:
            own = decontam.words_of(it)
            if own:
                n = min(5, len(own))
                a, b = decontam.shingles(own, n), decontam.shingles(decontam.words_of(t), n)
                if len(a & b) >= .8 * len(a) - 1e-9:
                    want.add((d, j, len(a), len(a & b)))
    df, bench = documents(spark, docs), spark.createDataFrame(items + items[:3], "item_id long, text string")
    assert len(want) > 30
    for block_words in (10_000, 100):
        found = decontam.contained_items(df, bench, block_words=block_words).collect()
        assert {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in found} == want and len(found) == len(want)
    clean = decontam.drop_contaminated(df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == set(range(200)) - {d for d, *_ in want}


def test_decontamination_edges(spark, edge, none):
    bench = spark.createDataFrame([(1, "same text in two rows"), (1, "same text in two rows"), (None, "no id here")], "item_id long, text string")
    found = sorted(((r.doc_id or 0, r.item_id or 0) for r in decontam.contained_items(edge, bench).collect()))
    assert found == [(0, 0), (8, 1), (8, 1), (9, 1)]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contained_items(edge, empty).count() == 0
    assert decontam.contained_items(none, bench).count() == 0
    assert decontam.drop_contaminated(edge, empty).count() == len(EDGE)


def plain_repeats(words):
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    return len({j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 3)})


def test_quality_statistics(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    for t in texts:
        assert quality_rules.repeated_words(t.split()) == plain_repeats(t.split())
    s = quality_rules.stats_of("A line.\nA line.\n \n \nb|c & d\xa0e")
    assert s[:4] == (7, 19, 2, 1)


def test_quality_line_rules(spark):
    good = "This is a sentence of some ten words in a row. " * 10
    rows = [(1, good), (2, "home | about | contact | more\n" * 30 + "end of it."), (3, good + "\nAll rights reserved."),
            (4, "\n".join(["word### noise*** more$$$ and%%% yet&&&."] * 1 + [f"w{i}### x{i}*** y{i}$$$" for i in range(40)])),
            (5, "licensed under the terms of use of somebody else " * 8 + ".\n" + good), (6, "too short."), (7, good.replace(" ", "\n", 3))]
    found = {r.doc_id: r.kept for r in quality_rules.judge(documents(spark, [(i, t.replace("This", f"This{i}")) for i, t in rows])).select("doc.doc_id", "kept").collect()}
    assert found == {1: False, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False}  # the same sentence again and again
    rng = random.Random(1)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = [(1, ". ".join(fresh(9) for _ in range(12)) + "."), (2, "\n".join(" | ".join(fresh(1) for _ in range(9)) for _ in range(9)) + "\n" + fresh(20) + "."),
            (3, fresh(80) + ".\nAll rights reserved."), (4, "\n".join(" ".join(fresh(1) + "###" for _ in range(9)) for _ in range(9))),
            (5, fresh(60)), (6, fresh(30) + ".\n" + fresh(31) + "\n" + fresh(5) + ".")]
    found = {r.doc_id: r.kept for r in quality_rules.judge(documents(spark, rows)).select("doc.doc_id", "kept").collect()}
    assert found == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True}


def test_quality_removes_the_failing_lines(spark):
    rng = random.Random(2)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    bad = ["home | about | contact", "all rights reserved.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Vea las condiciones de uso.", "no end of a sentence", "a### b*** c$$$."]
    lines = lambda: [rng.choice([fresh(9) + ".", fresh(30) + "! ", "", " \t", "é 1.\r", *bad]) for _ in range(rng.randint(0, 14))]
    made = [(i, lines()) for i in range(200)]
    want = {i: "\n".join(x for x in t if x not in bad) for i, t in made}
    docs = documents(spark, [(i, "\n".join(t), "en", "s") for i, t in made] + [(900, None, "en", "s")], extra=True)
    judged = quality_rules.judge(docs).select("doc.doc_id", "cleaned", "kept_words", "kept").collect()
    assert {r.doc_id: r.cleaned for r in judged} == {**want, 900: None}
    assert all(r.kept_words == len((r.cleaned or "").split()) for r in judged)
    cleaned = quality_rules.clean(docs)
    assert cleaned.columns == docs.columns
    got = {r.doc_id: r.text for r in cleaned.collect()}
    assert got == {r.doc_id: want[r.doc_id] for r in judged if r.kept} and 20 < len(got) < 200


def test_quality_edges(spark, edge, none):
    found = quality_rules.judge(edge).select("doc.*", "n_words", "kept").collect()
    assert len(found) == len(EDGE)
    assert {(r.n_words, r.kept) for r in found if r.doc_id in (1, 2, 3, 12)} == {(0, False)}
    assert {r.n_words for r in found if r.doc_id == 5} == {len(re.findall(r"\S+", EDGE[6][1]))}
    assert quality_rules.judge(none).count() == 0


def test_ids_of_any_type_and_one_block_on_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([("d1", "so it says: one two three four five six, and more"), ("d2", "seven eight nine ten eleven"), (None, "clean")], "doc_id string, text string")
    bench = spark.createDataFrame([("a", "one two three four five six"), ("b", "Seven eight, nine ten eleven."), ("c", "never met anywhere at all"), (None, "")], "item_id string, text string")
    alive, most, build = [0], [0], decontam.Index.__init__

    def counted(self, *args):
        build(self, *args)
        alive[0] += 1
        most[0] = max(most[0], alive[0])
        weakref.finalize(self, lambda: alive.__setitem__(0, alive[0] - 1))

    monkeypatch.setattr(decontam.Index, "__init__", counted)
    parts = decontam.blocks(bench, 4)
    assert iter(parts) is parts  # nothing is read before a block is asked for
    found = decontam.contained_items(docs, bench, block_words=4)
    assert dict(found.dtypes)["item_id"] == "string"
    assert most[0] <= 2  # the one in use, and the one being built
    monkeypatch.undo()
    assert sorted((r.doc_id, r.item_id) for r in decontam.contained_items(docs, bench, block_words=4).collect()) == [("d1", "a"), ("d2", "b")]
