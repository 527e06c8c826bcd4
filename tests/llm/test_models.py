"""Toxicity and language identification: held-out accuracy, unseen spellings, edge cases."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from supplymetrics.llm import langid, queries, toxicity
from supplymetrics.llm.common import drawn, label_counts

from .conftest import EDGE, documents

DATA = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"  # sf0.01 has a dozen toxic documents to learn from in each of two languages
LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_held_out_accuracy(spark):
    found = queries.op4_toxicity(spark, LARGER)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = found.join(labels, "doc_id").collect()
    assert found.count() == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= .3)
    held = [r for r in rows if r.held_out]
    good, bad = [r.score for r in held if not r.toxic], [r.score for r in held if r.toxic]
    assert len(bad) > 100 and np.mean([a > b for a in bad for b in good]) > .9
    assert np.mean(np.array(bad) >= .3) > .8 and np.mean(np.array(good) >= .3) < .04


def test_toxicity_shares_subwords(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    plain = [word() for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        words = rng.choices(plain, k=40)
        if i % 4 == 0:
            words[5] = words[20] = "zwurgel" + rng.choice(["", "s", "t", "ig"])
        texts.append(" ".join(words)), labels.append(int(i % 4 == 0))
    shares, bias = toxicity.train(texts, labels, [1.0] * 400)
    memo = toxicity.WordShares(shares)
    say = lambda *w: toxicity.score_text(" ".join(rng.choices(plain, k=38) + list(w)), memo, bias)
    unseen = [say("zwurgelein", "ZWURGELL!!!"), say("zwurgelchen", "zwurgele"), say("zwurgelant", "zwurgelo")]
    assert min(unseen) >= .3 > max(say(rng.choice(plain), rng.choice(plain)) for _ in range(20))


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(1, 13)] + [(None, 1, 1), (3, None, None), (4, 1, 1), (4, 1, 0)], LABELS)
    docs, score = toxicity.scored(edge, labels)
    rows = docs.select("doc_id", score.alias("p")).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.p <= 1 for r in rows)
    no_labels = spark.createDataFrame([], LABELS)
    docs, score = toxicity.scored(edge, no_labels)
    assert max(r[0] for r in docs.select(score).collect()) < 1e-5
    docs, score = toxicity.scored(none, labels)
    assert docs.select(score).collect() == []
    assert toxicity.drop_toxic(edge, no_labels).columns == edge.columns


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_language_held_out_accuracy(spark):
    found = queries.op6_language_id(spark, DATA)
    rows = found.join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > .97


def test_binding_keeps_order_and_case_does_not_matter():
    p = langid.Profiles(["abc abd", "xyz xzy"], ["a", "x"])
    r = langid.Reader(p)
    cos = lambda a, b: float(r.bundle(a) @ r.bundle(b) / np.linalg.norm(r.bundle(a)) / np.linalg.norm(r.bundle(b)))
    assert cos("abc", "ABC!") > .999 and cos("abc", "cba") < .5
    codes, counts = r.grams("ab" * 700_000)
    again = langid.Reader(p).grams("ab" * 50)
    assert set(codes) == set(again[0]) and counts.sum() == 1_400_000


def words_of(rng, letters, n=40):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n))


def test_letters_of_every_script_have_their_own_vectors():
    rng = random.Random(8)
    frequent = [chr(c) for c in range(0x3B1, 0x600) if chr(c).isalpha() and chr(c).islower()][:120]  # over 94 letters
    scripts = {"ka": [chr(0x10D0 + i) for i in range(30)], "am": [chr(0x1200 + i) for i in range(60)]}
    texts, langs = [words_of(rng, frequent, 4000)], ["xx"]
    vocabulary = {lang: words_of(rng, letters).split() for lang, letters in scripts.items()}
    say = lambda lang: " ".join(rng.choices(vocabulary[lang], k=30))
    for lang in scripts:
        texts += [say(lang) for _ in range(5)]
        langs += [lang] * 5
    r = langid.Reader(langid.Profiles(texts, langs))
    for lang in scripts:
        assert {r.predict(say(lang))[0] for _ in range(20)} == {lang}
    han = "".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(100_000))  # more n-grams than are kept
    codes, counts = r.grams(han)
    assert np.array_equal(r.bundle(han), langid.Reader(r.p).bundle(han)) and counts.sum() == len(han)
    assert np.allclose(r.bundle(han), sum(counts[i:i + 999].astype(float) @ r.vectors(codes[i:i + 999]) for i in range(0, len(codes), 999)))


def test_language_edges(spark, edge, none):
    rows = langid.identify(edge).select("doc.doc_id", "doc.text", "lang_pred", "score").collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in {"en", "fr", "es", "de"}
    assert langid.identify(none).count() == 0
    unlabelled = documents(spark, [(1, "words", None, "a"), (2, None, None, None)])
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def learnable(ids):
    return {i for i in ids if zlib.crc32(str(i).encode()) % 4 != 2}


def test_texts_are_drawn_and_learned_whole_whatever_their_length(spark):
    rng = random.Random(4)
    vocabulary = {"aa": words_of(rng, "abcdefg").split(), "zz": words_of(rng, "tuvwxyz").split()}
    say = lambda lang, n: " ".join(rng.choices(vocabulary[lang], k=n))
    # a class of long texts alone, and one of both where what tells it apart stands only in the long ones, at a different place each
    rows = [(i, say("aa", 30), "aa", "s") for i in range(80)] + [(100 + i, say("zz", 7000), "zz", "s") for i in range(40)]
    docs = documents(spark, rows)
    assert min(len(r[1]) for r in rows[80:]) > 30_000
    found = langid.identify(docs).select("doc.lang", "lang_pred").collect()
    assert all(r.lang == r.lang_pred for r in found)
    assert {r.doc_id: r.text for r in langid.training_rows(docs).collect()} == {r[0]: r[1] for r in rows if r[0] in learnable([r[0]])}
    labels = spark.createDataFrame([(r[0], 1, int(r[2] == "zz")) for r in rows], LABELS)
    assert {r.doc_id: r.text for r in toxicity.training_rows(docs, labels).collect()} == {r[0]: r[1] for r in rows if r[0] in learnable([r[0]])}
    scored, p = toxicity.scored(docs, labels)
    got = {r.doc_id: r.p for r in scored.select("doc_id", p.alias("p")).collect()}
    assert min(got[i] for i in got if i >= 100) > max(got[i] for i in got if i < 100)
    mixed = [(i, say("aa", 6000 if i % 10 == 0 else 5), "aa", "s") for i in range(4000)]
    drawn_ids = {r.doc_id for r in langid.training_rows(documents(spark, mixed), 600).select("doc_id").collect()}
    assert 500 < len(drawn_ids) < 700 and 35 < sum(i % 10 == 0 for i in drawn_ids) < 90  # long ones as often as others


def test_brute_force_of_the_toxicity_fit(spark):
    """The model fitted by tasks is that of the plain function on the sampled texts, and scores are its plain scores."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows = sorted(toxicity.training_rows(docs, labels).collect(), key=lambda r: r.doc_id)
    toxic = {r.doc_id: int(r.toxic > 0) for r in labels.collect()}
    assert {r.doc_id: r.label for r in rows} == {i: toxic[i] for i in learnable(toxic) & {r.doc_id for r in docs.filter("text is not null").collect()}}
    sizes = {y: sum(r.label == y for r in rows) for y in (0, 1)}
    shares, bias = toxicity.train([r.text for r in rows], [r.label for r in rows], [r.n_label / sizes[r.label] for r in rows])
    fitted = toxicity.fit(docs, labels)
    assert np.array_equal(fitted[0], shares) and fitted[1] == bias
    got = {r.doc_id: (r.score, r.predicted) for r in queries.op4_toxicity(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        bag = {w for w in set(toxicity.WORDS.findall((r.text or "").lower())) if not w.isdigit()}
        mean = sum(float(shares[toxicity.subwords(w)].mean()) for w in bag) / (len(bag) + toxicity.BLANKS)
        want = 1 / (1 + np.exp(-(bias + toxicity.SCALE * mean)))
        assert abs(got[r.doc_id][0] - want) < 1e-9 and got[r.doc_id][1] == (got[r.doc_id][0] >= .3)


def test_brute_force_of_the_language_profiles(spark):
    """Prototypes and predictions against sums over every single n-gram."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = langid.training_rows(docs).collect()
    assert {r.doc_id for r in rows} == learnable(r.doc_id for r in docs.filter("lang is not null and text rlike '\\\\p{L}'").collect())
    letters = {}

    def vector(ch):
        if ch not in letters:
            letters[ch] = np.random.default_rng([langid.SEED, ord(ch)]).choice(np.array([-1, 1], np.int8), langid.DIMENSIONS).astype(float)
        return letters[ch]

    def bundle(text):
        low = "".join(c.lower()[0] if c.lower()[0].isalpha() else " " for c in text)
        low = " " + " ".join(low.split()) + " "
        out = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(low, low[1:], low[2:]):
            out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
        return out / max(np.linalg.norm(out), 1e-9)

    langs = sorted({r.label for r in rows})
    sums = np.stack([sum(bundle(r.text) for r in rows if r.label == lang) for lang in langs])
    units = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    units = units - units.mean(axis=0)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op6_language_id(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id] == ("und", 0.0)
        elif len(r.text) < 30_000:
            cosine = units @ bundle(r.text)
            assert got[r.doc_id][0] == langs[int(np.argmax(cosine))] and abs(got[r.doc_id][1] - max(cosine.max(), 0)) < 1e-4


def test_every_language_is_learned_however_many(spark):
    rng = random.Random(9)
    vocabulary = {f"l{k:03}": words_of(rng, [chr(0x4E00 + 30 * k + i) for i in range(30)], 12).split() for k in range(260)}
    rows = [(3 * k + i, " ".join(rng.choices(v, k=20)), lang, "s") for k, (lang, v) in enumerate(vocabulary.items()) for i in range(3)]
    docs = documents(spark, rows)
    learned = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    p = langid.fit(docs)
    assert p.langs == sorted(learned) and len(learned) > 250
    reader = langid.Reader(p)
    assert np.mean([reader.predict(r[1])[0] == r[2] for r in rows if r[2] in learned]) > .95
    ids = spark.range(20_000).selectExpr("id doc_id", "concat('l', id % 20) label")  # 1,000 rows of each of 20 values
    usable, counts = label_counts(ids)
    chosen = usable.join(counts, "label").filter(drawn(F.col("doc_id"), F.col("n_label"), 500, 6)).groupBy("label").count().collect()
    assert len(chosen) == 20 and all(400 < r["count"] < 600 for r in chosen)


def test_only_drawn_texts_of_many_languages_are_shuffled(spark, capsys):
    rows = [(k, f"text of language {chr(97 + k % 26)} number {k}", f"l{k % 300}", "s") for k in range(900)]
    langid.training_rows(documents(spark, rows)).explain("formatted")
    plan = capsys.readouterr().out.split("\n\n")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
