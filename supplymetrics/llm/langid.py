"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +-1 (seeded by its code point). A letter n-gram is bound from the
permuted letter vectors, rho^2(a) * rho(b) * c; a text is the bundle (sum) of its n-gram vectors; a
language's prototype is the bundle of its training texts, less the mean of all languages; texts are compared with the
prototypes by cosine.

Training reads a bounded sample (about ``SAMPLE`` learnable rows of every language value, whole texts of any length),
drawn at the scan: a row is kept by a hash of its id and the number of ids of its language, so no other text is shuffled. The
sums per language are a Spark aggregate, and the driver holds one prototype (1 KB) a language. Prediction covers every document and its whole text. n-gram vectors are computed once per task and n-gram, and
kept for up to ``KEPT_GRAMS`` of them; letters of every script have vectors of their own, drawn when first met. Documents
are read once and not shuffled.

Defined results: letters are compared without case; all else is one space; a text that is null or has no letter is ``und`` with score 0;
without any learned language every text is ``und``; ties go to the first language in code point
order; a null id is never learned from; lang, source and ids are not inputs; repeated rows score alike.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplymetrics.llm.common import drawn, label_counts, learnable, ship, small_side

ship(__name__)

SAMPLE = 500
SEED = 6
DIMENSIONS = 256
POINT_BITS = 21  # of a code point: three of them are the code of an n-gram
STEP = 1 << 14
UNIT = 1 << 32
UNKNOWN = "und"
KEPT_GRAMS = 60_000


class Profiles:
    """Language prototypes, and what letter vectors follow from."""

    def __init__(self, texts: Sequence[str] = (), langs: Sequence[str] = (), dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.langs, self.prototypes = [], np.zeros((0, dimensions), np.float32)
        self.learn(sums_of(self, zip(texts, langs)))

    def learn(self, sums: dict[str, np.ndarray]) -> Profiles:
        """Prototypes from the sums of the languages' unit vectors."""
        self.langs = sorted(sums)
        if self.langs:
            units = np.stack([sums[k] / max(np.linalg.norm(sums[k].astype(np.float64)), 1e-9) for k in self.langs])
            if len(units) > 1:
                units = units - units.mean(axis=0)
            self.prototypes = (units / np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        return self


def sums_of(profiles: Profiles, labelled: Iterable[tuple[str, str]]) -> dict[str, np.ndarray]:
    """Sums of the texts' unit vectors per language, in whole ``1 / UNIT``: no order of adding changes them."""
    reader, sums = Reader(profiles), {}
    for text, lang in labelled:
        v = reader.bundle(text)
        if v is not None:
            unit = np.rint(v.astype(np.float64) / max(np.linalg.norm(v), 1e-9) * UNIT).astype(np.int64)
            sums[lang] = sums[lang] + unit if lang in sums else unit
    return sums


class Reader:
    """Bundles texts; remembers the vectors of the letters it met, and of the n-grams it met first."""

    def __init__(self, profiles: Profiles):
        self.p = profiles
        self.table = np.full(sys.maxunicode + 1, -1, np.int32)  # symbol of every code point: 0 space, a lower-case letter itself, -1 not known yet
        self.place = np.full(sys.maxunicode + 1, -1, np.int32)  # of a symbol's vectors
        self.turned = [np.zeros((64, profiles.dimensions), np.int8) for _ in range(3)]
        self.met = 0
        self.row: dict[int, int] = {}  # of an n-gram's vector
        self.kept = np.zeros((1024, profiles.dimensions), np.float32)

    def symbol(self, point: int) -> int:
        low = chr(point).lower()
        return ord(low[0]) if low[0].isalpha() else 0

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Codes and counts of the n-grams of a text; None without a letter."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        s = self.table[points]
        if (s < 0).any():
            for x in np.unique(points[s < 0]).tolist():
                self.table[x] = self.symbol(x)
            s = self.table[points]
        if not s.any():
            return None
        s = s[(s > 0) | (np.concatenate(([1], s[:-1])) > 0)]  # runs of other characters are one space
        s = np.concatenate(([0][: int(s[0] > 0)], s, [0][: int(s[-1] > 0)])).astype(np.int64)
        codes = (s[:-2] << 2 * POINT_BITS) | (s[1:-1] << POINT_BITS) | s[2:]
        return np.unique(codes, return_counts=True)

    def places(self, symbols: np.ndarray) -> np.ndarray:
        """Where the vectors of the symbols stand; those not met before are drawn from their code points."""
        at = self.place[symbols]
        if (at < 0).any():
            for x in np.unique(symbols[at < 0]).tolist():
                if self.met == len(self.turned[0]):
                    self.turned = [np.concatenate((t, np.zeros_like(t))) for t in self.turned]
                v = np.random.default_rng([self.p.seed, x or 32]).choice(np.array([-1, 1], np.int8), self.p.dimensions)
                for t, shift in zip(self.turned, (2, 1, 0)):
                    t[self.met] = np.roll(v, shift)
                self.place[x], self.met = self.met, self.met + 1
            at = self.place[symbols]
        return at

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        mask = (1 << POINT_BITS) - 1
        at = [self.places(s) for s in (codes >> 2 * POINT_BITS, codes >> POINT_BITS & mask, codes & mask)]
        a, b, c = self.turned
        return a[at[0]] * b[at[1]] * c[at[2]]

    def bundle(self, text: str | None) -> np.ndarray | None:
        found = self.grams(text) if text else None
        if found is None:
            return None
        out = np.zeros(self.p.dimensions, np.float32)
        for i in range(0, len(found[0]), STEP):  # a long text of a large script has as many n-grams as letters
            codes, counts = found[0][i:i + STEP], found[1][i:i + STEP].astype(np.float32)
            rows = np.array([self.row.get(c, -1) for c in codes.tolist()], np.int64)
            new = codes[rows < 0][:KEPT_GRAMS - len(self.row)]
            if len(new):
                used = len(self.row)
                while used + len(new) > len(self.kept):
                    self.kept = np.concatenate((self.kept, np.zeros_like(self.kept)))
                self.kept[used:used + len(new)] = self.vectors(new)
                self.row.update(zip(new.tolist(), range(used, used + len(new))))
                rows[np.flatnonzero(rows < 0)[:len(new)]] = np.arange(used, used + len(new))
            out += counts[rows >= 0] @ self.kept[rows[rows >= 0]]
            if (rows < 0).any():
                out += counts[rows < 0] @ self.vectors(codes[rows < 0]).astype(np.float32)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        v = self.bundle(text)
        if v is None or not self.p.langs:
            return UNKNOWN, 0.0
        cosine = self.p.prototypes @ v / max(float(np.linalg.norm(v)), 1e-9)
        best = int(np.argmax(cosine))
        return self.p.langs[best], float(min(max(cosine[best], 0.0), 1.0))


def training_rows(docs: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text, label): a bounded, seeded sample of the learnable documents of every language, one text an id."""
    texts = docs.select("doc_id", "text", F.col("lang").alias("label")).filter(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    _, counts = label_counts(texts.select("doc_id", "label"))
    kept = texts.filter(learnable(F.col("doc_id"))).join(small_side(counts), "label").filter(drawn(F.col("doc_id"), F.col("n_label"), sample, seed))
    return kept.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Profiles:
    """Learn the prototypes of all languages from the training rows."""
    rows = training_rows(docs, sample, seed).select("text", "label")
    profiles = Profiles(seed=seed)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = sums_of(profiles, (pair for rows in batches for pair in zip(rows["text"], rows["label"])))
        if sums:
            yield pd.DataFrame({"label": list(sums), "v": list(sums.values())})

    parts = rows.mapInPandas(learn, "label string, v array<long>").select("label", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("label", "i").agg(F.sum("x").alias("x")).groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    # a prototype a language
    return profiles.learn({r.label: np.array(r.v, np.int64) for r in sums.toLocalIterator()})


def identify(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc (the whole row as struct), lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, **settings))

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(sent.value)
        for texts in batches:
            yield pd.DataFrame([reader.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.select(F.struct("*").alias("doc"), run(F.col("text")).alias("p")).select("doc", "p.*")
