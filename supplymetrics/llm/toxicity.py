"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (and of itself), a document the mean of its
distinct words and of ``BLANKS`` words with a zero vector (so that a few words alone prove little), and a
linear layer with a softmax gives the two class probabilities. Vectors and layer are trained together,
so an unseen misspelling or inflection scores by the n-grams it shares.

Training reads a bounded sample (``SAMPLE`` rows a class, whole texts of any length) of the labelled rows; tasks turn these texts into
numbers of the words that at least ``MIN_DOCS`` of them hold, and the driver gets those numbers and the list of such words, never a
text. Scoring covers every document and its whole text. Averaging and the layer are linear, so a word's share of the
logit is one number; workers remember it for the words met lately. Documents are read once and not shuffled.

Defined results: words are runs of letters and digits, lower-cased, with a letter in them; a text without words (null, empty) scores the base rate of the sample; without labels of both classes every score is
the share of toxic labels (0 without any); repeated rows score alike; an empty table gives an empty result;
a null id is never learned from; labels, lang, source and ids are not inputs; other columns are carried.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplymetrics.llm.common import cut, drawn, label_counts, ship, small_side

ship(__name__)

SAMPLE = 2500
SEED = 4
BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
DIMENSIONS = 4
DECAY = 0.01  # of the n-gram vectors each step, against learning single documents by heart
EPOCHS = 180
RATE = 0.1
MIN_DOCS = 4
BLANKS = 20
SCALE = 50.0  # of a document's mean, so that vectors and layer train at one rate
MEMO = 400_000
CUTOFF = 0.3
WORDS = re.compile(r"[^\W_]+")


def bag_of(text: str | None) -> set[str]:
    """The distinct words of a text."""
    return {w for w in set(WORDS.findall(text.lower())) if not w.isdigit()} if text else set()


def subwords(word: str) -> list[int]:
    """Buckets of the word itself and of its character n-grams with word borders."""
    marked = f"<{word}>"
    if marked.isascii():  # characters are bytes
        marked = marked.encode()
        return [crc32(marked) % BUCKETS, *(crc32(marked[i:i + n]) % BUCKETS for n in GRAMS for i in range(len(marked) - n + 1))]
    parts = [marked, *(marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1))]
    return [crc32(p.encode("utf-8", "replace")) % BUCKETS for p in parts]


class Sums:
    """Weighted sums of rows of a matrix, and of its transpose, over a sparse (row, column, weight) list."""

    def __init__(self, row: np.ndarray, col: np.ndarray, weight: np.ndarray, rows: int, cols: int):
        self.forward, self.backward = (self._order(a, b, weight, n) for a, b, n in ((row, col, rows), (col, row, cols)))

    @staticmethod
    def _order(to, of, weight, n):
        by = np.argsort(to, kind="stable")
        target, start = np.unique(to[by], return_index=True)
        return of[by], weight[by, None], target, start, n

    @staticmethod
    def apply(order, values: np.ndarray) -> np.ndarray:
        of, weight, target, start, n = order
        out = np.zeros((n, values.shape[1]), np.float32)
        if len(of):
            out[target] = np.add.reduceat(values[of] * weight, start, axis=0)
        return out


def train(texts: list[str], labels: list[int], weights: list[float], **settings) -> tuple[np.ndarray, float]:
    """``train_bags`` of a few texts at hand."""
    bags = [bag_of(t) for t in texts]
    counts = Counter(w for bag in bags for w in bag)
    vocabulary = sorted(w for w, n in counts.items() if n >= MIN_DOCS)
    number = {w: i for i, w in enumerate(vocabulary)}
    return train_bags(vocabulary, [numbered(bag, number) for bag in bags], [len(bag) for bag in bags], labels, weights, **settings)


def numbered(bag: set[str], number: dict[str, int]) -> np.ndarray:
    """Numbers of the words of a bag that have one, in order."""
    return np.array(sorted(number[w] for w in bag if w in number), np.int32)


def train_bags(vocabulary: list[str], found: list[np.ndarray], bag_sizes: list[int], labels: list[int], weights: list[float],
               epochs: int = EPOCHS, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Logit share of every bucket, and the bias.

    ``found`` holds per document the numbers of its words in the vocabulary, ``bag_sizes`` how many distinct words it has in all.
    Full-batch steps with momentum, each matrix scaled by its largest slope so far and the rate falling to zero:
    n-grams that many documents share then learn faster than those of a few documents.
    """
    rng = np.random.default_rng(seed)
    y, weight = np.array(labels), np.array(weights, np.float32)
    rate = float((weight * y).sum() / max(weight.sum(), 1e-9)) if len(y) else 0.0
    if not vocabulary or len(set(labels)) < 2:
        edge = min(max(rate, 1e-6), 1 - 1e-6)
        return np.zeros(BUCKETS, np.float32), math.log(edge / (1 - edge))

    sizes = [len(f) for f in found]
    share = np.repeat([SCALE / (n + BLANKS) for n in bag_sizes], sizes).astype(np.float32)
    docs = Sums(np.repeat(np.arange(len(found), dtype=np.int32), sizes), np.concatenate(found), share, len(found), len(vocabulary))
    parts = [np.array(subwords(w), np.int32) for w in vocabulary]
    used, gram = np.unique(np.concatenate(parts), return_inverse=True)
    sizes = [len(p) for p in parts]
    of = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    words = Sums(of, gram.astype(np.int32), np.repeat([1 / n for n in sizes], sizes).astype(np.float32), len(parts), len(used))
    del found, parts

    state = {"grams": rng.normal(0, 0.01, (len(used), dimensions)).astype(np.float32),
             "layer": rng.normal(0, 0.5, (dimensions, 2)).astype(np.float32),
             "bias": np.array([math.log(1 - rate), math.log(rate)], np.float32)}
    momentum, largest = {k: np.zeros_like(v) for k, v in state.items()}, dict.fromkeys(state, 0.0)
    hot, weight = np.eye(2, dtype=np.float32)[y], weight / weight.sum()
    for step in range(1, epochs + 1):
        hidden = Sums.apply(docs.forward, Sums.apply(words.forward, state["grams"]))
        logits = hidden @ state["layer"] + state["bias"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - hot) * weight[:, None]
        slope = {"layer": hidden.T @ error, "bias": error.sum(axis=0),
                 "grams": Sums.apply(words.backward, Sums.apply(docs.backward, error @ state["layer"].T))}
        for k, g in slope.items():
            momentum[k] = 0.9 * momentum[k] + 0.1 * g
            largest[k] = 0.999 * largest[k] + 0.001 * float((g * g).max())
            step_size = RATE * (1 - (step - 1) / epochs) / (math.sqrt(largest[k] / (1 - 0.999 ** step)) + 1e-12)
            state[k] -= step_size * momentum[k] / (1 - 0.9 ** step)
        state["grams"] *= 1 - DECAY
    logit = state["layer"][:, 1] - state["layer"][:, 0]
    shares = np.zeros(BUCKETS, np.float32)
    shares[used] = state["grams"] @ logit
    return shares, float(state["bias"][1] - state["bias"][0])


class WordShares(dict):
    """A word's share of the logit, remembered for the words met lately."""

    def __init__(self, shares: np.ndarray):
        super().__init__()
        self.shares = shares

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = float(self.shares[subwords(word)].mean())
        return value


def score_text(text: str | None, memo: WordShares, bias: float) -> float:
    bag = bag_of(text)
    logit = bias + SCALE * sum(memo[w] for w in bag) / (len(bag) + BLANKS)
    return 1 / (1 + math.exp(-min(max(logit, -60.0), 60.0)))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text, label, n_label): a bounded, seeded sample of ``labels(doc_id, toxic)`` with their texts, one an id."""
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    # one row an id with its class, from the labels and the documents together: an id without a text is no row to learn from
    said = labels.select("doc_id", (F.col("toxic") > 0).cast("int").alias("label"), F.lit(None).cast("boolean").alias("here"))
    both = said.unionByName(texts.select("doc_id", F.lit(None).cast("int").alias("label"), F.lit(True).alias("here")))
    ids = both.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("here").alias("here")).filter("here").select("doc_id", "label")
    usable, counts = label_counts(ids)
    chosen = usable.join(small_side(counts), "label").filter(drawn(F.col("doc_id"), F.col("n_label"), sample, seed))
    # about ``sample`` ids in each of two classes: bounded, so they are broadcast and no text is shuffled but the chosen
    return texts.join(small_side(cut(chosen)), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("label").alias("label"), F.max("n_label").alias("n_label"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Train on the training rows; their bags are made, counted and numbered in tasks."""
    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(bag_of(t)) for t in texts], dtype=object)

    bags = cut(training_rows(docs, labels, sample, seed).select("doc_id", "label", "n_label", words("text").alias("bag")))
    counts = bags.select(F.explode("bag").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = sorted(r.word for r in counts.filter(F.col("n") >= MIN_DOCS).select("word").toLocalIterator())
    number = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    @F.pandas_udf("binary")
    def numbers(found: pd.Series) -> pd.Series:
        return pd.Series([numbered(bag, number.value).tobytes() for bag in found], dtype=object)

    rows = bags.select("doc_id", "label", "n_label", F.size("bag").alias("n"), numbers("bag").alias("found")).collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    kept = Counter(r.label for r in rows)
    return train_bags(vocabulary, [np.frombuffer(r.found, np.int32) for r in rows], [r.n for r in rows], [r.label for r in rows],
                      [r.n_label / kept[r.label] for r in rows], seed=seed)


def score(text: Column, model) -> Column:
    """Probability of the toxic class under a broadcast (shares, bias)."""
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shares, bias = model.value
        memo = WordShares(shares)
        for texts in batches:
            yield pd.Series([score_text(t, memo, bias) for t in texts], dtype="float64")

    return run(text)


def scored(docs: DataFrame, labels: DataFrame, **settings) -> tuple[DataFrame, Column]:
    """The documents and the column that scores them."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **settings))
    return docs, score(F.col("text"), model)


def drop_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, **settings) -> DataFrame:
    """Documents that score under the cut-off. The columns are the input's."""
    docs, value = scored(docs, labels, **settings)
    return docs.filter(value < cutoff)
