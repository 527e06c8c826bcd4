"""Audit of how filters interact: what every order of them keeps, removes and loses.

A document is judged by each of five filters once. Its truth table over the 32 subsets of filters is one 32-bit
word: bit S is set if the document passes every filter of S. Positional popcounts of these words (carry-save
adders on whole words, 32 counters at once) give the survivors of every subset per part and label; whatever any order
does follows from them: an order's first k filters keep survivors(their set), a step removes the difference of
two sets, a document fails one filter alone if it is lost from the full set but not from the other four.

Scale: texts are read once by one Python pass over Arrow batches and reduced to a word of four bits, a digest
and the part; only those are shuffled. Copies meet by digest through partial minima; the digests that occur under
more than one id are joined back (broadcast only up to a checked size, else a join that AQE splits), so a text held by a third of the
rows is no group. Every Arrow batch emits 32 counts per part and label, added up by key. 600 rows a part come
from 96 numbers.

Defined results: a null text is empty (fails A; no words, so B is not failed; nothing else); a null id is
neither smaller than any other nor later than one, so E never concerns it; rows repeated with the same id are not copies of each
other; labels repeated for an id count once, quality or toxic if any row says so; ids without labels are in the plain counts only; null and
empty parts are one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplymetrics.llm.bits import positional_popcount
from supplymetrics.llm.common import UPPER, cut, ship, small_side

ship(__name__)

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3
SYMBOLS = re.compile(rb"[#$%&*|]")
SUBSETS = 1 << len(FILTERS)
LABELS = ("all", "good", "toxic")
REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def failures_of(text: str | None) -> int:
    """Bits of the filters that look at the text alone: A, B, C and D from the lowest bit."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()  # of bytes: splits at space, tab, newline, vertical tab, form feed and carriage return only
    upper = len(raw) - len(raw.translate(None, UPPER.encode()))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
            | (100 * upper > MAX_UPPER_PERCENT * len(text or "")) << 2 | (SYMBOLS.search(raw) is not None) << 3)


def failures(text: Column) -> Column:
    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([failures_of(t) for t in texts], dtype="int32")

    return run(text)


def survival_words() -> np.ndarray:
    """Per failure mask the word whose bit S tells whether no filter of S is failed."""
    return np.array([sum(1 << s for s in range(SUBSETS) if not s & mask) for mask in range(SUBSETS)], np.uint32)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, part, failed (bits of FILTERS from the lowest), good, toxic."""
    rows = cut(docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), failures(F.col("text")).alias("own"),
                           F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("digest")))
    first = rows.filter(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copied = small_side(cut(first.filter(F.col("first") < F.col("last")).select("digest", "first")))
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return (rows.join(copied, "digest", "left").join(said, F.col("doc_id") == F.col("labelled"), "left")
            .select("doc_id", "part", F.col("own").bitwiseOR(F.shiftleft(late, 4)).alias("failed"),
                    F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))


def survivors(rows: DataFrame) -> DataFrame:
    """(part, label, subset, n): how many documents of ``rows(part, failed, good, toxic)`` pass all filters of each subset."""
    words = survival_words()

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, own in batch.groupby("part"):
                word = words[own["failed"].to_numpy()]
                chosen = {"all": word, "good": word[own["good"].to_numpy(bool)], "toxic": word[own["toxic"].to_numpy(bool)]}
                for label, w in chosen.items():
                    if len(w):
                        yield pd.DataFrame({"part": part, "label": label, "subset": np.arange(SUBSETS, dtype=np.int32), "n": positional_popcount(w)})

    partial = rows.select("part", "failed", "good", "toxic").mapInPandas(count, "part string, label string, subset int, n long")
    return partial.groupBy("part", "label", "subset").agg(F.sum("n").alias("n"))


def steps_of(left: dict[str, list[int]]) -> list[tuple]:
    """The 600 steps of a part from the survivors of every subset, by label."""
    total, full = left["all"], SUBSETS - 1
    shapley = dict.fromkeys(FILTERS, 0)
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            after = before | bit
            lost = {label: left[label][before] - left[label][after] for label in LABELS}
            shapley[name] += lost["all"]
            steps.append((order, step, name, total[after], lost["all"], total[0] - total[bit] - lost["all"],
                          total[full ^ bit] - total[full], lost["good"], lost["toxic"]))
            before = after
    return [("".join(order), step, *counts, shapley[name]) for order, step, name, *counts in steps]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of filters and step: what the step keeps, removes, finds removed already, and loses."""
    def report(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, *counts in batch[["part", *LABELS]].itertuples(index=False):
                rows = steps_of(dict(zip(LABELS, (list(map(int, c)) for c in counts))))
                yield pd.DataFrame([(part, *r) for r in rows], columns=names)

    names = [c.split()[0] for c in REPORT.split(", ")]
    of = {label: F.array(*[F.coalesce(F.sum(F.when((F.col("label") == label) & (F.col("subset") == s), F.col("n"))), F.lit(0))
                           for s in range(SUBSETS)]).alias(label) for label in LABELS}
    return survivors(judged(docs, labels)).groupBy("part").agg(*of.values()).mapInPandas(report, REPORT)
