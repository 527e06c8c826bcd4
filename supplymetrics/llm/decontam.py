"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

Test items are short and documents long, so the question is containment: does a document hold at least
``threshold`` of an item's word shingles? Items are partitioned by their number of shingles (powers
of two). Each partition has a sketch length: the bottom-k MinHash of an item keeps its k smallest shingle
hashes, with k = floor((1 - threshold) * largest size of the partition) + 1, so a document that holds
enough of the item must hold at least k minus the allowed misses of the sketch. That is a guarantee,
not a probability: no document at or over the threshold is missed. Documents are probed with all their
shingle hashes; candidates are verified by their exact shingles.

Scale: documents are read once per block of items and not shuffled. An index block holds at most about
``BLOCK_WORDS`` words of items (an item is never split); blocks are cut by a hash of the items, so
a benchmark of any size is searched completely, one block after another.

Defined results: words are runs of letters and digits, lower-cased; an item of fewer words than a
shingle is one shingle of all its words; an item or text without words matches nothing; a shingle counts
once however often it occurs; items repeated with the same id and text count once; repeated documents are
reported each; empty tables give an empty result; other columns are not read, or carried as they are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplymetrics.llm.common import ship

ship(__name__)

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BLOCK_WORDS = 200_000
WORDS = re.compile(r"[^\W_]+")
STEP = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the rolling hash
MEMO = 500_000


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def shingles(words: list[str], size: int) -> set[str]:
    return {" ".join(words[i:i + size]) for i in range(len(words) - size + 1)}


class WordHashes(dict):
    """64-bit hash of a word, remembered for the words met lately."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(words: list[str], size: int, memo: WordHashes) -> np.ndarray:
    """Hash of every run of ``size`` words, well mixed so that its order is a MinHash order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * STEP + w[i:i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def allowed_misses(n: int, threshold: float) -> int:
    """Largest number of an item's n shingles that may be missing."""
    return n - int(np.ceil(threshold * n - 1e-9))


def sketch_length(n: int, threshold: float) -> int:
    largest = (1 << n.bit_length()) - 1  # of the size partition [2 ** p, 2 ** (p + 1))
    return min(n, allowed_misses(largest, threshold) + 1)


class Index:
    """Sketches and exact shingles of one block of items."""

    def __init__(self, texts: list[str | None], shingle: int, threshold: float):
        self.threshold, self.items, self.by_size = threshold, [], {}
        memo, posts = WordHashes(), defaultdict(lambda: defaultdict(list))
        for number, text in enumerate(texts):
            words = words_of(text)
            size = min(shingle, len(words))
            own = shingles(words, size) if words else set()
            self.items.append((size, own))
            if own:
                hashes = np.unique(shingle_hashes(words, size, memo))
                for h in hashes[:sketch_length(len(own), threshold)].tolist():
                    posts[size][h].append(number)
        for size, entries in posts.items():
            keys = np.array(sorted(entries), np.uint64)
            gate = np.zeros(1 << 16, bool)
            gate[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.by_size[size] = (gate, keys, [entries[k] for k in keys.tolist()])

    def candidates(self, words: list[str], memo: WordHashes) -> list[int]:
        hits: dict[int, int] = defaultdict(int)
        for size, (gate, keys, lists) in self.by_size.items():
            h = shingle_hashes(words, size, memo)
            h = h[gate[(h >> np.uint64(48)).astype(np.int64)]]
            if len(h):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                for k in np.unique(at[keys[at] == h]).tolist():
                    for number in lists[k]:
                        hits[number] += 1
        return sorted(number for number, got in hits.items() if got >= self.least(number))

    def least(self, number: int) -> int:
        n = len(self.items[number][1])
        return max(1, sketch_length(n, self.threshold) - allowed_misses(n, self.threshold))

    def matches(self, text: str | None, memo: WordHashes) -> list[int]:
        """number * 2 ** 32 + shared shingles, for every item contained to the threshold."""
        words, found, own = words_of(text), [], {}
        for number in self.candidates(words, memo):
            size, wanted = self.items[number]
            if size not in own:
                own[size] = shingles(words, size)
            shared = len(wanted & own[size])
            if shared >= len(wanted) - allowed_misses(len(wanted), self.threshold):
                found.append(number << 32 | shared)
        return found


def blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list]:
    """The items (item_id, text) in bounded blocks, distinct, ordered by id. The driver holds one block at a time."""
    items = items.select("item_id", "text").distinct()
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0
    n = max(1, -(-int(words) // block_words))
    at = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        yield sorted(items.filter(at == b).collect(), key=lambda r: (r.item_id is not None, str(r.item_id), r.text or ""))


def match_column(text: Column, index) -> Column:
    """array<bigint> of ``Index.matches`` against a broadcast index."""
    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = WordHashes()
        for texts in batches:
            yield pd.Series([index.value.matches(t, memo) for t in texts], dtype=object)

    return run(text)


def contained_items(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE_WORDS,
                    threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, item_shingles, shared, containment."""
    spark, out = docs.sparkSession, None
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    for rows in blocks(benchmark, block_words):
        index = Index([r.text for r in rows], shingle, threshold)
        sent = spark.sparkContext.broadcast(index)
        # one short row per item of the block, so its size is bounded by block_words
        names = F.broadcast(spark.createDataFrame(
            [(i, r.item_id, len(index.items[i][1])) for i, r in enumerate(rows)],
            f"number long, item_id {id_type}, item_shingles long"))
        found = docs.select("doc_id", F.explode(match_column(F.col("text"), sent)).alias("m"))
        found = found.select("doc_id", F.shiftright("m", 32).alias("number"), F.col("m").bitwiseAND(F.lit((1 << 32) - 1)).alias("shared"))
        found = found.join(names, "number").select("doc_id", "item_id", "item_shingles", "shared",
                                                   (F.col("shared") / F.col("item_shingles")).alias("containment"))
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE_WORDS,
                      threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents that contain no test item. The columns are the input's."""
    spark = docs.sparkSession
    for rows in blocks(benchmark, block_words):
        sent = spark.sparkContext.broadcast(Index([r.text for r in rows], shingle, threshold))
        docs = docs.filter(F.size(match_column(F.col("text"), sent)) == 0)
    return docs
