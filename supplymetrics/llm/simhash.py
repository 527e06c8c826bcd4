"""SimHash near-duplicate groups through a byte-position inverted index with count filtering.

A fingerprint has 8 positional bytes. Two fingerprints within ``max_bits`` bits differ in at most
``max_bits`` bytes, so they share at least 8 - max_bits positional bytes. Lists keyed by one byte
would each hold 1/256 of the corpus, so the index is keyed by sets of positions (14 sets of four bytes
for 3 bits) chosen so that any guaranteed number of shared positions contains one whole set. Pairs that meet in a
list are tallied (number of shared positional bytes), kept from the guaranteed minimum on, and
verified by their bit distance.

Only distinct fingerprints enter the index, so exact copies cost one entry. A list longer than
``LONG_LIST`` is not paired up: its members differ only in the free bits, and two of them lie within
``max_bits`` of each other exactly if some code is within ceil(max_bits / 2) of one and within floor(max_bits / 2) of
the other; every member emits those codes and is tied to the smallest near member of each code, which is
linear in the list and yields the same components.

Defined results: a text without words (null, empty, white space) has fingerprint 0 and is linked like
any other; repeated rows get one row each; a null id keeps its row and is never the smallest id
unless its whole component has none; an empty table gives an empty result; other columns are not read.
Long texts are hashed in pieces of ``PIECE`` shingles. Every iteration is cut by a reliable checkpoint.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplymetrics.llm.common import cut, ship

ship(__name__)

SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42
BYTES = 8
LONG_LIST = 256
PIECE = 16384


def fingerprint_of(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the XXH64 of every word shingle, repeats included."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    votes = np.zeros(64, np.int64)
    for a in range(0, n, PIECE):
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), HASH_SEED)
                           for i in range(a, min(n, a + PIECE))], dtype=">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed long."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return run(text)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def position_sets(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any 8 - max_bits positions contain one whole set.

    Chosen greedily, always the set that is the first to be contained in the most position groups left.
    """
    shared = BYTES - max_bits
    size = max(1, shared - 1)
    left = set(combinations(range(BYTES), shared))
    sets = list(combinations(range(BYTES), size))
    chosen = []
    while left:
        best = max(sets, key=lambda s: sum(1 for g in left if set(s) <= set(g)))
        chosen.append(best)
        left = {g for g in left if not set(best) <= set(g)}
    return chosen


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def mask(positions) -> int:
    """Bits of the bytes at these positions (position 0 is the highest byte)."""
    return sum(0xFF << (8 * (BYTES - 1 - p)) for p in positions)


def postings(fps: DataFrame, max_bits: int) -> DataFrame:
    """The inverted index: (part, key, fp), one row per fingerprint and position set."""
    entries = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(mask(s)))).alias("key"))
                        for i, s in enumerate(position_sets(max_bits))])
    return fps.select("fp", F.explode(entries).alias("e")).select("e.part", "e.key", "fp")


def short_list_edges(index: DataFrame, max_bits: int) -> DataFrame:
    """Verified pairs (a < b) that meet in a list."""
    a = index.select("part", "key", F.col("fp").alias("a"))
    b = index.select("part", "key", F.col("fp").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    tally = sum(((diff.bitwiseAND(F.lit(signed(mask([p])))) == 0).cast("int") for p in range(BYTES)), F.lit(0))
    met = a.join(b, ["part", "key"]).filter((F.col("a") < F.col("b")) & (tally >= BYTES - max_bits)
                                            & (F.bit_count(diff) <= max_bits))
    return met.select("a", "b")


def flips(bits: list[int], upto: int) -> list[int]:
    """Codes to XOR with: up to ``upto`` of these bits."""
    return [signed(sum(1 << b for b in c)) for k in range(upto + 1) for c in combinations(bits, k)]


def long_list_edges(index: DataFrame, max_bits: int) -> DataFrame:
    """Ties between members of long lists that give the same components as all their verified pairs."""
    out = None
    for i, s in enumerate(position_sets(max_bits)):
        free = [b for b in range(64) if not mask(s) >> b & 1]
        own = index.filter(F.col("part") == i)

        def codes(upto: int, name: str) -> DataFrame:
            flipped = F.explode(F.array(*[F.lit(x) for x in flips(free, upto)]))
            return own.select("fp", flipped.alias("x")).select(
                F.col("fp").alias(name), F.col("fp").bitwiseXOR(F.col("x")).alias("code"))

        near = codes(max_bits // 2, "near").groupBy("code").agg(F.min("near").alias("a"))
        far = codes(max_bits - max_bits // 2, "b")
        ties = far.join(near, "code").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        out = ties if out is None else out.unionByName(ties)
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS, long_list: int = LONG_LIST) -> DataFrame:
    """Edges (a < b) between distinct fingerprints ``fps(fp)`` whose components are those of all pairs within max_bits."""
    index = postings(fps, max_bits)
    long = cut(index.groupBy("part", "key").count().filter(F.col("count") > long_list).select("part", "key"))
    if long.isEmpty():
        return short_list_edges(index, max_bits).distinct()
    short = index.join(long, ["part", "key"], "left_anti")
    rest = index.join(long, ["part", "key"], "left_semi")
    return short_list_edges(short, max_bits).unionByName(long_list_edges(rest, max_bits)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with an edge.

    Alternating large and small stars; minima are aggregated before they are shuffled and no
    neighbourhood is ever gathered. Ends when a round changes no edge.
    """
    edges, seen = cut(edges.select("a", "b")), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large.filter("a <> b"))  # every edge now leads from a node to a smaller one
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").filter("a <> b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def groups(docs: DataFrame, shingle: int, max_bits: int, long_list: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprinted documents (doc_id, text_key, fp), and per distinct fingerprint the row that stays of its component.

    ``stays`` is (id is null, id, text_key): the smallest id, and of rows repeating it the smallest text key.
    """
    fps = cut(docs.select("doc_id", F.xxhash64("text").alias("text_key"),
                          fingerprint(F.col("text"), shingle).alias("fp")))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = cut(fps.groupBy("fp").agg(F.min(row).alias("first")))
    roots = components(links(classes.select("fp"), max_bits, long_list))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("stays"))
    return fps, cut(rooted.join(smallest, "root").select("fp", "stays"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    long_list: int = LONG_LIST) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (smallest id linked to it, itself included)."""
    fps, stays = groups(docs, shingle, max_bits, long_list)
    return fps.join(stays, "fp").select("doc_id", "fp", F.col("stays.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                         long_list: int = LONG_LIST) -> DataFrame:
    """Documents with one row left per group: that of the smallest id. The columns are the input's."""
    _, stays = groups(docs, shingle, max_bits, long_list)

    def key(doc_id: Column) -> Column:
        return F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("n")).alias("id_key")

    keep = stays.select(key(F.col("stays.doc_id")), F.col("stays.text_key").alias("text_key")).distinct()
    rows = docs.select(key(F.col("doc_id")), F.xxhash64("text").alias("text_key"), F.struct("*").alias("doc"))
    kept = rows.join(cut(keep), ["id_key", "text_key"]).dropDuplicates(["id_key", "text_key"])
    return kept.select("doc.*")
