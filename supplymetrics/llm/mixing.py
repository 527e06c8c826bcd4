"""Mixing sources to target weights by Sainte-Laguë apportionment [native: DataFrame functions only].

The mix is a sequence of equal blocks of ``block`` words. Sainte-Laguë awards the blocks to the
sources one after the other, each to the highest quotient ``target / (2 k + 1)``; it is
house-monotone, so cutting the award sequence at ``shards`` equal places gives every shard whole
numbers of blocks per source. Each source's documents are put in a seeded order; its blocks are the
consecutive runs of ``block`` words of that order, run through up to ``max_repeat`` times (the last block of the last
round may be short). The first shard takes as many of a source's blocks as its quota says, the next shard the following
ones, and so on: the words of a document that each shard takes are returned, and ``taken`` is their sum.

Scale: the only sorts are by (source, leading hex digits of the seeded order key), as many digits as make groups of
about ``BUCKET_ROWS`` rows, so a source holding a third of all rows is spread over as many groups as it needs; the start of each group
comes from a sum per group. Windows without that key run over one row per source, and over 2 candidate blocks per source and shard.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; size 0
takes 0 words; an empty table gives an empty result; rows repeated with the same id and text share
their place in the order, any of them may come first; other columns of the input are not read, whatever
their names. ``taken`` never exceeds ``max_repeat`` times the size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from supplymetrics.llm.common import cut, word_count

BLOCK_WORDS = 16
SHARDS = 8
SEED = 20260101
MAX_REPEAT = 3
BUCKET_ROWS = 4096
PLAN_ROWS = 65536


def order_key(seed: int) -> Column:
    """Seeded order of documents: 32 hex digits from the seed, the id and the text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                             F.coalesce(F.md5(F.col("text")), F.lit(""))).cast("binary"))


def bucket_digits(rows: int) -> int:
    """Hex digits of the order key that split ``rows`` rows into groups of about BUCKET_ROWS, three at least."""
    return max(3, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16)))


def plan_tasks(rows: int) -> int:
    """Tasks, and so checkpoint files, that sums of ``rows`` rows are kept in: one per PLAN_ROWS rows, eight at least.

    Sums per group are few and short; a file for every shuffle partition would be empty or hold a few rows.
    """
    return max(8, math.ceil(rows / PLAN_ROWS))


def sized(docs: DataFrame, seed: int = SEED, carry: bool = False, digits: int = 3) -> DataFrame:
    """(skey, source, bucket, okey, doc_id, size[, doc]): what the apportionment reads of each document.

    ``skey`` is the source with null made a value of its own; with ``carry`` the whole input row comes
    along as the struct ``doc``.
    """
    cols = [F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("skey"),
            F.col("source"), order_key(seed).alias("okey"), F.col("doc_id"), word_count(F.col("text")).alias("size")]
    if carry:
        cols.append(F.struct("*").alias("doc"))
    return docs.select(*cols).withColumn("bucket", F.substring("okey", 1, digits))


def cycling_weights(sources: DataFrame) -> DataFrame:
    """Sources ordered by code point, null last, weigh 1, 2, 3, repeating."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("rank", rank).withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("long"))


def targets(sources: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Target words per source: shares by ``weight`` of all words, stopped at ``max_repeat`` times the size.

    ``sources`` has one row per source: (source, source_size, rank, weight). Resharing the excess by
    weight until no source is above its stop ends where every stopped source has the smaller ratio
    stop / weight, so one ordered pass over the sources finds it.
    """
    cap = F.lit(max_repeat) * F.col("source_size")
    by_ratio = W.orderBy((cap / F.col("weight")), "rank")
    before, from_here = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    s = (sources.withColumn("cap", cap)
         .withColumn("total", F.sum("source_size").over(everything))
         .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("weights_left", F.sum("weight").over(from_here))
         .withColumn("stopped", F.col("cap").cast("double") * F.col("weights_left")
                     <= F.col("weight").cast("double") * (F.col("total") - F.col("caps_before")))
         .withColumn("rest", F.col("total") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("cap"))).over(everything), F.lit(0)))
         .withColumn("rest_weight", F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(everything)))
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(
        F.col("weight").cast("double") * F.col("rest") / F.col("rest_weight"))
    return s.select(*sources.columns, "cap", target.alias("target"))


def quotas(target: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """(source, rank, shard, first_block, quota): whole blocks each source gives each shard.

    House k of ``shards`` has floor(N k / shards) of the N blocks. A source's award for a house of n
    blocks lies between target (n -+ m/2) / T rounded, m the number of sources, so only about two
    candidate blocks per source are ranked by quotient; all blocks below that range are awarded.
    """
    everything = W.partitionBy()
    t = (target.withColumn("sum_target", F.sum("target").over(everything))
         .withColumn("m", F.count(F.lit(1)).over(everything))
         .withColumn("seats", F.round(F.sum("target").over(everything) / block).cast("long"))
         .withColumn("most", F.ceil(F.col("cap") / block).cast("long"))
         .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
         .withColumn("house", F.floor((F.col("shard") + 1) * F.col("seats") / shards).cast("long")))
    share = F.when(F.col("sum_target") > 0, F.col("target") / F.col("sum_target")).otherwise(F.lit(0.0))
    low = F.floor(share * (F.col("house") - F.col("m") / 2) - 2)
    high = F.ceil(share * (F.col("house") + F.col("m")) + 2)
    t = (t.withColumn("low", F.greatest(F.lit(0), F.least(low, F.col("most"))).cast("long"))
         .withColumn("high", F.greatest(F.col("low"), F.least(high, F.col("most"))).cast("long"))
         .withColumn("left", F.col("house") - F.sum("low").over(W.partitionBy("shard"))))
    seat = F.explode(F.when(F.col("high") > F.col("low"), F.sequence(F.col("low"), F.col("high") - 1))
                     .otherwise(F.array().cast("array<bigint>")))
    best = W.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "rank", "k")
    won = (t.select("source", "rank", "shard", "target", "left", seat.alias("k"))
           .withColumn("place", F.row_number().over(best)).filter("place <= left")
           .groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("won")))
    upto = (t.join(won, ["rank", "shard"], "left")
            .select("source", "rank", "shard", (F.col("low") + F.coalesce(F.col("won"), F.lit(0))).alias("upto")))
    by_source = W.partitionBy("rank").orderBy("shard")
    first = F.coalesce(F.lag("upto").over(by_source), F.lit(0))
    return (upto.withColumn("first_block", first)
            .select("source", "rank", "shard", "first_block", (F.col("upto") - F.col("first_block")).alias("quota")))


def plan(parts: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS,
         max_repeat: int = MAX_REPEAT) -> tuple[DataFrame, DataFrame]:
    """From sums per (skey, source, bucket): start of each bucket, and the sources with target and shard bounds.

    ``bounds`` holds where the words of each shard begin and end in the source's order: shard s takes bounds[s] to bounds[s + 1].
    """
    src = targets(cycling_weights(parts.groupBy("source", "skey").agg(F.sum("words").alias("source_size"))), max_repeat)
    ends = quotas(src, block, shards).groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("shard", (F.col("first_block") + F.col("quota")).alias("upto")))).alias("ends"))
    words = F.transform("ends", lambda e: F.least(e["upto"] * block, F.col("cap")).cast("long"))  # one entry per shard
    src = src.join(ends, "rank").select("skey", "source_size", "target", F.concat(F.array(F.lit(0).cast("long")), words).alias("bounds"))
    order = W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("words").over(order), F.lit(0))).select("skey", "bucket", "start")
    return starts.join(src, "skey"), src


def mix(docs: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED,
        max_repeat: int = MAX_REPEAT, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, shard_words[, doc].

    A document at words [p, p + size) of its source's order stands there again at p + e * source_size in every round e. A shard
    takes of it the words that lie in its run of the source's blocks; a block that ends inside it takes the part before the
    cut. ``shard_words`` lists these words by shard, comma-joined.
    """
    n = docs.count()
    digits, tasks = bucket_digits(n), plan_tasks(n)
    parts = cut(sized(docs, seed, digits=digits).groupBy("skey", "source", "bucket").agg(F.sum("size").alias("words")).coalesce(tasks))
    starts, _ = plan(parts, block, shards, max_repeat)
    rows = sized(docs, seed, carry, digits).join(cut(starts.coalesce(tasks)), ["skey", "bucket"])
    before = W.partitionBy("skey", "bucket").orderBy("okey", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(before), F.lit(0)))

    def words(shard: int) -> Column:
        low, high = F.col("bounds")[shard], F.col("bounds")[shard + 1]
        return sum((F.greatest(F.lit(0), F.least(F.col("at") + e * F.col("source_size") + F.col("size"), high) - F.greatest(F.col("at") + e * F.col("source_size"), low))
                    for e in range(max_repeat)), F.lit(0).cast("long"))

    rows = rows.withColumn("shard_words", F.array(*[words(i) for i in range(shards)]))
    taken = F.aggregate("shard_words", F.lit(0).cast("long"), lambda a, x: a + x)
    out = ["doc_id", "size", "source_size", "target", taken.alias("taken"), F.array_join(F.transform("shard_words", lambda x: x.cast("string")), ",").alias("shard_words")]
    return rows.select(*out, *(["doc"] if carry else []))


def apply_mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: each row as often as its words are taken, to the nearest whole document.

    A row of which under half is taken is left out; one taken twice appears twice. The columns are the input's.
    """
    mixed = mix(docs, carry=True, **settings)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")).otherwise(F.lit(0))
    copies = mixed.select("doc", F.explode(F.array_repeat(F.lit(1), times)).alias("copy"))
    return copies.select("doc.*")
