"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from supplymetrics.session import checkpoint_dir

# Fixed by the query contracts: white space is these six characters, words are runs of the others.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(module: str) -> None:
    """Send the functions of ``module`` to Python workers by value.

    Tasks then run on executors that do not have this package on their path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; read by Spark only, so any store that Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the session names."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents no label is learned from (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """True for documents whose label may be learned from (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def small_side(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast a cut table if it has at most ``most`` (short) rows; beyond that the planner shuffles it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ranked(df: DataFrame, *keys: str) -> DataFrame:
    """The rows with their place from 0 (``rank``) in the order of ``keys``, kept in a checkpoint so that no retried task renumbers them.

    Rows are range-partitioned and sorted; a place is that within the partition plus the rows of the partitions before it.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # row i of partition p has the id p * 2 ** 33 + i
    ordered = cut(df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)).withColumn("_at", F.monotonically_increasing_id())
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = cut(counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    # one row per task: broadcast is bounded by the number of partitions
    placed = ordered.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return placed.select(*df.columns, "rank")


def running_total(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The rows with ``name``: the sum of ``value`` over all rows before theirs in the order of ``key`` (nulls first), without a
    window over all rows: sums run within the sorted partitions and start from the totals of the partitions before."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(df.repartitionByRange(tasks, F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first()))
    ordered = ordered.withColumn("_part", F.spark_partition_id())
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = ordered.groupBy("_part").agg(F.sum(value).alias("_n"))
    starts = cut(totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    within = W.partitionBy("_part").orderBy(F.col(key).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    # one row per task: broadcast is bounded by the number of partitions
    placed = ordered.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(within), F.lit(0)))
    return placed.select(*df.columns, name)


def drawn(doc_id: Column, n_label: Column, most: int, seed: int) -> Column:
    """True for about ``most`` of the ``n_label`` ids of a label value, spread evenly by a seeded hash of the id."""
    at = F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 30)) / float(1 << 30)
    return at * n_label < most


def label_counts(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, label) of every learnable id with a label, and (label, n_label). An id labelled twice has its largest label."""
    usable = cut(labels.filter(learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label")).dropna())
    return usable, cut(usable.groupBy("label").agg(F.count(F.lit(1)).alias("n_label")))
