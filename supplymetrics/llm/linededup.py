"""Line dedup: lines that occur in many documents are dropped from all of them.

Lines are exploded with their position, normalised and hashed (128 bits); distinct documents are counted
per hash; the positions of lines over the threshold are gathered per document and the text is
reassembled from the other positions. Only hashes, ids and positions are shuffled for the count; texts
are shuffled once, by document.

Scale: a line held by a third of all documents is one partial count per task before the shuffle by
hash, and its rows in the join by hash are split by AQE's skew join (both sides are plain exchanges).
No list is longer than one document has lines.

Defined results: a null or empty text is one empty line; a line is looked up by its key (stripped, A-Z
lowered), and keys shorter than ``min_chars`` are never dropped; a document is its id, so rows repeating an id
count once (null is one id) and each keeps its row; if every line goes the text is empty; an empty
table gives an empty result; other columns are not read, or carried as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplymetrics.llm.common import SPACE_CHARS, ascii_lower, cut

MIN_CHARS = 1
MIN_DOCS = 10


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def _key_hash(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def _doc_key() -> list[Column]:
    return [F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n")).alias("id_key"),
            F.xxhash64("text").alias("text_key")]


def exploded(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id_key, text_key, pos, h1, h2): every line long enough to be dropped."""
    at = docs.select(*_doc_key(), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = at.select("id_key", "text_key", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.length("key") >= min_chars).select("id_key", "text_key", "pos", *_key_hash(F.col("key")))


def common_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2): hashes found in at least ``min_docs`` distinct documents."""
    once = lines.select("h1", "h2", "id_key").distinct()
    return once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per input row: doc (the whole row as struct), n_lines, n_dropped, kept (the text without the dropped lines)."""
    lines = cut(exploded(docs, min_chars))
    gone = (lines.join(cut(common_lines(lines, min_docs)), ["h1", "h2"])
            .groupBy("id_key", "text_key").agg(F.collect_set("pos").alias("gone")))
    rows = docs.select(*_doc_key(), F.struct("*").alias("doc")).join(gone, ["id_key", "text_key"], "left")
    all_lines = lines_of(F.col("doc.text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone"))  # hashed, in order of position
    kept = F.when(F.col("gone").isNull(), F.coalesce("doc.text", F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n"))
    return rows.select("doc", F.size(all_lines).cast("long").alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
