"""Sharding by Hilbert-curve ordering of several metadata dimensions.

Every document is a cell of a grid (source, language, size); cells are numbered along a Hilbert curve,
documents are sorted by that number and cut into equal runs, so the files of a shard cover a compact box in
all dimensions at once and can be pruned by each. Every dimension is quantised by the mass of rows before a value, strings
in code point order, sizes in steps of a 64th of a power of two, so neither the order of arrival nor the range of sizes matters:
books among short texts have cells of their own as far as they are a share of the rows.

Scale: the sort is a range partitioning by (curve index, text hash, id), which spreads a hot
cell over many tasks; ranks come from the counts of the sorted partitions, kept in a checkpoint so that
a retried task cannot renumber them. Texts are read once and never shuffled. The masses before a value come from
running totals over range partitions; the one window over all rows of a table runs over a row per partition.

Defined results: a null in a dimension is its own value, before all others; a null text has 1 byte of size and
CRC 0; equal texts of a cell stand next to each other; rows repeated with the same id and text are
interchangeable; fewer rows than shards leave shards empty; an empty table gives an empty result; other
columns are not read. Shard counts differ by one at most (law ``rows``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from supplymetrics.llm.common import cut, ranked, running_total, small_side

SHARDS = 16
BITS = 5
STRING_DIMENSIONS = ("source", "lang")


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    return F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")


def size_step(size: Column) -> Column:
    """Sizes in steps of a 64th of a power of two, some 2,000 in all."""
    return F.floor(64 * F.log2(size.cast("double"))).cast("int")


def value_cells(rows: DataFrame, name: str, bits: int) -> DataFrame:
    """(value, cell) of a dimension: the share of rows before the middle of the value, in 2 ** bits steps."""
    counts = rows.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = F.lit(rows.count())
    return running_total(counts, "value", "n", "before").select(
        "value", F.least(F.floor((F.col("before") + F.col("n") / 2) / total * (1 << bits)), F.lit((1 << bits) - 1)).cast("int").alias("cell"))


def hilbert_index(axes: Sequence[Column], bits: int) -> Column:
    """Position along the Hilbert curve of a cell, one integer column per dimension.

    From the highest bit down every level swaps or inverts the lower bits of the axes (the turn of the
    sub-cube), then the bits are Gray-decoded and interleaved, axis by axis.
    """
    return F.expr(_index_sql(len(axes), bits, [f"cell_{i}" for i in range(len(axes))]))


def _index_sql(n: int, bits: int, names: list[str]) -> str:
    # One lambda variable per axis state keeps each level's result from being expanded again.
    body, opened = "", 0

    def bind(expression: str, variable: str) -> None:
        nonlocal body, opened
        body += f"transform(array({expression}), {variable} -> "
        opened += 1

    bind("named_struct(" + ", ".join(f"'x{i}', {c}" for i, c in enumerate(names)) + ")", "s0")
    step = 0

    def update(**new: str) -> None:
        nonlocal step
        fields = ", ".join(f"'x{i}', {new.get(f'x{i}', f's{step}.x{i}')}" for i in range(n))
        bind(f"named_struct({fields})", f"s{step + 1}")
        step += 1

    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            s = f"s{step}"
            turned = f"({s}.x{i} & {q}) <> 0"
            swap = f"(({s}.x0 ^ {s}.x{i}) & {low})"
            if i == 0:
                update(x0=f"if({turned}, {s}.x0 ^ {low}, {s}.x0)")
            else:
                update(x0=f"if({turned}, {s}.x0 ^ {low}, {s}.x0 ^ {swap})",
                       **{f"x{i}": f"if({turned}, {s}.x{i}, {s}.x{i} ^ {swap})"})
    for i in range(1, n):
        update(**{f"x{i}": f"s{step}.x{i} ^ s{step}.x{i - 1}"})
    s = f"s{step}"
    flip = " ^ ".join(f"if(({s}.x{n - 1} & {1 << k}) <> 0, {(1 << k) - 1}, 0)" for k in range(1, bits)) or "0"
    bind(flip, "t")
    bits_of = [f"shiftleft(cast(shiftright({s}.x{i} ^ t, {k}) & 1 as bigint), {k * n + n - 1 - i})"
               for k in range(bits) for i in range(n)]
    body += " + ".join(bits_of) + ")" * opened
    return body + "[0]" * opened


def row_key(docs: DataFrame) -> Column:
    """Hash of all columns of a row."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def assign(docs: DataFrame, shards: int = SHARDS, bits: int = BITS,
           dimensions: Sequence[str] = STRING_DIMENSIONS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, curve_index, row_key, shard (0 to shards - 1), slot (gapless from 0).

    ``row_key`` hashes all columns of the document, for ``in_shards``.
    """
    rows = cut(docs.select("doc_id", text_bytes(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"),
                           F.xxhash64("text").alias("text_key"),
                           row_key(docs).alias("row_key"),
                           *[F.col(c).cast("string").alias(f"dim_{i}") for i, c in enumerate(dimensions)],
                           size_step(text_bytes(F.col("text"))).alias(f"dim_{len(dimensions)}")))
    placed = rows
    for i in range(len(dimensions) + 1):
        cells = small_side(cut(value_cells(rows, f"dim_{i}", bits))).withColumnRenamed("cell", f"cell_{i}")
        placed = placed.join(cells, placed[f"dim_{i}"].eqNullSafe(cells["value"])).drop("value")
    axes = [F.col(f"cell_{i}") for i in range(len(dimensions) + 1)]
    keys = ["curve_index", "text_key", "doc_id", "row_key"]
    ordered = placed.select("doc_id", "size", "text_crc32", "text_key", "row_key", hilbert_index(axes, bits).alias("curve_index"))
    ranked_rows = ranked(ordered, *keys).withColumn("total", F.lit(rows.count()))
    shard = F.expr(f"cast(rank * {shards} div total as int)")
    # shard s starts at the first rank r with floor(r * shards / total) = s
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return (ranked_rows.withColumn("shard", shard)
            .select("doc_id", "size", "text_crc32", "curve_index", "text_key", "row_key", "shard", (F.col("rank") - first).cast("long").alias("slot")))


def in_shards(docs: DataFrame, **settings) -> DataFrame:
    """The documents with their shard and slot (columns of those names are replaced), texts shuffled once.

    Rows equal in every column are interchangeable: each place of theirs gets the same row.
    """
    places = assign(docs, **settings).select("text_key", "row_key", F.struct("shard", "slot").alias("place"))
    rows = docs.select(F.xxhash64("text").alias("text_key"), row_key(docs).alias("row_key"),
                       F.struct(*[c for c in docs.columns if c not in ("shard", "slot")]).alias("doc"))
    return rows.dropDuplicates(["text_key", "row_key"]).join(places, ["text_key", "row_key"]).select("doc.*", "place.*")
