"""Grain-safe relational operators.

Each function is a thin composition of DataFrame operations whose *shape* matters: aggregate a
many-to-many bridge before joining it, aggregate every fact on its own before combining, keep a
semi-additive measure from being summed across snapshots, and so on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = [
    "orphans", "reconcile", "compare_by_key", "duplicates", "duplicate_groups",
    "universe", "report", "unpivot", "top_k", "extreme", "at_latest",
    "semi_additive", "listagg", "list_rows", "combine_signals",
]


def orphans(child: DataFrame, parent: DataFrame, child_key: str | Sequence[str],
            parent_key: str | Sequence[str] | None = None) -> DataFrame:
    """Child rows whose (possibly composite) foreign key has no parent (JN7): a left-anti
    join, so no parent row is ever materialised next to its children."""
    ck = [child_key] if isinstance(child_key, str) else list(child_key)
    pk = ck if parent_key is None else ([parent_key] if isinstance(parent_key, str) else list(parent_key))
    p = parent.select(*[F.col(k).alias(f"_pk{i}") for i, k in enumerate(pk)])
    cond = [child[c] == p[f"_pk{i}"] for i, c in enumerate(ck)]
    return child.join(p, cond, "left_anti")


RECONCILE_BUCKETS = 1 << 14  # a power of two; the most rows a task sends before the keys that may differ are known


def reconcile(curated: DataFrame, raw: DataFrame, key: str, column: str,
              raw_column: str | None = None) -> DataFrame:
    """Rows checked and mismatches of one column between two tables on their key (JN9).

    ``rows_checked`` are the curated rows whose key is in both tables, ``mismatches`` those of them whose key does not
    hold the same values on both sides. Two NULLs count as equal, and keys may repeat.

    The rows are compared twice: by buckets of keys, which are a bounded number of sums per task, and then by key in those
    buckets whose two sides are not the same multiset of keys and values. Rows of the others are never shuffled by their key:
    all their keys are in both tables and agree. Tables that differ everywhere are compared by key as a whole."""
    rows = _stacked(curated, raw, [key], {"v": (column, raw_column or column)})
    # never NULL, so that no filter on it reaches the scans and both passes share the sides' shuffles
    rows = rows.withColumn("_bucket", F.xxhash64(key).bitwiseAND(F.lit(RECONCILE_BUCKETS - 1)))
    entry = F.xxhash64(F.col(key).isNull(), F.col(key), F.col("_h_v"))
    buckets = _compared(rows.withColumn("_h_v", entry), ["_bucket"], ["v"])
    differing = F.broadcast(buckets.filter(~F.col("same_v")).select("_bucket"))
    by_key = _compared(rows.join(differing, "_bucket"), [key], ["v"]).filter((F.col("left_rows") > 0) & (F.col("right_rows") > 0))
    found = report([d.select("left_rows", F.when(F.col("same_v"), F.lit(0)).otherwise(F.col("left_rows")).alias("unlike"))
                    for d in (buckets.filter("same_v"), by_key)])
    return found.agg(F.coalesce(F.sum("left_rows"), F.lit(0)).alias("rows_checked"),
                     F.coalesce(F.sum("unlike"), F.lit(0)).alias("mismatches"))


def compare_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Both sides' rows per key, and per name of ``columns`` (left column, right column) whether the key holds the same
    values equally often on both (``same_<name>``), in any order.

    The sides are stacked and grouped once: per key and column the sum of the hashes of the left values less that of the right ones
    is nought where both hold the same multiset. No row of one side ever meets one of the other, so repeated keys do not fan out and a
    key held by a third of the rows is a few numbers per task."""
    return _compared(_stacked(left, right, keys, columns), keys, list(columns))


def _stacked(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The rows of both sides: keys, ``_left``, and per name of ``columns`` the hash of its value (``_h_<name>``)."""
    def side(df: DataFrame, pick: int) -> DataFrame:
        # the type of the column is hashed with its value: 1 and 1.0 differ unless the caller casts one of them
        hashes = [F.xxhash64(F.col(c[pick]).isNull(), F.col(c[pick])).alias(f"_h_{n}") for n, c in columns.items()]
        return df.select(*keys, F.lit(pick == 0).alias("_left"), *hashes)

    return side(left, 0).unionByName(side(right, 1))


def _compared(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Stacked rows grouped by keys: both sides' rows, and per name whether the hashes of both are the same multiset."""
    left_row = F.col("_left")
    differences = []
    for n in names:
        h = F.col(f"_h_{n}")
        # halves of the hash are summed apart, so that no sum overflows
        for name, half in (("hi", F.shiftright(h, 32)), ("lo", h.bitwiseAND(F.lit(0xFFFFFFFF)))):
            differences.append(F.sum(F.when(left_row, half).otherwise(-half)).alias(f"_{name}_{n}"))
    grouped = rows.groupBy(*keys).agg(
        F.count_if(left_row).alias("left_rows"), F.count_if(~left_row).alias("right_rows"), *differences)
    same = F.col("left_rows") == F.col("right_rows")
    return grouped.select(*keys, "left_rows", "right_rows",
                          *[(same & (F.col(f"_hi_{n}") == 0) & (F.col(f"_lo_{n}") == 0)).alias(f"same_{n}") for n in names])


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grain keys that occur more than once, with their count (AGG15)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
            .filter(F.col("row_count") > 1))


def duplicate_groups(df: DataFrame, keys: Sequence[str], checks: Mapping[str, Column]) -> DataFrame:
    """Several grain checks of one derivation in one pass: (check_name, duplicate_groups), the keys that occur more than once (AGG15).

    A check is the number of times that a row occurs in the table checked: 1 for the derivation itself, the product of its parents'
    copies for a join of it with them."""
    per_key = df.groupBy(*keys).agg(*[F.sum(times).alias(name) for name, times in checks.items()])
    found = per_key.agg(*[F.count_if(F.col(f"`{name}`") > 1).alias(name) for name in checks])
    return found.unpivot([], [f"`{name}`" for name in checks], "check_name", "duplicate_groups")


def universe(dfs: Sequence[DataFrame], cols: Sequence[str]) -> DataFrame:
    """UNION (distinct) of the same key columns from several tables (SET2)."""
    return reduce(DataFrame.unionByName, [d.select(*cols) for d in dfs]).distinct()


def report(dfs: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL of labelled check rows into one report (SET1)."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str],
            variable: str = "measure", value: str = "value") -> DataFrame:
    """Wide to long (SET4)."""
    return df.unpivot(list(ids), list(values), variable, value)


def top_k(df: DataFrame, order_by: Sequence[Column], k: int) -> DataFrame:
    """Global top-k by an order (WIN2). Planned as TakeOrderedAndProject: each task keeps k."""
    return df.orderBy(*order_by).limit(k)


def extreme(df: DataFrame, label: str, value: str, ascending: bool = True) -> DataFrame:
    """The row with the lowest (or highest) value; NULL values last, ties by label (ORD4)."""
    v = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    return df.orderBy(v, F.col(label).asc()).limit(1)


def at_latest(df: DataFrame, date_col: str, latest: Column) -> DataFrame:
    """Rows at the latest date (PRJ12). ``latest`` is a scalar subquery over the narrowest source that
    knows the date, so the surface itself is derived once, and only for that date: the filter is on a
    grouping column, which the optimiser moves below the aggregation and its shuffles."""
    return df.filter(F.col(date_col) == latest)


def semi_additive(df: DataFrame, group_by: Sequence[str], date_col: str,
                  aggs: Mapping[str, Column]) -> DataFrame:
    """Semi-additive aggregate (SA1): additive over every dimension except ``date_col``.

    If the date is one of the groups, this is a plain aggregate. Otherwise stage 1 aggregates
    per (groups, date) — partial aggregation before the shuffle — and stage 2 keeps, per group,
    the value at that group's latest date (``max_by``), never summing across dates.
    """
    group_by = list(group_by)
    named = [c.alias(n) for n, c in aggs.items()]
    if date_col in group_by:
        return df.groupBy(*group_by).agg(*named)
    stage1 = df.groupBy(*group_by, date_col).agg(*named)
    # one pick per measure: of numbers these are hash aggregates, while a struct of them would be sorted first
    return stage1.groupBy(*group_by).agg(*[F.max_by(n, date_col).alias(n) for n in aggs])


def listagg(df: DataFrame, keys: Sequence[str], value: Column, order: Column, sep: str = ", ",
            chunk: Column | None = None, extra: Sequence[tuple[str, Column, str]] = ()) -> DataFrame:
    """Ordered string aggregation per key (AGG13).

    With ``chunk`` (a monotone function of ``order``, e.g. ``order div 4096``) the work is done
    in two stages so no stage sorts more than one chunk's rows per group: stage 1 builds the
    ordered string of each (key, chunk); stage 2 joins the chunk strings in chunk order.
    ``extra`` carries additional decomposable aggregates as (name, stage-1 column, stage-2
    function name) triples, e.g. ("n", F.count(lit(1)), "sum").
    """
    item = F.struct(order.alias("o"), value.cast("string").alias("v"))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["v"]), sep)
    if chunk is None:
        return df.groupBy(*keys).agg(ordered(item).alias("listagg"),
                                     *[c.alias(n) for n, c, _ in extra])
    stage1 = df.groupBy(*keys, chunk.alias("_chunk")).agg(
        ordered(item).alias("_part"), *[c.alias(n) for n, c, _ in extra])
    part = F.struct(F.col("_chunk").alias("o"), F.col("_part").alias("v"))
    return stage1.groupBy(*keys).agg(ordered(part).alias("listagg"),
                                     *[getattr(F, fn)(n).alias(n) for n, _, fn in extra])


def list_rows(df: DataFrame, keys: Sequence[str], value: Column, order: Column, chunk: Column, sep: str = ", ") -> DataFrame:
    """Ordered list per key as rows (AGG13 for lists without a bound): keys, chunk, position (of the chunk's first item in the key's
    list, from 1), items (their number) and ``part`` (the items joined).

    ``chunk`` is a monotone function of ``order`` with a bounded number of rows, so no group grows with the list; a part's position is
    the number of items in the key's chunks before it, from a window over one row per chunk. Joined in the order of their positions, the
    parts of a key are its list."""
    item = F.struct(order.alias("o"), value.cast("string").alias("v"))
    parts = df.groupBy(*keys, chunk.alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["v"]), sep).alias("part"), F.count(F.lit(1)).alias("items"))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, "chunk", (F.coalesce(F.sum("items").over(before), F.lit(0)) + 1).alias("position"), "items", "part")


def combine_signals(parts: Sequence[DataFrame], key: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregate several facts to a shared key in ONE pass (JN12): the row-level inputs of each
    fact are unioned (missing inputs NULL) and a single groupBy computes every signal. The
    key universe falls out of the union, partial aggregation runs before the only shuffle,
    and no fact is ever joined to another."""
    cols = []
    for p in parts:
        for c in p.columns:
            if c not in cols:
                cols.append(c)
    aligned = [p.select(*[F.col(c) if c in p.columns else F.lit(None).alias(c) for c in cols])
               for p in parts]
    # give NULL literals the type of the column where it exists
    types = {}
    for p in parts:
        for f in p.schema.fields:
            types.setdefault(f.name, f.dataType)
    aligned = [a.select(*[F.col(c).cast(types[c]).alias(c) for c in cols]) for a in aligned]
    return reduce(DataFrame.unionByName, aligned).groupBy(*key).agg(*aggs)
