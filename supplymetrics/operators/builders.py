"""Dataset builders: calendar, dense surrogate keys, systematic samples, rate lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplymetrics.functions import exprs as X
from supplymetrics.sources.schemas import conform


def _date(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("date")


def calendar(spark: SparkSession, start, end) -> DataFrame:
    """Calendar dimension, one row per day in [start, end] (BLD1).

    ``start``/``end`` are dates, ISO strings or scalar Columns (e.g. scalar subqueries over
    the facts, so the calendar follows the data). Day names are three-letter, ISO week and
    ISO weekday (Monday = 1).
    """
    d = F.col("calendar_date")
    df = (spark.range(1)
          .select(F.explode(F.sequence(_date(start), _date(end))).alias("calendar_date"))
          .select(F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), d,
                  F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
                  F.date_format(d, "MMM").alias("month_name"),
                  F.weekofyear(d).alias("week_of_year"),
                  (F.weekday(d) + 1).alias("day_of_week"),
                  F.date_format(d, "EEE").alias("day_name"),
                  (F.weekday(d) >= 5).alias("is_weekend")))
    return conform(df, "date_dim")


def sample_mod(df: DataFrame, expr: Column, k: int) -> DataFrame:
    """Systematic sample: rows whose ``expr`` is divisible by ``k`` (BLD8). Pushed to the scan
    when ``expr`` is a plain column."""
    return df.filter(F.pmod(expr, F.lit(k)) == 0)


def apply_rate(df: DataFrame, rates: DataFrame, key: str, qty: str, rate: str = "rate",
               out: str = "adjusted_quantity") -> DataFrame:
    """Lookup a rate per key and emit greatest(0, round(qty * (1 - rate))) (BLD9).

    ``rates`` is a lookup keyed by ``key``; rows without a rate keep their quantity. The join
    is left to the planner (AQE broadcasts it when the measured lookup is small)."""
    r = rates.select(key, F.col(rate).alias("_rate"))
    # greatest() skips NULLs, so a missing quantity is kept missing explicitly
    adjusted = F.when(F.col(qty).isNotNull(), F.greatest(
        F.lit(0.0), X.dround(F.col(qty) * (F.lit(1.0) - F.coalesce("_rate", F.lit(0.0))), 0)))
    return df.join(r, key, "left").withColumn(out, adjusted).drop("_rate")


def surrogate_key(df: DataFrame, order_by: Sequence[str], name: str, prefix: str = "",
                  width: int = 0, num_partitions: int | None = None) -> DataFrame:
    """Dense, ordered surrogate key: ``prefix`` and the row number, zero-padded to ``width`` (longer
    numbers keep all digits), over a total order (BLD3) without pulling all rows into one task.

    1. range-partition on the order and sort inside partitions;
    2. checkpoint to the shared checkpoint folder, so partition contents are fixed for the two
       passes below (a recomputed range shuffle could place rows differently);
    3. a row's position in its partition is the low part of ``monotonically_increasing_id``;
    4. rows per partition (one small row per partition) give the starting offsets.

    ``order_by`` must be a total order (append a unique column on ties).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    from supplymetrics.session import checkpoint_dir
    checkpoint_dir(spark)
    ranged = (df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by).checkpoint(eager=True)
              .withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({"_pid": F.shiftright("_at", 33), "_pos": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # offsets: rows in all lower partitions; the window runs over one row per partition
    prior = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_off"))
    number = F.col("_off") + F.col("_pos") + 1
    digits = number.cast("string")
    if width:
        digits = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    key = F.concat(F.lit(prefix), digits) if prefix or width else number
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, key).drop("_at", "_pid", "_pos", "_off"))


def fill_months(df: DataFrame, keys: Sequence[str], date_col: str, until: Column) -> DataFrame:
    """Monthly snapshots without gaps (BLD2): a row also stands for the months up to the next row of its key, the
    last row of a key for those up to ``until``. Filled rows are dated at their month's end.

    One window per key (at most a row a month) finds where a row's validity ends; its months are then exploded from the
    row itself, so no product of entities and dates is built and nothing is joined back. Rows of one key and month
    each keep their own, the last of them is carried on; a row after ``until`` or without a date stands for itself."""
    d = F.col(date_col)
    following = F.lead(d).over(Window.partitionBy(*keys).orderBy(date_col))
    start = F.trunc(d, "month")
    # the bounds are columns before they are exploded: a generator takes no subquery, and ``until`` may be one
    stop = F.greatest(start, F.coalesce(F.add_months(F.trunc(following, "month"), -1), F.trunc(until, "month")))
    bounded = df.withColumn("_stop", stop).withColumn("_next", F.add_months(start, 1))
    months = F.when(F.col("_stop") >= F.col("_next"), F.sequence("_next", "_stop", F.expr("interval 1 month")))
    each = F.explode(F.concat(F.array(F.lit(None).cast("date")), F.coalesce(months, F.array().cast("array<date>"))))
    return bounded.withColumn("_month", each).withColumn(date_col, F.coalesce(F.last_day("_month"), d)).select(*df.columns)
