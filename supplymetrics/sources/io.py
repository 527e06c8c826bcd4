"""Layered storage and hand-off helpers (SRC1, SRC3, SRC6-SRC10).

Layers are folders under one root (``raw/``, ``curated/``, ``semantic/``); tables are Parquet.
Writes go through Spark's committers, so a failed or retried task never leaves partial files
behind, and a rebuild (overwrite) makes every load idempotent.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplymetrics.sources.adapters import FrameTables, Tables
from supplymetrics.sources.schemas import SCHEMAS, enforce

LAYERS = ("raw", "curated", "semantic")

# Entity tables written partitioned by a date column, so date filters prune whole folders.
PARTITION_BY = {"inventory": "snapshot_date", "production": "production_date"}


def layers(root: str) -> dict[str, str]:
    """SRC1 — layer name -> folder."""
    root = root.rstrip("/")
    return {name: f"{root}/{name}" for name in LAYERS}


def table(spark: SparkSession, root: str, layer: str, name: str) -> DataFrame:
    """SRC3 — scan a table by layer and name, with its declared schema when it has one."""
    path = f"{layers(root)[layer]}/{name}"
    reader = spark.read
    if layer == "raw" and name in SCHEMAS and name not in PARTITION_BY:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(path).drop(BATCH)


def rows(spark: SparkSession, name: str, data: list[tuple]) -> DataFrame:
    """SRC4 — literal rows typed by the declared schema of ``name``; dates may be ISO strings."""
    dates = [isinstance(f.dataType, T.DateType) for f in SCHEMAS[name].fields]
    typed = [tuple(dt.date.fromisoformat(v) if d and isinstance(v, str) else v for v, d in zip(row, dates, strict=True)) for row in data]
    return spark.createDataFrame(typed, SCHEMAS[name])


def row_source(spark: SparkSession, n: int) -> DataFrame:
    """SRC5 — n generated rows with a 1-based sequence column ``seq``."""
    return spark.range(1, n + 1).withColumnRenamed("id", "seq")


def rebuild(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """SRC7 — full rebuild (overwrite). Idempotent: rerunning gives the same table."""
    if partition_by:  # few files per folder; AQE splits the rows of a large folder over several tasks
        df = df.hint("rebalance", partition_by)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


BATCH = "batch_id"


def append(df: DataFrame, path: str, batch: str | None = None) -> None:
    """SRC6 — append rows; the first write creates the table. Columns are matched by name, and a column
    that is missing, unknown or of another type raises, so a folder never holds two schemas.

    With a ``batch`` id the load can be repeated: a batch is a folder of its own that Spark's committer replaces as a whole, so
    the same batch written again, after a failure or by a second scheduler, gives its rows once. A table takes either
    batches or bare appends, never both."""
    spark = df.sparkSession
    try:
        existing = spark.read.parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        existing = None
    if existing is not None and (BATCH in existing.names) != (batch is not None):
        raise ValueError(f"{path} is loaded {'in batches' if batch is None else 'without batches'}; the two do not mix")
    have = {f.name: f.dataType for f in df.schema.fields}
    want = have if existing is None else {f.name: f.dataType for f in existing.fields if f.name != BATCH}
    if have != want:
        differ = sorted(c for c in {*have, *want} if have.get(c) != want.get(c))
        raise ValueError(f"cannot append to {path}: columns {differ} differ")
    if batch is None:
        df.select(*want).write.mode("append").parquet(path)
    else:
        (df.select(*want, F.lit(str(batch)).alias(BATCH)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BATCH).parquet(path))


def write_raw_layer(t: Tables, root: str, names=None, strict: bool = False) -> None:
    """Materialise the entity tables once (SRC7) so later jobs read them instead of
    re-deriving them; executor loss during a later job then only re-reads Parquet.

    ``strict`` refuses a row that lacks a value its schema demands; without it such rows stay visible to the integrity job."""
    raw = layers(root)["raw"]
    for name in names or Tables.ENTITIES:
        df = t.table(name)
        rebuild(enforce(df, name) if strict else df, f"{raw}/{name}", PARTITION_BY.get(name))


def read_raw_layer(spark: SparkSession, root: str, names=None) -> FrameTables:
    """Entity tables read back from a materialised raw layer."""
    frames = {n: table(spark, root, "raw", n) for n in (names or Tables.ENTITIES)}
    return FrameTables(spark, frames)


def register_surface(name: str, df: DataFrame) -> DataFrame:
    """SRC8 — named view over a plan (lazy; re-evaluated by every query that uses it)."""
    df.createOrReplaceTempView(name)
    return df


def _versions(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Folder and time of commit (ms) of every complete version under ``path``, the oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for entry in fs.listStatus(root) if fs.exists(root) else []:
        done = hadoop.Path(entry.getPath(), "_SUCCESS")  # written last by Spark's committer
        if entry.isDirectory() and entry.getPath().getName().startswith("version-") and fs.exists(done):
            found.append((entry.getPath().toString(), fs.getFileStatus(done).getModificationTime()))
    return sorted(found)


def current(spark: SparkSession, path: str, max_age: float | None = None) -> DataFrame | None:
    """The newest complete version of a materialised result, if there is one (not older than ``max_age`` seconds). The scan
    stays on that version whatever is materialised later."""
    versions = _versions(spark, path)
    if not versions or (max_age is not None and time.time() - versions[-1][1] / 1000 > max_age):
        return None
    return spark.read.parquet(versions[-1][0])


def materialise(df: DataFrame, path: str, max_age: float | None = None) -> DataFrame:
    """SRC9 — refreshable result: a scan of its newest version, written anew unless one of at most ``max_age`` seconds exists.

    Every refresh is a folder of its own, complete when Spark's commit marker is there, so readers see the old version or
    the new one, and scans that they hold keep theirs until ``prune``. Between jobs this replaces a time-based cache; the copies
    lie on shared storage and survive executor loss."""
    spark = df.sparkSession
    kept = None if max_age is None else current(spark, path, max_age)
    if kept is not None:
        return kept
    version = f"{path.rstrip('/')}/version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(version)
    return spark.read.parquet(version)


def prune(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions; scans of the deleted ones fail from then on. Returns how many went."""
    old = _versions(spark, path)[:-keep] if keep else _versions(spark, path)
    for folder, _ in old:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(old)


def to_rows(df: DataFrame, limit: int = 1000):
    """SRC10 — hand a final, small aggregate to the driver as pandas; more than ``limit`` rows raise."""
    out = df.limit(limit + 1).toPandas()
    if len(out) > limit:
        raise ValueError(f"the result has more than {limit} rows; aggregate it further or raise the limit")
    return out
