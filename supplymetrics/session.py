"""Session helpers.

On a cluster the session (and its configuration) comes from the platform; these helpers only
fill in settings that are still unset, so a tuned cluster configuration always wins.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Defaults for local runs and tests. Every key is only applied when the session does not
# already define it.
LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "supplymetrics") -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    builder = builder.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Bytes of the largest table's files that one shuffle partition is planned for; bytes of files in one task of a scan, and the shuffled
# bytes up to which adaptive execution merges partitions again and builds a join's hash table of one side instead of sorting both.
PARTITION_FILE_BYTES = 4 << 20
TASK_SIZES = {"spark.sql.files.maxPartitionBytes": 16 << 20,
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20,
              "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": 16 << 20}
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_FITTED: dict[str, str] = {}  # what was set here, so that it follows the next input and never replaces another's choice


def partitions_for(spark: SparkSession, largest_bytes: int) -> int:
    """Shuffle partitions for an input whose largest table has so many bytes of files; the session's own number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-largest_bytes // PARTITION_FILE_BYTES))


def fit_partitions(spark: SparkSession, largest_bytes: int) -> None:
    """Let the number of shuffle partitions follow the input, so that a task's rows (and its memory) do not grow with it.

    Adaptive execution starts from at least one partition per ``PARTITION_FILE_BYTES`` of the largest table and merges small ones
    again; ``spark.sql.shuffle.partitions`` stays as it is and is the least number. A session's own settings win."""
    wanted = {_INITIAL: str(partitions_for(spark, largest_bytes))} | {k: str(v) for k, v in TASK_SIZES.items()}
    for key, value in wanted.items():
        now = spark.conf.get(key, None)
        if now is None or now == _FITTED.get(key):
            spark.conf.set(key, value)
            _FITTED[key] = value


def _is_local(spark: SparkSession) -> bool:
    try:
        master = spark.sparkContext.master
    except Exception:  # noqa: BLE001 — remote sessions have no SparkContext here
        master = spark.conf.get("spark.master", "")
    return str(master).startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    A folder is only chosen here when the session names none and runs in local mode (tests); on
    a cluster the setting must point at shared storage so checkpoints survive executor loss, and
    a missing setting is an error rather than a silent machine-local folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir is not set: point it at shared storage "
                               "(e.g. an HDFS or object-store folder) before checkpointing")
        import tempfile
        path = tempfile.mkdtemp(prefix="supplymetrics-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 — remote sessions manage checkpoints server-side
        return path
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path
