import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from supplymetrics.session import LOCAL_DEFAULTS, checkpoint_dir
    b = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
    for k, v in LOCAL_DEFAULTS.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def small(spark):
    from supplymetrics.sources.adapters import Tables
    return Tables.of(spark, SMALL)


@pytest.fixture(scope="session")
def dirty(spark, tmp_path_factory):
    """The small tables with five lines whose order, part and supplier do not exist."""
    from supplymetrics.sources.adapters import DRIVER_TABLES, Tables
    folder = tmp_path_factory.mktemp("dirty")
    for name in DRIVER_TABLES:
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    from pyspark.sql import functions as F
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    lost = lines.limit(5).withColumns({c: F.col(c) + 10_000_000 for c in ("l_orderkey", "l_partkey", "l_suppkey")})
    lost.write.mode("append").parquet(f"{folder}/lineitem.parquet")
    return Tables.of(spark, str(folder))
