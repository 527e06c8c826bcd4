"""What a task holds and what is shuffled on grown tables: plans of the queries with every parent too large to be broadcast by size."""

import re

import pytest
from pyspark.sql import functions as F

from supplymetrics import session
from supplymetrics.operators.relational import compare_by_key, reconcile, semi_additive
from supplymetrics.plans import dashboard as DSH
from supplymetrics.plans import quality as DQ
from supplymetrics.plans import surfaces as SUR
from supplymetrics.plans.catalog import all_entries
from supplymetrics.plans.verified import run_batch
from supplymetrics.sources.adapters import Tables
from tests.conftest import SMALL


@pytest.fixture
def large(spark):
    """Small tables whose joins are planned as if no table could be broadcast by its size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    t = Tables(spark, SMALL)
    t.bytes = dict.fromkeys(("supplier", "lineitem"), 1)
    yield t
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled_by(df):
    return re.findall(r"Exchange hashpartitioning\((\w+)#", physical(df))


def test_order_lines_are_never_shuffled_by_customer_or_supplier(large):  # sur4, F9
    keys = shuffled_by(SUR.customer_fulfillment(large))
    assert "l_suppkey" not in keys and "s_suppkey" not in keys and keys.count("l_orderkey") == keys.count("l_partkey") == 1, keys
    orders_first = physical(SUR.customer_fulfillment(large))
    assert keys.count("o_custkey") == 1 and orders_first.index("hashpartitioning(o_orderkey") < orders_first.index("hashpartitioning(o_custkey"), keys


def test_the_top_lines_carry_no_attributes(large):  # win2, F10
    df = all_entries()["win2_topk"].build(large)
    keys, p = shuffled_by(df), physical(df)
    assert "l_suppkey" not in keys and keys.count("l_orderkey") == 1 and "c_name" not in p and "c_mktsegment" not in p, keys


def test_both_kpis_scan_the_lines_once(large):  # fn27, F7
    df = DSH.kpi_bands(large)
    assert len(re.findall(r"FileScan parquet \[l_", physical(df))) == 1
    want = [DSH.network_fulfillment_pct(large).first()[0], DSH.network_otd_pct(large).first()[0]]
    assert [(r.kpi, r.value) for r in df.collect()] == list(zip(("fulfillment", "on_time_delivery"), want))


def test_a_batch_proves_the_edges_first(large):  # dsh11, F2
    rows = run_batch(large, ["vq02_gaps_by_family"]).collect()
    assert rows[0].status == "SUCCESS" and large.proven("part", "supplier", "orders", "customer")


def test_grain_checks_meet_customers_with_the_orders(large):  # dq04, F6
    met = physical(DQ.grain_duplicates(large)).split("Exchange hashpartitioning(o_custkey")
    assert len(met) == 2 and "Join" not in met[1].split("Exchange")[0] and "FileScan parquet [o_orderkey" in met[1], met[1][:2000]


def test_comparison_keeps_two_sums_a_column(spark):  # dq10 F5, jn09 F4 and F13
    left = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, None), (3, 5.0), (4, 1.0)], "k int, v double")
    right = spark.createDataFrame([(1, 2.0), (1, 1.0), (2, None), (3, 6.0), (3, 5.0), (5, 1.0)], "k int, v double")
    df = compare_by_key(left, right, ["k"], {"v": ("v", "v")})
    assert "bit_xor" not in physical(df)
    assert {r.k: (r.left_rows, r.right_rows, r.same_v) for r in df.collect()} == {
        1: (2, 2, True), 2: (1, 1, True), 3: (1, 2, False), 4: (1, 0, False), 5: (0, 1, False)}


def test_sides_that_agree_are_not_shuffled_by_key(spark):  # dq10, F5
    left = spark.range(5000).select((F.col("id") % 4000).alias("k"), F.col("id").cast("double").alias("v"))
    right = left.repartition(3)
    df = reconcile(left, right, "k", "v")
    assert df.first()[:] == (5000, 0)
    done = reconcile(left, right, "k", "v")
    done.collect()
    final = physical(done).split("Initial Plan")[0]
    assert "Final Plan" in final and "hashpartitioning(k#" not in final and "hashpartitioning(_bucket#" in final, final


def test_buckets_that_differ_are_compared_by_key(spark):  # dq10 F5, jn09 F13
    rows = [(k, float(k % 7)) for k in range(3000)]
    left = spark.createDataFrame([*rows, (None, 1.0), (None, None), (5, None)], "k int, v double")
    swapped = [(k, v + (k in (10, 20))) for k, v in rows if k != 30]
    right = spark.createDataFrame([*swapped, (None, None), (None, 1.0), (5, None), (9999, 1.0)], "k bigint, v double")
    assert reconcile(left, right, "k", "v").first()[:] == (3002, 2)  # 30 and 9999 are on one side
    # two keys that exchange their values hold the same values between them, yet neither agrees
    assert reconcile(spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double"),
                     spark.createDataFrame([(1, 2.0), (2, 1.0)], "k int, v double"), "k", "v").first()[:] == (2, 2)
    assert reconcile(left.limit(0), right, "k", "v").first()[:] == (0, 0)


def test_both_passes_share_the_sides_shuffles(large):  # dq10, F5
    t = large
    df = reconcile(SUR.customer_fulfillment(t, columns=("order_line_id", "fulfilled_quantity")),
                   t.columns("order_line", "order_line_id", "fulfilled_quantity"), "order_line_id", "fulfilled_quantity")
    df.collect()
    final = physical(df).split("Initial Plan")[0]
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", final)) == 1, final


def test_shipments_share_the_shuffles_of_order_lines(large):  # dq10, F5
    p = physical(SUR.shipment_performance(large, columns=("shipment_id", "shipped_quantity")))
    assert not re.search(r"isnotnull\(concat\(CA0", p)


def test_latest_pick_is_not_sorted(spark):  # sa_on_hand_by_part_plant, F3
    df = spark.createDataFrame([(1, 10, 2.0), (1, 11, 3.0), (1, 11, 4.0), (2, None, 7.0)], "k int, day int, v double")
    out = semi_additive(df, ["k"], "day", {"total": F.sum("v"), "n": F.count(F.lit(1))})
    assert "SortAggregate" not in physical(out)
    assert {tuple(r) for r in out.collect()} == {(1, 7.0, 2), (2, None, None)}


def test_a_products_rows_leave_one_task_together(large):  # sur3, F1
    df = SUR.production_performance(large)
    assert re.search(r"hashpartitioning\(product_id#\d+, \d+\), REPARTITION_BY_NUM", physical(df)) and "SortMergeJoin" in physical(df)
    tasks = df.select("product_id", F.spark_partition_id().alias("task")).distinct().groupBy("product_id").count()
    assert tasks.filter("count > 1").isEmpty()


def test_ordered_rows_of_a_task_do_not_grow(spark):  # bld3, F12
    t = Tables(spark, SMALL)
    t.bytes = {"lineitem": 40 * session.PARTITION_FILE_BYTES}
    df = all_entries()["bld3_surrogate_key"].build(t)
    assert df.select(F.spark_partition_id()).distinct().count() > 30
    assert df.select("po_seq_id").distinct().count() == df.count() == t.purchase_order_line.count()


def test_partitions_follow_the_input(spark):  # F3, F4, F6, F8, F11, F12, F13: a task's rows do not grow with the tables
    key, least = session._INITIAL, int(spark.conf.get("spark.sql.shuffle.partitions"))
    session.fit_partitions(spark, 1)
    assert spark.conf.get(key) == str(least)
    session.fit_partitions(spark, 100 * least * session.PARTITION_FILE_BYTES)
    assert spark.conf.get(key) == str(100 * least)
    spark.conf.set(key, "77")  # a session's own choice stays
    try:
        session.fit_partitions(spark, 1)
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.unset(key)
    Tables.of(spark, SMALL)
    assert spark.conf.get(key) == str(least)
