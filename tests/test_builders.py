"""Builders and I/O helpers."""

import datetime as dt
import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from supplymetrics.functions import exprs as X
from supplymetrics.operators.builders import calendar, surrogate_key
from supplymetrics.operators.relational import duplicates, listagg, semi_additive, top_k
from supplymetrics.sources import io as IO


def test_calendar(spark):
    c = calendar(spark, "2026-06-01", "2026-08-31").collect()
    assert len(c) == 92
    first = c[0]
    assert first.date_key == 20260601 and first.day_name == "Mon" and first.day_of_week == 1
    assert first.month_name == "Jun" and first.quarter == 2 and first.week_of_year == 23
    assert sum(r.is_weekend for r in c) == 26


def test_surrogate_key_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k"), F.lit("x").alias("v"))
    out = surrogate_key(df, ["k"], "sk", prefix="PO-", width=6, num_partitions=7).collect()
    got = sorted((r.k, r.sk) for r in out)
    assert got == [(i, f"PO-{i + 1:06d}") for i in range(5000)]


def test_bucket_is_portable_md5(spark):
    r = spark.range(1).select(X.bucket(F.lit("abc"), 4).alias("b")).collect()[0].b
    assert r == int("900150983cd24fb0d6963f7d28e17f72"[:8], 16) % 4


def test_listagg_two_stage_order(spark):
    df = spark.range(0, 3000).select(F.lit("p").alias("k"), F.col("id").alias("o"))
    one = listagg(df, ["k"], F.col("o"), F.col("o"), ",").collect()[0].listagg
    two = listagg(df, ["k"], F.col("o"), F.col("o"), ",", chunk=F.floor(F.col("o") / 128)).collect()[0].listagg
    assert one == two == ",".join(str(i) for i in range(3000))


def test_semi_additive_equals_plain_sum_with_date(spark):
    df = spark.createDataFrame([("a", dt.date(2026, 1, 1), 1.0), ("a", dt.date(2026, 1, 2), 2.0),
                                ("b", dt.date(2026, 1, 1), 5.0)], "g string, d date, v double")
    with_date = {(r.g, r.d): r.v for r in semi_additive(df, ["g", "d"], "d", {"v": F.sum("v")}).collect()}
    assert with_date == {("a", dt.date(2026, 1, 1)): 1.0, ("a", dt.date(2026, 1, 2)): 2.0,
                         ("b", dt.date(2026, 1, 1)): 5.0}
    latest = {r.g: r.v for r in semi_additive(df, ["g"], "d", {"v": F.sum("v")}).collect()}
    assert latest == {"a": 2.0, "b": 5.0}
    total = semi_additive(df, [], "d", {"v": F.sum("v")}).collect()[0].v
    assert total == 2.0


def test_duplicates_and_topk(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert [(r.k, r.row_count) for r in duplicates(df, ["k"]).collect()] == [(1, 2)]
    assert [r.k for r in top_k(df, [F.col("k").desc()], 1).collect()] == [2]


def test_ratio_null_safe(spark):
    r = spark.range(1).select(X.ratio(F.lit(1.0), F.lit(0.0)).alias("r"), X.pct(F.lit(1), F.lit(3)).alias("p")).collect()[0]
    assert r.r is None and r.p == 33.33


def test_raw_layer_round_trip(spark, small):
    root = tempfile.mkdtemp(prefix="sm-layer-")
    IO.write_raw_layer(small, root, ["product", "inventory"])
    back = IO.read_raw_layer(spark, root, ["product", "inventory"])
    assert back.product.count() == small.product.count()
    assert back.inventory.count() == small.inventory.count()
    assert os.path.isdir(os.path.join(root, "raw", "inventory"))
    IO.append(small.product.limit(1), os.path.join(root, "raw", "product"))
    assert IO.table(spark, root, "raw", "product").count() == small.product.count() + 1


def test_order_cohort_prefix(small):
    from supplymetrics.plans.quality import order_cohort
    one = small.order_line.select("order_id").limit(1).collect()[0].order_id
    rows = order_cohort(small, f"{one}-").collect()
    assert rows and all(r.order_line_id.startswith(f"{one}-") for r in rows)
    assert len(rows) == small.order_line.filter(f"order_id = {one}").count()


def test_run_batch_records_outcomes(small):
    from supplymetrics.plans.verified import run_batch
    out = {r.query_id: r for r in run_batch(small, ["vq01_fulfillment_by_segment", "vq14_exposed_and_constrained"]).collect()}
    assert out["vq01_fulfillment_by_segment"].status == "SUCCESS" and out["vq01_fulfillment_by_segment"].row_count == 5
    assert out["vq14_exposed_and_constrained"].status in ("SUCCESS", "NO_ROWS")


def test_checkpoint_dir_required_on_cluster(spark):
    import pytest
    from supplymetrics.session import checkpoint_dir

    class _Conf:
        def get(self, key, default=None):
            return default

        def set(self, key, value):
            raise AssertionError("must not choose a folder on a cluster")

    class _Ctx:
        master = "yarn"

    class _Cluster:
        conf = _Conf()
        sparkContext = _Ctx()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(_Cluster())
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")   # local: kept as set


def test_run_batch_records_an_output_expression_that_fails(small, monkeypatch):
    from supplymetrics.plans import verified
    bad = lambda t: t.plant.select(F.raise_error(F.lit("line one\nline two")).alias("x"))
    monkeypatch.setitem(verified.VERIFIED, "bad", bad)
    row = verified.run_batch(small, ["bad"]).collect()[0]
    assert row.status == "EXECUTION_FAILED" and "line two" in row.error


def test_to_rows_raises_past_its_bound(spark):
    assert len(IO.to_rows(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        IO.to_rows(spark.range(6), 5)


def test_append_refuses_another_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    IO.append(a, path)
    IO.append(a.select("b", "a"), path)
    assert spark.read.parquet(path).count() == 2
    for bad in (spark.createDataFrame([(1, 2.0)], "a int, c double"), a.select("a"), a.withColumn("z", F.lit(1)), a.withColumn("a", F.lit("s"))):
        with pytest.raises(ValueError):
            IO.append(bad, path)
    assert spark.read.parquet(path).count() == 2


def test_surrogate_keys_stay_unique_past_their_width(spark):
    out = surrogate_key(spark.range(1200), ["id"], "sk", prefix="K", width=3, num_partitions=5).collect()
    assert {r.sk for r in out} == {f"K{i:03d}" for i in range(1, 1201)}


def test_missing_quantity_stays_missing(spark):
    from supplymetrics.operators.builders import apply_rate
    df = spark.createDataFrame([("a", None), ("a", 10.0), ("b", 7.0)], "k string, q double")
    rates = spark.createDataFrame([("a", 0.2)], "k string, rate double")
    assert [r.adjusted_quantity for r in apply_rate(df, rates, "k", "q").orderBy("k", F.col("q").asc_nulls_first()).collect()] == [None, 8.0, 7.0]


def test_literal_rows_take_iso_dates(spark):
    name = "order_line"
    from supplymetrics.sources.schemas import SCHEMAS
    row = tuple("2026-01-02" if f.dataType.typeName() == "date" else 1.0 if f.dataType.typeName() == "double"
                else 1 if f.dataType.typeName() in ("long", "integer") else "x" for f in SCHEMAS[name].fields)
    assert str(IO.rows(spark, name, [row]).first().order_date) == "2026-01-02"
    assert [r.seq for r in IO.row_source(spark, 3).collect()] == [1, 2, 3]


def test_views_and_materialised_copies(spark, tmp_path):
    df = spark.range(4)
    IO.register_surface("sm_four", df)
    assert spark.sql("select count(*) c from sm_four").first().c == 4
    assert IO.materialise(df, str(tmp_path / "m")).count() == 4


def test_planted_orphans_are_reported(dirty, small):
    from supplymetrics.plans.quality import referential_integrity
    clean = {r.check_name: r.orphan_count for r in referential_integrity(small).collect()}
    found = {r.check_name: r.orphan_count for r in referential_integrity(dirty).collect()}
    assert set(clean.values()) == {0}
    planted = {"PO -> SUPPLIER", "PO -> PART", "PO -> PLANT", "ORDER -> CUSTOMER", "ORDER -> PRODUCT"}
    assert {k for k, v in found.items() if v} == planted and {found[k] for k in planted} == {5}
    assert dirty.order_line.count() == small.order_line.count() + 5


@pytest.mark.parametrize("lost_key", ["l_partkey", "l_suppkey"])
def test_late_orphan_line_moves_no_latest_date(spark, tmp_path, lost_key):
    import __spark_entry__ as E
    from supplymetrics.sources.adapters import DRIVER_TABLES
    for name in DRIVER_TABLES:
        df = spark.read.parquet(f"{SMALL}/{name}.parquet")
        if name == "lineitem":
            late = df.limit(1).withColumns({lost_key: (F.col(lost_key) + 10_000_000).cast(df.schema[lost_key].dataType),
                                            "l_shipdate": F.lit("2030-05-05").cast(df.schema["l_shipdate"].dataType)})
            df = df.unionByName(late)
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in DRIVER_TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("vq07_below_safety_latest", "dsh05_latest_exceptions", "vq14_exposed_and_constrained"):
        want = sorted(map(repr, con.sql(E.oracle_sql()[name]).fetchall()))
        got = E.queries()[name](spark, str(tmp_path))
        assert sorted(repr(tuple(r)) for r in got.collect()) == want and (want or name.startswith("vq14"))


def test_expected_counts_can_fail(small):
    from supplymetrics.plans.quality import expected_counts
    found = {r.check_name: r.status for r in expected_counts(small, {"plant": 25, "CUSTOMER": 1}).collect()}
    assert found["PLANT"] == "PASS" and found["CUSTOMER"] == "FAIL"


def test_new_files_are_seen(spark, tmp_path):
    from supplymetrics.sources.adapters import Tables
    path = f"{tmp_path}/nation.parquet"
    rows = spark.read.parquet(f"{SMALL}/nation.parquet")
    rows.write.parquet(path)
    assert Tables.of(spark, str(tmp_path)).read("nation").count() == 25
    rows.limit(2).write.mode("append").parquet(path)
    assert Tables.of(spark, str(tmp_path)).read("nation").count() == 27


def test_fill_months(spark):
    from supplymetrics.operators.builders import fill_months
    rows = [(1, "2024-01-31", 5), (1, "2024-04-30", 7), (2, "2024-05-31", 1), (3, "2024-02-29", 2), (3, "2024-02-29", 3), (4, "2024-07-31", 9), (None, "2024-04-30", 4)]
    df = spark.createDataFrame([(k, dt.date.fromisoformat(d), v) for k, d, v in rows] + [(5, None, 8)], "k int, d date, v int")
    got = sorted(((r.k or 0, str(r.d), r.v) for r in fill_months(df, ["k"], "d", F.lit("2024-05-31").cast("date")).collect()))
    carried = [(3, "2024-02-29", 2), (3, "2024-02-29", 3)]
    idle = {r[2] for r in got if r[:2] == (3, "2024-05-31")}
    assert idle in ({2}, {3})  # of two rows of one month either may come last
    carried += [(3, d, idle.copy().pop()) for d in ("2024-03-31", "2024-04-30", "2024-05-31")]
    assert got == sorted([(0, "2024-04-30", 4), (0, "2024-05-31", 4), (1, "2024-01-31", 5), (1, "2024-02-29", 5), (1, "2024-03-31", 5), (1, "2024-04-30", 7),
                          (1, "2024-05-31", 7), (2, "2024-05-31", 1), (4, "2024-07-31", 9), (5, "None", 8), *carried])


def test_a_part_idle_in_the_last_month_is_counted(spark, small):
    from supplymetrics.plans.semantic import DENSE_MODEL, MODEL
    from supplymetrics.sources.adapters import FrameTables
    day = dt.date.fromisoformat
    stock = [("a", 1, 0, day("2024-01-31"), 10.0, 0.0, 10.0, 4.0), ("b", 2, 0, day("2024-01-31"), 5.0, 1.0, 4.0, 8.0), ("c", 2, 0, day("2024-03-31"), 2.0, 0.0, 2.0, 8.0)]
    inventory = spark.createDataFrame(stock, "inventory_snapshot_id string, part_id long, plant_id int, snapshot_date date, on_hand_quantity double, "
                                             "reserved_quantity double, available_quantity double, safety_stock_quantity double")
    t = FrameTables(spark, {"inventory": inventory, "part": small.part, "plant": small.plant})
    assert MODEL.query(t, [], ["total_on_hand"]).first()[0] == 2.0
    assert DENSE_MODEL.query(t, [], ["total_on_hand", "parts_below_safety_stock"]).first()[:] == (12.0, 1)
    ids = {r.inventory_snapshot_id for r in t.dense_inventory.collect()}
    assert ids == {"a", "a-20240229", "a-20240331", "b", "b-20240229", "c"}


def test_the_same_batch_twice_gives_its_rows_once(spark, tmp_path):
    path = str(tmp_path / "raw" / "customer")
    rows = lambda *ids: spark.createDataFrame([(i, f"C{i}", "n", "s", "r", "p") for i in ids], IO.SCHEMAS["customer"])
    IO.append(rows(1, 2), path, "2024-01-01")
    IO.append(rows(3), path, "b2")
    IO.append(rows(1, 2), path, "2024-01-01")
    back = IO.table(spark, str(tmp_path), "raw", "customer")
    assert sorted(r.customer_id for r in back.collect()) == [1, 2, 3] and back.columns == IO.SCHEMAS["customer"].names
    IO.append(rows(4), path, "2024-01-01")  # a batch that was corrected replaces its former self
    assert sorted(r.customer_id for r in IO.table(spark, str(tmp_path), "raw", "customer").collect()) == [3, 4]
    with pytest.raises(ValueError):
        IO.append(rows(5), path)
    with pytest.raises(ValueError):
        IO.append(rows(5).drop("customer_name"), path, "b3")
    bare = str(tmp_path / "bare")
    IO.append(rows(1), bare)
    with pytest.raises(ValueError):
        IO.append(rows(1), bare, "b1")


def test_readers_survive_a_refresh(spark, tmp_path):
    path = str(tmp_path / "m")
    assert IO.current(spark, path) is None
    first = IO.materialise(spark.range(4), path)
    second = IO.materialise(spark.range(7), path)
    assert (first.count(), second.count(), IO.current(spark, path).count()) == (4, 7, 7)
    assert IO.materialise(spark.range(9), path, max_age=3600).count() == 7   # fresh enough
    assert IO.materialise(spark.range(9), path, max_age=0).count() == 9
    failing = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        IO.materialise(failing, path)
    assert IO.current(spark, path).count() == 9 and first.count() == 4      # a failed refresh is no version
    assert IO.prune(spark, path, keep=1) == 2 and IO.current(spark, path).count() == 9


def test_required_values_are_enforced_by_name(spark, small, tmp_path):
    from supplymetrics.sources.adapters import FrameTables
    from supplymetrics.sources.schemas import TABLE_COMMENTS, null_counts, required
    assert SCHEMAS_KEYS() == {("inventory", "part_id"): 1, ("inventory", "plant_id"): 2, ("inventory", "snapshot_date"): 3}
    assert TABLE_COMMENTS["production"] == "One row per plant_id and product_id and production_date."
    broken = FrameTables(spark, {"plant": small.plant.withColumn("plant_code", F.when(F.col("plant_id") != 7, F.col("plant_code")))})
    IO.write_raw_layer(broken, str(tmp_path / "a"), ["plant"])
    with pytest.raises(Exception, match="plant.plant_code is NULL"):
        IO.write_raw_layer(broken, str(tmp_path / "b"), ["plant"], strict=True)
    IO.write_raw_layer(small, str(tmp_path / "c"), ["plant", "customer"], strict=True)
    assert {r.column_name: r.nulls for r in null_counts(broken.plant, "plant").collect()} == {c: int(c == "plant_code") for c in required("plant")}


def SCHEMAS_KEYS():
    return {("inventory", f.name): f.metadata["key"] for f in IO.SCHEMAS["inventory"].fields if "key" in f.metadata}


def test_list_rows_do_not_grow_with_the_list(spark):
    from supplymetrics.operators.relational import list_rows
    longest = []
    for n in (300, 3000):
        df = spark.range(n).select((F.col("id") % 3 * 0).alias("k"), F.col("id").alias("o"))
        rows = sorted(list_rows(df, ["k"], F.col("o").cast("string"), F.col("o"), F.floor(F.col("o") / 50)).collect(), key=lambda r: r.position)
        assert ", ".join(r.part for r in rows) == ", ".join(map(str, range(n)))
        assert [r.position for r in rows] == list(range(1, n, 50)) and {r["items"] for r in rows} == {50}
        longest.append(max(len(r.part) for r in rows if r.position < 300))
    assert longest[0] == longest[1]


def test_reconciliation_counts_planted_faults_among_repeats(spark):
    from supplymetrics.operators.relational import compare_by_key, reconcile
    schema = "k string, v double, w string"
    left = [("a", 1.0, "x"), ("a", 2.0, "y"), ("a", 2.0, "y"), ("b", 5.0, None), ("b", None, None), ("c", 7.0, "z"), ("d", 0.0, ""), ("e", 1.0, "q"), (None, 3.0, "n")]
    right = [("a", 2.0, "y"), ("a", 1.0, "x"), ("a", 2.0, "y"), ("b", None, None), ("b", 5.0, None), ("c", 7.5, "z"), ("d", None, ""), ("f", 1.0, "q"), (None, 3.0, "n")]
    a, b = (spark.createDataFrame(x, schema) for x in (left, right))
    assert reconcile(a, b, "k", "v").first()[:] == (8, 2)                                  # c and d differ; e and f are on one side
    assert reconcile(a.unionByName(a), b.unionByName(b), "k", "v").first()[:] == (16, 4)
    assert reconcile(a.unionByName(a), b.unionByName(b.limit(1)), "k", "v").first()[:] == (16, 16)
    rows = {r.k: r for r in compare_by_key(a, b, ["k"], {"v": ("v", "v"), "w": ("w", "w")}).collect()}
    assert {k for k, r in rows.items() if not r.same_v} == {"c", "d", "e", "f"} and {k for k, r in rows.items() if not r.same_w} == {"e", "f"}


def test_data_quality_job_counts_planted_faults(spark, small):
    """Frames with one fault of each kind: the shared passes report exactly these."""
    from supplymetrics.plans import quality as DQ
    from supplymetrics.sources.adapters import FrameTables
    frames = {n: small.table(n) for n in FrameTables.ENTITIES}
    line = frames["order_line"].orderBy("order_line_id").limit(1)
    ship = frames["shipment"].join(line.select("order_line_id"), "order_line_id")
    clean = FrameTables(spark, frames)
    base = {r.check_name: r.duplicate_groups for r in DQ.grain_duplicates(clean).collect()}
    assert base == {r.check_name: r.duplicate_groups for r in DQ.grain_duplicates(small).collect()}
    # three copies of a line that was single, one of them of a customer that does not exist; a snapshot twice
    lines = frames["order_line"].unionByName(line).unionByName(line.withColumn("customer_id", F.lit(-1).cast("long")))
    stock = frames["inventory"].unionByName(frames["inventory"].orderBy("inventory_snapshot_id").limit(1))
    faulty = FrameTables(spark, frames | {"order_line": lines, "inventory": stock})
    got = {r.check_name: r.duplicate_groups for r in DQ.grain_duplicates(faulty).collect()}
    changed = {k: got[k] - base[k] for k in got if got[k] != base[k]}
    assert changed == {"ORDER_LINE_DUPLICATE_ID": 1, "V_CUSTOMER_FULFILLMENT_GRAIN": 1, "INVENTORY_DUPLICATE_PART_PLANT_DATE": 1, "V_INVENTORY_POSITION_GRAIN": 1}
    # a plant that is there twice doubles rows of the surfaces, not of the facts
    twice = FrameTables(spark, frames | {"plant": frames["plant"].unionByName(frames["plant"])})
    got = {r.check_name: r.duplicate_groups for r in DQ.grain_duplicates(twice).collect()}
    assert all(got[k] == base[k] for k in base if not k.startswith("V_") or "SUPPLIER" in k)
    assert got["V_INVENTORY_POSITION_GRAIN"] == frames["inventory"].select("part_id", "plant_id", "snapshot_date").distinct().count()
    # a shipment of more than its line, and coverage without it
    more = frames["shipment"].join(ship.select("shipment_id"), "shipment_id", "left_anti").unionByName(
        ship.withColumn("shipped_quantity", F.lit(1e6)).select(*frames["shipment"].columns))
    rules = {r.check_name: r.failure_count for r in DQ.value_rules(FrameTables(spark, frames | {"shipment": more})).collect()}
    assert rules["SHIPMENT_QTY_GT_ORDER_LINE_FULFILLED"] == 1
    assert {r.check_name: r.mismatch_rows for r in DQ.reconciliation(clean).collect()} == dict.fromkeys(
        [r.check_name for r in DQ.reconciliation(small).collect()], 0)
    assert DQ.coverage(clean).collect() == DQ.coverage(small).collect()
