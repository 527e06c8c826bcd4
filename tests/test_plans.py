"""Plan-shape checks: the physical plans stay JVM-side, never build a Cartesian product,
prune scans to the columns used and broadcast only the bounded dimensions."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from conftest import SMALL
from supplymetrics.plans.catalog import all_entries

NAMES = sorted(all_entries())
# their windows run over one row per partition, or within a key: the months of a part and plant, the chunks of a product's list
OFFSETS = {"bld3_surrogate_key", "bld2_dense_snapshots", "sa_on_hand_latest_dense", "agg13_part_rows"}


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian_no_python_no_global_window(spark, name):
    p = plan(E.queries()[name](spark, SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                "MapInPandas", "FlatMapGroupsInPandas", "MapInArrow", "Window"):
        assert bad not in p or (bad == "Window" and name in OFFSETS), f"{name}: {bad} in plan"


def test_scan_is_pruned(spark):
    p = plan(E.queries()["vq01_fulfillment_by_segment"](spark, SMALL))
    li = [line for line in p.splitlines() if "ReadSchema: struct<l_orderkey" in line]
    assert li, p
    for col in ("l_tax", "l_discount", "l_extendedprice", "l_linestatus"):
        assert col not in li[0]


def test_filter_pushed_to_scan(spark):
    p = plan(E.queries()["dq16_otd_profile"](spark, SMALL))
    assert "PushedFilters" in p
    q = plan(E.queries()["jn07_uninspected_supplier_parts"](spark, SMALL))
    assert "In(l_returnflag, [A,R])" in q


def test_bounded_dimensions_broadcast(spark):
    p = plan(E.queries()["vq05_attainment_by_plant"](spark, SMALL))
    assert "BroadcastHashJoin" in p and "BroadcastExchange" in p


def test_surrogate_key_uses_range_partitioning(spark):
    p = plan(E.queries()["bld3_surrogate_key"](spark, SMALL))
    assert "CartesianProduct" not in p


def test_part_list_only_built_when_selected(spark):
    for name in ("vq06_constrained_exposed", "vq13_multi_signal_products", "met07_exposed_days_by_plant"):
        assert "collect_list" not in plan(E.queries()[name](spark, SMALL)), name
    assert "collect_list" in plan(E.queries()["sur3_production_performance"](spark, SMALL))


def test_supplier_surface_joins_share_partitioning(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(E.queries()["sur1_supplier_performance"](spark, SMALL), "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    import re
    assert len([line for line in p.splitlines() if "LeftOuter" in line and "Join [supplier_id" in line]) == 3
    # one exchange per pre-aggregate on the composite key, none re-shuffling the join chain
    keyed = re.findall(r"Exchange hashpartitioning\(supplier_id#\d+L, part_id#\d+L", p)
    assert len(keyed) == 3, p


def test_surface_plan_reused_as_fresh_dataset(spark):
    from pyspark.sql import Column
    from pyspark.sql import functions as F
    from supplymetrics.plans import surfaces as SUR
    from supplymetrics.sources.adapters import Tables
    t = Tables.of(spark, SMALL)
    a, b = SUR.supplier_performance(t), SUR.supplier_performance(t)
    assert a is not b and a.columns == b.columns       # a new Dataset per call ...
    assert ("supplier_performance", (), ()) in t._surfaces   # ... over one memoised plan
    c = SUR.critical_bom(t, F.lit(1))                  # Column arguments are never memoised
    assert not any(isinstance(a, Column) for k in t._surfaces for a in k[1])
    assert c.columns == SUR.critical_bom(t).columns


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", ["vq01_fulfillment_by_segment", "sur4_customer_fulfillment", "sur5_shipment_performance",
                                  "vq13_multi_signal_products", "met03_otd_by_service_level", "dq02_row_counts"])
def test_no_fact_is_shuffled_by_product(spark, no_broadcast, name):
    name = name if name in NAMES else next(n for n in NAMES if n.startswith(name.split("_")[0] + "_"))
    p = plan(E.queries()[name](spark, SMALL), "simple")
    rows = [x for x in p.splitlines() if "hashpartitioning(product_id" in x and "ENSURE_REQUIREMENTS" in x]
    lines = p.splitlines()
    for x in rows:  # only pre-aggregated rows, or the production grain's few rows beside the part list, move by product
        below = lines[lines.index(x) + 1]
        assert "HashAggregate" in below or "ObjectHashAggregate" in below or "SortAggregate" in below or "production_date" in p, x


def test_latest_snapshot_derives_the_surface_once(spark, no_broadcast):
    p = plan(E.queries()["vq07_below_safety_latest"](spark, SMALL), "simple")
    assert any("Filter" in x and "last_day(cast(l_shipdate" in x for x in p.splitlines()), p
    assert len([x for x in p.splitlines() if "HashAggregate(keys=[l_partkey" in x]) == 2, p


def exchanges(p):
    return [x for x in p.splitlines() if "Exchange hashpartitioning" in x and "Reused" not in x]


def test_facts_join_only_the_parents_asked_for(spark, no_broadcast):
    from supplymetrics.sources.adapters import FROM_PARENTS, Tables
    from supplymetrics.sources.schemas import SCHEMAS
    t = Tables.of(spark, SMALL)
    for name, parents in FROM_PARENTS.items():
        own = [c for c in SCHEMAS[name].names if not any(c in got for got in parents.values())]
        joins = plan(t.columns(name, *own), "simple").count("SortMergeJoin")
        assert joins == (1 if name == "inventory" else 0), name  # a snapshot is kept per plant, which is the supplier's
        for parent, got in parents.items():
            assert plan(t.columns(name, *got), "simple").count("SortMergeJoin") > joins, (name, parent)
        assert t.columns(name, *SCHEMAS[name].names).exceptAll(t.table(name)).isEmpty(), name


def test_supplier_surface_derives_purchase_order_lines_once(spark, no_broadcast):
    p = plan(E.queries()["sur1_supplier_performance"](spark, SMALL), "simple")
    scans = [x for x in p.splitlines() if "FileScan parquet" in x]
    assert len([x for x in scans if "l_suppkey" in x]) == 4 and len([x for x in scans if "o_orderdate" in x]) == 1, p
    assert len(exchanges(p)) <= 12, len(exchanges(p))


def test_part_is_joined_to_snapshots_not_to_lines(spark, no_broadcast):
    import re
    p = plan(E.queries()["sur2_inventory_position"](spark, SMALL), "simple")
    assert not re.search(r"hashpartitioning\(l_partkey#\d+L, \d+\)", p), p
    # the snapshots are shuffled once for both reads of the part dimension
    assert len([x for x in exchanges(p) if re.search(r"\(part_id#\d+L, \d+\)", x)]) == 2, p


def scans_of(p, column):
    return [x for x in p.splitlines() if "FileScan parquet" in x and column in x]


def test_grain_checks_share_derivations(spark, no_broadcast):
    p = plan(E.queries()["dq04_grain_duplicates"](spark, SMALL), "simple")
    assert len(exchanges(p)) <= 24, len(exchanges(p))
    assert len(scans_of(p, "l_shipdate")) + len(scans_of(p, "l_suppkey")) - len([x for x in scans_of(p, "l_shipdate") if "l_suppkey" in x]) <= 4, p


def test_signals_need_two_scans_of_the_lines(spark, no_broadcast):
    from supplymetrics.plans import surfaces as SUR
    from supplymetrics.sources.adapters import Tables
    p = plan(SUR.risk_signals(Tables(spark, SMALL)), "simple")
    assert len(scans_of(p, "l_partkey")) == 2, p


@pytest.fixture
def proven(spark):
    """Own instance, so that no other test sees its proof."""
    from supplymetrics.sources.adapters import Tables
    t = Tables(spark, SMALL)
    assert t.prove() == {"part": True, "supplier": True, "orders": True, "customer": True}
    return t


def test_proven_edges_are_not_joined(spark, no_broadcast, proven):
    from supplymetrics.plans import surfaces as SUR
    from supplymetrics.plans.semantic import MODEL
    from supplymetrics.sources.adapters import Tables
    bare = Tables(spark, SMALL)
    asked = lambda t: plan(MODEL.query(t, ["customer_segment"], ["fulfillment_rate"]), "simple")
    for key in ("l_partkey", "l_suppkey"):
        assert f"hashpartitioning({key}" in asked(bare) and f"hashpartitioning({key}" not in asked(proven)
    assert "o_custkey" in asked(proven) and "c_mktsegment" in asked(proven) and len(exchanges(asked(proven))) == 5  # lines, orders (twice), customers, groups
    p = plan(SUR.risk_signals(proven), "simple")
    assert len(scans_of(p, "l_partkey")) == 1 and "o_orderkey" not in p and "c_custkey" not in p, p
    p = plan(MODEL.query(proven, [], ["fulfillment_rate"]), "simple")
    assert "Join" not in p and "o_orderkey" not in p, p


def test_a_proof_changes_no_result(spark, proven):
    from supplymetrics.sources.adapters import Tables
    bare = Tables(spark, SMALL)
    for name in ("vq01_fulfillment_by_segment", "vq03_otd_by_carrier", "vq07_below_safety_latest", "vq13_multi_signal_products", "sur4_customer_fulfillment",
                 "sur5_shipment_performance", "sur6_product_risk_signals", "dsh07_posture_table", "sem_filter_functions", "sem_rollup_month", "dq10_reconciliation"):
        build = next(e.build for n, e in all_entries().items() if n == name or n.startswith(name.split("_")[0] + "_") and name.startswith("sur"))
        a, b = build(bare), build(proven)
        assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name


def test_nothing_is_proven_of_dirty_lines(spark, dirty):
    from supplymetrics.plans.semantic import MODEL
    rows = {r.edge: r for r in dirty.integrity().collect()}
    assert [rows[e].orphans for e in ("part", "supplier", "orders", "customer")] == [5, 5, 5, 0]
    before = MODEL.query(dirty, [], ["fulfillment_rate"], aggregates={"q": ("sum", "qty ordered")}).collect()
    assert dirty.prove() == {"part": False, "supplier": False, "orders": False, "customer": True}
    assert MODEL.query(dirty, [], ["fulfillment_rate"], aggregates={"q": ("sum", "qty ordered")}).collect() == before
