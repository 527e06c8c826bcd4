"""Property checks: ratios are ratios of sums under any regrouping, semi-additive measures equal
plain sums when the snapshot date is a dimension, and every surface keeps its fact's grain."""

import datetime as dt

from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st
from pyspark.sql import functions as F

from supplymetrics.operators.relational import semi_additive
from supplymetrics.plans import surfaces as SUR
from supplymetrics.plans.semantic import MODEL
from supplymetrics.sources.adapters import FrameTables
from supplymetrics.sources.schemas import SCHEMAS

LINE = st.tuples(st.integers(1, 3), st.sampled_from(["A", "B"]), st.integers(0, 20), st.integers(0, 20))


def _tables(spark, lines):
    plant = spark.createDataFrame([(1, "PL01", "Alpha", "A", "R1", "Assembly", None)], SCHEMAS["plant"])
    product = spark.createDataFrame([("A", "A", "Prod A", "F1", "C1", 1.0), ("B", "B", "Prod B", "F2", "C1", 1.0)],
                                    SCHEMAS["product"])
    customer = spark.createDataFrame([(i, f"C{i}", f"Cust {i}", f"S{i % 2}", "R1", "High") for i in (1, 2, 3)],
                                     SCHEMAS["customer"])
    d = dt.date(2026, 7, 1)
    rows = [(f"ol{i}", i, c, p, 1, d, d, float(o), float(min(f, o)), "x") for i, (c, p, o, f) in enumerate(lines)]
    order_line = spark.createDataFrame(rows, SCHEMAS["order_line"])
    return FrameTables(spark, {"plant": plant, "product": product, "customer": customer, "order_line": order_line})


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(LINE, min_size=1, max_size=12))
def test_rate_is_ratio_of_sums_under_regrouping(spark, lines):
    t = _tables(spark, lines)
    by_seg = {r.customer_segment: r.fulfillment_rate for r in MODEL.query(t, ["customer_segment"], ["fulfillment_rate"]).collect()}
    for seg in {f"S{c % 2}" for c, _, _, _ in lines}:
        o = sum(x[2] for x in lines if f"S{x[0] % 2}" == seg)
        f = sum(min(x[3], x[2]) for x in lines if f"S{x[0] % 2}" == seg)
        assert by_seg[seg] == (round(f / o, 9) if o else None)
    total = MODEL.query(t, [], ["fulfillment_rate"]).collect()[0].fulfillment_rate
    o = sum(x[2] for x in lines)
    f = sum(min(x[3], x[2]) for x in lines)
    assert total == (round(f / o, 9) if o else None)       # never the mean of group rates


def test_semi_additive_with_date_is_plain_sum(small):
    inv = SUR.inventory_position(small)
    a = {(r.plant_id, r.snapshot_date): r.v for r in
         semi_additive(inv, ["plant_id", "snapshot_date"], "snapshot_date", {"v": F.sum("on_hand_quantity")}).collect()}
    b = {(r.plant_id, r.snapshot_date): r.v for r in
         inv.groupBy("plant_id", "snapshot_date").agg(F.sum("on_hand_quantity").alias("v")).collect()}
    assert a == b


def test_surfaces_keep_fact_grain(small):
    pairs = [(SUR.customer_fulfillment(small), small.order_line), (SUR.shipment_performance(small), small.shipment),
             (SUR.production_performance(small), small.production), (SUR.inventory_position(small), small.inventory),
             (SUR.supplier_performance(small), small.supplier_part)]
    for surface, fact in pairs:
        assert surface.count() == fact.count()
