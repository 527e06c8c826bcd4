"""Hand-built scenario in the entity schema, with answers derived by hand (edge rows: NULL
delivery date, ordered = 0, planned = 0, product without orders, supplier-part without any
activity, PO line with two receipts, available <= 0, available == safety and == 1.25 x safety,
rate exactly at the 0.90 cut, a plant with no row at the latest snapshot)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from supplymetrics.operators.builders import calendar
from supplymetrics.plans import dashboard as DSH
from supplymetrics.plans import surfaces as SUR
from supplymetrics.plans import verified as VQ
from supplymetrics.plans.semantic import MODEL
from supplymetrics.sources.adapters import FrameTables
from supplymetrics.sources.schemas import SCHEMAS

D = dt.date
D0 = D(2026, 7, 1)


def _df(spark, name, rows):
    return spark.createDataFrame(rows, SCHEMAS[name])


@pytest.fixture(scope="module")
def t(spark):
    f = {}
    f["plant"] = _df(spark, "plant", [(1, "PL01", "Alpha", "A", "R1", "Assembly", None),
                                      (2, "PL02", "Beta", "B", "R2", "Assembly", None)])
    f["product"] = _df(spark, "product", [("A", "A", "Prod A", "F1", "C1", 1.0),
                                          ("B", "B", "Prod B", "F1", "C1", 1.0),
                                          ("C", "C", "Prod C", "F2", "C2", 1.0)])
    f["customer"] = _df(spark, "customer", [(1, "C1", "Cust 1", "S1", "R1", "High"),
                                            (2, "C2", "Cust 2", "S2", "R2", "Standard")])
    f["supplier"] = _df(spark, "supplier", [(1, "S1", "Sup 1", "R1", "Strategic", "Active"),
                                            (2, "S2", "Sup 2", "R2", "Standard", "Active")])
    f["part"] = _df(spark, "part", [(10, "P10", "Part 10", "K", "EA", "Critical", 1.0),
                                    (11, "P11", "Part 11", "K", "EA", "Low", 1.0)])
    f["product_part"] = _df(spark, "product_part", [("A-10", "A", 10, 2.0, True), ("A-11", "A", 11, 1.0, False),
                                                    ("B-11", "B", 11, 3.0, True), ("C-10", "C", 10, 1.0, True)])
    f["supplier_part"] = _df(spark, "supplier_part", [("1-10", 1, 10, True, 50.0), ("1-11", 1, 11, False, 50.0),
                                                      ("2-10", 2, 10, True, 50.0)])
    p5 = D0 + dt.timedelta(5)
    f["order_line"] = _df(spark, "order_line", [
        ("ol1", 1, 1, "A", 1, D0, p5, 10.0, 7.0, "Partially Fulfilled"),
        ("ol2", 1, 1, "A", 1, D0, p5, 10.0, 10.0, "Fulfilled"),
        ("ol3", 2, 2, "B", 2, D0, p5, 0.0, 0.0, "Open"),
        ("ol4", 2, 2, "B", 2, D0, p5, 20.0, 18.0, "Partially Fulfilled")])
    f["shipment"] = _df(spark, "shipment", [
        ("sh1", "ol1", 1, "A", 1, "CA01", D0, p5, None, 7.0, "In Transit", None),
        ("sh2", "ol2", 1, "A", 1, "CA01", D0, p5, p5, 10.0, "Delivered", None),
        ("sh3", "ol3", 2, "B", 2, "CA02", D0, p5, p5 + dt.timedelta(3), 0.0, "Delivered", "late"),
        ("sh4", "ol4", 2, "B", 2, "CA02", D0, p5, D0, 18.0, "Delivered", None)])
    f["production"] = _df(spark, "production", [
        ("pr1", 1, "A", D0, 100.0, 80.0, 2.0, "Constrained"),
        ("pr2", 1, "C", D0, 0.0, 0.0, 0.0, "Normal"),
        ("pr3", 2, "B", D0, 100.0, 100.0, 0.0, "Normal")])
    d1, d2 = D(2026, 7, 31), D(2026, 8, 31)
    f["inventory"] = _df(spark, "inventory", [
        ("i1", 10, 1, d1, 0.0, 0.0, 0.0, 5.0),
        ("i2", 10, 1, d2, 5.0, 0.0, 5.0, 5.0),
        ("i3", 11, 1, d2, 12.5, 0.0, 12.5, 10.0),
        ("i4", 11, 2, d1, 3.0, 0.0, 3.0, 10.0)])
    po_p = D0 + dt.timedelta(5)
    f["purchase_order_line"] = _df(spark, "purchase_order_line", [
        ("po1", 1, 1, 10, 1, D0, po_p, 100.0, 1.0, "Closed"),
        ("po2", 1, 1, 10, 1, D0, po_p, 50.0, 1.0, "Closed"),
        ("po3", 2, 1, 11, 1, D0, po_p, 10.0, 1.0, "Open")])
    f["supply_receipt"] = _df(spark, "supply_receipt", [
        ("r1", "po1", 1, 10, 1, po_p, 60.0, 60.0, 0.0, "Received"),
        ("r2", "po1", 1, 10, 1, po_p + dt.timedelta(4), 40.0, 30.0, 10.0, "Received"),
        ("r3", "po2", 1, 10, 1, po_p + dt.timedelta(1), 50.0, 50.0, 0.0, "Received")])
    f["quality"] = _df(spark, "quality", [
        ("q1", 1, 10, 1, D0, 100.0, 3.0, "Dim", "Failed"),
        ("q2", 1, 11, 1, D0, 100.0, 1.0, "Dim", "Failed")])
    f["date_dim"] = calendar(spark, "2026-06-01", "2026-08-31")
    return FrameTables(spark, f)


def _rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_fulfillment_surface(t):
    r = _rows(SUR.customer_fulfillment(t), "order_line_id")
    assert r["ol1"]["fulfillment_pct"] == 70.0 and r["ol1"]["fulfillment_gap_flag"] is True
    assert r["ol3"]["fulfillment_pct"] is None            # ordered = 0 -> NULL, never an error
    assert r["ol3"]["fulfillment_gap_flag"] is False
    assert r["ol1"]["customer_segment"] == "S1" and r["ol4"]["plant_region"] == "R2"


def test_shipment_surface(t):
    r = _rows(SUR.shipment_performance(t), "shipment_id")
    assert r["sh1"]["delivery_delay_days"] is None and r["sh1"]["delivery_eligible_flag"] is False
    assert r["sh1"]["on_time_flag"] is False
    assert r["sh3"]["delivery_delay_days"] == 3 and r["sh3"]["on_time_flag"] is False
    assert r["sh4"]["delivery_delay_days"] == -5 and r["sh4"]["on_time_flag"] is True


def test_production_surface_bom_preaggregated(t):
    r = _rows(SUR.production_performance(t, watched_part=10), "production_id")
    assert len(r) == 3                                      # grain kept: no BOM fan-out
    assert r["pr1"]["critical_part_count"] == 1 and r["pr1"]["critical_parts"] == "10 (2.0)"
    assert r["pr1"]["watched_part_exposure_flag"] is True and r["pr1"]["watched_part_qty_per_product"] == 2.0
    assert r["pr3"]["watched_part_exposure_flag"] is False and r["pr3"]["critical_parts"] == "11 (3.0)"
    assert r["pr2"]["production_attainment_pct"] is None   # planned = 0
    assert r["pr1"]["constraint_flag"] is True and r["pr1"]["production_gap_quantity"] == 20.0


def test_inventory_bands(t):
    r = _rows(SUR.inventory_position(t), "inventory_snapshot_id")
    assert r["i1"]["inventory_risk_band"] == "STOCKOUT"
    assert r["i2"]["inventory_risk_band"] == "NEAR_SAFETY_STOCK" and r["i2"]["below_safety_stock_flag"] is False
    assert r["i3"]["inventory_risk_band"] == "HEALTHY"      # exactly 1.25 x safety is healthy
    assert r["i4"]["inventory_risk_band"] == "BELOW_SAFETY_STOCK"


def test_supplier_performance(t):
    rows = SUR.supplier_performance(t).collect()
    r = {(x.supplier_id, x.part_id): x.asDict() for x in rows}
    a = r[(1, 10)]
    assert a["po_line_count"] == 2 and a["receipt_count"] == 3 and a["ordered_quantity"] == 150.0
    assert a["avg_receipt_delay_days"] == 1.5              # mean of per-PO-line means (2 and 1)
    assert a["on_time_receipt_pct"] == 33.33
    assert a["defect_rate_pct"] == 3.0 and a["supply_risk_band"] == "HIGH"
    b = r[(1, 11)]
    assert b["avg_receipt_delay_days"] is None and b["supply_risk_band"] == "MEDIUM"
    c = r[(2, 10)]                                          # no PO, receipt or inspection
    assert c["po_line_count"] == 0 and c["defect_rate_pct"] is None and c["supply_risk_band"] == "LOW"


def test_risk_signals(t):
    r = _rows(SUR.risk_signals(t), "product_id")
    assert set(r) == {"A", "B", "C"}
    a, b, c = r["A"], r["B"], r["C"]
    assert a["fulfillment_rate"] == 0.85 and a["fulfillment_risk_flag"] is True
    assert a["on_time_delivery_rate"] == 1.0 and a["production_attainment"] == 0.8
    assert a["risk_signal_count"] == 2 and a["eligible_shipments"] == 1
    assert b["fulfillment_rate"] == 0.9 and b["fulfillment_risk_flag"] is False   # strict cut
    assert b["on_time_delivery_rate"] == 0.5 and b["risk_signal_count"] == 1
    assert c["fulfillment_rate"] is None and c["fulfillment_risk_flag"] is None   # missing stays NULL
    assert c["production_risk_flag"] is None and c["risk_signal_count"] == 0
    assert c["total_order_lines"] == 0 and c["total_production_days"] == 1
    assert [x.product_name for x in VQ.vq13_multi_signal_products(t).collect()] == ["Prod A"]


def test_latest_snapshot_and_semi_additive(t):
    v7 = {r.plant_name: r.parts_below_safety_stock for r in VQ.vq07_below_safety_latest(t).collect()}
    assert v7 == {"Alpha": 0}                               # zero kept; Beta has no latest row
    tot = MODEL.query(t, [], ["total_on_hand"]).collect()[0].total_on_hand
    assert tot == 17.5                                      # latest global snapshot only
    by_plant = {r.plant_name: r.total_on_hand for r in MODEL.query(t, ["plant_name"], ["total_on_hand"]).collect()}
    assert by_plant == {"Alpha": 17.5, "Beta": 3.0}         # latest snapshot per group
    by_date = {r.snapshot_date: r.total_on_hand for r in MODEL.query(t, ["snapshot_date"], ["total_on_hand"]).collect()}
    assert by_date == {D(2026, 7, 31): 3.0, D(2026, 8, 31): 17.5}


def test_dashboard(t):
    p = DSH.posture(t).collect()[0]
    assert (p.high_risk_count, p.watchlist_count, p.healthy_count, p.monitored_count) == (1, 1, 1, 3)
    pt = [(r.attention_state, r.product_count) for r in DSH.posture_table(t).collect()]
    assert pt == [("High Risk", 1), ("Watchlist", 1), ("Healthy", 1)]
    top = DSH.top_priority(t).collect()
    assert top[0].product_id == "A" and top[0].active_signals == "Fulfillment · Production"
    assert DSH.network_fulfillment_pct(t).collect()[0].fulfillment_pct == round(100 * 35 / 40, 1)


def test_rollup_through_calendar(t):
    r = MODEL.query(t, ["year", "month"], ["fulfillment_rate"]).collect()
    assert [(x.year, x.month, x.fulfillment_rate) for x in r] == [(2026, 7, 0.875)]
