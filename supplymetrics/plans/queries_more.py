"""Registered queries: dashboard aggregates, data-quality checks, builders and operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from supplymetrics.functions import exprs as X
from supplymetrics.operators.builders import apply_rate, sample_mod, surrogate_key
from supplymetrics.operators.relational import duplicates, listagg, orphans, reconcile, report, top_k, universe
from supplymetrics.plans import dashboard as DSH
from supplymetrics.plans import quality as DQ
from supplymetrics.plans import surfaces as SUR
from supplymetrics.plans.catalog import REGISTRY, register
from supplymetrics.plans.verified import VERIFIED, run_batch
from supplymetrics.session import checkpoint_dir
from supplymetrics.sources import io as IO
from supplymetrics.sources.adapters import CARRIERS, Tables
from supplymetrics.sources.schemas import null_counts, required

# --- dashboard -------------------------------------------------------------------------------
register("dsh01_risk_table", DSH.risk_table, "SELECT * FROM product_risk_signals ORDER BY risk_signal_count DESC",
         "product_risk_signals")
register("dsh02_network_fulfillment_pct", DSH.network_fulfillment_pct, """
SELECT round(100.0::DOUBLE * sum(fulfilled_quantity) / NULLIF(sum(ordered_quantity), 0), 1) AS fulfillment_pct
FROM customer_fulfillment""", "customer_fulfillment")
register("dsh03_network_otd_pct", DSH.network_otd_pct, """
SELECT round(100.0::DOUBLE * count_if(on_time_flag) / NULLIF(count_if(delivery_eligible_flag), 0), 1) AS otd_pct
FROM shipment_performance""", "shipment_performance")
register("dsh04_inventory_trend", DSH.inventory_trend, """
SELECT snapshot_date, sum(available_quantity) AS available_inventory, sum(safety_stock_quantity) AS safety_stock_level
FROM inventory_position GROUP BY snapshot_date ORDER BY snapshot_date""", "inventory_position")
register("dsh05_latest_exceptions", DSH.latest_exceptions, """
SELECT snapshot_date, count(DISTINCT part_id) AS parts_below_safety_stock FROM inventory_position
WHERE snapshot_date = (SELECT max(snapshot_date) FROM inventory_position)
  AND available_quantity < safety_stock_quantity GROUP BY snapshot_date""", "inventory_position")
register("dsh06_posture", DSH.posture, """
SELECT CAST(count_if(risk_signal_count >= 2) AS BIGINT) AS high_risk_count,
       CAST(count_if(risk_signal_count = 1) AS BIGINT) AS watchlist_count,
       CAST(count_if(risk_signal_count = 0) AS BIGINT) AS healthy_count,
       CAST(count_if(risk_signal_count >= 1) AS BIGINT) AS attention_count,
       count(DISTINCT product_id) AS monitored_count
FROM product_risk_signals""", "product_risk_signals")
register("dsh07_posture_table", DSH.posture_table, """
WITH c AS (SELECT CASE WHEN risk_signal_count >= 2 THEN 'High Risk' WHEN risk_signal_count = 1 THEN 'Watchlist'
                       ELSE 'Healthy' END AS attention_state, count(*) AS product_count
           FROM product_risk_signals GROUP BY 1),
s AS (SELECT * FROM (VALUES ('High Risk', 1), ('Watchlist', 2), ('Healthy', 3)) v(attention_state, display_order))
SELECT s.attention_state, s.display_order, COALESCE(c.product_count, 0) AS product_count,
       round(COALESCE(c.product_count, 0)::DOUBLE
             / greatest((SELECT count(DISTINCT product_id) FROM product_risk_signals), 1), 9) AS share
FROM s LEFT JOIN c ON s.attention_state = c.attention_state ORDER BY s.display_order""", "product_risk_signals")
_PRIORITY_SELECT = """
SELECT product_id, product_name, risk_signal_count, fulfillment_rate, on_time_delivery_rate,
       concat_ws(' · ', CASE WHEN fulfillment_risk_flag THEN 'Fulfillment' END,
                        CASE WHEN delivery_risk_flag THEN 'Delivery' END,
                        CASE WHEN production_risk_flag THEN 'Production' END) AS active_signals,
       CASE WHEN risk_signal_count >= 2 THEN 'High Risk' WHEN risk_signal_count = 1 THEN 'Watchlist'
            ELSE 'Healthy' END AS attention_state
FROM product_risk_signals"""
register("dsh08_priority_list", DSH.priority_list,
         _PRIORITY_SELECT + """
ORDER BY risk_signal_count DESC, fulfillment_rate ASC NULLS LAST, on_time_delivery_rate ASC NULLS LAST, product_id""",
         "product_risk_signals")
register("ord3_top_priority", DSH.top_priority,
         _PRIORITY_SELECT + """
WHERE risk_signal_count > 0
ORDER BY risk_signal_count DESC, fulfillment_rate ASC NULLS LAST, on_time_delivery_rate ASC NULLS LAST, product_id
LIMIT 1""", "product_risk_signals")
register("dsh09_snapshots_below", DSH.snapshots_below, """
SELECT CAST(count_if(available_inventory < safety_stock_level) AS BIGINT) AS snapshots_below, count(*) AS total_snapshots
FROM (SELECT snapshot_date, sum(available_quantity) AS available_inventory, sum(safety_stock_quantity) AS safety_stock_level
      FROM inventory_position GROUP BY snapshot_date)""", "inventory_position")
register("dsh10_trend_long", DSH.trend_long, """
SELECT snapshot_date, measure, value FROM (
  SELECT snapshot_date, sum(available_quantity) AS available_inventory, sum(safety_stock_quantity) AS safety_stock_level
  FROM inventory_position GROUP BY snapshot_date)
UNPIVOT (value FOR measure IN (available_inventory, safety_stock_level))""", "inventory_position")
register("fn27_kpi_bands", DSH.kpi_bands, """
WITH k AS (
  SELECT 'fulfillment' AS kpi, (SELECT round(100.0::DOUBLE * sum(fulfilled_quantity) / NULLIF(sum(ordered_quantity), 0), 1)
                                FROM customer_fulfillment) AS value, 90 AS good, 80 AS warn
  UNION ALL
  SELECT 'on_time_delivery', (SELECT round(100.0::DOUBLE * count_if(on_time_flag) / NULLIF(count_if(delivery_eligible_flag), 0), 1)
                              FROM shipment_performance), 85, 70)
SELECT kpi, value, CASE WHEN value IS NULL THEN 'Unavailable' WHEN value >= good THEN 'On target'
                        WHEN value >= warn THEN 'Watch' ELSE 'Below target' END AS band FROM k""",
         "customer_fulfillment", "shipment_performance")
register("ord2_priority", lambda t: SUR.risk_signals(t).select(
    "product_id", "risk_signal_count", "fulfillment_rate", "on_time_delivery_rate").orderBy(*DSH.priority_order()),
    """
SELECT product_id, risk_signal_count, fulfillment_rate, on_time_delivery_rate FROM product_risk_signals
ORDER BY risk_signal_count DESC, fulfillment_rate ASC NULLS LAST, on_time_delivery_rate ASC NULLS LAST, product_id""",
    "product_risk_signals")
register("ord4_lowest_otd_carrier", DSH.lowest_otd_carrier, """
SELECT carrier_name, round(count_if(on_time_flag)::DOUBLE / NULLIF(count_if(delivery_eligible_flag), 0), 9) AS on_time_delivery_rate
FROM shipment_performance GROUP BY carrier_name ORDER BY on_time_delivery_rate ASC NULLS LAST, carrier_name LIMIT 1""",
         "shipment_performance")
register("ord4_highest_defect_supplier", DSH.highest_defect_supplier, """
SELECT supplier_name, round(sum(defective_quantity) / NULLIF(sum(inspected_quantity), 0), 9) AS defect_rate
FROM supplier_performance GROUP BY supplier_name ORDER BY defect_rate DESC NULLS LAST, supplier_name LIMIT 1""",
         "supplier_performance")

# --- data quality ----------------------------------------------------------------------------
register("dq01_expected_counts", DQ.expected_counts, """
WITH c AS (
  SELECT 'CARRIER' AS check_name, (SELECT count(*) FROM carrier_t) AS actual_count, CAST(4 AS BIGINT) AS expected_count
  UNION ALL SELECT 'CUSTOMER', (SELECT count(*) FROM customer_t), (SELECT count(*) FROM customer)
  UNION ALL SELECT 'DATE_DIM', (SELECT count(*) FROM date_t),
        CAST(date_diff('day', CAST(least((SELECT min(o_orderdate) FROM orders), (SELECT min(l_shipdate) FROM lineitem)) AS DATE),
                       last_day(CAST((SELECT max(l_shipdate) FROM lineitem) AS DATE))) + 1 AS BIGINT)
  UNION ALL SELECT 'PART', (SELECT count(*) FROM part_t), (SELECT count(*) FROM part)
  UNION ALL SELECT 'PLANT', (SELECT count(*) FROM plant_t), (SELECT count(*) FROM nation)
  UNION ALL SELECT 'PRODUCT', (SELECT count(*) FROM product_t), (SELECT count(DISTINCT (p_brand, p_type)) FROM part)
  UNION ALL SELECT 'SUPPLIER', (SELECT count(*) FROM supplier_t), (SELECT count(*) FROM supplier))
SELECT check_name, CASE WHEN actual_count = expected_count THEN 'PASS' ELSE 'FAIL' END AS status,
       actual_count, expected_count FROM c ORDER BY check_name""",
         "carrier_t", "customer_t", "date_t", "part_t", "plant_t", "product_t", "supplier_t")

_ENTITY_CTES = ["supplier_t", "part_t", "product_t", "plant_t", "customer_t", "carrier_t", "date_t",
                "supplier_part_t", "product_part_t", "purchase_order_line_t", "supply_receipt_t",
                "inventory_t", "production_t", "quality_t", "order_line_t", "shipment_t"]
_names = ["SUPPLIER", "PART", "PRODUCT", "PLANT", "CUSTOMER", "CARRIER", "DATE_DIM", "SUPPLIER_PART",
          "PRODUCT_PART", "PURCHASE_ORDER_LINE", "SUPPLY_RECEIPT", "INVENTORY", "PRODUCTION", "QUALITY",
          "ORDER_LINE", "SHIPMENT"]
_surf = [("V_SUPPLIER_PERFORMANCE", "supplier_performance"), ("V_INVENTORY_POSITION", "inventory_position"),
         ("V_PRODUCTION_PERFORMANCE", "production_performance"), ("V_CUSTOMER_FULFILLMENT", "customer_fulfillment"),
         ("V_SHIPMENT_PERFORMANCE", "shipment_performance")]
register("dq02_row_counts", DQ.row_counts,
         "\nUNION ALL\n".join([f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {c}" for n, c in zip(_names, _ENTITY_CTES)]
                              + [f"SELECT '{n}', count(*) FROM {c}" for n, c in _surf]),
         *_ENTITY_CTES, *[c for _, c in _surf])

register("dq03_referential_integrity", DQ.referential_integrity, """
SELECT 'PO -> SUPPLIER' AS check_name, count(*) AS orphan_count FROM purchase_order_line_t x
  WHERE NOT EXISTS (SELECT 1 FROM supplier_t p WHERE p.supplier_id = x.supplier_id)
UNION ALL SELECT 'PO -> PART', count(*) FROM purchase_order_line_t x WHERE NOT EXISTS (SELECT 1 FROM part_t p WHERE p.part_id = x.part_id)
UNION ALL SELECT 'PO -> PLANT', count(*) FROM purchase_order_line_t x WHERE NOT EXISTS (SELECT 1 FROM plant_t p WHERE p.plant_id = x.plant_id)
UNION ALL SELECT 'RECEIPT -> PO', count(*) FROM supply_receipt_t x WHERE NOT EXISTS (SELECT 1 FROM purchase_order_line_t p WHERE p.po_line_id = x.po_line_id)
UNION ALL SELECT 'ORDER -> CUSTOMER', count(*) FROM order_line_t x WHERE NOT EXISTS (SELECT 1 FROM customer_t p WHERE p.customer_id = x.customer_id)
UNION ALL SELECT 'ORDER -> PRODUCT', count(*) FROM order_line_t x WHERE NOT EXISTS (SELECT 1 FROM product_t p WHERE p.product_id = x.product_id)
UNION ALL SELECT 'SHIPMENT -> ORDER', count(*) FROM shipment_t x WHERE NOT EXISTS (SELECT 1 FROM order_line_t p WHERE p.order_line_id = x.order_line_id)
UNION ALL SELECT 'SHIPMENT -> CARRIER', count(*) FROM shipment_t x WHERE NOT EXISTS (SELECT 1 FROM carrier_t p WHERE p.carrier_id = x.carrier_id)
ORDER BY check_name""", "purchase_order_line_t", "supplier_t", "part_t", "plant_t", "supply_receipt_t",
         "order_line_t", "customer_t", "product_t", "shipment_t", "carrier_t")

_DUPS = [("INVENTORY_DUPLICATE_PART_PLANT_DATE", "inventory_t", "part_id, plant_id, snapshot_date"),
         ("PO_LINE_DUPLICATE_ID", "purchase_order_line_t", "po_line_id"),
         ("ORDER_LINE_DUPLICATE_ID", "order_line_t", "order_line_id"),
         ("SHIPMENT_DUPLICATE_ID", "shipment_t", "shipment_id"),
         ("V_SUPPLIER_PERFORMANCE_GRAIN", "supplier_performance", "supplier_id, part_id"),
         ("V_INVENTORY_POSITION_GRAIN", "inventory_position", "part_id, plant_id, snapshot_date"),
         ("V_PRODUCTION_PERFORMANCE_GRAIN", "production_performance", "plant_id, product_id, production_date"),
         ("V_CUSTOMER_FULFILLMENT_GRAIN", "customer_fulfillment", "order_line_id"),
         ("V_SHIPMENT_PERFORMANCE_GRAIN", "shipment_performance", "shipment_id")]
register("dq04_grain_duplicates", DQ.grain_duplicates,
         "\nUNION ALL\n".join(f"SELECT '{n}' AS check_name, count(*) AS duplicate_groups FROM "
                              f"(SELECT {k} FROM {c} GROUP BY {k} HAVING count(*) > 1)" for n, c, k in _DUPS),
         *[c for _, c, _ in _DUPS])

register("dq05_09_value_rules", DQ.value_rules, """
SELECT 'RECEIPT_QUANTITY_BALANCE' AS check_name,
       CAST(count_if(received_quantity <> accepted_quantity + rejected_quantity) AS BIGINT) AS failure_count FROM supply_receipt_t
UNION ALL SELECT 'NEGATIVE_INVENTORY_AVAILABLE', CAST(count_if(available_quantity < 0) AS BIGINT) FROM inventory_t
UNION ALL SELECT 'ORDER_FULFILLED_GT_ORDERED', CAST(count_if(fulfilled_quantity > ordered_quantity) AS BIGINT) FROM order_line_t
UNION ALL SELECT 'SHIPMENT_QTY_GT_ORDER_LINE_FULFILLED', CAST(count_if(sh.shipped > o.fulfilled) AS BIGINT)
          FROM (SELECT order_line_id, sum(shipped_quantity) AS shipped FROM shipment_t GROUP BY order_line_id) sh
          JOIN (SELECT order_line_id, sum(fulfilled_quantity) AS fulfilled FROM order_line_t GROUP BY order_line_id) o USING (order_line_id)
UNION ALL SELECT 'QUALITY_DEFECT_GT_INSPECTED', CAST(count_if(defective_quantity > inspected_quantity) AS BIGINT) FROM quality_t
ORDER BY check_name""", "supply_receipt_t", "inventory_t", "order_line_t", "shipment_t", "quality_t")

_REC = [("V_INVENTORY_POSITION.AVAILABLE_QUANTITY", "inventory_position", "inventory_t", "inventory_snapshot_id", "available_quantity"),
        ("V_PRODUCTION_PERFORMANCE.PRODUCED_QUANTITY", "production_performance", "production_t", "production_id", "produced_quantity"),
        ("V_CUSTOMER_FULFILLMENT.FULFILLED_QUANTITY", "customer_fulfillment", "order_line_t", "order_line_id", "fulfilled_quantity"),
        ("V_SHIPMENT_PERFORMANCE.SHIPPED_QUANTITY", "shipment_performance", "shipment_t", "shipment_id", "shipped_quantity")]
register("dq10_reconciliation", DQ.reconciliation,
         "\nUNION ALL\n".join(f"SELECT '{n}' AS check_name, CAST(sum(n) AS BIGINT) AS rows_checked, "
                              f"CAST(coalesce(sum(n) FILTER (c.vals IS DISTINCT FROM r.vals), 0) AS BIGINT) AS mismatch_rows "
                              f"FROM (SELECT {k}, count(*) AS n, list({col} ORDER BY {col}) AS vals FROM {cur} GROUP BY {k}) c "
                              f"JOIN (SELECT {k}, list({col} ORDER BY {col}) AS vals FROM {raw} GROUP BY {k}) r USING ({k})"
                              for n, cur, raw, k, col in _REC),
         *[x for _, c, r, _, _ in _REC for x in (c, r)])

register("dq11_coverage", DQ.coverage, """
SELECT count(DISTINCT ol.product_id) AS affected_order_products, count(DISTINCT s.product_id) AS affected_shipment_products
FROM order_line_t ol LEFT JOIN shipment_t s ON ol.order_line_id = s.order_line_id""", "order_line_t", "shipment_t")

register("dq12_labelled_counts", DQ.labelled_counts, """
SELECT 'OPEN_PO_LINES' AS check_name, CAST(count_if(po_line_status = 'Open') AS BIGINT) AS row_count FROM purchase_order_line_t
UNION ALL SELECT 'LATE_RECEIPTS', CAST(count_if(r.receipt_date > p.promised_receipt_date) AS BIGINT)
          FROM supply_receipt_t r JOIN purchase_order_line_t p ON r.po_line_id = p.po_line_id
UNION ALL SELECT 'INVENTORY_BELOW_SAFETY_STOCK', CAST(count_if(available_quantity < safety_stock_quantity) AS BIGINT) FROM inventory_t
UNION ALL SELECT 'CONSTRAINED_PRODUCTION', CAST(count_if(production_status = 'Constrained') AS BIGINT) FROM production_t
UNION ALL SELECT 'PARTIALLY_FULFILLED_ORDER_LINES', CAST(count_if(order_status = 'Partially Fulfilled') AS BIGINT) FROM order_line_t
UNION ALL SELECT 'OPEN_ORDER_LINES', CAST(count_if(order_status = 'Open') AS BIGINT) FROM order_line_t
UNION ALL SELECT 'IN_TRANSIT_SHIPMENTS', CAST(count_if(shipment_status = 'In Transit') AS BIGINT) FROM shipment_t
UNION ALL SELECT 'LATE_DELIVERIES', CAST(count_if(actual_delivery_date > promised_date) AS BIGINT) FROM shipment_t""",
         "purchase_order_line_t", "supply_receipt_t", "inventory_t", "production_t", "order_line_t", "shipment_t")

register("dq13_po_receipt_evidence", DQ.po_receipt_evidence, """
SELECT po.po_line_id, po.supplier_id, po.part_id, po.plant_id, po.order_date, po.promised_receipt_date,
       r.receipt_id, r.receipt_date, CAST(r.receipt_date - po.promised_receipt_date AS INTEGER) AS receipt_delay_days
FROM purchase_order_line_t po LEFT JOIN supply_receipt_t r ON r.po_line_id = po.po_line_id""",
         "purchase_order_line_t", "supply_receipt_t")

register("dq13_snapshot_series", DQ.snapshot_series, """
SELECT part_id, plant_id, snapshot_date, available_quantity, safety_stock_quantity,
       available_quantity < safety_stock_quantity AS below_safety_stock_flag FROM inventory_t""", "inventory_t")

register("dq13_order_cohorts", DQ.order_cohorts, """
SELECT split_part(order_line_id, '-', 1) AS cohort, count(*) AS order_lines, sum(ordered_quantity) AS ordered_quantity,
       sum(fulfilled_quantity) AS fulfilled_quantity, CAST(count_if(order_status <> 'Fulfilled') AS BIGINT) AS lines_not_fulfilled
FROM order_line_t GROUP BY 1""", "order_line_t")

register("dq14_production_severity", DQ.production_severity, """
SELECT plant_id, product_id, count(*) AS production_days,
       round(avg(planned_quantity - produced_quantity), 2) AS avg_production_gap,
       round(avg(downtime_hours), 2) AS avg_downtime_hours,
       CAST(sum(CASE WHEN production_status = 'Constrained' THEN 1 ELSE 0 END) AS BIGINT) AS constrained_days
FROM production_t GROUP BY plant_id, product_id""", "production_t")

register("dq15_fulfillment_profile", DQ.fulfillment_profile, """
SELECT plant_id, product_id, count(*) AS order_lines, sum(ordered_quantity) AS ordered_qty,
       sum(fulfilled_quantity) AS fulfilled_qty, sum(ordered_quantity - fulfilled_quantity) AS unfulfilled_qty,
       round(100.0::DOUBLE * sum(fulfilled_quantity) / NULLIF(sum(ordered_quantity), 0), 2) AS fulfillment_pct
FROM order_line_t GROUP BY plant_id, product_id""", "order_line_t")

register("dq16_otd_profile", DQ.otd_profile, """
SELECT plant_id, product_id, count(*) AS shipment_count, sum(shipped_quantity) AS shipped_qty,
       CAST(sum(CASE WHEN actual_delivery_date IS NOT NULL AND actual_delivery_date <= promised_date THEN 1 ELSE 0 END) AS BIGINT) AS on_time_shipments,
       round(100.0::DOUBLE * sum(CASE WHEN actual_delivery_date IS NOT NULL AND actual_delivery_date <= promised_date THEN 1 ELSE 0 END)
             / NULLIF(sum(CASE WHEN actual_delivery_date IS NOT NULL THEN 1 ELSE 0 END), 0), 2) AS on_time_delivery_pct
FROM shipment_t GROUP BY plant_id, product_id""", "shipment_t")

register("dq17_supplier_delay", DQ.supplier_delay, """
SELECT po.supplier_id, count(*) AS receipt_count,
       round(avg(r.receipt_date - po.promised_receipt_date), 2) AS avg_receipt_delay_days
FROM purchase_order_line_t po JOIN supply_receipt_t r ON po.po_line_id = r.po_line_id GROUP BY po.supplier_id""",
         "purchase_order_line_t", "supply_receipt_t")

register("dq18_inventory_pressure", DQ.inventory_pressure, """
SELECT part_id, plant_id, min(snapshot_date) AS first_snapshot,
       min(CASE WHEN available_quantity < safety_stock_quantity THEN snapshot_date END) AS first_below_safety_stock,
       min(available_quantity) AS minimum_available_quantity, max(safety_stock_quantity) AS safety_stock_quantity
FROM inventory_t GROUP BY part_id, plant_id""", "inventory_t")

register("dq19_where_used", DQ.where_used, """
SELECT pp.part_id, pp.product_id, p.product_name, pp.quantity_per_product, pp.critical_part_flag
FROM product_part_t pp JOIN product_t p ON pp.product_id = p.product_id WHERE pp.critical_part_flag""",
         "product_part_t", "product_t")

register("dq20_first_constrained", DQ.first_constrained, """
SELECT plant_id, product_id, min(production_date) AS first_constrained_date
FROM production_t WHERE production_status = 'Constrained' GROUP BY plant_id, product_id""", "production_t")

register("dq21_exposed_products", DQ.exposed_products, """
SELECT DISTINCT plant_id, product_id, product_name, critical_part_count, critical_parts, watched_part_exposure_flag,
       watched_part_qty_per_product FROM production_performance WHERE watched_part_exposure_flag""",
         "production_performance")


# --- builders ----------------------------------------------------------------------------------
register("bld1_calendar", lambda t: t.date_dim, "SELECT * FROM date_t", "date_t")


def _po_keys(t: Tables):
    po = t.columns("purchase_order_line", "po_line_id", "order_date", "supplier_id", "ordered_quantity")
    return surrogate_key(po, ["order_date", "po_line_id"], "po_seq_id", prefix="PO-", width=9, num_partitions=t.partitions)


register("bld3_surrogate_key", _po_keys, """
SELECT po_line_id, order_date, supplier_id, ordered_quantity,
       'PO-' || lpad(CAST(row_number() OVER (ORDER BY order_date, po_line_id) AS VARCHAR), 9, '0') AS po_seq_id
FROM purchase_order_line_t""", "purchase_order_line_t")

register("bld5_bucket_counts", lambda t: t.columns("order_line", "order_line_id", "ordered_quantity").groupBy(X.bucket(F.col("order_line_id"), 9).alias("bucket")).agg(
    F.count(F.lit(1)).alias("order_lines"), F.sum("ordered_quantity").alias("ordered_quantity")), """
SELECT CAST(('0x' || substr(md5(order_line_id), 1, 8)) AS BIGINT) % 9 AS bucket, count(*) AS order_lines,
       sum(ordered_quantity) AS ordered_quantity FROM order_line_t GROUP BY 1""", "order_line_t")

# Service zones assigned cyclically by customer key.
ZONES = ["North", "South", "East", "West"]
register("bld6_cycle_assignment", lambda t: t.customer.groupBy(
    X.cycle(F.col("customer_id"), ZONES).alias("service_zone"), "customer_segment").agg(
    F.count(F.lit(1)).alias("customers")), """
SELECT (['North', 'South', 'East', 'West'])[CAST(customer_id % 4 AS INTEGER) + 1] AS service_zone, customer_segment,
       count(*) AS customers FROM customer_t GROUP BY 1, 2""", "customer_t")

# Order-size bands (inclusive bounds).
SIZE_BANDS = [(0, 10, "XS"), (11, 25, "S"), (26, 40, "M"), (41, 50, "L")]
register("bld7_banded", lambda t: t.columns("order_line", "ordered_quantity", "fulfilled_quantity").groupBy(
    X.banded(F.col("ordered_quantity"), SIZE_BANDS, "XL").alias("size_band")).agg(
    F.count(F.lit(1)).alias("order_lines"), F.sum("fulfilled_quantity").alias("fulfilled_quantity")), """
SELECT CASE WHEN ordered_quantity BETWEEN 0 AND 10 THEN 'XS' WHEN ordered_quantity BETWEEN 11 AND 25 THEN 'S'
            WHEN ordered_quantity BETWEEN 26 AND 40 THEN 'M' WHEN ordered_quantity BETWEEN 41 AND 50 THEN 'L'
            ELSE 'XL' END AS size_band, count(*) AS order_lines, sum(fulfilled_quantity) AS fulfilled_quantity
FROM order_line_t GROUP BY 1""", "order_line_t")


def _sampled_po(t: Tables):
    d = t.date_dim.select(F.col("calendar_date").alias("order_date"), "date_key")
    sampled = sample_mod(d, F.col("date_key") + 4, 9)
    return (t.purchase_order_line.join(F.broadcast(sampled), "order_date")
            .groupBy("plant_id").agg(F.count(F.lit(1)).alias("po_lines"), F.sum("ordered_quantity").alias("ordered_quantity")))


register("bld8_systematic_sample", _sampled_po, """
SELECT p.plant_id, count(*) AS po_lines, sum(p.ordered_quantity) AS ordered_quantity
FROM purchase_order_line_t p JOIN date_t d ON p.order_date = d.calendar_date
WHERE (d.date_key + 4) % 9 = 0 GROUP BY p.plant_id""", "purchase_order_line_t", "date_t")

# Expected service haircut by customer priority.
RATES = [("Strategic", 0.0), ("High", 0.1), ("Standard", 0.25)]


def _rated(t: Tables):
    rates = t.spark.createDataFrame(RATES, "customer_priority string, rate double")
    f = SUR.customer_fulfillment(t).select("order_line_id", "customer_priority", "ordered_quantity")
    return (apply_rate(f, F.broadcast(rates), "customer_priority", "ordered_quantity", out="expected_fulfilled")
            .groupBy("customer_priority").agg(F.sum("expected_fulfilled").alias("expected_fulfilled"),
                                              F.sum("ordered_quantity").alias("ordered_quantity")))


register("bld9_rate", _rated, """
WITH r AS (SELECT * FROM (VALUES ('Strategic', 0.0::DOUBLE), ('High', 0.1::DOUBLE), ('Standard', 0.25::DOUBLE)) v(customer_priority, rate))
SELECT f.customer_priority, sum(greatest(0.0, round(f.ordered_quantity * (1.0 - COALESCE(r.rate, 0.0))))) AS expected_fulfilled,
       sum(f.ordered_quantity) AS ordered_quantity
FROM customer_fulfillment f LEFT JOIN r ON f.customer_priority = r.customer_priority GROUP BY f.customer_priority""",
         "customer_fulfillment")


# --- operators -----------------------------------------------------------------------------
register("jn03_critical_bom", lambda t: SUR.critical_bom(t), "SELECT * FROM critical_bom", "critical_bom")

register("jn07_uninspected_supplier_parts", lambda t: orphans(
    t.supplier_part.select("supplier_id", "part_id", "supplier_part_id"),
    t.columns("quality", "supplier_id", "part_id"), ["supplier_id", "part_id"]), """
SELECT sp.supplier_id, sp.part_id, sp.supplier_part_id FROM supplier_part_t sp
WHERE NOT EXISTS (SELECT 1 FROM quality_t q WHERE q.supplier_id = sp.supplier_id AND q.part_id = sp.part_id)""",
         "supplier_part_t", "quality_t")

register("jn09_reconcile_on_hand", lambda t: reconcile(SUR.inventory_position(t), t.inventory,
                                                       "inventory_snapshot_id", "on_hand_quantity"), """
SELECT count(*) AS rows_checked, CAST(count_if(c.on_hand_quantity IS DISTINCT FROM r.on_hand_quantity) AS BIGINT) AS mismatches
FROM inventory_position c JOIN inventory_t r ON c.inventory_snapshot_id = r.inventory_snapshot_id""",
         "inventory_position", "inventory_t")

register("agg06_first_when", lambda t: t.production.groupBy("plant_id").agg(
    X.first_when("production_date", F.col("production_status") == "Constrained").alias("first_constrained_date"),
    F.min("production_date").alias("first_production_date")), """
SELECT plant_id, min(CASE WHEN production_status = 'Constrained' THEN production_date END) AS first_constrained_date,
       min(production_date) AS first_production_date FROM production_t GROUP BY plant_id""", "production_t")

register("agg07_any_when", lambda t: t.production.groupBy("product_id").agg(
    X.any_when(F.col("production_status") == "Constrained").alias("ever_constrained"),
    X.value_when("planned_quantity", F.col("production_status") == "Constrained").alias("max_constrained_plan")), """
SELECT product_id, bool_or(production_status = 'Constrained') AS ever_constrained,
       max(CASE WHEN production_status = 'Constrained' THEN planned_quantity END) AS max_constrained_plan
FROM production_t GROUP BY product_id""", "production_t")

register("agg13_listagg", lambda t: listagg(
    t.product.select("product_family", "product_category").distinct(), ["product_family"],
    F.col("product_category"), F.col("product_category"), ", ").withColumnRenamed("listagg", "categories"), """
SELECT product_family, string_agg(product_category, ', ' ORDER BY product_category) AS categories
FROM (SELECT DISTINCT product_family, product_category FROM product_t) GROUP BY product_family""", "product_t")


def _two_level_vs_row(t: Tables):
    r = t.promised_receipts.withColumn("delay", X.days_between("promised_receipt_date", "receipt_date"))
    per_line = r.groupBy("po_id", "po_line_id", "supplier_id").agg(F.avg("delay").alias("line_mean"),
                                                          F.sum("delay").alias("s"), F.count(F.lit(1)).alias("n"))
    return per_line.groupBy("supplier_id").agg(
        X.dround(F.avg("line_mean"), 6).alias("mean_of_line_means"),
        X.dround(F.sum("s") / F.sum("n"), 6).alias("row_mean"))


register("agg14_two_level", _two_level_vs_row, """
WITH l AS (SELECT r.po_line_id, r.supplier_id, avg(r.receipt_date - p.promised_receipt_date) AS line_mean,
                  sum(r.receipt_date - p.promised_receipt_date) AS s, count(*) AS n
           FROM supply_receipt_t r JOIN purchase_order_line_t p ON r.po_line_id = p.po_line_id
           GROUP BY r.po_line_id, r.supplier_id)
SELECT supplier_id, round(avg(line_mean), 6) AS mean_of_line_means, round(sum(s)::DOUBLE / sum(n), 6) AS row_mean
FROM l GROUP BY supplier_id""", "purchase_order_line_t", "supply_receipt_t")

register("agg15_duplicates", lambda t: duplicates(t.read("lineitem", "l_orderkey", "l_linenumber"),
                                                  ["l_orderkey", "l_linenumber"]), """
SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")

register("set2_universe", lambda t: universe(
    [SUR.customer_fulfillment(t), SUR.shipment_performance(t), SUR.production_performance(t)],
    ["product_id", "product_name"]), """
SELECT product_id, product_name FROM customer_fulfillment UNION SELECT product_id, product_name FROM shipment_performance
UNION SELECT product_id, product_name FROM production_performance""",
         "customer_fulfillment", "shipment_performance", "production_performance")

register("win2_topk", lambda t: top_k(
    SUR.customer_fulfillment(t, columns=("order_line_id", "product_id", "unfulfilled_quantity")),
    [F.col("unfulfilled_quantity").desc(), F.col("order_line_id").asc()], 100), """
SELECT order_line_id, product_id, unfulfilled_quantity FROM customer_fulfillment
ORDER BY unfulfilled_quantity DESC, order_line_id LIMIT 100""", "customer_fulfillment")


# --- storage and hand-off ------------------------------------------------------------------------
def _scratch(t: Tables) -> str:
    """A new folder beside the checkpoints, which every executor reaches."""
    return f"{checkpoint_dir(t.spark).rstrip('/')}/layers-{uuid.uuid4().hex}"


def _appended(t: Tables):
    root = _scratch(t)
    path, even = f"{IO.layers(root)['raw']}/customer", F.col("customer_id") % 2 == 0
    IO.append(t.customer.filter(even), path)
    IO.append(t.customer.filter(~even), path)
    return IO.table(t.spark, root, "raw", "customer")


def _batches(t: Tables):
    """Two batches, the first of them loaded twice."""
    root = _scratch(t)
    path, even = f"{IO.layers(root)['raw']}/customer", F.col("customer_id") % 2 == 0
    for batch, rows in (("even", even), ("odd", ~even), ("even", even)):
        IO.append(t.customer.filter(rows), path, batch)
    return IO.table(t.spark, root, "raw", "customer")


def _refreshed(t: Tables):
    """A reader of the first version, one of the second, and one that is content with what is there."""
    path, whole = f"{_scratch(t)}/quality", SUR.quality_summary(t)
    first = IO.materialise(whole.filter("defective_quantity > 0"), path)
    second = IO.materialise(whole, path)
    third = IO.materialise(whole.limit(0), path, max_age=3600)
    count = lambda df, who: df.agg(F.count(F.lit(1)).alias("supplier_parts"), F.sum("defective_quantity").alias("defective_quantity")).select(
        F.lit(who).alias("reader"), "supplier_parts", "defective_quantity")
    return count(first, "first").unionByName(count(second, "second")).unionByName(count(third, "third"))


def _rebuilt(t: Tables):
    root = _scratch(t)
    IO.write_raw_layer(t, root, ["inventory"])
    return IO.read_raw_layer(t.spark, root, ["inventory"]).inventory


def _viewed(t: Tables):
    IO.register_surface("v_inventory_position", SUR.inventory_position(t))
    return t.spark.sql("SELECT inventory_risk_band, count(*) AS positions, sum(available_quantity) AS available_quantity "
                       "FROM v_inventory_position GROUP BY inventory_risk_band")


def _handed_off(t: Tables):
    """A final aggregate through pandas and back, typed by its own schema."""
    small = DSH.posture(t)
    return t.spark.createDataFrame(IO.to_rows(small, 10), small.schema)


register("src6_append", _appended, "SELECT * FROM customer_t", "customer_t")
register("src4_literal_rows", lambda t: IO.rows(t.spark, "carrier", CARRIERS).join(
    t.columns("shipment", "carrier_id").groupBy("carrier_id").agg(F.count(F.lit(1)).alias("shipments")), "carrier_id", "left"), """
SELECT c.*, n.shipments FROM carrier_t c LEFT JOIN (SELECT carrier_id, count(*) AS shipments FROM shipment_t GROUP BY carrier_id) n USING (carrier_id)""",
         "carrier_t", "shipment_t")
register("src5_row_source", lambda t: IO.row_source(t.spark, 9).join(
    t.read("lineitem", "l_linenumber").groupBy(F.col("l_linenumber").alias("seq")).agg(F.count(F.lit(1)).alias("lines")), "seq", "left").select(
    "seq", F.coalesce("lines", F.lit(0)).alias("lines")), """
SELECT seq, count(l_linenumber) AS lines FROM (SELECT unnest(range(1, 10)) AS seq) s LEFT JOIN lineitem ON l_linenumber = seq GROUP BY seq""")
register("prj8_order_cohort", lambda t: DQ.order_cohort(t, "1"), """
SELECT order_line_id, customer_id, product_id, plant_id, promised_date, ordered_quantity, fulfilled_quantity, order_status
FROM order_line_t WHERE order_line_id LIKE '1%'""", "order_line_t")
register("fn3_nested_bands", lambda t: t.part.select("part_id", X.banded("standard_cost", [(0, 1000, "LOW"), (1000.01, 1400, "MID")], X.banded(
    F.length("part_name"), [(0, 20, "HIGH, SHORT NAME")], "HIGH")).alias("band")), """
SELECT part_id, CASE WHEN standard_cost BETWEEN 0 AND 1000 THEN 'LOW' WHEN standard_cost BETWEEN 1000.01 AND 1400 THEN 'MID'
       ELSE CASE WHEN length(part_name) BETWEEN 0 AND 20 THEN 'HIGH, SHORT NAME' ELSE 'HIGH' END END AS band FROM part_t""", "part_t")
register("src6_append_batches", _batches, "SELECT * FROM customer_t", "customer_t")
register("src7_rebuild_partitioned", _rebuilt, "SELECT * FROM inventory_t", "inventory_t")
register("src8_view", _viewed, """
SELECT inventory_risk_band, count(*) AS positions, sum(available_quantity) AS available_quantity
FROM inventory_position GROUP BY inventory_risk_band""", "inventory_position")
register("src9_materialise", lambda t: IO.materialise(SUR.quality_summary(t), f"{_scratch(t)}/quality"), """
SELECT supplier_id, part_id, sum(inspected_quantity) AS inspected_quantity, sum(defective_quantity) AS defective_quantity
FROM quality_t GROUP BY supplier_id, part_id""", "quality_t")
register("src9_refresh", _refreshed, """
WITH q AS (SELECT supplier_id, part_id, sum(defective_quantity) AS d FROM quality_t GROUP BY supplier_id, part_id)
SELECT 'first' AS reader, count(*) AS supplier_parts, sum(d) AS defective_quantity FROM q WHERE d > 0
UNION ALL SELECT 'second', count(*), sum(d) FROM q UNION ALL SELECT 'third', count(*), sum(d) FROM q""", "quality_t")
register("src2_required_values", lambda t: report([null_counts(t.columns(n, *required(n)), n) for n in t.ENTITIES]), "\nUNION ALL\n".join(
    f"SELECT '{n}' AS table_name, '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS nulls FROM {cte}"
    for n, cte in zip(Tables.ENTITIES, _ENTITY_CTES) for c in required(n)), *_ENTITY_CTES)
register("jn14_integrity", lambda t: t.integrity(), "\nUNION ALL\n".join(f"""
SELECT '{edge}' AS edge, count(*) AS child_rows, CAST(count_if(n IS NULL) AS BIGINT) AS orphans, CAST(count_if(n > 1) AS BIGINT) AS multiplied,
       CAST(count_if(good < n) AS BIGINT) AS incomplete
FROM {child} c LEFT JOIN (SELECT {pk}, count(*) AS n, count_if({good}) AS good FROM {parent} GROUP BY {pk}) p ON c.{ck} = p.{pk}"""
    for edge, child, ck, parent, pk, good in (
        ("part", "lineitem", "l_partkey", "part", "p_partkey", "p_brand IS NOT NULL AND p_type IS NOT NULL"),
        ("supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey", "s_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)"),
        ("orders", "lineitem", "l_orderkey", "orders", "o_orderkey", "true"), ("customer", "orders", "o_custkey", "customer", "c_custkey", "true"))))
register("agg13_part_rows", SUR.critical_part_rows, f"""
SELECT product_id, chunk, CAST(sum(items) OVER (PARTITION BY product_id ORDER BY chunk) - items + 1 AS BIGINT) AS position, items, part
FROM (SELECT product_id, part_id // {SUR.LIST_CHUNK} AS chunk, count(*) AS items,
             string_agg(CAST(part_id AS VARCHAR) || ' (' || CAST(quantity_per_product AS VARCHAR) || ')', ', ' ORDER BY part_id) AS part
      FROM product_part_t WHERE critical_part_flag GROUP BY product_id, part_id // {SUR.LIST_CHUNK})""", "product_part_t")


def _changed(t: Tables):
    """Inventory against a copy in which a hundredth of the parts' balances were changed, both stacked twice: keys repeat on both sides."""
    raw = t.inventory.select("inventory_snapshot_id", "part_id", "on_hand_quantity")
    other = raw.withColumn("on_hand_quantity", F.col("on_hand_quantity") + F.when(F.col("part_id") % 100 == 0, 1.0).otherwise(0.0))
    return reconcile(raw.unionByName(raw), other.unionByName(raw), "inventory_snapshot_id", "on_hand_quantity")


register("jn09_reconcile_repeats", _changed, """
SELECT CAST(2 * count(*) AS BIGINT) AS rows_checked, CAST(2 * count_if(part_id % 100 = 0) AS BIGINT) AS mismatches FROM inventory_t""", "inventory_t")
register("src10_hand_off", _handed_off, REGISTRY["dsh06_posture"].sql)
register("dsh11_batch", run_batch, "\nUNION ALL\n".join(
    f"SELECT '{name}' AS query_id, CASE WHEN count(*) > 0 THEN 'SUCCESS' ELSE 'NO_ROWS' END AS status, "
    f"count(*) AS row_count, CAST(NULL AS VARCHAR) AS error FROM ({REGISTRY[name].sql})" for name in VERIFIED))
