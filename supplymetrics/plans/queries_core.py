"""Registered queries: curated surfaces, verified queries, metrics and semantic roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplymetrics.operators.relational import report
from supplymetrics.plans import surfaces as SUR
from supplymetrics.plans import verified as VQ
from supplymetrics.plans.catalog import register
from supplymetrics.plans.semantic import DENSE_MODEL, MODEL, AmbiguousName, GrainError

R9 = "round({}, 9)"

# --- surfaces ---------------------------------------------------------------------------------
register("sur1_supplier_performance", SUR.supplier_performance,
         "SELECT * FROM supplier_performance", "supplier_performance")
register("sur2_inventory_position", SUR.inventory_position,
         "SELECT * FROM inventory_position", "inventory_position")
register("sur3_production_performance", SUR.production_performance,
         "SELECT * FROM production_performance", "production_performance")
register("sur4_customer_fulfillment", SUR.customer_fulfillment,
         "SELECT * FROM customer_fulfillment", "customer_fulfillment")
register("sur5_shipment_performance", SUR.shipment_performance,
         "SELECT * FROM shipment_performance", "shipment_performance")
register("sur6_product_risk_signals", SUR.risk_signals,
         "SELECT * FROM product_risk_signals", "product_risk_signals")

# --- verified queries -------------------------------------------------------------------------
register("vq01_fulfillment_by_segment", VQ.vq01_fulfillment_by_segment, """
SELECT customer_segment, round(sum(fulfilled_quantity) / NULLIF(sum(ordered_quantity), 0), 9) AS fulfillment_rate
FROM customer_fulfillment GROUP BY customer_segment ORDER BY fulfillment_rate""", "customer_fulfillment")

register("vq02_gaps_by_family", VQ.vq02_gaps_by_family, """
SELECT product_family, CAST(count_if(fulfillment_gap_flag) AS BIGINT) AS order_lines_with_fulfillment_gaps
FROM customer_fulfillment GROUP BY product_family ORDER BY 2 DESC""", "customer_fulfillment")

register("vq03_otd_by_carrier", VQ.vq03_otd_by_carrier, """
SELECT carrier_name, round(count_if(on_time_flag)::DOUBLE / NULLIF(count_if(delivery_eligible_flag), 0), 9) AS on_time_delivery_rate
FROM shipment_performance GROUP BY carrier_name ORDER BY 2""", "shipment_performance")

register("vq04_delay_by_priority", VQ.vq04_delay_by_priority, """
SELECT customer_priority, round(avg(CASE WHEN delivery_eligible_flag THEN delivery_delay_days END), 9) AS avg_delivery_delay_days
FROM shipment_performance GROUP BY customer_priority ORDER BY 2 DESC""", "shipment_performance")

register("vq05_attainment_by_plant", VQ.vq05_attainment_by_plant, """
SELECT plant_name, round(sum(produced_quantity) / NULLIF(sum(planned_quantity), 0), 9) AS production_attainment
FROM production_performance GROUP BY plant_name ORDER BY 2""", "production_performance")

register("vq06_constrained_exposed", VQ.vq06_constrained_exposed, """
SELECT product_name, CAST(count_if(constraint_flag) AS BIGINT) AS constrained_production_days,
       count(*) AS total_production_days
FROM production_performance WHERE watched_part_exposure_flag GROUP BY product_name ORDER BY 2 DESC""",
         "production_performance")

register("vq07_below_safety_latest", VQ.vq07_below_safety_latest, """
SELECT plant_name, CAST(count_if(below_safety_stock_flag) AS BIGINT) AS parts_below_safety_stock
FROM inventory_position WHERE snapshot_date = (SELECT max(snapshot_date) FROM inventory_position)
GROUP BY plant_name ORDER BY 2 DESC""", "inventory_position")

register("vq08_available_by_date", VQ.vq08_available_by_date, """
SELECT snapshot_date, sum(available_quantity) AS total_available
FROM inventory_position GROUP BY snapshot_date ORDER BY snapshot_date""", "inventory_position")

register("vq09_defect_by_tier", VQ.vq09_defect_by_tier, """
SELECT supplier_tier, round(sum(defective_quantity) / NULLIF(sum(inspected_quantity), 0), 9) AS defect_rate
FROM supplier_performance GROUP BY supplier_tier ORDER BY 2 DESC""", "supplier_performance")

register("vq10_high_receipt_delay", VQ.vq10_high_receipt_delay, """
SELECT supplier_name, part_name, avg_receipt_delay_days, supply_risk_band
FROM supplier_performance WHERE avg_receipt_delay_days > 2 ORDER BY avg_receipt_delay_days DESC""",
         "supplier_performance")

register("vq13_multi_signal_products", VQ.vq13_multi_signal_products, """
SELECT product_name, fulfillment_rate, on_time_delivery_rate, production_attainment, risk_signal_count,
       fulfillment_risk_flag, delivery_risk_flag, production_risk_flag
FROM product_risk_signals WHERE risk_signal_count >= 2
ORDER BY risk_signal_count DESC, production_attainment ASC""", "product_risk_signals")

register("vq14_exposed_and_constrained", VQ.vq14_exposed_and_constrained, """
SELECT product_name, CAST(count_if(constraint_flag) AS BIGINT) AS constrained_production_days,
       CAST(count_if(watched_part_exposure_flag) AS BIGINT) AS exposed_production_days
FROM production_performance
WHERE watched_part_exposure_flag
  AND production_date >= date_trunc('month', (SELECT max(production_date) FROM production_performance))
  AND production_date <= last_day((SELECT max(production_date) FROM production_performance))
GROUP BY product_name HAVING count_if(constraint_flag) > 0 ORDER BY 2 DESC""", "production_performance")


# --- governed metrics, each by one dimension (through the semantic operator) ----------------
def _met(dim, metric):
    return lambda t: MODEL.query(t, [dim], [metric])


_MET_SQL = {
    "fulfillment_rate": ("customer_fulfillment", "round(sum(fulfilled_quantity) / NULLIF(sum(ordered_quantity), 0), 9)"),
    "order_lines_with_fulfillment_gaps": ("customer_fulfillment", "CAST(count_if(fulfillment_gap_flag) AS BIGINT)"),
    "on_time_delivery_rate": ("shipment_performance",
                              "round(count_if(on_time_flag)::DOUBLE / NULLIF(count_if(delivery_eligible_flag), 0), 9)"),
    "avg_delivery_delay_days": ("shipment_performance",
                                "round(avg(CASE WHEN delivery_eligible_flag THEN delivery_delay_days END), 9)"),
    "production_attainment": ("production_performance",
                              "round(sum(produced_quantity) / NULLIF(sum(planned_quantity), 0), 9)"),
    "constrained_production_days": ("production_performance", "CAST(count_if(constraint_flag) AS BIGINT)"),
    "exposed_production_days": ("production_performance", "CAST(count_if(watched_part_exposure_flag) AS BIGINT)"),
    "total_on_hand": ("inventory_position", "sum(on_hand_quantity)"),
    "total_available": ("inventory_position", "sum(available_quantity)"),
    "parts_below_safety_stock": ("inventory_position", "CAST(count_if(below_safety_stock_flag) AS BIGINT)"),
    "defect_rate": ("supplier_performance", "round(sum(defective_quantity) / NULLIF(sum(inspected_quantity), 0), 9)"),
    "rejection_rate": ("supplier_performance", "round(sum(rejected_quantity) / NULLIF(sum(received_quantity), 0), 9)"),
}


def _semi_sql(dim: str, metric: str) -> str:
    """Semi-additive: per group, the value at the group's latest snapshot date."""
    table, expr = _MET_SQL[metric]
    return f"""
SELECT {dim}, {metric} FROM (
  SELECT {dim}, snapshot_date, {expr} AS {metric},
         row_number() OVER (PARTITION BY {dim} ORDER BY snapshot_date DESC) AS rn
  FROM {table} GROUP BY {dim}, snapshot_date) WHERE rn = 1"""


_METRIC_KEYS = [
    ("met01_fulfillment_rate_by_region", "customer_region", "fulfillment_rate"),
    ("met02_gap_lines_by_plant", "plant_name", "order_lines_with_fulfillment_gaps"),
    ("met03_otd_by_service_level", "service_level", "on_time_delivery_rate"),
    ("met04_avg_delay_by_carrier", "carrier_name", "avg_delivery_delay_days"),
    ("met05_attainment_by_family", "product_family", "production_attainment"),
    ("met06_constrained_days_by_region", "plant_region", "constrained_production_days"),
    ("met07_exposed_days_by_plant", "plant_name", "exposed_production_days"),
    ("met08_on_hand_by_plant", "plant_name", "total_on_hand"),
    ("met09_available_by_criticality", "criticality", "total_available"),
    ("met10_below_safety_by_region", "plant_region", "parts_below_safety_stock"),
    ("met11_defect_rate_by_region", "supplier_region", "defect_rate"),
    ("met12_rejection_rate_by_tier", "supplier_tier", "rejection_rate"),
]

for _key, _dim, _metric in _METRIC_KEYS:
    _table, _expr = _MET_SQL[_metric]
    if _table == "inventory_position":
        _sql = _semi_sql(_dim, _metric)
    else:
        _sql = f"SELECT {_dim}, {_expr} AS {_metric} FROM {_table} GROUP BY {_dim}"
    register(_key, _met(_dim, _metric), _sql, _table)


# --- semantic roll-ups and semi-additive forms ------------------------------------------------
register("sem_rollup_month",
         lambda t: MODEL.query(t, ["year", "month"], ["fulfillment_rate", "order_lines_with_fulfillment_gaps"]),
         """
SELECT d.year, d.month, round(sum(f.fulfilled_quantity) / NULLIF(sum(f.ordered_quantity), 0), 9) AS fulfillment_rate,
       CAST(count_if(f.fulfillment_gap_flag) AS BIGINT) AS order_lines_with_fulfillment_gaps
FROM customer_fulfillment f LEFT JOIN date_t d ON f.order_date = d.calendar_date GROUP BY d.year, d.month""",
         "customer_fulfillment", "date_t")

register("sem_rollup_quarter",
         lambda t: MODEL.query(t, ["year", "quarter", "plant_region"], ["production_attainment", "constrained_production_days"]),
         """
SELECT d.year, d.quarter, p.plant_region,
       round(sum(p.produced_quantity) / NULLIF(sum(p.planned_quantity), 0), 9) AS production_attainment,
       CAST(count_if(p.constraint_flag) AS BIGINT) AS constrained_production_days
FROM production_performance p LEFT JOIN date_t d ON p.production_date = d.calendar_date
GROUP BY d.year, d.quarter, p.plant_region""", "production_performance", "date_t")

register("sem_rollup_week_weekend",
         lambda t: MODEL.query(t, ["is_weekend", "day_name"], ["on_time_delivery_rate", "avg_delivery_delay_days"]),
         """
SELECT d.is_weekend, d.day_name,
       round(count_if(s.on_time_flag)::DOUBLE / NULLIF(count_if(s.delivery_eligible_flag), 0), 9) AS on_time_delivery_rate,
       round(avg(CASE WHEN s.delivery_eligible_flag THEN s.delivery_delay_days END), 9) AS avg_delivery_delay_days
FROM shipment_performance s LEFT JOIN date_t d ON s.ship_date = d.calendar_date GROUP BY d.is_weekend, d.day_name""",
         "shipment_performance", "date_t")

register("sem_foreign_dim",
         lambda t: MODEL.query(t, ["carrier_region", "service_level"], ["on_time_delivery_rate"]),
         """
SELECT c.carrier_region, s.service_level,
       round(count_if(s.on_time_flag)::DOUBLE / NULLIF(count_if(s.delivery_eligible_flag), 0), 9) AS on_time_delivery_rate
FROM shipment_performance s LEFT JOIN carrier_t c ON s.carrier_id = c.carrier_id
GROUP BY c.carrier_region, s.service_level""", "shipment_performance", "carrier_t")

register("sem_filtered_synonyms",
         lambda t: MODEL.query(t, ["segment"], ["fill rate", "backorder count"],
                               where=F.col("customer_priority") == "Strategic"),
         """
SELECT customer_segment, round(sum(fulfilled_quantity) / NULLIF(sum(ordered_quantity), 0), 9) AS fulfillment_rate,
       CAST(count_if(fulfillment_gap_flag) AS BIGINT) AS order_lines_with_fulfillment_gaps
FROM customer_fulfillment WHERE customer_priority = 'Strategic' GROUP BY customer_segment""", "customer_fulfillment")

register("sem_filter_foreign_dim",
         lambda t: MODEL.query(t, ["plant_name"], ["fulfillment_rate"], where="year = 1998 and plant.region = 'ASIA'"),
         """
SELECT f.plant_name, round(sum(f.fulfilled_quantity) / NULLIF(sum(f.ordered_quantity), 0), 9) AS fulfillment_rate
FROM customer_fulfillment f JOIN date_t d ON f.order_date = d.calendar_date JOIN plant_t p ON f.plant_id = p.plant_id
WHERE d.year = 1998 AND p.region = 'ASIA' GROUP BY f.plant_name""", "customer_fulfillment", "date_t", "plant_t")

register("sem_filter_functions",
         lambda t: MODEL.query(t, ["segment"], ["fill rate"], aggregates={"missing": ("sum", "backorder quantity")},
                               where="year(order_date) = 1998 and month(`promise date`) between 2 and 11 and order_date >= date '1998-03-01' "
                                     "and `market segment` <> \"BUILDING\" and plant.region in ('ASIA', 'EUROPE', 'year') "
                                     "and case when is_weekend then quarter > 1 else `day_name` <> 'Mon' end"),
         """
SELECT f.customer_segment, round(sum(f.fulfilled_quantity) / NULLIF(sum(f.ordered_quantity), 0), 9) AS fulfillment_rate,
       sum(f.unfulfilled_quantity) AS missing
FROM customer_fulfillment f JOIN date_t d ON f.order_date = d.calendar_date JOIN plant_t p ON f.plant_id = p.plant_id
WHERE d.year = 1998 AND month(f.promised_date) BETWEEN 2 AND 11 AND f.order_date >= DATE '1998-03-01' AND f.customer_segment <> 'BUILDING'
  AND p.region IN ('ASIA', 'EUROPE', 'year') AND CASE WHEN d.is_weekend THEN d.quarter > 1 ELSE d.day_name <> 'Mon' END
GROUP BY f.customer_segment""", "customer_fulfillment", "date_t", "plant_t")

register("sem_rollup_levels",
         lambda t: MODEL.query(t, [*MODEL.levels("calendar.quarter"), *MODEL.levels("family"), "product.product_family"], ["attainment rate"]),
         """
SELECT d.year, d.quarter, pr.product_family, round(sum(x.produced_quantity) / NULLIF(sum(x.planned_quantity), 0), 9) AS production_attainment
FROM production_performance x JOIN date_t d ON x.production_date = d.calendar_date JOIN product_t pr ON x.product_id = pr.product_id
GROUP BY d.year, d.quarter, pr.product_family""", "production_performance", "date_t", "product_t")

def _refusals(t: Tables):
    """What the model answers to requests that its rules settle: a refusal by its kind, or the value asked for."""
    ordered = lambda table: {"aggregates": {"value": ("sum", f"{table}.ordered_quantity")}}
    asked = [
        ("inventory beside production", {"metrics": ["total_on_hand", "production_attainment"]}),
        ("suppliers beside shipments", {"metrics": ["defect_rate", "on_time_delivery_rate"]}),
        ("production by a bill of materials", {"dimensions": ["product_part.part_id"], "metrics": ["production_attainment"]}),
        ("sum of a ratio", {"aggregates": {"value": ("sum", "supplier_performance.defect_rate_pct")}}),
        ("sum of a key", {"aggregates": {"value": ("sum", "inventory_position.part_id")}}),
        ("a name of two tables", {"dimensions": ["ordered_quantity"]}),
        ("ordered by customers", ordered("customer_fulfillment")),
        ("ordered from suppliers", ordered("supplier_performance")),
    ]
    rows = []
    for request, parts in asked:
        try:
            rows.append(MODEL.query(t, **parts).select(F.lit(request).alias("request"), F.lit("ANSWERED").alias("status"), F.col("value")))
        except (GrainError, AmbiguousName) as e:
            status = "REFUSED" if isinstance(e, GrainError) else "AMBIGUOUS"
            rows.append(t.spark.range(1).select(F.lit(request).alias("request"), F.lit(status).alias("status"), F.lit(None).cast("double").alias("value")))
    return report(rows)


register("sem_refusals", _refusals, """
SELECT unnest(['inventory beside production', 'suppliers beside shipments', 'production by a bill of materials', 'sum of a ratio', 'sum of a key']) AS request,
       'REFUSED' AS status, CAST(NULL AS DOUBLE) AS value
UNION ALL SELECT 'a name of two tables', 'AMBIGUOUS', NULL
UNION ALL SELECT 'ordered by customers', 'ANSWERED', sum(ordered_quantity) FROM customer_fulfillment
UNION ALL SELECT 'ordered from suppliers', 'ANSWERED', sum(ordered_quantity) FROM supplier_performance""",
         "customer_fulfillment", "supplier_performance")

# An as-of join against every month end: another way to the balances that the window and the exploded months give.
_DENSE = """
dense AS (
  SELECT s.part_id, s.plant_id, m.snapshot_date, i.on_hand_quantity, i.reserved_quantity, i.available_quantity, i.safety_stock_quantity
  FROM (SELECT part_id, plant_id, min(snapshot_date) AS since FROM inventory_position GROUP BY part_id, plant_id) s
  JOIN (SELECT DISTINCT last_day(calendar_date) AS snapshot_date FROM date_t) m
    ON m.snapshot_date BETWEEN s.since AND (SELECT max(snapshot_date) FROM inventory_position)
  ASOF JOIN inventory_position i ON i.part_id = s.part_id AND i.plant_id = s.plant_id AND i.snapshot_date <= m.snapshot_date)"""

register("bld2_dense_snapshots",
         lambda t: SUR.inventory_position(t, dense=True).groupBy("snapshot_date", "plant_region").agg(
             F.count(F.lit(1)).alias("positions"), F.sum("on_hand_quantity").alias("on_hand"), F.sum("available_quantity").alias("available"),
             F.count_if(F.col("below_safety_stock_flag")).alias("below_safety_stock")),
         f"""
WITH {_DENSE.strip()}
SELECT d.snapshot_date, p.region AS plant_region, count(*) AS positions, sum(on_hand_quantity) AS on_hand, sum(available_quantity) AS available,
       CAST(count_if(available_quantity < safety_stock_quantity) AS BIGINT) AS below_safety_stock
FROM dense d JOIN plant_t p ON d.plant_id = p.plant_id GROUP BY d.snapshot_date, p.region""", "inventory_position", "date_t", "plant_t")

register("sa_on_hand_latest_dense",
         lambda t: DENSE_MODEL.query(t, ["plant_name"], ["total_on_hand", "parts_below_safety_stock"]),
         f"""
WITH {_DENSE.strip()}
SELECT p.plant_name, sum(on_hand_quantity) AS total_on_hand, CAST(count_if(available_quantity < safety_stock_quantity) AS BIGINT) AS parts_below_safety_stock
FROM dense d JOIN plant_t p ON d.plant_id = p.plant_id WHERE d.snapshot_date = (SELECT max(snapshot_date) FROM dense) GROUP BY p.plant_name""",
         "inventory_position", "date_t", "plant_t")

register("sem_qualified_dim",
         lambda t: MODEL.query(t, ["plant.plant_name", "product.product_family"], ["production_attainment"]),
         """
SELECT pl.plant_name, pr.product_family,
       round(sum(x.produced_quantity) / NULLIF(sum(x.planned_quantity), 0), 9) AS production_attainment
FROM production_performance x JOIN plant_t pl ON x.plant_id = pl.plant_id JOIN product_t pr ON x.product_id = pr.product_id
GROUP BY pl.plant_name, pr.product_family""", "production_performance", "plant_t", "product_t")

register("sem_dims_only",
         lambda t: MODEL.query(t, ["customer_fulfillment.customer_segment", "customer_region"]),
         "SELECT DISTINCT customer_segment, customer_region FROM customer_fulfillment", "customer_fulfillment")

register("sem_fact_by_name",
         lambda t: MODEL.query(t, ["tier"], ["rejection_rate"],
                               aggregates={"received": ("sum", "qty received"), "defects": ("sum", "defects")}),
         """
SELECT supplier_tier, round(sum(rejected_quantity) / NULLIF(sum(received_quantity), 0), 9) AS rejection_rate,
       sum(received_quantity) AS received, sum(defective_quantity) AS defects
FROM supplier_performance GROUP BY supplier_tier""", "supplier_performance")

register("sa_on_hand_latest",
         lambda t: MODEL.query(t, [], ["total_on_hand", "total_available", "parts_below_safety_stock"]),
         """
SELECT sum(on_hand_quantity) AS total_on_hand, sum(available_quantity) AS total_available,
       CAST(count_if(below_safety_stock_flag) AS BIGINT) AS parts_below_safety_stock
FROM inventory_position WHERE snapshot_date = (SELECT max(snapshot_date) FROM inventory_position)""",
         "inventory_position")

register("sa_on_hand_by_month",
         lambda t: MODEL.query(t, ["year", "month"], ["total_on_hand", "total_available"]),
         """
SELECT year, month, total_on_hand, total_available FROM (
  SELECT d.year, d.month, i.snapshot_date, sum(i.on_hand_quantity) AS total_on_hand,
         sum(i.available_quantity) AS total_available,
         row_number() OVER (PARTITION BY d.year, d.month ORDER BY i.snapshot_date DESC) AS rn
  FROM inventory_position i LEFT JOIN date_t d ON i.snapshot_date = d.calendar_date
  GROUP BY d.year, d.month, i.snapshot_date) WHERE rn = 1""", "inventory_position", "date_t")

register("sa_on_hand_by_date",
         lambda t: MODEL.query(t, ["snapshot_date", "plant_region"], ["total_on_hand"]),
         """
SELECT snapshot_date, plant_region, sum(on_hand_quantity) AS total_on_hand
FROM inventory_position GROUP BY snapshot_date, plant_region""", "inventory_position")

register("sa_on_hand_by_part_plant",
         lambda t: MODEL.query(t, ["part_id", "plant_id"], ["total_available"]),
         """
SELECT part_id, plant_id, total_available FROM (
  SELECT part_id, plant_id, snapshot_date, sum(available_quantity) AS total_available,
         row_number() OVER (PARTITION BY part_id, plant_id ORDER BY snapshot_date DESC) AS rn
  FROM inventory_position GROUP BY part_id, plant_id, snapshot_date) WHERE rn = 1""", "inventory_position")
