"""Independent ANSI-SQL statements (DuckDB dialect) of every registered query.

Used only by the correctness gate: the driver tables are pre-registered as views, and each
statement rebuilds the entity tables and surfaces it needs as CTEs. Written separately from the
DataFrame code on purpose — it is a second derivation, not a translation of the plan.
"""

from __future__ import annotations

# name -> (dependencies, body)
CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, deps: tuple[str, ...] = ()) -> None:
    CTE[name] = (deps, body)


# --- entity tables -------------------------------------------------------------------------
cte("nr", """SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")

cte("supplier_t", """
SELECT s.s_suppkey AS supplier_id, 'S' || CAST(s.s_suppkey AS VARCHAR) AS supplier_code,
       s.s_name AS supplier_name, nr.r_name AS supplier_region,
       CASE WHEN s.s_acctbal >= 6000 THEN 'Strategic' WHEN s.s_acctbal >= 2500 THEN 'Preferred'
            ELSE 'Standard' END AS supplier_tier,
       'Active' AS supplier_status
FROM supplier s JOIN nr ON s.s_nationkey = nr.n_nationkey""", ("nr",))

cte("part_t", """
SELECT p_partkey AS part_id, 'P' || CAST(p_partkey AS VARCHAR) AS part_code, p_name AS part_name,
       p_type AS part_category, 'EA' AS unit_of_measure,
       CASE WHEN p_size >= 40 THEN 'Critical' WHEN p_size >= 25 THEN 'High'
            WHEN p_size >= 10 THEN 'Medium' ELSE 'Low' END AS criticality,
       p_retailprice AS standard_cost
FROM part""")

cte("product_t", """
SELECT p_brand || '|' || p_type AS product_id, p_brand || '|' || p_type AS product_code,
       p_brand || ' ' || p_type AS product_name, p_brand AS product_family,
       p_type AS product_category, max(p_retailprice) AS unit_price
FROM part GROUP BY p_brand, p_type""")

cte("plant_t", """
SELECT n_nationkey AS plant_id, 'PL' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS plant_code,
       n_name AS plant_name, n_name AS city, r_name AS region, 'Assembly' AS plant_type,
       CAST(NULL AS DOUBLE) AS capacity_units_per_day
FROM nr""", ("nr",))

cte("customer_t", """
SELECT c.c_custkey AS customer_id, 'C' || CAST(c.c_custkey AS VARCHAR) AS customer_code,
       c.c_name AS customer_name, c.c_mktsegment AS customer_segment, nr.r_name AS customer_region,
       CASE WHEN c.c_acctbal >= 6000 THEN 'Strategic' WHEN c.c_acctbal >= 2500 THEN 'High'
            ELSE 'Standard' END AS customer_priority
FROM customer c JOIN nr ON c.c_nationkey = nr.n_nationkey""", ("nr",))

cte("carrier_t", """
SELECT * FROM (VALUES
  ('CA01', 'CA01', 'Northwind Freight', 'Express', 'National'),
  ('CA02', 'CA02', 'Blue Arrow Logistics', 'Standard', 'National'),
  ('CA03', 'CA03', 'Coastal Carriers', 'Economy', 'Regional'),
  ('CA04', 'CA04', 'Summit Express', 'Express', 'Regional'))
  AS v(carrier_id, carrier_code, carrier_name, service_level, carrier_region)""")

cte("date_t", """
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS calendar_date,
       CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
       CAST(month(d) AS INTEGER) AS month, strftime(d, '%b') AS month_name,
       CAST(week(d) AS INTEGER) AS week_of_year, CAST(isodow(d) AS INTEGER) AS day_of_week,
       strftime(d, '%a') AS day_name, isodow(d) >= 6 AS is_weekend
FROM (SELECT CAST(unnest(generate_series(
        CAST(least((SELECT min(o_orderdate) FROM orders), (SELECT min(l_shipdate) FROM lineitem)) AS DATE),
        last_day(CAST((SELECT max(l_shipdate) FROM lineitem) AS DATE)), INTERVAL 1 DAY)) AS DATE) AS d)""")

cte("supplier_part_t", """
SELECT CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS supplier_part_id,
       l_suppkey AS supplier_id, l_partkey AS part_id,
       (l_suppkey + l_partkey) % 2 = 0 AS preferred_supplier_flag, 50.0::DOUBLE AS allocation_percent
FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""")

cte("product_part_t", """
SELECT product_id || '-' || CAST(part_id AS VARCHAR) AS product_part_id, product_id, part_id,
       CAST(p_size % 4 + 1 AS DOUBLE) AS quantity_per_product, p_size >= 40 AS critical_part_flag
FROM (SELECT p_brand || '|' || p_type AS product_id, p_partkey AS part_id, p_size FROM part
      UNION
      SELECT 'Brand#' || CAST(1 + p_partkey % 25 AS VARCHAR) || '|' || p_type, p_partkey, p_size FROM part)""")

cte("watched", """SELECT min(part_id) AS part_id FROM part_t WHERE criticality = 'Critical'""", ("part_t",))

# lineitem joined to the parents each fact needs
_LI_COLS = """l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity AS q,
       l.l_extendedprice, l.l_returnflag, l.l_linestatus, CAST(l.l_shipdate AS DATE) AS ship_date,
       CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_partkey AS VARCHAR) || '-' || CAST(l.l_suppkey AS VARCHAR) AS line_id"""

cte("li_os", f"""
SELECT {_LI_COLS}, CAST(o.o_orderdate AS DATE) AS order_date, o.o_custkey, s.s_nationkey AS plant_id
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey""")

cte("li_ps", f"""
SELECT {_LI_COLS}, p.p_brand || '|' || p.p_type AS product_id, p.p_size, s.s_nationkey AS plant_id
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey""")

cte("li_s", f"""
SELECT {_LI_COLS}, s.s_nationkey AS plant_id
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey""")

cte("li_all", f"""
SELECT {_LI_COLS}, CAST(o.o_orderdate AS DATE) AS order_date, o.o_custkey,
       p.p_brand || '|' || p.p_type AS product_id, s.s_nationkey AS plant_id,
       CASE WHEN l.l_returnflag = 'R' THEN floor(l.l_quantity * 7 / 10) ELSE l.l_quantity END AS fulfilled_quantity
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey""")

cte("purchase_order_line_t", """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS po_line_id,
       l_orderkey AS po_id, l_suppkey AS supplier_id, l_partkey AS part_id, plant_id, order_date,
       order_date + 5 AS promised_receipt_date, sum(q) AS ordered_quantity,
       max(l_extendedprice / NULLIF(q, 0)) AS unit_cost,
       CASE WHEN max(l_linestatus) = 'O' THEN 'Open' ELSE 'Closed' END AS po_line_status
FROM li_os GROUP BY l_orderkey, l_partkey, l_suppkey, plant_id, order_date""", ("li_os",))

cte("supply_receipt_t", """
WITH f AS (SELECT * FROM li_os WHERE l_linestatus = 'F'),
r AS (
  SELECT line_id, l_linenumber, l_suppkey, l_partkey, plant_id, l_returnflag, 1 AS n,
         order_date + 5 + (l_linenumber - 3) AS receipt_date,
         CASE WHEN l_linenumber < 5 THEN q ELSE floor(q / 2) END AS received_quantity
  FROM f
  UNION ALL
  SELECT line_id, l_linenumber, l_suppkey, l_partkey, plant_id, l_returnflag, 2,
         order_date + 5 + (l_linenumber + 4), q - floor(q / 2)
  FROM f WHERE l_linenumber >= 5)
SELECT line_id || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(n AS VARCHAR) AS receipt_id,
       line_id AS po_line_id, l_suppkey AS supplier_id, l_partkey AS part_id, plant_id, receipt_date,
       received_quantity,
       received_quantity - CASE WHEN l_returnflag = 'R' THEN floor(received_quantity / 10) ELSE 0.0 END AS accepted_quantity,
       CASE WHEN l_returnflag = 'R' THEN floor(received_quantity / 10) ELSE 0.0 END AS rejected_quantity,
       'Received' AS receipt_status
FROM r""", ("li_os",))

cte("quality_t", """
SELECT line_id || '-' || CAST(l_linenumber AS VARCHAR) AS inspection_id, l_suppkey AS supplier_id,
       l_partkey AS part_id, plant_id, ship_date AS inspection_date, q AS inspected_quantity,
       CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber % 3 AS DOUBLE) ELSE 0.0 END AS defective_quantity,
       CASE WHEN l_returnflag = 'R' AND l_linenumber % 3 > 0 THEN 'Dimensional' END AS defect_type,
       CASE WHEN l_returnflag = 'R' AND l_linenumber % 3 > 0 THEN 'Failed' ELSE 'Passed' END AS inspection_status
FROM li_s WHERE l_returnflag IN ('A', 'R')""", ("li_s",))

cte("inventory_t", """
SELECT CAST(part_id AS VARCHAR) || '-' || CAST(plant_id AS VARCHAR) || '-' || strftime(snapshot_date, '%Y%m%d') AS inventory_snapshot_id,
       part_id, plant_id, snapshot_date, on_hand_quantity, reserved_quantity,
       on_hand_quantity - reserved_quantity AS available_quantity, safety_stock_quantity
FROM (SELECT l_partkey AS part_id, plant_id, last_day(ship_date) AS snapshot_date,
             sum(q) AS on_hand_quantity,
             sum(CASE WHEN l_linestatus = 'O' THEN floor(q / 2) ELSE 0.0 END) AS reserved_quantity,
             CAST(max(p_size) AS DOUBLE) AS safety_stock_quantity
      FROM li_ps GROUP BY l_partkey, plant_id, last_day(ship_date))""", ("li_ps",))

cte("production_t", """
SELECT CAST(plant_id AS VARCHAR) || '-' || product_id || '-' || strftime(production_date, '%Y%m%d') AS production_id,
       plant_id, product_id, production_date, planned_quantity, produced_quantity, downtime_hours,
       CASE WHEN produced_quantity < planned_quantity THEN 'Constrained' ELSE 'Normal' END AS production_status
FROM (SELECT plant_id, product_id, ship_date AS production_date, sum(q) AS planned_quantity,
             sum(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN floor(q * 4 / 10) ELSE q END) AS produced_quantity,
             CAST(count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'A') AS DOUBLE) AS downtime_hours
      FROM li_ps GROUP BY plant_id, product_id, ship_date)""", ("li_ps",))

cte("order_line_t", """
SELECT line_id AS order_line_id, l_orderkey AS order_id, o_custkey AS customer_id, product_id, plant_id,
       order_date, order_date + 10 AS promised_date, q AS ordered_quantity, fulfilled_quantity,
       CASE WHEN fulfilled_quantity <= 0 THEN 'Open' WHEN fulfilled_quantity < q THEN 'Partially Fulfilled'
            ELSE 'Fulfilled' END AS order_status
FROM li_all""", ("li_all",))

cte("shipment_t", """
SELECT line_id AS shipment_id, line_id AS order_line_id, o_custkey AS customer_id, product_id, plant_id,
       'CA0' || CAST(CAST(('0x' || substr(md5(line_id), 1, 8)) AS BIGINT) % 4 + 1 AS VARCHAR) AS carrier_id,
       ship_date, ship_date + 6 AS promised_date,
       CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN NULL ELSE ship_date + l_linenumber END AS actual_delivery_date,
       fulfilled_quantity AS shipped_quantity,
       CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'In Transit' ELSE 'Delivered' END AS shipment_status,
       CASE WHEN NOT (l_linestatus = 'O' AND l_returnflag = 'N') AND l_linenumber > 6 THEN 'Carrier delay' END AS delay_reason
FROM li_all""", ("li_all",))

# --- curated surfaces ----------------------------------------------------------------------
cte("customer_fulfillment", """
SELECT o.order_line_id, o.order_id, o.order_date, o.promised_date, o.customer_id, c.customer_name,
       c.customer_segment, c.customer_region, c.customer_priority, o.product_id, p.product_name,
       p.product_family, p.product_category, o.plant_id, pl.plant_name, pl.region AS plant_region,
       o.ordered_quantity, o.fulfilled_quantity, o.ordered_quantity - o.fulfilled_quantity AS unfulfilled_quantity,
       round(100.0::DOUBLE * o.fulfilled_quantity / NULLIF(o.ordered_quantity, 0), 2) AS fulfillment_pct,
       o.order_status, o.fulfilled_quantity < o.ordered_quantity AS fulfillment_gap_flag
FROM order_line_t o JOIN customer_t c ON o.customer_id = c.customer_id
JOIN product_t p ON o.product_id = p.product_id JOIN plant_t pl ON o.plant_id = pl.plant_id""",
    ("order_line_t", "customer_t", "product_t", "plant_t"))

cte("shipment_performance", """
SELECT s.shipment_id, s.order_line_id, s.customer_id, c.customer_name, c.customer_segment, c.customer_region,
       c.customer_priority, s.product_id, p.product_name, p.product_family, s.plant_id, pl.plant_name,
       pl.region AS plant_region, s.carrier_id, ca.carrier_name, ca.service_level, s.ship_date,
       s.promised_date, s.actual_delivery_date, s.shipped_quantity, s.shipment_status, s.delay_reason,
       CASE WHEN s.actual_delivery_date IS NOT NULL
            THEN CAST(s.actual_delivery_date - s.promised_date AS INTEGER) END AS delivery_delay_days,
       COALESCE(s.actual_delivery_date IS NOT NULL AND s.actual_delivery_date <= s.promised_date, FALSE) AS on_time_flag,
       s.actual_delivery_date IS NOT NULL AS delivery_eligible_flag
FROM shipment_t s JOIN customer_t c ON s.customer_id = c.customer_id
JOIN product_t p ON s.product_id = p.product_id JOIN plant_t pl ON s.plant_id = pl.plant_id
JOIN carrier_t ca ON s.carrier_id = ca.carrier_id""",
    ("shipment_t", "customer_t", "product_t", "plant_t", "carrier_t"))

cte("critical_bom", """
SELECT pp.product_id, CAST(count(*) AS BIGINT) AS critical_part_count,
       string_agg(CAST(pp.part_id AS VARCHAR) || ' (' || CAST(pp.quantity_per_product AS VARCHAR) || ')', ', '
                  ORDER BY pp.part_id) AS critical_parts,
       bool_or(pp.part_id = w.part_id) AS watched_part_exposure_flag,
       max(CASE WHEN pp.part_id = w.part_id THEN pp.quantity_per_product END) AS watched_part_qty_per_product
FROM product_part_t pp, watched w WHERE pp.critical_part_flag GROUP BY pp.product_id""",
    ("product_part_t", "watched"))

cte("production_performance", """
SELECT pr.production_id, pr.production_date, pr.plant_id, pl.plant_name, pl.region AS plant_region,
       pr.product_id, p.product_name, p.product_family, p.product_category, pr.planned_quantity,
       pr.produced_quantity, pr.planned_quantity - pr.produced_quantity AS production_gap_quantity,
       round(100.0::DOUBLE * pr.produced_quantity / NULLIF(pr.planned_quantity, 0), 2) AS production_attainment_pct,
       pr.downtime_hours, pr.production_status, pr.production_status = 'Constrained' AS constraint_flag,
       COALESCE(b.critical_part_count, 0) AS critical_part_count, b.critical_parts,
       COALESCE(b.watched_part_exposure_flag, FALSE) AS watched_part_exposure_flag,
       b.watched_part_qty_per_product
FROM production_t pr JOIN plant_t pl ON pr.plant_id = pl.plant_id
JOIN product_t p ON pr.product_id = p.product_id LEFT JOIN critical_bom b ON pr.product_id = b.product_id""",
    ("production_t", "plant_t", "product_t", "critical_bom"))

cte("inventory_position", """
SELECT i.inventory_snapshot_id, i.snapshot_date, i.part_id, p.part_name, p.part_category, p.criticality,
       i.plant_id, pl.plant_name, pl.region AS plant_region, i.on_hand_quantity, i.reserved_quantity,
       i.available_quantity, i.safety_stock_quantity, i.available_quantity - i.safety_stock_quantity AS safety_stock_gap,
       round(100.0::DOUBLE * i.available_quantity / NULLIF(i.safety_stock_quantity, 0), 2) AS available_to_safety_stock_pct,
       i.available_quantity < i.safety_stock_quantity AS below_safety_stock_flag,
       CASE WHEN i.available_quantity <= 0 THEN 'STOCKOUT'
            WHEN i.available_quantity < i.safety_stock_quantity THEN 'BELOW_SAFETY_STOCK'
            WHEN i.available_quantity < i.safety_stock_quantity * 1.25 THEN 'NEAR_SAFETY_STOCK'
            ELSE 'HEALTHY' END AS inventory_risk_band
FROM inventory_t i JOIN part_t p ON i.part_id = p.part_id JOIN plant_t pl ON i.plant_id = pl.plant_id""",
    ("inventory_t", "part_t", "plant_t"))

# One grouped pass over a tagged union of purchase orders, receipts and inspections. The mean of the
# per-line mean delays is the sum of delay / receipts of the line, over the number of lines.
cte("supplier_performance", """
WITH moves AS (
  SELECT supplier_id, part_id, 'order' AS kind, po_line_id AS line, ordered_quantity AS v1, 0.0 AS v2, 0.0 AS v3, 0.0 AS share, false AS in_time
  FROM purchase_order_line_t
  UNION ALL
  SELECT r.supplier_id, r.part_id, 'receipt', r.po_line_id, r.received_quantity, r.accepted_quantity, r.rejected_quantity,
         (r.receipt_date - l.promised_receipt_date)::DOUBLE / count(*) OVER (PARTITION BY r.po_line_id, r.supplier_id, r.part_id),
         r.receipt_date <= l.promised_receipt_date
  FROM supply_receipt_t r JOIN purchase_order_line_t l USING (po_line_id)
  UNION ALL
  SELECT supplier_id, part_id, 'inspection', NULL, inspected_quantity, defective_quantity, 0.0, 0.0, false FROM quality_t),
card AS (
  SELECT supplier_id, part_id,
         count(*) FILTER (kind = 'order') AS orders, sum(v1) FILTER (kind = 'order') AS ordered,
         count(*) FILTER (kind = 'receipt') AS receipts, sum(v1) FILTER (kind = 'receipt') AS received,
         sum(v2) FILTER (kind = 'receipt') AS accepted, sum(v3) FILTER (kind = 'receipt') AS rejected,
         round(sum(share) FILTER (kind = 'receipt') / count(DISTINCT line) FILTER (kind = 'receipt'), 2) AS delay,
         count(*) FILTER (kind = 'receipt' AND in_time) AS in_time,
         sum(v1) FILTER (kind = 'inspection') AS inspected, sum(v2) FILTER (kind = 'inspection') AS defective
  FROM moves GROUP BY supplier_id, part_id),
rated AS (SELECT *, greatest(ifnull(delay, 0), ifnull(100.0::DOUBLE * defective / NULLIF(inspected, 0), 0)) AS worst FROM card)
SELECT supplier_id, supplier_name, supplier_region, supplier_tier, supplier_status, part_id, part_name, part_category, criticality,
       preferred_supplier_flag, allocation_percent, ifnull(orders, 0)::BIGINT AS po_line_count, ifnull(ordered, 0.0) AS ordered_quantity,
       ifnull(receipts, 0)::BIGINT AS receipt_count, ifnull(received, 0.0) AS received_quantity, ifnull(accepted, 0.0) AS accepted_quantity,
       ifnull(rejected, 0.0) AS rejected_quantity, delay AS avg_receipt_delay_days,
       round(100.0::DOUBLE * in_time / NULLIF(receipts, 0), 2) AS on_time_receipt_pct,
       ifnull(inspected, 0.0) AS inspected_quantity, ifnull(defective, 0.0) AS defective_quantity,
       round(100.0::DOUBLE * defective / NULLIF(inspected, 0), 2) AS defect_rate_pct,
       ['LOW', 'MEDIUM', 'HIGH'][1 + (ifnull(worst, 0) >= 1)::INT + (ifnull(worst, 0) >= 3)::INT] AS supply_risk_band
FROM supplier_part_t LEFT JOIN rated USING (supplier_id, part_id) JOIN supplier_t USING (supplier_id) JOIN part_t USING (part_id)""",
    ("purchase_order_line_t", "supply_receipt_t", "quality_t", "supplier_part_t", "supplier_t", "part_t"))

# One filtered aggregate over a tagged union of the three surfaces: parts / wholes of each signal and a row flag.
cte("product_risk_signals", """
WITH evidence AS (
  SELECT product_id, product_name, 'demand' AS kind, fulfilled_quantity AS part, ordered_quantity AS whole, fulfillment_gap_flag AS hit FROM customer_fulfillment
  UNION ALL
  SELECT product_id, product_name, 'delivery', on_time_flag::INT::DOUBLE, delivery_eligible_flag::INT::DOUBLE, delivery_eligible_flag FROM shipment_performance
  UNION ALL
  SELECT product_id, product_name, 'output', produced_quantity, planned_quantity, constraint_flag FROM production_performance),
tally AS (
  SELECT product_id, max(product_name) AS product_name,
         sum(part) FILTER (kind = 'demand') / NULLIF(sum(whole) FILTER (kind = 'demand'), 0) AS demand_rate,
         sum(part) FILTER (kind = 'delivery') / NULLIF(sum(whole) FILTER (kind = 'delivery'), 0) AS delivery_rate,
         sum(part) FILTER (kind = 'output') / NULLIF(sum(whole) FILTER (kind = 'output'), 0) AS output_rate,
         count(*) FILTER (kind = 'demand' AND hit) AS gaps, count(*) FILTER (kind = 'demand') AS demand_rows,
         count(*) FILTER (kind = 'delivery' AND hit) AS delivered,
         count(*) FILTER (kind = 'output' AND hit) AS constrained, count(*) FILTER (kind = 'output') AS output_rows
  FROM evidence GROUP BY product_id),
flagged AS (SELECT *, demand_rate < 0.90 AS low_demand, delivery_rate < 0.85 AS low_delivery, output_rate < 0.90 AS low_output FROM tally)
SELECT product_id, product_name, round(demand_rate, 9) AS fulfillment_rate, gaps AS order_lines_with_gaps, demand_rows AS total_order_lines,
       low_demand AS fulfillment_risk_flag, round(delivery_rate, 9) AS on_time_delivery_rate, delivered AS eligible_shipments,
       low_delivery AS delivery_risk_flag, round(output_rate, 9) AS production_attainment, constrained AS constrained_days,
       output_rows AS total_production_days, low_output AS production_risk_flag,
       len(list_filter([low_demand, low_delivery, low_output], lambda x: x))::INTEGER AS risk_signal_count
FROM flagged""",
    ("customer_fulfillment", "shipment_performance", "production_performance"))


def _dec_scale(digits: int) -> int:
    # same rule as functions.exprs.dec_scale
    return 10 if digits <= 2 else 12


def decimal_rounding(sql: str) -> str:
    """Every ``round(x, d)`` in these statements rounds the *decimal* value of x half-up (the
    modelled product's NUMBER semantics): x is fixed to a few extra decimals first, so a tie
    such as 2.385 (stored as 2.38499999...) rounds to 2.39 as the DataFrame side does."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 1, j + 6, None
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner_end = k - 1
        expr = sql[j + 6:comma if comma is not None else inner_end]
        digits = int(sql[comma + 1:inner_end].strip()) if comma is not None else 0
        out.append(sql[i:j])
        out.append(f"CAST(round(CAST(({decimal_rounding(expr)}) AS DECIMAL(38,{_dec_scale(digits)})), "
                   f"{digits}) AS DOUBLE)")
        i = k


def with_ctes(final: str, *needs: str) -> str:
    """Prefix ``final`` with the CTEs it needs (transitively, dependencies first)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTE[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return decimal_rounding(final.strip())
    parts = [f"{n} AS (\n{CTE[n][1].strip()}\n)" for n in order]
    body = final.strip()
    if body[:5].upper() == "WITH ":
        # the statement has its own CTEs: continue the same WITH list
        return decimal_rounding("WITH " + ",\n".join(parts) + ",\n" + body[5:])
    return decimal_rounding("WITH " + ",\n".join(parts) + "\n" + body)
