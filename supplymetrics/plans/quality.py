"""Data-quality job (DQ1-DQ21): counts, referential integrity, grain, value rules,
reconciliation, coverage and profiles — each a report DataFrame over whole tables.

Reports are unions of one-row aggregates (SET1); every check is one scan of its table with
partial aggregation, so a report costs a handful of small jobs regardless of data size.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplymetrics.functions import exprs as X
from supplymetrics.operators.relational import duplicate_groups, duplicates, orphans, reconcile, report
from supplymetrics.plans import surfaces as SUR
from supplymetrics.sources.adapters import Tables
from supplymetrics.sources.schemas import GRAIN


def _count(df: DataFrame, name: str, alias: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(alias)).select(F.lit(name).alias("check_name"), alias)


def expected_counts(t: Tables, expected: dict[str, int] | None = None) -> DataFrame:
    """DQ1 — dimension row counts against given counts; those not given are expected from the source tables."""
    exp = {
        "CARRIER": (t.carrier, F.lit(4).cast("bigint")),
        "CUSTOMER": (t.customer, t.read("customer", "c_custkey").select(F.count(F.lit(1))).scalar()),
        "DATE_DIM": (t.date_dim, (F.datediff(t.date_bounds[1], t.date_bounds[0]) + 1).cast("bigint")),
        "PART": (t.part, t.read("part", "p_partkey").select(F.count(F.lit(1))).scalar()),
        "PLANT": (t.plant, t.read("nation", "n_nationkey").select(F.count(F.lit(1))).scalar()),
        "PRODUCT": (t.product, t.read("part", "p_brand", "p_type")
                    .select(F.count_distinct("p_brand", "p_type")).scalar()),
        "SUPPLIER": (t.supplier, t.read("supplier", "s_suppkey").select(F.count(F.lit(1))).scalar()),
    }
    given = {k.upper(): F.lit(v).cast("bigint") for k, v in (expected or {}).items()}
    if unknown := set(given) - set(exp):
        raise KeyError(f"no dimension named {sorted(unknown)}")
    rows = []
    for name, (df, default) in exp.items():
        expected_count = given.get(name, default)
        rows.append(df.agg(F.count(F.lit(1)).alias("actual_count")).select(
            F.lit(name).alias("check_name"),
            X.iff(F.col("actual_count") == expected_count, "PASS", "FAIL").alias("status"),
            "actual_count", expected_count.alias("expected_count")))
    return report(rows).orderBy("check_name")


def row_counts(t: Tables) -> DataFrame:
    """DQ2 — row count of every entity table and curated surface."""
    parts = [_count(t.columns(n, GRAIN[n][0]), n.upper()) for n in t.ENTITIES]
    surfaces = {"V_SUPPLIER_PERFORMANCE": SUR.supplier_performance(t),
                "V_INVENTORY_POSITION": SUR.inventory_position(t),
                "V_PRODUCTION_PERFORMANCE": SUR.production_performance(t),
                "V_CUSTOMER_FULFILLMENT": SUR.customer_fulfillment(t),
                "V_SHIPMENT_PERFORMANCE": SUR.shipment_performance(t)}
    parts += [_count(df, n) for n, df in surfaces.items()]
    return report(parts).withColumnRenamed("check_name", "table_name")


# (check, child table, child key, parent table, parent key)
EDGES = [
    ("PO -> SUPPLIER", "purchase_order_line", "supplier_id", "supplier", "supplier_id"),
    ("PO -> PART", "purchase_order_line", "part_id", "part", "part_id"),
    ("PO -> PLANT", "purchase_order_line", "plant_id", "plant", "plant_id"),
    ("RECEIPT -> PO", "supply_receipt", "po_line_id", "purchase_order_line", "po_line_id"),
    ("ORDER -> CUSTOMER", "order_line", "customer_id", "customer", "customer_id"),
    ("ORDER -> PRODUCT", "order_line", "product_id", "product", "product_id"),
    ("SHIPMENT -> ORDER", "shipment", "order_line_id", "order_line", "order_line_id"),
    ("SHIPMENT -> CARRIER", "shipment", "carrier_id", "carrier", "carrier_id"),
]


def orphan_count(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose foreign key has no parent (a missing key counts). Rows are counted per key before
    the anti join, so a key held by a third of the rows is one row per task in the shuffle."""
    per_key = child.groupBy(child_key).agg(F.count(F.lit(1)).alias("_n"))
    lost = orphans(per_key, parent.select(parent_key), child_key, parent_key)
    return lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("orphan_count"))


def referential_integrity(t: Tables) -> DataFrame:
    """DQ3 — orphan foreign keys on the eight declared edges (left-anti joins)."""
    parts = [orphan_count(t.columns(c, ck), t.columns(p, pk), ck, pk).select(F.lit(name).alias("check_name"), "orphan_count")
             for name, c, ck, p, pk in EDGES]
    return report(parts).orderBy("check_name")


def _copies(df: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """The rows with ``n_<key>``: how often the parent has their key. Parents are counted per key first, so no row is multiplied."""
    p = parent.groupBy(F.col(key).alias(f"_{key}")).agg(F.count(F.lit(1)).alias(f"n_{key}"))
    return df.join(p, F.col(key) == F.col(f"_{key}"), "left").withColumn(f"n_{key}", F.coalesce(f"n_{key}", F.lit(0))).drop(f"_{key}")


def grain_duplicates(t: Tables) -> DataFrame:
    """DQ4 — duplicate grain keys in raw facts and curated surfaces (groups occurring >1).

    A fact and its surface are one derivation: the fact's rows with the number of copies that each parent has, summed per key once as
    rows and once as what the surface's inner joins make of them. Order lines, shipments and purchase-order lines of the
    driver's lines share theirs, so four scans of the lines serve the nine checks."""
    one = F.lit(1)

    def with_product(df: DataFrame) -> DataFrame:
        if t.DERIVED:  # the id spells the product
            return df.withColumn("n_product_id", F.col("product_id").isNotNull().cast("long"))
        return _copies(df, t.product, "product_id")

    def with_parents(df: DataFrame) -> DataFrame:
        df = df.withColumn("n_customer_id", F.coalesce("n_customer_id", F.lit(0))) if t.DERIVED else _copies(df, t.customer, "customer_id")
        return with_product(_copies(df, t.plant, "plant_id"))

    def joined(*keys: str) -> Column:
        return functools.reduce(lambda a, b: a * b, [F.col(f"n_{k}") for k in keys])

    inventory = _copies(_copies(t.inventory.select(*GRAIN["inventory"]), t.part, "part_id"), t.plant, "plant_id")
    production = with_product(_copies(t.production.select(*GRAIN["production"]), t.plant, "plant_id"))
    reports = [
        duplicate_groups(inventory, GRAIN["inventory"], {"INVENTORY_DUPLICATE_PART_PLANT_DATE": one,
                                                         "V_INVENTORY_POSITION_GRAIN": joined("part_id", "plant_id")}),
        duplicate_groups(production, GRAIN["production"], {"V_PRODUCTION_PERFORMANCE_GRAIN": joined("plant_id", "product_id")}),
        _count(duplicates(SUR.supplier_performance(t).select(*GRAIN["supplier_performance"]), GRAIN["supplier_performance"]),
               "V_SUPPLIER_PERFORMANCE_GRAIN", "duplicate_groups"),
    ]
    in_surface = joined("plant_id", "customer_id", "product_id")
    if t.DERIVED:
        customers = t.customer.groupBy("customer_id").agg(F.count(one).alias("n_customer_id"))  # met by the orders, before the lines
        lines = with_parents(t.demand(customers=customers, customer_join="left"))
        # a purchase-order line is its key, plant and order date: two of one key differ in what is hashed here
        other = F.xxhash64("plant_id", "order_date")
        per_line = lines.groupBy("order_line_id").agg(F.count(one).alias("n"), F.sum(in_surface).alias("kept"), (F.min(other) != F.max(other)).alias("orders_differ"))
        found = per_line.agg(F.count_if(F.col("n") > 1).alias("n"), F.count_if(F.col("kept") > 1).alias("kept"), F.count_if("orders_differ").alias("po"))
        names = {"ORDER_LINE_DUPLICATE_ID": "n", "SHIPMENT_DUPLICATE_ID": "n", "V_CUSTOMER_FULFILLMENT_GRAIN": "kept",
                 "V_SHIPMENT_PERFORMANCE_GRAIN": "kept", "PO_LINE_DUPLICATE_ID": "po"}
        reports.append(found.select(*[F.col(c).alias(n) for n, c in names.items()]).unpivot([], list(names), "check_name", "duplicate_groups"))
    else:
        shipments = _copies(t.shipment.select("shipment_id", "customer_id", "product_id", "plant_id", "carrier_id"), t.carrier, "carrier_id")
        reports += [
            duplicate_groups(with_parents(t.order_line.select("order_line_id", "customer_id", "product_id", "plant_id")), ["order_line_id"],
                             {"ORDER_LINE_DUPLICATE_ID": one, "V_CUSTOMER_FULFILLMENT_GRAIN": in_surface}),
            duplicate_groups(with_parents(shipments), ["shipment_id"],
                             {"SHIPMENT_DUPLICATE_ID": one, "V_SHIPMENT_PERFORMANCE_GRAIN": in_surface * F.col("n_carrier_id")}),
            _count(duplicates(t.purchase_order_line.select(*GRAIN["purchase_order_line"]), GRAIN["purchase_order_line"]), "PO_LINE_DUPLICATE_ID", "duplicate_groups"),
        ]
    return report(reports)


def rule(df: DataFrame, name: str, failing: Column) -> DataFrame:
    """One value rule: rows where ``failing`` holds."""
    return df.agg(F.count_if(failing).alias("failure_count")).select(F.lit(name).alias("check_name"),
                                                                       "failure_count")


def value_rules(t: Tables) -> DataFrame:
    """DQ5-DQ9 — quantity balance, non-negative stock, fulfilled <= ordered, shipped <=
    fulfilled (cross-table, JN8), defective <= inspected.

    The cross-table rule compares totals per order line: both tables are stacked and summed by the line's id, so
    lines that repeat an id are checked together and never multiply."""
    r = t.columns("supply_receipt", "received_quantity", "accepted_quantity", "rejected_quantity")
    sh = t.columns("shipment", "order_line_id", "shipped_quantity")
    ol = t.columns("order_line", "order_line_id", "ordered_quantity", "fulfilled_quantity")
    per_line = (sh.unionByName(ol.select("order_line_id", "fulfilled_quantity"), allowMissingColumns=True).groupBy("order_line_id")
                .agg(F.sum("shipped_quantity").alias("shipped_quantity"), F.sum("fulfilled_quantity").alias("fulfilled_quantity")))
    stock = t.columns("inventory", "available_quantity")
    inspected = t.columns("quality", "defective_quantity", "inspected_quantity")
    checks = [
        rule(r, "RECEIPT_QUANTITY_BALANCE",
             F.col("received_quantity") != F.col("accepted_quantity") + F.col("rejected_quantity")),
        rule(stock, "NEGATIVE_INVENTORY_AVAILABLE", F.col("available_quantity") < 0),
        rule(ol, "ORDER_FULFILLED_GT_ORDERED", F.col("fulfilled_quantity") > F.col("ordered_quantity")),
        rule(per_line, "SHIPMENT_QTY_GT_ORDER_LINE_FULFILLED", F.col("shipped_quantity") > F.col("fulfilled_quantity")),
        rule(inspected, "QUALITY_DEFECT_GT_INSPECTED", F.col("defective_quantity") > F.col("inspected_quantity")),
    ]
    return report(checks).orderBy("check_name")


def reconciliation(t: Tables) -> DataFrame:
    """DQ10 — curated values equal raw values on the primary key (null-safe; repeated keys as multisets).

    Each pair is compared by digests of both sides, by buckets of keys first and by key where these differ. The surfaces are built
    for the compared columns alone."""
    pairs = [
        ("V_INVENTORY_POSITION.AVAILABLE_QUANTITY", SUR.inventory_position(t, columns=("inventory_snapshot_id", "available_quantity")),
         "inventory", "inventory_snapshot_id", "available_quantity"),
        ("V_PRODUCTION_PERFORMANCE.PRODUCED_QUANTITY", SUR.production_performance(t, columns=("production_id", "produced_quantity")),
         "production", "production_id", "produced_quantity"),
        ("V_CUSTOMER_FULFILLMENT.FULFILLED_QUANTITY", SUR.customer_fulfillment(t, columns=("order_line_id", "fulfilled_quantity")),
         "order_line", "order_line_id", "fulfilled_quantity"),
        ("V_SHIPMENT_PERFORMANCE.SHIPPED_QUANTITY", SUR.shipment_performance(t, columns=("shipment_id", "shipped_quantity")),
         "shipment", "shipment_id", "shipped_quantity"),
    ]
    return report([reconcile(c, t.columns(r, k, col), k, col).select(F.lit(n).alias("check_name"), "rows_checked",
                                                  F.col("mismatches").alias("mismatch_rows"))
                   for n, c, r, k, col in pairs])


def coverage(t: Tables) -> DataFrame:
    """DQ11 — distinct products with order lines, and of those lines' shipments (JN11).

    Order lines and shipments are stacked and grouped by the line's id and the product, so repeated ids do not multiply."""
    ol = t.columns("order_line", "order_line_id", "product_id").withColumn("s_product_id", F.lit(None).cast("string")).withColumn("ordered", F.lit(True))
    sh = t.columns("shipment", "order_line_id", "product_id").select(
        "order_line_id", F.lit(None).cast("string").alias("product_id"), F.col("product_id").alias("s_product_id"), F.lit(False).alias("ordered"))
    lines = ol.unionByName(sh).groupBy("order_line_id").agg(
        F.collect_set("product_id").alias("products"), F.collect_set("s_product_id").alias("shipped"), F.max("ordered").alias("ordered"))
    found = lines.filter("ordered").select(F.explode(F.concat(
        F.transform("products", lambda p: F.struct(p.alias("product_id"), F.lit(False).alias("s"))),
        F.transform("shipped", lambda p: F.struct(p.alias("product_id"), F.lit(True).alias("s"))))).alias("p")).select("p.*")
    return found.agg(F.count_distinct(F.when(~F.col("s"), F.col("product_id"))).alias("affected_order_products"),
                     F.count_distinct(F.when(F.col("s"), F.col("product_id"))).alias("affected_shipment_products"))


def labelled_counts(t: Tables) -> DataFrame:
    """DQ12 — labelled counts of the situations the model is built to surface, one pass per
    table (several ``count_if`` in a single aggregate)."""
    blocks = [
        (t.columns("purchase_order_line", "po_line_status"), {"OPEN_PO_LINES": F.col("po_line_status") == "Open"}),
        (t.promised_receipts, {"LATE_RECEIPTS": F.col("receipt_date") > F.col("promised_receipt_date")}),
        (t.inventory, {"INVENTORY_BELOW_SAFETY_STOCK": F.col("available_quantity") < F.col("safety_stock_quantity")}),
        (t.production, {"CONSTRAINED_PRODUCTION": F.col("production_status") == "Constrained"}),
    ]
    of_orders = {"PARTIALLY_FULFILLED_ORDER_LINES": F.col("order_status") == "Partially Fulfilled", "OPEN_ORDER_LINES": F.col("order_status") == "Open"}
    of_shipments = {"IN_TRANSIT_SHIPMENTS": F.col("shipment_status") == "In Transit", "LATE_DELIVERIES": F.col("actual_delivery_date") > F.col("promised_date")}
    if t.DERIVED:  # both come from the same line and need no parent
        blocks.append((t.demand(orders=False, part=False, supplier=False), of_orders | of_shipments))
    else:
        blocks += [(t.order_line, of_orders), (t.shipment, of_shipments)]
    parts = []
    for df, preds in blocks:
        wide = df.agg(*[F.count_if(p).alias(n) for n, p in preds.items()])
        parts.append(wide.unpivot([], list(preds), "check_name", "row_count"))
    return report(parts)


def po_receipt_evidence(t: Tables) -> DataFrame:
    """DQ13 — every PO line with its receipts (if any) and the receipt delay (JN10)."""
    po = t.purchase_order_line.select("po_line_id", "supplier_id", "part_id", "plant_id",
                                      "order_date", "promised_receipt_date")
    r = t.columns("supply_receipt", "receipt_id", "po_line_id", "receipt_date")
    return (po.join(r, "po_line_id", "left")
            .withColumn("receipt_delay_days", X.days_between("promised_receipt_date", "receipt_date")))


def snapshot_series(t: Tables) -> DataFrame:
    """DQ13 — available quantity against safety stock at every snapshot, with the breach marked."""
    avail, safety = F.col("available_quantity"), F.col("safety_stock_quantity")
    return t.inventory.select("part_id", "plant_id", "snapshot_date", "available_quantity", "safety_stock_quantity",
                              X.flag(avail < safety).alias("below_safety_stock_flag"))


def order_cohorts(t: Tables) -> DataFrame:
    """DQ13 — every cohort of order lines (ids with the same text before the first dash): lines, quantities, open lines."""
    ol = t.columns("order_line", "order_line_id", "ordered_quantity", "fulfilled_quantity", "order_status")
    return ol.groupBy(F.substring_index("order_line_id", "-", 1).alias("cohort")).agg(
        F.count(F.lit(1)).alias("order_lines"), F.sum("ordered_quantity").alias("ordered_quantity"),
        F.sum("fulfilled_quantity").alias("fulfilled_quantity"),
        F.count_if(F.col("order_status") != "Fulfilled").alias("lines_not_fulfilled"))


def production_severity(t: Tables) -> DataFrame:
    """DQ14 — production gap, downtime and constrained days per plant and product."""
    return t.production.groupBy("plant_id", "product_id").agg(
        F.count(F.lit(1)).alias("production_days"),
        X.dround(F.avg(F.col("planned_quantity") - F.col("produced_quantity")), 2).alias("avg_production_gap"),
        X.dround(F.avg("downtime_hours"), 2).alias("avg_downtime_hours"),
        F.sum(X.iff(F.col("production_status") == "Constrained", 1, 0)).alias("constrained_days"))


def fulfillment_profile(t: Tables) -> DataFrame:
    """DQ15 — fulfilment per plant and product from the raw order lines."""
    ol = t.columns("order_line", "plant_id", "product_id", "ordered_quantity", "fulfilled_quantity")
    return ol.groupBy("plant_id", "product_id").agg(
        F.count(F.lit(1)).alias("order_lines"),
        F.sum("ordered_quantity").alias("ordered_qty"),
        F.sum("fulfilled_quantity").alias("fulfilled_qty"),
        F.sum(F.col("ordered_quantity") - F.col("fulfilled_quantity")).alias("unfulfilled_qty"),
        X.pct(F.sum("fulfilled_quantity"), F.sum("ordered_quantity")).alias("fulfillment_pct"))


def otd_profile(t: Tables) -> DataFrame:
    """DQ16 — on-time delivery per plant and product from raw shipments (no curated flags)."""
    a, p = F.col("actual_delivery_date"), F.col("promised_date")
    on_time = X.iff(a.isNotNull() & (a <= p), 1, 0)
    sh = t.columns("shipment", "plant_id", "product_id", "shipped_quantity", "actual_delivery_date", "promised_date")
    return sh.groupBy("plant_id", "product_id").agg(
        F.count(F.lit(1)).alias("shipment_count"),
        F.sum("shipped_quantity").alias("shipped_qty"),
        F.sum(on_time).alias("on_time_shipments"),
        X.pct(F.sum(on_time), F.sum(X.iff(a.isNotNull(), 1, 0))).alias("on_time_delivery_pct"))


def supplier_delay(t: Tables) -> DataFrame:
    """DQ17 — receipt delay per supplier as a plain row mean (compare AGG14)."""
    return t.promised_receipts.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("receipt_count"),
        X.dround(F.avg(X.days_between("promised_receipt_date", "receipt_date")), 2).alias("avg_receipt_delay_days"))


def inventory_pressure(t: Tables) -> DataFrame:
    """DQ18 — per part and plant: first snapshot, first breach, minimum available, safety."""
    below = F.col("available_quantity") < F.col("safety_stock_quantity")
    return t.inventory.groupBy("part_id", "plant_id").agg(
        F.min("snapshot_date").alias("first_snapshot"),
        X.first_when("snapshot_date", below).alias("first_below_safety_stock"),
        F.min("available_quantity").alias("minimum_available_quantity"),
        F.max("safety_stock_quantity").alias("safety_stock_quantity"))


def where_used(t: Tables, part_id=None, critical_only: bool = True) -> DataFrame:
    """DQ19 / JN13 — products whose BOM uses a part (default: every critical part)."""
    bom = t.product_part
    if part_id is not None:
        bom = bom.filter(F.col("part_id") == (part_id if isinstance(part_id, Column) else F.lit(part_id)))
    elif critical_only:
        bom = bom.filter(F.col("critical_part_flag"))
    p = t.product.select("product_id", "product_name")
    return (bom.join(p, "product_id")
            .select("part_id", "product_id", "product_name", "quantity_per_product", "critical_part_flag")
            .orderBy("part_id", "product_id"))


def first_constrained(t: Tables) -> DataFrame:
    """DQ20 — first constrained production date per plant and product."""
    return (t.production.filter(F.col("production_status") == "Constrained")
            .groupBy("plant_id", "product_id").agg(F.min("production_date").alias("first_constrained_date")))


def exposed_products(t: Tables) -> DataFrame:
    """DQ21 — distinct exposed products per plant with their BOM summary (GROUP BY without
    aggregates)."""
    pairs = t.production.select("plant_id", "product_id").distinct()  # before the part list is joined
    bom = SUR.critical_bom(t).filter(F.col("watched_part_exposure_flag"))
    return (t.with_product(pairs, "product_name").join(t.plant.select("plant_id"), "plant_id").join(bom, "product_id")
            .select("plant_id", "product_id", "product_name", F.col("critical_part_count"), "critical_parts",
                    "watched_part_exposure_flag", "watched_part_qty_per_product"))


def order_cohort(t: Tables, id_prefix: str) -> DataFrame:
    """PRJ8 — evidence listing of the order lines whose id starts with a prefix (e.g. all
    lines of one order: ``"<order key>-"``); the prefix predicate is pushed to the scan."""
    return (t.order_line.filter(F.col("order_line_id").startswith(id_prefix))
            .select("order_line_id", "customer_id", "product_id", "plant_id", "promised_date",
                    "ordered_quantity", "fulfilled_quantity", "order_status")
            .orderBy("order_line_id"))
