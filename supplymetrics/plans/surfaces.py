"""Curated surfaces (SUR1-SUR6): each fact joined to its dimensions at a declared grain.

Rules carried over from the modelled product:
* a many-to-many bridge (the BOM) is aggregated to one row per product before it is joined;
* facts never join each other — cross-surface results aggregate each surface alone;
* ratios use a NULL-safe denominator and threshold flags stay three-valued.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplymetrics.functions import exprs as X
from supplymetrics.operators.relational import combine_signals, list_rows, listagg
from supplymetrics.sources.adapters import Tables

# Risk thresholds (strict "<" comparisons) and band cut-offs of the model.
FULFILLMENT_CUT = 0.90
OTD_CUT = 0.85
ATTAINMENT_CUT = 0.90
SUPPLY_HIGH = 3.0      # avg receipt delay days or defect %
SUPPLY_MEDIUM = 1.0
NEAR_SAFETY_FACTOR = 1.25
BOM_CHUNK = 4096       # parts per first-stage chunk of the critical-part list


def surface(fn):
    """Reuse a surface's lazy plan per ``Tables`` instance (one per session and directory).

    Only the analysed plan (not data) is kept, so repeated queries skip re-analysing the same
    joins on the driver; each call returns a new Dataset over it, planned with the session's
    current settings. Calls with a Column or DataFrame argument are built fresh."""
    @functools.wraps(fn)
    def wrapper(t: Tables, *args, **kwargs):
        if any(isinstance(a, (Column, DataFrame)) for a in (*args, *kwargs.values())):
            return fn(t, *args, **kwargs)
        memo = t.__dict__.setdefault("_surfaces", {})
        key = (fn.__name__, args, tuple(sorted(kwargs.items())))
        try:
            df = memo.get(key)
        except TypeError:  # unhashable argument
            return fn(t, *args, **kwargs)
        if df is None:
            df = memo[key] = fn(t, *args, **kwargs)
        # a new Dataset over the analysed plan, so physical planning follows the current config
        return df.select("*")
    return wrapper


def _plant(t: Tables) -> DataFrame:
    return t.plant.select("plant_id", "plant_name", F.col("region").alias("plant_region"))


CUSTOMER = ("customer_id", "customer_name", "customer_segment", "customer_region", "customer_priority")
PRODUCT = ("product_id", "product_name", "product_family", "product_category")
PLANT = ("plant_id", "plant_name", "plant_region")


def _joined(t: Tables, fact: str, own: Sequence[str], want: set[str], *edges_of_demand: str) -> DataFrame:
    """Rows of a fact that have a product, a plant and, where ``edges_of_demand`` are named, a customer, with the wanted attributes.

    A parent is joined if one of its columns is wanted, or if nothing proves that it is there (``Tables.prove``)."""
    customer = bool(edges_of_demand) and (bool(want & set(CUSTOMER)) or not t.proven(*edges_of_demand))
    product = bool(want & set(PRODUCT)) or not t.proven("part")
    plant = bool(want & set(PLANT)) or not t.proven("supplier")
    keys = ["customer_id"] * customer + ["product_id"] * product + ["plant_id"] * plant
    columns = [*dict.fromkeys([*own, *keys])]
    df = t.of_customers(fact, columns, [c for c in CUSTOMER[1:] if c in want]) if customer else t.columns(fact, *columns)
    if product:
        df = t.with_product(df, *[c for c in PRODUCT[1:] if c in want])
    if plant:
        df = df.join(_plant(t), "plant_id")
    return df


FULFILLMENT = ("order_line_id", "order_id", "order_date", "promised_date", *CUSTOMER, *PRODUCT, *PLANT, "ordered_quantity",
               "fulfilled_quantity", "unfulfilled_quantity", "fulfillment_pct", "order_status", "fulfillment_gap_flag")


@surface
def customer_fulfillment(t: Tables, columns: tuple[str, ...] = FULFILLMENT) -> DataFrame:
    """SUR4 — one row per order line, with the columns asked for."""
    want = set(columns)
    ordered, fulfilled = F.col("ordered_quantity"), F.col("fulfilled_quantity")
    own = [c for c in ("order_line_id", "order_id", "order_date", "promised_date", "order_status") if c in want]
    df = _joined(t, "order_line", [*own, "ordered_quantity", "fulfilled_quantity"], want, "orders", "customer")
    made = {"unfulfilled_quantity": X.gap(ordered, fulfilled), "fulfillment_pct": X.pct(fulfilled, ordered),
            "fulfillment_gap_flag": X.flag(fulfilled < ordered)}
    return df.select(*[made[c].alias(c) if c in made else F.col(c) for c in columns])


SHIPMENT = ("shipment_id", "order_line_id", *CUSTOMER, *PRODUCT[:3], *PLANT, "carrier_id", "carrier_name", "service_level", "ship_date",
            "promised_date", "actual_delivery_date", "shipped_quantity", "shipment_status", "delay_reason", "delivery_delay_days",
            "on_time_flag", "delivery_eligible_flag")


@surface
def shipment_performance(t: Tables, columns: tuple[str, ...] = SHIPMENT) -> DataFrame:
    """SUR5 — one row per shipment, with the columns asked for."""
    want = set(columns)
    own = [c for c in ("shipment_id", "order_line_id", "ship_date", "shipped_quantity", "shipment_status", "delay_reason") if c in want]
    df = _joined(t, "shipment", [*own, "carrier_id", "promised_date", "actual_delivery_date"], want, "orders", "customer")
    df = df.join(t.carrier.select("carrier_id", "carrier_name", "service_level"), "carrier_id")
    actual, promised = F.col("actual_delivery_date"), F.col("promised_date")
    made = {"delivery_delay_days": F.when(actual.isNotNull(), X.days_between(promised, actual)),
            "on_time_flag": X.flag(actual.isNotNull() & (actual <= promised)), "delivery_eligible_flag": X.flag(actual.isNotNull())}
    return df.select(*[made[c].alias(c) if c in made else F.col(c) for c in columns])


@surface
def critical_bom(t: Tables, watched_part: Column | int | None = None) -> DataFrame:
    """Critical BOM rows collapsed to one row per product (JN3 input): count, ordered list of
    'part (qty)', and exposure to the watched part. Two-stage (see ``listagg``)."""
    watched = t.watched_part if watched_part is None else (
        watched_part if isinstance(watched_part, Column) else F.lit(watched_part))
    bom = t.product_part.filter(F.col("critical_part_flag"))
    is_w = F.col("part_id") == watched
    item = F.concat(F.col("part_id").cast("string"), F.lit(" ("),
                    F.col("quantity_per_product").cast("string"), F.lit(")"))
    return listagg(
        bom, ["product_id"], item, F.col("part_id"),
        chunk=F.floor(F.col("part_id") / BOM_CHUNK),
        extra=[("critical_part_count", F.count(F.lit(1)), "sum"),
               ("watched_part_exposure_flag", X.any_when(is_w), "max"),
               ("watched_part_qty_per_product", X.value_when("quantity_per_product", is_w), "max")],
    ).withColumnRenamed("listagg", "critical_parts")


LIST_CHUNK = 64        # parts per row of the list that is returned as rows


def critical_part_rows(t: Tables) -> DataFrame:
    """The critical parts of every product as rows of at most LIST_CHUNK ids' width: product_id, chunk, position, items, part.

    ``critical_bom`` gives the whole list of a product as one string, which grows with the parts; these rows do not."""
    item = F.concat(F.col("part_id").cast("string"), F.lit(" ("), F.col("quantity_per_product").cast("string"), F.lit(")"))
    return list_rows(t.product_part.filter(F.col("critical_part_flag")), ["product_id"], item, F.col("part_id"),
                     F.floor(F.col("part_id") / LIST_CHUNK))


BOM = ("critical_part_count", "critical_parts", "watched_part_exposure_flag", "watched_part_qty_per_product")
PRODUCTION = ("production_id", "production_date", *PLANT, *PRODUCT, "planned_quantity", "produced_quantity", "production_gap_quantity",
              "production_attainment_pct", "downtime_hours", "production_status", "constraint_flag", *BOM)


@surface
def production_performance(t: Tables, watched_part: Column | int | None = None, columns: tuple[str, ...] = PRODUCTION) -> DataFrame:
    """SUR3 — one row per plant × product × production date; BOM attributes pre-aggregated, joined if asked for.

    A production row is a group of lines by plant and product, so both are always derived."""
    want = set(columns)
    df = t.with_product(t.production, *[c for c in PRODUCT[1:] if c in want])
    if want & set(PLANT) or not t.proven("supplier"):
        df = df.join(_plant(t), "plant_id")
    if want & set(BOM):
        # a product's rows (at most one a plant and day) come out together and few products share a task, so that a file keeps each of
        # their long part lists once, in its dictionary, instead of once a row
        df = df.repartition(t.partitions, "product_id").join(critical_bom(t, watched_part).hint("merge"), "product_id", "left")
    planned, produced = F.col("planned_quantity"), F.col("produced_quantity")
    made = {"production_gap_quantity": X.gap(planned, produced), "production_attainment_pct": X.pct(produced, planned),
            "constraint_flag": X.flag(F.col("production_status") == "Constrained"),
            "critical_part_count": F.coalesce(F.col("critical_part_count"), F.lit(0)) if want & set(BOM) else None,
            "watched_part_exposure_flag": F.coalesce(F.col("watched_part_exposure_flag"), F.lit(False)) if want & set(BOM) else None}
    return df.select(*[made[c].alias(c) if c in made else F.col(c) for c in columns])


PART = ("part_id", "part_name", "part_category", "criticality")
INVENTORY = ("inventory_snapshot_id", "snapshot_date", *PART, *PLANT, "on_hand_quantity", "reserved_quantity", "available_quantity",
             "safety_stock_quantity", "safety_stock_gap", "available_to_safety_stock_pct", "below_safety_stock_flag", "inventory_risk_band")


@surface
def inventory_position(t: Tables, dense: bool = False, columns: tuple[str, ...] = INVENTORY) -> DataFrame:
    """SUR2 — one row per part × plant × snapshot date (semi-additive quantities), with the columns asked for.

    ``dense`` fills the months without movements with the last balance (BLD2)."""
    want = set(columns)
    avail, safety = F.col("available_quantity"), F.col("safety_stock_quantity")
    made = {"safety_stock_gap": X.gap(avail, safety), "available_to_safety_stock_pct": X.pct(avail, safety),
            "below_safety_stock_flag": X.flag(avail < safety),
            "inventory_risk_band": X.band([(avail <= 0, "STOCKOUT"), (avail < safety, "BELOW_SAFETY_STOCK"),
                                           (avail < safety * NEAR_SAFETY_FACTOR, "NEAR_SAFETY_STOCK")], "HEALTHY")}
    compared = ["available_quantity", "safety_stock_quantity"] if want & set(made) else []
    own = [c for c in ("inventory_snapshot_id", "snapshot_date", "on_hand_quantity", "reserved_quantity", "available_quantity", "safety_stock_quantity") if c in want]
    own = [*dict.fromkeys([*own, *compared, "part_id", "plant_id"])]
    df = t.dense_inventory.select(*own) if dense else t.columns("inventory", *own)
    if want & set(PART) or not t.proven("part"):
        df = df.join(t.part.select("part_id", *[c for c in PART[1:] if c in want]), "part_id")
    if want & set(PLANT) or not t.proven("supplier"):
        df = df.join(_plant(t), "plant_id")
    return df.select(*[made[c].alias(c) if c in made else F.col(c) for c in columns])


@surface
def po_summary(t: Tables) -> DataFrame:
    """SUR1a — PO lines per supplier × part."""
    return t.columns("purchase_order_line", "supplier_id", "part_id", "ordered_quantity").groupBy("supplier_id", "part_id").agg(
        F.count(F.lit(1)).alias("po_line_count"),
        F.sum("ordered_quantity").alias("ordered_quantity"))


@surface
def receipt_summary(t: Tables) -> DataFrame:
    """SUR1b — receipts per PO line (delay vs the line's promise), then per supplier × part.
    The average delay is a mean of per-PO-line means (AGG14). Grouping starts with the order, by which
    the receipts are already partitioned."""
    promised, rdate = F.col("promised_receipt_date"), F.col("receipt_date")
    per_line = t.promised_receipts.groupBy("po_id", "po_line_id", "supplier_id", "part_id").agg(
        F.count(F.lit(1)).alias("receipt_count"),
        F.sum("received_quantity").alias("received_quantity"),
        F.sum("accepted_quantity").alias("accepted_quantity"),
        F.sum("rejected_quantity").alias("rejected_quantity"),
        F.avg(X.days_between(promised, rdate)).alias("avg_receipt_delay_days"),
        F.sum(X.iff(rdate <= promised, 1, 0)).alias("on_time_receipts"))
    return per_line.groupBy("supplier_id", "part_id").agg(
        F.sum("receipt_count").alias("receipt_count"),
        F.sum("received_quantity").alias("received_quantity"),
        F.sum("accepted_quantity").alias("accepted_quantity"),
        F.sum("rejected_quantity").alias("rejected_quantity"),
        X.dround(F.avg("avg_receipt_delay_days"), 2).alias("avg_receipt_delay_days"),
        F.sum("on_time_receipts").alias("on_time_receipts"))


@surface
def quality_summary(t: Tables) -> DataFrame:
    """SUR1c — inspections per supplier × part."""
    q = t.columns("quality", "supplier_id", "part_id", "inspected_quantity", "defective_quantity")
    return q.groupBy("supplier_id", "part_id").agg(
        F.sum("inspected_quantity").alias("inspected_quantity"),
        F.sum("defective_quantity").alias("defective_quantity"))


def supply_risk_band(avg_delay: Column, defect_pct_raw: Column) -> Column:
    """SUR1d — HIGH / MEDIUM / LOW; missing values count as 0 (rounded delay, unrounded defect %)."""
    d = F.coalesce(avg_delay, F.lit(0.0))
    q = F.coalesce(defect_pct_raw, F.lit(0.0))
    return X.band([((d >= SUPPLY_HIGH) | (q >= SUPPLY_HIGH), "HIGH"),
                   ((d >= SUPPLY_MEDIUM) | (q >= SUPPLY_MEDIUM), "MEDIUM")], "LOW")


@surface
def supplier_performance(t: Tables) -> DataFrame:
    """SUR1 — one row per supplier × part sourcing relationship.

    The three pre-aggregates are left-joined on the same composite key first, so the key's
    hash partitioning is shared by all three joins; the dimensions are joined after."""
    keys = ["supplier_id", "part_id"]
    sp = t.supplier_part.select("supplier_id", "part_id", "preferred_supplier_flag", "allocation_percent")
    df = (sp.join(po_summary(t), keys, "left")
          .join(receipt_summary(t), keys, "left")
          .join(quality_summary(t), keys, "left"))
    s = t.supplier.select("supplier_id", "supplier_name", "supplier_region", "supplier_tier", "supplier_status")
    p = t.part.select("part_id", "part_name", "part_category", "criticality")
    df = df.join(s, "supplier_id").join(p, "part_id")
    defect_raw = F.lit(100.0) * X.fdiv("defective_quantity", "inspected_quantity")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    zd = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return df.select(
        "supplier_id", "supplier_name", "supplier_region", "supplier_tier", "supplier_status",
        "part_id", "part_name", "part_category", "criticality",
        "preferred_supplier_flag", "allocation_percent",
        z("po_line_count"), zd("ordered_quantity"), z("receipt_count"),
        zd("received_quantity"), zd("accepted_quantity"), zd("rejected_quantity"),
        "avg_receipt_delay_days",
        X.pct("on_time_receipts", "receipt_count").alias("on_time_receipt_pct"),
        zd("inspected_quantity"), zd("defective_quantity"),
        X.pct("defective_quantity", "inspected_quantity").alias("defect_rate_pct"),
        supply_risk_band(F.col("avg_receipt_delay_days"), defect_raw).alias("supply_risk_band"))


def fulfilled_and_delivered(t: Tables) -> DataFrame:
    """Rows of SUR4 and SUR5 side by side, without attributes: order lines and shipments are the same lines and join the same parents, so
    what both surfaces hold of a line is derived once. Parents that are proven are not joined."""
    customers = None if t.proven("orders", "customer") else t.customer.select("customer_id")
    part, plant = not t.proven("part"), not t.proven("supplier")
    lines = t.demand(orders=False, part=part, supplier=plant, customers=customers)
    if part:
        lines = t.with_product(lines)
    if plant:
        lines = lines.join(_plant(t).select("plant_id"), "plant_id")
    actual, promised = F.col("actual_delivery_date"), F.col("promised_date")
    return lines.select("ordered_quantity", "fulfilled_quantity", X.flag(actual.isNotNull() & (actual <= promised)).alias("on_time_flag"),
                        X.flag(actual.isNotNull()).alias("delivery_eligible_flag"))


def _signals_of_surfaces(ful: DataFrame, shp: DataFrame, prd: DataFrame) -> DataFrame:
    """Signals per product of three surfaces that may come from anywhere: three inputs, one shuffle."""
    key = ["product_id", "product_name"]
    return _signals([
        ful.select(*key, F.col("fulfilled_quantity").alias("_ful"), F.col("ordered_quantity").alias("_ord"),
                   F.col("fulfillment_gap_flag").cast("long").alias("_gap"), F.lit(1).cast("long").alias("_ol")),
        shp.select(*key, F.col("on_time_flag").cast("long").alias("_ot"), F.col("delivery_eligible_flag").cast("long").alias("_el")),
        prd.select(*key, F.col("produced_quantity").alias("_prod"), F.col("planned_quantity").alias("_plan"),
                   F.col("constraint_flag").cast("long").alias("_con"), F.lit(1).cast("long").alias("_pd")),
    ])


def _signals_of_lines(t: Tables) -> DataFrame:
    """Signals per product from the lines themselves, of which all three surfaces are made.

    Order lines and shipments are the same rows, so they are derived once. Where the edges of the lines are proven, production
    is too: one derivation, grouped by product, plant and day, holds every signal."""
    key = ["product_id", "product_name"]
    if t.proven("part", "supplier", "orders", "customer"):
        days = t.with_product(t.daily_lines(), "product_name")
        short = F.col("produced_quantity") < F.col("ordered_quantity")
        return _signals([days.select(
            *key, F.col("fulfilled_quantity").alias("_ful"), F.col("ordered_quantity").alias("_ord"), F.col("gap_lines").alias("_gap"),
            F.col("order_lines").alias("_ol"), F.col("on_time_shipments").alias("_ot"), F.col("eligible_shipments").alias("_el"),
            F.col("produced_quantity").alias("_prod"), F.col("ordered_quantity").alias("_plan"), X.flag(short).cast("long").alias("_con"),
            F.lit(1).cast("long").alias("_pd"))])
    lines = t.with_product(t.demand(customers=t.customer.select("customer_id")), "product_name").join(_plant(t), "plant_id")
    actual, promised = F.col("actual_delivery_date"), F.col("promised_date")
    prd = production_performance(t, columns=("product_id", "product_name", "produced_quantity", "planned_quantity", "constraint_flag"))
    return _signals([
        lines.select(*key, F.col("fulfilled_quantity").alias("_ful"), F.col("ordered_quantity").alias("_ord"),
                     X.flag(F.col("fulfilled_quantity") < F.col("ordered_quantity")).cast("long").alias("_gap"), F.lit(1).cast("long").alias("_ol"),
                     X.flag(actual.isNotNull() & (actual <= promised)).cast("long").alias("_ot"), X.flag(actual.isNotNull()).cast("long").alias("_el")),
        prd.select(*key, F.col("produced_quantity").alias("_prod"), F.col("planned_quantity").alias("_plan"),
                   F.col("constraint_flag").cast("long").alias("_con"), F.lit(1).cast("long").alias("_pd")),
    ])


def _signals(parts: Sequence[DataFrame]) -> DataFrame:
    """Rates and counts per product in one aggregate over the union of ``parts``; an input that a part lacks is NULL."""
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return combine_signals(parts, ["product_id"], [
        F.max("product_name").alias("product_name"),
        X.ratio(F.sum("_ful"), F.sum("_ord"), None).alias("fulfillment_rate"),
        count("_gap").alias("order_lines_with_gaps"), count("_ol").alias("total_order_lines"),
        X.ratio(F.sum("_ot"), F.sum("_el"), None).alias("on_time_delivery_rate"),
        count("_el").alias("eligible_shipments"),
        X.ratio(F.sum("_prod"), F.sum("_plan"), None).alias("production_attainment"),
        count("_con").alias("constrained_days"), count("_pd").alias("total_production_days"),
    ])


@surface
def risk_signals(t: Tables, fulfillment: DataFrame | None = None, shipments: DataFrame | None = None,
                 production: DataFrame | None = None) -> DataFrame:
    """SUR6 — one row per product: three independent signals and their co-occurrence count.

    One pass: the inputs of the three surfaces are aggregated by product together (``combine_signals``) instead of joining
    a product universe to three aggregates. Where the surfaces come from the lines, they are derived together, too."""
    if fulfillment is None and shipments is None and production is None and t.DERIVED:
        agg = _signals_of_lines(t)
    else:
        agg = _signals_of_surfaces(customer_fulfillment(t) if fulfillment is None else fulfillment,
                                   shipment_performance(t) if shipments is None else shipments,
                                   production_performance(t) if production is None else production)
    fr, od, pa = F.col("fulfillment_rate"), F.col("on_time_delivery_rate"), F.col("production_attainment")
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    ffl, dfl, pfl = X.threshold_flag(fr, FULFILLMENT_CUT), X.threshold_flag(od, OTD_CUT), \
        X.threshold_flag(pa, ATTAINMENT_CUT)
    r = lambda c: X.dround(c, X.RATIO_DIGITS)
    return agg.select(
        "product_id", "product_name",
        r(fr).alias("fulfillment_rate"), "order_lines_with_gaps", "total_order_lines",
        ffl.alias("fulfillment_risk_flag"),
        r(od).alias("on_time_delivery_rate"), "eligible_shipments", dfl.alias("delivery_risk_flag"),
        r(pa).alias("production_attainment"), "constrained_days", "total_production_days",
        pfl.alias("production_risk_flag"),
        (one(ffl) + one(dfl) + one(pfl)).alias("risk_signal_count"))
