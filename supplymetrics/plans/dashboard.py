"""Dashboard aggregates (DSH1-DSH10, ORD2-ORD4, FN26-FN29).

Every function returns a small, final aggregate DataFrame; only these results are meant to
cross to the driver (``to_rows``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplymetrics.functions import exprs as X
from supplymetrics.operators.relational import at_latest, extreme, unpivot
from supplymetrics.plans import surfaces as SUR
from supplymetrics.plans.semantic import MODEL
from supplymetrics.sources.adapters import Tables

# Posture labels and their display order.
POSTURE_STATES = [("High Risk", 1), ("Watchlist", 2), ("Healthy", 3)]
SIGNAL_NAMES = [("fulfillment_risk_flag", "Fulfillment"), ("delivery_risk_flag", "Delivery"),
                ("production_risk_flag", "Production")]


def risk_table(t: Tables, risk: DataFrame | None = None) -> DataFrame:
    """DSH1."""
    r = SUR.risk_signals(t) if risk is None else risk
    return r.orderBy(F.col("risk_signal_count").desc(), "product_id")


def network_fulfillment_pct(t: Tables) -> DataFrame:
    """DSH2 — one row."""
    return SUR.customer_fulfillment(t, columns=("fulfilled_quantity", "ordered_quantity")).agg(_fulfillment_pct())


def _fulfillment_pct():
    return X.kpi_pct(X.fdiv(F.sum("fulfilled_quantity"), F.sum("ordered_quantity"))).alias("fulfillment_pct")


def _otd_pct():
    return X.kpi_pct(X.fdiv(F.count_if(F.col("on_time_flag")), F.count_if(F.col("delivery_eligible_flag")))).alias("otd_pct")


def network_otd_pct(t: Tables) -> DataFrame:
    """DSH3 — one row."""
    return SUR.shipment_performance(t, columns=("on_time_flag", "delivery_eligible_flag")).agg(_otd_pct())


def kpi_bands(t: Tables) -> DataFrame:
    """FN27 — both headline KPIs with their band; a missing KPI is its own band.

    Where order lines and shipments come from the same lines, both KPIs are one aggregate of them."""
    if t.DERIVED:
        both = SUR.fulfilled_and_delivered(t).agg(_fulfillment_pct(), _otd_pct())
        rows = [F.struct(F.lit(name).alias("kpi"), F.col(c).alias("value"), X.kpi_band(c, good, warn).alias("band"))
                for name, c, good, warn in (("fulfillment", "fulfillment_pct", 90, 80), ("on_time_delivery", "otd_pct", 85, 70))]
        return both.select(F.inline(F.array(*rows)))
    f = network_fulfillment_pct(t)
    s = network_otd_pct(t)
    return f.select(F.lit("fulfillment").alias("kpi"), F.col("fulfillment_pct").alias("value"),
                    X.kpi_band("fulfillment_pct", 90, 80).alias("band")).unionByName(
        s.select(F.lit("on_time_delivery").alias("kpi"), F.col("otd_pct").alias("value"),
                 X.kpi_band("otd_pct", 85, 70).alias("band")))


def inventory_trend(t: Tables, inv: DataFrame | None = None) -> DataFrame:
    """DSH4 — available and safety stock per snapshot date."""
    i = SUR.inventory_position(t, columns=("snapshot_date", "available_quantity", "safety_stock_quantity")) if inv is None else inv
    return (i.groupBy("snapshot_date")
            .agg(F.sum("available_quantity").alias("available_inventory"),
                 F.sum("safety_stock_quantity").alias("safety_stock_level"))
            .orderBy("snapshot_date"))


def latest_exceptions(t: Tables) -> DataFrame:
    """DSH5 — distinct parts below safety stock at the latest snapshot (no row when none)."""
    i = at_latest(SUR.inventory_position(t), "snapshot_date", t.latest_snapshot)
    return (i.filter(F.col("available_quantity") < F.col("safety_stock_quantity"))
            .groupBy("snapshot_date")
            .agg(F.count_distinct("part_id").alias("parts_below_safety_stock")))


def posture(t: Tables, risk: DataFrame | None = None) -> DataFrame:
    """DSH6 — posture counts in one aggregate."""
    r = SUR.risk_signals(t) if risk is None else risk
    n = F.col("risk_signal_count")
    return r.agg(F.count_if(n >= 2).alias("high_risk_count"),
                 F.count_if(n == 1).alias("watchlist_count"),
                 F.count_if(n == 0).alias("healthy_count"),
                 F.count_if(n >= 1).alias("attention_count"),
                 F.count_distinct("product_id").alias("monitored_count"))


def posture_table(t: Tables, risk: DataFrame | None = None) -> DataFrame:
    """DSH7 — products per attention state with share of scope; all three states listed.

    One pass: the posture counts and the product total come from a single aggregate, which
    is then reshaped to one row per state (so a state with no products still shows 0)."""
    p = posture(t, risk)
    total = F.greatest(F.col("monitored_count"), F.lit(1))
    rows = [F.struct(F.lit(label).alias("attention_state"), F.lit(order).alias("display_order"),
                     F.col(col).alias("product_count"),
                     X.dround(F.col(col) / total, 9).alias("share"))
            for (label, order), col in zip(POSTURE_STATES, ["high_risk_count", "watchlist_count", "healthy_count"])]
    return (p.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
            .orderBy("display_order"))


def priority_order():
    """ORD2 — signals desc, fulfilment asc, OTD asc (missing rates last), product id."""
    return [F.col("risk_signal_count").desc(), F.col("fulfillment_rate").asc_nulls_last(),
            F.col("on_time_delivery_rate").asc_nulls_last(), F.col("product_id").asc()]


def priority_list(t: Tables, risk: DataFrame | None = None) -> DataFrame:
    """DSH8 — products in priority order with their active signals and attention state."""
    r = SUR.risk_signals(t) if risk is None else risk
    return (r.select("product_id", "product_name", "risk_signal_count", "fulfillment_rate",
                     "on_time_delivery_rate",
                     X.active_signals(SIGNAL_NAMES).alias("active_signals"),
                     X.attention_state("risk_signal_count").alias("attention_state"))
            .orderBy(*priority_order()))


def top_priority(t: Tables, risk: DataFrame | None = None) -> DataFrame:
    """ORD3 — the first product in priority order, only if it has a signal."""
    return priority_list(t, risk).filter(F.col("risk_signal_count") > 0).limit(1)


def snapshots_below(t: Tables) -> DataFrame:
    """DSH9 — snapshots where network available < network safety stock, of all snapshots."""
    tr = inventory_trend(t)
    return tr.agg(F.count_if(F.col("available_inventory") < F.col("safety_stock_level")).alias("snapshots_below"),
                  F.count(F.lit(1)).alias("total_snapshots"))


def trend_long(t: Tables) -> DataFrame:
    """DSH10 — long form (snapshot_date, measure, value)."""
    return unpivot(inventory_trend(t), ["snapshot_date"],
                   ["available_inventory", "safety_stock_level"], "measure", "value")


def lowest_otd_carrier(t: Tables) -> DataFrame:
    """ORD4 — carrier with the lowest on-time delivery rate."""
    return extreme(MODEL.query(t, ["carrier_name"], ["on_time_delivery_rate"]),
                   "carrier_name", "on_time_delivery_rate", ascending=True)


def highest_defect_supplier(t: Tables) -> DataFrame:
    """ORD4 — supplier with the highest weighted defect rate."""
    per_supplier = MODEL.query(t, ["supplier_name"], ["defect_rate"])
    return extreme(per_supplier, "supplier_name", "defect_rate", ascending=False)
