"""Verified queries (VQ1-VQ14): the governed questions of the model, each one plan over one
surface. Most go through the semantic operator; the rest are filters/projections of a surface.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from supplymetrics.operators.relational import at_latest
from supplymetrics.plans import surfaces as SUR
from supplymetrics.plans.semantic import MODEL
from supplymetrics.sources.adapters import Tables


def vq01_fulfillment_by_segment(t: Tables) -> DataFrame:
    return MODEL.query(t, ["customer_segment"], ["fulfillment_rate"],
                       order_by=[F.col("fulfillment_rate").asc(), "customer_segment"])


def vq02_gaps_by_family(t: Tables) -> DataFrame:
    return MODEL.query(t, ["product_family"], ["order_lines_with_fulfillment_gaps"],
                       order_by=[F.col("order_lines_with_fulfillment_gaps").desc(), "product_family"])


def vq03_otd_by_carrier(t: Tables) -> DataFrame:
    return MODEL.query(t, ["carrier_name"], ["on_time_delivery_rate"],
                       order_by=[F.col("on_time_delivery_rate").asc(), "carrier_name"])


def vq04_delay_by_priority(t: Tables) -> DataFrame:
    return MODEL.query(t, ["customer_priority"], ["avg_delivery_delay_days"],
                       order_by=[F.col("avg_delivery_delay_days").desc(), "customer_priority"])


def vq05_attainment_by_plant(t: Tables) -> DataFrame:
    return MODEL.query(t, ["plant_name"], ["production_attainment"],
                       order_by=[F.col("production_attainment").asc(), "plant_name"])


def vq06_constrained_exposed(t: Tables) -> DataFrame:
    prd = SUR.production_performance(t, columns=("product_name", "constraint_flag", "watched_part_exposure_flag")).filter(F.col("watched_part_exposure_flag"))
    return (prd.groupBy("product_name")
            .agg(F.count_if(F.col("constraint_flag")).alias("constrained_production_days"),
                 F.count(F.lit(1)).alias("total_production_days"))
            .orderBy(F.col("constrained_production_days").desc(), "product_name"))


def vq07_below_safety_latest(t: Tables) -> DataFrame:
    inv = at_latest(SUR.inventory_position(t, columns=("snapshot_date", "plant_name", "below_safety_stock_flag")), "snapshot_date", t.latest_snapshot)
    return (inv.groupBy("plant_name")
            .agg(F.count_if(F.col("below_safety_stock_flag")).alias("parts_below_safety_stock"))
            .orderBy(F.col("parts_below_safety_stock").desc(), "plant_name"))


def vq08_available_by_date(t: Tables) -> DataFrame:
    return MODEL.query(t, ["snapshot_date"], ["total_available"], order_by=["snapshot_date"])


def vq09_defect_by_tier(t: Tables) -> DataFrame:
    return MODEL.query(t, ["supplier_tier"], ["defect_rate"],
                       order_by=[F.col("defect_rate").desc(), "supplier_tier"])


def vq10_high_receipt_delay(t: Tables) -> DataFrame:
    sp = SUR.supplier_performance(t)
    return (sp.filter(F.col("avg_receipt_delay_days") > 2)
            .select("supplier_name", "part_name", "avg_receipt_delay_days", "supply_risk_band")
            .orderBy(F.col("avg_receipt_delay_days").desc(), "supplier_name", "part_name"))


def vq13_multi_signal_products(t: Tables) -> DataFrame:
    r = SUR.risk_signals(t)
    return (r.filter(F.col("risk_signal_count") >= 2)
            .select("product_name", "fulfillment_rate", "on_time_delivery_rate", "production_attainment",
                    "risk_signal_count", "fulfillment_risk_flag", "delivery_risk_flag",
                    "production_risk_flag")
            .orderBy(F.col("risk_signal_count").desc(), F.col("production_attainment").asc(), "product_name"))


def vq14_exposed_and_constrained(t: Tables, month_start=None) -> DataFrame:
    """Exposed products with constrained days inside one month (default: the month of the
    latest production date)."""
    prd = SUR.production_performance(t, columns=("product_name", "production_date", "constraint_flag", "watched_part_exposure_flag"))
    if month_start is None:
        month_start = F.trunc(t.latest_production, "month")
    m = month_start if not isinstance(month_start, str) else F.lit(month_start).cast("date")
    in_month = (F.col("production_date") >= m) & (F.col("production_date") <= F.last_day(m))
    return (prd.filter(in_month & F.col("watched_part_exposure_flag"))
            .groupBy("product_name")
            .agg(F.count_if(F.col("constraint_flag")).alias("constrained_production_days"),
                 F.count_if(F.col("watched_part_exposure_flag")).alias("exposed_production_days"))
            .filter(F.col("constrained_production_days") > 0)
            .orderBy(F.col("constrained_production_days").desc(), "product_name"))


VERIFIED: dict[str, Callable[[Tables], DataFrame]] = {
    "vq01_fulfillment_by_segment": vq01_fulfillment_by_segment,
    "vq02_gaps_by_family": vq02_gaps_by_family,
    "vq03_otd_by_carrier": vq03_otd_by_carrier,
    "vq04_delay_by_priority": vq04_delay_by_priority,
    "vq05_attainment_by_plant": vq05_attainment_by_plant,
    "vq06_constrained_exposed": vq06_constrained_exposed,
    "vq07_below_safety_latest": vq07_below_safety_latest,
    "vq08_available_by_date": vq08_available_by_date,
    "vq09_defect_by_tier": vq09_defect_by_tier,
    "vq10_high_receipt_delay": vq10_high_receipt_delay,
    "vq13_multi_signal_products": vq13_multi_signal_products,
    "vq14_exposed_and_constrained": vq14_exposed_and_constrained,
}


def run_batch(t: Tables, names=None) -> DataFrame:
    """DSH11: run a set of verified queries and record each outcome apart — SUCCESS with its
    row count, NO_ROWS, or EXECUTION_FAILED with the whole error — as a small status DataFrame.

    Every query is written to the ``noop`` sink, so each output expression of each row is computed (a
    count alone would let the optimiser drop them); the rows are counted on the way by an observation. The edges of the lines are
    proven first, so that no query of the batch joins a parent only to confirm it."""
    rows = []
    with contextlib.suppress(Exception):  # without a proof the joins stay; what fails there fails in its queries, too
        t.prove()
    for name in (names or VERIFIED):
        try:
            seen = Observation()
            df = VERIFIED[name](t).observe(seen, F.count(F.lit(1)).alias("n"))
            df.write.format("noop").mode("overwrite").save()
            n = seen.get["n"]
            rows.append((name, "SUCCESS" if n else "NO_ROWS", int(n), None))
        except Exception as e:  # noqa: BLE001 — recorded, not raised
            rows.append((name, "EXECUTION_FAILED", None, str(e)))
    return t.spark.createDataFrame(rows, "query_id string, status string, row_count bigint, error string")


__all__ = ["VERIFIED", "run_batch"]
