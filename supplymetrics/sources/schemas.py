"""Typed entity tables (SRC2) and the grain registry the data-quality job checks.

Types follow the adapters in ``sources/adapters.py``: natural integer keys stay bigint/int,
composite line keys are strings, quantities are double, calendar values are dates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, I, D, B, DT = (T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(),
                     T.BooleanType(), T.DateType())


def _f(name, typ, nullable=True, comment=""):
    return T.StructField(name, typ, nullable, {"comment": comment} if comment else {})


SCHEMAS: dict[str, T.StructType] = {
    "supplier": T.StructType([
        _f("supplier_id", L, False, "Supplier key"), _f("supplier_code", S, False),
        _f("supplier_name", S, False), _f("supplier_region", S), _f("supplier_tier", S),
        _f("supplier_status", S)]),
    "part": T.StructType([
        _f("part_id", L, False), _f("part_code", S, False), _f("part_name", S, False),
        _f("part_category", S), _f("unit_of_measure", S), _f("criticality", S),
        _f("standard_cost", D)]),
    "product": T.StructType([
        _f("product_id", S, False), _f("product_code", S, False), _f("product_name", S, False),
        _f("product_family", S), _f("product_category", S), _f("unit_price", D)]),
    "plant": T.StructType([
        _f("plant_id", I, False), _f("plant_code", S, False), _f("plant_name", S, False),
        _f("city", S), _f("region", S), _f("plant_type", S), _f("capacity_units_per_day", D)]),
    "customer": T.StructType([
        _f("customer_id", L, False), _f("customer_code", S, False), _f("customer_name", S, False),
        _f("customer_segment", S), _f("customer_region", S), _f("customer_priority", S)]),
    "carrier": T.StructType([
        _f("carrier_id", S, False), _f("carrier_code", S, False), _f("carrier_name", S, False),
        _f("service_level", S), _f("carrier_region", S)]),
    "date_dim": T.StructType([
        _f("date_key", I, False), _f("calendar_date", DT, False), _f("year", I, False),
        _f("quarter", I, False), _f("month", I, False), _f("month_name", S, False),
        _f("week_of_year", I, False), _f("day_of_week", I, False), _f("day_name", S, False),
        _f("is_weekend", B, False)]),
    "supplier_part": T.StructType([
        _f("supplier_part_id", S, False), _f("supplier_id", L, False), _f("part_id", L, False),
        _f("preferred_supplier_flag", B), _f("allocation_percent", D)]),
    "product_part": T.StructType([
        _f("product_part_id", S, False), _f("product_id", S, False), _f("part_id", L, False),
        _f("quantity_per_product", D, False), _f("critical_part_flag", B)]),
    "purchase_order_line": T.StructType([
        _f("po_line_id", S, False), _f("po_id", L, False), _f("supplier_id", L, False),
        _f("part_id", L, False), _f("plant_id", I, False), _f("order_date", DT, False),
        _f("promised_receipt_date", DT, False), _f("ordered_quantity", D, False),
        _f("unit_cost", D), _f("po_line_status", S, False)]),
    "supply_receipt": T.StructType([
        _f("receipt_id", S, False), _f("po_line_id", S, False), _f("supplier_id", L, False),
        _f("part_id", L, False), _f("plant_id", I, False), _f("receipt_date", DT, False),
        _f("received_quantity", D, False), _f("accepted_quantity", D, False),
        _f("rejected_quantity", D, False), _f("receipt_status", S, False)]),
    "inventory": T.StructType([
        _f("inventory_snapshot_id", S, False), _f("part_id", L, False), _f("plant_id", I, False),
        _f("snapshot_date", DT, False), _f("on_hand_quantity", D, False),
        _f("reserved_quantity", D, False), _f("available_quantity", D, False),
        _f("safety_stock_quantity", D, False)]),
    "production": T.StructType([
        _f("production_id", S, False), _f("plant_id", I, False), _f("product_id", S, False),
        _f("production_date", DT, False), _f("planned_quantity", D, False),
        _f("produced_quantity", D, False), _f("downtime_hours", D, False),
        _f("production_status", S, False)]),
    "quality": T.StructType([
        _f("inspection_id", S, False), _f("supplier_id", L, False), _f("part_id", L, False),
        _f("plant_id", I, False), _f("inspection_date", DT, False),
        _f("inspected_quantity", D, False), _f("defective_quantity", D, False),
        _f("defect_type", S), _f("inspection_status", S, False)]),
    "order_line": T.StructType([
        _f("order_line_id", S, False), _f("order_id", L, False), _f("customer_id", L, False),
        _f("product_id", S, False), _f("plant_id", I, False), _f("order_date", DT, False),
        _f("promised_date", DT, False), _f("ordered_quantity", D, False),
        _f("fulfilled_quantity", D, False), _f("order_status", S, False)]),
    "shipment": T.StructType([
        _f("shipment_id", S, False), _f("order_line_id", S, False), _f("customer_id", L, False),
        _f("product_id", S, False), _f("plant_id", I, False), _f("carrier_id", S, False),
        _f("ship_date", DT, False), _f("promised_date", DT, False),
        _f("actual_delivery_date", DT), _f("shipped_quantity", D, False),
        _f("shipment_status", S, False), _f("delay_reason", S)]),
}

# Declared grain of every table and curated surface (keys that must be unique).
GRAIN: dict[str, tuple[str, ...]] = {
    "supplier": ("supplier_id",), "part": ("part_id",), "product": ("product_id",),
    "plant": ("plant_id",), "customer": ("customer_id",), "carrier": ("carrier_id",),
    "date_dim": ("calendar_date",),
    "supplier_part": ("supplier_id", "part_id"), "product_part": ("product_id", "part_id"),
    "purchase_order_line": ("po_line_id",), "supply_receipt": ("receipt_id",),
    "inventory": ("part_id", "plant_id", "snapshot_date"),
    "production": ("plant_id", "product_id", "production_date"),
    "quality": ("inspection_id",), "order_line": ("order_line_id",),
    "shipment": ("shipment_id",),
    "supplier_performance": ("supplier_id", "part_id"),
    "inventory_position": ("part_id", "plant_id", "snapshot_date"),
    "production_performance": ("plant_id", "product_id", "production_date"),
    "customer_fulfillment": ("order_line_id",),
    "shipment_performance": ("shipment_id",),
    "product_risk_signals": ("product_id",),
}


# Keys are declared in the metadata of their fields: place in the table's grain, counted from 1.
for _table, _schema in SCHEMAS.items():
    for _place, _key in enumerate(GRAIN[_table], 1):
        _schema[_key].metadata["key"] = _place

TABLE_COMMENTS = {name: f"One row per {' and '.join(GRAIN[name])}." for name in SCHEMAS}


def required(name: str) -> list[str]:
    """Columns of a table that must not be NULL."""
    return [f.name for f in SCHEMAS[name].fields if not f.nullable]


def enforce(df: DataFrame, name: str) -> DataFrame:
    """The rows of a table, refusing any with a NULL where the schema allows none: the action that meets it fails with the table and
    column named. The check is an expression on the column, so it adds no pass."""
    checked = {c: F.coalesce(F.col(c), F.raise_error(F.lit(f"{name}.{c} is NULL but declared NOT NULL")).cast(SCHEMAS[name][c].dataType)) for c in required(name)}
    return df.select([checked[f.name].alias(f.name, metadata=f.metadata) if f.name in checked else F.col(f.name) for f in SCHEMAS[name].fields])


def null_counts(df: DataFrame, name: str) -> DataFrame:
    """(table_name, column_name, nulls) of the columns that must not be NULL, in one pass."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required(name)])
    return wide.unpivot([], required(name), "column_name", "nulls").select(F.lit(name).alias("table_name"), "column_name", "nulls")


def conform(df: DataFrame, name: str, more: Sequence[str] = ()) -> DataFrame:
    """Project ``df`` onto the declared schema of ``name`` (order, types, column comments), followed by the columns ``more`` as they are."""
    schema = SCHEMAS[name]
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata)
                      for f in schema.fields] + list(more))
