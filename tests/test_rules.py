"""Grain rules of the semantic model are enforced before any plan is built."""

import pytest

from supplymetrics.plans.semantic import MODEL, AmbiguousName, GrainError


def test_two_facts_refused(small):
    with pytest.raises(GrainError):
        MODEL.query(small, [], ["total_on_hand", "production_attainment"])
    with pytest.raises(GrainError):
        MODEL.query(small, [], ["defect_rate", "on_time_delivery_rate"])


def test_foreign_fact_dimension_refused(small):
    with pytest.raises(GrainError):
        MODEL.query(small, ["shipment_performance.carrier_name"], ["fulfillment_rate"])


def test_bridge_not_in_model(small):
    with pytest.raises(GrainError):
        MODEL.query(small, ["product_part.part_id"], ["production_attainment"])


def test_unreachable_dimension(small):
    with pytest.raises(GrainError):
        MODEL.query(small, ["carrier_region"], ["fulfillment_rate"])


def test_non_additive_ratio_not_aggregated(small):
    with pytest.raises(GrainError):
        MODEL.query(small, ["supplier_performance.supplier_tier"], [],
                    aggregates={"x": ("sum", "avg_receipt_delay_days")})
    ok = MODEL.query(small, ["supplier_tier"], ["defect_rate"], aggregates={"rq": ("sum", "received_quantity")})
    assert set(ok.columns) == {"supplier_tier", "defect_rate", "rq"}


def test_synonyms(small):
    assert MODEL.resolve("order fill rate") == ("metric", "fulfillment_rate")
    assert MODEL.resolve_metric("fill rate").name == "fulfillment_rate"
    assert MODEL.resolve("stock levels") == ("table", "inventory_position")
    assert MODEL.resolve("qty received") == ("fact", "supplier_performance.received_quantity")
    assert MODEL.resolve("delivery reliability") == ("metric", "on_time_delivery_rate")
    assert MODEL.resolve("carrier") == ("dimension", "carrier_name")
    assert MODEL.resolve("service_level") == ("dimension", "service_level")
    with pytest.raises(KeyError):
        MODEL.resolve_metric("OTIF rate")


@pytest.mark.parametrize("name", ["fill rate", "average delay", "OTD rate", "ordered_quantity", "status", "qty ordered from"])
def test_ambiguous_names(name):
    if name == "qty ordered from":
        assert MODEL.resolve("qty ordered from supplier") == ("fact", "supplier_performance.ordered_quantity")
        return
    with pytest.raises(AmbiguousName):
        MODEL.resolve(name)


def test_bare_column_of_two_facts_is_ambiguous(small):
    with pytest.raises(AmbiguousName):
        MODEL.query(small, ["ordered_quantity"], [])


@pytest.mark.parametrize("name", ["product_risk_signals.fulfillment_rate", "shipment_performance.fulfillment_rate"])
def test_metric_of_another_table_refused(small, name):
    with pytest.raises(GrainError):
        MODEL.query(small, [], [name])


@pytest.mark.parametrize("column", ["product_risk_signals.fulfillment_rate", "customer_fulfillment.fulfillment_pct",
                                    "production_performance.production_attainment_pct", "inventory_position.available_to_safety_stock_pct"])
def test_precomputed_ratios_not_aggregated(small, column):
    with pytest.raises(GrainError):
        MODEL.query(small, [], [], aggregates={"x": ("avg", column)})


def test_facts_are_columns_of_their_surfaces(small):
    assert len(MODEL.facts) == 29
    for name in [*MODEL.facts, *MODEL.dimension_synonyms]:
        table, column = name.split(".")
        assert column in MODEL.tables[table].build(small).columns, name


def test_filter_on_unreachable_dimension_refused(small):
    with pytest.raises(GrainError):
        MODEL.query(small, ["plant_name"], ["fulfillment_rate"], where="carrier.carrier_region = 'National'")
    text = MODEL.query(small, ["plant_name"], ["fulfillment_rate"], where="customer_segment <> 'year carrier.carrier_region'")
    assert text.count() == 10


def test_dimension_table_alone(small):
    assert MODEL.query(small, ["plant.city"]).count() == 25


@pytest.mark.parametrize("where,same", [
    ("year(order_date) = 1998", "year = 1998"),
    ("month(order_date) = 6 or quarter in (1)", "month = 6 or quarter = 1"),
    ("order_date >= date '1998-01-01'", "calendar_date >= to_date('1998-01-01')"),
    ("order_date < timestamp '1995-03-05 00:00:00'", "`date` < '1995-03-05'"),
    ("plant_name <> \"month\"", "true"), ("plant_name = \"it's the year\"", "false"), ("plant.plant_name <> 'plant.city \"region\"'", "true"),
    ("`market segment` = 'BUILDING'", "customer_segment = \"BUILDING\""), ("PLANT.`plant city` like 'C%'", "startswith(plant_name, 'C')"),
    ("exists(array(year, 1), month -> month = 1995)", "year = 1995"),
    ("extract(year from order_date) = 1995 and order_date + interval '1' month > current_date", "false"),
])
def test_filters_know_what_is_a_name(small, where, same):
    asked = lambda w: sorted(MODEL.query(small, ["plant_name"], ["order_lines_with_fulfillment_gaps"], where=w).collect())
    assert asked(where) == asked(same)


@pytest.mark.parametrize("column", ["inventory_position.part_id", "inventory_position.available_to_safety_stock_pct", "inventory_position.plant_name"])
def test_only_declared_facts_are_aggregated(small, column):
    with pytest.raises(GrainError):
        MODEL.query(small, [], [], aggregates={"x": ("sum", column)})


def test_a_dimension_named_twice_is_one_column(small, tmp_path):
    df = MODEL.query(small, ["customer_segment", "segment", "customer_fulfillment.market segment"], ["fulfillment_rate"])
    assert df.columns == ["customer_segment", "fulfillment_rate"]
    df.write.parquet(str(tmp_path / "x"))


def test_dimension_registry(small):
    # one of the modelled dimensions is a fact here under another name only: 123 in all
    assert sum(map(len, MODEL.dimensions.values())) == 123
    for table, names in MODEL.dimensions.items():
        assert set(names) <= set(MODEL.tables[table].build(small).columns), table
    rows = {(r.kind, r.table, r.name): r for r in MODEL.describe(small).collect()}
    assert len(rows) == 11 + 123 + 29 + 12
    assert rows["dimension", "date_dim", "month"].data_type == "int" and rows["dimension", "date_dim", "month"].hierarchies == ["calendar.month"]
    assert rows["dimension", "supplier_performance", "defect_rate_pct"].rule == "never aggregated"
    assert rows["fact", "inventory_position", "on_hand_quantity"].rule == "never summed across snapshot_date"
    assert rows["table", "plant", "plant"].rule == "one row per plant_id"


def test_levels(small):
    assert MODEL.levels("quarter") == ["date_dim.year", "date_dim.quarter"]
    with pytest.raises(KeyError):
        MODEL.levels("calendar.decade")


def test_a_dimension_that_repeats_its_key_is_refused(spark, small):
    from supplymetrics.sources.adapters import FrameTables
    frames = {n: small.table(n) for n in ("order_line", "customer", "product", "plant", "date_dim")}
    good = FrameTables(spark, frames)
    assert MODEL.query(good, ["plant.region"], ["fulfillment_rate"]).count() == 5
    doubled = FrameTables(spark, frames | {"plant": small.plant.unionByName(small.plant.filter("plant_id = 3"))})
    with pytest.raises(GrainError):
        MODEL.query(doubled, ["plant.region"], ["fulfillment_rate"])
    with pytest.raises(GrainError):
        MODEL.query(doubled, ["customer_segment"], ["fulfillment_rate"], where="plant.region = 'ASIA'")
