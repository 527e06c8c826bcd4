"""The sixteen entity tables, derived from the driver's TPC-H-style tables.

Each property returns a lazy DataFrame; nothing is computed until an action runs. Scans select
only the columns they use, so Parquet reads are pruned. Facts join only the parents whose
attributes they need (e.g. production never touches ``orders``).

Join sizing: ``region``/``nation`` (plants) and the four carriers have a fixed, proven bound and
are broadcast explicitly, and so are the two columns that lines take from suppliers as long as the
supplier files stay below ``SUPPLIER_BROADCAST_BYTES``. Every other parent (customer, part, orders, derived
products) grows with the data and is left to the planner: the static threshold uses file
statistics, and AQE re-plans from measured shuffle sizes, switching to a broadcast join only
when the measured side is small and handling skewed keys in sort-merge joins. Orders meet their customers
before the lines, so lines are shuffled by order once and never by customer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplymetrics.functions import exprs as X
from supplymetrics.session import fit_partitions, partitions_for
from supplymetrics.sources.schemas import conform

# The carriers of the adapter (id, code, name, service level, region).
CARRIERS = [
    ("CA01", "CA01", "Northwind Freight", "Express", "National"),
    ("CA02", "CA02", "Blue Arrow Logistics", "Standard", "National"),
    ("CA03", "CA03", "Coastal Carriers", "Economy", "Regional"),
    ("CA04", "CA04", "Summit Express", "Express", "Regional"),
]

# Columns of the facts that come from a parent of the line; all others are the line's own.
FROM_PARENTS = {
    "purchase_order_line": {"orders": {"order_date", "promised_receipt_date"}, "supplier": {"plant_id"}},
    "supply_receipt": {"orders": {"receipt_date"}, "supplier": {"plant_id"}},
    "quality": {"supplier": {"plant_id"}},
    "inventory": {"part": {"safety_stock_quantity"}},
    "order_line": {"orders": {"customer_id", "order_date", "promised_date"}, "part": {"product_id"}, "supplier": {"plant_id"}},
    "shipment": {"orders": {"customer_id"}, "part": {"product_id"}, "supplier": {"plant_id"}},
}

_INSTANCES: dict[tuple[int, str], "Tables"] = {}
SUPPLIER_BROADCAST_BYTES = 32 << 20  # files of some 1.4 million suppliers, whose two columns are a few tens of MB
DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def line_key() -> Column:
    """Line identifier: order-part-supplier. Lines that repeat it are one purchase-order line; as order
    lines and shipments they are reported by the grain checks."""
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"),
                       F.col("l_suppkey").cast("string"))


def product_key(brand, ptype) -> Column:
    return F.concat(brand, F.lit("|"), ptype)


def _attributes(customers: DataFrame | None) -> list[str]:
    return [] if customers is None else [c for c in customers.columns if c != "customer_id"]


class Tables:
    """Entity tables over one driver directory (``sf_dir``)."""

    DERIVED = True  # facts come from the driver's lines, so several can share one derivation

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._scans: dict[str, DataFrame] = {}
        self.bytes: dict[str, int] = {}  # of the tables' files, as far as they were asked for

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        """Entity tables over the files that lie in the directory now.

        An instance keeps its file listings and lazy plans. The one made last for a directory is returned
        again only while its files are the same, so a query never sees an old listing."""
        key, state = (id(spark), sf_dir.rstrip("/")), cls._state(spark, sf_dir)
        fit_partitions(spark, max((length for *_, length in state), default=0))
        t = _INSTANCES.get(key)
        if t is None or t.spark is not spark or t.state != state:
            t = _INSTANCES[key] = cls(spark, sf_dir)
            t.state = state
            t.bytes = {name: length for name, *_, length in state}
        return t

    @property
    def partitions(self) -> int:
        """Partitions for a shuffle that names its number: they follow the largest table's files."""
        return partitions_for(self.spark, max(self.bytes.values(), default=0))

    @staticmethod
    def _state(spark: SparkSession, sf_dir: str):
        """Change time, files and bytes of every driver table, asked of the file system in one call each."""
        jvm, out = spark._jvm, []
        for name in DRIVER_TABLES:
            path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            if fs.exists(path):
                summary = fs.getContentSummary(path)
                out.append((name, fs.getFileStatus(path).getModificationTime(), summary.getFileCount(), summary.getLength()))
        return out

    # --- driver scans ------------------------------------------------------------------
    def read(self, name: str, *cols: str) -> DataFrame:
        df = self._scans.get(name)
        if df is None:
            df = self._scans[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.select(*cols) if cols else df

    def _lines(self, orders=False, part=False, supplier=False, customers: DataFrame | None = None, customer_join="inner") -> DataFrame:
        """lineitem with derived columns and only the requested parents joined. Lines without a parent
        stay (their derived columns are NULL), so the integrity job can report them. The columns of a
        parent that is not asked for are NULL.

        ``customers`` are customers by ``customer_id`` that the orders meet before the lines do; with an inner ``customer_join``
        only the lines of orders that have one stay. Columns made of the line itself are added after the joins, so shuffles
        carry the line's own narrow columns."""
        li = self.read("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                       "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus",
                       "l_shipdate")
        if supplier:
            s = self.read("supplier", "s_suppkey", "s_nationkey")
            li = li.join(F.broadcast(s) if self._supplier_fits else s, li.l_suppkey == s.s_suppkey, "left").withColumn("plant_id", F.col("s_nationkey"))
        else:
            li = li.withColumn("plant_id", F.lit(None).cast("int"))
        if part:
            p = self.read("part", "p_partkey", "p_brand", "p_type", "p_size")
            li = (li.join(p, li.l_partkey == p.p_partkey, "left")
                  .withColumn("product_id", product_key(F.col("p_brand"), F.col("p_type"))))
        else:
            li = li.withColumns({"product_id": F.lit(None).cast("string"), "p_size": F.lit(None).cast("int")})
        # orders last: at scale this join shuffles, and its output stays
        # hash-partitioned by order key for the PO-line aggregation that follows
        if orders or customers is not None:
            o = self.read("orders", "o_orderkey", "o_custkey", "o_orderdate")
            if customers is not None:
                c = customers.withColumnRenamed("customer_id", "_customer_id")
                o = o.join(c, o.o_custkey == F.col("_customer_id"), customer_join).drop("_customer_id")
            li = (li.join(o, li.l_orderkey == o.o_orderkey, "left" if customers is None else customer_join)
                  .withColumn("order_date", F.to_date("o_orderdate")))
        else:
            li = li.withColumns({"o_custkey": F.lit(None).cast("long"), "order_date": F.lit(None).cast("date")})
        return li.withColumns({"q": F.col("l_quantity"), "ship_date": F.to_date("l_shipdate"), "line_id": line_key()})

    @property
    def _supplier_fits(self) -> bool:
        """Whether the suppliers' two columns are broadcast; never where the session has switched broadcast joins off."""
        off = self.spark.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-")
        return not off and self.bytes.get("supplier", SUPPLIER_BROADCAST_BYTES) < SUPPLIER_BROADCAST_BYTES

    @cached_property
    def _nation_region(self) -> DataFrame:
        n = self.read("nation", "n_nationkey", "n_name", "n_regionkey")
        r = self.read("region", "r_regionkey", "r_name")
        # nation and region are fixed-size reference tables (25 and 5 rows in any scale).
        return F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey))

    # --- dimensions --------------------------------------------------------------------
    @cached_property
    def supplier(self) -> DataFrame:
        s = self.read("supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
        df = s.join(self._nation_region, s.s_nationkey == F.col("n_nationkey"), "left").select(
            F.col("s_suppkey").alias("supplier_id"),
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("supplier_code"),
            F.col("s_name").alias("supplier_name"),
            F.col("r_name").alias("supplier_region"),
            X.band([(F.col("s_acctbal") >= 6000, "Strategic"),
                    (F.col("s_acctbal") >= 2500, "Preferred")], "Standard").alias("supplier_tier"),
            F.lit("Active").alias("supplier_status"))
        return conform(df, "supplier")

    @cached_property
    def part(self) -> DataFrame:
        p = self.read("part", "p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
        df = p.select(
            F.col("p_partkey").alias("part_id"),
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("part_code"),
            F.col("p_name").alias("part_name"),
            F.col("p_type").alias("part_category"),
            F.lit("EA").alias("unit_of_measure"),
            X.band([(F.col("p_size") >= 40, "Critical"), (F.col("p_size") >= 25, "High"),
                    (F.col("p_size") >= 10, "Medium")], "Low").alias("criticality"),
            F.col("p_retailprice").alias("standard_cost"))
        return conform(df, "part")

    @cached_property
    def product(self) -> DataFrame:
        p = self.read("part", "p_brand", "p_type", "p_retailprice")
        df = (p.groupBy("p_brand", "p_type").agg(F.max("p_retailprice").alias("unit_price"))
              .select(product_key(F.col("p_brand"), F.col("p_type")).alias("product_id"),
                      product_key(F.col("p_brand"), F.col("p_type")).alias("product_code"),
                      F.concat_ws(" ", "p_brand", "p_type").alias("product_name"),
                      F.col("p_brand").alias("product_family"),
                      F.col("p_type").alias("product_category"),
                      "unit_price"))
        return conform(df, "product")

    @cached_property
    def plant(self) -> DataFrame:
        df = self._nation_region.select(
            F.col("n_nationkey").alias("plant_id"),
            F.concat(F.lit("PL"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("plant_code"),
            F.col("n_name").alias("plant_name"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("region"),
            F.lit("Assembly").alias("plant_type"),
            F.lit(None).cast("double").alias("capacity_units_per_day"))
        return F.broadcast(conform(df, "plant"))

    @cached_property
    def customer(self) -> DataFrame:
        c = self.read("customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
        df = c.join(self._nation_region, c.c_nationkey == F.col("n_nationkey"), "left").select(
            F.col("c_custkey").alias("customer_id"),
            F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("customer_code"),
            F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("customer_segment"),
            F.col("r_name").alias("customer_region"),
            X.band([(F.col("c_acctbal") >= 6000, "Strategic"),
                    (F.col("c_acctbal") >= 2500, "High")], "Standard").alias("customer_priority"))
        return conform(df, "customer")

    @cached_property
    def carrier(self) -> DataFrame:
        schema = "carrier_id string, carrier_code string, carrier_name string, " \
                 "service_level string, carrier_region string"
        return F.broadcast(conform(self.spark.createDataFrame(CARRIERS, schema), "carrier"))

    @cached_property
    def date_bounds(self) -> tuple[Column, Column]:
        """First and last calendar day the facts can reference, as scalar subqueries."""
        o = self.read("orders", "o_orderdate")
        li = self.read("lineitem", "l_shipdate")
        lo = F.least(o.select(F.min(F.to_date("o_orderdate"))).scalar(),
                     li.select(F.min(F.to_date("l_shipdate"))).scalar())
        hi = F.last_day(li.select(F.max(F.to_date("l_shipdate"))).scalar())
        return lo, hi

    @cached_property
    def date_dim(self) -> DataFrame:
        from supplymetrics.operators.builders import calendar
        lo, hi = self.date_bounds
        return calendar(self.spark, lo, hi)  # as long as the data's dates, so not broadcast by hand

    def with_product(self, df: DataFrame, *cols: str) -> DataFrame:
        """The rows of ``df`` that have a product, with its attributes.

        A product id spells its brand and type, so no join (and no shuffle on the few product ids)
        is needed; a line without a part has no product id."""
        brand, ptype = F.substring_index("product_id", "|", 1), F.substring_index("product_id", "|", -1)
        values = {"product_name": F.concat_ws(" ", brand, ptype), "product_family": brand, "product_category": ptype}
        return df.filter(F.col("product_id").isNotNull()).withColumns({c: values[c] for c in cols})

    # --- bridges -----------------------------------------------------------------------
    @cached_property
    def supplier_part(self) -> DataFrame:
        sp = self.read("lineitem", "l_suppkey", "l_partkey").distinct()
        df = sp.select(
            F.concat_ws("-", F.col("l_suppkey").cast("string"),
                        F.col("l_partkey").cast("string")).alias("supplier_part_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_partkey").alias("part_id"),
            ((F.col("l_suppkey") + F.col("l_partkey")) % 2 == 0).alias("preferred_supplier_flag"),
            F.lit(50.0).alias("allocation_percent"))
        return conform(df, "supplier_part")

    @cached_property
    def product_part(self) -> DataFrame:
        """Bill of materials: each part is used by its own product and by one more product
        (brand chosen from the part key). Many-to-many; deduplicated within the part row, so no
        shuffle is needed."""
        p = self.read("part", "p_partkey", "p_brand", "p_type", "p_size")
        alt_brand = F.concat(F.lit("Brand#"), (F.lit(1) + F.col("p_partkey") % 25).cast("string"))
        df = (p.select("p_partkey", "p_size", F.explode(F.array_distinct(F.array(
                    product_key(F.col("p_brand"), F.col("p_type")),
                    product_key(alt_brand, F.col("p_type"))))).alias("product_id"))
              .select(F.concat_ws("-", F.col("product_id"),
                                  F.col("p_partkey").cast("string")).alias("product_part_id"),
                      "product_id",
                      F.col("p_partkey").alias("part_id"),
                      (F.col("p_size") % 4 + 1).cast("double").alias("quantity_per_product"),
                      (F.col("p_size") >= 40).alias("critical_part_flag")))
        return conform(df, "product_part")

    @cached_property
    def watched_part(self) -> Column:
        """Default watched part: the smallest critical part id (a scalar subquery)."""
        return self.part.filter(F.col("criticality") == "Critical").select(F.min("part_id")).scalar()

    def _latest_ship_date(self, part: DataFrame) -> Column:
        """Latest ship date of the lines that have one of the parts and a plant, as the surfaces' rows have."""
        li = self.read("lineitem", "l_partkey", "l_suppkey", "l_shipdate")
        if self.proven("part", "supplier"):
            return li.select(F.max(F.to_date("l_shipdate"))).scalar()
        s = self.read("supplier", "s_suppkey", "s_nationkey")
        s = s.join(self._nation_region, s.s_nationkey == F.col("n_nationkey"), "left_semi")
        li = li.join(part, li.l_partkey == part.p_partkey, "left_semi").join(s, li.l_suppkey == s.s_suppkey, "left_semi")
        return li.select(F.max(F.to_date("l_shipdate"))).scalar()

    @property
    def latest_production(self) -> Column:
        """Latest production date of a product and plant."""
        p = self.read("part", "p_partkey", "p_brand", "p_type")
        return self._latest_ship_date(p.filter(product_key(F.col("p_brand"), F.col("p_type")).isNotNull()).select("p_partkey"))

    @property
    def latest_snapshot(self) -> Column:
        """Latest inventory snapshot of a part and plant: the month end after their latest ship date."""
        return F.last_day(self._latest_ship_date(self.read("part", "p_partkey")))

    # --- facts -------------------------------------------------------------------------
    @cached_property
    def purchase_order_line(self) -> DataFrame:
        return self._purchase_order_line()

    def _purchase_order_line(self, orders=True, supplier=True) -> DataFrame:
        li = self._lines(orders=orders, supplier=supplier)
        df = (li.groupBy("l_orderkey", "l_partkey", "l_suppkey", "plant_id", "order_date")
              .agg(F.sum("q").alias("ordered_quantity"),
                   F.max(F.col("l_extendedprice") / X.nullif_zero(F.col("q"))).alias("unit_cost"),
                   F.max("l_linestatus").alias("_st"))
              .select(line_key().alias("po_line_id"),
                      F.col("l_orderkey").alias("po_id"),
                      F.col("l_suppkey").alias("supplier_id"),
                      F.col("l_partkey").alias("part_id"),
                      "plant_id", "order_date",
                      F.date_add("order_date", 5).alias("promised_receipt_date"),
                      "ordered_quantity", "unit_cost",
                      X.iff(F.col("_st") == "O", "Open", "Closed").alias("po_line_status")))
        return conform(df, "purchase_order_line")

    @cached_property
    def supply_receipt(self) -> DataFrame:
        return self._supply_receipt()

    @property
    def promised_receipts(self) -> DataFrame:
        """Receipts with the order and the promise of their purchase-order line. Both follow from the
        receipt's own order, so purchase-order lines are neither derived nor joined."""
        return self._receipts(supplier=False).drop("plant_id")

    def _supply_receipt(self, orders=True, supplier=True) -> DataFrame:
        return conform(self._receipts(orders, supplier), "supply_receipt")

    def _receipts(self, orders=True, supplier=True) -> DataFrame:
        """One receipt per finished line; lines 5-7 arrive in two receipts (split quantity)."""
        li = self._lines(orders=orders, supplier=supplier).filter(F.col("l_linestatus") == "F")
        ln, q = F.col("l_linenumber"), F.col("q")
        promised = F.date_add("order_date", 5)
        n = F.col("receipt_no")
        li = li.withColumn("receipt_no", F.explode(
            F.when(ln >= 5, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        received = (F.when(n == 1, F.when(ln < 5, q).otherwise(X.floor_d(q / 2)))
                    .otherwise(q - X.floor_d(q / 2)))
        return (li.withColumn("received_quantity", received)
              .withColumn("rejected_quantity",
                          F.when(F.col("l_returnflag") == "R",
                                 X.floor_d(F.col("received_quantity") / 10)).otherwise(F.lit(0.0)))
              .select(F.concat_ws("-", F.col("line_id"), ln.cast("string"),
                                  n.cast("string")).alias("receipt_id"),
                      F.col("line_id").alias("po_line_id"),
                      F.col("l_suppkey").alias("supplier_id"),
                      F.col("l_partkey").alias("part_id"),
                      "plant_id",
                      F.when(n == 1, F.date_add(promised, ln - 3))
                       .otherwise(F.date_add(promised, ln + 4)).alias("receipt_date"),
                      "received_quantity",
                      (F.col("received_quantity") - F.col("rejected_quantity")).alias("accepted_quantity"),
                      "rejected_quantity",
                      F.lit("Received").alias("receipt_status"),
                      F.col("l_orderkey").alias("po_id"),
                      promised.alias("promised_receipt_date")))

    @cached_property
    def quality(self) -> DataFrame:
        return self._quality()

    def _quality(self, supplier=True) -> DataFrame:
        li = self._lines(supplier=supplier).filter(F.col("l_returnflag").isin("A", "R"))
        ln = F.col("l_linenumber")
        defective = F.when(F.col("l_returnflag") == "R", (ln % 3).cast("double")).otherwise(F.lit(0.0))
        df = li.select(
            F.concat_ws("-", F.col("line_id"), ln.cast("string")).alias("inspection_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_partkey").alias("part_id"),
            "plant_id",
            F.col("ship_date").alias("inspection_date"),
            F.col("q").alias("inspected_quantity"),
            defective.alias("defective_quantity"),
            F.when(defective > 0, F.lit("Dimensional")).alias("defect_type"),
            X.iff(defective > 0, "Failed", "Passed").alias("inspection_status"))
        return conform(df, "quality")

    @cached_property
    def inventory(self) -> DataFrame:
        return self._inventory()

    def _inventory(self, part=True) -> DataFrame:
        """Month-end snapshots per part and plant; the part is joined to the snapshots, not to the lines."""
        li = self._lines(supplier=True).withColumn("snapshot_date", F.last_day("ship_date"))
        df = (li.groupBy(F.col("l_partkey").alias("part_id"), "plant_id", "snapshot_date")
              .agg(F.sum("q").alias("on_hand_quantity"),
                   F.sum(F.when(F.col("l_linestatus") == "O", X.floor_d(F.col("q") / 2))
                         .otherwise(F.lit(0.0))).alias("reserved_quantity"))
              .withColumn("available_quantity",
                          F.col("on_hand_quantity") - F.col("reserved_quantity"))
              .withColumn("inventory_snapshot_id",
                          F.concat_ws("-", F.col("part_id").cast("string"),
                                      F.col("plant_id").cast("string"), X.yyyymmdd("snapshot_date"))))
        safety = F.lit(None)
        if part:
            p = self.read("part", "p_partkey", "p_size")
            df, safety = df.join(p, df.part_id == p.p_partkey, "left"), F.col("p_size")
        return conform(df.withColumn("safety_stock_quantity", safety.cast("double")), "inventory")

    @cached_property
    def dense_inventory(self) -> DataFrame:
        """Inventory with a snapshot of every part and plant at every month end from its first movement to the latest
        snapshot: a month without movements carries the balance of the one before."""
        from supplymetrics.operators.builders import fill_months
        own = self.inventory.withColumn("_dated", F.col("snapshot_date"))
        dense = fill_months(own, ["part_id", "plant_id"], "snapshot_date", self.latest_snapshot)
        carried = F.concat_ws("-", "inventory_snapshot_id", X.yyyymmdd("snapshot_date"))
        return conform(dense.withColumn("inventory_snapshot_id", F.when(F.col("snapshot_date") == F.col("_dated"), F.col("inventory_snapshot_id"))
                                        .otherwise(carried)), "inventory")

    @cached_property
    def production(self) -> DataFrame:
        li = self._lines(part=True, supplier=True)
        df = (li.groupBy("plant_id", "product_id", F.col("ship_date").alias("production_date"))
              .agg(F.sum("q").alias("planned_quantity"), F.sum(self._produced()).alias("produced_quantity"),
                   F.count_if(self._hit()).cast("double").alias("downtime_hours"))
              .withColumn("production_status",
                          X.iff(F.col("produced_quantity") < F.col("planned_quantity"),
                                "Constrained", "Normal"))
              .withColumn("production_id",
                          F.concat_ws("-", F.col("plant_id").cast("string"), F.col("product_id"),
                                      X.yyyymmdd("production_date"))))
        return conform(df, "production")

    def demand(self, orders=True, part=True, supplier=True, customers: DataFrame | None = None, customer_join="inner") -> DataFrame:
        """Order lines and their shipments side by side: both come from the same line, so it is derived once. With ``customers`` they
        also hold what these say of the order's customer."""
        li = self._demand_lines(orders=orders, part=part, supplier=supplier, customers=customers, customer_join=customer_join)
        return li.select(
            F.col("line_id").alias("order_line_id"), "l_orderkey", "l_partkey", "l_suppkey", "order_date",
            F.col("o_custkey").alias("customer_id"), "product_id", "plant_id", "ship_date",
            F.col("q").alias("ordered_quantity"), "fulfilled_quantity",
            F.date_add("ship_date", 6).alias("promised_date"), self._delivered().alias("actual_delivery_date"),
            self._order_status().alias("order_status"), self._shipment_status().alias("shipment_status"), *_attributes(customers))

    @staticmethod
    def _order_status() -> Column:
        ful = F.col("fulfilled_quantity")
        return X.band([(ful <= 0, "Open"), (ful < F.col("q"), "Partially Fulfilled")], "Fulfilled")

    @staticmethod
    def _shipment_status() -> Column:
        return X.iff(Tables._in_transit(), "In Transit", "Delivered")

    @staticmethod
    def _delivered() -> Column:
        """Actual delivery date of a line; none while it is in transit."""
        return F.when(~Tables._in_transit(), F.date_add("ship_date", F.col("l_linenumber")))

    @staticmethod
    def _in_transit() -> Column:
        return (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")

    @staticmethod
    def _produced() -> Column:
        """Produced quantity of a line: finished and accepted ones were cut to four tenths."""
        return F.when(Tables._hit(), X.floor_d(F.col("q") * 4 / 10)).otherwise(F.col("q"))

    @staticmethod
    def _hit() -> Column:
        return (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")

    def daily_lines(self) -> DataFrame:
        """Demand, deliveries and production of a product by plant and day, from one derivation of the lines.

        Every line counts, so this equals the three facts only where the edges of the lines are proven."""
        actual, promised = self._delivered(), F.date_add("ship_date", 6)
        li = self._demand_lines(part=True, supplier=True)
        return li.groupBy("product_id", "plant_id", "ship_date").agg(
            F.sum("q").alias("ordered_quantity"), F.sum("fulfilled_quantity").alias("fulfilled_quantity"),
            F.count_if(F.col("fulfilled_quantity") < F.col("q")).alias("gap_lines"), F.count(F.lit(1)).alias("order_lines"),
            F.count_if(actual.isNotNull()).alias("eligible_shipments"), F.count_if(actual <= promised).alias("on_time_shipments"),
            F.sum(self._produced()).alias("produced_quantity"))

    def _demand_lines(self, **parents) -> DataFrame:
        q = F.col("q")
        return self._lines(**parents).withColumn("fulfilled_quantity",
                             F.when(F.col("l_returnflag") == "R", X.floor_d(q * 7 / 10)).otherwise(q))

    @cached_property
    def order_line(self) -> DataFrame:
        return self._order_line()

    def _order_line(self, orders=True, part=True, supplier=True, customers: DataFrame | None = None) -> DataFrame:
        li = self._demand_lines(orders=orders, part=part, supplier=supplier, customers=customers)
        df = li.select(
            F.col("line_id").alias("order_line_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            "product_id", "plant_id", "order_date",
            F.date_add("order_date", 10).alias("promised_date"),
            F.col("q").alias("ordered_quantity"), "fulfilled_quantity", self._order_status().alias("order_status"), *_attributes(customers))
        return conform(df, "order_line", _attributes(customers))

    @cached_property
    def shipment(self) -> DataFrame:
        return self._shipment()

    def _shipment(self, orders=True, part=True, supplier=True, customers: DataFrame | None = None) -> DataFrame:
        li = self._demand_lines(orders=orders, part=part, supplier=supplier, customers=customers)
        actual, promised = self._delivered(), F.date_add("ship_date", 6)
        df = li.select(
            F.col("line_id").alias("shipment_id"),
            F.col("line_id").alias("order_line_id"),
            F.col("o_custkey").alias("customer_id"),
            "product_id", "plant_id",
            # never NULL, and said so: a filter on it in the scan would keep shipments from sharing the order lines' shuffles
            F.coalesce(F.concat(F.lit("CA0"), (X.bucket(F.col("line_id"), 4) + 1).cast("string")), F.lit("")).alias("carrier_id"),
            "ship_date",
            promised.alias("promised_date"),
            actual.alias("actual_delivery_date"),
            F.col("fulfilled_quantity").alias("shipped_quantity"),
            self._shipment_status().alias("shipment_status"),
            F.when(actual > promised, F.lit("Carrier delay")).alias("delay_reason"), *_attributes(customers))
        return conform(df, "shipment", _attributes(customers))

    # --- integrity -----------------------------------------------------------------------
    UNIQUE_BY_CONSTRUCTION = ("date_dim", "product", "carrier")  # exploded days, groups, literal rows

    def is_unique(self, name: str, keys: Sequence[str]) -> bool:
        """Whether no key of a table repeats; asked of the data once per instance, that is, per state of the files."""
        if name in self.UNIQUE_BY_CONSTRUCTION:
            return True
        proven = self.__dict__.setdefault("_unique", {})
        if (name, *keys) not in proven:
            counts = self.columns(name, *keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            proven[name, *keys] = counts.filter(F.col("n") > 1).isEmpty()
        return proven[name, *keys]

    # Edges of the line facts: child and its key, parent and its key, and what a parent row must have to count.
    EDGES = {
        "part": ("lineitem", "l_partkey", "part", "p_partkey", "p_brand is not null and p_type is not null", ("p_brand", "p_type")),
        "supplier": ("lineitem", "l_suppkey", "supplier", "s_suppkey", "plant_id is not null", ("s_nationkey",)),
        "orders": ("lineitem", "l_orderkey", "orders", "o_orderkey", "true", ()),
        "customer": ("orders", "o_custkey", "customer", "c_custkey", "true", ()),
    }

    def integrity(self) -> DataFrame:
        """One row per edge: child rows, those without a parent (``orphans``), with several (``multiplied``), and with one that
        lacks what the surfaces join on (``incomplete``).

        Children are counted per key and parents per key before they meet, so neither a hot key nor a repeated parent fans out."""
        out = None
        for edge, (child, ck, parent, pk, complete, cols) in self.EDGES.items():
            rows = self.read(parent, pk, *cols)
            if parent == "supplier":
                rows = rows.join(self._nation_region, F.col("s_nationkey") == F.col("n_nationkey"), "left").withColumn("plant_id", F.col("n_nationkey"))
            parents = rows.groupBy(pk).agg(F.count(F.lit(1)).alias("_copies"), F.count_if(F.expr(complete)).alias("_complete"))
            keys = self.read(child, ck).groupBy(ck).agg(F.count(F.lit(1)).alias("_n"))
            met = keys.join(parents, F.col(ck) == F.col(pk), "left")
            lost, several = F.col("_copies").isNull(), F.col("_copies") > 1
            total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0)).cast("long")
            report = met.agg(total(F.lit(True)).alias("child_rows"), total(lost).alias("orphans"), total(several).alias("multiplied"),
                             total(~lost & (F.col("_complete") < F.col("_copies"))).alias("incomplete"))
            report = report.select(F.lit(edge).alias("edge"), "child_rows", "orphans", "multiplied", "incomplete")
            out = report if out is None else out.unionByName(report)
        return out

    def prove(self) -> dict[str, bool]:
        """Check every edge once and remember which hold. From then on (while the files stay as they are) plans leave out the
        joins that would only confirm a parent; without a proof they keep them."""
        if "_proof" not in self.__dict__:
            self._proof = {r.edge: not (r.orphans or r.multiplied or r.incomplete) for r in self.integrity().collect()}
            for memo in ("_surfaces", "_unique"):
                self.__dict__.pop(memo, None)
        return self._proof

    def proven(self, *edges: str) -> bool:
        """Whether a proof was made and each of these edges held: every child has exactly one complete parent."""
        return all(self.__dict__.get("_proof", {}).get(e, False) for e in edges)

    # --- access by name ----------------------------------------------------------------
    ENTITIES = ("supplier", "part", "product", "plant", "customer", "carrier", "date_dim",
                "supplier_part", "product_part", "purchase_order_line", "supply_receipt",
                "inventory", "production", "quality", "order_line", "shipment")

    def table(self, name: str) -> DataFrame:
        if name not in self.ENTITIES:
            raise KeyError(f"unknown entity table {name!r}")
        return getattr(self, name)

    def columns(self, name: str, *cols: str) -> DataFrame:
        """Columns of an entity table; a fact is joined only with the parents these columns come from."""
        if name not in FROM_PARENTS:
            return self.table(name).select(*cols)
        needed = {parent: bool(got.intersection(cols)) for parent, got in FROM_PARENTS[name].items()}
        return getattr(self, f"_{name}")(**needed).select(*cols)

    def of_customers(self, name: str, cols: Sequence[str], attributes: Sequence[str]) -> DataFrame:
        """Columns of a fact's rows that have a customer, with attributes of the customer. Orders meet the customers first."""
        needed = {parent: bool(got.intersection(cols)) for parent, got in FROM_PARENTS[name].items()}
        customers = self.customer.select("customer_id", *attributes)
        return getattr(self, f"_{name}")(**needed, customers=customers).select(*cols, *attributes)


class FrameTables(Tables):
    """Entity tables supplied directly as DataFrames — a persisted raw layer read back, or a
    hand-built fixture. Only the given entities exist; the rest raise when used."""

    DERIVED = False
    UNIQUE_BY_CONSTRUCTION = ()

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame], watched_part=None):
        super().__init__(spark, "<frames>")
        for name, df in frames.items():
            if name not in self.ENTITIES:
                raise KeyError(f"unknown entity table {name!r}")
            self.__dict__[name] = conform(df, name)
        if watched_part is not None:
            self.__dict__["watched_part"] = watched_part if isinstance(watched_part, Column) \
                else F.lit(watched_part)
        if "date_dim" not in frames:
            self.__dict__.pop("date_dim", None)

    def columns(self, name: str, *cols: str) -> DataFrame:
        return self.table(name).select(*cols)

    def of_customers(self, name: str, cols: Sequence[str], attributes: Sequence[str]) -> DataFrame:
        return self.columns(name, *dict.fromkeys([*cols, "customer_id"])).join(self.customer.select("customer_id", *attributes), "customer_id").select(*cols, *attributes)

    def prove(self) -> dict[str, bool]:
        return {}  # given frames are joined as they are

    @property
    def promised_receipts(self) -> DataFrame:
        po = self.purchase_order_line.select("po_line_id", "po_id", "promised_receipt_date")
        return self.supply_receipt.join(po, "po_line_id").drop("plant_id")

    @property
    def latest_production(self) -> Column:
        return self.production.select(F.max("production_date")).scalar()

    @property
    def latest_snapshot(self) -> Column:
        return self.inventory.select(F.max("snapshot_date")).scalar()

    def with_product(self, df: DataFrame, *cols: str) -> DataFrame:
        return df.join(self.product.select("product_id", *cols), "product_id")

    def read(self, name: str, *cols: str) -> DataFrame:
        raise KeyError(f"FrameTables has no driver table {name!r}; supply the entity frames")
