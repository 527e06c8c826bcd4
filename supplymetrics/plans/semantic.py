"""Governed semantic model: logical tables, relationships, metrics, synonyms and the
dims × metrics query operator (SEM1-SEM13, MET1-MET12, SA1).

``model.query(t, dimensions, metrics, where, order_by, limit)`` resolves names, checks the
grain rules before building anything, then composes one DataFrame plan:

    fact surface -> (left joins to the related dimension tables that are asked for)
                 -> filter -> groupBy(dims).agg(metrics) [two-stage for semi-additive]
                 -> order / limit
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplymetrics.functions import exprs as X
from supplymetrics.operators.relational import semi_additive
from supplymetrics.plans import surfaces as SUR
from supplymetrics.plans.vocabulary import DIMENSION_SYNONYMS, DIMENSIONS, FACTS, HIERARCHIES, TABLE_SYNONYMS
from supplymetrics.sources.adapters import Tables


class GrainError(ValueError):
    """A request that would aggregate across grains (fact-to-fact, bridge fan-out, summing a
    non-additive column)."""


class AmbiguousName(ValueError):
    """A name that resolves to more than one metric or dimension; qualify it as table.column."""


@dataclass(frozen=True)
class LogicalTable:
    name: str
    build: Callable[[Tables], DataFrame]
    primary_key: tuple[str, ...] | None
    fact: bool
    synonyms: tuple[str, ...] = ()
    non_additive: tuple[str, ...] = ()      # SEM11: shown or filtered, never aggregated
    semi_additive_by: str | None = None     # SEM9: never summed across this column
    columns: tuple[str, ...] = ()           # of a surface that can be built for the columns asked for

    def frame(self, t: Tables, asked: set[str] | None) -> DataFrame:
        """The table with at least the columns asked for (all, if that is not known)."""
        if asked is None or not self.columns:
            return self.build(t)
        return self.build(t, columns=tuple(c for c in self.columns if c in asked))


@dataclass(frozen=True)
class Relationship:
    name: str
    left: str
    left_cols: tuple[str, ...]
    right: str
    right_cols: tuple[str, ...]


@dataclass(frozen=True)
class Metric:
    name: str
    table: str
    expr: Callable[[], Column]
    uses: tuple[str, ...] = ()              # columns of its table that the expression reads
    non_additive_by: str | None = None
    synonyms: tuple[str, ...] = ()
    comment: str = ""


def _m(name, table, uses, expr, non_additive_by=None, synonyms=(), comment=""):
    return Metric(name, table, expr, tuple(uses.split()), non_additive_by, tuple(synonyms), comment)


# Metric synonyms of the modelled product ('OTIF rate' dropped: quantity-in-full
# is not tested by the metric).
METRICS: dict[str, Metric] = {m.name: m for m in [
    _m("fulfillment_rate", "customer_fulfillment", "fulfilled_quantity ordered_quantity",
       lambda: X.sum_ratio("fulfilled_quantity", "ordered_quantity"),
       synonyms=("fill rate", "order fill rate", "fulfillment percentage", "service level"),
       comment="Ratio of fulfilled to ordered quantity."),
    _m("order_lines_with_fulfillment_gaps", "customer_fulfillment", "fulfillment_gap_flag",
       lambda: F.count_if(F.col("fulfillment_gap_flag")),
       synonyms=("gap count", "unfulfilled order lines", "backorder count")),
    _m("on_time_delivery_rate", "shipment_performance", "on_time_flag delivery_eligible_flag",
       lambda: X.count_ratio(F.col("on_time_flag"), F.col("delivery_eligible_flag")),
       synonyms=("OTD rate", "on-time percentage", "delivery reliability"),
       comment="On-time over eligible (delivered) shipments."),
    _m("avg_delivery_delay_days", "shipment_performance", "delivery_delay_days delivery_eligible_flag",
       lambda: X.dround(X.avg_when("delivery_delay_days", F.col("delivery_eligible_flag")), X.RATIO_DIGITS),
       synonyms=("average delay", "mean delay days", "average lateness")),
    _m("production_attainment", "production_performance", "produced_quantity planned_quantity",
       lambda: X.sum_ratio("produced_quantity", "planned_quantity"),
       synonyms=("attainment rate", "plan achievement", "production yield", "schedule adherence")),
    _m("constrained_production_days", "production_performance", "constraint_flag",
       lambda: F.count_if(F.col("constraint_flag")),
       synonyms=("constraint count", "days constrained", "constrained days")),
    _m("exposed_production_days", "production_performance", "watched_part_exposure_flag",
       lambda: F.count_if(F.col("watched_part_exposure_flag")),
       synonyms=("exposure count", "dependent days")),
    _m("total_on_hand", "inventory_position", "on_hand_quantity", lambda: F.sum("on_hand_quantity"), "snapshot_date",
       synonyms=("total inventory on hand", "aggregate on hand", "total stock", "inventory on hand")),
    _m("total_available", "inventory_position", "available_quantity", lambda: F.sum("available_quantity"), "snapshot_date",
       synonyms=("total available stock", "aggregate available", "available inventory")),
    _m("parts_below_safety_stock", "inventory_position", "below_safety_stock_flag",
       lambda: F.count_if(F.col("below_safety_stock_flag")), "snapshot_date",
       synonyms=("understocked parts", "parts at risk", "safety stock breaches")),
    _m("defect_rate", "supplier_performance", "defective_quantity inspected_quantity",
       lambda: X.sum_ratio("defective_quantity", "inspected_quantity"),
       synonyms=("quality defect rate", "weighted defect rate", "inspection failure rate")),
    _m("rejection_rate", "supplier_performance", "rejected_quantity received_quantity",
       lambda: X.sum_ratio("rejected_quantity", "received_quantity"),
       synonyms=("weighted rejection rate", "material rejection rate")),
]}

# Precomputed ratios may be shown or filtered, never aggregated (SEM11).
_RATIOS = {
    "customer_fulfillment": ("fulfillment_pct",),
    "production_performance": ("production_attainment_pct",),
    "inventory_position": ("available_to_safety_stock_pct",),
    "supplier_performance": ("avg_receipt_delay_days", "on_time_receipt_pct", "defect_rate_pct"),
    "product_risk_signals": ("fulfillment_rate", "on_time_delivery_rate", "production_attainment"),
}


def _t(name, build, key, fact, semi_additive_by=None, columns=()):
    return LogicalTable(name, build, key, fact, TABLE_SYNONYMS[name], _RATIOS.get(name, ()), semi_additive_by, columns)


TABLES: dict[str, LogicalTable] = {t.name: t for t in [
    _t("customer_fulfillment", SUR.customer_fulfillment, ("order_line_id",), True, columns=SUR.FULFILLMENT),
    _t("shipment_performance", SUR.shipment_performance, ("shipment_id",), True, columns=SUR.SHIPMENT),
    _t("production_performance", SUR.production_performance, ("production_id",), True, columns=SUR.PRODUCTION),
    _t("inventory_position", SUR.inventory_position, ("inventory_snapshot_id",), True, "snapshot_date", SUR.INVENTORY),
    _t("supplier_performance", SUR.supplier_performance, None, True),
    _t("product_risk_signals", SUR.risk_signals, ("product_id",), True),
    _t("date_dim", lambda t: t.date_dim, ("calendar_date",), False),
    _t("plant", lambda t: t.plant, ("plant_id",), False),
    _t("product", lambda t: t.product, ("product_id",), False),
    _t("part", lambda t: t.part, ("part_id",), False),
    _t("carrier", lambda t: t.carrier, ("carrier_id",), False),
]}

RELATIONSHIPS: tuple[Relationship, ...] = (
    Relationship("fulfillment_to_date", "customer_fulfillment", ("order_date",), "date_dim", ("calendar_date",)),
    Relationship("fulfillment_to_plant", "customer_fulfillment", ("plant_id",), "plant", ("plant_id",)),
    Relationship("fulfillment_to_product", "customer_fulfillment", ("product_id",), "product", ("product_id",)),
    Relationship("shipment_to_carrier", "shipment_performance", ("carrier_id",), "carrier", ("carrier_id",)),
    Relationship("shipment_to_date", "shipment_performance", ("ship_date",), "date_dim", ("calendar_date",)),
    Relationship("shipment_to_plant", "shipment_performance", ("plant_id",), "plant", ("plant_id",)),
    Relationship("shipment_to_product", "shipment_performance", ("product_id",), "product", ("product_id",)),
    Relationship("production_to_date", "production_performance", ("production_date",), "date_dim", ("calendar_date",)),
    Relationship("production_to_plant", "production_performance", ("plant_id",), "plant", ("plant_id",)),
    Relationship("production_to_product", "production_performance", ("product_id",), "product", ("product_id",)),
    Relationship("inventory_to_date", "inventory_position", ("snapshot_date",), "date_dim", ("calendar_date",)),
    Relationship("inventory_to_part", "inventory_position", ("part_id",), "part", ("part_id",)),
    Relationship("inventory_to_plant", "inventory_position", ("plant_id",), "plant", ("plant_id",)),
    Relationship("supplier_to_part", "supplier_performance", ("part_id",), "part", ("part_id",)),
)

# Tables that exist in the raw layer but are deliberately outside the model (SEM10).
UNMODELLED = ("product_part", "supplier_part")


def column_names(spark: SparkSession, text: str) -> list[tuple[int, int, list[str]]]:
    """The column names of an SQL expression, as (first character, last character, parts), from the tree of Spark's parser."""
    found, todo = [], [spark._jsparkSession.sessionState().sqlParser().parseExpression(text)]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "UnresolvedAttribute":
            at, parts = node.origin(), node.nameParts()
            found.append((at.startIndex().get(), at.stopIndex().get(), [parts.apply(i) for i in range(parts.size())]))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sorted(found)


@dataclass
class SemanticModel:
    tables: dict[str, LogicalTable] = field(default_factory=lambda: dict(TABLES))
    relationships: tuple[Relationship, ...] = RELATIONSHIPS
    metrics: dict[str, Metric] = field(default_factory=lambda: dict(METRICS))
    facts: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(FACTS))
    dimensions: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(DIMENSIONS))
    dimension_synonyms: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(DIMENSION_SYNONYMS))

    # --- name resolution (SEM7, SEM13) ---------------------------------------------------
    @staticmethod
    def _says(key: str, name: str, synonyms: Sequence[str]) -> bool:
        return key == name or key in (s.lower() for s in synonyms)

    def resolve_metric(self, name: str) -> Metric:
        """The metric of a name, a synonym or either qualified by the metric's own table."""
        table, _, bare = name.lower().rpartition(".")
        hits = [m for m in self.metrics.values() if m.name == bare] or \
            [m for m in self.metrics.values() if self._says(bare, m.name, m.synonyms)]
        if table:
            wrong, hits = hits, [m for m in hits if m.table == table]
            if wrong and not hits:
                raise GrainError(f"{bare!r} is a metric of {wrong[0].table}, not of {table}")
        if len(hits) > 1:
            raise AmbiguousName(f"{name!r} names several metrics: {[m.name for m in hits]}")
        if not hits:
            raise KeyError(f"unknown metric {name!r}")
        return hits[0]

    def _columns(self, key: str, within: Sequence[str] | None, synonyms: dict) -> list[str]:
        """Qualified names whose name or synonym is ``key``, in the given tables."""
        table, _, bare = key.rpartition(".")
        return [q for q, syn in synonyms.items()
                if (not table or q.startswith(table + ".")) and self._says(bare, q.split(".")[1], syn)
                and (within is None or q.split(".")[0] in within)]

    def _fact_names(self, key: str, within: Sequence[str] | None = None) -> list[str]:
        return self._columns(key, within, self.facts)

    def resolve(self, name: str) -> tuple[str, str]:
        """('metric' | 'fact' | 'dimension' | 'table', name) of a name or synonym.

        A metric's own name is the metric; any other name with more than one meaning raises. Facts and
        qualified dimensions come back as table.column, bare dimension columns as they are."""
        key = name.lower()
        if key in self.metrics:
            return "metric", key
        if "." in key:
            metrics = [m.name for m in self.metrics.values() if key == f"{m.table}.{m.name}"]
            facts = self._fact_names(key)
            return ("metric", metrics[0]) if metrics else ("fact", facts[0]) if facts else ("dimension", key)
        found = [("metric", m.name) for m in self.metrics.values() if self._says(key, m.name, m.synonyms)]
        found += [("fact", q) for q in self._fact_names(key)]
        found += sorted({("dimension", q.split(".")[1]) for q in self._columns(key, None, self.dimension_synonyms)})
        found = found or [("table", t.name) for t in self.tables.values() if self._says(key, t.name, t.synonyms)]
        if len(found) > 1 and key not in {n for k, n in found if k == "dimension"}:
            raise AmbiguousName(f"{name!r} may be {', '.join(f'{k} {n}' for k, n in found)}; qualify it")
        return found[0] if found else ("dimension", key)

    # --- planning ------------------------------------------------------------------------
    def _related(self, fact: str) -> dict[str, Relationship]:
        return {r.right: r for r in self.relationships if r.left == fact}

    def _base_for(self, t: Tables, metrics: Sequence[Metric], dimensions: Sequence[str]) -> str:
        """The one table a request is about: that of its metrics, else that of its dimensions."""
        facts = {m.table for m in metrics}
        named = []
        for d in dimensions:
            table = d.lower().split(".")[0] if "." in d else None
            if table in UNMODELLED:
                raise GrainError(f"{table} is a many-to-many bridge outside the model (no BOM/sourcing fan-out)")
            if table is not None:
                if table not in self.tables:
                    raise GrainError(f"{table} is not a table of the model")
                named.append(table)
                if self.tables[table].fact:
                    facts.add(table)
        if not facts and not named and dimensions:
            owners = [{n for n, x in self.tables.items() if self._own(t, n, d)} for d in dimensions]
            common = set.intersection(*owners)
            if len(common) != 1:
                raise AmbiguousName(f"{list(dimensions)} are on {sorted(common) or 'no one table'}; qualify them")
            return common.pop()
        if len(facts) > 1:
            raise GrainError(f"metrics/dimensions span several facts {sorted(facts)}; "
                             "facts are never joined to each other — query each fact alone")
        if facts:
            return facts.pop()
        if len(set(named)) == 1:
            return named[0]
        raise GrainError("no common table: name a metric or qualify the dimensions with one fact")

    def _own(self, t: Tables, table: str, name: str) -> str | None:
        """The declared dimension or fact of a table that a bare name or synonym means, if any."""
        key = name.lower()
        if key in self.dimensions[table] or f"{table}.{key}" in self.facts or key in self.tables[table].non_additive:
            return key
        hits = self._columns(key, [table], self.dimension_synonyms) + self._fact_names(key, [table])
        if len(hits) > 1:
            raise AmbiguousName(f"{name!r} may be {hits}")
        return hits[0].split(".")[1] if hits else None

    def _locate(self, t: Tables, base: str, name: str) -> tuple[str, str]:
        """(table, column) of a dimension as seen from the base table."""
        related = self._related(base)
        table, _, bare = name.rpartition(".")
        table = table.lower()
        if table in UNMODELLED:
            raise GrainError(f"{table} is a many-to-many bridge outside the model (no BOM/sourcing fan-out)")
        if table and table != base and table not in related:
            raise GrainError(f"dimension {name!r} is not reachable from {base!r}")
        for tables in ([table],) if table else ([base], list(related)):
            hits = [(n, c) for n in tables if (c := self._own(t, n, bare))]
            if len(hits) > 1:
                raise AmbiguousName(f"{name!r} exists on {[n for n, _ in hits]}; qualify it")
            if hits:
                return hits[0]
        raise GrainError(f"dimension {name!r} is not reachable from {base!r}")

    def _filter(self, t: Tables, base: str, where: str, place, asked: set[str]) -> str:
        """A text filter with every name that is not a column of the base table replaced by the column it is placed in.
        The base table's columns that it reads are added to ``asked``.

        Which words are names is told by Spark's own parser: functions, keywords, typed literals, lambda variables and
        texts in either kind of quotes are none. A synonym of several words stands in backquotes."""
        own = {c.lower() for c in self.tables[base].build(t).columns}
        out, done = [], 0
        for start, stop, parts in column_names(t.spark, where):
            if len(parts) == 1 and parts[0].lower() in own:
                asked.add(parts[0].lower())
                continue
            try:
                column = place(*self._locate(t, base, ".".join(parts)))
            except GrainError:
                if len(parts) > 1:
                    raise
                continue  # left to Spark, which knows words such as current_date and reports the others
            out += [where[done:start], f"`{column}`"]
            done = stop + 1
        return "".join([*out, where[done:]])

    def levels(self, level: str) -> list[str]:
        """The dimensions of a level of a hierarchy (``quarter``, or ``calendar.quarter``), for ``query``."""
        name, _, key = level.lower().rpartition(".")
        found = [(table, cols) for h, (table, steps) in HIERARCHIES.items() for step, cols in steps if step == key and name in ("", h)]
        if len(found) != 1:
            raise KeyError(f"unknown level {level!r}") if not found else AmbiguousName(f"{level!r} is a level of several hierarchies")
        return [f"{found[0][0]}.{c}" for c in found[0][1]]

    def describe(self, t: Tables) -> DataFrame:
        """The model as rows: kind, table, name, data type, synonyms, hierarchies and the rule that governs an element."""
        rows = []
        for name, spec in self.tables.items():
            types = dict(spec.build(t).dtypes)
            rows.append(("table", name, name, None, list(spec.synonyms), [], f"one row per {', '.join(spec.primary_key)}" if spec.primary_key else None))
            for d in self.dimensions[name]:
                ups = [f"{h}.{step}" for h, (table, steps) in HIERARCHIES.items() if table == name for step, cols in steps if cols[-1] == d]
                rows.append(("dimension", name, d, types[d], list(self.dimension_synonyms.get(f"{name}.{d}", ())), ups,
                             "never aggregated" if d in spec.non_additive else None))
        for q, synonyms in self.facts.items():
            table, col = q.split(".")
            spec = self.tables[table]
            rule = "never aggregated" if col in spec.non_additive else f"never summed across {spec.semi_additive_by}" if spec.semi_additive_by else None
            rows.append(("fact", table, col, dict(spec.build(t).dtypes)[col], list(synonyms), [], rule))
        for m in self.metrics.values():
            rows.append(("metric", m.table, m.name, None, list(m.synonyms), [], f"never summed across {m.non_additive_by}" if m.non_additive_by else None))
        return t.spark.createDataFrame(rows, "kind string, table string, name string, data_type string, synonyms array<string>, "
                                             "hierarchies array<string>, rule string")

    def _check_unique(self, t: Tables, table: str) -> None:
        """Refuse a relationship whose right side repeats its key: the join would multiply the fact's rows (JN14)."""
        keys = self.tables[table].primary_key
        if not t.is_unique(table, keys):
            raise GrainError(f"{table} repeats its key {', '.join(keys)}: joining it would multiply rows of the fact")

    def query(self, t: Tables, dimensions: Sequence[str] = (), metrics: Sequence[str] = (),
              where: Column | str | None = None, order_by: Sequence[Column | str] | None = None,
              limit: int | None = None, aggregates: dict[str, tuple[str, str]] | None = None) -> DataFrame:
        """dims × metrics over one fact (SEM1); without metrics, the distinct dimension values.

        A text ``where`` is any SQL predicate over the dimensions reachable from the fact, selected or not, by name,
        qualified name or synonym (in backquotes if it has several words), and the fact's own columns; a Column filter
        sees the fact's columns and the selected ones. ``aggregates`` adds ad-hoc aggregates of declared facts {alias: (fn, fact
        name or synonym)}; non-additive columns are refused (SEM11) and semi-additive ones get the snapshot rule (SEM9)."""
        ms = [self.resolve_metric(m) for m in metrics]
        base = self._base_for(t, ms, [*dimensions, *(c for _, c in (aggregates or {}).values() if "." in c)])
        spec, related = self.tables[base], self._related(base)
        needed: dict[str, list[str]] = {}
        asked: set[str] | None = {c for m in ms for c in m.uses} | {m.non_additive_by for m in ms if m.non_additive_by}

        def place(table: str, col: str) -> str:
            if table == base:
                asked.add(col)
                return col
            asked.update(related[table].left_cols)
            if col not in needed.setdefault(table, []):
                needed[table].append(col)
            return f"{table}__{col}"

        located = list(dict.fromkeys(self._locate(t, base, d) for d in dimensions))  # a dimension named twice is one
        picked = [place(*x) for x in located]
        names = [c for _, c in located]
        names = [c if names.count(c) == 1 or tbl == base else f"{tbl}_{c}" for (tbl, c) in located]
        if isinstance(where, str):
            where = F.expr(self._filter(t, base, where, place, asked))
        elif where is not None:
            asked = None  # a Column may read anything
        sums = {}
        for alias, (fn, name) in (aggregates or {}).items():
            table, col = self._locate(t, base, name)
            if table != base:
                raise GrainError(f"{name!r} is no fact of {base}")
            if col in spec.non_additive:
                raise GrainError(f"{base}.{col} is a pre-computed ratio; it may be shown or "
                                 "filtered but not aggregated — use a governed metric")
            if f"{base}.{col}" not in self.facts:
                raise GrainError(f"{base}.{col} is no fact of the model, so it is not aggregated")
            sums[alias] = getattr(F, fn)(col)
            if asked is not None:
                asked.add(col)
        if aggregates and spec.semi_additive_by and asked is not None:
            asked.add(spec.semi_additive_by)
        df = spec.frame(t, asked)
        for table, cols in needed.items():
            rel = related[table]
            self._check_unique(t, table)
            dim = self.tables[table].build(t)
            dim = dim.select(*[F.col(rc).alias(f"{table}__key{i}") for i, rc in enumerate(rel.right_cols)],
                             *[F.col(c).alias(f"{table}__{c}") for c in cols])
            keys = [f"{table}__key{i}" for i in range(len(rel.right_cols))]
            df = df.join(dim, [df[lc] == dim[k] for lc, k in zip(rel.left_cols, keys)], "left").drop(*keys)
        if where is not None:
            df = df.filter(where)
        groups = [F.col(p).alias(n) for p, n in zip(picked, names)]
        agg_exprs: dict[str, Column] = {m.name: m.expr() for m in ms}
        agg_exprs |= sums
        semi = {m.non_additive_by for m in ms if m.non_additive_by}
        if aggregates and spec.semi_additive_by:
            semi.add(spec.semi_additive_by)
        if not agg_exprs:
            out = df.select(*groups).distinct()
        elif semi:
            if len(semi) > 1 or any(m.non_additive_by is None for m in ms):
                raise GrainError("cannot mix additive and semi-additive measures in one query")
            for p, n in zip(picked, names):
                df = df.withColumn(n, F.col(p))
            out = semi_additive(df, names, semi.pop(), agg_exprs)
        else:
            out = df.groupBy(*groups).agg(*[c.alias(n) for n, c in agg_exprs.items()])
        if order_by:
            out = out.orderBy(*order_by)
        if limit is not None:
            out = out.limit(limit)
        return out


MODEL = SemanticModel()

# The same model over gap-filled snapshots: a part that did not move in a month still has its balance in it.
DENSE_MODEL = SemanticModel(tables=TABLES | {
    "inventory_position": _t("inventory_position", lambda t, **asked: SUR.inventory_position(t, dense=True, **asked), ("inventory_snapshot_id",), True,
                             "snapshot_date", SUR.INVENTORY)})
