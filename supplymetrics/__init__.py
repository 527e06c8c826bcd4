"""supplymetrics — governed supply-chain analytics on Spark.

Layers:
  sources/    typed entity tables (schemas, driver-table adapters, read/write helpers)
  functions/  column expressions (ratios, percentages, flags, bands, calendar parts)
  operators/  reusable DataFrame operators (builders, grain-safe joins, two-level and
              semi-additive aggregates, data-quality primitives, ordering)
  plans/      curated surfaces, governed metrics, the semantic model, verified queries,
              dashboard aggregates and the data-quality job
"""

from supplymetrics.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
