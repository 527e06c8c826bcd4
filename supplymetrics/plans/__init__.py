"""Curated surfaces, governed metrics, semantic model, verified queries, dashboard, DQ job."""
