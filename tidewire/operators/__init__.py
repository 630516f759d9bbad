"""Joins, clustering, lifecycle, ranking and aggregation operators."""
