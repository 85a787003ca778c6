"""Joins, aggregations and models over sequence tables."""
