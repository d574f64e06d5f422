"""Spark-first analytics for observation tables, routes, grids and datasets."""
