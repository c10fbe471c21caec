"""Composite spatial indices on Spark: sources, scalar functions, operators and composed plans."""
