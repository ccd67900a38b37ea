"""Spark operators for tables of paired, line-oriented texts."""
