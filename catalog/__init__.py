"""Registered queries and their check SQL, by family."""

from catalog import lines_diff, records_apply, scores, sources_tables

FAMILIES = (sources_tables, lines_diff, records_apply, scores)
QUERIES = {k: v for family in FAMILIES for k, v in family.QUERIES.items()}
ORACLES = {k: v for family in FAMILIES for k, v in family.ORACLES.items()}
