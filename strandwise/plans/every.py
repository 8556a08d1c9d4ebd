"""All library queries and their SQL."""

from . import catalog_queries, format_queries, selection_queries, simulation_queries, table_queries

QUERIES, ORACLES = catalog_queries.QUERIES, catalog_queries.ORACLES

__all__ = ["ORACLES", "QUERIES", "catalog_queries", "format_queries", "selection_queries", "simulation_queries", "table_queries"]
