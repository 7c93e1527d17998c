"""Workflows and the catalog of queries with their SQL."""

from . import surface, surface_sql, temporal, temporal_sql  # noqa: F401  they add to the catalog
