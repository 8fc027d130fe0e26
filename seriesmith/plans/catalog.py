"""Registered queries over the shared test tables, with their DuckDB SQL."""

from __future__ import annotations

from . import catalogue, group_queries, kernel_queries, parts_queries, placement_queries, points, series, study_queries

_MODULES = (series, points, catalogue, parts_queries, study_queries, kernel_queries, placement_queries, group_queries)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
