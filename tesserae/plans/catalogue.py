"""Registered queries of the object-map operators and their DuckDB oracles, gathered from the modules of this package."""

from __future__ import annotations

from tesserae.plans import graph_queries, mask_queries, object_queries, scene_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (scene_queries, mask_queries, graph_queries, object_queries):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
