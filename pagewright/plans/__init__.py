"""Registered queries of the engine, and the SQL that they are held against."""

from __future__ import annotations

from pagewright.plans import layout_queries, region_queries, text_queries

QUERIES = {**layout_queries.QUERIES, **text_queries.QUERIES, **region_queries.QUERIES}
ORACLES = {**layout_queries.ORACLES, **text_queries.ORACLES, **region_queries.ORACLES}
