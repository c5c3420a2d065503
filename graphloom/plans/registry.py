"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from graphloom.plans import change_queries, graph_queries, text_queries

QUERIES: dict = {**text_queries.QUERIES, **graph_queries.QUERIES, **change_queries.QUERIES}
ORACLES: dict = {**text_queries.ORACLES, **graph_queries.ORACLES, **change_queries.ORACLES}
FLAGSHIP = "bm25_topk"
