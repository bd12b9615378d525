"""The registry of named queries: ``QUERIES[name](spark, sf_dir)`` and the
DuckDB SQL that must return the same rows, ``ORACLES[name]``."""

from __future__ import annotations

from . import graph_queries, misc_queries, ml_queries, relational, stream_queries, surface_queries

QUERIES: dict = {}
ORACLES: dict = {}

for _m in (relational, graph_queries, ml_queries, stream_queries, misc_queries, surface_queries):
    QUERIES.update(_m.Q)
    ORACLES.update(_m.SQL)
