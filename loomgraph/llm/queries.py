"""The queries of this subpackage, by problem."""

import importlib

MODULES = ("p1_queries", "p2_queries", "p3_queries", "p4_queries", "p5_queries", "p7_queries", "p8_queries", "p9_queries", "p10_queries")
QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _m = importlib.import_module(f"loomgraph.llm.{_name}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
