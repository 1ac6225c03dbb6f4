"""Queries of problem 10."""

from loomgraph.llm import language
from loomgraph.session import table


def p10_found(spark, d):
    return language.mislabelled(table(spark, d, "documents"))


def p10_segments(spark, d):
    return language.segments(table(spark, d, "documents"))


QUERIES = {"p10_found": p10_found, "p10_segments": p10_segments}
SQL: dict[str, str] = {}
