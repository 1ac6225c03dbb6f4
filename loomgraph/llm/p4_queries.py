"""Queries of problem 4."""

from loomgraph.llm import syntax
from loomgraph.session import table


def p4_found(spark, d):
    return syntax.invalid(table(spark, d, "sources"))


def p4_rates(spark, d):
    return syntax.rates(table(spark, d, "sources"), table(spark, d, "file_index"))


QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates}
SQL: dict[str, str] = {}
