"""Queries of problem 3."""

from loomgraph.llm import credentials
from loomgraph.session import table


def p3_found(spark, d):
    return credentials.found(table(spark, d, "examples"))


def p3_redacted(spark, d):
    return credentials.redacted(table(spark, d, "examples"))


QUERIES = {"p3_found": p3_found, "p3_redacted": p3_redacted}
SQL: dict[str, str] = {}
