"""Queries of problem 2."""

from pyspark.sql import functions as F

from loomgraph.llm import split_overlap
from loomgraph.session import table


def p2_found(spark, d):
    pairs = split_overlap.row_pairs(table(spark, d, "examples"))
    return pairs.select(F.least("ord_e", "ord_t").alias("ord_a"), F.greatest("ord_e", "ord_t").alias("ord_b")).distinct()


def p2_report(spark, d):
    return split_overlap.report(table(spark, d, "examples"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL: dict[str, str] = {}
