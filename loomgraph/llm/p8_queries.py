"""Queries of problem 8."""

from loomgraph.llm import bpe
from loomgraph.session import table


def p8_ids(spark, d):
    return bpe.encode_column(table(spark, d, "documents"))


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
