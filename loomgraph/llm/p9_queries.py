"""Queries of problem 9."""

from loomgraph.llm import leakage
from loomgraph.session import table


def _in(spark, d):
    return table(spark, d, "documents"), table(spark, d, "eval_items")


def p9_found(spark, d):
    return leakage.find(*_in(spark, d)).select("doc_id", "item_id")


def p9_items(spark, d):
    return leakage.items_report(*_in(spark, d))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
SQL: dict[str, str] = {}
