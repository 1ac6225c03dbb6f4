"""Queries of problem 5."""

from pyspark.sql import functions as F

from loomgraph.llm import handwritten
from loomgraph.session import table


def _in(spark, d):
    return table(spark, d, "predictions"), table(spark, d, "sources")


def p5_found(spark, d):
    return handwritten.marked(*_in(spark, d)).select("ord")


def p5_kinds(spark, d):
    """Rows by kind and by the evidence that tells it: the path, else a mark, the form, a lone file, a family or a cluster; n_clustered: those that a family or cluster tells as well."""
    m = handwritten.marked(*_in(spark, d))
    evidence = F.when(F.col("by_path").isNotNull(), "path").otherwise(F.col("evidence"))
    return m.groupBy(F.coalesce("by_path", "kind").alias("kind"), evidence.alias("evidence")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("clustered").alias("n_clustered"))


QUERIES = {"p5_found": p5_found, "p5_kinds": p5_kinds}
SQL: dict[str, str] = {}
