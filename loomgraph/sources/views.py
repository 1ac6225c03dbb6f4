"""Code-shaped views over the test tables: functions, calls and edges of a synthetic code base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import table


def functions(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_linenumber = 1")
    return li.groupBy(
        F.concat(F.lit("r"), (F.col("l_suppkey") % 5).cast("string")).alias("repo_url"),
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("source_file"),
        F.concat(F.lit("fn"), (F.col("l_partkey") % 1500).cast("string")).alias("function"),
    ).agg(F.min("l_orderkey").alias("ord"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("r"), (F.col("l_suppkey") % 5).cast("string")).alias("repo_url"),
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("source_file"),
        F.concat(F.lit("fn"), (F.col("l_partkey") % 1500).cast("string")).alias("function"),
        F.concat(F.lit("obj.fn"), (F.col("l_orderkey") % 2000).cast("string"), F.lit("()")).alias("raw_call"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


def _kind():
    return F.when(F.col("l_returnflag") == "R", "CALLS").when(F.col("l_returnflag") == "A", "FLOWS_TO").otherwise("DEFINES")


def edges(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    n = F.broadcast(table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n")))  # one row
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(n)
    return joined.select(F.col("o_custkey").alias("src"), (F.col("l_partkey") % F.col("n")).alias("dst"), _kind().alias("type"), F.col("l_discount").alias("p"))


def edge_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(key, dst, type) and (key, src): joined by key they are edges()."""
    n = F.broadcast(table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n")))  # one row
    to = table(spark, d, "lineitem").join(n).select(F.col("l_orderkey").alias("key"), (F.col("l_partkey") % F.col("n")).alias("dst"), _kind().alias("type"))
    return to, table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("src"))


#: The same views in SQL, for the oracle.
SQL = """
v_functions AS (SELECT 'r'||(l_suppkey%5)::VARCHAR AS repo_url, 'f'||l_suppkey::VARCHAR AS source_file, 'fn'||(l_partkey%1500)::VARCHAR AS function, min(l_orderkey) AS ord
  FROM lineitem WHERE l_linenumber=1 GROUP BY 1,2,3),
v_calls AS (SELECT 'r'||(l_suppkey%5)::VARCHAR AS repo_url, 'f'||l_suppkey::VARCHAR AS source_file, 'fn'||(l_partkey%1500)::VARCHAR AS function,
  'obj.fn'||(l_orderkey%2000)::VARCHAR||'()' AS raw_call, l_orderkey*10+l_linenumber AS ord FROM lineitem),
v_edges AS (SELECT o_custkey AS src, l_partkey%(SELECT count(*) FROM customer) AS dst,
  CASE l_returnflag WHEN 'R' THEN 'CALLS' WHEN 'A' THEN 'FLOWS_TO' ELSE 'DEFINES' END AS type, l_discount AS p FROM lineitem JOIN orders ON l_orderkey=o_orderkey)
"""

#: Folders of the predicted edges' files; they reach every layer (fixed values of the view).
FOLDERS = ("api/v1", "db/store", "ui/components", "core/server", "misc/notes", "lib/text")
SUFFIXES = ("py", "sql", "jsx", "txt")


def _path(node):
    folder = F.element_at(F.array(*[F.lit(x) for x in FOLDERS]), (node % len(FOLDERS) + 1).cast("int"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in SUFFIXES]), (F.floor(node / len(FOLDERS)) % len(SUFFIXES) + 1).cast("int"))
    return F.concat(folder, F.lit("/f"), node.cast("string"), F.lit("."), suffix)


def predicted_edges(spark: SparkSession, d: str) -> DataFrame:
    """Predicted edges between synthetic files, one a pair of nodes."""
    e = edges(spark, d).where("src <> dst").select("src", "dst").distinct()
    calls, flows = (F.col("src") + F.col("dst")) % 100 / 100.0, (F.col("src") * 3 + F.col("dst")) % 100 / 100.0
    kept = F.filter(F.array(F.struct(F.lit("CALLS").alias("t"), calls.alias("p")), F.struct(F.lit("FLOWS_TO").alias("t"), flows.alias("p"))), lambda x: x["p"] >= 0.5)
    return e.select(
        _path(F.col("src")).alias("source_filepath"), _path(F.col("dst")).alias("target_filepath"), ((F.col("src") * 7 + F.col("dst")) % 1000 / 1000.0).alias("edge_exists_prob"),
        F.transform(kept, lambda x: x["t"]).alias("predicted_types"), F.create_map(F.lit("CALLS"), calls, F.lit("FLOWS_TO"), flows).alias("type_probs"),
    )


def flows(spark: SparkSession, d: str) -> DataFrame:
    """Variables passed to calls, beside functions and calls."""
    return calls(spark, d).select("repo_url", "source_file", "function", F.concat(F.lit("v"), (F.col("ord") % 10).cast("string")).alias("variable"), F.col("raw_call").alias("passed_to"), (F.col("ord") % 3).cast("int").alias("arg_position"), "ord")


def classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes with bases, attributes and methods that name functions of their file."""
    f = functions(spark, d).where("ord % 5 = 0")
    k = F.regexp_replace("function", "^fn", "")
    return f.select(
        "repo_url", "source_file", F.concat(F.lit("C"), k).alias("class"), F.array(F.concat(F.lit("m.C"), ((k.cast("bigint") * 7) % 1500).cast("string"))).alias("bases"),
        F.array(F.concat(F.lit("a"), k)).alias("attributes"), F.array(F.concat("function", F.lit("(self, x)")), F.lit("other()")).alias("methods"), "ord",
    )


_P = lambda n: f"([{', '.join(repr(x) for x in FOLDERS)}])[{n} % {len(FOLDERS)} + 1] || '/f' || {n}::VARCHAR || '.' || ([{', '.join(repr(x) for x in SUFFIXES)}])[({n} // {len(FOLDERS)}) % {len(SUFFIXES)} + 1]"
#: The further views in SQL; they follow SQL.
MORE_SQL = f""",
v_pred AS (SELECT {_P("src")} AS source_filepath, {_P("dst")} AS target_filepath, ((src * 7 + dst) % 1000) / 1000.0::DOUBLE AS edge_exists_prob,
  ((src + dst) % 100) / 100.0::DOUBLE AS p_calls, ((src * 3 + dst) % 100) / 100.0::DOUBLE AS p_flows FROM (SELECT DISTINCT src, dst FROM v_edges WHERE src <> dst)),
v_flows AS (SELECT repo_url, source_file, function, 'v' || (ord % 10)::VARCHAR AS variable, raw_call AS passed_to, (ord % 3)::INT AS arg_position, ord FROM v_calls),
v_classes AS (SELECT repo_url, source_file, 'C' || k AS class, 'm.C' || ((k::BIGINT * 7) % 1500)::VARCHAR AS base, 'a' || k AS attribute, function, ord
  FROM (SELECT *, substr(function, 3) AS k FROM v_functions WHERE ord % 5 = 0))
"""
