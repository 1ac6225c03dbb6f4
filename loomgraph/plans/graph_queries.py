"""Queries over extracted records, imports, distances and pair scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import extract, graph, resolve, viewsets
from loomgraph.session import cut, table
from loomgraph.sources import views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _records(spark, d, *kinds):
    return extract.extract(table(spark, d, "sources"), kinds)


@query()
def call_view(spark, d):
    # read twice: calls, and the functions they may mean
    return viewsets.call_view(cut(_records(spark, d, "call_flow")))


@query()
def dependency_view(spark, d):
    return viewsets.dependency_view(cut(_records(spark, d, "call_flow")))


@query()
def data_flow_view(spark, d):
    return viewsets.data_flow_view(_records(spark, d, "data_flow"))


@query()
def class_view(spark, d):
    return viewsets.class_view(_records(spark, d, "class_bases", "class_attributes", "class_methods"))


@query()
def import_view(spark, d):
    return viewsets.import_view(_records(spark, d, "imports"))


@query()
def extracted_file_index(spark, d):
    """What the extraction says of the files: analysed or not, by language."""
    f = extract.file_index(table(spark, d, "sources"))
    return f.groupBy("language", "analysed").agg(F.count(F.lit(1)).alias("n"), F.count("reason").alias("n_reasons"))


@query()
def source_graph_counts(spark, d):
    """The unified graph of the real sources: extracted functions, calls, classes and data flow, resolved."""
    r = cut(_records(spark, d)).withColumn("ord", F.xxhash64("repo_url", "source_file", "seq"))
    t = {k: v for k, v in extract.tables(r).items()}
    calls = r.where("kind = 'call_flow'").select("repo_url", "source_file", F.col("name").alias("function"), "items", "ord")
    classes = t["class_diagram"].withColumn("ord", F.xxhash64("repo_url", "source_file", "class"))
    flows = r.where("kind = 'data_flow'").select("repo_url", "source_file", F.col("name").alias("function"), F.col("a").alias("variable"), F.col("b").alias("passed_to"), F.col("pos").alias("arg_position"), "ord")
    variables = t["variables_per_function"].withColumn("ord", F.lit(0))
    files = extract.file_index(table(spark, d, "sources")).select("repo_url", F.col("filepath").alias("source_file"), "language", "analysed")
    fns = calls.select("repo_url", "source_file", "function", "ord")
    nodes, edges = resolve.unified_graph(files, fns, calls.select("repo_url", "source_file", "function", F.explode("items").alias("raw_call"), "ord"), classes, flows, variables=variables)
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "type", "n").unionByName(edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), "type", "n"))


@query()
def import_edges(spark, d):
    return viewsets.import_edges(table(spark, d, "sources"))


@query()
def role_flows(spark, d):
    return viewsets.role_flows(viewsets.import_edges(table(spark, d, "sources")))


@query()
def distance_measures(spark, d):
    return graph.shortest_path_measures(views.edges(spark, d))


@query(
    "WITH RECURSIVE" + views.SQL
    + """, g AS (SELECT DISTINCT src, dst FROM v_edges WHERE src < 80 AND dst < 80 AND src <> dst), nd AS (SELECT src AS id FROM g UNION SELECT dst FROM g),
 r(s, t, d) AS (SELECT src, dst, 1 FROM g UNION SELECT r.s, g.dst, r.d + 1 FROM r JOIN g ON g.src = r.t WHERE r.d < 79),
 m AS (SELECT t AS id, count(*) AS r, sum(d) AS d FROM (SELECT s, t, min(d) AS d FROM r WHERE s <> t GROUP BY 1, 2) GROUP BY 1)
 SELECT nd.id, round(CASE WHEN m.d > 0 THEN m.r::DOUBLE / m.d * m.r / ((SELECT count(*) FROM nd) - 1) ELSE 0 END, 8) AS closeness FROM nd LEFT JOIN m USING (id)"""
)
def closeness_of_a_corner(spark, d):
    """Closeness in the graph of the first 80 nodes, small enough for all walks in SQL."""
    e = views.edges(spark, d).where("src < 80 AND dst < 80 AND src <> dst")
    return graph.shortest_path_measures(e).select("id", F.round("closeness", 8).alias("closeness"))


@query()
def topological_layers(spark, d):
    return graph.sequence_numbers(views.edges(spark, d))


@query(
    """WITH v AS (SELECT vec_id AS id, embedding AS x, label AS grp FROM embeddings), p AS (SELECT a.id AS src, b.id AS dst,
  list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i]::DOUBLE * b.x[i]::DOUBLE)) / sqrt(list_sum(list_transform(a.x, lambda t: t::DOUBLE * t::DOUBLE)) * list_sum(list_transform(b.x, lambda t: t::DOUBLE * t::DOUBLE))) AS c
  FROM v a JOIN v b ON a.grp = b.grp AND a.id <> b.id WHERE a.id % 50 = 0)
 SELECT src, dst, round(1 / (1 + exp(-c)), 6) AS p FROM p WHERE round(1 / (1 + exp(-c)), 6) >= 0.5 ORDER BY p DESC, src, dst LIMIT 1000"""
)
def scored_pairs(spark, d):
    """The stated query set of a search: sources whose id is divisible by 50, against all vectors of their group."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.col("label").alias("grp"))
    left = v.where("id % 50 = 0").select(F.col("id").alias("src"), "grp")
    pairs = left.join(v.select(F.col("id").alias("dst"), "grp"), "grp").where("src <> dst").select("src", "dst")
    return viewsets.score_pairs(pairs, v)


@query("SELECT p.ord, p.filepath, CASE WHEN len(all_labels) > 0 THEN all_labels[1].label END AS first_label, len(all_labels)::INT AS n_labels FROM predictions p")
def first_labels(spark, d):
    labs = F.col("all_labels")
    return table(spark, d, "predictions").select("ord", "filepath", F.when(F.size(labs) > 0, labs[0]["label"]).alias("first_label"), F.when(labs.isNotNull(), F.size(labs)).alias("n_labels"))
