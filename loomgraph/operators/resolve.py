"""Joins that turn raw records into the unified property graph. Order decides between equals: `ord` everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S

REPO, FILE, NAME = "repo_url", "source_file", "function"


def first_function(functions: DataFrame) -> DataFrame:
    """The earliest function of each (repo, name): target of calls that match no function of their own file."""
    return functions.groupBy(REPO, F.col(NAME).alias("callee")).agg(F.min_by(FILE, F.struct("ord", FILE)).alias("repo_file"))


def resolve_calls(calls: DataFrame, functions: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """calls with caller_id, target_id and tier: same_file, else same_repo (earliest), else external; `carry` names columns that stay."""
    called = calls.withColumn("callee", S.call_name(F.col("raw_call")))
    own = functions.select(REPO, FILE, F.col(NAME).alias("callee")).distinct().withColumn("own", F.lit(True))
    out = called.join(own, [REPO, FILE, "callee"], "left").join(first_function(functions), [REPO, "callee"], "left")
    target = (
        F.when(F.col("own"), S.node_id("func", F.col(REPO), F.col(FILE), F.col("callee")))
        .when(F.col("repo_file").isNotNull(), S.node_id("func", F.col(REPO), F.col("repo_file"), F.col("callee")))
        .otherwise(S.node_id("external", F.col("callee")))
    )
    tier = F.when(F.col("own"), "same_file").when(F.col("repo_file").isNotNull(), "same_repo").otherwise("external")
    target_file = F.when(F.col("own"), F.col(FILE)).otherwise(F.col("repo_file"))
    return out.select(REPO, FILE, NAME, "callee", "ord", S.node_id("func", F.col(REPO), F.col(FILE), F.col(NAME)).alias("caller_id"), target.alias("target_id"), target_file.alias("target_file"), tier.alias("tier"), *carry)


def resolve_bases(classes: DataFrame) -> DataFrame:
    """INHERITS edges of classes(repo_url, source_file, class, bases, ord): the last class of a name in the repo wins."""
    last = classes.groupBy(REPO, F.col("class").alias("base")).agg(F.max_by(FILE, F.struct("ord", FILE)).alias("base_file"))
    bases = classes.select(REPO, FILE, "class", "ord", F.posexplode("bases").alias("pos", "raw")).withColumn("base", S.base_name(F.col("raw")))
    out = bases.join(last, [REPO, "base"], "left")
    target = F.when(F.col("base_file").isNotNull(), S.node_id("class", F.col(REPO), F.col("base_file"), F.col("base"))).otherwise(S.node_id("external", F.col("base")))
    return out.select(S.node_id("class", F.col(REPO), F.col(FILE), F.col("class")).alias("source"), target.alias("target"), F.lit("INHERITS").alias("type"), "ord", "pos")


def method_edges(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """HAS_METHOD edges: a class and the functions of its file named by its method signatures."""
    m = classes.select(REPO, FILE, "class", "ord", F.explode("methods").alias("sig")).withColumn(NAME, S.method_name(F.col("sig")))
    own = functions.select(REPO, FILE, NAME).distinct()
    return m.join(own, [REPO, FILE, NAME]).select(S.node_id("class", F.col(REPO), F.col(FILE), F.col("class")).alias("source"), S.node_id("func", F.col(REPO), F.col(FILE), F.col(NAME)).alias("target"), F.lit("HAS_METHOD").alias("type"), "ord")


def defines_edges(files: DataFrame, owned: DataFrame, kind: str, name: str) -> DataFrame:
    """DEFINES edges: files(repo_url, source_file) and what they own; owners that are no file give none."""
    f = files.select(REPO, FILE).distinct()
    return owned.join(f, [REPO, FILE]).select(S.node_id("file", F.col(REPO), F.col(FILE)).alias("source"), S.node_id(kind, F.col(REPO), F.col(FILE), F.col(name)).alias("target"), F.lit("DEFINES").alias("type"), "ord")


def data_flow_edges(flows: DataFrame, functions: DataFrame, with_variables: bool = False) -> DataFrame:
    """FLOWS_TO edges of flows(.., variable, passed_to, arg_position, ord) whose function exists; ASSIGNS with variables."""
    own = functions.select(REPO, FILE, NAME).distinct()
    live = flows.join(own, [REPO, FILE, NAME], "left_semi").withColumnRenamed("passed_to", "raw_call")
    merged = resolve_calls(live, functions, ("variable", "arg_position"))
    var = S.node_id("var", F.col(REPO), F.col(FILE), F.col(NAME), F.col("variable"))
    source = var if with_variables else F.col("caller_id")
    out = merged.select(source.alias("source"), F.col("target_id").alias("target"), F.lit("FLOWS_TO").alias("type"), "variable", "arg_position", "ord")
    if with_variables:
        out = out.unionByName(merged.select(F.col("caller_id").alias("source"), var.alias("target"), F.lit("ASSIGNS").alias("type"), "variable", F.lit(None).cast("int").alias("arg_position"), "ord"))
    return out


PARAM = "param:"


def variables(records: DataFrame, marked: bool = True) -> DataFrame:
    """records(.., items) with params and assigns: marked items are parameters, the others assigned names."""
    is_param = lambda x: x.startswith(PARAM)
    params = F.filter("items", is_param)
    if not marked:
        params = F.transform(params, lambda x: F.substring(x, len(PARAM) + 1, 1 << 30))
    return records.withColumns({"params": params, "assigns": F.filter("items", lambda x: ~is_param(x))}).drop("items")


def attach_variables(functions: DataFrame, variables: DataFrame) -> DataFrame:
    """functions with params and assigns of the latest record of their key."""
    last = variables.groupBy(REPO, FILE, NAME).agg(F.max_by(F.struct("params", "assigns"), "ord").alias("v"))
    return functions.join(last, [REPO, FILE, NAME], "left").select("*", F.col("v.params").alias("params"), F.col("v.assigns").alias("assigns")).drop("v")


#: Columns of the graph's nodes and edges; what a kind does not have is null.
NODE = "id string, type string, label string, repo_url string, filepath string, source_file string, language string, analysed boolean, params array<string>, assigns array<string>"
EDGE = "source string, target string, type string, raw string, variable string, arg_position int"


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    have = set(df.columns)
    cols = [c.split() for c in schema.split(", ")]
    return df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in cols])


def unified_graph(files: DataFrame, functions: DataFrame, calls: DataFrame, classes: DataFrame | None = None, flows: DataFrame | None = None, with_variables: bool = False, variables: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the typed multigraph with their attributes (NODE, EDGE); parallel edges stay.

    files: repo_url, source_file and, if known, language and analysed. Of nodes given twice one stays.
    """
    fns = functions if variables is None else attach_variables(functions, variables)
    file_id, own = S.node_id("file", F.col(REPO), F.col(FILE)), [F.col(REPO).alias("repo_url"), F.col(FILE).alias("source_file")]
    have = [c for c in ("language", "analysed") if c in files.columns]
    more = [c for c in ("language", "params", "assigns") if c in fns.columns]
    nodes = [
        files.select(file_id.alias("id"), F.lit("File").alias("type"), F.element_at(F.split(FILE, "/"), -1).alias("label"), F.col(REPO).alias("repo_url"), F.col(FILE).alias("filepath"), *have),
        fns.select(S.node_id("func", F.col(REPO), F.col(FILE), F.col(NAME)).alias("id"), F.lit("Function").alias("type"), F.col(NAME).alias("label"), *own, *more),
    ]
    hit = resolve_calls(calls, functions, ("raw_call",))
    edges = [
        defines_edges(files, functions, "func", NAME),
        hit.select(F.col("caller_id").alias("source"), F.col("target_id").alias("target"), F.lit("CALLS").alias("type"), F.col("raw_call").alias("raw")),
    ]
    if classes is not None:
        edges += [defines_edges(files, classes, "class", "class"), resolve_bases(classes), method_edges(classes, functions)]
        nodes.append(classes.select(S.node_id("class", F.col(REPO), F.col(FILE), F.col("class")).alias("id"), F.lit("Class").alias("type"), F.col("class").alias("label"), *own))
    if flows is not None:
        f = data_flow_edges(flows, functions, with_variables)
        edges.append(f)
        if with_variables:
            nodes.append(f.where("type = 'ASSIGNS'").select(F.col("target").alias("id"), F.lit("Variable").alias("type"), F.col("variable").alias("label"), F.split("target", "::")[1].alias("repo_url"), F.split("target", "::")[2].alias("source_file")))
    all_edges = None
    for e in edges:
        all_edges = _shaped(e, EDGE) if all_edges is None else all_edges.unionByName(_shaped(e, EDGE))
    ext = all_edges.where(F.col("target").startswith("external::")).select(F.col("target").alias("id"), F.lit("External").alias("type"), F.regexp_replace("target", "^external::", "").alias("label"))
    all_nodes = _shaped(ext, NODE)
    for n in nodes:
        all_nodes = all_nodes.unionByName(_shaped(n, NODE))
    cols = [c.split()[0] for c in NODE.split(", ")]
    one = all_nodes.groupBy("id").agg(F.min(F.struct(*cols[1:])).alias("n"))
    return one.select("id", *[F.col(f"n.{c}").alias(c) for c in cols[1:]]), all_edges


def file_projection(resolved: DataFrame, edge_type: str = "CALLS") -> DataFrame:
    """(file_u, file_v, n): calls between different files of a repository."""
    u, v = S.node_id("file", F.col(REPO), F.col(FILE)), S.node_id("file", F.col(REPO), F.col("target_file"))
    return resolved.where("target_file IS NOT NULL AND target_file <> source_file").groupBy(u.alias("file_u"), v.alias("file_v")).agg(F.count(F.lit(1)).alias("n"))


def replace_files(existing: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = (REPO, FILE)) -> DataFrame:
    """Incremental replace: rows of re-analysed files go, the fresh rows come."""
    return existing.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def dropped_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges with an end that is no node, and all edges."""
    ids = nodes.select("id").distinct().withColumn("there", F.lit(1))
    both = edges.join(ids.select(F.col("id").alias("source"), F.col("there").alias("s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.col("there").alias("t")), "target", "left")
    return both.agg(F.count_if(F.col("s").isNull() | F.col("t").isNull()).alias("dropped"), F.count(F.lit(1)).alias("total"))


def pair_types(edges: DataFrame, types: tuple[str, ...] = ("CALLS", "FLOWS_TO")) -> DataFrame:
    """(u, v, one count a type) of edges(u, v, type) between different owners."""
    return edges.where("u <> v").where(F.col("type").isin(*types)).groupBy("u", "v").pivot("type", list(types)).count().na.fill(0)


def first_seen(rows: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """The distinct values of each key in the order they are first seen."""
    once = rows.groupBy(*keys, value).agg(F.min(order).alias("_o"))
    listed = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_o"), F.col(value).alias("v")))).alias("_l"))
    return listed.select(*keys, F.transform("_l", lambda x: x["v"]).alias(name))
