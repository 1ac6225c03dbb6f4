"""Queries of serving, of the views over a record table, and of labels and candidates; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import roles
from loomgraph.functions import scalars as S
from loomgraph.operators import graph, resolve, rollups, serving, skew, splits, viewsets
from loomgraph.plans.core_queries import _CLASSIFIED, _BELOW, _LAYER, _OK, _RESOLVED, _SIMPLE, _classified, _edges, _s, V
from loomgraph.session import table
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


W = V + views.MORE_SQL
_TYPES = "list_filter(['CALLS', 'FLOWS_TO'], lambda t: CASE t WHEN 'CALLS' THEN p_calls ELSE p_flows END >= 0.5)"


# ---- serving -------------------------------------------------------------------------------------
@query(
    W
    + f""" SELECT 'total' AS section, 'totalEdges' AS name, count(*)::BIGINT AS value FROM v_pred UNION ALL SELECT 'total', 'totalFiles', count(*)::BIGINT FROM predictions
 UNION ALL SELECT 'total', 'avgConfidence', floor(sum(coalesce({_OK}, 0)) / count(*) * 100 + 0.5)::BIGINT FROM predictions
 UNION ALL SELECT 'label', CASE WHEN predicted_label <> '' THEN predicted_label ELSE 'other' END, count(*)::BIGINT FROM predictions GROUP BY 2
 UNION ALL SELECT 'type', t, count(*)::BIGINT FROM (SELECT unnest({_TYPES}) AS t FROM v_pred) GROUP BY 2"""
)
def api_report(spark, d):
    return serving.report(views.predicted_edges(spark, d), table(spark, d, "predictions"))


_LAYERED = W + f", l AS (SELECT path, {_LAYER} AS layer FROM (SELECT path, lower(path) AS p, '' AS lab FROM (SELECT source_filepath AS path FROM v_pred UNION SELECT target_filepath FROM v_pred)))"


def _layers(edges):
    return serving.endpoints(edges).withColumn("layer", S.layer(F.col("path"), F.lit(None).cast("string")))


@query(_LAYERED + " SELECT layer, count(*)::BIGINT AS n_files FROM l GROUP BY 1")
def files_per_layer(spark, d):
    return serving.files_per_layer(views.predicted_edges(spark, d), S.layer(F.col("path"), F.lit(None).cast("string")))


@query("SELECT CASE WHEN count(*) > 0 THEN count(*) ELSE 0 END::BIGINT AS n_files FROM predictions")
def file_total(spark, d):
    return serving.file_total(views.predicted_edges(spark, d), table(spark, d, "predictions"))


@query(W + " SELECT count(*)::BIGINT AS n_files FROM (SELECT source_filepath FROM v_pred UNION SELECT target_filepath FROM v_pred)")
def file_total_of_edges(spark, d):
    return serving.file_total(views.predicted_edges(spark, d), table(spark, d, "predictions").limit(0))


_DRILL = _LAYERED + """, i AS (SELECT source_filepath AS src, target_filepath AS dst, p_calls AS p FROM v_pred JOIN l a ON a.path = source_filepath JOIN l b ON b.path = target_filepath WHERE a.layer = 'api' AND b.layer = 'api' AND p_calls >= 0.5),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY p DESC, dst) AS rank FROM i) WHERE rank <= 2)"""


@query(_DRILL + " SELECT src, dst, p, rank::INT AS rank FROM k")
def layer_links(spark, d):
    e = views.predicted_edges(spark, d)
    return serving.layer_links(e, _layers(e), "api", "CALLS")


@query(_DRILL + " SELECT id, split_part(id, '/', -1) AS name, count(*)::BIGINT AS degree FROM (SELECT src AS id FROM k UNION ALL SELECT dst FROM k) GROUP BY 1, 2")
def layer_files(spark, d):
    return serving.layer_files(layer_links(spark, d))


@query(W + " SELECT source_filepath AS src, target_filepath AS dst, CASE WHEN p_calls >= 0.5 THEN p_calls END AS calls, p_flows AS secondary FROM v_pred WHERE p_calls >= 0.5")
def edge_weights(spark, d):
    e = serving.of_type(views.predicted_edges(spark, d), "CALLS")
    return e.select("src", "dst", F.col("p").alias("calls"), F.element_at(serving.secondary(F.col("type_probs"), "CALLS"), F.lit("FLOWS_TO")).alias("secondary"))


@query(
    _SIMPLE
    + """, dg AS (SELECT id, sum(i) AS i, sum(o) AS o FROM (SELECT src AS id, 0 AS i, 1 AS o FROM s UNION ALL SELECT dst, 1, 0 FROM s) GROUP BY 1),
 q AS (SELECT id, row_number() OVER (ORDER BY i, id) AS seq, CASE WHEN i = 0 THEN 'start' WHEN o = 0 THEN 'end' ELSE 'mid' END AS role FROM dg)
 SELECT id, seq::BIGINT AS seq, role, CASE role WHEN 'start' THEN '▶ ' WHEN 'end' THEN '■ ' ELSE '' END || '[' || seq::VARCHAR || '] ' || id::VARCHAR AS label,
  CASE role WHEN 'start' THEN 'limegreen' WHEN 'end' THEN 'tomato' ELSE 'orange' END AS colour FROM q"""
)
def drawn_nodes(spark, d):
    """Labels and colours of the nodes; the graph has cycles, so their numbers follow the in-degree."""
    e = _edges(spark, d)
    return serving.drawn_nodes(graph.degrees(e), graph.sequence_numbers(e))


_DAG = V + """, g AS (SELECT DISTINCT src, dst FROM v_edges WHERE src < dst AND dst - src <= 40 * (1 + src % 3) AND (src + dst) % 7 = 0),
 nd AS (SELECT src AS id FROM g UNION SELECT dst FROM g)"""


@query(
    "WITH RECURSIVE" + _DAG[4:]
    + """, r(id, l) AS (SELECT id, 0 FROM nd WHERE id NOT IN (SELECT dst FROM g) UNION SELECT g.dst, r.l + 1 FROM r JOIN g ON g.src = r.id),
 m AS (SELECT id, max(l) AS l FROM r GROUP BY 1) SELECT id, l::INT AS seq_layer, (row_number() OVER (ORDER BY l, id))::BIGINT AS seq FROM m"""
)
def acyclic_layers(spark, d):
    """Layers and numbers of an acyclic graph: only edges to a node somewhat further on."""
    ahead = _edges(spark, d).where("src < dst AND dst - src <= 40 * (1 + src % 3) AND (src + dst) % 7 = 0")
    return graph.sequence_numbers(ahead)


@query(f"SELECT ord, predicted_label, confidence FROM (SELECT ord, predicted_label, {_OK} AS confidence FROM predictions) WHERE confidence IS NOT NULL ORDER BY confidence DESC, ord LIMIT 100")
def surest_predictions(spark, d):
    p = table(spark, d, "predictions").select("ord", "predicted_label", skew.usable(F.col("confidence")).alias("confidence"))
    return p.where("confidence IS NOT NULL").orderBy(F.desc("confidence"), "ord").limit(100)


# ---- views over records --------------------------------------------------------------------------
def _call_records(spark, d):
    """The record table of the extraction, made of the shaped calls: one row a function with its calls in order."""
    c = views.calls(spark, d).groupBy("repo_url", "source_file", "function").agg(F.array_sort(F.collect_list(F.struct("ord", "raw_call"))).alias("c"))
    items = F.transform("c", lambda x: F.regexp_replace(x["raw_call"], r"\(\)$", ""))
    return c.select(F.lit("call_flow").alias("kind"), "repo_url", "source_file", F.col("function").alias("name"), items.alias("items"))


_OWN = ", own AS (SELECT DISTINCT repo_url, function FROM v_calls), cv AS (SELECT DISTINCT c.repo_url, c.function AS caller, replace(raw_call, '()', '') AS callee, CASE WHEN own.function IS NOT NULL THEN 'function' ELSE 'library' END AS kind FROM v_calls c LEFT JOIN own ON own.repo_url = c.repo_url AND own.function = replace(raw_call, '()', ''))"


@query(W + _OWN + " SELECT * FROM cv")
def shaped_call_view(spark, d):
    return viewsets.call_view(_call_records(spark, d))


@query(W + _OWN + " SELECT DISTINCT repo_url, caller, split_part(callee, '.', 1) AS module FROM cv WHERE kind <> 'function'")
def shaped_dependency_view(spark, d):
    return viewsets.dependency_view(_call_records(spark, d))


@query(
    W
    + """, p AS (SELECT repo_url, function AS source, function || '::' || variable AS target, 'owns' AS label, source_file, ord FROM v_flows
  UNION ALL SELECT repo_url, function || '::' || variable, passed_to, 'passed_as', source_file, ord FROM v_flows)
 SELECT repo_url, source, target, arg_min(label, ord) AS label FROM p GROUP BY 1, 2, 3"""
)
def shaped_data_flow_view(spark, d):
    r = views.flows(spark, d).select(F.lit("data_flow").alias("kind"), "repo_url", "source_file", F.col("function").alias("name"), F.col("variable").alias("a"), F.col("passed_to").alias("b"), F.col("arg_position").alias("pos"), F.col("ord").alias("seq"))
    return viewsets.data_flow_view(r)


@query(
    W
    + """ SELECT DISTINCT repo_url, class, base AS member, 'inherits' AS relation FROM v_classes UNION SELECT repo_url, class, attribute, 'has_attribute' FROM v_classes
 UNION SELECT repo_url, class, function || '(self, x)', 'has_method' FROM v_classes UNION SELECT repo_url, class, 'other()', 'has_method' FROM v_classes"""
)
def shaped_class_view(spark, d):
    parts = F.array(*[F.struct(F.lit(f"class_{k}").alias("kind"), F.col(k).alias("items")) for k in ("bases", "attributes", "methods")])
    r = views.classes(spark, d).select("repo_url", "source_file", F.col("class").alias("name"), F.explode(parts).alias("e")).select("repo_url", "source_file", "name", "e.*")
    return viewsets.class_view(r)


@query(W + " SELECT DISTINCT repo_url, source_file || '::' || function AS function, 'm' || (ord % 17)::VARCHAR AS module FROM v_calls")
def shaped_import_view(spark, d):
    c = views.calls(spark, d).groupBy("repo_url", "source_file", "function").agg(F.collect_set(F.concat(F.lit("m"), (F.col("ord") % 17).cast("string"))).alias("items"))
    return viewsets.import_view(c.select(F.lit("imports").alias("kind"), "repo_url", "source_file", F.col("function").alias("name"), "items"))


# ---- the unified graph with classes and flows ----------------------------------------------------
_CLASS_EDGES = _RESOLVED.replace(V, W) + """, fn AS (SELECT DISTINCT repo_url, source_file, function FROM v_functions),
 last_ AS (SELECT repo_url, class AS base, arg_max(source_file, (ord, source_file)) AS base_file FROM v_classes GROUP BY 1, 2),
 inh AS (SELECT CASE WHEN base_file IS NOT NULL THEN 'class::' || c.repo_url || '::' || base_file || '::' || l.base ELSE 'external::' || split_part(c.base, '.', -1) END AS target, 'class::' || c.repo_url || '::' || c.source_file || '::' || class AS source
   FROM v_classes c LEFT JOIN last_ l ON l.repo_url = c.repo_url AND l.base = split_part(c.base, '.', -1)),
 met AS (SELECT c.* FROM v_classes c JOIN fn USING (repo_url, source_file, function)),
 fl AS (SELECT f.* FROM v_flows f JOIN fn USING (repo_url, source_file, function))"""


@query(_CLASS_EDGES + " SELECT source, target, 'INHERITS' AS type, count(*)::BIGINT AS n FROM inh GROUP BY 1, 2")
def inheritance(spark, d):
    return resolve.resolve_bases(views.classes(spark, d)).groupBy("source", "target", "type").agg(F.count(F.lit(1)).alias("n"))


@query(_CLASS_EDGES + " SELECT 'class::' || repo_url || '::' || source_file || '::' || class AS source, 'func::' || repo_url || '::' || source_file || '::' || function AS target, count(*)::BIGINT AS n FROM met GROUP BY 1, 2")
def class_methods(spark, d):
    return resolve.method_edges(views.classes(spark, d), views.functions(spark, d)).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query(
    _CLASS_EDGES
    + """ SELECT type, count(*)::BIGINT AS n FROM (SELECT 'DEFINES' AS type FROM v_functions UNION ALL SELECT 'DEFINES' FROM v_classes JOIN (SELECT DISTINCT repo_url, source_file FROM v_functions) USING (repo_url, source_file) UNION ALL SELECT 'CALLS' FROM r
 UNION ALL SELECT 'INHERITS' FROM inh UNION ALL SELECT 'HAS_METHOD' FROM met UNION ALL SELECT 'FLOWS_TO' FROM fl UNION ALL SELECT 'ASSIGNS' FROM fl) GROUP BY 1"""
)
def unified_edges(spark, d):
    """All edge types of the unified graph, data flow and variables included."""
    f = views.functions(spark, d)
    _, edges = resolve.unified_graph(f.select("repo_url", "source_file").distinct(), f, views.calls(spark, d), views.classes(spark, d), views.flows(spark, d), with_variables=True)
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    _CLASS_EDGES
    + """ SELECT repo_url, variable, arg_position, count(*)::BIGINT AS n FROM fl GROUP BY 1, 2, 3"""
)
def flow_attributes(spark, d):
    """FLOWS_TO edges keep the variable and the argument's position."""
    e = resolve.data_flow_edges(views.flows(spark, d), views.functions(spark, d))
    return e.groupBy(F.split("source", "::")[1].alias("repo_url"), "variable", "arg_position").agg(F.count(F.lit(1)).alias("n"))


@query(
    W
    + """, last_ AS (SELECT repo_url, source_file, function, arg_max(ord, ord) AS o FROM v_flows GROUP BY 1, 2, 3)
 SELECT f.repo_url, f.source_file, f.function, 'param:v' || (o % 10)::VARCHAR AS params, 'v' || (o % 10)::VARCHAR AS assigns FROM v_functions f LEFT JOIN last_ USING (repo_url, source_file, function)"""
)
def function_variables(spark, d):
    """Functions with the parameters and assignments of their latest variable record, which comes as one marked list."""
    v = views.flows(spark, d).select("repo_url", "source_file", "function", F.array(F.concat(F.lit("param:"), "variable"), F.col("variable")).alias("items"), "ord")
    out = resolve.attach_variables(views.functions(spark, d), resolve.variables(v, marked=True))
    return out.select("repo_url", "source_file", "function", F.array_join("params", ",").alias("params"), F.array_join("assigns", ",").alias("assigns"))


@query(_SIMPLE + " SELECT e.src, e.dst, count(*)::BIGINT AS n FROM v_edges e WHERE e.src % 3 > 0 AND e.dst % 3 > 0 GROUP BY 1, 2")
def valid_edges(spark, d):
    """Edges whose ends are both nodes; a third of the ids are none."""
    e = _edges(spark, d).select(F.col("src").alias("source"), F.col("dst").alias("target"))
    nodes = e.select(F.explode(F.array("source", "target")).alias("id")).distinct().where("id % 3 > 0")
    return resolve.valid_edges(e, nodes).groupBy(F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


@query(_SIMPLE + " SELECT (count(*) FILTER (NOT (src % 3 > 0 AND dst % 3 > 0)))::BIGINT AS dropped, count(*)::BIGINT AS total FROM v_edges")
def dropped_edges(spark, d):
    e = _edges(spark, d).select(F.col("src").alias("source"), F.col("dst").alias("target"))
    nodes = e.select(F.explode(F.array("source", "target")).alias("id")).distinct().where("id % 3 > 0")
    return resolve.dropped_edges(e, nodes)


@query(V + ", f AS (SELECT src % 50 AS u, dst % 50 AS v, type FROM v_edges WHERE src % 50 <> dst % 50) SELECT u, v, (count(*) FILTER (type = 'CALLS'))::BIGINT AS CALLS, (count(*) FILTER (type = 'FLOWS_TO'))::BIGINT AS FLOWS_TO FROM f WHERE type IN ('CALLS', 'FLOWS_TO') GROUP BY 1, 2")
def file_pair_types(spark, d):
    """Edges between owners by type; here a node's owner is its id modulo 50."""
    e = _edges(spark, d).select((F.col("src") % 50).alias("u"), (F.col("dst") % 50).alias("v"), "type")
    return resolve.pair_types(e, ("CALLS", "FLOWS_TO"))


@query(_RESOLVED + " SELECT repo_url, source_file, function, list(callee ORDER BY o) AS callees FROM (SELECT repo_url, source_file, function, callee, min(ord) AS o FROM r GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3")
def first_seen_callees(spark, d):
    c = resolve.resolve_calls(views.calls(spark, d), views.functions(spark, d))
    return resolve.first_seen(c, ["repo_url", "source_file", "function"], "callee", "ord", "callees")


# ---- labels, splits, candidates ------------------------------------------------------------------
@query(
    f"""WITH f AS (SELECT * FROM (SELECT repo_url, filepath, predicted_label, {_OK} AS c, row_number() OVER (PARTITION BY repo_url, filepath ORDER BY ord) AS r FROM predictions WHERE repo_url IS NOT NULL AND filepath IS NOT NULL) WHERE r = 1)
 SELECT s.ord, CASE WHEN c >= 0.3 THEN predicted_label END AS node_label FROM sources s LEFT JOIN f ON f.repo_url = s.repo_url AND f.filepath = s.filepath"""
)
def labelled_files(spark, d):
    return serving.labelled_nodes(table(spark, d, "sources"), table(spark, d, "predictions")).select("ord", "node_label")


@query("SELECT ord FROM (SELECT ord, row_number() OVER (ORDER BY md5('42|' || ord::VARCHAR), ord) AS r, count(*) OVER () AS n FROM examples) WHERE r <= floor(n * 0.6)")
def train_subsample(spark, d):
    return serving.ranked_subsample(table(spark, d, "examples").select("ord"), "ord")


@query("SELECT s.split, m.label, count(e.ord)::BIGINT AS n FROM (SELECT DISTINCT split FROM examples WHERE split IS NOT NULL) s CROSS JOIN label_meta m LEFT JOIN examples e ON e.split = s.split AND e.label = m.label GROUP BY 1, 2")
def label_support(spark, d):
    """Rows of every label in every split; labels without any show as 0."""
    ex = table(spark, d, "examples")
    return splits.support(ex, "split", "label", table(spark, d, "label_meta").select("label"))


_METHOD = (
    _CLASSIFIED
    + f", z AS (SELECT predicted_label AS l, {_BELOW} AS f, c FROM cl) SELECT method, count(*)::BIGINT AS n FROM (SELECT CASE WHEN l IN ({', '.join(_s(x) for x in roles.RENAMED)}) THEN 'direct_rename' WHEN l <> 'core_logic' THEN 'unknown_label_passthrough' WHEN "
    + " OR ".join(f"regexp_matches(f, {_s(r)}, 'i')" for _, r in roles.PATH_RULES) + " THEN 'path' WHEN "
    + " OR ".join(f"regexp_matches(c, {_s(r)}, 'i')" for _, r in roles.CONTENT_RULES) + " THEN 'content' ELSE 'fallback_default' END AS method FROM z) GROUP BY 1"
)


@query(_METHOD)
def remap_methods(spark, d):
    c = _classified(spark, d)
    return c.groupBy(roles.remap(F.col("predicted_label"), F.col("filepath"), F.col("code"))["method"].alias("method")).agg(F.count(F.lit(1)).alias("n"))


@query(
    _SIMPLE
    + """, t AS (SELECT src, dst, array_to_string(list_sort(list(DISTINCT type)), '+') AS types FROM v_edges GROUP BY 1, 2), n AS (SELECT types, count(*) AS n FROM t GROUP BY 1),
 k AS (SELECT types, n, CASE WHEN n <= 2 THEN n ELSE greatest(1, round_even(n * 0.7, 0)) END::BIGINT AS a FROM n), m AS (SELECT *, CASE WHEN n > 2 THEN least(n - a, greatest(1, round_even(n * 0.15, 0))) ELSE 0 END::BIGINT AS b FROM k)
 SELECT types, split, c FROM (SELECT types, 'train' AS split, a AS c FROM m UNION ALL SELECT types, 'val', b FROM m UNION ALL SELECT types, 'test', n - a - b FROM m) WHERE c > 0"""
)
def type_set_split_sizes(spark, d):
    """The stratified split with the set of edge types of a pair as stratum."""
    t = _edges(spark, d).groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("type")), "+").alias("types")).withColumn("pair", F.concat_ws(">", "src", "dst"))
    return splits.stratified(t, "types", "pair").groupBy("types", "split").agg(F.count(F.lit(1)).alias("c"))


_GROUPS = _SIMPLE + ", m AS (SELECT c_custkey AS id, c_nationkey * 10 + c_custkey % 10 AS grp FROM customer), a AS (SELECT x.id AS src, y.id AS dst FROM m x JOIN m y ON x.grp = y.grp AND x.id <> y.id)"


def _groups(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") * 10 + F.col("c_custkey") % 10).alias("grp"))


@query(_GROUPS + " SELECT src % 10 AS digit, count(*)::BIGINT AS n, sum(dst)::BIGINT AS check_sum FROM a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.src = a.src AND s.dst = a.dst) GROUP BY 1")
def new_candidates(spark, d):
    c = graph.candidate_pairs(_groups(spark, d), _edges(spark, d), "new")
    return c.groupBy((F.col("src") % 10).alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.sum("dst").alias("check_sum"))


@query(_GROUPS + " SELECT src, dst FROM a ORDER BY md5('cap|' || src::VARCHAR || '>' || dst::VARCHAR), src, dst LIMIT 500")
def capped_candidates(spark, d):
    """All pairs of a group, at most 500 of them by hash: the sampling feature."""
    return graph.capped_candidates(_groups(spark, d), _edges(spark, d), 500, "all")


@query(_SIMPLE + " SELECT src, dst FROM s WHERE src <> dst")
def existing_candidates(spark, d):
    return graph.candidate_pairs(_groups(spark, d), _edges(spark, d), "existing")


@query("SELECT 5000::BIGINT AS n, 0::BIGINT AS n_edges, 0::BIGINT AS n_loops, 5000::BIGINT AS n_distinct")
def negative_pairs_check(spark, d):
    """Counts over the negative pairs: as many as asked for, none of them an edge or a loop, none twice."""
    e = _edges(spark, d)
    n = graph.negatives(e, 5_000)
    marked = n.join(graph.simple(e).withColumn("e", F.lit(1)), ["src", "dst"], "left")
    return marked.agg(F.count(F.lit(1)).alias("n"), F.count("e").alias("n_edges"), F.count_if(F.col("src") == F.col("dst")).alias("n_loops"), F.countDistinct("src", "dst").alias("n_distinct"))


# ---- scalars -------------------------------------------------------------------------------------
_EXT_KEY = r"lower(regexp_extract(filepath, '[^/](\.[^./]*)$', 1))"


@query(f"SELECT grammar, count(*)::BIGINT AS n FROM (SELECT CASE {_EXT_KEY} " + " ".join(f"WHEN {_s(k)} THEN {_s(v[0])}" for k, v in S.GRAMMAR_OF.items()) + " END AS grammar FROM sources) GROUP BY 1")
def grammars(spark, d):
    return table(spark, d, "sources").groupBy(S.grammar(F.col("filepath")).alias("grammar")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT ord, filepath || chr(10) || code[1:2000] AS text FROM sources WHERE code IS NOT NULL")
def composed_texts(spark, d):
    return table(spark, d, "sources").where("code IS NOT NULL").select("ord", S.compose_text(F.col("filepath"), F.col("code"), 2000).alias("text"))


_ROLE = "CASE WHEN contains(p, '/components/') OR contains(p, '/pages/') OR suffix(p, '.jsx') OR suffix(p, '.tsx') OR contains(p, '/hooks/') THEN 'FRONTEND' WHEN contains(p, '/api/') OR contains(p, 'endpoint') OR contains(p, '/server/') THEN 'API' WHEN contains(p, '/db/') OR contains(p, 'database') OR contains(p, 'schema') THEN 'DB' ELSE 'OTHER' END"


@query(f"SELECT role, count(*)::BIGINT AS n FROM (SELECT {_ROLE} AS role FROM (SELECT lower(filepath) AS p FROM sources)) GROUP BY 1")
def path_roles(spark, d):
    return table(spark, d, "sources").groupBy(S.role_of(F.col("filepath")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query(W + f", ro AS (SELECT path, {_ROLE} AS role FROM (SELECT path, lower(path) AS p FROM (SELECT source_filepath AS path FROM v_pred UNION SELECT target_filepath FROM v_pred))) SELECT a.role || '_TO_' || b.role AS flow, count(*)::BIGINT AS n FROM v_pred JOIN ro a ON a.path = source_filepath JOIN ro b ON b.path = target_filepath GROUP BY 1")
def predicted_role_flows(spark, d):
    return viewsets.role_flows(views.predicted_edges(spark, d).select(F.col("source_filepath").alias("source"), F.col("target_filepath").alias("target")))


@query("SELECT ord, list_transform([confidence, 1 - confidence, 0.5], lambda x: round(exp(x) / (exp(confidence) + exp(1 - confidence) + exp(0.5)), 6)) AS p FROM predictions WHERE confidence BETWEEN 0 AND 1")
def softmax_scores(spark, d):
    p = table(spark, d, "predictions").where("confidence BETWEEN 0 AND 1")
    xs = F.array(F.col("confidence"), 1 - F.col("confidence"), F.lit(0.5))
    return p.select("ord", F.transform(S.softmax(xs), lambda x: F.round(x, 6)).alias("p"))


@query("SELECT DISTINCT repo_url, regexp_replace(regexp_replace(split_part(repo_url, '/', -1), '\\.json$', ''), '^unified_graph_([0-9a-f]+)$', '\\1') AS repo_id FROM (SELECT repo_url FROM predictions WHERE repo_url IS NOT NULL UNION SELECT 'x/unified_graph_' || md5(repo_url) || '.json' FROM predictions WHERE repo_url IS NOT NULL)")
def repo_ids(spark, d):
    u = table(spark, d, "predictions").where("repo_url IS NOT NULL").select("repo_url").distinct()
    both = u.unionByName(u.select(F.concat(F.lit("x/unified_graph_"), F.md5("repo_url"), F.lit(".json")).alias("repo_url"))).distinct()
    return both.select("repo_url", S.repo_id(F.col("repo_url")).alias("repo_id"))
