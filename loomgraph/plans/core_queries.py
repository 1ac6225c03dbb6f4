"""Queries of the code graph, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import roles
from loomgraph.functions import scalars as S
from loomgraph.operators import extract, graph, resolve, rollups, skew, splits
from loomgraph.session import table
from loomgraph.sources import views
from loomgraph.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


V = "WITH " + views.SQL
_LANG = "CASE ext " + " ".join(f"WHEN {_s(k)} THEN {_s(v)}" for k, v in S.LANGUAGE_OF.items()) + " WHEN '' THEN 'Unknown' ELSE 'Unknown (' || ext || ')' END"
_EXT = r"lower(regexp_extract(filepath, '[^/](\.[^./]*)$', 1))"
_OK = "CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END"


# ---- scalars over files and addresses ------------------------------------------------------------
@query(f"SELECT language, detected, count(*)::BIGINT AS n FROM (SELECT language, {_LANG} AS detected FROM (SELECT language, {_EXT} AS ext FROM sources)) GROUP BY 1, 2")
def language_detect(spark, d):
    return table(spark, d, "sources").groupBy("language", S.detect_language(F.col("filepath")).alias("detected")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""SELECT DISTINCT repo_url, name, CASE WHEN slug = '' THEN 'repo' ELSE slug END AS slug, regexp_matches(repo_url, '^https?://') OR repo_url LIKE '%.git' AS is_url FROM (
 SELECT repo_url, name, regexp_replace(regexp_replace(name, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM (
 SELECT repo_url, regexp_replace(split_part(regexp_replace(repo_url, '/+$', ''), '/', -1), '\.git$', '') AS name FROM predictions WHERE repo_url IS NOT NULL))"""
)
def repo_names(spark, d):
    u = F.col("repo_url")
    return table(spark, d, "predictions").where("repo_url IS NOT NULL").select("repo_url", S.repo_name(u).alias("name"), S.repo_slug(u).alias("slug"), S.is_repo_url(u).alias("is_url")).distinct()


@query("SELECT 'file::' || repo_url || '::' || filepath AS id, ord FROM sources")
def file_node_ids(spark, d):
    return table(spark, d, "sources").select(S.node_id("file", F.col("repo_url"), F.col("filepath")).alias("id"), "ord")


def _mod(expr: str, m: int) -> str:
    return f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split(md5({expr}), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT)), lambda a, x: (a * 16 + x) % {m})"


@query(
    rf"""SELECT ord, (len(string_split(filepath, '/')) - 1)::INT AS depth, CASE WHEN filepath LIKE '%/%' THEN 0.0 ELSE 1.0 END::DOUBLE AS is_root,
  round({_mod("regexp_replace(regexp_extract(filepath, '^(.*/)[^/]*$', 1), '/$', '')", 997)} / 997.0::DOUBLE, 6) AS parent_hash, round({_mod(f"ltrim({_EXT}, '.')", 101)} / 101.0::DOUBLE, 6) AS ext_hash FROM sources"""
)
def path_features(spark, d):
    return table(spark, d, "sources").select("ord", *S.path_features(F.col("filepath")))


@query(
    "SELECT ord, " + ", ".join(f"(CASE WHEN lang = {_s(v)} THEN 1 ELSE 0 END)::DOUBLE AS l{i}" for i, v in enumerate(S.FEATURE_LANGUAGES))
    + " FROM (SELECT ord, CASE WHEN language IN (" + ",".join(_s(x) for x in S.FEATURE_LANGUAGES) + ") THEN language ELSE 'OTHER' END AS lang FROM sources)"
)
def language_one_hot(spark, d):
    v = S.one_hot(F.col("language"), S.FEATURE_LANGUAGES)
    return table(spark, d, "sources").select("ord", v.alias("v")).select("ord", *[F.col("v")[i].alias(f"l{i}") for i in range(len(S.FEATURE_LANGUAGES))])


@query(
    r"""WITH t AS (SELECT ord, unnest(list_filter(regexp_split_to_array(lower(filepath), '[/_.\s]+'), lambda x: x <> '')) AS tok FROM sources),
 h AS (SELECT ord, (strpos('0123456789abcdef', substr(md5(tok), 31, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(md5(tok), 32, 1)) - 1 AS v FROM t),
 s AS (SELECT ord, v % 32 AS i, sum(CASE WHEN (v // 32) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS x FROM h GROUP BY 1, 2),
 n AS (SELECT ord, sqrt(sum(x * x)) AS norm FROM s GROUP BY 1)
 SELECT ord, i::INT AS i, round((x / norm)::DOUBLE, 6) AS x FROM s JOIN n USING (ord) WHERE x <> 0"""
)
def text_embedding(spark, d):
    return S.hash_embed(table(spark, d, "sources"), "ord", "filepath").select("ord", "i", F.round("x", 6).alias("x"))


@query("SELECT filepath, ord, CASE WHEN len(p) > 2 THEN array_to_string(p[1:3], '/') ELSE filepath END AS grp, CASE WHEN len(p) > 2 THEN array_to_string(p[1:2], '/') WHEN len(p) = 2 THEN p[1] ELSE filepath END AS module FROM (SELECT filepath, ord, string_split(filepath, '/') AS p FROM sources)")
def path_groups(spark, d):
    p = F.col("filepath")
    return table(spark, d, "sources").select("filepath", "ord", S.split_group(p).alias("grp"), S.module_of(p).alias("module"))


@query("SELECT repo_url, filepath, CASE WHEN n > 1 THEN filepath ELSE base END AS display_id FROM (SELECT repo_url, filepath, split_part(filepath, '/', -1) AS base, count(*) OVER (PARTITION BY repo_url, split_part(filepath, '/', -1)) AS n FROM sources)")
def display_names(spark, d):
    return rollups.display_ids(table(spark, d, "sources"))


_LAYER = r"""CASE WHEN lab IN ('frontend','api','backend','database') THEN lab
 WHEN regexp_matches(p, '(^|/)(api|routes?|endpoints?|controllers?)(/|$)') OR regexp_matches(p, 'route|endpoint|controller') THEN 'api'
 WHEN regexp_matches(p, '(^|/)(db|database|models?|schema|datastore|migrations?)(/|$)') OR regexp_matches(p, '\.sql$') THEN 'database'
 WHEN regexp_matches(p, '\.(jsx|tsx|vue|svelte|css|scss|html)$') OR regexp_matches(p, '(^|/)(components?|pages?|views?|ui|frontend|client|public)(/|$)') THEN 'frontend'
 WHEN regexp_matches(p, '\.(py|go|java|rb|php|rs|cs|ts|js)$') OR regexp_matches(p, '(^|/)(server|backend|services?|core)(/|$)') THEN 'backend' ELSE 'other' END"""
_WITH_LAYER = f"WITH l AS (SELECT *, {_LAYER} AS layer FROM (SELECT *, lower(filepath) AS p, lower(coalesce(predicted_label, '')) AS lab FROM predictions WHERE filepath IS NOT NULL)) "


@query(_WITH_LAYER + f"SELECT layer, count(*)::BIGINT AS n_files, floor(avg({_OK}) * 100 + 0.5)::BIGINT AS mean_percent FROM l GROUP BY 1")
def layer_stats(spark, d):
    return rollups.api_stats(table(spark, d, "predictions").where("filepath IS NOT NULL"), S.layer(F.col("filepath"), F.col("predicted_label")))


# ---- role labels ---------------------------------------------------------------------------------
def _score_sql(lab: str) -> str:
    parts = [f"(CASE WHEN regexp_matches(p, {_s(r)}) THEN {n}.0 ELSE 0.0 END)" for r, x, n in roles.PATH_POINTS if x == lab] or ["0.0"]
    more = {
        "entry_point": f"(CASE WHEN regexp_matches(c, {_s(roles.MAIN_GUARD)}) OR regexp_matches(c, {_s(roles.CLI)}) THEN 3.0 ELSE 0.0 END)",
        "core_logic": "(CASE WHEN n_class >= 2 THEN 2.0 ELSE 0.0 END) + 1.5",
        "utility": "(CASE WHEN n_func >= 4 AND n_class = 0 THEN 2.0 ELSE 0.0 END) + (CASE WHEN n_lines < 15 THEN 1.0 ELSE 0.0 END)",
        "documentation": "(CASE WHEN n_comment::DOUBLE / n_lines > 0.35 THEN 1.0 ELSE 0.0 END)",
    }.get(lab)
    return "(" + " + ".join([*parts, *([more] if more else [])]) + ")::DOUBLE"


_CLASSIFIED = f"""
WITH b AS (SELECT ord, repo_url, filepath, lower(filepath) AS p, coalesce(code, '') AS c FROM sources),
 m AS (SELECT *, len(c) - len(replace(c, chr(10), '')) + 1 AS n_lines, len(regexp_extract_all(c, {_s(roles.FUNCTIONS)})) AS n_func,
   len(regexp_extract_all(c, {_s(roles.CLASSES)})) AS n_class, len(regexp_extract_all(c, {_s(roles.COMMENT_LINE)})) AS n_comment FROM b),
 sc AS (SELECT ord, repo_url, filepath, c, [{", ".join(_score_sql(x) for x in roles.LABELS)}] AS s FROM m),
 r AS (SELECT ord, repo_url, filepath, c, list_reverse_sort(list_transform(range(1, {len(roles.LABELS) + 1}), lambda i: {{'c': s[i] / list_sum(s), 'tie': -i, 'label': ([{", ".join(_s(x) for x in roles.LABELS)}])[i]}})) AS r FROM sc),
 cl AS (SELECT ord, repo_url, filepath, c, r[1].label AS predicted_label, round(r[1].c, 4) AS confidence, r[1].c >= 0.5 AS is_confident FROM r)
"""


def _classified(spark, d):
    return roles.classify(table(spark, d, "sources"))


@query(_CLASSIFIED + "SELECT ord, predicted_label, confidence, is_confident FROM cl")
def role_classify(spark, d):
    return _classified(spark, d).select("ord", "predicted_label", "confidence", "is_confident")


_BELOW = "CASE WHEN contains(filepath, '/') THEN regexp_replace(filepath, '^[^/]*/', '') ELSE filepath END"


@query(
    _CLASSIFIED
    + f", z AS (SELECT ord, predicted_label AS l, {_BELOW} AS f, c FROM cl) SELECT ord, l AS original_label, CASE l "
    + " ".join(f"WHEN {_s(a)} THEN {_s(b)}" for a, b in roles.RENAMED.items())
    + " ELSE CASE " + " ".join(f"WHEN regexp_matches(f, {_s(r)}, 'i') THEN {_s(n)}" for n, r in roles.PATH_RULES)
    + " " + " ".join(f"WHEN regexp_matches(c, {_s(r)}, 'i') THEN {_s(n)}" for n, r in roles.CONTENT_RULES) + " ELSE 'backend' END END AS label FROM z"
)
def role_remap(spark, d):
    c = _classified(spark, d)
    return c.select("ord", F.col("predicted_label").alias("original_label"), roles.remap(F.col("predicted_label"), F.col("filepath"), F.col("code"))["label"].alias("label"))


# ---- predictions ---------------------------------------------------------------------------------
@query("SELECT count(*)::BIGINT AS total, (count(*) FILTER (is_confident))::BIGINT AS confident, (count(*) FILTER (NOT is_confident))::BIGINT AS non_confident, count(DISTINCT repo_url)::BIGINT AS repos, count(DISTINCT predicted_label)::BIGINT AS labels FROM predictions")
def prediction_stats(spark, d):
    return rollups.prediction_stats(table(spark, d, "predictions"))


@query(f"SELECT predicted_label, count(*)::BIGINT AS n, round(avg({_OK}), 6) AS mean_confidence, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM predictions GROUP BY 1")
def label_stats(spark, d):
    return rollups.label_stats(table(spark, d, "predictions"))


@query("SELECT '>0.' || k AS bin, (SELECT count(*) FROM predictions WHERE confidence BETWEEN 0 AND 1 AND confidence >= k / 10.0::DOUBLE)::BIGINT AS n FROM range(1, 10) t(k)")
def confidence_histogram(spark, d):
    return rollups.confidence_histogram(table(spark, d, "predictions"))


@query("SELECT repo_url, count(*)::BIGINT AS n FROM predictions WHERE repo_url IS NOT NULL GROUP BY 1 ORDER BY n DESC, repo_url LIMIT 10")
def top_repos(spark, d):
    return table(spark, d, "predictions").where("repo_url IS NOT NULL").groupBy("repo_url").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "repo_url").limit(10)


@query(f"SELECT repo_url, filepath, ord, predicted_label, {_OK} AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY repo_url, filepath ORDER BY ord) AS r FROM predictions) WHERE r = 1")
def dedup_keep_first(spark, d):
    """The first row of each file; a confidence outside 0..1, NaN among them, is null."""
    return rollups.keep_first(table(spark, d, "predictions")).select("repo_url", "filepath", "ord", "predicted_label", skew.usable(F.col("confidence")).alias("confidence"))


@query("SELECT repo_url, (count(*) FILTER (confidence >= 0.3 AND confidence <= 1))::BIGINT AS kept, (count(*) FILTER (confidence >= 0.3 AND confidence <= 1 AND is_confident))::BIGINT AS kept_confident, (count(*) FILTER (confidence IS NULL OR NOT (confidence >= 0.3 AND confidence <= 1)))::BIGINT AS unknown FROM predictions GROUP BY 1")
def confidence_filter(spark, d):
    keep = F.col("confidence").between(0.3, 1.0)
    return table(spark, d, "predictions").groupBy("repo_url").agg(F.count_if(keep).alias("kept"), F.count_if(keep & F.col("is_confident")).alias("kept_confident"), F.count_if(F.coalesce(~keep, F.lit(True))).alias("unknown"))


@query("SELECT p.repo_url, (count(*) FILTER (s.ord IS NOT NULL))::BIGINT AS found, (count(*) FILTER (s.ord IS NULL))::BIGINT AS missing FROM predictions p LEFT JOIN sources s ON p.repo_url = s.repo_url AND p.filepath = s.filepath GROUP BY 1")
def found_files(spark, d):
    p, s = table(spark, d, "predictions").select("repo_url", "filepath"), table(spark, d, "sources").select("repo_url", "filepath", "ord")
    return p.join(s, ["repo_url", "filepath"], "left").groupBy("repo_url").agg(F.count_if(F.col("ord").isNotNull()).alias("found"), F.count_if(F.col("ord").isNull()).alias("missing"))


@query("SELECT count(*)::BIGINT AS tracked, (count(*) FILTER (analysed))::BIGINT AS analysed, (count(*) FILTER (NOT analysed))::BIGINT AS skipped, (count(*) FILTER (analysed IS NULL))::BIGINT AS unknown FROM file_index")
def file_index_summary(spark, d):
    return table(spark, d, "file_index").agg(F.count(F.lit(1)).alias("tracked"), F.count_if("analysed").alias("analysed"), F.count_if(~F.col("analysed")).alias("skipped"), F.count_if(F.col("analysed").isNull()).alias("unknown"))


@query("SELECT s.ord FROM sources s WHERE NOT EXISTS (SELECT 1 FROM file_index f WHERE f.repo_url = s.repo_url AND f.filepath = s.filepath AND f.analysed)")
def unhandled_files(spark, d):
    s, f = table(spark, d, "sources").select("ord", "repo_url", "filepath"), table(spark, d, "file_index").where("analysed").select("repo_url", "filepath").distinct()
    return s.join(f, ["repo_url", "filepath"], "left_anti").select("ord")


@query("SELECT label, idx, coalesce(n, 0)::BIGINT AS n FROM label_meta LEFT JOIN (SELECT label, count(*) AS n FROM examples GROUP BY 1) USING (label)")
def label_vocabulary(spark, d):
    n = table(spark, d, "examples").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "label_meta").join(n, "label", "left").select("label", "idx", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT remap_method, label, count(*)::BIGINT AS n FROM examples GROUP BY 1, 2 ORDER BY n DESC, remap_method NULLS FIRST, label NULLS FIRST LIMIT 20")
def remap_statistics(spark, d):
    return table(spark, d, "examples").groupBy("remap_method", "label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("remap_method"), F.asc_nulls_first("label")).limit(20)


@query("SELECT ord, filepath FROM sources WHERE contains(lower(filepath), 'valve') ORDER BY ord LIMIT 8")
def substring_search(spark, d):
    return table(spark, d, "sources").where(F.lower("filepath").contains("valve")).select("ord", "filepath").orderBy("ord").limit(8)


# ---- splits and metrics --------------------------------------------------------------------------
@query(
    """WITH n AS (SELECT label, count(*) AS n FROM examples WHERE label IS NOT NULL GROUP BY 1),
 t AS (SELECT label, n, CASE WHEN n <= 2 THEN n ELSE greatest(1, round_even(n * 0.7::DOUBLE, 0))::BIGINT END AS tr FROM n),
 v AS (SELECT label, n, tr, CASE WHEN n > 2 THEN least(n - tr, greatest(1, round_even(n * 0.15::DOUBLE, 0))::BIGINT) ELSE 0 END AS va FROM t)
 SELECT label, tr::BIGINT AS train, va::BIGINT AS val, (n - tr - va)::BIGINT AS test FROM v"""
)
def stratified_split_sizes(spark, d):
    rows = splits.stratified(table(spark, d, "examples").where("label IS NOT NULL").select("ord", "label"), "label", "ord")
    return rows.groupBy("label").agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")])


@query(
    """WITH g AS (SELECT count(DISTINCT CASE WHEN len(string_split(filepath, '/')) > 2 THEN array_to_string(string_split(filepath, '/')[1:3], '/') ELSE filepath END) AS n FROM examples)
 SELECT floor(n * 0.8::DOUBLE)::BIGINT AS train, floor(n * 0.1::DOUBLE)::BIGINT AS val, (n - floor(n * 0.8::DOUBLE) - floor(n * 0.1::DOUBLE))::BIGINT AS test FROM g"""
)
def group_split_sizes(spark, d):
    rows = splits.grouped(table(spark, d, "examples").where("filepath IS NOT NULL").select("ord", S.split_group(F.col("filepath")).alias("grp")), "grp")
    return rows.select("grp", "split").distinct().agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")])


_PAIRS = "WITH e AS (SELECT label AS truth, original_label AS guess FROM examples WHERE label IS NOT NULL AND original_label IS NOT NULL) "


def _pairs(spark, d):
    return table(spark, d, "examples").where("label IS NOT NULL AND original_label IS NOT NULL").select("label", "original_label")


@query(_PAIRS + "SELECT truth, guess, count(*)::BIGINT AS n FROM e GROUP BY 1, 2")
def confusion_counts(spark, d):
    return splits.confusion(_pairs(spark, d), "label", "original_label")


_PER_CLASS = _PAIRS + """, t AS (SELECT truth AS label, count(*) AS support, count(*) FILTER (truth = guess) AS tp FROM e GROUP BY 1), g AS (SELECT guess AS label, count(*) AS guessed FROM e GROUP BY 1),
 j AS (SELECT label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(guessed, 0) AS guessed FROM t FULL JOIN g USING (label)),
 pc AS (SELECT label, round(CASE WHEN guessed > 0 THEN tp::DOUBLE / guessed ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (guessed + support) ELSE 0 END, 6) AS f1, support::BIGINT AS support FROM j) """


@query(_PER_CLASS + "SELECT * FROM pc")
def per_class_metrics(spark, d):
    return splits.per_class(_pairs(spark, d), "label", "original_label")


@query(_PER_CLASS + "SELECT round(sum(recall * support) / sum(support), 5) AS accuracy, round(avg(f1), 5) AS macro_f1, round(sum(f1 * support) / sum(support), 5) AS weighted_f1, (SELECT round(avg(f1), 5) FROM (SELECT f1 FROM pc WHERE support > 0 ORDER BY support, label LIMIT 5)) AS minority_f1 FROM pc WHERE support > 0")
def overall_metrics(spark, d):
    return splits.overall(_pairs(spark, d), "label", "original_label")


@query("WITH c AS (SELECT label, count(*) AS n FROM examples WHERE label IS NOT NULL GROUP BY 1) SELECT label, n::BIGINT AS n, round(sqrt(1.0::DOUBLE / n) / avg(sqrt(1.0::DOUBLE / n)) OVER (), 6) AS weight FROM c")
def class_weights(spark, d):
    return splits.class_weights(table(spark, d, "examples"), "label")


@query("SELECT split, label, count(*)::BIGINT AS n FROM examples WHERE label IS NOT NULL AND split IS NOT NULL GROUP BY 1, 2")
def class_support(spark, d):
    return table(spark, d, "examples").where("label IS NOT NULL AND split IS NOT NULL").groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(least(greatest(count(*) FILTER (NOT is_confident), 1)::DOUBLE / greatest(count(*) FILTER (is_confident), 1), 20), 6) AS pos_weight FROM predictions")
def pos_weight(spark, d):
    return splits.pos_weight(table(spark, d, "predictions"), "is_confident")


@query(
    """WITH p AS (SELECT confidence AS s, is_confident AS y FROM predictions WHERE confidence BETWEEN 0 AND 1 AND is_confident IS NOT NULL), c AS (SELECT round(0.1 + 0.05 * i, 4)::DOUBLE AS t FROM range(0, 17) r(i)),
 k AS (SELECT t, count(*) FILTER (s >= t AND y) AS tp, count(*) FILTER (s >= t) AS pp, count(*) FILTER (y) AS pos FROM p, c GROUP BY 1)
 SELECT t AS threshold, round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (pp + pos) ELSE 0 END, 6) AS f1 FROM k ORDER BY f1 DESC, t LIMIT 1"""
)
def threshold_sweep(spark, d):
    p = table(spark, d, "predictions").where("confidence BETWEEN 0 AND 1 AND is_confident IS NOT NULL").select("confidence", "is_confident")
    return splits.threshold_sweep(p, "confidence", "is_confident")


@query("SELECT predicted_label, round(avg(-power(1 - confidence, 2) * ln(confidence)), 6) AS focal, round(avg(1 / (1 + exp(-confidence))), 6) AS sigmoid FROM predictions WHERE confidence > 0 AND confidence <= 1 GROUP BY 1")
def loss_terms(spark, d):
    p = table(spark, d, "predictions").where("confidence > 0 AND confidence <= 1")
    return p.groupBy("predicted_label").agg(F.round(F.avg(S.focal_loss(F.col("confidence"))), 6).alias("focal"), F.round(F.avg(S.sigmoid(F.col("confidence"))), 6).alias("sigmoid"))


# ---- calls and the unified graph -----------------------------------------------------------------
_NAME = r"split_part(trim(regexp_replace(raw_call, '\(.*\)$', '')), '.', -1)"
_RESOLVED = V + f""", c AS (SELECT *, {_NAME} AS callee FROM v_calls), own AS (SELECT DISTINCT repo_url, source_file, function AS callee, true AS own FROM v_functions),
 first_ AS (SELECT repo_url, function AS callee, arg_min(source_file, ord * 100000 + substr(source_file, 2)::BIGINT) AS repo_file FROM v_functions GROUP BY 1, 2),
 r AS (SELECT c.*, own, repo_file, CASE WHEN own THEN 'same_file' WHEN repo_file IS NOT NULL THEN 'same_repo' ELSE 'external' END AS tier,
   CASE WHEN own THEN source_file ELSE repo_file END AS target_file FROM c LEFT JOIN own USING (repo_url, source_file, callee) LEFT JOIN first_ USING (repo_url, callee)) """


def _resolved(spark, d):
    return resolve.resolve_calls(views.calls(spark, d), views.functions(spark, d))


@query(_RESOLVED + "SELECT repo_url, tier, count(*)::BIGINT AS n, count(DISTINCT callee)::BIGINT AS callees FROM r GROUP BY 1, 2")
def call_resolution(spark, d):
    return _resolved(spark, d).groupBy("repo_url", "tier").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("callee").alias("callees"))


_PROJECTED = _RESOLVED + ", f AS (SELECT 'file::' || repo_url || '::' || source_file AS file_u, 'file::' || repo_url || '::' || target_file AS file_v, count(*)::BIGINT AS n FROM r WHERE target_file IS NOT NULL AND target_file <> source_file GROUP BY 1, 2) "


@query(_PROJECTED + "SELECT * FROM f")
def file_projection(spark, d):
    return resolve.file_projection(_resolved(spark, d))


@query(_PROJECTED + "SELECT file_u, file_v, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file_u ORDER BY n DESC, file_v) AS rank FROM f) WHERE rank <= 2")
def file_dependency_topk(spark, d):
    """The flagship: resolve calls, project them to files, keep each file's two strongest dependencies."""
    p = resolve.file_projection(_resolved(spark, d)).select(F.col("file_u").alias("src"), F.col("file_v").alias("dst"), "n")
    return rollups.top_k_per_source(p, 2, "n", ("dst",)).select(F.col("src").alias("file_u"), F.col("dst").alias("file_v"), "n", "rank")


@query(
    _RESOLVED
    + """, e AS (SELECT 'DEFINES' AS type FROM v_functions UNION ALL SELECT 'CALLS' FROM r)
 SELECT 'edge' AS what, type, count(*)::BIGINT AS n FROM e GROUP BY 2 UNION ALL SELECT 'node', 'File', count(DISTINCT repo_url || source_file) FROM v_functions
 UNION ALL SELECT 'node', 'Function', count(*) FROM v_functions UNION ALL SELECT 'node', 'External', count(DISTINCT callee) FROM r WHERE tier = 'external'"""
)
def unified_graph_counts(spark, d):
    f = views.functions(spark, d)
    nodes, edges = resolve.unified_graph(f.select("repo_url", "source_file").distinct(), f, views.calls(spark, d))
    n = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "type", "n")
    return n.unionByName(edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), "type", "n"))


@query(_RESOLVED + "SELECT repo_url, source_file, function, list_sort(list(DISTINCT callee)) AS callees FROM r GROUP BY 1, 2, 3")
def distinct_callees(spark, d):
    return _resolved(spark, d).groupBy("repo_url", "source_file", "function").agg(F.array_sort(F.collect_set("callee")).alias("callees"))


@query(V + "SELECT kind, module, count(*)::BIGINT AS n FROM (SELECT CASE WHEN f.function IS NOT NULL THEN 'function' ELSE 'library' END AS kind, CASE WHEN f.function IS NULL THEN split_part(raw_call, '.', 1) END AS module FROM v_calls c LEFT JOIN (SELECT DISTINCT repo_url, function FROM v_functions) f ON f.repo_url = c.repo_url AND f.function = regexp_replace(split_part(c.raw_call, '.', -1), '\\(.*\\)$', '')) GROUP BY 1, 2".replace("\\\\", "\\"))
def call_kinds(spark, d):
    f = views.functions(spark, d).select("repo_url", F.col("function").alias("callee"), F.lit(True).alias("known")).distinct()
    c = views.calls(spark, d).withColumn("callee", S.call_name(F.col("raw_call"))).join(f, ["repo_url", "callee"], "left")
    known = F.coalesce("known", F.lit(False))
    return c.groupBy(S.call_kind(F.col("raw_call"), known).alias("kind"), S.callee_module(F.col("raw_call"), known).alias("module")).agg(F.count(F.lit(1)).alias("n"))


@query(V + ", old AS (SELECT * FROM v_functions), fresh AS (SELECT * FROM v_functions WHERE source_file IN ('f1', 'f2')) SELECT repo_url, source_file, function, ord FROM old WHERE (repo_url, source_file) NOT IN (SELECT repo_url, source_file FROM fresh) UNION ALL SELECT repo_url, source_file, function || '_new', ord FROM fresh")
def incremental_replace(spark, d):
    f = views.functions(spark, d)
    fresh = f.where(F.col("source_file").isin("f1", "f2")).withColumn("function", F.concat("function", F.lit("_new")))
    return resolve.replace_files(f, fresh).select("repo_url", "source_file", "function", "ord")


# ---- graph measures ------------------------------------------------------------------------------
def _edges(spark, d):
    return views.edges(spark, d)


_SIMPLE = V + ", s AS (SELECT DISTINCT src, dst FROM v_edges) "


@query(_SIMPLE + """, x AS (SELECT src AS id, 0 AS i, 1 AS o FROM s UNION ALL SELECT dst, 1, 0 FROM s) SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*)::BIGINT AS total_degree,
 CASE WHEN sum(i) = 0 THEN 'start' WHEN sum(o) = 0 THEN 'end' ELSE 'mid' END AS role FROM x GROUP BY 1""")
def node_degrees(spark, d):
    return graph.degrees(_edges(spark, d))


@query(V + ", b AS (SELECT src, dst, CASE WHEN type IN ('DEFINES','IMPORTS','CALLS','INHERITS','USES') THEN type ELSE 'OTHER' END AS t FROM v_edges), x AS (SELECT dst AS id, 'in_' || t AS k FROM b UNION ALL SELECT src, 'out_' || t FROM b) SELECT id, "
 + ", ".join(f"(count(*) FILTER (k = '{p}{t}'))::BIGINT AS {p}{t}" for p in ("in_", "out_") for t in S.EDGE_TYPES) + " FROM x GROUP BY 1")
def edge_type_counts(spark, d):
    return graph.type_counts(_edges(spark, d))


def _rank_sql(rounds: int) -> str:
    parts = [_SIMPLE, ", nd AS (SELECT src AS id FROM s UNION SELECT dst FROM s), n AS (SELECT count(*)::DOUBLE AS n FROM nd), od AS (SELECT src, count(*) AS deg FROM s GROUP BY 1), r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM nd, n)"]
    for k in range(rounds):
        parts.append(
            f", r{k + 1} AS (SELECT r.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE id NOT IN (SELECT src FROM od)) / n) AS rank FROM r{k} r CROSS JOIN n "
            f"LEFT JOIN (SELECT s.dst AS id, sum(q.rank / od.deg) AS got FROM s JOIN od USING (src) JOIN r{k} q ON q.id = s.src GROUP BY 1) g USING (id))"
        )
    return "".join(parts) + f" SELECT id, round(rank * 1000000, 3) AS rank_ppm FROM r{rounds}"


@query(_rank_sql(4))
def pagerank_rounds(spark, d):
    return graph.pagerank(_edges(spark, d), rounds=4, tolerance=None).select("id", F.round(F.col("rank") * 1000000, 3).alias("rank_ppm"))


@query()
def pagerank_converged(spark, d):
    return graph.pagerank(_edges(spark, d), rounds=60, tolerance=1e-7)


@query(V + """, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM v_edges WHERE src <> dst), dg AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY 1),
 t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b), c AS (SELECT id, count(*) AS tri FROM (SELECT p AS id FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY 1)
 SELECT id, degree::BIGINT AS degree, coalesce(tri, 0)::BIGINT AS triangles, round(CASE WHEN degree > 1 THEN coalesce(tri, 0) / (degree * (degree - 1) / 2.0::DOUBLE) ELSE 0 END, 6) AS clustering FROM dg LEFT JOIN c USING (id)""")
def clustering_coefficient(spark, d):
    return graph.clustering(_edges(spark, d))


@query()
def negative_pairs(spark, d):
    e = _edges(spark, d)
    return graph.negatives(e, 5_000)


@query(V + ", k AS (SELECT src, dst, type, max(p) AS p FROM v_edges GROUP BY 1, 2, 3) SELECT src, dst, type, p, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY p DESC, dst, type) AS rank FROM k) WHERE rank <= 2")
def topk_edges_per_source(spark, d):
    e = _edges(spark, d).groupBy("src", "dst", "type").agg(F.max("p").alias("p"))
    return rollups.top_k_per_source(e)


@query(V + ", k AS (SELECT src, dst, type, max(p) AS p FROM v_edges GROUP BY 1, 2, 3) SELECT src, dst, type, p FROM k WHERE p >= 0.05 ORDER BY p DESC, src, dst, type LIMIT 1000")
def topk_edges(spark, d):
    e = _edges(spark, d).groupBy("src", "dst", "type").agg(F.max("p").alias("p"))
    return rollups.top_k(e, 1000, 0.05)


_DEG = V + ", dg AS (SELECT id, count(*)::BIGINT AS degree FROM (SELECT src AS id FROM v_edges UNION ALL SELECT dst FROM v_edges) GROUP BY 1) "


@query(_DEG + "SELECT id, degree, rank::INT AS rank FROM (SELECT *, row_number() OVER (ORDER BY degree DESC, id) AS rank, count(*) OVER () AS n FROM dg) WHERE rank <= least(14, ceil(n * 0.12))")
def hub_nodes(spark, d):
    return rollups.hubs(rollups.endpoint_degree(_edges(spark, d)))


@query(_DEG + "SELECT id, degree, round(6 + 3.2 * sqrt(degree + 1), 6) AS radius FROM dg")
def node_radius(spark, d):
    return rollups.endpoint_degree(_edges(spark, d)).select("id", "degree", F.round(S.radius(F.col("degree")), 6).alias("radius"))


@query(V + ", b AS (SELECT src AS id, dst AS o FROM v_edges WHERE src <> dst UNION SELECT dst, src FROM v_edges WHERE src <> dst) SELECT id, count(*)::BIGINT AS n FROM b GROUP BY 1")
def neighbour_counts(spark, d):
    return rollups.neighbours(_edges(spark, d)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(_SIMPLE + ", o AS (SELECT src AS id, dst AS other FROM s WHERE src <> dst), i AS (SELECT dst AS id, src AS other FROM s WHERE src <> dst) SELECT direction, count(*)::BIGINT AS n FROM (SELECT CASE WHEN o.id IS NOT NULL AND i.id IS NOT NULL THEN 'both' WHEN o.id IS NOT NULL THEN 'out' ELSE 'in' END AS direction FROM o FULL JOIN i ON o.id = i.id AND o.other = i.other) GROUP BY 1")
def connection_directions(spark, d):
    return rollups.connections(_edges(spark, d)).groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


_NODE_LAYER = "CASE n.n_regionkey WHEN 0 THEN 'frontend' WHEN 1 THEN 'api' WHEN 2 THEN 'backend' WHEN 3 THEN 'database' ELSE 'other' END"


def _node_layers(spark, d):
    lab = F.create_map(*[F.lit(x) for kv in enumerate(("frontend", "api", "backend", "database")) for x in kv])
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.coalesce(F.try_element_at(lab, F.col("n_regionkey")), F.lit("other")).alias("layer"), F.col("n_name").alias("module"))


@query(V + f""", l AS (SELECT c_custkey AS id, {_NODE_LAYER} AS layer FROM customer JOIN nation n ON c_nationkey = n.n_nationkey),
 e AS (SELECT a.layer AS ls, b.layer AS lt, p FROM v_edges JOIN l a ON a.id = src JOIN l b ON b.id = dst WHERE a.layer <> b.layer),
 g AS (SELECT least(ls, lt) AS a, greatest(ls, lt) AS b, count(*)::BIGINT AS weight, (count(*) FILTER (ls < lt))::BIGINT AS ab, (count(*) FILTER (ls > lt))::BIGINT AS ba, round(avg(p), 6) AS mean_p FROM e GROUP BY 1, 2)
 SELECT *, CASE WHEN ab >= ba THEN a ELSE b END AS s, CASE WHEN ab >= ba THEN b ELSE a END AS t FROM g""")
def layer_flow(spark, d):
    return rollups.layer_flow(_edges(spark, d), _node_layers(spark, d))


@query(V + """, m AS (SELECT c_custkey AS id, n_name AS module FROM customer JOIN nation n ON c_nationkey = n.n_nationkey),
 e AS (SELECT src, dst, type, p, a.module FROM v_edges JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.module = b.module AND src <> dst AND type = 'CALLS'),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY p DESC, dst, type) AS r FROM (SELECT src, dst, type, module, max(p) AS p FROM e GROUP BY ALL)) WHERE r <= 2),
 nn AS (SELECT module, count(DISTINCT id) AS n_nodes FROM (SELECT module, src AS id FROM k UNION ALL SELECT module, dst FROM k) GROUP BY 1)
 SELECT module, (SELECT count(*) FROM e WHERE e.module = nn.module)::BIGINT AS n_intra, (SELECT count(*) FROM k WHERE k.module = nn.module)::BIGINT AS n_edges, n_nodes::BIGINT AS n_nodes FROM nn""")
def module_rollup(spark, d):
    return rollups.module_rollup(_edges(spark, d), _node_layers(spark, d), "CALLS")


@query(V + "SELECT type, count(*)::BIGINT AS n FROM v_edges GROUP BY 1")
def edge_type_vocabulary(spark, d):
    return rollups.type_vocabulary(_edges(spark, d))


@query(_SIMPLE + ", t AS (SELECT src, dst, list_sort(list(DISTINCT type)) AS types FROM v_edges GROUP BY 1, 2) SELECT array_to_string(types, '+') AS types, count(*)::BIGINT AS n FROM t GROUP BY 1")
def type_sets(spark, d):
    t = _edges(spark, d).groupBy("src", "dst").agg(F.array_sort(F.collect_set("type")).alias("types"))
    return t.groupBy(F.array_join("types", "+").alias("types")).agg(F.count(F.lit(1)).alias("n"))


@query(_SIMPLE + ", m AS (SELECT c_custkey AS id, c_nationkey AS grp FROM customer), x AS (SELECT a.grp, count(*) AS n FROM m a JOIN m b ON a.grp = b.grp AND a.id <> b.id WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.src = a.id AND s.dst = b.id) GROUP BY 1) SELECT grp, n::BIGINT AS n FROM x")
def candidate_counts(spark, d):
    """New pairs within a group, counted without making them: n (n - 1) less the group's own edges."""
    g = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"))
    total = g.groupBy("grp").agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)).alias("all"))
    e = graph.candidate_pairs(g, _edges(spark, d), "existing")
    inside = e.join(g.select(F.col("id").alias("src"), F.col("grp").alias("gs")), "src").join(g.select(F.col("id").alias("dst"), F.col("grp").alias("gt")), "dst").where("gs = gt")
    return total.join(inside.groupBy(F.col("gs").alias("grp")).agg(F.count(F.lit(1)).alias("e")), "grp", "left").select("grp", (F.col("all") - F.coalesce("e", F.lit(0))).alias("n")).where("n > 0")


@query(_SIMPLE + "SELECT id, (row_number() OVER (ORDER BY id) - 1)::BIGINT AS idx FROM (SELECT src AS id FROM s UNION SELECT dst FROM s)")
def dense_node_index(spark, d):
    return graph.dense_index(graph.node_ids(_edges(spark, d)))


@query(V + "SELECT dst AS id, round(avg(c_acctbal), 4) AS neigh FROM v_edges JOIN customer ON c_custkey = src GROUP BY 1")
def neighbour_means(spark, d):
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal")).alias("x"))
    e = _edges(spark, d)
    out = graph.mean_neighbours(e, x, 1)
    return out.join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_semi").select("id", F.round(F.col("neigh")[0], 4).alias("neigh"))


# ---- extraction and imports ----------------------------------------------------------------------
@query()
def extracted_records(spark, d):
    return extract.extract(table(spark, d, "sources")).groupBy("language", "kind").agg(F.count(F.lit(1)).alias("n"))


_JS_IMPORTS = (r"import\s+(?:[\w*{}\s,]+\s+from\s+)?['\"]([^'\"]+)['\"]", r"export\s+(?:[\w*{}\s,]+\s+from\s+)?['\"]([^'\"]+)['\"]", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)", r"import\(\s*['\"]([^'\"]+)['\"]\s*\)")


@query("SELECT ord, imp FROM (SELECT ord, unnest(list_concat(" + ", ".join(f"regexp_extract_all(code, {_s(r)}, 1)" for r in _JS_IMPORTS) + ")) AS imp FROM sources WHERE regexp_matches(filepath, '\\.(js|jsx|ts|tsx)$'))")
def js_imports(spark, d):
    s = table(spark, d, "sources").where(F.col("filepath").rlike(r"\.(js|jsx|ts|tsx)$"))
    return s.select("ord", F.explode(F.concat(*[F.regexp_extract_all("code", F.lit(r), 1) for r in _JS_IMPORTS])).alias("imp"))


# ---- events --------------------------------------------------------------------------------------
@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS begin, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    w = ingest.event_windows(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return w.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("begin"), "n", "total")
