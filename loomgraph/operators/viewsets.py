"""Graph views over extracted records (extract.SCHEMA), import edges, role flows, and scoring of file pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S

#: Extensions an import path may leave out, in the order they are tried.
IMPORT_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx")
IMPORT_PATTERNS = (
    r"import\s+(?:[\w*{}\s,]+\s+from\s+)?['\"]([^'\"]+)['\"]",
    r"export\s+(?:[\w*{}\s,]+\s+from\s+)?['\"]([^'\"]+)['\"]",
    r"require\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"import\(\s*['\"]([^'\"]+)['\"]\s*\)",
)


def call_view(records: DataFrame) -> DataFrame:
    """(repo_url, caller, callee, kind): distinct calls with the kind of the callee."""
    calls = records.where("kind = 'call_flow'").select("repo_url", F.col("name").alias("caller"), F.explode("items").alias("callee"))
    own = records.where("kind = 'call_flow'").select("repo_url", F.col("name").alias("callee"), F.lit(True).alias("known")).distinct()
    j = calls.distinct().join(own, ["repo_url", "callee"], "left")
    return j.select("repo_url", "caller", "callee", S.call_kind(F.col("callee"), F.coalesce("known", F.lit(False))).alias("kind"))


def dependency_view(records: DataFrame) -> DataFrame:
    """(repo_url, caller, module): functions and the modules they call into."""
    v = call_view(records)
    m = S.callee_module(F.col("callee"), F.col("kind") == "function")
    return v.select("repo_url", "caller", m.alias("module")).where("module IS NOT NULL").distinct()


def data_flow_view(records: DataFrame) -> DataFrame:
    """(repo_url, source, target, label): functions own variables, variables are passed on; the first label of a pair stays."""
    f = records.where("kind = 'data_flow'")
    var = F.concat_ws("::", "name", "a")
    owns = f.select("repo_url", F.col("name").alias("source"), var.alias("target"), F.lit("owns").alias("label"), F.struct("source_file", "seq").alias("o"))
    passed = f.select("repo_url", var.alias("source"), F.col("b").alias("target"), F.lit("passed_as").alias("label"), F.struct("source_file", "seq").alias("o"))
    return owns.unionByName(passed).groupBy("repo_url", "source", "target").agg(F.min_by("label", "o").alias("label"))


def class_view(records: DataFrame) -> DataFrame:
    """(repo_url, class, member, relation): inherits, has_attribute, has_method."""
    rel = F.create_map(*[F.lit(x) for x in ("class_bases", "inherits", "class_attributes", "has_attribute", "class_methods", "has_method")])
    c = records.where(F.col("kind").isin("class_bases", "class_attributes", "class_methods"))
    return c.select("repo_url", F.col("name").alias("class"), F.explode("items").alias("member"), F.element_at(rel, F.col("kind")).alias("relation")).distinct()


def import_view(records: DataFrame) -> DataFrame:
    """(repo_url, function, module): path::function and what its file imports for it."""
    i = records.where("kind = 'imports'")
    return i.select("repo_url", F.concat_ws("::", "source_file", "name").alias("function"), F.explode("items").alias("module")).distinct()


def _normal(path):
    """A path without '.', 'x/..' and empty parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.when(p == "..", a).otherwise(F.concat(a, F.array(p)))))
    return F.array_join(kept, "/")


def import_edges(sources: DataFrame) -> DataFrame:
    """(repo_url, source, target): files and the files of their repository that they import relatively; first existing candidate."""
    js = sources.where(F.col("filepath").rlike(r"\.(js|jsx|ts|tsx)$"))
    found = F.concat(*[F.regexp_extract_all("code", F.lit(p), 1) for p in IMPORT_PATTERNS])
    imp = js.select("repo_url", "filepath", F.explode(F.array_distinct(found)).alias("imp")).where("imp LIKE '.%' OR imp LIKE '/%'")
    raw = F.when(F.col("imp").startswith("/"), F.col("imp")).otherwise(F.concat(S.parent_dir(F.col("filepath")), F.lit("/"), F.col("imp")))
    base = imp.withColumn("raw", _normal(raw))
    names = F.array(F.col("raw"), *[F.concat("raw", F.lit(e)) for e in IMPORT_EXTENSIONS], *[F.concat("raw", F.lit("/index" + e)) for e in IMPORT_EXTENSIONS])
    tried = base.select("repo_url", F.col("filepath").alias("source"), "imp", F.posexplode(names).alias("pos", "target"))
    there = sources.select("repo_url", F.col("filepath").alias("target")).distinct()
    return tried.join(there, ["repo_url", "target"]).groupBy("repo_url", "source", "imp").agg(F.min_by("target", "pos").alias("target")).where("target <> source").select("repo_url", "source", "target").distinct()


def role_flows(edges: DataFrame) -> DataFrame:
    """(flow, n): edges(source, target) by the roles of their paths, as SRC_TO_TGT."""
    return edges.groupBy(F.concat(S.role_of(F.col("source")), F.lit("_TO_"), S.role_of(F.col("target"))).alias("flow")).agg(F.count(F.lit(1)).alias("n"))


def score_pairs(pairs: DataFrame, vectors: DataFrame, top: int = 1000, threshold: float = 0.5) -> DataFrame:
    """The `top` pairs (src, dst) by the sigmoid of their vectors' cosine, at least `threshold`; scored JVM-side."""
    a, b = vectors.select(F.col("id").alias("src"), F.col("x").alias("xa")), vectors.select(F.col("id").alias("dst"), F.col("x").alias("xb"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s.cast("double") * t), F.lit(0.0), lambda acc, v: acc + v)
    cos = dot(F.col("xa"), F.col("xb")) / F.sqrt(dot(F.col("xa"), F.col("xa")) * dot(F.col("xb"), F.col("xb")))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", F.round(S.sigmoid(cos), 6).alias("p")).where(F.col("p") >= threshold).orderBy(F.desc("p"), "src", "dst").limit(top)


def score_files(files: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A scorer of the caller's own (any model that maps a batch to predictions), batch by batch in the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield model(b)

    return files.mapInPandas(run, schema)
