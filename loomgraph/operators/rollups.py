"""Aggregations for serving: prediction statistics, layer flows, module roll-ups, top-k, hubs, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S


def top_k_per_source(edges: DataFrame, k: int = 2, weight: str = "p", ties: tuple[str, ...] = ("dst", "type")) -> DataFrame:
    """The k heaviest edges of each source; the planner keeps k rows a source before the shuffle (window group limit)."""
    w = Window.partitionBy("src").orderBy(F.col(weight).desc(), *ties)
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(edges: DataFrame, k: int, threshold: float = 0.0, weight: str = "p", ties: tuple[str, ...] = ("src", "dst", "type")) -> DataFrame:
    return edges.where(F.col(weight) >= threshold).orderBy(F.col(weight).desc(), *ties).limit(k)


def endpoint_degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hubs(degree: DataFrame, share: float = 0.12, most: int = 14) -> DataFrame:
    """The top min(most, ceil(share * n)) nodes by degree."""
    n = degree.agg(F.least(F.lit(most), F.ceil(F.count(F.lit(1)) * share)).alias("limit"))
    first = degree.orderBy(F.desc("degree"), "id").limit(most)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "id")))  # at most `most` rows
    return ranked.join(F.broadcast(n), F.col("rank") <= F.col("limit")).select("id", "degree", "rank")


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, neighbour): one hop, either direction."""
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("neighbour")), F.struct(F.col("dst").alias("id"), F.col("src").alias("neighbour")))).alias("e"))
    return both.select("e.*").where("id <> neighbour").distinct()


def connections(edges: DataFrame) -> DataFrame:
    """(id, other, direction): both, out or in for every node and the nodes it shares an edge with."""
    s = edges.where("src <> dst").select("src", "dst").distinct()
    out = s.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(1).alias("o"))
    into = s.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(1).alias("i"))
    j = out.join(into, ["id", "other"], "full_outer")
    return j.select("id", "other", F.when(F.col("o").isNotNull() & F.col("i").isNotNull(), "both").when(F.col("o").isNotNull(), "out").otherwise("in").alias("direction"))


def layer_flow(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Undirected flows between layers: count, either way's count, mean weight and the majority's direction (tie: alphabetical)."""
    a, b = layers.select(F.col("id").alias("src"), F.col("layer").alias("ls")), layers.select(F.col("id").alias("dst"), F.col("layer").alias("lt"))
    e = edges.join(a, "src").join(b, "dst").where("ls <> lt")
    lo, hi = F.least("ls", "lt"), F.greatest("ls", "lt")
    g = e.groupBy(lo.alias("a"), hi.alias("b")).agg(F.count(F.lit(1)).alias("weight"), F.sum((F.col("ls") == lo).cast("bigint")).alias("ab"), F.sum((F.col("ls") == hi).cast("bigint")).alias("ba"), F.round(F.avg("p"), 6).alias("mean_p"))
    fwd = F.col("ab") >= F.col("ba")
    return g.select("a", "b", "weight", "ab", "ba", "mean_p", F.when(fwd, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(fwd, F.col("b")).otherwise(F.col("a")).alias("t"))


def module_rollup(edges: DataFrame, modules: DataFrame, edge_type: str, k: int = 2) -> DataFrame:
    """Per module: intra-module edges of a type, those kept by top-k per source, nodes; ordered by edges."""
    m = modules.select("id", "module")
    e = edges.where(F.col("type") == edge_type).join(m.select(F.col("id").alias("src"), F.col("module").alias("ms")), "src").join(m.select(F.col("id").alias("dst"), F.col("module").alias("mt")), "dst").where("ms = mt AND src <> dst")
    kept = top_k_per_source(e.groupBy("src", "dst", "type", "ms").agg(F.max("p").alias("p")), k)
    intra = e.groupBy(F.col("ms").alias("module")).agg(F.count(F.lit(1)).alias("n_intra"))
    shown = kept.groupBy(F.col("ms").alias("module")).agg(F.count(F.lit(1)).alias("n_edges"))
    nodes = kept.select("ms", F.explode(F.array("src", "dst")).alias("id")).groupBy(F.col("ms").alias("module")).agg(F.countDistinct("id").alias("n_nodes"))
    return intra.join(shown, "module").join(nodes, "module")


def type_vocabulary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def display_ids(paths: DataFrame, path: str = "filepath", repo: str = "repo_url") -> DataFrame:
    """Base name, or the whole path where base names collide inside the repository."""
    base = F.element_at(F.split(path, "/"), -1)
    p = paths.select(repo, path).distinct().withColumn("base", base)
    many = p.groupBy(repo, "base").agg(F.count(F.lit(1)).alias("n"))
    return p.join(many, [repo, "base"]).select(repo, path, F.when(F.col("n") > 1, F.col(path)).otherwise(F.col("base")).alias("display_id"))


def prediction_stats(preds: DataFrame) -> DataFrame:
    return preds.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_confident").alias("confident"),
        F.count_if(~F.col("is_confident")).alias("non_confident"),
        F.countDistinct("repo_url").alias("repos"),
        F.countDistinct("predicted_label").alias("labels"),
    )


def label_stats(preds: DataFrame) -> DataFrame:
    """Rows, usable mean confidence and percentage per label."""
    ok = F.when(F.col("confidence").between(0.0, 1.0), F.col("confidence"))
    g = preds.groupBy("predicted_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ok), 6).alias("mean_confidence"))
    total = g.agg(F.sum("n").alias("total"))  # one row
    return g.join(F.broadcast(total)).select("predicted_label", "n", "mean_confidence", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"))


def confidence_histogram(preds: DataFrame) -> DataFrame:
    """Cumulative: rows at or above each tenth; one pass, then nine rows."""
    ok = F.col("confidence").between(0.0, 1.0)
    counts = preds.agg(*[F.count_if(ok & (F.col("confidence") >= k / 10)).alias(f"c{k}") for k in range(1, 10)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f">0.{k}").alias("bin"), F.col(f"c{k}").alias("n")) for k in range(1, 10)])).alias("e")).select("e.*")


def keep_first(preds: DataFrame, keys: tuple[str, ...] = ("repo_url", "filepath"), order: str = "ord") -> DataFrame:
    """The first row of each key by order, without a window: one struct a key through the shuffle."""
    rest = [c for c in preds.columns if c not in keys]
    first = preds.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return first.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def api_stats(preds: DataFrame, layer: Column) -> DataFrame:
    ok = F.when(F.col("confidence").between(0.0, 1.0), F.col("confidence"))
    return preds.groupBy(layer.alias("layer")).agg(F.count(F.lit(1)).alias("n_files"), S.half_up(F.avg(ok) * 100).cast("bigint").alias("mean_percent"))
