"""Fitted models over node features: role labels, edges and their types, and the scoring of a graph end to end.

Logistic regressions stand in for the neural encoder and heads: an analogue with the same inputs, outputs and
metrics, not the same numbers. The encoder is one aggregation layer (own features beside the mean of the
neighbours'), a pair is described by both ends and their product.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import arrays, graph, pairs, splits
from loomgraph.session import cut, parallelism

TYPES = ("CALLS", "FLOWS_TO")
#: Of how many scored pairs the best are kept (the size of a result file).
TOP = 1_000


def _width(x: DataFrame) -> int:
    first = x.select(F.size("x").alias("n")).first()
    return first.n if first else 0


def encode(x: DataFrame, edges: DataFrame, aggregate: str = "mean") -> DataFrame:
    """(id, x): own features beside an aggregate of the sources' along edges(src, dst).

    mean: the plain mean; degree: each source's vector divided by the root of both ends' degrees; none: own only.
    """
    if aggregate == "none":
        return x
    width = _width(x)
    if aggregate == "mean":
        m = graph.mean_neighbours(edges, x, width)
        return m.select("id", F.concat("x", "neigh").alias("x"))
    out, into = edges.groupBy("src").agg(F.count(F.lit(1)).alias("do")), edges.groupBy("dst").agg(F.count(F.lit(1)).alias("di"))
    w = 1 / F.sqrt(F.col("do") * F.col("di"))
    sent = edges.join(out, "src").join(into, "dst").join(x.select(F.col("id").alias("src"), "x"), "src").select(F.col("dst").alias("id"), w.alias("w"), "x")
    total = sent.groupBy("id").agg(*[F.sum(F.col("w") * F.col("x")[k]).alias(f"s{k}") for k in range(width)])
    total = total.select("id", F.array(*[F.coalesce(F.col(f"s{k}"), F.lit(0.0)) for k in range(width)]).alias("n"))
    return x.join(total, "id", "left").select("id", F.concat("x", F.coalesce("n", F.array_repeat(F.lit(0.0), width))).alias("x"))


class Constant:
    """Stands for a model where the training rows have one class only."""

    def __init__(self, p: float):
        self.p = p


def fit_binary(rows: DataFrame, label: str, rounds: int = 50, most: float = 20.0) -> LogisticRegressionModel | Constant:
    """Logistic regression of a boolean label on x; positives weigh negatives / positives, at most `most` times."""
    n = rows.agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q")).first()
    if not n.p or not n.q:
        return Constant(float(bool(n.p)))
    w = min(most, max(1, n.q) / max(1, n.p))
    data = rows.select(array_to_vector("x").alias("features"), F.col(label).cast("double").alias("label"), F.when(F.col(label), w).otherwise(1.0).alias("weight"))
    return LogisticRegression(maxIter=rounds, regParam=1e-3, weightCol="weight").fit(data)


def score(rows: DataFrame, fitted: dict[str, LogisticRegressionModel | Constant]) -> DataFrame:
    """rows(x, ..) without x, with one probability column a model: dense dot products, JVM-side."""
    out = rows.withColumn("_f", array_to_vector("x"))
    for i, (name, m) in enumerate(fitted.items()):
        if isinstance(m, Constant):
            out = out.withColumn(name, F.lit(m.p))
            continue
        told = m.copy().setFeaturesCol("_f").setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_l{i}")
        out = told.transform(out).withColumn(name, vector_to_array(f"_p{i}")[1]).drop(f"_p{i}", f"_r{i}", f"_l{i}")
    return out.drop("_f", "x")


def encoded(x: DataFrame | pairs.Vectors, edges: DataFrame | arrays.Packed, whole: arrays.Whole | None = None) -> pairs.Vectors:
    """encode(x, edges, "mean") as shared arrays: no vector an edge. Packed edges need the whole numbers of x's index."""
    own = x if isinstance(x, pairs.Vectors) else pairs.Vectors.of(x)
    z = own.with_means(edges, parallelism(own.index.by.sparkSession), whole)
    own.parts[0].close()  # z has its rows
    return z


def type_flags(has) -> Column:
    """An edge as a number: 1, and a bit for each of TYPES for which has(type) holds."""
    return sum((F.when(has(t), 2 << i).otherwise(0) for i, t in enumerate(TYPES)), F.lit(1))


def fit_edges(z: DataFrame | pairs.Vectors, typed: DataFrame, rounds: int = 50) -> dict[str, pairs.Linear | Constant]:
    """Models of an edge's existence and of each of its TYPES from typed(src, dst, types) and as many negative pairs.

    typed may hold the numbers of its ends and its type_flags instead: (a, b, flags), without loops.
    """
    v = z if isinstance(z, pairs.Vectors) else pairs.Vectors.of(z)
    if "flags" in typed.columns:
        pos = typed.select("a", "b", "flags")
    else:
        flags = type_flags(lambda t: F.array_contains("types", t))
        pos = cut(typed.where("src <> dst").select(v.index.of("src").alias("a"), v.index.of("dst").alias("b"), F.coalesce(flags, F.lit(1)).alias("flags")))
    written = pairs.training(pos, pos.count(), v.index.n, 4 * typed.sparkSession.sparkContext.defaultParallelism)
    found = pairs.fit(written, v, {"exists": (1, 0)} | {t: (2 << i, 1) for i, t in enumerate(TYPES)}, rounds, 20.0, 1e-3)
    return {t: m if isinstance(m, pairs.Linear) else Constant(m) for t, m in found.items()}


def _told(at: DataFrame, v: pairs.Vectors, models: dict) -> DataFrame:
    """at(a, b, ..) with a probability a model."""
    linear = {t: m for t, m in models.items() if isinstance(m, pairs.Linear)}
    own = at.columns
    if linear:
        at = at.withColumn("_p", pairs.probability(linear, v, "a", "b"))
    return at.select(*own, *[F.col(f"_p.{t}").alias(t) if t in linear else F.lit(m.p).alias(t) for t, m in models.items()])


def _scored(rows: DataFrame, z: DataFrame | pairs.Vectors, models: dict) -> DataFrame:
    """rows(src, dst) whose ends have vectors, with a probability a model."""
    v = z if isinstance(z, pairs.Vectors) else pairs.Vectors.of(z)
    at = cut(rows.select("src", "dst", v.index.of("src").alias("a"), v.index.of("dst").alias("b")).where("a >= 0 AND b >= 0"))
    return _told(at, v, models).drop("a", "b")


def _surest(groups: DataFrame, edges: DataFrame | None, z: DataFrame | pairs.Vectors, models: dict, exists: float, top: int) -> DataFrame:
    """_scored() of the `top` surest pairs within groups(id, grp) that are none of edges(src, dst)."""
    v, of = z if isinstance(z, pairs.Vectors) else pairs.Vectors.of(z), models["exists"]
    at = cut(pairs.surest(groups, edges, v, of if isinstance(of, pairs.Linear) else of.p, exists, top).withColumnRenamed("p", "exists"))
    return _told(at, v, {t: m for t, m in models.items() if t != "exists"}).drop("a", "b")


def score_graph(nodes: DataFrame, edges: DataFrame, z: DataFrame | pairs.Vectors, models: dict, groups: DataFrame, mode: str = "new", exists: float = 0.5, typed: float = 0.5, top: int | None = TOP, most: int | None = None) -> DataFrame:
    """Predicted edges between files: candidates, probabilities, types above the threshold, the `top` surest.

    nodes: id, filepath; edges(src, dst): file pairs known; groups(id, grp): candidates are made within a group. All of
    them are scored, unless the caller names how many at `most` (the first by a hash).
    Columns: source_id, target_id, source_filepath, target_filepath, edge_exists_prob, predicted_types, type_probs.
    """
    if most:
        p = _scored(graph.capped_candidates(groups, edges, most, mode), z, models)
    elif top and mode != "existing":
        p = _surest(groups.join(nodes.select("id"), "id", "left_semi"), edges if mode == "new" else None, z, models, exists, top)
    else:
        p = _scored(graph.candidate_pairs(groups, edges, mode, groups), z, models)
    p = p.select("src", "dst", F.col("exists").alias("p"), *[F.round(t, 4).alias(t) for t in TYPES]).where(F.col("p") >= exists)
    names = nodes.select("id", F.coalesce("filepath", "id").alias("path"))
    j = p.join(names.select(F.col("id").alias("src"), F.col("path").alias("source_filepath")), "src").join(names.select(F.col("id").alias("dst"), F.col("path").alias("target_filepath")), "dst")
    chosen = F.filter(F.array(*[F.when(F.col(t) >= typed, F.lit(t)) for t in TYPES]), lambda t: t.isNotNull())
    probs = F.create_map(*[v for t in TYPES for v in (F.lit(t), F.col(t))])
    out = j.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "source_filepath", "target_filepath", F.round("p", 4).alias("edge_exists_prob"), chosen.alias("predicted_types"), probs.alias("type_probs"))
    return out.orderBy(F.desc("edge_exists_prob"), "source_id", "target_id").limit(top) if top else out


def fit_roles(rows: DataFrame, label: str, labels: list[str], rounds: int = 50) -> dict[str, LogisticRegressionModel | Constant]:
    """One model a label against the rest, over rows(x, label)."""
    return {lab: fit_binary(rows.withColumn("is", F.coalesce(F.col(label) == lab, F.lit(False))), "is", rounds) for lab in labels}


def predict_roles(rows: DataFrame, models: dict) -> DataFrame:
    """rows without x, with predicted_label, confidence and is_confident: the label of the highest probability, ties by label order."""
    entries = F.array(*[F.struct(F.round(f"_m{i}", 4).alias("c"), F.lit(-i).alias("tie"), F.lit(lab).alias("label")) for i, lab in enumerate(models)])
    top = F.sort_array(entries, asc=False)[0]
    told = score(rows, {f"_m{i}": m for i, m in enumerate(models.values())})
    return told.withColumn("_t", top).drop(*[f"_m{i}" for i in range(len(models))]).withColumns({"predicted_label": F.col("_t.label"), "confidence": F.col("_t.c"), "is_confident": F.col("_t.c") >= 0.5}).drop("_t")


def compare_encoders(x: DataFrame, edges: DataFrame, labelled: DataFrame, labels: list[str], kinds: tuple[str, ...] = ("none", "mean", "degree"), rounds: int = 20) -> DataFrame:
    """(encoder, accuracy, macro_f1, ..) of role models on the held-out rows of labelled(id, label, split)."""
    out = None
    for kind in kinds:
        rows = cut(encode(x, edges, kind).join(labelled, "id"))
        models = fit_roles(rows.where("split = 'train'"), "label", labels, rounds)
        m = splits.overall(predict_roles(rows.where("split <> 'train'"), models), "label", "predicted_label").select(F.lit(kind).alias("encoder"), "*")
        out = m if out is None else out.unionByName(m)
    return out

