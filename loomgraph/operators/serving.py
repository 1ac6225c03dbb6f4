"""Answers for a file-map front end over predicted edges and file predictions.

Predicted edges: source_filepath, target_filepath, edge_exists_prob, predicted_types (array), type_probs (map).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import rollups, skew

ENDS = ("source_filepath", "target_filepath")


def of_type(edges: DataFrame, edge_type: str | None) -> DataFrame:
    """src, dst and weight p of the edges predicted to be of a type (of all edges without one)."""
    kept = edges if edge_type is None else edges.where(F.array_contains("predicted_types", edge_type))
    weight = S.edge_weight(F.col("type_probs"), edge_type or "", F.col("edge_exists_prob"))
    return kept.select(F.col(ENDS[0]).alias("src"), F.col(ENDS[1]).alias("dst"), weight.alias("p"), "type_probs")


def secondary(type_probs: Column, edge_type: str) -> Column:
    """The probabilities of the other types."""
    return F.map_filter(type_probs, lambda k, _: k != edge_type)


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(*ENDS)).alias("path")).distinct()


def report(edges: DataFrame, predictions: DataFrame) -> DataFrame:
    """(section, name, value): totals, mean confidence in percent, files by label, edges by type.

    A confidence that is null or no probability counts as 0; a missing label counts as 'other'.
    """
    conf = F.coalesce(skew.usable(F.col("confidence")), F.lit(0.0))
    label = F.when(F.col("predicted_label") != "", F.col("predicted_label"))
    n = F.count(F.lit(1))
    files = predictions.agg(n.alias("totalFiles"), F.when(n > 0, S.half_up(F.sum(conf) / n * 100)).otherwise(F.lit(0)).cast("bigint").alias("avgConfidence"))
    one = files.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in files.columns])).alias("e")).select(F.lit("total").alias("section"), "e.*")
    total = edges.agg(n.alias("value")).select(F.lit("total").alias("section"), F.lit("totalEdges").alias("name"), "value")
    labels = predictions.groupBy(F.coalesce(label, F.lit("other")).alias("name")).agg(n.alias("value")).select(F.lit("label").alias("section"), "name", "value")
    types = edges.select(F.explode("predicted_types").alias("name")).groupBy("name").agg(n.alias("value")).select(F.lit("type").alias("section"), "name", "value")
    return one.unionByName(total).unionByName(labels).unionByName(types)


def files_per_layer(edges: DataFrame, layer: Column) -> DataFrame:
    """(layer, n_files) over the files at the ends of edges; layer: a column of `path`."""
    return endpoints(edges).groupBy(layer.alias("layer")).agg(F.count(F.lit(1)).alias("n_files"))


def file_total(edges: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: the predicted files, or without any the files at the ends of edges."""
    p = predictions.agg(F.count(F.lit(1)).alias("p"))
    e = endpoints(edges).agg(F.count(F.lit(1)).alias("e"))
    return p.join(F.broadcast(e)).select(F.when(F.col("p") > 0, F.col("p")).otherwise(F.col("e")).alias("n_files"))  # one row each


def layer_links(edges: DataFrame, layers: DataFrame, layer: str, edge_type: str | None = None, k: int = 2) -> DataFrame:
    """(src, dst, p, rank): a layer's strongest links, k a source, of layers(path, layer). Ties by target."""
    inside = layers.where(F.col("layer") == layer).select("path")
    e = of_type(edges, edge_type).drop("type_probs")
    e = e.join(inside.withColumnRenamed("path", "src"), "src", "left_semi").join(inside.withColumnRenamed("path", "dst"), "dst", "left_semi")
    return rollups.top_k_per_source(e, k, "p", ("dst",))


def layer_files(links: DataFrame) -> DataFrame:
    """(id, name, degree) of the files on links: base name and number of link ends."""
    return rollups.endpoint_degree(links).select("id", F.element_at(F.split("id", "/"), -1).alias("name"), "degree")


#: Colours of starts and ends, and of the node types of the four views.
ROLE_COLOUR = {"start": "limegreen", "end": "tomato"}
#: Marks before the labels of starts and ends.
ROLE_MARK = {"start": "▶ ", "end": "■ "}


def display_label(name: Column, seq: Column, role: Column) -> Column:
    mark = F.coalesce(F.try_element_at(S.literal_map(ROLE_MARK), role), F.lit(""))
    return F.concat(mark, F.lit("["), seq.cast("string"), F.lit("] "), name.cast("string"))


def node_colour(role: Column, kind: Column | None = None, colours: dict[str, str] | None = None, default: str = "orange") -> Column:
    """Role colours first, else the node type's colour."""
    base = F.coalesce(F.try_element_at(S.literal_map(colours), kind), F.lit(default)) if colours and kind is not None else F.lit(default)
    return F.coalesce(F.try_element_at(S.literal_map(ROLE_COLOUR), role), base)


def drawn_nodes(degrees: DataFrame, sequence: DataFrame) -> DataFrame:
    """(id, seq, role, label, colour) of degrees(id, role, ..) and sequence(id, seq)."""
    return degrees.join(sequence, "id").select("id", "seq", "role", display_label(F.col("id"), F.col("seq"), F.col("role")).alias("label"), node_colour(F.col("role")).alias("colour"))


def ranked_subsample(rows: DataFrame, key: str, share: float = 0.6, seed: str = "42") -> DataFrame:
    """Exactly floor(share * n) rows by hash order: ranks in two levels, a bucket's own and the buckets before it."""
    h = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))).withColumn("_b", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))
    cells = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))  # at most 256 rows
    off = cells.select("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"), F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    off = off.where(F.col("_off") < F.floor(F.col("_n") * share))
    r = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) + F.col("_off")
    return h.join(F.broadcast(off), "_b").withColumn("_r", r).where(F.col("_r") <= F.floor(F.col("_n") * share)).drop("_h", "_b", "_off", "_n", "_r")


def labelled_nodes(files: DataFrame, predictions: DataFrame, keys: tuple[str, ...] = ("repo_url", "filepath"), least: float = 0.3) -> DataFrame:
    """files with the label of their first prediction; null if there is none or it is below the confidence."""
    first = rollups.keep_first(predictions.where(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull()), keys)
    ok = skew.usable(F.col("confidence")) >= least
    return files.join(first.select(*keys, F.when(ok, F.col("predicted_label")).alias("node_label")), list(keys), "left")
