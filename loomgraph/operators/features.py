"""Node features of the graph: 76 columns in a fixed order.

7 structural, 12 edge counts by type and direction, 4 of the path, 21 one-hot (type, language, analysed), 32 of the
hashed tokens of label and path.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from loomgraph.functions import scalars as S
from loomgraph.operators import graph
from loomgraph.session import cut

#: Fixed names and order.
STRUCTURAL = ["in_degree", "out_degree", "total_degree", "pagerank", "betweenness", "closeness", "clustering"]
COUNTS = [f"{d}{t}" for d in ("out_", "in_") for t in S.EDGE_TYPES]
PATH = ["path_depth", "is_root", "parent_folder_hash", "extension_hash"]
CATEGORICAL = [f"type_{t}" for t in S.NODE_TYPES] + [f"lang_{x}" for x in S.FEATURE_LANGUAGES] + ["analysed"]
EMBEDDING = [f"embed_{i}" for i in range(S.EMBED_DIM)]
NAMES = STRUCTURAL + COUNTS + PATH + CATEGORICAL + EMBEDDING


def categorical(kind: Column, language: Column, analysed: Column) -> Column:
    """21 numbers: one-hot node type and language, whether it was analysed."""
    kind, language = F.coalesce(kind, F.lit("")), F.coalesce(language, F.lit(""))
    return F.concat(S.one_hot(kind, S.NODE_TYPES), S.one_hot(language, S.FEATURE_LANGUAGES), F.array(F.coalesce(analysed, F.lit(False)).cast("double")))


_PARTS = re.compile(r"[/_.\s]+")
_PLACES: dict[str, tuple[int, float]] = {}


def _place(token: str) -> tuple[int, float]:
    """(entry, sign) of a token, by the last byte of its md5; remembered by the worker."""
    got = _PLACES.get(token)
    if got is None:
        if len(_PLACES) > 500_000:
            _PLACES.clear()
        v = hashlib.md5(token.encode("utf-8", "surrogatepass")).digest()[-1]
        got = _PLACES[token] = v % S.EMBED_DIM, 1.0 if v // S.EMBED_DIM % 2 == 0 else -1.0
    return got


def _vectors(texts: pd.Series) -> np.ndarray:
    out = np.zeros((len(texts), S.EMBED_DIM))
    for row, text in zip(out, texts, strict=True):
        for t in _PARTS.split(text.lower()) if text else ():
            if t:
                i, sign = _place(t)
                row[i] += sign
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1.0)


def _embedded(texts: pd.Series) -> pd.Series:
    return pd.Series(list(_vectors(texts)))


def embedding(text: Column) -> Column:
    """The hashed token vector of a text, of length 1 (zeros without tokens).

    In Arrow batches: the same sums over nested arrays in SQL took fifty times as long.
    """
    return F.pandas_udf(_embedded, ArrayType(DoubleType()))(text)


def static(nodes: DataFrame) -> DataFrame:
    """(id, x) with the 57 features that need no edges, of nodes(id, type, label, filepath, language, analysed)."""
    path = F.coalesce("filepath", F.lit(""))
    of_path = S.path_features(path)
    text = F.concat_ws(" ", F.coalesce("label", F.lit("")), path)
    return nodes.select("id", F.concat(F.array(*[c.cast("double") for c in of_path]), categorical(F.col("type"), F.col("language"), F.col("analysed")), embedding(text)).alias("x"))


#: Of a node without edges: entries of the path, the categories and the text.
STATIC = len(PATH) + len(CATEGORICAL) + len(EMBEDDING)
_FOLDED: dict[tuple[str, int], float] = {}


def _folded(text: str, m: int) -> float:
    """The md5 of a text modulo m as a share of m; remembered by the worker."""
    got = _FOLDED.get((text, m))
    if got is None:
        if len(_FOLDED) > 500_000:
            _FOLDED.clear()
        got = _FOLDED[text, m] = round(int(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest(), 16) % m / m, 6)
    return got


def _rows(depth: pd.Series, parent: pd.Series, extension: pd.Series, kind: pd.Series, language: pd.Series, analysed: pd.Series, text: pd.Series) -> pd.Series:
    out = np.zeros((len(depth), STATIC))
    out[:, 0], out[:, 1] = depth, depth == 0
    out[:, 2], out[:, 3] = [_folded(t, 997) for t in parent], [_folded(t, 101) for t in extension]
    at = len(PATH)
    for values, vocab in ((kind, S.NODE_TYPES), (language, S.FEATURE_LANGUAGES)):
        place = {v: i for i, v in enumerate(vocab)}
        told = np.array([place.get(v, -1) for v in values], np.int64)
        out[np.flatnonzero(told >= 0), at + told[told >= 0]] = 1.0
        at += len(vocab)
    out[:, at], out[:, at + 1 :] = analysed, _vectors(text)
    return pd.Series([r.tobytes() for r in out])


def static_bytes(nodes: DataFrame) -> DataFrame:
    """(id, row): the numbers of static() as the bytes of their doubles.

    Made in one pass over a few short columns: no array a node, and a folder's hash is made once.
    """
    path = F.coalesce("filepath", F.lit(""))
    text = F.concat_ws(" ", F.coalesce("label", F.lit("")), path)
    kind, language = (S.bucket(F.coalesce(c, F.lit("")), vocab) for c, vocab in ((F.col("type"), S.NODE_TYPES), (F.col("language"), S.FEATURE_LANGUAGES)))
    row = F.pandas_udf(_rows, "binary")
    return nodes.select("id", row(S.path_features(path)[0], S.parent_dir(path), F.ltrim(S.file_ext(path), F.lit(".")), kind, language, F.coalesce("analysed", F.lit(False)), text).alias("row"))


def counted(edges: DataFrame) -> DataFrame:
    """(id, x) with the 12 edge counts of the nodes on edges(src, dst, type)."""
    c = graph.type_counts(edges)
    return c.select("id", F.array(*[F.col(n).cast("double") for n in COUNTS]).alias("x"))


def structural(edges: DataFrame) -> DataFrame:
    """(id, x) with the 7 structural features of the nodes on edges."""
    d, c = graph.degrees(edges), graph.clustering(edges).select("id", "clustering")
    p, b = graph.pagerank(edges), graph.shortest_path_measures(edges)
    j = d.join(p, "id").join(b, "id").join(c, "id", "left")
    return j.select("id", F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in ("in_degree", "out_degree", "total_degree", "rank", "betweenness", "closeness", "clustering")]).alias("x"))


def assemble(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, x): the 76 features of every node; edges(source, target, type) with an end that is no node are left out.

    A node without edges has zeros in the first 19.
    """
    ids = nodes.select("id").distinct()
    e = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), "type")
    e = cut(e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    s, c = structural(e).withColumnRenamed("x", "s"), counted(e).withColumnRenamed("x", "c")
    j = static(nodes).join(s, "id", "left").join(c, "id", "left")
    return j.select("id", F.concat(F.coalesce("s", zeros(len(STRUCTURAL))), F.coalesce("c", zeros(len(COUNTS))), "x").alias("x"))
