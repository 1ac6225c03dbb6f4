"""Graph operators over edges(src, dst, type, p): degrees, PageRank, clustering, distances, sampling, candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import digests
from loomgraph.functions import scalars as S
from loomgraph.session import cut, parallelism


def simple(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def node_ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, total_degree, role) on the simple digraph."""
    s = simple(edges)
    ends = s.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    d = ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return d.select("id", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("total_degree"), S.node_role(F.col("in_degree"), F.col("out_degree")).alias("role"))


def type_counts(edges: DataFrame, vocab: list[str] = S.EDGE_TYPES) -> DataFrame:
    """(id, in_<type>.., out_<type>..): incident edges by type bucket on the multigraph."""
    b = S.bucket(F.col("type"), vocab)
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit("out_").alias("d")), F.struct(F.col("dst").alias("id"), F.lit("in_").alias("d")))).alias("e"), b.alias("b"))
    keyed = ends.select("e.id", F.concat("e.d", "b").alias("k"))
    return keyed.groupBy("id").pivot("k", [f"{d}{t}" for d in ("in_", "out_") for t in vocab]).count().na.fill(0)


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 200, tolerance: float | None = 1e-6) -> DataFrame:
    """(id, rank) by power iteration with dangling mass, on the simple digraph; stops at an L1 change of n * tolerance.

    Every round is written out, so plans do not grow; of a round the driver sees two sums, the moved and the
    dangling mass. Empty edges give no rows.
    """
    s = simple(edges)
    out = s.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    links = cut(s.join(out, "src").select("src", "dst", "deg"))
    n = node_ids(edges).count()
    ranks = cut(node_ids(edges).join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("deg").isNull().alias("dangling"), F.lit(1.0 / max(1, n)).alias("rank")))
    lost = ranks.where("dangling").count() / max(1, n)
    for _ in range(rounds if n else 0):
        sent = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        new = (1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + lost / n)
        step = cut(ranks.join(sent, "id", "left").select("id", "dangling", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")))
        moved, lost = step.agg(F.sum("moved"), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))).first()
        ranks = step.select("id", "dangling", "rank")
        if tolerance is not None and moved < n * tolerance:
            break
    return ranks.select("id", "rank")


def clustering(edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, clustering) of the undirected simple graph without loops."""
    und = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    deg = und.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    # each edge is owned by its end of lower degree: wedges open at low-degree nodes only
    d = deg.select(F.col("id"), F.struct("degree", "id").alias("r"))
    ranked = und.join(d.select(F.col("id").alias("u"), F.col("r").alias("ru")), "u").join(d.select(F.col("id").alias("v"), F.col("r").alias("rv")), "v")
    own = ranked.select(F.when(F.col("ru") < F.col("rv"), F.col("u")).otherwise(F.col("v")).alias("a"), F.when(F.col("ru") < F.col("rv"), F.col("v")).otherwise(F.col("u")).alias("b"))
    x, y = own.select("a", F.col("b").alias("b1")), own.select("a", F.col("b").alias("b2"))
    wedge = x.join(y, "a").where("b1 < b2")
    tri = wedge.join(und.select(F.col("u").alias("b1"), F.col("v").alias("b2")), ["b1", "b2"]).select(F.explode(F.array("a", "b1", "b2")).alias("id"))
    t = tri.groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return deg.join(t, "id", "left").na.fill(0, ["triangles"]).withColumn("clustering", F.round(F.when(pairs > 0, F.col("triangles") / pairs).otherwise(0.0), 6))


#: Sources of betweenness that are summed side by side at most, and so many numbers of nodes.
SIDE_BY_SIDE, NODE_NUMBERS = 64, 8_000_000
#: Sources of one breadth-first search for closeness are bits of words: so many words at most, and so many words of nodes. Links looked at at once.
SOURCE_WORDS, NODE_WORDS, LINKS_AT_ONCE = 16, 4_000_000, 1 << 18


def _packed(links: DataFrame, key: str, other: str, n: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends): the other ends of links(key, other) by their key 0..n-1; they reach the driver in key order, a partition at a time."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": [b[key].to_numpy(np.int32).tobytes()], "o": [b[other].to_numpy(np.int32).tobytes()]})

    degree, ends, at = np.zeros(n + 1, np.int64), np.empty(count, np.int32), 0
    for r in links.repartitionByRange(key).sortWithinPartitions(key, other).mapInPandas(pack, "k binary, o binary").toLocalIterator(prefetchPartitions=True):
        k, o = np.frombuffer(r.k, np.int32), np.frombuffer(r.o, np.int32)
        ids, n_of = np.unique(k, return_counts=True)
        degree[ids + 1] += n_of
        ends[at : at + len(o)] = o
        at += len(o)
    return np.cumsum(degree), ends


def _links_of(nodes: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position in nodes, other end) of the links of nodes in their order, at most so many at a time, be they of one node."""
    count = starts[nodes + 1] - starts[nodes]
    upto = np.cumsum(count)
    shift = starts[nodes] - (upto - count)
    total = int(upto[-1]) if len(upto) else 0
    for lo in range(0, total, most):
        hi = min(lo + most, total)
        first, last = np.searchsorted(upto, (lo, hi - 1), "right")
        part = np.minimum(upto[first : last + 1], hi) - np.maximum(upto[first : last + 1] - count[first : last + 1], lo)
        yield np.repeat(np.arange(first, last + 1), part), ends[np.arange(lo, hi) + np.repeat(shift[first : last + 1], part)]


def _run_sums(x: np.ndarray, a: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of runs of one key, and the sums of x[a] of each run."""
    from loomgraph.operators import arrays  # it needs this module

    lo = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[lo], arrays._sums(x, a, np.diff(np.r_[lo, len(key)]))


def _dependencies(src: np.ndarray, out_of: tuple[np.ndarray, np.ndarray], into: tuple[np.ndarray, np.ndarray], most: int) -> np.ndarray:
    """Brandes' dependencies of all nodes, summed over distinct sources; a column a source, so a link is looked up once for all."""
    (at, to), (at_in, from_) = out_of, into
    n, own = len(at) - 1, np.arange(len(src))
    dist, sigma, got = np.full((n, len(src)), -1, np.int32), np.zeros((n, len(src))), np.zeros((n, len(src)))
    dist[src, own], sigma[src, own] = 0, 1.0
    reached, layers, sent = np.sort(src), [], np.zeros((n, len(src)))
    while len(reached):
        front = np.where(dist[reached] == len(layers), sigma[reached], 0.0)
        layers.append(reached)
        near = [reached[:0]]
        # many links leave the reached nodes: those that some source has not found look at their own incoming ones, in order, else theirs are sorted
        leaving = (at[reached + 1] - at[reached]).sum()
        left = np.flatnonzero((dist < 0).any(axis=1)) if 4 * leaving > len(to) else None
        if left is not None and 2 * leaving > (at_in[left + 1] - at_in[left]).sum():
            sent[reached] = front
            for k, u in _links_of(left, at_in, from_, most):
                w, total = _run_sums(sent, u, left[k])
                got[w] += total
                near.append(w)
            sent[reached] = 0
        else:
            for k, w in _links_of(reached, at, to, most):
                order = np.argsort(w, kind="stable")
                w, total = _run_sums(front, k[order], w[order])
                got[w] += total
                near.append(w.astype(np.int64))
        near = np.unique(np.concatenate(near))
        total, far = got[near], dist[near]
        new = (total > 0) & (far < 0)
        got[near] = 0
        dist[near], sigma[near] = np.where(new, len(layers), far), np.where(new, total, sigma[near])
        reached = near[new.any(axis=1)]
    delta, share = got, sent
    for layer in range(len(layers) - 1, 0, -1):
        up, low = layers[layer - 1], layers[layer]
        on = dist[low] == layer
        share[low] = np.divide(1 + delta[low], sigma[low], out=np.zeros(on.shape), where=on)
        for k, w in _links_of(up, at, to, most):
            u, total = _run_sums(share, w, up[k])
            delta[u] += np.where(dist[u] == layer - 1, sigma[u] * total, 0.0)
        share[low] = 0
    delta[src, own] = 0
    return delta.sum(axis=1)


def shortest_path_measures(edges: DataFrame, exact: int | None = None, sources: int = 500, at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """(id, betweenness, closeness): Brandes' accumulation from every source, sources spread over the tasks.

    Betweenness is normalised by (n-1)(n-2). It is exact whatever the size, unless the caller names a number of nodes
    (exact) beyond which so many sampled sources will do; it is then scaled by n / sources. Closeness uses the incoming
    distances from every node, with the size correction. A worker holds the links twice, by either end, in four bytes
    each, and looks at at_once of them at a time.
    """
    s = cut(simple(edges).where("src <> dst"))
    links = s.count()
    dense = cut(dense_index(node_ids(edges)).withColumnRenamed("idx", "i"))
    n = dense.count()
    a, b = dense.select(F.col("id").alias("src"), F.col("i").cast("int").alias("a")), dense.select(F.col("id").alias("dst"), F.col("i").cast("int").alias("b"))
    numbers = cut(s.join(a, "src").join(b, "dst").select("a", "b"))
    spark = edges.sparkSession
    packed = _packed(numbers, "a", "b", n, links)
    out_of = spark.sparkContext.broadcast(packed)
    into = spark.sparkContext.broadcast(_packed(numbers, "b", "a", n, links))
    chosen = np.arange(n) if exact is None or n <= exact else np.random.default_rng(42).choice(n, min(n, sources), replace=False)
    scale = n / max(1, len(chosen))
    chosen = chosen[np.diff(packed[0])[chosen] > 0]  # no path leaves the others
    wide = max(1, min(SIDE_BY_SIDE, NODE_NUMBERS // max(1, n)))

    def brandes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        between = np.zeros(n)
        for b in batches:
            every = b["s"].to_numpy()
            for lo in range(0, len(every), wide):
                between += _dependencies(every[lo : lo + wide], out_of.value, into.value, at_once)
        keep = np.flatnonzero(between > 0)
        yield pd.DataFrame({"i": keep, "b": between[keep]})

    words = max(1, min(SOURCE_WORDS, NODE_WORDS // max(1, n)))
    searches = -(-n // (64 * words))

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (at, to), (at_in, from_) = out_of.value, into.value
        every = np.arange(n)
        dist_in, seen_from = np.zeros(n, np.int64), np.zeros(n, np.int64)
        front, got = np.zeros((n, words), np.uint64), np.zeros((n, words), np.uint64)
        for b in batches:
            for first in b["k"] * 64 * words:
                src = np.arange(first, min(n, first + 64 * words))
                seen = np.zeros((n, words), np.uint64)
                seen[src, (src - first) // 64] = np.uint64(1) << ((src - first) % 64).astype(np.uint64)
                reached, bits, level = src, seen[src], 0
                while len(reached):
                    level += 1
                    front[reached], near = bits, [reached[:0]]
                    # many links leave the reached nodes: every node looks at its own incoming ones, in order, else theirs are sorted
                    if 4 * (at[reached + 1] - at[reached]).sum() > len(to):
                        for k, u in _links_of(every, at_in, from_, at_once):
                            lo = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                            got[k[lo]] |= np.bitwise_or.reduceat(front[u], lo, axis=0)
                            near.append(k[lo])
                    else:
                        for k, w in _links_of(reached, at, to, at_once):
                            order = np.argsort(w, kind="stable")
                            w = w[order]
                            lo = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                            got[w[lo]] |= np.bitwise_or.reduceat(bits[k[order]], lo, axis=0)
                            near.append(w[lo].astype(np.int64))
                    front[reached] = 0
                    reached = np.unique(np.concatenate(near))
                    bits = got[reached] & ~seen[reached]
                    got[reached] = 0
                    new = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
                    reached, bits, new = reached[new > 0], bits[new > 0], new[new > 0]
                    seen[reached] |= bits
                    dist_in[reached] += level * new
                    seen_from[reached] += new
        keep = np.flatnonzero(seen_from)
        yield pd.DataFrame({"i": keep, "d": dist_in[keep], "r": seen_from[keep]})

    tasks = spark.createDataFrame(pd.DataFrame({"s": chosen})).repartition(min(len(chosen) or 1, 4 * spark.sparkContext.defaultParallelism))
    part = tasks.mapInPandas(brandes, "i bigint, b double").groupBy("i").agg(F.sum("b").alias("b"))
    every = spark.range(searches).withColumnRenamed("id", "k").repartition(min(searches or 1, 4 * spark.sparkContext.defaultParallelism))
    far = every.mapInPandas(distances, "i bigint, d bigint, r bigint").groupBy("i").agg(F.sum("d").alias("d"), F.sum("r").alias("r"))
    norm = scale / ((n - 1) * (n - 2)) if n > 2 else 0.0
    close = F.when(F.col("d") > 0, F.col("r") / F.col("d") * F.col("r") / max(1, n - 1)).otherwise(0.0)
    return dense.join(part, "i", "left").join(far, "i", "left").select("id", F.coalesce(F.col("b") * norm, F.lit(0.0)).alias("betweenness"), F.coalesce(close, F.lit(0.0)).alias("closeness"))


def dense_index(nodes: DataFrame, key: str = "id") -> DataFrame:
    """nodes with idx 0..n-1 in key order, numbered by range partition and offset: no single-task window."""
    ranged = cut(nodes.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).select(key, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    parts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_lo"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    off = parts.select("_p", "_lo", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return ranged.join(F.broadcast(off), "_p").select(key, (F.col("_m") - F.col("_lo") + F.col("_off")).alias("idx"))


def negatives(edges: DataFrame, count: int, seed: str = "neg", tries: int = 20, nodes: DataFrame | None = None) -> DataFrame:
    """At most `count` distinct pairs (src, dst), src <> dst, that are no edge, in the order of a hash.

    They are drawn from nodes(id), by default the nodes on edges.
    """
    idx = cut(dense_index(node_ids(edges) if nodes is None else nodes.select("id")))
    n = idx.count()
    if n < 2:
        return edges.select("src", "dst").limit(0)
    draws = edges.sparkSession.range(min(count * tries, count * 2 + 64)).select(F.col("id").alias("k"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("i"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("j"))
    a, b = idx.select(F.col("idx").alias("i"), F.col(idx.columns[0]).alias("src")), idx.select(F.col("idx").alias("j"), F.col(idx.columns[0]).alias("dst"))
    pairs = draws.where("i <> j").join(a, "i").join(b, "j").groupBy("src", "dst").agg(F.min("k").alias("k"))
    return pairs.join(simple(edges), ["src", "dst"], "left_anti").orderBy("k").limit(count).select("src", "dst")


def negative_draws(spark: SparkSession, count: int, n: int, seed: str = "neg", tries: int = 20) -> DataFrame:
    """(k, a, b): the draws of negative_numbers, loops left out, others with repetitions."""
    draws = spark.range(min(count * tries, count * 2 + 64)).select(F.col("id").alias("k"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("a"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("b"))
    return draws.where("a <> b")


def negative_numbers(edges: DataFrame, count: int, n: int, seed: str = "neg", tries: int = 20) -> DataFrame:
    """negatives() of edges(a, b) between nodes that are numbers 0..n-1 in id order: (a, b, k), k the number of the draw."""
    if n < 2:
        return edges.select("a", "b", F.lit(0).cast("bigint").alias("k")).limit(0)
    left = negative_draws(edges.sparkSession, count, n, seed, tries).groupBy("a", "b").agg(F.min("k").alias("k")).join(edges.select("a", "b"), ["a", "b"], "left_anti")
    return left.orderBy("k").limit(count)


#: The sources of a group are dealt to so many parts, each paired with the whole group: a large group is more than one task.
PARTS = 8


def _members(groups: DataFrame) -> DataFrame:
    """(id, grp, more) of groups(id, grp), once each; more: all groups of an id that has several."""
    every = groups.where("id IS NOT NULL AND grp IS NOT NULL").groupBy("id").agg(F.collect_set("grp").alias("every"))
    return every.select("id", F.explode("every").alias("grp"), F.when(F.size("every") > 1, F.col("every")).alias("more"))


def _known(members: DataFrame, existing: DataFrame) -> DataFrame:
    """(src, grp, known): the targets within a group that a source has an edge to."""
    kind = members.schema["id"].dataType
    e = existing.where("src <> dst").select("src", "dst").join(members.select(F.col("id").alias("src"), "grp"), "src")
    inside = e.join(members.select(F.col("id").alias("dst"), "grp"), ["dst", "grp"])
    return inside.groupBy(F.col("src").cast(kind).alias("src"), "grp").agg(F.collect_set(F.col("dst").cast(kind)).alias("known"))


def candidate_pairs(files: DataFrame, existing: DataFrame, mode: str = "new", partners: DataFrame | None = None) -> DataFrame:
    """Ordered pairs (src, dst) of files to score: 'existing' edges, or pairs of one group (partners: id, grp) without or with them.

    All ordered pairs of all files grow with the square; pairs are therefore made within a group (repository,
    module) that the caller bounds. No pair goes through a shuffle: a source carries its known targets, and a pair
    with several groups in common is made in the least of them.
    """
    if mode == "existing":
        return simple(existing).where("src <> dst")
    m = _members(partners if partners is not None else files)
    left = m.select(F.col("id").alias("src"), "grp", F.col("more").alias("_l"), F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("_part"))
    right = m.select(F.col("id").alias("dst"), "grp", F.col("more").alias("_r"), F.explode(F.array(*[F.lit(k) for k in range(PARTS)])).alias("_part"))
    if mode == "new":
        left = left.join(_known(m, existing), ["src", "grp"], "left")
    pairs = left.join(right, ["grp", "_part"]).where("src <> dst AND (_l IS NULL OR _r IS NULL OR array_min(array_intersect(_l, _r)) = grp)")
    return (pairs.where(F.col("known").isNull() | ~F.array_contains("known", F.col("dst"))) if mode == "new" else pairs).select("src", "dst")


def capped(pairs: DataFrame, most: int, seed: str = "cap") -> DataFrame:
    """At most `most` pairs in the order of a hash: a sample without replacement that is the same in every run."""
    h = F.md5(F.concat(F.lit(seed + "|"), F.col("src").cast("string"), F.lit(">"), F.col("dst").cast("string")))
    return pairs.orderBy(h, "src", "dst").limit(most)


#: Digests that are computed at once.
AT_ONCE = 32_768


def _low_pairs(members: DataFrame, low: int, seed: str) -> DataFrame:
    """(src, dst): the pairs of a group whose hash begins with at most `low` as a number of 32 bits."""
    kind = members.schema["id"].dataType.simpleString()
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")
    rows = members.select("id", "grp", F.col("id").cast("string").alias("text"), part.alias("mine"), F.explode(F.array(*[F.lit(k) for k in range(PARTS)])).alias("part"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        texts, own, sized = [t.encode() for t in b["text"]], (b["mine"] == b["part"]).to_numpy(), {}
        for i, t in enumerate(texts):
            sized.setdefault(len(t), []).append(i)
        alike = [(np.array(at), np.frombuffer(b"".join(texts[i] for i in at), np.uint8).reshape(len(at), k)) for k, at in sized.items()]
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, left in ((at[own[at]], m[own[at]]) for at, m in alike):
            for y, right in alike:
                for j in range(0, len(y), AT_ONCE):
                    some = right[j : j + AT_ONCE]
                    step = max(1, AT_ONCE // len(some))
                    for i in range(0, len(x), step):
                        hit = np.flatnonzero(digests.pair_heads(seed.encode() + b"|", left[i : i + step], b">", some) <= low)
                        src.append(x[i + hit // len(some)])
                        dst.append(y[j + hit % len(some)])
        u, v = np.concatenate(src), np.concatenate(dst)
        ids = b["id"]
        return pd.DataFrame({"src": ids.iloc[u[u != v]].to_numpy(), "dst": ids.iloc[v[u != v]].to_numpy()})

    # as many tasks as that: rows are few beside what is made of them
    return rows.repartition(parallelism(rows.sparkSession), "grp", "part").groupBy("grp", "part").applyInPandas(run, f"src {kind}, dst {kind}")


def capped_candidates(files: DataFrame, existing: DataFrame, most: int, mode: str = "new", seed: str = "cap") -> DataFrame:
    """capped(candidate_pairs(files, existing, mode), most, seed) for pairs of a group, without a row a pair.

    Hashes are spread evenly, so about as many as are asked for lie below a bound that the number of pairs gives;
    every pair is hashed where it is made and only those below go on. If they are too few the bound is doubled.
    """
    if mode == "existing":
        return capped(candidate_pairs(files, existing, mode), most, seed)
    m = cut(_members(files))
    total = m.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1))).first()[0] or 0.0
    low, every = int(min(1.0, (most + 6 * math.sqrt(most) + 16) / max(1.0, total)) * 2**32), 2**32 - 1
    while True:
        pairs = _low_pairs(m, min(low, every), seed).distinct()
        pairs = cut(pairs.join(existing.select("src", "dst"), ["src", "dst"], "left_anti") if mode == "new" else pairs)
        if low >= every or pairs.count() >= most:
            return capped(pairs, most, seed)
        low = 2 * low + 1


def topological_sequence(edges: DataFrame) -> DataFrame:
    """(id, seq_layer): Kahn layers; nodes on or behind a cycle get the layer -1.

    One table of nodes with their open in-degrees is written a layer; a round reads the links of the layer's nodes.
    """
    links = cut(simple(edges))
    into = links.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("open"))
    state = cut(node_ids(edges).join(into, "id", "left").select("id", F.coalesce("open", F.lit(0)).alias("open"), F.lit(-1).alias("seq_layer")))
    layer = 0
    while not state.where("open = 0 AND seq_layer < 0").isEmpty():
        ready = state.where("open = 0 AND seq_layer < 0").select(F.col("id").alias("src"))
        less = links.join(ready, "src").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("less"))
        now = F.when((F.col("open") == 0) & (F.col("seq_layer") < 0), F.lit(layer)).otherwise(F.col("seq_layer"))
        state = cut(state.join(less, "id", "left").select("id", (F.col("open") - F.coalesce("less", F.lit(0))).alias("open"), now.alias("seq_layer")))
        layer += 1
    return state.select("id", "seq_layer")


def sequence_numbers(edges: DataFrame) -> DataFrame:
    """(id, seq_layer, seq): seq from 1 by layer and id; in a graph with a cycle by in-degree and id, for every node."""
    layers = cut(topological_sequence(edges))
    if layers.where("seq_layer < 0").isEmpty():
        keyed = layers.withColumn("k", F.struct("seq_layer", "id"))
    else:
        got = simple(edges).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        keyed = layers.join(got, "id", "left").select("id", "seq_layer", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "id").alias("k"))
    numbered = dense_index(keyed, "k").select(F.col("k.id").alias("id"), (F.col("idx") + 1).alias("seq"))
    return layers.join(numbered, "id").select("id", "seq_layer", "seq")


def mean_neighbours(edges: DataFrame, features: DataFrame, width: int) -> DataFrame:
    """One aggregation layer: (id, x, neigh) with the mean of the incoming neighbours' vectors (bag of edges), zeros if none.

    Whole vectors are summed, so a row an edge and one a target goes through the shuffle, whatever the width.
    """
    sent = edges.join(features.select(F.col("id").alias("src"), F.col("x")), "src").select(F.col("dst").alias("id"), "x")
    mean = sent.groupBy("id").agg(*[F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(width)])
    mean = mean.select("id", F.array(*[F.coalesce(F.col(f"m{k}"), F.lit(0.0)) for k in range(width)]).alias("mm"))
    return features.join(mean, "id", "left").select("id", "x", F.coalesce("mm", F.array_repeat(F.lit(0.0), width)).alias("neigh"))
