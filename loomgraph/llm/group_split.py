"""Problem 7: splits that keep related records together.

Related entities are the connected components of a graph whose edges say "same group" (repository name -
owner). Components come from Boruvka-style contraction: every component takes its minimum edge under one
total order of the edges, the chosen edges hook components together, pointer jumping finds the roots, the
edges are rewritten to roots, until no edge joins two components. The chosen edges of all rounds are the
spanning forest, written out round by round. Roots are then put into size bands and dealt to the splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut

SPLITS = (("train", 80), ("val", 10), ("test", 10))
#: Groups with at least this share of all rows are placed one by one; there can be no more than its inverse.
BIG_SHARE = 0.001
ROUNDS = 64  # each round at least halves the components that still have edges: enough for 2**64 nodes


def repo_parts(url: Column) -> Column:
    """struct(owner, name), lower case, of a repository address in any spelling (scheme, ssh form, suffix, slashes)."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"[/\s]+$", ""), r"(\.git)?/*$", "")
    owner = F.regexp_extract(bare, r"([^/:]+)/([^/:]+)$", 1)
    name = F.regexp_extract(bare, r"([^/:]+)/([^/:]+)$", 2)
    return F.when(owner != "", F.struct(owner.alias("owner"), name.alias("name")))


def head(path: Column) -> Column:
    """First path segment in lower case; null for a null or empty path."""
    h = F.lower(F.trim(F.element_at(F.split(path, "/"), 1)))
    return F.when(h != "", h)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, DataFrame]:
    """(node, root) of every node on an edge, and the spanning forest (a, b, round).

    Null ends and loops are ignored, repeated edges count once. Empty edges give two empty tables. The
    driver sees counts only; all tables live in the checkpoint folder.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    base = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = base.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    nodes, forest = cut(nodes), None
    # an edge keeps its own ends (a, b) for the forest beside the components (u, v) it joins now
    live = base.select("a", "b", F.col("a").alias("u"), F.col("b").alias("v"), F.xxhash64("a", "b").alias("w"))
    for turn in range(ROUNDS):
        both = live.select("u", "v", "w", "a", "b").unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "a", "b"))
        # the minimum is combined map-side: a hub's edges never meet in one task
        best = both.groupBy("u").agg(F.min(F.struct("w", "a", "b", "v")).alias("e"))
        best = cut(best.select("u", F.col("e.v").alias("p"), F.col("e.a").alias("a"), F.col("e.b").alias("b")))
        if best.isEmpty():
            break
        chosen = best.select("a", "b").distinct().withColumn("round", F.lit(turn))
        forest = chosen if forest is None else forest.unionByName(chosen)
        # distinct edge weights leave cycles of two only: the smaller end of each is a root
        up = best.select("u", "p")
        back = up.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        ptr = up.join(back, "p", "left").select("u", F.when((F.col("pp") == F.col("u")) & (F.col("u") < F.col("p")), F.col("u")).otherwise(F.col("p")).alias("p"))
        ptr = cut(ptr)
        while True:
            nxt = ptr.select(F.col("u").alias("p"), F.col("p").alias("q"))
            step = cut(ptr.join(nxt, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
            ptr = step.select("u", "p")
            if step.where("moved").isEmpty():
                break
        to = ptr.select(F.col("u").alias("root"), F.col("p").alias("new"))
        nodes = cut(nodes.join(to, "root", "left").select("node", F.coalesce("new", "root").alias("root")))
        pu, pv = ptr.select("u", F.col("p").alias("nu")), ptr.select(F.col("u").alias("v"), F.col("p").alias("nv"))
        live = live.join(pu, "u").join(pv, "v").where("nu <> nv")
        live = cut(live.groupBy(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v")).agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.a", "e.b", "u", "v", "e.w"))
    if forest is None:
        forest = base.limit(0).withColumn("round", F.lit(0))
    return nodes, forest


def ownership(predictions: DataFrame, url_col: str = "repo_url") -> DataFrame:
    """Distinct (owner, name) of the repositories named by predictions; unreadable addresses give none."""
    return predictions.select(repo_parts(F.col(url_col)).alias("p")).where("p IS NOT NULL").select("p.owner", "p.name").distinct()


def grouped(examples: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Examples' (ord, name, split, grp) and the (node, root) table.

    grp is the component of the example's repository name; a name nobody owns is a group of its own, and a
    row without a path is alone (grp by its ord).
    """
    edges = owners.select(F.concat(F.lit("n:"), "name").alias("a"), F.concat(F.lit("o:"), "owner").alias("b"))
    nodes, _ = components(edges)
    rows = examples.select("ord", head(F.col("filepath")).alias("name"), "split").withColumn("node", F.concat(F.lit("n:"), "name"))
    # unowned names keep themselves as group; the join key of a null name never matches
    joined = rows.join(nodes, "node", "left")
    grp = F.coalesce("root", "node", F.concat(F.lit("r:"), F.col("ord").cast("string")))
    return joined.select("ord", "name", "split", grp.alias("grp")), nodes


def torn(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Owners whose examples lie in more than one split: owner and rows per split (null splits don't count).

    A component that one owner holds is judged whole. Where a repository's name joins several owners, each is
    judged by the rows of its own names.
    """
    owners = cut(ownership(predictions))
    rows, nodes = grouped(examples, owners)
    per_name = cut(rows.where("name IS NOT NULL AND split IS NOT NULL").groupBy("grp", "name", "split").agg(F.count(F.lit(1)).alias("n")))
    counts = [F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(f"n_{s}") for s, _ in SPLITS]
    spread = [*counts, F.min("split").alias("lo"), F.max("split").alias("hi")]
    parts = per_name.groupBy("grp").agg(*spread).where("lo <> hi")
    # an owner's node begins with "o:"
    heads = nodes.where("node LIKE 'o:%'").groupBy(F.col("root").alias("grp")).agg(F.count(F.lit(1)).alias("owners"), F.min(F.substring("node", 3, 1 << 30)).alias("owner"))
    known = parts.join(heads, "grp")
    alone = known.where("owners = 1").select("owner", *[f"n_{s}" for s, _ in SPLITS])
    mixed = known.where("owners > 1").select("grp")
    own = per_name.join(mixed, "grp", "left_semi").join(owners, "name").groupBy("owner").agg(*spread).where("lo <> hi").drop("lo", "hi")
    return alone.unionByName(own)


def assign(examples: DataFrame, predictions: DataFrame, shares=SPLITS, seed: str = "deal") -> DataFrame:
    """(ord, grp, split): every example, all of a group in one split, rows near the shares.

    Groups of at least BIG_SHARE of the rows (so at most 1 / BIG_SHARE of them) go, largest first, to the
    split that lacks most rows. The others are put into bands by size (powers of two), ordered at random in
    their band, and each band is dealt in the proportions that are still open. Empty tables give no rows.
    """
    rows, _ = grouped(examples, cut(ownership(predictions)))
    rows = cut(rows.select("ord", "grp"))
    sizes = cut(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    spark = examples.sparkSession
    big = sizes.where(F.col("n") >= max(1, total * BIG_SHARE))
    limit = max(1, total * BIG_SHARE)
    names, need = [s for s, _ in shares], {s: total * p / sum(q for _, q in shares) for s, p in shares}
    placed = []
    for r in big.orderBy(F.desc("n"), "grp").toLocalIterator():
        to = max(names, key=lambda s: (need[s], -names.index(s)))
        need[to] -= r.n
        placed.append((r.grp, to))
    left = {s: max(0.0, v) for s, v in need.items()}
    whole = sum(left.values()) or 1.0
    small = sizes.where(F.col("n") < limit).withColumn("band", F.floor(F.log2("n")))
    small = small.withColumn("k", F.xxhash64(F.lit(seed), "grp")).withColumn("cell", F.pmod(F.shiftrightunsigned("k", 56), F.lit(256)))
    cells = small.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("band").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offs = cells.select("band", "cell", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("off"), F.sum("c").over(Window.partitionBy("band")).alias("of"))
    at = (F.row_number().over(Window.partitionBy("band", "cell").orderBy("k", "grp")) + F.col("off") - 0.5) / F.col("of")
    dealt = small.join(offs, ["band", "cell"]).withColumn("u", at)
    edge, choice = 0.0, F.lit(names[0])
    for s in names:
        choice = F.when(F.col("u") >= edge, F.lit(s)).otherwise(choice) if left[s] > 0 else choice
        edge += left[s] / whole
    dealt = dealt.select("grp", choice.alias("split"))
    if placed:
        dealt = dealt.unionByName(spark.createDataFrame(placed, "grp string, split string"))
    return rows.join(dealt, "grp").select("ord", "grp", "split")
