"""Deterministic splits and evaluation metrics. Hash order replaces seeded shuffles: sizes match, membership differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: str, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in cols]))


def stratified(rows: DataFrame, stratum: str, key: str, train: float = 0.7, val: float = 0.15, seed: str = "42") -> DataFrame:
    """rows with split: per stratum round-half-even shares, at least one train row; what is left is test.

    Strata are ranked in hash buckets, so that a heavy stratum never meets in one task.
    """
    h = rows.withColumn("_h", hash_order(seed, key)).withColumn("_b", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))
    cells = h.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(stratum)
    off = cells.select(stratum, "_b", F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"), F.sum("_c").over(w).alias("_n"))
    ranked = h.withColumn("_r", F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", key)))
    joined = ranked.join(off, (ranked[stratum].eqNullSafe(off[stratum])) & (ranked["_b"] == off["_b"])).drop(off[stratum]).drop(off["_b"])
    n, r = F.col("_n"), F.col("_r") + F.col("_off")
    n_train = F.greatest(F.lit(1), F.bround(n * train).cast("bigint"))
    n_val = F.when(n > 2, F.least(n - n_train, F.greatest(F.lit(1), F.bround(n * val).cast("bigint")))).otherwise(F.lit(0))
    n_train = F.when(n <= 2, n).otherwise(n_train)
    return joined.withColumn("split", F.when(r <= n_train, "train").when(r <= n_train + n_val, "val").otherwise("test")).drop("_h", "_b", "_r", "_off", "_n")


def grouped(rows: DataFrame, group: str, train: float = 0.8, val: float = 0.1, seed: str = "13") -> DataFrame:
    """rows with split, whole groups together: floor shares of the number of groups, in hash order."""
    g = rows.select(group).distinct().withColumn("_h", hash_order(seed, group)).withColumn("_b", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))
    cells = g.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))  # at most 256 rows
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = cells.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    r = F.row_number().over(Window.partitionBy("_b").orderBy("_h", group)) + F.col("_off")
    placed = g.join(F.broadcast(off), "_b").withColumn("_r", r)
    cut1, cut2 = F.floor(F.col("_n") * train), F.floor(F.col("_n") * train) + F.floor(F.col("_n") * val)
    choice = placed.select(group, F.when(F.col("_r") <= cut1, "train").when(F.col("_r") <= cut2, "val").otherwise("test").alias("split"))
    return rows.join(choice, group)


def subsample(rows: DataFrame, key: str, share: float = 0.6, seed: str = "42") -> DataFrame:
    """About `share` of the rows by hash: no count, no sort, no shuffle."""
    return rows.where(F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("bigint") < int(share * 2**32))


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def per_class(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives 0. Works on the small confusion table."""
    c = confusion(rows, truth, guess)
    t = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("tp"))
    g = c.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("guessed"))
    j = t.join(g, "label", "full_outer").na.fill(0, ["support", "tp", "guessed"])
    p = F.when(F.col("guessed") > 0, F.col("tp") / F.col("guessed")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("guessed") + F.col("support"))).otherwise(0.0)
    return j.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.col("support").cast("bigint").alias("support"))


def overall(rows: DataFrame, truth: str, guess: str, minority: int = 5) -> DataFrame:
    """Accuracy, macro, weighted and minority F1."""
    pc = per_class(rows, truth, guess).where("support > 0")
    small = pc.orderBy("support", "label").limit(minority).agg(F.round(F.avg("f1"), 5).alias("minority_f1"))
    main = pc.agg(F.round(F.sum(F.col("recall") * F.col("support")) / F.sum("support"), 5).alias("accuracy"), F.round(F.avg("f1"), 5).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 5).alias("weighted_f1"))
    return main.join(F.broadcast(small))  # one row each


def threshold_sweep(rows: DataFrame, score: str, positive: str, steps: int = 17) -> DataFrame:
    """Best of the thresholds 0.1..0.9 by F1 (first best wins): one pass counts per interval, then cumulated."""
    cuts = [0.1 + 0.8 * i / (steps - 1) for i in range(steps)]
    aggs = [F.sum(F.col(positive).cast("bigint")).alias("pos")]
    for i, t in enumerate(cuts):
        on = F.col(score) >= round(t, 4)
        aggs += [F.count_if(on & F.col(positive)).alias(f"tp{i}"), F.count_if(on).alias(f"pp{i}")]
    one = rows.agg(*aggs)
    e = F.explode(F.array(*[F.struct(F.lit(round(t, 4)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"pp{i}").alias("pp")) for i, t in enumerate(cuts)])).alias("e")
    each = one.select("pos", e).select("e.*", "pos")
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("pp") + F.col("pos"))).otherwise(0.0)
    return each.select("threshold", F.round(f1, 6).alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


def support(rows: DataFrame, split: str, label: str, labels: DataFrame) -> DataFrame:
    """(split, label, n) for every split and every label of labels(label), those without rows included."""
    have = rows.groupBy(F.col(split).alias("split"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    # splits times labels, both small lists
    every = rows.where(F.col(split).isNotNull()).select(F.col(split).alias("split")).distinct().join(F.broadcast(labels.select(F.array_agg("label").alias("all"))))
    return every.select("split", F.explode("all").alias("label")).join(have, ["split", "label"], "left").na.fill(0, ["n"])


def class_weights(rows: DataFrame, label: str, power: float = 0.5) -> DataFrame:
    """(1 / frequency) ** power, normalised to mean 1."""
    c = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    raw = F.pow(1.0 / F.col("n"), F.lit(power))
    mean = c.agg(F.avg(raw).alias("m"))  # one row
    return c.join(F.broadcast(mean)).select("label", "n", F.round(raw / F.col("m"), 6).alias("weight"))


def pos_weight(rows: DataFrame, positive: str, most: float = 20.0) -> DataFrame:
    p, n = F.count_if(F.col(positive)), F.count_if(~F.col(positive))
    return rows.agg(F.round(F.least(F.greatest(n, F.lit(1)) / F.greatest(p, F.lit(1)), F.lit(most)), 6).alias("pos_weight"))
