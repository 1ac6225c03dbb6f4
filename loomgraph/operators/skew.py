"""Per-key results when a few keys hold most rows.

Rows are range-partitioned on the composite (key field, key, entity, row order) with Spark's sampled quantiles,
so a heavy key is cut across as many partitions as its share of the rows asks for, and so are a key's repeated
and null entities. Each sorted partition is folded into one partial state a key: sums, distinct entities, first
and last entity. Stitching adds the states of a key up in partition order; an entity that runs over a boundary
is the last of one state and the first of the next, and counts once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import parallelism


def usable(confidence: Column) -> Column:
    """The confidence where it lies in 0..1; null for null, NaN and anything outside (NaN sorts above 1)."""
    return F.when(confidence.between(0.0, 1.0), confidence)


def keyed(df: DataFrame, key_fields: Sequence[str], entity: Sequence[str], measure: str) -> DataFrame:
    """One row per (row, key field): key_field, key_value, whether it has an entity, two hashes of that (0 without), the usable measure and a number of the row."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key_field"), F.col(k).cast("string").alias("key_value")) for k in key_fields])
    parts = [F.coalesce(F.concat(F.lit("="), F.col(e).cast("string")), F.lit("")) for e in entity]  # null differs from empty
    there = F.col(entity[-1]).isNotNull()
    e1, e2 = (F.when(there, F.xxhash64(*seed, *parts)).otherwise(F.lit(0)) for seed in ((), (F.lit("entity"),)))  # 128 bits
    slim = df.select(F.explode(pairs).alias("k"), there.alias("has"), e1.alias("e1"), e2.alias("e2"), usable(F.col(measure)).alias("m"), F.monotonically_increasing_id().alias("o"))
    return slim.select("k.key_field", "k.key_value", "has", "e1", "e2", "m", "o").where("key_value IS NOT NULL")


_STATE = "p int, key_field string, key_value string, n bigint, files bigint, ms double, mn bigint, f1 bigint, f2 bigint, l1 bigint, l2 bigint"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The partial state of every key of one sorted partition, in order; a key's state is open until the next key comes."""
    open_: list | None = None
    names = [c.split()[0] for c in _STATE.split(", ")]
    for b in batches:
        if not len(b):
            continue
        field, value = b["key_field"].to_numpy(), b["key_value"].to_numpy()
        has, e1, e2 = b["has"].to_numpy(bool), b["e1"].to_numpy(np.int64), b["e2"].to_numpy(np.int64)
        m = b["m"].to_numpy(np.float64)
        starts = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (field[1:] != field[:-1])])
        new = has & np.r_[True, (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1]) | ~has[:-1]]
        new[starts] = has[starts]
        n, files = np.diff(np.r_[starts, len(b)]), np.add.reduceat(new.astype(np.int64), starts)
        ms, mn = np.add.reduceat(np.nan_to_num(m), starts), np.add.reduceat((~np.isnan(m)).astype(np.int64), starts)
        done = []
        for k, (lo, hi) in enumerate(zip(starts, np.r_[starts[1:], len(b)], strict=True)):
            at = np.flatnonzero(has[lo:hi])
            ends = [None] * 4 if not len(at) else [int(x[lo + at[j]]) for j in (0, -1) for x in (e1, e2)]
            one = [int(b["p"].iloc[0]), field[lo], value[lo], int(n[k]), int(files[k]), float(ms[k]), int(mn[k]), *ends]
            if open_ is None:
                open_ = one
            elif open_[1:3] == one[1:3]:
                same = one[7] is not None and open_[9:11] == one[7:9]
                open_[3:7] = [open_[3] + one[3], open_[4] + one[4] - same, open_[5] + one[5], open_[6] + one[6]]
                open_[7:9] = open_[7:9] if open_[7] is not None else one[7:9]
                open_[9:11] = one[9:11] if one[9] is not None else open_[9:11]
            else:
                done.append(open_)
                open_ = one
        yield _states(done, names)
    if open_ is not None:
        yield _states([open_], names)


def _states(rows: list[list], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    ends = ("f1", "f2", "l1", "l2")
    return out.assign(**{c: pd.array(out[c].tolist(), "Int64") for c in ends})


def per_key(df: DataFrame, key_fields: Sequence[str] = ("repo_url", "predicted_label"), entity: Sequence[str] = ("repo_url", "filepath"), measure: str = "confidence", partitions: int | None = None) -> DataFrame:
    """Rows, distinct entities and mean usable measure of each value of each key field, free of key skew.

    Nulls: a null key value yields no row; an entity whose last column is null counts as a row but not as an
    entity; an unusable measure counts as a row but not into the mean (null if none is usable). Repeated rows
    all count. Empty input gives no rows. Other columns of df are never read.
    """
    n = partitions or parallelism(df.sparkSession)
    order = ("key_field", "key_value", "has", "e1", "e2", "o")
    slices = keyed(df, key_fields, entity, measure).repartitionByRange(n, *order).sortWithinPartitions(*order)
    states = slices.select(F.spark_partition_id().alias("p"), "key_field", "key_value", "has", "e1", "e2", "m").mapInPandas(_fold, _STATE)
    # a key has at most one state a partition: the window is as long as the number of partitions
    w = Window.partitionBy("key_field", "key_value").orderBy("p")
    runs_over = (F.lag("l1").over(w) == F.col("f1")) & (F.lag("l2").over(w) == F.col("f2"))
    stitched = states.withColumn("again", F.coalesce(runs_over.cast("int"), F.lit(0)))
    return stitched.groupBy("key_field", "key_value").agg(
        F.sum("n").alias("n_rows"),
        (F.sum("files") - F.sum("again")).alias("n_files"),
        F.sum("mn").alias("n_usable"),
        F.when(F.sum("mn") > 0, F.round(F.sum("ms") / F.sum("mn"), 6)).alias("mean_confidence"),
    )


def heavy_keys(df: DataFrame, share_percent: int = 5, **options) -> DataFrame:
    """The key values that at least share_percent % of all rows of df hold (null keys count into all rows)."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    # the total is one row by construction
    return per_key(df, **options).join(F.broadcast(total), F.col("n_rows") * 100 >= F.col("total") * share_percent).select("key_field", "key_value")
