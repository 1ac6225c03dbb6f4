"""Problem 1: samples whose category shares meet given targets.

Divisor method: the rows of a category get random ranks 1..n and row r the priority (r - 0.5) / target.
Records that fill a minimum come first, then the globally smallest priorities fill the sample, so a
category that runs out hands its seats to the others. Which rows those are follows from the categories'
counts alone: the cut-off of the priorities is found on the small count table, and a row is kept if its
rank is within its category's seats. No global sort, and no category in one task: ranks are made in two
levels, a row_number inside (category, hash bucket) plus the bucket's offset. Buckets follow the order of the
keys, so those that begin beyond the last rank wanted of a category are never shuffled or sorted.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut

SEED = "seat"
BUCKETS = 256  # hash buckets per category; a bucket of the largest category holds 1/256 of its rows
#: The target table is broadcast; it has profiles x labels rows. Above this many it is joined by shuffle.
MAX_BROADCAST_TARGETS = 100_000


def clean_label(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))


def usable_rows(predictions: DataFrame, targets: DataFrame, id_col: str = "ord", label_col: str = "predicted_label", confidence_col: str = "confidence") -> DataFrame:
    """(label, id) of rows with a label of the targets and a confidence in 0..1; repeats all count."""
    rows = predictions.select(F.col(id_col).alias("id"), clean_label(F.col(label_col)).alias("label"), F.col(confidence_col).alias("c"))
    labels = targets.select("label").distinct()
    # left semi against a distinct label list: a shuffle-free broadcast when the planner sees it is small
    return rows.where(F.col("c").between(0.0, 1.0) & F.col("label").isNotNull()).join(labels, "label", "left_semi").select("label", "id")


def seats_of(counts: pd.DataFrame, size: int) -> pd.DataFrame:
    """Seats per label of one profile from columns label, target_pct, min_rows, usable.

    Takes the floors first (in priority order if even they exceed the size), then the smallest
    priorities (r - 0.5) / target, ties by label. A target of 0 or null gets its floor only.
    """
    c = counts.sort_values("label").reset_index(drop=True)
    n = c["usable"].astype("int64").tolist()
    t = c["target_pct"].fillna(0).astype("int64").tolist()
    floor = [min(a, max(0, int(b))) for a, b in zip(n, c["min_rows"].fillna(0), strict=True)]

    def fill(lo: list[int], hi: list[int], left: int) -> list[int]:
        """lo plus the `left` smallest priorities among ranks lo+1..hi of each label."""
        room = [max(0, h - b) if w > 0 else 0 for b, h, w in zip(lo, hi, t, strict=True)]
        if left >= sum(room):
            return [b + r for b, r in zip(lo, room, strict=True)]
        # ranks with priority <= x, x = num / den: r <= x * w + 0.5
        import math

        def at(x: float) -> list[int]:
            return [min(b + r, max(b, math.floor(x * w + 0.5))) for b, r, w in zip(lo, room, t, strict=True)]

        low, high = 0.0, max((b + r) / w for b, r, w in zip(lo, room, t, strict=True) if w > 0) + 1
        for _ in range(200):
            mid = (low + high) / 2
            if mid in (low, high):
                break
            if sum(at(mid)) - sum(lo) <= left:
                low = mid
            else:
                high = mid
        got = at(low)
        # whatever is still open are ties at the cut-off: one by one, by (priority, label)
        while (open_ := left - (sum(got) - sum(lo))) > 0:
            nxt = sorted(((2 * (g + 1) - 1) / w, k) for k, (g, b, r, w) in enumerate(zip(got, lo, room, t, strict=True)) if g < b + r)
            for _, k in nxt[:open_]:
                got[k] += 1
        return got

    if sum(floor) >= size:
        seats, left = [0] * len(n), size
        # floors alone fill the sample: positive targets by priority, then the rest by label
        seats = fill(seats, floor, left)
        left -= sum(seats)
        for k, (w, f) in enumerate(zip(t, floor, strict=True)):
            if w <= 0 and left > 0:
                seats[k] = min(f, left)
                left -= seats[k]
    else:
        seats = fill(floor, n, size - sum(floor))
    return c.assign(seats=seats)


def keyed_rows(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """rows with their random key k and its bucket b, in the order of the keys."""
    keyed = rows.withColumn("k", F.md5(F.concat(F.lit(seed + ":"), F.col("id").cast("string"))))
    return keyed.withColumn("b", F.conv(F.substring("k", 1, 2), 16, 10).cast("int") % BUCKETS)


def cells_of(keyed: DataFrame) -> DataFrame:
    """Rows of each (label, b): at most BUCKETS rows a label. One pass; counts, sizes and offsets all come from here."""
    return cut(keyed.groupBy("label", "b").agg(F.count(F.lit(1)).alias("n")))


def plan(predictions: DataFrame, targets: DataFrame, divisor: int = 5, cells: DataFrame | None = None, **cols) -> DataFrame:
    """One row per target row: usable rows, sample size, rows wanted, seats, and whether the target can be met.

    Empty predictions: size 0, nothing drawn, every positive minimum short. Null labels or confidences,
    NaN and values outside 0..1 are not usable. Ties of equal rank keys fall by id.
    """
    cells = cells_of(keyed_rows(usable_rows(predictions, targets, **cols))) if cells is None else cells
    per_label = cells.groupBy("label").agg(F.sum("n").alias("usable"))
    size = per_label.agg((F.coalesce(F.sum("usable"), F.lit(0)) / divisor).cast("bigint").alias("size"))
    small = targets.select("profile", "label", F.col("target_pct").cast("bigint").alias("target_pct"), F.col("min_rows").cast("bigint").alias("min_rows"))
    joined = small.join(per_label, "label", "left").withColumn("usable", F.coalesce("usable", F.lit(0).cast("bigint"))).join(F.broadcast(size))  # size is one row by construction

    def seats(pdf: pd.DataFrame) -> pd.DataFrame:
        return seats_of(pdf, int(pdf["size"].iloc[0]))[["profile", "label", "target_pct", "min_rows", "usable", "size", "seats"]]

    # a group here is one profile's label list, never rows
    done = joined.groupBy("profile").applyInPandas(seats, "profile string, label string, target_pct bigint, min_rows bigint, usable bigint, size bigint, seats bigint")
    need = F.greatest("min_rows", F.expr("(size * target_pct + 99) div 100"))
    return done.withColumn("wanted", need).withColumn("short", F.col("usable") < F.col("wanted"))


def ranked(keyed: DataFrame, cells: DataFrame, most: DataFrame) -> DataFrame:
    """(label, id, rank): random ranks within the labels of most(label, most), from 1 up to `most` and a little beyond.

    Ties of the key fall by id. The offsets have at most BUCKETS rows a label.
    """
    before = Window.partitionBy("label").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("label", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    wanted = offsets.join(most, "label").where("off < most").select("label", "b", "off")
    inside = F.row_number().over(Window.partitionBy("label", "b").orderBy("k", "id"))
    return keyed.join(wanted, ["label", "b"]).select("label", "id", (inside + F.col("off")).alias("rank"))


def _drawing(predictions: DataFrame, targets: DataFrame, divisor: int, seed: str, **cols) -> tuple[DataFrame, DataFrame]:
    """(plan, rows with profile, label, id, rank, seats and wanted that lie within the seats or the rows wanted)."""
    keyed = keyed_rows(usable_rows(predictions, targets, **cols), seed)
    cells = cells_of(keyed)
    quota = cut(plan(predictions, targets, divisor, cells=cells))
    reach = F.greatest("seats", "wanted")
    most = quota.groupBy("label").agg(F.max(reach).alias("most"))
    rows = ranked(keyed, cells, most)
    limits = quota.select("profile", "label", "seats", "wanted")
    # profiles x labels rows; beyond the bound the join is by label and shuffled
    if targets.limit(MAX_BROADCAST_TARGETS + 1).count() <= MAX_BROADCAST_TARGETS:
        limits = F.broadcast(limits)
    return quota, rows.join(limits, "label").where(F.col("rank") <= reach)


def draw(predictions: DataFrame, targets: DataFrame, divisor: int = 5, seed: str = SEED, **cols) -> DataFrame:
    """The sample: (profile, label, id, rank), each row at most once a profile."""
    _, rows = _drawing(predictions, targets, divisor, seed, **cols)
    return rows.where("rank <= seats").select("profile", "label", "id", "rank")


def report(predictions: DataFrame, targets: DataFrame, divisor: int = 5, seed: str = SEED, **cols) -> DataFrame:
    """(profile, label, wanted, seats, drawn, reached, short) of every target row, read off the ranked rows themselves.

    drawn: the sample's rows; reached: the last of the wanted ranks that a row holds. The target cannot be met
    (short) if the rows end before the rank wanted.
    """
    quota, rows = _drawing(predictions, targets, divisor, seed, **cols)
    got = rows.groupBy("profile", "label").agg(F.count_if(F.col("rank") <= F.col("seats")).alias("drawn"), F.max(F.least("rank", "wanted")).alias("reached"))
    out = quota.select("profile", "label", "wanted", "seats").join(got, ["profile", "label"], "left").na.fill(0, ["drawn", "reached"])
    return out.withColumn("short", F.col("reached") < F.col("wanted"))
