"""Logistic regressions over pairs of nodes: 342 numbers a pair (both ends' vectors and their product) that are never written.

A pair is two numbers; every evaluation of the loss reads the ends' vectors where they lie (operators.arrays). The
objective and the steps are those of Spark ML's LogisticRegression (weighted mean loss, L2 on standardised
coefficients, L-BFGS with ten pairs kept and strong Wolfe steps), so the models are the same up to rounding.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Generator, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import arrays, graph
from loomgraph.session import cut, parallelism

#: Pairs whose numbers are looked at in one go, those of which they are in the fit, those that are written as a block, and those of a group whose margins are.
AT_ONCE, PRODUCTS, BLOCK, MARGINS = 2_048, 1_024, 1 << 15, 1 << 18


class Linear(NamedTuple):
    """A fitted model: coefficients of a pair's numbers and intercept."""

    coef: np.ndarray
    intercept: float


class Vectors:
    """Vectors of the nodes: an index of the ids and one or more matrices side by side."""

    def __init__(self, index: arrays.Index, *parts: arrays.Shared) -> None:
        self.index, self.parts = index, parts
        self.width = sum(p.shape[1] for p in parts)

    @classmethod
    def of(cls, x: DataFrame, zeros: bool = True) -> Vectors:
        """Of rows (id, x), or (id, row) with the bytes of their doubles; zeros: with the entries that are zero in all rows."""
        first = x.first()
        index, width = arrays.Index(x), 0 if first is None else len(first.row) // 8 if "row" in x.columns else len(first.x)
        given = F.col("row") if "row" in x.columns else arrays.as_bytes("x", width)
        rows = x.select(index.of("id").alias("at"), given.alias("row")).where("at >= 0")
        return cls(index, arrays.placed(rows, index.n, width, kept=None if zeros else arrays.used(x.select(given.alias("row")), width)))

    def with_means(self, edges: DataFrame | arrays.Packed, parts: int, whole: arrays.Whole | None = None) -> Vectors:
        """Own vectors beside the mean of the sources' along edges(src, dst), as models.encode makes them; whole: the numbers of packed edges."""
        if isinstance(edges, arrays.Packed):
            sent = edges.dealt(whole, parts)
        else:
            numbers = edges.select(self.index.of("src").alias("a"), self.index.of("dst").alias("b"))
            sent = arrays.dealt(numbers, lambda: lambda batch: (batch.column(0).to_numpy(), batch.column(1).to_numpy()), self.index.n, parts)
        return Vectors(self.index, arrays.with_means(sent, self.parts[0], parts))

    def open(self) -> list[np.ndarray]:
        return [p.open() for p in self.parts]


def _numbers(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 3 * width numbers of the pairs."""
    w = sum(r.shape[1] for r in rows)
    out, at = np.empty((len(a), 3 * w)), 0
    for r in rows:
        k = r.shape[1]
        out[:, at : at + k], out[:, w + at : w + at + k] = r[a], r[b]
        at += k
    np.multiply(out[:, :w], out[:, w : 2 * w], out=out[:, 2 * w :])
    return out


def training(known: DataFrame, count: int, n: int, parts: int) -> DataFrame:
    """known(a, b, flags) and the pairs of graph.negative_numbers(known, count, n) with flags 0, written as blocks of bytes, near ones together.

    No pair has a row in a shuffle: pairs are dealt by their first end as bytes, and told apart, in order, in arrays.
    """
    spark, schema = known.sparkSession, "a binary, b binary, flags binary, k binary"
    kinds = (("a", "i4"), ("b", "i4"), ("flags", "u1"), ("k", "i8"))
    pos = known.where("a >= 0 AND b >= 0").select("a", "b", F.col("flags").cast("int"), F.lit(-1).cast("bigint").alias("k"))
    draws = graph.negative_draws(spark, count if n > 1 else 0, max(1, n)).select("a", "b", F.lit(0).alias("flags"), "k")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            values = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(4)]
            part = values[0] * parts // n
            order, ends = np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=parts))
            data = [(c, v.astype(t)[order]) for (c, t), v in zip(kinds, values, strict=True)]
            blocks = {c: pa.array([v[lo:hi].tobytes() for lo, hi in zip(np.r_[0, ends[:-1]], ends, strict=True)], pa.binary()) for c, v in data}
            return pa.RecordBatch.from_pydict({"part": pa.array(np.arange(parts, dtype=np.int32))} | blocks)

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= arrays.DEALT:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def read(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            for row in zip(*batch.columns[first:], strict=True):
                yield [np.frombuffer(v.as_buffer(), t) for v, (_, t) in zip(row, kinds, strict=True)]

    def written(a: np.ndarray, b: np.ndarray, flags: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(a), BLOCK):
            s = slice(lo, lo + BLOCK)
            yield pa.RecordBatch.from_pydict({c: pa.array([v[s].tobytes()], pa.binary()) for (c, _), v in zip(kinds, (a, b, flags, k), strict=True)})

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(read(batches, 1))
        if got:
            a, b, flags, k = (np.concatenate(v) for v in zip(*got, strict=True))
            key = a.astype(np.int64) * n + b
            order = np.lexsort((k, key))  # a known pair comes before its draws, and the first draw before the others
            key = key[order]
            order = order[(k[order] < 0) | np.r_[True, key[1:] != key[:-1]]]
            yield from written(a[order], b[order], flags[order], k[order])

    left = cut(pos.mapInArrow(deal, f"part int, {schema}").unionByName(draws.mapInArrow(deal, f"part int, {schema}")).repartition(parts, "part").mapInArrow(apart, schema))
    step = max(1, count // 1_000)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for *_, k in read(batches, 0):
            own = np.bincount(k[k >= 0] // step, minlength=len(total))
            own[: len(total)] += total
            total = own
        yield pa.RecordBatch.from_pydict({"n": pa.array([total.tobytes()], pa.binary())})

    states = [np.frombuffer(r.n, np.int64) for r in left.mapInArrow(counted, "n binary").collect()]
    total = np.zeros(max((len(v) for v in states), default=0), np.int64)
    for v in states:
        total[: len(v)] += v
    upto = np.cumsum(total)
    last = 2**63 - 1  # the last draw wanted
    if len(upto) and upto[-1] > count:
        stretch = int(np.searchsorted(upto, count))

        def those(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for *_, k in read(batches, 0):
                yield pa.RecordBatch.from_pydict({"k": pa.array([k[(k >= 0) & (k // step == stretch)].tobytes()], pa.binary())})

        within = np.sort(np.concatenate([np.frombuffer(r.k, np.int64) for r in left.mapInArrow(those, "k binary").collect()]))
        last = int(within[count - int(upto[stretch] - total[stretch]) - 1]) if count else -1

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, flags, k in read(batches, 0):
            on = k <= last
            yield pa.RecordBatch.from_pydict({c: pa.array([v[on].tobytes()], pa.binary()) for c, v in (("a", a), ("b", b), ("flags", flags))})

    # blocks are alike in size: dealt in turn, the tasks of an evaluation are, too
    return cut(left.mapInArrow(wanted, "a binary, b binary, flags binary").repartition(parts).sortWithinPartitions("a", "b"))


def _folded(written: DataFrame, vectors: Vectors, fold) -> list:
    """fold(state or None, matrices of the vectors, a, b, flags) over the blocks of each task; the states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows = None, vectors.open()
        for batch in batches:
            for block in batch.to_pylist():
                a, b, flags = np.frombuffer(block["a"], np.int32), np.frombuffer(block["b"], np.int32), np.frombuffer(block["flags"], np.uint8)
                state = fold(state, rows, a, b, flags)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"state": pa.array([pickle.dumps(state)], pa.binary())})

    return [pickle.loads(r.state) for r in written.mapInArrow(run, "state binary").collect()]


def _moments(state, x: np.ndarray, flags: np.ndarray):
    """{flags: ((count, means, squared deviations), least, greatest)}."""
    by = {} if state is None else state
    for k in np.unique(flags).tolist():
        own = x[flags == k]
        mean = own.mean(axis=0)
        by[k] = _seen(by.get(k), ((len(own), mean, ((own - mean) ** 2).sum(axis=0)), own.min(axis=0), own.max(axis=0)))
    return by


def _all_moments(state, rows: list[np.ndarray], a: np.ndarray, b: np.ndarray, flags: np.ndarray):
    for lo in range(0, len(a), AT_ONCE):
        s = slice(lo, lo + AT_ONCE)
        state = _moments(state, _numbers(rows, a[s], b[s]), flags[s])
    return state


def _taken(rows: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    return np.take(rows[0], at, axis=0) if len(rows) == 1 else np.concatenate([r[at] for r in rows], axis=1)


def _losses(state, rows: list[np.ndarray], a: np.ndarray, b: np.ndarray, flags: np.ndarray, coef: np.ndarray, shift: np.ndarray, weight: np.ndarray, label: np.ndarray):
    """Sums over the pairs of each model's loss, residuals, and residuals times the numbers.

    Pairs lie side by side by a. Those of one first end share its coefficients: the second end's, and the product's times
    the first end's numbers. So of a pair only the second end's numbers are looked at, and no product is made; the runs of
    one length are multiplied in one go.
    """
    w, k = len(coef) // 3, coef.shape[1]
    c1, c2, c3 = coef[:w], np.ascontiguousarray(coef[w : 2 * w].T), np.ascontiguousarray(coef[2 * w :].T)
    known = np.ascontiguousarray(np.concatenate([weight, label], axis=1).T)
    loss, total, moved = (np.zeros(k), np.zeros(k), np.zeros(coef.shape)) if state is None else state
    new = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    far = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    first = np.flatnonzero(new | (far % PRODUCTS == 0))  # longer runs are some runs
    long = np.diff(np.r_[first, len(a)])
    order = np.argsort(long, kind="stable")
    first, long = first[order], long[order]
    ends = np.flatnonzero(np.r_[long[1:] != long[:-1], True]) + 1 if len(long) else ()
    lo = 0
    for hi in ends:
        n = int(long[lo])
        for i in range(lo, hi, max(1, PRODUCTS // n)):
            start = first[i : min(hi, i + max(1, PRODUCTS // n))]
            at = (start[:, None] + np.arange(n)).reshape(-1)
            za, zb = _taken(rows, a[start]), _taken(rows, b[at]).reshape(len(start), n, w)
            own = za[:, None, :] * c3
            own += c2
            margin = zb @ own.transpose(0, 2, 1)
            margin += (za @ c1 + shift)[:, None, :]
            margin = np.ascontiguousarray(margin.reshape(-1, k).T)  # a model's side by side
            told = np.take(known, flags[at], axis=1)
            u, y = told[:k], told[k:]
            e = np.exp(-np.abs(margin))
            each = np.log1p(e)
            each += np.maximum(margin, 0.0)
            each -= y * margin
            loss += np.einsum("ij,ij->i", u, each)
            r = np.where(margin >= 0, 1.0, e)
            e += 1.0
            r /= e
            r -= y
            r *= u
            of_a = r.reshape(k, len(start), n).sum(axis=2).T
            total += of_a.sum(axis=0)
            moved[:w] += za.T @ of_a
            r = np.ascontiguousarray(r.T).reshape(len(start), n, k)
            of_b = r.transpose(0, 2, 1) @ zb
            moved[w : 2 * w] += of_b.sum(axis=0).T
            of_b *= za[:, None, :]
            moved[2 * w :] += of_b.sum(axis=0).T
        lo = hi
    return loss, total, moved


def _seen(p, q):
    return q if p is None else (_joined(p[0], q[0]), np.minimum(p[1], q[1]), np.maximum(p[2], q[2]))


def _joined(p, q):
    """Counts (or weights), means and squared deviations of two parts together."""
    if p is None:
        return q
    n, d = p[0] + q[0], q[1] - p[1]
    return n, p[1] + d * (q[0] / n), p[2] + q[2] + d * d * (p[0] * q[0] / n)


class Problem:
    """One model's labels and weights by flags, and its standardised objective."""

    def __init__(self, by: dict, bit: int, among: int, most: float, reg: float) -> None:
        own = {k: m for k, m in by.items() if not among or k & among}
        rows = {k: m[0] for k, m in own.items()}
        p, q = sum(m[0] for k, m in rows.items() if k & bit), sum(m[0] for k, m in rows.items() if not k & bit)
        self.only = None if p and q else float(bool(p))
        if self.only is not None:
            return
        w = min(most, max(1, q) / max(1, p))
        self.weight, self.label = np.zeros(256), np.array([float(bool(k & bit)) for k in range(256)])
        total, squares = None, 0.0
        for k, (n, mean, m2) in rows.items():
            self.weight[k] = w if k & bit else 1.0
            total, squares = _joined(total, (n * self.weight[k], mean, m2 * self.weight[k])), squares + n * self.weight[k] ** 2
        self.sum, self.mean = total[0], total[1]
        # told by its ends: what rounding leaves of the deviation of a constant would be scaled up
        constant = np.min([m[1] for m in own.values()], axis=0) == np.max([m[2] for m in own.values()], axis=0)
        self.std = np.where(constant, 0.0, np.sqrt(np.maximum(total[2] / (self.sum - squares / self.sum), 0.0)))
        self.scale = np.divide(1.0, self.std, out=np.zeros_like(self.std), where=self.std > 0)
        self.reg, self.start = reg, np.r_[np.zeros(len(self.mean)), math.log(p * w / q)]

    def raw(self, at: np.ndarray) -> tuple[np.ndarray, float]:
        coef = at[:-1] * self.scale
        return coef, float(at[-1] - coef @ self.mean)

    def value(self, at: np.ndarray, loss: float, r: float, rx: np.ndarray) -> tuple[float, np.ndarray]:
        """Objective and gradient from the sums of the loss, the residuals, and the residuals times the numbers."""
        g = np.r_[(rx - self.mean * r) * self.scale, r] / self.sum
        g[:-1] += self.reg * at[:-1]
        return loss / self.sum + 0.5 * self.reg * float(at[:-1] @ at[:-1]), g


def _step(x: np.ndarray, f0: float, g0: np.ndarray, d: np.ndarray, first: float) -> Generator:
    """A step along d by the strong Wolfe conditions: (point, value, gradient), or None."""
    slope = float(g0 @ d)

    def at(t: float):
        f, g = yield x + t * d
        return t, f, float(g @ d), g

    def between(p, q) -> float:
        d1 = p[2] + q[2] - 3 * (p[1] - q[1]) / (p[0] - q[0])
        d2, far = math.sqrt(max(0.0, d1 * d1 - p[2] * q[2])), q[0] - p[0]
        t = q[0] - far * (q[2] + d2 - d1) / (q[2] - p[2] + 2 * d2)
        return min(max(t, p[0] + 0.1 * far), p[0] + 0.9 * far)

    low, t, high = (0.0, f0, slope, g0), first, None
    for i in range(10):
        c = yield from at(t)
        if not math.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > f0 + 1e-4 * c[0] * slope or (c[1] >= low[1] and i > 0):
            high = c
            break
        if abs(c[2]) <= 0.9 * abs(slope):
            return x + c[0] * d, c[1], c[3]
        if c[2] >= 0:
            low, high = c, low
            break
        low, t = c, t * 1.5
    for _ in range(10 if high else 0):
        c = yield from at(between(high, low) if low[0] > high[0] else between(low, high))
        if c[1] > f0 + 1e-4 * c[0] * slope or c[1] >= low[1]:
            high = c
        else:
            if abs(c[2]) <= 0.9 * abs(slope):
                return x + c[0] * d, c[1], c[3]
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
    return None


def lbfgs(x: np.ndarray, rounds: int, tolerance: float = 1e-6, kept: int = 10) -> Generator:
    """Yields points and is sent (value, gradient); returns the last point."""
    f, g = yield x
    pairs, values, scale = [], [f], abs(f)
    for k in range(rounds):
        q, used = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            used.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        got = yield from _step(x, f, g, -q, 1.0 if k else 1.0 / max(float(np.linalg.norm(q)), 1e-300))
        if got is None:
            break
        new, f, g_new = got
        pairs = [*pairs, (new - x, g_new - g)][-kept:]
        x, g, values = new, g_new, [*values, f][-20:]
        if abs(f - max(values)) <= tolerance * scale or np.linalg.norm(g) <= max(tolerance * abs(f), 1e-8):
            break
    return x


def fit(written: DataFrame, vectors: Vectors, bits: dict[str, tuple[int, int]], rounds: int, most: float, reg: float) -> dict[str, Linear | float]:
    """Models by name of bits(name: (bit of the label, bit that a row must have, or 0)); a number where the rows have one class only.

    All models are looked at in one pass over the pairs an evaluation.
    """
    states = _folded(written, vectors, _all_moments)
    by: dict = {}
    for s in states:
        for k, m in s.items():
            by[k] = _seen(by.get(k), m)
    problems = {t: Problem(by, bit, among, most, reg) for t, (bit, among) in bits.items()}
    found: dict = {t: p.only for t, p in problems.items() if p.only is not None}
    running = {t: lbfgs(p.start, rounds) for t, p in problems.items() if p.only is None}
    asked = {t: next(r) for t, r in running.items()}
    while asked:
        names = list(asked)
        raw = [problems[t].raw(asked[t]) for t in names]
        coef, shift = np.array([c for c, _ in raw]).T, np.array([b for _, b in raw])
        weight, label = np.array([problems[t].weight for t in names]).T, np.array([problems[t].label for t in names]).T

        fold = partial(_losses, coef=coef, shift=shift, weight=weight, label=label)
        loss, r, rx = (sum(v) for v in zip(*_folded(written, vectors, fold), strict=True))
        for i, t in enumerate(names):
            try:
                asked[t] = running[t].send(problems[t].value(asked[t], float(loss[i]), float(r[i]), rx[:, i]))
            except StopIteration as end:
                found[t] = Linear(*problems[t].raw(end.value))
                del asked[t]
    return {t: found[t] for t in bits}


def probability(models: dict[str, Linear], vectors: Vectors, a: str, b: str) -> Column:
    """A struct of the models' probabilities of the pairs of two columns of numbers."""
    names = list(models)
    coef, shift = np.array([m.coef for m in models.values()]).T, np.array([m.intercept for m in models.values()])

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        rows = vectors.open()
        for x, y in batches:
            x, y, out = x.to_numpy(np.int64), y.to_numpy(np.int64), np.zeros((len(x), len(names)))
            for lo in range(0, len(x), AT_ONCE):
                s = slice(lo, lo + AT_ONCE)
                out[s] = 1.0 / (1.0 + np.exp(-np.clip(_numbers(rows, x[s], y[s]) @ coef + shift, -700, 700)))
            yield pd.DataFrame(out, columns=names)

    return F.pandas_udf(run, ", ".join(f"{t} double" for t in names))(a, b)


def _rounded(p: np.ndarray) -> np.ndarray:
    """Ten thousand times p, rounded as Spark rounds p to four digits: half up, by the digits that are written."""
    t = p * 1e4 + 0.5
    out = np.floor(t).astype(np.int64)
    near = np.flatnonzero(np.abs(t - np.rint(t)) < 1e-6)
    some, which = np.unique(p[near], return_inverse=True)
    out[near] = np.array([int(Decimal(repr(v)).scaleb(4).quantize(Decimal(1), ROUND_HALF_UP)) for v in some.tolist()], np.int64)[which]
    return out


def surest(groups: DataFrame, existing: DataFrame | None, vectors: Vectors, exists: Linear | float, least: float, top: int) -> DataFrame:
    """(src, dst, a, b, p): of all ordered pairs of one of groups(id, grp), but those of existing(src, dst), the `top` of the highest probabilities.

    Probabilities count by four digits, from `least` on; ties go by src and dst. Every pair is scored where its group is: a
    source's margins are one product with the whole group, and of a task only the surest go on, so no pair has a row.
    """
    m = cut(graph._members(groups).select("*", vectors.index.of("id").alias("at")).where("at >= 0"))
    kind = m.schema["id"].dataType.simpleString()
    known = m.withColumn("known", F.array().cast(f"array<{kind}>")) if existing is None else m.join(graph._known(m, existing).withColumnRenamed("src", "id"), ["id", "grp"], "left")
    mine, part = F.pmod(F.xxhash64("id"), F.lit(graph.PARTS)).cast("int"), F.explode(F.array(*[F.lit(k) for k in range(graph.PARTS)]))
    rows = known.select("id", "grp", "at", "known", mine.alias("mine"), part.alias("part")).withColumn("known", F.when(F.col("mine") == F.col("part"), F.col("known")))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id")
        ids, at, known, own = b["id"].to_numpy(), b["at"].to_numpy(), b["known"].to_numpy(), np.flatnonzero((b["mine"] == b["part"]).to_numpy())
        place = {v: i for i, v in enumerate(ids.tolist())}
        if isinstance(exists, Linear):
            x = _taken(vectors.open(), at)
            w = x.shape[1]
            c1, c2, c3 = exists.coef[:w], exists.coef[w : 2 * w], exists.coef[2 * w :]
        src, dst, key, p = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        bound = -np.finfo(float).max if least <= 0 or not isinstance(exists, Linear) else min(math.log(least / (1 - least)) - 1e-6, 25.0) if least < 1 else 25.0
        step = max(1, MARGINS // len(b))
        for lo in range(0, len(own), step):
            s = own[lo : lo + step]
            if isinstance(exists, Linear):
                za = x[s]
                margin = (za * c3 + c2) @ x.T
                margin += (za @ c1 + exists.intercept)[:, None]
            else:
                margin = np.zeros((len(s), len(b)))
            margin[np.arange(len(s)), s] = -np.inf
            for i, k in enumerate(known[s]):
                if k is not None and len(k):
                    margin[i, [place[v] for v in k if v in place]] = -np.inf
            hit = np.flatnonzero(margin.reshape(-1) >= bound)
            got = 1.0 / (1.0 + np.exp(-np.clip(margin.reshape(-1)[hit], -700, 700))) if isinstance(exists, Linear) else np.full(len(hit), exists)
            hit, got = hit[got >= least], got[got >= least]
            src, dst, key, p = np.r_[src, s[hit // len(b)]], np.r_[dst, hit % len(b)], np.r_[key, _rounded(got)], np.r_[p, got]
            order = np.lexsort((dst, src, -key))[:top]
            src, dst, key, p = src[order], dst[order], key[order], p[order]
            if len(key) == top:  # sources come in order: one to come must be surer than the last
                if key[-1] >= 10_000 or not isinstance(exists, Linear):
                    break
                worst = (key[-1] + 0.5) / 1e4
                bound = max(bound, math.log(worst / (1 - worst)) - 1e-6)
        return pd.DataFrame({"src": ids[src], "dst": ids[dst], "a": at[src], "b": at[dst], "p": p})

    few = rows.repartition(parallelism(rows.sparkSession), "grp", "part").groupBy("grp", "part").applyInPandas(run, f"src {kind}, dst {kind}, a bigint, b bigint, p double")
    if not m.where("more IS NOT NULL").isEmpty():
        few = few.dropDuplicates(["src", "dst"])  # each group in common has the pair
    return few.orderBy(F.desc(F.round("p", 4)), "src", "dst").limit(top)
