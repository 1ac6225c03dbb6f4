"""Problem 2: the same or nearly the same records across splits.

A text is the multiset of its code-token shingles (comments and layout gone), each occurrence numbered, so
that multisets become sets. Jaccard >= THRESHOLD is found exactly by prefix filtering: all shingles have one
global order, rare first; two sets that similar share a shingle within their prefixes. Evaluation prefixes
are the index, training prefixes probe it; length and position filters cut candidates, which must share
COMMON shingles within prefixes that much longer; the full sets decide. The rarity comes from a counter table of fixed size summed over all texts: any total order
keeps the result exact, so collisions cost only time. Bitmaps of fixed size tell which shingles may occur on
the other side at all; they let through too much when full, never too little. Texts with equal token
sequences are one class and are joined once. No join is a broadcast: the planner would size these tables by
their compressed files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.codetext import extension, tokens
from loomgraph.session import cut

#: Cases differ in a few names and values while three quarters of the code is alike; one changed token
#: breaks SHINGLE shingles, so the threshold on shingles lies below that share.
SHINGLE, THRESHOLD = 3, 0.6
SKETCH_BITS = 18  # 2**18 counters of 4 bytes: the broadcast has this size whatever the corpus
SEEN_BITS = 23  # bits of each bitmap: 1 MB
COMMON = 4  # shingles that two sets must share within prefixes longer by as many, less one
_STEP, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def body(text: str) -> tuple[str, str]:
    path, _, code = text.partition("\n")
    return code, extension(path)


class _Ids(dict):
    """32-bit ids of tokens, remembered by the worker."""

    def __missing__(self, t: str) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[t] = xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass"))
        return got


_IDS = _Ids()


def token_ids(text: str) -> np.ndarray:
    """Ids of the code tokens of a text: path line first, code below."""
    t = tokens(*body(text))
    return np.fromiter(map(_IDS.__getitem__, t), np.uint32, len(t))


def shingles(ids: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Shingle ids of a token sequence, none of them twice; a sequence shorter than a shingle is one."""
    k = min(k, len(ids))
    if not k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        wide = ids.astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(ids) - k + 1, np.uint64)
        for i in range(k):
            h = (h + wide[i : i + len(h)]) * _STEP
            h ^= h >> np.uint64(29)
        # the n-th occurrence of a shingle is an element of its own
        h.sort()
        at = np.arange(len(h))
        first = np.r_[True, h[1:] != h[:-1]]
        h = (h + (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64) * _NEXT) * _STEP
        return h ^ (h >> np.uint64(32))


_ROWS = "ord bigint, split string, repo string, cls binary, sh binary"


def shingled(examples: DataFrame, text_col: str = "text", train: str = "train") -> DataFrame:
    """(ord, split, repo, cls, sh): rows of a split with code. Null texts and texts without code are left out.

    A task gives the token ids of a class and side once, however often it meets the class.
    """
    slim = examples.select("ord", "split", F.col(text_col).alias("text")).where("text IS NOT NULL AND split IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given: set[tuple[bytes, bool]] = set()
        for b in batches:
            rows = []
            for o, s, t in b.itertuples(index=False):
                ids = token_ids(t)
                if not len(ids):
                    continue
                cls, sh = xxhash.xxh128_digest(ids.tobytes()), None
                if (cls, s == train) not in given:
                    if len(given) < 1_000_000:
                        given.add((cls, s == train))
                    sh = ids.tobytes()
                rows.append((o, s, t.partition("/")[0].lower(), cls, sh))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ROWS.split(", ")])

    return slim.mapInPandas(run, _ROWS)


def _ids(sh: bytes) -> np.ndarray:
    return shingles(np.frombuffer(sh, np.uint32))


def _slot(h: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(words: DataFrame, bits: int = SEEN_BITS) -> np.ndarray:
    """The bitmap of rows (page, word, bits) of one kind: 2**bits bits, whatever the number of rows."""
    table = np.zeros(1 << (bits - 6), np.uint64)
    packed = words.groupBy(F.shiftright("word", 12).alias("page")).agg(F.collect_list(F.struct("word", "bits")).alias("c"))
    for page in packed.select(F.col("c.word").alias("word"), F.col("c.bits").alias("bits")).toLocalIterator():
        table[page.word] = np.array(page.bits, np.int64).view(np.uint64)
    return table


def _on(table: np.ndarray, h: np.ndarray, bits: int = SEEN_BITS) -> np.ndarray:
    at = _slot(h, bits)
    return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def _words(h: np.ndarray, bits: int = SEEN_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(word, bits) of the words of a bitmap that the hashes set."""
    at = np.unique(_slot(h, bits))
    word = at >> 6
    lo = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(at) else np.empty(0, np.int64)
    if not len(at):
        return lo, lo
    return word[lo], np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), lo).view(np.int64)


def statistics(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrences by slot over all sets, bitmap of evaluation shingles, bitmap of training shingles)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        seen = {k: np.zeros(1 << (SEEN_BITS - 6), np.uint64) for k in (1, 2)}
        for b in batches:
            for kind, part in ((1, b[~b["is_train"]]), (2, b[b["is_train"]])):
                if len(part):
                    h = np.concatenate([_ids(x) for x in part["sh"]])
                    total += np.bincount(_slot(h), minlength=1 << SKETCH_BITS)
                    w, x = _words(h)
                    seen[kind][w] |= x.view(np.uint64)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"kind": 0, "word": at, "bits": total[at]})
        for kind, table in seen.items():
            at = np.flatnonzero(table)
            yield pd.DataFrame({"kind": kind, "word": at, "bits": table[at].view(np.int64)})

    rows = sets.select("is_train", "sh").mapInPandas(count, "kind int, word bigint, bits bigint")
    # at most 2**SKETCH_BITS counters and 2 * 2**(SEEN_BITS - 6) words, whatever the corpus
    both = rows.groupBy("kind", "word").agg(F.sum(F.when(F.col("kind") == 0, F.col("bits"))).alias("n"), F.bit_or(F.when(F.col("kind") > 0, F.col("bits"))).alias("on"))
    rows = cut(both.select("kind", "word", F.when(F.col("kind") == 0, F.least("n", F.lit(2**31 - 1))).otherwise(F.col("on")).alias("bits")))
    counts = bitmap(rows.where("kind = 0"), SKETCH_BITS + 6).astype(np.int64).astype(np.int32)
    return counts, bitmap(rows.where("kind = 1")), bitmap(rows.where("kind = 2"))


def _prefix(n: int, threshold: float) -> int:
    return n - int(np.ceil(threshold * n - 1e-9)) + COMMON


def overlaps(examples: DataFrame, threshold: float = THRESHOLD, train: str = "train") -> tuple[DataFrame, DataFrame]:
    """(class pairs with their similarity, membership).

    pairs: cls_e, cls_t, sim of every evaluation class and training class at or above the threshold;
    members: ord, split, repo, cls, is_train. Copies are members of one class. Ties in the shingle order
    fall by shingle id. Empty tables give no rows; extra columns are never read.
    """
    spark = examples.sparkSession
    rows = cut(shingled(examples, train=train))
    members = rows.select("ord", "split", "repo", "cls", (F.col("split") == train).alias("is_train"))
    sets = rows.where("sh IS NOT NULL").select("cls", (F.col("split") == train).alias("is_train"), "sh")
    shared = spark.sparkContext.broadcast(statistics(sets))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, ev, tr = shared.value
        for b in batches:
            grams, places, size = [], [], []
            for side, sh in zip(b["is_train"], b["sh"], strict=True):
                h = _ids(sh)
                first = h[np.lexsort((h, counts[_slot(h)]))[: _prefix(len(h), threshold)]]
                # what cannot be on the other side is left out, the places stay
                at = np.flatnonzero(_on(ev if side else tr, first))
                grams.append(first[at].tobytes())
                places.append(at.astype(np.int32).tobytes())
                size.append(len(h))
            yield pd.DataFrame({"cls": b["cls"], "is_train": b["is_train"], "n": size, "grams": grams, "places": places})

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            count = [len(g) // 8 for g in b["grams"]]
            key = np.frombuffer(b"".join(c[:8] for c in b["cls"]), np.int64)
            yield pd.DataFrame({"key": np.repeat(key, count), "is_train": np.repeat(b["is_train"].to_numpy(bool), count), "n": np.repeat(b["n"].to_numpy(np.int32), count), "gram": np.frombuffer(b"".join(b["grams"]), np.int64), "pos": np.frombuffer(b"".join(b["places"]), np.int32)})

    # a class may come from many tasks: one prefix of it goes on
    one = sets.mapInPandas(prefixes, "cls binary, is_train boolean, n int, grams binary, places binary").where(F.length("grams") > 0)
    one = one.groupBy("cls", "is_train").agg(F.first("n").alias("n"), F.first("grams").alias("grams"), F.first("places").alias("places"))
    # half of a class's id is its key among the candidates: two classes of one key are candidates together
    heads = one.mapInPandas(opened, "key bigint, is_train boolean, n int, gram bigint, pos int")
    index = heads.where("NOT is_train").select("gram", F.col("key").alias("e"), F.col("pos").alias("pe"), F.col("n").alias("ne"))
    probe = heads.where("is_train").select("gram", F.col("key").alias("t"), F.col("pos").alias("pt"), F.col("n").alias("nt"))
    need = F.ceil((F.col("ne") + F.col("nt")) * (threshold / (1 + threshold)) - 1e-9)
    few = F.least(F.lit(COMMON), need)
    # the first `few` common shingles of a pair have need - few others behind them on both sides
    early = (F.col("pe") < F.col("ne") - need + few) & (F.col("pt") < F.col("nt") - need + few)
    cand = (
        probe.join(index.hint("merge"), "gram")
        .where((F.col("ne") >= F.col("nt") * threshold) & (F.col("nt") >= F.col("ne") * threshold) & early)
        .select("e", "t", few.cast("int").alias("few"))
        .groupBy("e", "t")
        .agg(F.count(F.lit(1)).alias("k"), F.min("few").alias("few"))
        .where("k >= few")
        .select("e", "t")
    )
    cand = cut(cand)
    ends = cand.select(F.explode(F.array("e", "t")).alias("key")).distinct()
    chosen = spark.sparkContext.broadcast(_bitmap_of(ends, "key"))

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(key=np.frombuffer(b"".join(c[:8] for c in b["cls"]), np.int64))
            yield b[_on(chosen.value, _mixed(b["key"].to_numpy()))]

    # the sets of the candidates only, without a shuffle of all sets
    kept = sets.select("cls", "sh").mapInPandas(wanted, "cls binary, sh binary, key bigint").join(ends.hint("merge"), "key", "left_semi").groupBy("cls").agg(F.first("key").alias("key"), F.first("sh").alias("sh"))
    kept = cut(kept)
    she = kept.select(F.col("key").alias("e"), F.col("cls").alias("cls_e"), F.col("sh").alias("she"))
    sht = kept.select(F.col("key").alias("t"), F.col("cls").alias("cls_t"), F.col("sh").alias("sht"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sim = []
            for x, y in zip(b["she"], b["sht"], strict=True):
                x, y = _ids(x), _ids(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                sim.append(both / (len(x) + len(y) - both))
            out = b[["cls_e", "cls_t"]].assign(sim=np.array(sim, float))
            yield out[out["sim"] >= threshold]

    pairs = cand.join(she.hint("merge"), "e").join(sht.hint("merge"), "t").drop("e", "t").mapInPandas(verify, "cls_e binary, cls_t binary, sim double")
    return pairs, members


def _mixed(keys: np.ndarray) -> np.ndarray:
    h = keys.view(np.uint64) * _STEP
    return (h ^ (h >> np.uint64(29))) * _NEXT


def _bitmap_of(rows: DataFrame, col: str) -> np.ndarray:
    """The bitmap of a column of keys."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w, x = _words(_mixed(b[col].to_numpy(np.int64)))
            yield pd.DataFrame({"word": w, "bits": x})

    return bitmap(rows.select(col).mapInPandas(mark, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")))


def row_pairs(examples: DataFrame) -> DataFrame:
    """Every (evaluation row, training row) pair, copies expanded: ord_e, split, repo, ord_t, sim."""
    pairs, members = overlaps(examples)
    ev = members.where("NOT is_train").select(F.col("cls").alias("cls_e"), F.col("ord").alias("ord_e"), "split", "repo")
    tr = members.where("is_train").select(F.col("cls").alias("cls_t"), F.col("ord").alias("ord_t"))
    return pairs.join(ev.hint("merge"), "cls_e").join(tr.hint("merge"), "cls_t").select("ord_e", "split", "repo", "ord_t", "sim")


def report(examples: DataFrame) -> DataFrame:
    """Per evaluation split and repository: rows with code, and rows that also occur in training."""
    pairs, members = overlaps(examples)
    hit = pairs.select(F.col("cls_e").alias("cls")).distinct().withColumn("hit", F.lit(1))
    ev = members.where("NOT is_train").join(hit.hint("merge"), "cls", "left")
    return ev.groupBy("split", "repo").agg(F.count(F.lit(1)).alias("n_rows"), F.count("hit").alias("n_leaked"))
