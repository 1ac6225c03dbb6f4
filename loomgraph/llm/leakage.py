"""Problem 9: held-out passages inside corpus documents.

Q-gram lemma filtering. Texts are reduced to lower-case words joined by single spaces. The q-grams of the
held-out items form the index; a document's q-grams hit it at (item, diagonal = position in the document
minus position in the item). Diagonals fall into bands of 2 * STEP that overlap by STEP, so a passage whose
changes move it by less than STEP characters lies whole in one band. E edited words spoil a bounded number
of q-grams, hence a band with fewer distinct hits than the item's bound cannot hold a case. An item whose words are
too short for a bound at Q is indexed by shorter q-grams, and if none gives a bound, by its words. The bands that
remain are verified by a banded word alignment with at most EDITS edits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths of q-grams, powers of two, longest first: an item takes the first that leaves it LEAST q-grams at least.
QS, LEAST = (16, 8, 4, 2), 4
STEP, EDITS, PART = 64, 2, 0.5
WORD_BAND = 16  # words on either side of the band's diagonal that the alignment may use
#: Characters of held-out text in one broadcast index; more items are taken in several blocks.
BLOCK_CHARS = 8_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MARKUP = re.compile(r"<[^<>\n]{0,80}>|&(?:nbsp|amp|quot|lt|gt|#\d+);")
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_]+")
#: Characters without width or meaning for a word (fixed values).
_DROP = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_DROPPED = re.compile("[" + "".join(map(chr, _DROP)) + "]")


def words(text: str | None) -> list[str]:
    """Words of a text, apart from case, punctuation, spacing, markup and the spelling of characters."""
    t = text or ""
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t.translate(_DROP) if _DROPPED.search(t) else t)
    t = t.casefold()
    return _WORD.findall(_MARKUP.sub(" ", t) if "<" in t or "&" in t else t)


def grams(codes: np.ndarray, q: int = QS[0]) -> np.ndarray:
    """Hashes of all q-grams of an array of code points; q is a power of two: hashes of halves are joined."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, width = codes.astype(np.uint64) + np.uint64(1), 1
    with np.errstate(over="ignore"):
        while width < q:
            h = (h[: len(h) - width] * _BASE) ^ h[width:]
            h ^= h >> np.uint64(29)
            width *= 2
        return h * _BASE


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def bound(w: list[str], q: int) -> int:
    """Least distinct q-grams that a case keeps: those of the shortest half, less what EDITS words can spoil."""
    need = -(-len(w) // 2)
    if not need:
        return 0
    size = [len(x) + 1 for x in w]
    ends = np.cumsum([0, *size])
    least = int(min(ends[need:] - ends[:-need])) - 1
    return least - q + 1 - sum(sorted(size)[-EDITS:]) - EDITS * q


class Index:
    """Q-grams of the items of a block that share one q, sorted by hash, with a bit table in front."""

    BITS = 22

    def __init__(self, items: list[tuple[int, list[str]]], q: int = QS[0]):
        self.q = q
        self.ids, self.words = [i for i, _ in items], [w for _, w in items]
        self.bound = [max(1, bound(w, q)) for w in self.words]
        self.least, self._bounds = min(self.bound, default=1), np.array(self.bound, np.int64)
        hashes = [grams(codes(" ".join(w)), q) for w in self.words]
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        by = np.argsort(h, kind="stable")
        self.hash = h[by]
        # how often a hash stands there from its first place on
        first = np.r_[True, self.hash[1:] != self.hash[:-1]] if len(h) else np.empty(0, bool)
        starts = np.flatnonzero(first)
        self.run = np.zeros(len(h), np.int64)
        self.run[starts] = np.diff(np.r_[starts, len(h)])
        self.item = np.concatenate([np.full(len(x), k, np.int64) for k, x in enumerate(hashes)] or [np.empty(0, np.int64)])[by]
        self.at = np.concatenate([np.arange(len(x)) for x in hashes] or [np.empty(0, np.int64)])[by]
        self.bits = np.zeros(1 << self.BITS, bool)
        self.bits[self._slot(self.hash)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    def bands(self, text: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(item number, positions of the hits in the text, and in the item) of the bands that keep the bound, the fullest first."""
        h = grams(text, self.q)
        pos = np.flatnonzero(self.bits[self._slot(h)])
        if len(pos) < self.least:
            return []
        g = h[pos]
        lo = np.searchsorted(self.hash, g, "left")
        n = np.where(self.hash[np.minimum(lo, len(self.hash) - 1)] == g, self.run[np.minimum(lo, len(self.hash) - 1)], 0)
        if not n.sum():
            return []
        src = np.repeat(pos, n)
        idx = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, at = self.item[idx], self.at[idx]
        # an item's hits in all bands together must keep its bound first
        total = np.bincount(item, minlength=len(self.ids))
        some = (total >= self._bounds)[item]
        if not some.any():
            return []
        if not some.all():
            src, item, at = src[some], item[some], at[some]
        band = (src - at) // STEP
        low = int(band.min()) - 1
        span = int(band.max()) - low + 1
        key = item * span + (band - low)
        bins = len(self.ids) * span
        # a hit counts in its band and in the one below, which overlaps it; a repeated hit may count twice,
        # which can only let more through to the alignment
        if bins <= 4 * len(key) + 50_000:
            count = np.bincount(key, minlength=bins)
            count[:-1] += count[1:].copy()
            keys = np.flatnonzero(count >= self.least)
            count = count[keys]
        else:
            keys, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        by = np.argsort(key, kind="stable")
        key, src, at = key[by], src[by], at[by]
        best: dict[int, list[tuple[int, int]]] = {}
        for k, c in zip(keys.tolist(), count.tolist(), strict=True):
            i = k // span
            if i < len(self.bound) and c >= self.bound[i]:
                best.setdefault(i, []).append((c, k))
        out = []
        for i, found in best.items():
            for _, k in sorted(found, reverse=True):
                x, y = np.searchsorted(key, [k, k + 2])
                out.append((i, src[x:y], at[x:y]))
        return out


def centres(diagonals: np.ndarray) -> list[int]:
    """Diagonals in words such that every given one, EDITS words more or less, is within WORD_BAND of one of them."""
    out: list[int] = []
    reach = WORD_BAND - EDITS
    for v in np.unique(diagonals).tolist():
        if not out or v > out[-1] + reach:
            out.append(v + reach)
    # the one with the most hits first
    return sorted(out, key=lambda c: -int((np.abs(diagonals - c) <= reach).sum()))


def aligned(doc: list[str], item: list[str], centre: int, need: int, band: int = WORD_BAND) -> int:
    """Words of the longest window of item that doc holds in order with at most EDITS edits, near a diagonal.

    An edit is a word changed, dropped or put in. The window counts its changed and dropped words too, and it
    begins and ends with a word that is there. Stops as soon as `need` words are found.
    """
    best = 0
    # cell (i, diagonal): for each number of edits the longest window that ends with item[i] matched or edited there
    width = 2 * band + 1
    none = -1
    prev = [[none] * (width + 2) for _ in range(EDITS + 1)]
    for i, w in enumerate(item):
        cur = [[none] * (width + 2) for _ in range(EDITS + 1)]
        base = i + centre - band
        for s in range(width):
            j = base + s
            if j < 0 or j >= len(doc):
                continue
            hit = doc[j] == w
            for e in range(EDITS + 1):
                v = none
                if hit:
                    p = prev[e][s + 1]  # (i-1, j-1)
                    v = p + 1 if p > 0 else (1 if e == 0 else none)
                    if v > best:
                        best = v
                if e:
                    p = prev[e - 1]
                    x = p[s + 1]  # changed word
                    if x > 0 and x + 1 > v:
                        v = x + 1
                    x = p[s + 2]  # (i-1, j): item word dropped
                    if x > 0 and x + 1 > v:
                        v = x + 1
                    x = cur[e - 1][s]  # (i, j-1): word put in
                    if x > v:
                        v = x
                cur[e][s + 1] = v
        if best >= need:
            return best
        prev = cur
    return best


class Items:
    """The index of a block of items: by q-grams, as long as each item's words allow, or by words."""

    def __init__(self, items: list[tuple[int, str]]):
        read = [(i, w) for i, t in items if (w := words(t))]
        groups: dict[int, list[tuple[int, list[str]]]] = {}
        for i, w in read:
            groups.setdefault(next((q for q in QS if bound(w, q) >= LEAST), 0), []).append((i, w))
        self.short = groups.pop(0, [])
        self.indexes = [Index(g, q) for q, g in groups.items()]


def _longest(w: list[str], item: list[str], diagonals: np.ndarray) -> int:
    """Words of the longest window of item that w holds near one of the diagonals, 0 if it is not the part that counts."""
    need = -(-len(item) * PART // 1)
    for centre in centres(diagonals):
        got = aligned(w, item, centre, len(item) + 1)
        if got >= need:
            return got
    return 0


def leaked(items: Items, text: str | None) -> list[tuple[int, float]]:
    """(item id, share of its words) of the items that a text holds."""
    w = words(text)
    if not w:
        return []
    line = codes(" ".join(w))
    out: list[tuple[int, float]] = []
    word_at = None
    for index in items.indexes:
        done: dict[int, int] = {}
        for i, src, at in index.bands(line):
            if i in done:
                continue
            if word_at is None:
                word_at = np.concatenate([[0], np.cumsum(line == 32)])
            item = index.words[i]
            # the band's diagonals in words, measured where its hits are: words of other lengths before them do not count
            starts = np.cumsum([0, *[len(x) + 1 for x in item]])
            got = _longest(w, item, word_at[src] - (np.searchsorted(starts, at, "right") - 1))
            if got:
                done[i] = got
        out += [(index.ids[i], got / len(index.words[i])) for i, got in done.items()]
    if items.short:
        places: dict[str, list[int]] = {}
        for k, x in enumerate(w):
            places.setdefault(x, []).append(k)
        for i, item in items.short:
            got = _longest(w, item, np.array([p - k for k, x in enumerate(item) for p in places.get(x, ())], np.int64))
            if got:
                out.append((i, got / len(item)))
    return out


def find(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, share): each document and each item of which it holds at least half in one passage.

    Null, empty and wordless texts, on either side, give no rows. A repeated document id with a leaking text
    gives its row once. Texts are scanned whole. Items are broadcast in blocks of bounded size.
    """
    spark = documents.sparkSession
    slim_items = items.select("item_id", F.col("text").alias("t")).where("t IS NOT NULL")
    chars = slim_items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // BLOCK_CHARS))
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    out = None
    for b in range(blocks):
        part = [(r.item_id, r.t) for r in slim_items.where(block_of == b).orderBy("item_id").toLocalIterator()]
        shared = spark.sparkContext.broadcast(Items(part))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            items = shared.value
            for pdf in batches:
                rows = [(d, i, s) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for i, s in leaked(items, t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share"])

        found = docs.mapInPandas(run, "doc_id bigint, item_id bigint, share double")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def items_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: the documents that hold it."""
    hits = find(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.max("share"), 4).alias("max_share"))
    return items.select("item_id").distinct().join(hits, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "max_share")
