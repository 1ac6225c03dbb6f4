"""Problem 8: token ids of whole texts by a public byte-level BPE vocabulary.

Two tiers. A minimal perfect hash over the vocabulary (hash and displace, one slot a token) turns a
pre-token that is itself in the vocabulary into its id. A miss is merged by a heap of adjacent pairs over a
doubly linked list of its bytes, lowest rank first, leftmost among equals.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; a parameter, never copied into the package.
VOCABULARY_DIR = os.environ.get("LOOMGRAPH_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenising pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 200_000  # pre-tokens a worker remembers; beyond that it starts anew


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash: n keys in n slots; key and value of a slot are stored to tell strangers."""

    def __init__(self, items: dict[bytes, int]):
        keys = list(items)
        self.n, self.m = len(keys), max(1, len(keys) // 2)
        buckets: list[list[bytes]] = [[] for _ in range(self.m)]
        for k in keys:
            buckets[xxhash.xxh64_intdigest(k, 0) % self.m].append(k)
        taken = bytearray(self.n)
        self.shift = np.zeros(self.m, np.int64)
        self.keys: list[bytes] = [b""] * self.n
        self.values = np.zeros(self.n, np.int32)
        free = 0
        for b in sorted(range(self.m), key=lambda i: -len(buckets[i])):
            group = buckets[b]
            if not group:
                break
            if len(group) == 1:  # a lone key takes the next free slot; its bucket stores that slot
                while taken[free]:
                    free += 1
                slots, self.shift[b] = [free], -free - 1
            else:
                d = 0
                while True:
                    slots = [xxhash.xxh64_intdigest(k, d + 1) % self.n for k in group]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    d += 1
                self.shift[b] = d
            for k, s in zip(group, slots, strict=True):
                taken[s], self.keys[s], self.values[s] = 1, k, items[k]

    def slot(self, key: bytes) -> int:
        d = int(self.shift[xxhash.xxh64_intdigest(key, 0) % self.m])
        return -d - 1 if d < 0 else xxhash.xxh64_intdigest(key, d + 1) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        s = self.slot(key)
        return int(self.values[s]) if self.keys[s] == key else None


def merge(piece: bytes, table: PerfectHash) -> list[int]:
    """Ids of a pre-token outside the vocabulary: O(n log n) in its bytes, however long it is."""
    n = len(piece)
    start, end = list(range(n)), list(range(1, n + 1))  # node i spans piece[start[i]:end[i]]
    nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and (rank := table.get(piece[start[i] : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != to:
            continue  # the pair has changed since
        j = nxt[i]
        end[i], nxt[i], alive[j] = end[j], nxt[j], 0
        if nxt[j] < n:
            prev[nxt[j]] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(table.get(piece[start[i] : end[i]]))
        i = nxt[i]
    return out


class Encoder(dict):
    """Maps pre-tokens to id tuples, remembering what it has seen."""

    def __init__(self, table: PerfectHash):
        super().__init__()
        self.table, self.split = table, regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        hit = self.table.get(raw)
        ids = [hit] if hit is not None else merge(raw, self.table)
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            for piece in self.split(text):
                out += self[piece]
        return out


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the ids of every text without special tokens; [] for an empty and for a null text.

    Every row yields a row (repeats too); strings of special tokens are ordinary text; other columns are
    not read. The vocabulary's tables are broadcast: their size is that of the file, whatever the corpus.
    """
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(PerfectHash(read_ranks(path or os.path.join(VOCABULARY_DIR, VOCABULARY))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(table.value)
        for batch in batches:
            rows = [coder.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)])
            flat = np.fromiter((i for r in rows for i in r), np.int32, int(ends[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    slim = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    back = {v: k for k, v in ranks.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "surrogatepass")
