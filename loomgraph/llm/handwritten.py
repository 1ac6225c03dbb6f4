"""Problem 5: generated, minified, vendored files and data blobs among source files.

A file is told by its path, by its own code (markers in its comments, minified lines, literals that make up the
file), or by its cluster. Clusters come from MinHash bands over shingles of identifier-masked tokens. Within a
repository, files of different content that repeat one masked pattern, or follow one masked template under other
names, are a family: generated. Across repositories, a file whose cluster holds a vendor's file (by mark or path)
and that keeps its names is a copy of it: vendored; that a hand-written file occurs elsewhere tells nothing.
Files whose masked tokens are literals only are blobs. Buckets are compared by heads until every member was a head
or is linked; every member is verified with its likeliest partner first, and with all the others only if that
fails, so no link within a bucket is lost and few sets travel.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.codetext import HASH, SLASH, extension, tokens
from loomgraph.llm.split_overlap import _mixed, _on, _words, bitmap
from loomgraph.session import cut, parallelism

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 12, 3
LONG_LINE, LONG_SHARE, MAX_BLANK = 300, 0.6, 0.12
BLOB_LITERALS, BLOB_TOKENS = 0.45, 40
CALLS = 0.04  # opening parentheses over tokens, at least, of code
PACKED, BLOB_CHARS = 40, 0.6  # characters of a packed string (no blanks), and their share in a blob
_PACKED_LINE = re.compile(r"(?m)^[A-Za-z0-9+/=]{40,}$")
_PACKED = re.compile(r"[\"'][A-Za-z0-9+/=_\\x-]+[\"']")
#: Distinct shingles over tokens: a family repeats itself; a lone file must do so even more.
FAMILY_VARIETY, LONE_VARIETY, LONE_TOKENS = 0.3, 0.16, 80
#: One template: so many windows of SHINGLE tokens in a row, their similarity at least, and the names in common at most
#: (a hand-edited copy keeps its names); for files of LONE_TOKENS tokens and more.
WINDOWS, TEMPLATE, SAME_NAMES = 4, 0.6, 0.5
WORDS, TEMPLATE_WORDS = 8, 8  # 64-bit words of the bitmaps of a shingle set and of a template
BLOCK, BLOCK_PAIRS = 64, 400_000  # heads of a large bucket, and pairs with them, that are compared in one go
ALL_PAIRS = 64  # members of a bucket up to which all its pairs are compared
#: Repositories that hold a content by a vendor's mark or path before copies elsewhere count as vendored: of one such
#: copy and one file without a mark either may be the original.
HOLDERS = 2
SMALL_IDS = 50_000
FEW_HEADS = 10_000  # vendored contents whose bands may be broadcast (6 MB); more are joined by shuffle

#: Paths (fixed values), Java and Python regex alike, on the lower-case path.
VENDOR_PATH = r"(?:^|/)(?:node_modules|bower_components|jspm_packages|web_modules|_vendor|vendored|third[_-]?party|3rd[_-]?party|pods|carthage|site-packages)/|(?:^|/)(?:vendor|external|deps)/[^/]+/"
GENERATED_PATH = r"(?:^|/)(?:gen|generated|__generated__|autogen|auto[_-]generated|generated[_-](?:sources?|src|code))/|\.(?:gen|generated|pb|g|designer)\.[a-z]+$|[._-](?:autogen|auto[_-]?generated)\.[a-z]+$|(?:^|/)zz_generated[._]|_pb2(?:_grpc)?\.pyi?$|_pb\.(?:js|ts|d\.ts|rb)$|outerclass\.java$|grpc\.java$|(?:^|/)(?:(?:package|npm|yarn|pnpm)-(?:lock|shrinkwrap)[^/.]*|[^/]*\.lock)(?:\.json|\.ya?ml)?$|(?:^|/)(?:go\.sum|yarn\.lock|poetry\.lock|cargo\.lock|gemfile\.lock)$"
MINIFIED_PATH = r"[.-]min\.(?:js|mjs|css)$|\.(?:bundle|chunk)\.(?:js|mjs|css)$|\.[0-9a-f]{8,20}\.(?:js|mjs|css)$"
PATHS = f"{VENDOR_PATH}|{GENERATED_PATH}|{MINIFIED_PATH}"
#: Leading comments of generated files, anchored at the comment's first word (fixed values).
GENERATED_MARK = re.compile(
    r"(?i)(?:code )?(?:auto-?|automatically )?generated (?:by|from|file)\b|auto-?generated\b|<auto-generated|@generated\b|this (?:file|code) (?:was|is) (?:created |auto-?|automatically )*(?:generated|created automatically)|machine (?:written|generated)\b"
    r"|produced from \S+\.\w+ by|source of truth: \S+\.\w+|output of \S+ v?\d|do not (?:change|edit|modify) by hand\b|rebuilt by \S+"
)
#: Every one of these marks holds one of these in lower case.
_GENERATED_WORDS = ("generated", "created automatically", "machine written", "produced from ", "source of truth: ", "output of ", "by hand", "rebuilt by ")
#: Leading comments of third-party copies (fixed values).
VENDOR_MARK = re.compile(
    r"(?i)[\w@/.-]+ v?\d+\.\d+\.\d+\b(?:\s*$|\s*[-|*]| released)|bundled copy of|vendored (?:copy|from)|copied verbatim from|this file (?:comes|is taken|was taken) from (?:the )?\S+|upstream: \S+://|(?:imported|copied|taken|vendored|pulled|synced|mirrored|bundled|included|forked|borrowed) (?:as[- ]is |verbatim |unchanged |unmodified )?from (?:the )?\S+.*?(?:\b(?:commit|revision|rev|version|release|tag)\b|\bv?\d+\.\d+|\bunchanged\b|\bunmodified\b|\bas[- ]is\b|\bverbatim\b|https?://)|origin: \S+@v?\d|\S+ \(c\) .*(?:our build|renames the package)"
)
_LOCK = re.compile(r'"(?:lockfile|lock)_?[vV]ersion"\s*:')
_MARGIN_COMMENT = re.compile(r"(?m)^(?:#!?|//+!?|/\*+!?|\*|<!--|;|--)[ \t]*(\S.*)$")
_COMMENT_HEAD = re.compile(r"\s*(?:#!?|//+!?|/\*+!?|\*+/?|<!--|;|--)\s*(.*?)(?:\s*\*/|\s*-->)?\s*$")
#: Words whose masking would hide the shape of the code (fixed values).
_KEEP = frozenset("if else for while return def class function func public private static const let var import export package try catch except switch case new throw raise with as in is not and or lambda struct enum void int".split())


def repo_key(url: Column) -> Column:
    """host/owner/name in lower case, the same for every spelling of an address (scheme, ssh form, suffix, slashes)."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"[/\s]+$", ""), r"(\.git)?/*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^(?:[a-z+]+://)?(?:[^@/]+@)?", ""), r"^([^/:]+)(?::\d+/|:)", "$1/")


def leading_comments(code: str) -> list[str]:
    """Texts of all comment lines before the first line of code (a shebang and blank lines may stand between), however many."""
    out: list[str] = []
    close = None  # what ends the block comment that is open
    for line in code.split("\n"):
        text = line.strip()
        if not text:
            continue
        if close is None:
            m = _COMMENT_HEAD.match(line)
            if not m:
                break
            out.append(m.group(1))
            if text.startswith(("/*", "<!--")):
                close = "*/" if text[0] == "/" else "-->"
        else:
            out.append(text.split(close)[0].lstrip("*").strip())
        if close and close in text:
            close = None
    return out


def minified(code: str) -> bool:
    n = len(code)
    if n < LONG_LINE:
        return False
    # blanks tell most files at once: the lines are looked at only where they are few
    return sum(map(code.count, " \t")) <= MAX_BLANK * n and sum(len(x) for x in code.split("\n") if len(x) > LONG_LINE) >= LONG_SHARE * n


def signed(code: str) -> bool:
    """Whether an unindented comment line is a generator's mark; lines are sought only in texts that hold a word of one."""
    if code.isascii():
        low = code.lower()
        if not any(word in low for word in _GENERATED_WORDS):
            return False
    return any(map(GENERATED_MARK.match, _MARGIN_COMMENT.findall(code)))


_STRING, _NUMBER, _NAME = 1, 2, 3
_WORD_CODE = {w: 4 + i for i, w in enumerate(sorted(_KEEP))}


def _code(t: str) -> int:
    """The byte of a masked token: strings, numbers and names are one each, kept words and marks their own."""
    c = t[0]
    if c in "\"'":
        return _STRING
    if c.isdigit():
        return _NUMBER
    if c.isalpha() or c in "_$":
        return _WORD_CODE.get(t, _NAME)
    return 64 + ord(c) if ord(c) < 128 else 192 + ord(c) % 64


class _Table(dict):
    """Tokens of a worker, numbered; what is known of each lies in arrays by number. Cleared when it has grown large."""

    def __init__(self, room: int = 1 << 16) -> None:
        self.codes, self.hashes, self.packed = np.zeros(room, np.uint8), np.zeros(room, np.uint64), np.zeros(room, np.int32)
        self.fresh: list[str] = []

    def __missing__(self, t: str) -> int:
        k = self[t] = len(self)
        self.fresh.append(t)
        return k

    def _learn(self) -> None:
        """Fill the arrays for the tokens that were numbered since, all in one go."""
        new, self.fresh = self.fresh, []
        while len(self) > len(self.codes):
            self.codes, self.hashes, self.packed = (np.concatenate([x, np.zeros_like(x)]) for x in (self.codes, self.hashes, self.packed))
        at = slice(len(self) - len(new), len(self))
        self.codes[at] = [_code(t) for t in new]
        self.hashes[at] = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in new), np.uint64, len(new))
        self.packed[at] = [len(t) if len(t) >= PACKED and _PACKED.fullmatch(t) else 0 for t in new]

    def read(self, toks: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """(bytes of the masked tokens, hashes of the tokens, characters in packed strings)."""
        if len(self) > 500_000:
            self.clear()
        at = np.fromiter(map(self.__getitem__, toks), np.int64, len(toks))
        if self.fresh:
            self._learn()
        return self.codes[at], self.hashes[at], int(self.packed[at].sum())


_TOKENS = _Table()
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, np.uint64) | np.uint64(1)


_STEP, _FOLD, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(31), np.uint64(32)
_RNG = np.random.default_rng(11)
_A = _RNG.integers(1, 2**63, BANDS * ROWS, np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64)


class Features(NamedTuple):
    generated: bool
    vendored: bool
    minified: bool
    blob: bool
    variety: float
    n_tokens: int
    content: bytes
    calls: bool
    n: int = 0
    nt: int = 0
    seq: bytes | None = None
    names: bytes | None = None
    bits: np.ndarray | None = None
    bands: np.ndarray | None = None


def _once(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _FOLD)
    return _distinct(h)


def _distinct(h: np.ndarray) -> np.ndarray:
    """np.unique of an array that is sorted in place; that costs several times as much for the few numbers of a file."""
    h.sort()
    first = np.empty(len(h), bool)
    first[:1] = True
    np.not_equal(h[1:], h[:-1], out=first[1:])
    return h[first]


def _hashed(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of SHINGLE, and of WINDOWS * SHINGLE masked tokens, by their first token."""
    ids = _BYTE[seq]
    h = ids[: max(0, len(ids) - SHINGLE + 1)].copy()
    for i in range(1, SHINGLE):
        h *= _STEP
        h += ids[i : i + len(h)]
    t = h[: max(0, len(h) - SHINGLE * (WINDOWS - 1))].copy()
    for i in range(1, WINDOWS):
        t *= _STEP
        t += h[i * SHINGLE : i * SHINGLE + len(t)]
    return h, t


def sets_of(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle set, template set) of the masked tokens of a file: windows of SHINGLE, and of WINDOWS * SHINGLE tokens."""
    h, t = _hashed(seq)
    return _once(h), _once(t)


_SALT = np.arange(BANDS, dtype=np.uint64)
#: Tokens of files whose sets are made in one go.
GROUP_TOKENS = 8_192


def _runs(all_: np.ndarray, start: np.ndarray, count: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, how many, bitmap) of files side by side whose windows begin at so many places from start on."""
    upto = np.cumsum(count)
    of = np.repeat(np.arange(len(count)), count)
    h = all_[np.arange(len(of)) + (start - (upto - count))[of]]
    h ^= h >> _FOLD
    for lo, hi in zip((upto - count).tolist(), upto.tolist(), strict=True):
        h[lo:hi].sort()
    first = np.empty(len(h), bool)
    first[:1] = True
    np.not_equal(h[1:], h[:-1], out=first[1:])
    first[(upto - count)[count > 0]] = True
    on = np.zeros((len(count), 64 * words), bool)
    on[of, (h & np.uint64(64 * words - 1)).astype(np.int64)] = True
    return h[first], np.bincount(of[first], minlength=len(count)), np.packbits(on, axis=1).view(np.int64)


def _traits_of(seqs: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(size of the shingle set, of the template set, bitmaps of both, keys of the MinHash bands) of files of SHINGLE tokens or more.

    As sets_of tells them, but for many files at a time: most have too few tokens for arrays of their own to pay.
    """
    size = np.array([len(s) for s in seqs])
    start = np.cumsum(size) - size
    h, t = _hashed(np.concatenate(seqs))
    h, n, bits = _runs(h, start, size - SHINGLE + 1, WORDS)
    _, nt, more = _runs(t, start, np.maximum(0, size - SHINGLE * WINDOWS + 1), TEMPLATE_WORDS)
    begin, least, x = np.cumsum(n) - n, np.empty((len(_A), len(n)), np.uint64), np.empty_like(h)
    for k in range(len(_A)):
        np.multiply(h, _A[k], out=x)
        np.add(x, _B[k], out=x)
        np.minimum.reduceat(x, begin, out=least[k])
    sig = least.T.reshape(len(n), BANDS, ROWS)
    band = sig[:, :, 0].copy()
    for r in range(1, ROWS):
        band *= _STEP
        band += sig[:, :, r]
    band += _SALT
    return zip(n.tolist(), nt.tolist(), np.concatenate([bits, more], axis=1), band.view(np.int64), strict=True)


def features(path: str, code: str) -> Features:
    """What tells a file's kind; masked tokens, names, bitmaps and band keys only where it can be of a family or a copy."""
    return features_of([(path, code)])[0]


def features_of(files: Iterable[tuple[str, str]]) -> list[Features]:
    """features() of many files."""
    out: list[Features] = []
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    tokens_held = 0

    def fill() -> None:
        for (k, seq, names), (n, nt, bits, bands) in zip(held, _traits_of([seq for _, seq, _ in held]), strict=True):
            out[k] = out[k]._replace(variety=n / len(seq), n=n, nt=nt, seq=seq.tobytes(), names=names.tobytes(), bits=bits, bands=bands)
        held.clear()

    for path, code in files:
        told, seq, names = _told(path, code)
        if seq is not None:
            held.append((len(out), seq, names))
            tokens_held += len(seq)
        out.append(told)
        if tokens_held >= GROUP_TOKENS:
            fill()
            tokens_held = 0
    if held:
        fill()
    return out


def _told(path: str, code: str) -> tuple[Features, np.ndarray | None, np.ndarray | None]:
    """(what tells a file's kind without its sets, masked tokens, names): the last two where it can be of a family or a copy."""
    code = code.replace("\r\n", "\n")
    ext = extension(path)
    program = ext in HASH | SLASH and ext not in ("yml", "yaml", "ini", "cfg", "toml", "conf")
    # a generator may sign below the imports or at the very end: every unindented comment line counts
    gen = signed(code) or (ext == "json" and bool(_LOCK.search(code)))
    ven = any(VENDOR_MARK.match(h) for h in leading_comments(code))
    small = program and minified(code)
    seq, hashes, packed = _TOKENS.read(tokens(code, ext))
    n = len(seq)
    content = xxhash.xxh128_digest(hashes.tobytes())
    # in a blob literals and the marks between them are nearly all there is, by tokens or by characters
    of = np.bincount(seq, minlength=256)
    literals, rest = int(of[: _NUMBER + 1].sum()), int(of[_NUMBER + 1 : 64].sum())
    packed += sum(map(len, _PACKED_LINE.findall(code))) if program else 0
    table = n >= BLOB_TOKENS and literals >= BLOB_LITERALS * n and rest <= max(8, 0.05 * n)
    blob = program and (table or packed >= BLOB_CHARS * len(code))
    calls = int(of[64 + ord("(")]) >= CALLS * n
    # settings, prose and markup repeat one pattern by nature: only code makes a family
    if n < SHINGLE or small or blob or not (program or calls):
        return Features(gen, ven, small, blob, 1.0, n, content, calls), None, None
    return Features(gen, ven, small, blob, 1.0, n, content, calls), seq, _distinct((hashes[seq == _NAME] >> _HALF).astype(np.uint32))


_SCHEMA = "id bigint, repo string, filepath string, path_bad boolean, generated boolean, vendored boolean, minified boolean, blob boolean, variety double, n_tokens int, content binary, calls boolean, n int, nt int, seq binary, names binary, bits array<bigint>, bands array<bigint>"


def described(sources: DataFrame) -> DataFrame:
    """The features of every file with code; null and blank code gives no row. The code itself goes no further.

    Every code file carries its masked tokens and bands, marked ones too: a family is told by its links, not before.
    """
    slim = sources.select(F.xxhash64("repo_url", "filepath").alias("id"), repo_key(F.col("repo_url")).alias("repo"), "filepath", F.lower("filepath").rlike(PATHS).alias("path_bad"), "code")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told = features_of(zip(b["filepath"], b["code"], strict=True))
            rows = [(*x, *f) for x, f in zip(b[["id", "repo", "filepath", "path_bad"]].itertuples(index=False), told, strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    return slim.where("code IS NOT NULL AND trim(code) <> '' AND filepath IS NOT NULL AND repo IS NOT NULL").mapInPandas(run, _SCHEMA)


_WORDS = [f"w{k}" for k in range(WORDS + TEMPLATE_WORDS)]


class Traits(NamedTuple):
    """What a bucket knows of its members: sizes of both sets, whether a file repeats itself, is long, and both bitmaps."""

    n: np.ndarray
    nt: np.ndarray
    repeats: np.ndarray
    long: np.ndarray
    bits: np.ndarray


def _can_be(n: np.ndarray, m: np.ndarray, differ: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of n and m elements can be alike by `least`: they differ in at least as many elements as their bitmaps in bits."""
    return (np.minimum(n, m) >= least * np.maximum(n, m)) & (differ * (1 + least) <= (1 - least) * (n + m) + 1e-6)


def _may_link(t: Traits, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    """Never false for a link; what is cheap to tell goes first."""
    one = np.ndim(a) == 0

    def differ(k: np.ndarray, words: slice) -> np.ndarray:
        return np.bitwise_count(t.bits[a if one else a[k], words] ^ t.bits[b[k], words]).sum(axis=1, dtype=np.int64)

    repeat, least, most = t.repeats[a] & t.repeats[b], np.minimum(t.n[a], t.n[b]), np.maximum(t.n[a], t.n[b])
    k = np.flatnonzero((least >= SIMILAR * most) & (repeat | (t.long[a] & t.long[b])))
    x = k if not one else slice(None)
    k = k[_can_be(np.atleast_1d(t.n[a])[x], t.n[b[k]], differ(k, slice(0, WORDS)), SIMILAR)]
    x = k if not one else slice(None)
    k = k[repeat[k] | _can_be(np.atleast_1d(t.nt[a])[x], t.nt[b[k]], differ(k, slice(WORDS, None)), TEMPLATE)]
    out = np.zeros(len(b), bool)
    out[k] = True
    return out


def compared(bucket: np.ndarray, traits: Traits, most: int = ALL_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, big): index pairs within the buckets, equal buckets side by side, that may be links: all of them in a bucket
    of at most `most` members; else those of heads, the next head being the first member that no head reached.

    Members are taken by size: what is too large for one is too large for all before it.
    """
    by = np.lexsort((traits.n, bucket))
    bucket, traits = bucket[by], Traits(*(x[by] for x in traits))
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[starts[1:], len(bucket)]
    end = np.repeat(ends, ends - starts)
    left = np.flatnonzero(np.repeat(ends - starts <= most, ends - starts))
    xs, ys, bigs = [], [], []

    def keep(x: np.ndarray, y: np.ndarray, big: bool) -> None:
        xs.append(x), ys.append(y), bigs.append(np.full(len(x), big))

    for step in range(1, most):
        left = left[left + step < end[left]]
        left = left[traits.n[left] >= SIMILAR * traits.n[left + step]]
        if not len(left):
            break
        ok = _may_link(traits, left, left + step)
        keep(left[ok], left[ok] + step, False)
    for lo, hi in zip(starts[ends - starts > most], ends[ends - starts > most], strict=True):
        n = traits.n[lo:hi]
        first = lo + np.searchsorted(n, np.ceil(SIMILAR * n - 1e-9), "left")
        last = lo + np.searchsorted(n, np.floor(n / SIMILAR + 1e-9), "right")
        open_, head = np.ones(hi - lo, bool), 0
        size = max(1, min(BLOCK, BLOCK_PAIRS // int((last - first).max())))
        while head < len(open_):
            # the next open members and all that their sizes allow, in one go; whom an earlier one reaches is no head
            block = head + np.flatnonzero(open_[head : head + size])
            count = (last - first)[block]
            x = np.repeat(lo + block, count)
            y = np.repeat(first[block], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            ok = _may_link(traits, x, y) & (x != y)
            x, y = x[ok], y[ok]
            at = np.searchsorted(x, lo + np.r_[block, hi])
            for k, h in enumerate(block):
                if open_[h]:
                    near = y[at[k] : at[k + 1]]
                    open_[near - lo] = False
                    if len(near):
                        keep(np.full(len(near), lo + h), near, True)
            head += size
    if not xs:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return by[np.concatenate(xs)], by[np.concatenate(ys)], np.concatenate(bigs)


def _stars(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Pairs to verify of the buckets of one partition, sorted by bucket and member; a bucket is kept until it is whole."""

    def pairs(parts: list[pd.DataFrame]) -> pd.DataFrame:
        b = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        bucket, m = b["bucket"].to_numpy(), b["member"].to_numpy()
        # rows of one content in a bucket lie side by side
        once = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (m[1:] != m[:-1])])
        bucket, m = bucket[once], m[once]
        traits = Traits(b["n"].to_numpy(np.int64)[once], b["nt"].to_numpy(np.int64)[once], b["repeats"].to_numpy(bool)[once], b["long"].to_numpy(bool)[once], b[_WORDS].to_numpy(np.int64)[once].view(np.uint64))
        x, y, big = compared(bucket, traits, most)
        return pd.DataFrame({"a": np.minimum(m[x], m[y]), "b": np.maximum(m[x], m[y]), "big": big})

    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = int(np.searchsorted(b["bucket"].to_numpy(), b["bucket"].iloc[-1]))
        if held and (last or held[-1]["bucket"].iloc[-1] != b["bucket"].iloc[0]):
            yield pairs([*held, b.iloc[:last]])
            held = []
        elif last:
            yield pairs([b.iloc[:last]])
        held.append(b.iloc[last:])
    if held:
        yield pairs(held)


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 0.0


class _Sets:
    """Sets of the members of a batch, made once each."""

    def __init__(self) -> None:
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, member: int, seq: bytes) -> tuple[np.ndarray, np.ndarray]:
        got = self.known.get(member)
        if got is None:
            if len(self.known) > 2_000:
                self.known.clear()
            got = self.known[member] = sets_of(np.frombuffer(seq, np.uint8))
        return got


def _family(x: dict, y: dict, sets: _Sets) -> bool:
    """Whether two files of a repository are linked: alike, and both repeat themselves or follow one template under other names."""
    (hx, tx), (hy, ty) = sets.of(x["member"], x["seq"]), sets.of(y["member"], y["seq"])
    if _jaccard(hx, hy) < SIMILAR:
        return False
    if x["repeats"] and y["repeats"]:
        return True
    names = [np.frombuffer(k["names"], np.uint32) for k in (x, y)]
    return x["long"] and y["long"] and _jaccard(tx, ty) >= TEMPLATE and _jaccard(*names) < SAME_NAMES


def _copy(x: dict, y: dict, sets: _Sets) -> bool:
    """Whether two files are copies of one, perhaps edited: alike, and most names are the same."""
    names = [np.frombuffer(k["names"], np.uint32) for k in (x, y)]
    return _jaccard(*names) >= SAME_NAMES and _jaccard(sets.of(x["member"], x["seq"])[0], sets.of(y["member"], y["seq"])[0]) >= SIMILAR


_FIELDS = ("member", "seq", "names", "repeats", "long")


def _verified(pairs: DataFrame, sets: DataFrame, link) -> DataFrame:
    """The pairs (a, b) that are links."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("member")).distinct()
    own = sets.join(ends.hint("merge"), "member", "left_semi").groupBy("member").agg(*[F.first(c).alias(c) for c in _FIELDS[1:]])
    x, y = (own.select(F.col("member").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in _FIELDS[1:]]) for k in "ab")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Sets()
        for b in batches:
            cols = [b[c].tolist() for c in ("a", "b", *[f"{k}_{c}" for k in "ab" for c in _FIELDS[1:]])]
            ok = [link(dict(zip(_FIELDS, (r[0], *r[2:6]), strict=True)), dict(zip(_FIELDS, (r[1], *r[6:10]), strict=True)), known) for r in zip(*cols, strict=True)]
            yield b[["a", "b"]][np.array(ok, bool)]

    return pairs.select("a", "b").join(x.hint("merge"), "a").join(y.hint("merge"), "b").mapInPandas(run, "a bigint, b bigint")


def _sized(ids: DataFrame) -> DataFrame:
    """A written table of ids for a join: broadcast while it is small (1 MB), else merged."""
    return F.broadcast(ids) if ids.limit(SMALL_IDS + 1).count() <= SMALL_IDS else ids.hint("merge")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("member")).distinct()


def _linked(pairs: DataFrame, sets: DataFrame, link) -> DataFrame:
    """(member) of the members with a link among the pairs (a, b, k): the likeliest partner of each is tried first, the
    other pairs only of those without a link by then."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("member"), F.col("b").alias("other")), F.struct(F.col("b").alias("member"), F.col("a").alias("other")))).alias("e"), "k").select("e.*", "k")
    best = both.groupBy("member").agg(F.max_by("other", F.struct("k", "other")).alias("other"))
    first = cut(best.select(F.least("member", "other").alias("a"), F.greatest("member", "other").alias("b")).distinct())
    found = cut(_ends(_verified(first, sets, link)))
    # a pair that was not tried and has an end without a link
    open_ = cut(both.join(_sized(found), "member", "left_anti").select(F.least("member", "other").alias("a"), F.greatest("member", "other").alias("b")).distinct().join(_sized(first), ["a", "b"], "left_anti"))
    return cut(found.unionByName(_ends(_verified(open_, sets, link))).distinct())


def _shared_only(buckets: DataFrame) -> DataFrame:
    """buckets(bucket, member, ...) without buckets of a single member, as far as a bitmap of fixed size can tell."""
    many = buckets.select("bucket", "member").groupBy("bucket").agg(F.min("member").alias("lo"), F.max("member").alias("hi")).where("lo <> hi").select("bucket")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w, x = _words(_mixed(b["bucket"].to_numpy(np.int64)))
            yield pd.DataFrame({"word": w, "bits": x})

    on = bitmap(many.mapInPandas(mark, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")))
    shared = buckets.sparkSession.sparkContext.broadcast(on)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[_on(shared.value, _mixed(b["bucket"].to_numpy(np.int64)))]

    return buckets.mapInPandas(keep, buckets.schema)


def _can_pair(words: list[str], size: str, least: float, head: str = "h_") -> Column:
    """_can_be in SQL, between a row's columns and those with a prefix."""
    n, m, differ = F.col(size), F.col(f"{head}{size}"), sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{head}{w}"))) for w in words), F.lit(0))
    return (F.least(n, m) >= least * F.greatest(n, m)) & (differ * (1 + least) <= (1 - least) * (n + m) + 1e-6)


def _members(described_files: DataFrame, *key: str) -> DataFrame:
    """The files that can be in a cluster, with their member id: one for all files of a content (in a repository)."""
    f = described_files.where("bands IS NOT NULL").withColumn("member", F.xxhash64(*key, "content"))
    return f.withColumn("repeats", F.col("calls") & (F.col("variety") <= FAMILY_VARIETY)).withColumn("long", F.col("n_tokens") >= LONE_TOKENS)


_TRAITS = ["n", "nt", "repeats", "long", *_WORDS]


def families(described_files: DataFrame, most: int = ALL_PAIRS) -> DataFrame:
    """(id) of files in a within-repository family: linked to a file of other content in the repository.

    Exact within the buckets: a member of a large bucket whose head's pair does not verify is compared with all of it.
    """
    # a file that neither repeats itself nor is long has no links
    f = _members(described_files, "repo").where("repeats OR long")
    sets = f.select(*_FIELDS)
    words = [F.col("bits")[k].alias(w) for k, w in enumerate(_WORDS)]
    slim = f.select("member", "repo", "n", "nt", "repeats", "long", *words, F.explode("bands").alias("band")).select(F.xxhash64("repo", "band").alias("bucket"), "member", *_TRAITS)
    buckets = _shared_only(slim)
    dealt = buckets.repartition(parallelism(f.sparkSession), "bucket").sortWithinPartitions("bucket", "member")
    pairs = cut(dealt.mapInPandas(lambda batches: _stars(batches, most), "a bigint, b bigint, big boolean").groupBy("a", "b").agg(F.max("big").alias("big"), F.count(F.lit(1)).alias("k")))
    found = _linked(pairs, sets, _family)
    missed = cut(_ends(pairs.where("big")).join(_sized(found), "member", "left_anti"))
    if not missed.isEmpty():
        heads = buckets.join(_sized(missed), "member", "left_semi").select("bucket", F.col("member").alias("head"), *[F.col(c).alias(f"h_{c}") for c in _TRAITS])
        template = F.col("long") & F.col("h_long") & _can_pair(_WORDS[WORDS:], "nt", TEMPLATE)
        near = _can_pair(_WORDS[:WORDS], "n", SIMILAR) & (template | (F.col("repeats") & F.col("h_repeats")))
        more = heads.join(buckets.hint("merge"), "bucket").where((F.col("head") != F.col("member")) & near).groupBy(F.least("head", "member").alias("a"), F.greatest("head", "member").alias("b")).agg(F.count(F.lit(1)).alias("k"))
        found = cut(found.unionByName(_linked(cut(more.join(pairs.hint("merge"), ["a", "b"], "left_anti")), sets, _family)).distinct())
    return cut(f.select("id", "member").join(_sized(found), "member", "left_semi").select("id").distinct())


def copies(described_files: DataFrame, is_vendor: Column) -> DataFrame:
    """(id) of files that copy, word for word or edited, a vendor's file that HOLDERS repositories hold: a cross-repository cluster."""
    f = _members(described_files).where(F.col("n_tokens") >= BLOB_TOKENS).withColumn("origin", is_vendor)
    words = [F.col("bits")[k].alias(w) for k, w in enumerate(_WORDS[:WORDS])]
    # one row a content: is any file of it a vendor's, is any not
    one = f.groupBy("member").agg(F.max("origin").alias("any_origin"), F.min("origin").alias("all_origin"), F.countDistinct(F.when(F.col("origin"), F.col("repo"))).alias("holders"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    one = cut(one.where(~F.col("all_origin") | (F.col("holders") >= HOLDERS)).select("member", "any_origin", "all_origin", (F.col("holders") >= HOLDERS).alias("origin"), "n", *words, "bands"))
    same = one.where("origin AND NOT all_origin").select("member")
    cols = ["n", *_WORDS[:WORDS]]
    of = one.where("origin").select(F.col("member").alias("head"), *[F.col(c).alias(f"h_{c}") for c in cols], F.explode("bands").alias("band"))
    to = one.where("NOT all_origin AND NOT origin").select("member", *cols, F.explode("bands").alias("band"))
    few = one.where("origin").limit(FEW_HEADS + 1).count()
    if not few:
        return f.select("id").limit(0)
    near = to.join(F.broadcast(of) if few <= FEW_HEADS else of.hint("merge"), "band").where(_can_pair(_WORDS[:WORDS], "n", SIMILAR))
    pairs = cut(near.groupBy(F.least("head", "member").alias("a"), F.greatest("head", "member").alias("b")).agg(F.count(F.lit(1)).alias("k")))
    found = cut(same.unionByName(_linked(pairs, f.select(*_FIELDS), _copy)).distinct())
    return cut(f.where(~F.col("origin")).select("id", "member").join(_sized(found), "member", "left_semi").select("id").distinct())


def machine_made(sources: DataFrame) -> DataFrame:
    """(repo, filepath, kind, evidence, clustered) of the files that are not hand-written.

    evidence names the first that tells: mark (a comment or a lock file's field), form (minified or literals), lone
    (one file that repeats a pattern), family or cluster; clustered: whether a family or cluster tells it, too.
    """
    d = cut(described(sources))
    fam = _sized(families(d)).withColumn("in_family", F.lit(True))
    is_vendor = F.col("vendored") | F.lower("filepath").rlike(VENDOR_PATH)
    copied = _sized(copies(d, is_vendor)).withColumn("copied", F.lit(True))
    told = d.drop("seq", "names", "bits", "bands").join(fam, "id", "left").join(copied, "id", "left")
    lone = (F.col("variety") <= LONE_VARIETY) & (F.col("n_tokens") >= LONE_TOKENS) & F.col("calls")
    first = (
        F.when(F.col("vendored"), "vendored mark")
        .when(F.col("generated"), "generated mark")
        .when(F.col("minified"), "minified form")
        .when(F.col("blob"), "blob form")
        .when(lone, "generated lone")
        .when(F.coalesce("in_family", F.lit(False)), "generated family")
        .when(F.coalesce("copied", F.lit(False)), "vendored cluster")
    )
    clustered = F.coalesce("in_family", "copied", F.lit(False))
    out = told.select("repo", "filepath", F.split(first, " ").alias("first"), clustered.alias("clustered")).where("first IS NOT NULL")
    return out.select("repo", "filepath", F.col("first")[0].alias("kind"), F.col("first")[1].alias("evidence"), "clustered")


def marked(predictions: DataFrame, sources: DataFrame) -> DataFrame:
    """(ord, by_path, kind, evidence, clustered) of the prediction rows whose file is not hand-written; repeated rows are all marked.

    Rows with a null address or path are never marked; a file without a source row is judged by its path. kind and
    evidence are the code's and cluster's, null where only the path tells.
    """
    rows = predictions.select("ord", repo_key(F.col("repo_url")).alias("repo"), "filepath").where("repo IS NOT NULL AND filepath IS NOT NULL")
    path = F.lower("filepath")
    by_path = F.when(path.rlike(VENDOR_PATH), "vendored").when(path.rlike(GENERATED_PATH), "generated").when(path.rlike(MINIFIED_PATH), "minified")
    code = machine_made(sources).groupBy("repo", "filepath").agg(F.min(F.struct("kind", "evidence", "clustered")).alias("k")).select("repo", "filepath", "k.*")
    both = rows.withColumn("by_path", by_path).join(code, ["repo", "filepath"], "left")
    return both.where("by_path IS NOT NULL OR kind IS NOT NULL").select("ord", "by_path", "kind", "evidence", F.coalesce("clustered", F.lit(False)).alias("clustered"))
