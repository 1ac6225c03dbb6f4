"""Problem 10: the language of each document and of each passage of a mixed document.

Hierarchical discrimination: linear SVMs (one against the rest) tell the language family, then one-versus-one
linear SVMs tell the languages within it; the winner has most duels. Features are hashed words and character
n-grams inside words, so a sentence's score is the mean of its words' scores, which workers keep in a table; the
sentences of a batch are judged together. The SVMs minimise hinge loss with L2 weight decay.
The models are fitted here on a bounded sample of labelled rows (SAMPLE_DOCS a language) and on a few
function words a language; rows whose label the first fit contradicts are left out of the second.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documented bound of the training sample: labelled documents a language.
SAMPLE_DOCS = 150
FAMILIES = {"germanic": ("en", "de", "nl"), "romance": ("fr", "es", "it", "pt"), "slavic": ("ru",), "japonic": ("ja",)}
LANGS = tuple(x for f in FAMILIES.values() for x in f)
FAMILY_OF = {lang: k for k, f in enumerate(FAMILIES.values()) for lang in f}
DUELS = tuple((a, b) for f in FAMILIES.values() for i, a in enumerate(f) for b in f[i + 1 :])
#: English and own names of the languages (fixed values).
NAMES = {
    "english": "en", "german": "de", "dutch": "nl", "french": "fr", "spanish": "es", "italian": "it", "portuguese": "pt", "russian": "ru", "japanese": "ja",
    "deutsch": "de", "nederlands": "nl", "français": "fr", "español": "es", "italiano": "it", "português": "pt", "русский": "ru", "日本語": "ja",
}
#: Function words that every fit sees (fixed values).
SEEDS = {
    "en": "the and is of to in that it was for with not this but have are they which you my would never every",
    "de": "der die das und ist nicht ich ein eine mit für auf den dem sich auch wird war nach bei sehr nur noch",
    "nl": "de het een en is niet van ik met voor op dat zijn ook maar heeft er naar geen wel deze heel mijn",
    "fr": "le la les et est une des pas que pour dans qui sur avec ce cette mais nous je très sans mon au",
    "es": "el la los y es una que no en por con para del se más pero este esta muy mi sin aquí nada",
    "it": "il la gli e è una che non di per con del della sono più ma questo questa molto mio anche nella",
    "pt": "o a os e é uma que não em por com para do da mais mas este esta muito meu minha também sem",
    "ru": "и в не на я что он это как но мы по его из для очень мой за от так уже всё",
    "ja": "これ は とても です ます した の を に が で から まで しました ません という",
}
BITS = 16
MIN_WORDS = 3  # a sentence with fewer words of its own says nothing about a passage
MIN_RUN = 2  # whole sentences that make a passage
MARGIN = 0.1
DECAY = 1e-4  # L2 regularisation of the SVMs
OVERRULE = 0.8  # confidence at which a label counts as wrong

#: Markup, addresses and packed data (a long run with digits, marks or capitals inside) are no language; a long word is.
_MARKUP = re.compile(r"<[^<>\n]{0,80}>|https?://\S+|&[a-z]+;|(?=[A-Za-z-]*(?:[0-9+/=_]|[a-z][A-Z]))[A-Za-z0-9+/=_-]{25,}")
_MARKED = re.compile(r"[<&]|://|[A-Za-z0-9+/=_-]{25}")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_END = re.compile(r"(?:[.!?…]+[\"')\]»”]*(?=\s|$)|[。！？]+|\n+)")


def label_code(label: Column) -> Column:
    """Two-letter code a label stands for: any case, region suffix, English name; null if it names no language."""
    x = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    base = F.regexp_extract(x, r"^([^\s_-]+)", 1)
    named = F.create_map(*[F.lit(v) for kv in NAMES.items() for v in kv])
    code = F.coalesce(F.try_element_at(named, x), F.try_element_at(named, base), F.when(base.rlike("^[a-z]{2}$"), base))
    return F.when(~code.isin("xx", "zz"), code)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences; closing marks belong to the sentence, line ends part sentences."""
    out, at = [], 0
    for m in _END.finditer(text):
        if text[at : m.end()].strip():
            out.append((at, m.end()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def features(word: str) -> np.ndarray:
    w = f"^{word}$"
    grams = [f"w{w}"] + [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]
    return np.fromiter((xxhash.xxh32_intdigest(g) & ((1 << BITS) - 1) for g in grams), np.int64, len(grams))


def split_words(text: str) -> list[str]:
    words = _WORD.findall((_MARKUP.sub(" ", text) if _MARKED.search(text) else text).lower())
    if text.isascii() or not _CJK.search(text):
        return words
    out = []
    for w in words:
        # scripts without spaces: pairs of characters stand for words
        out += [w[i : i + 2] for i in range(0, len(w), 2)] if _CJK.search(w) else [w]
    return out


class _Rows(dict):
    """Row numbers of words in a table of scores that grows with the words met."""

    def __init__(self, weights: np.ndarray):
        self.w, self.table = weights, np.zeros((4096, weights.shape[1]), np.float32)

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        if k >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[k] = self.w[features(word)].mean(0)
        return k


class Model:
    """Weights of the family SVMs (one column a family) and of the duels (one column a pair)."""

    def __init__(self, weights: np.ndarray):
        self.w = weights
        self.rows = _Rows(weights)

    def judge_all(self, sents: list[list[str]]) -> list[tuple[str, float, float]]:
        """(language, margin, confidence 0..1) of each list of words; no list is empty."""
        if not sents:
            return []
        if len(self.rows) > 300_000:
            self.rows = _Rows(self.w)
        size = np.fromiter(map(len, sents), np.int64, len(sents))
        at = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(sents)), np.int64, int(size.sum()))
        s = np.add.reduceat(self.rows.table[at], np.cumsum(size) - size, axis=0) / size[:, None]
        fam = np.argsort(-s[:, : len(FAMILIES)], axis=1, kind="stable")
        every = np.arange(len(s))
        margin = (s[every, fam[:, 0]] - s[every, fam[:, 1]]) / 2
        wins, sums = np.zeros((len(s), len(LANGS))), np.zeros((len(s), len(LANGS)))
        low = np.full((len(s), len(LANGS)), 9.0)
        for k, (a, b) in enumerate(DUELS):
            d = s[:, len(FAMILIES) + k].astype(np.float64)
            for x, y in ((LANGS.index(a), d), (LANGS.index(b), -d)):
                wins[:, x] += y > 0 if x == LANGS.index(a) else y >= 0
                sums[:, x] += y
                low[:, x] = np.minimum(low[:, x], y)
        # only the family's own members can win; most duels, then the larger sum
        own = np.array([FAMILY_OF[x] for x in LANGS])[None, :] == fam[:, :1]
        rank = np.where(own, wins * 1e6 + np.clip(sums, -1e5, 1e5), -np.inf)
        best = rank.argmax(axis=1)
        margin = np.minimum(margin, low[every, best])
        conf = 1 / (1 + np.exp(-6 * margin))
        return [(LANGS[k], m, c) for k, m, c in zip(best.tolist(), margin.tolist(), conf.tolist(), strict=True)]

    def judge(self, ws: list[str]) -> tuple[str, float, float]:
        return self.judge_all([ws])[0]


def fit(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 0.5, decay: float = DECAY) -> np.ndarray:
    """Linear SVMs by SGD over sentences (language, text): hinge loss plus decay / 2 times the squared weights, averaged weights.

    The decay of all weights in a step is one factor kept beside them.
    """
    k = len(FAMILIES) + len(DUELS)
    w, avg = np.zeros((1 << BITS, k), np.float32), np.zeros((1 << BITS, k), np.float32)
    cache: dict[str, np.ndarray] = {}
    data = []
    for lang, text in rows:
        ws = split_words(text)
        if not ws:
            continue
        idx, val = [], []
        for x in ws:
            f = cache.get(x)
            if f is None:
                f = cache[x] = features(x)
            idx.append(f)
            val.append(np.full(len(f), 1 / (len(f) * len(ws)), np.float32))
        y = np.zeros(k, np.float32)
        y[: len(FAMILIES)] = -1
        y[FAMILY_OF[lang]] = 1
        for d, (a, b) in enumerate(DUELS):
            y[len(FAMILIES) + d] = 1 if lang == a else -1 if lang == b else 0
        data.append((np.concatenate(idx), np.concatenate(val), y))
    order = np.random.default_rng(7)
    scale = 60.0  # features are shares of words; steps make up for that
    size = 1.0  # the weights are size * w
    for e in range(epochs):
        step = rate * scale / (1 + e)
        for n in order.permutation(len(data)):
            idx, val, y = data[n]
            s = size * (val @ w[idx])
            act = np.where((y * s < 1) & (y != 0), y, 0).astype(np.float32)
            size *= 1 - rate / (1 + e) * decay
            if act.any():
                np.add.at(w, idx, np.float32(step / size) * val[:, None] * act[None, :])
        avg += np.float32(size) * w
    return avg / epochs


def train(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS) -> np.ndarray:
    """Weights from a hash-chosen sample of at most `sample` labelled documents a language."""
    # titles, where the table has them, teach the short texts; both count towards the bound
    titles = F.col("title") if "title" in documents.columns else F.lit(None).cast("string")
    rows = documents.select(F.concat_ws("\n", F.col(text_col), titles).alias("t"), label_code(F.col(lang_col)).alias("l")).where(F.col("l").isin(*LANGS) & (F.length("t") > 0))

    def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, pd.DataFrame] = {}
        for b in batches:
            for lang, part in b.groupby("l"):
                both = pd.concat([kept[lang], part]) if lang in kept else part
                kept[lang] = both.sort_values(["h", "t"]).drop_duplicates(["h", "t"]).head(sample)
        yield from kept.values()

    # one pass: each task keeps the first of its rows by hash, at most sample * languages of them; so does the whole
    firsts = rows.select("l", "t", F.xxhash64("t").alias("h")).mapInPandas(few, "l string, t string, h bigint")
    firsts = firsts.distinct().withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where(F.col("r") <= sample)
    got = sorted((r.l, r.t) for r in firsts.select("l", "t").collect())  # at most sample * languages rows
    seeds = [(lang, text) for lang, text in SEEDS.items() for _ in range(3)]
    seeds += [(lang, w) for lang, text in SEEDS.items() for w in text.split()]

    def cut_up(docs: list[tuple[str, str]]) -> list[tuple[str, str]]:
        return [(lang, t[a:b]) for lang, t in docs for a, b in sentences(t)]

    first = Model(fit(cut_up(got) + seeds, epochs=3))
    read = [(lang, t, ws) for lang, t in cut_up(got) if len(ws := split_words(t)) > 1]
    kept = [(lang, t) for (lang, t, _), told in zip(read, first.judge_all([ws for *_, ws in read]), strict=True) if told[0] == lang]
    return fit(kept + seeds)


Passage = tuple[str, float, int, int, int]


def passages_all(model: Model, texts: list[str | None]) -> list[list[Passage]]:
    """The passages of each text: (language, confidence, start, end, whole sentences), in order.

    Sentences too short or too even to tell join the passage before them (or the first one after). No words
    means no passage. All sentences are judged in one go.
    """
    cut_up: list[list[tuple[int, int]]] = []
    sents: list[list[str]] = []
    for text in texts:
        spans = []
        for a, b in sentences(text) if text else ():
            ws = split_words(text[a:b])
            if ws:
                spans.append((a, b))
                sents.append(ws)
        cut_up.append(spans)
    told = model.judge_all(sents)
    out: list[list[Passage] | None] = []
    unsure: list[tuple[int, list[str]]] = []
    at = 0
    for text, spans in zip(texts, cut_up, strict=True):
        mine = [(*told[at + i], a, b, len(sents[at + i])) for i, (a, b) in enumerate(spans)]
        words = [w for ws in sents[at : at + len(spans)] for w in ws]
        at += len(spans)
        if mine and not any(m >= MARGIN and n >= MIN_WORDS for _, m, _, _, _, n in mine):
            unsure.append((len(out), words))
            out.append(None)
        else:
            out.append(_joined(mine))
    for (k, _), (lang, _, conf) in zip(unsure, model.judge_all([ws for _, ws in unsure]), strict=True):
        out[k] = [(lang, conf, 0, len(texts[k]), 0)]
    return out


def _joined(told: list[tuple[str, float, float, int, int, int]]) -> list[Passage]:
    """Passages of sentences (language, margin, confidence, start, end, words) of which one at least is sure."""
    out: list[list] = []
    for lang, margin, conf, a, b, n in told:
        sure = margin >= MARGIN and n >= MIN_WORDS
        if out and (not sure or out[-1][0] in (None, lang)):
            o = out[-1]
            if o[0] is None and sure:
                o[0] = lang
            if sure:
                o[1], o[5] = (o[1] * o[5] + conf * n) / (o[5] + n), o[5] + n
            o[3], o[4] = b, o[4] + sure
        else:
            out.append([lang if sure else None, conf, a, b, int(sure), n if sure else 0])
    return [(o[0], o[1], o[2], o[3], o[4]) for o in out]


def passages(model: Model, text: str | None) -> list[Passage]:
    return passages_all(model, [text])[0]


def written(parts: list[tuple[str, float, int, int, int]]) -> tuple[list[str], str | None, float]:
    """(languages of the text, main language, its confidence): two or more if passages of MIN_RUN sentences differ."""
    if not parts:
        return [], None, 0.0
    size: dict[str, int] = {}
    for lang, _, a, b, _ in parts:
        size[lang] = size.get(lang, 0) + b - a
    main = max(size, key=lambda x: (size[x], x))
    conf = sum(c * (b - a) for lang, c, a, b, _ in parts if lang == main) / size[main]
    runs = sorted({lang for lang, _, _, _, n in parts if n >= MIN_RUN})
    return (runs if len(runs) > 1 else [main]), main, conf


TEXTS = 2_000  # texts judged together


def _apply(documents: DataFrame, weights: np.ndarray, make, schema: str, cols: list[Column]) -> DataFrame:
    """make(rest of the row, passages) for each row; cols: the text first."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)  # 2**BITS rows, fixed size
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(shared.value)
        for pdf in batches:
            for lo in range(0, len(pdf), TEXTS):
                part = pdf.iloc[lo : lo + TEXTS]
                rest = part.iloc[:, 1:].itertuples(index=False)
                rows = [x for r, p in zip(rest, passages_all(model, part.iloc[:, 0].tolist()), strict=True) for x in make(p, *r)]
                yield pd.DataFrame(rows, columns=names)

    return documents.select(*cols).mapInPandas(run, schema)


def assign(documents: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(doc_id, label, main, confidence, langs): every document with words; label is the code its lang stands for."""
    weights = train(documents) if weights is None else weights

    def make(parts, doc_id, label):
        langs, main, conf = written(parts)
        return [(doc_id, label, main, round(conf, 4), langs)] if main else []

    return _apply(documents, weights, make, "doc_id bigint, label string, main string, confidence double, langs array<string>", [F.col("text"), F.col("doc_id"), label_code(F.col("lang")).alias("label")])


def segments(documents: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, begin, finish, n_sentences): the passages of every document with words."""
    weights = train(documents) if weights is None else weights

    def make(parts, doc_id):
        return [(doc_id, i, lang, round(c, 4), a, b, n) for i, (lang, c, a, b, n) in enumerate(parts)]

    return _apply(documents, weights, make, "doc_id bigint, seg_no int, lang string, confidence double, begin int, finish int, n_sentences int", [F.col("text"), F.col("doc_id")])


def mislabelled(documents: DataFrame) -> DataFrame:
    """(doc_id, lang) of documents whose label is missing or wrong, or that are written in several languages."""
    a = assign(documents)
    # a label is overruled only by a text that says enough
    wrong = (F.col("label") != F.col("main")) & (F.col("confidence") >= OVERRULE)
    bad = F.col("label").isNull() | wrong | (F.size("langs") > 1)
    return a.where(bad).select("doc_id", F.explode("langs").alias("lang")).distinct()
