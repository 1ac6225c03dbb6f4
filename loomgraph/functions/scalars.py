"""Scalar column functions of the code graph: names, ids, paths, calls, features. All JVM-side."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Language by extension.
LANGUAGE_OF = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".jsx": "JavaScript (JSX)", ".tsx": "TypeScript (TSX)",
    ".java": "Java", ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".c": "C", ".h": "C/C++ Header", ".cs": "C#", ".go": "Go",
    ".rb": "Ruby", ".rs": "Rust", ".kt": "Kotlin", ".swift": "Swift", ".php": "PHP", ".R": "R", ".scala": "Scala",
    ".sh": "Shell", ".bash": "Shell", ".lua": "Lua", ".m": "MATLAB / Objective-C", ".pl": "Perl",
}
#: Grammar and display name by extension.
GRAMMAR_OF = {
    ".js": ("javascript", "JavaScript"), ".jsx": ("javascript", "JavaScript"), ".mjs": ("javascript", "JavaScript"), ".cjs": ("javascript", "JavaScript"),
    ".ts": ("typescript", "TypeScript"), ".tsx": ("tsx", "TypeScript"), ".go": ("go", "Go"), ".java": ("java", "Java"), ".c": ("c", "C"), ".h": ("c", "C"),
    ".cpp": ("cpp", "C++"), ".cc": ("cpp", "C++"), ".cxx": ("cpp", "C++"), ".hpp": ("cpp", "C++"), ".hh": ("cpp", "C++"),
}
#: Names that count as builtin calls.
BUILTINS = [
    "open", "print", "len", "getattr", "setattr", "hasattr", "isinstance", "type", "range", "enumerate", "zip", "map", "filter", "sorted", "list", "dict", "set", "tuple", "str", "int", "float", "bool",
    "repr", "super", "next", "iter", "vars", "dir", "id", "hex", "bin", "oct", "abs", "round", "min", "max", "sum", "any", "all", "format", "input", "exit", "quit", "assert",
]
#: Fixed vocabularies of the feature vector.
NODE_TYPES = ["File", "Class", "Function", "Variable", "Module", "OTHER"]
FEATURE_LANGUAGES = ["Python", "Shell", "JavaScript", "TypeScript", "C", "C++", "Java", "Go", "Rust", "R", "HTML", "CSS", "JSON", "OTHER"]
EDGE_TYPES = ["DEFINES", "IMPORTS", "CALLS", "INHERITS", "USES", "OTHER"]
EMBED_DIM = 32
LAYERS = ("frontend", "api", "backend", "database")


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def file_ext(path: Column) -> Column:
    """Extension with its dot, lower case; '' if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def detect_language(path: Column) -> Column:
    ext = file_ext(path)
    known = F.try_element_at(literal_map(LANGUAGE_OF), ext)
    return F.coalesce(known, F.when(ext != "", F.concat(F.lit("Unknown ("), ext, F.lit(")"))).otherwise("Unknown"))


def grammar(path: Column) -> Column:
    return F.try_element_at(literal_map({k: v[0] for k, v in GRAMMAR_OF.items()}), file_ext(path))


def repo_name(url: Column) -> Column:
    """Last segment without .git."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), r"\.git$", "")


def repo_id(path: Column) -> Column:
    """Id of a graph file: the hexadecimals of unified_graph_<hex>.json, else its stem."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.json$", "")
    return F.regexp_replace(stem, "^unified_graph_([0-9a-f]+)$", "$1")


def repo_slug(url: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(repo_name(url), r"[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "repo").otherwise(s)


def is_repo_url(s: Column) -> Column:
    return s.rlike("^https?://") | s.endswith(".git")


def node_id(kind: str, *parts: Column) -> Column:
    """'<kind>::part::part'; kinds file, class, func, var, external."""
    return F.concat_ws("::", F.lit(kind), *parts)


def call_name(raw: Column) -> Column:
    """Bare name of a call: arguments cut, last dotted segment."""
    bare = F.trim(F.regexp_replace(raw, r"\(.*\)$", ""))
    return F.element_at(F.split(bare, r"\."), -1)


def method_name(sig: Column) -> Column:
    return F.trim(F.substring_index(sig, "(", 1))


def base_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def call_kind(raw: Column, in_repo: Column) -> Column:
    return F.when(in_repo, "function").when(raw.startswith("self."), "method").when(raw.isin(*BUILTINS), "builtin").otherwise("library")


def callee_module(raw: Column, in_repo: Column) -> Column:
    """First dotted segment; null for the repository's own functions, self and builtins."""
    first = F.substring_index(raw, ".", 1)
    return F.when(~in_repo & (first != "self") & ~first.isin(*BUILTINS) & (first != ""), first)


def node_role(n_in: Column, n_out: Column) -> Column:
    return F.when(n_in == 0, "start").when(n_out == 0, "end").otherwise("mid")


def md5_mod(s: Column, m: int) -> Column:
    """The md5 of s as a 128-bit number, modulo m, folded digit by digit."""
    return F.aggregate(F.split(F.md5(s), ""), F.lit(0).cast("bigint"), lambda a, c: (a * 16 + F.coalesce(F.conv(c, 16, 10).cast("bigint"), F.lit(0))) % m)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"^(.*/)[^/]*$", 1), "/$", "")


def path_features(path: Column) -> list[Column]:
    """depth, is_root, hash of the parent folder, hash of the extension."""
    depth = F.size(F.split(path, "/")) - 1
    return [
        depth.alias("depth"),
        (depth == 0).cast("double").alias("is_root"),
        F.round(md5_mod(parent_dir(path), 997) / 997.0, 6).alias("parent_hash"),
        F.round(md5_mod(F.ltrim(file_ext(path), F.lit(".")), 101) / 101.0, 6).alias("ext_hash"),
    ]


def bucket(value: Column, vocab: list[str]) -> Column:
    return F.when(value.isin(*vocab), value).otherwise("OTHER")


def one_hot(value: Column, vocab: list[str]) -> Column:
    b = bucket(value, vocab)
    return F.array(*[(b == v).cast("double") for v in vocab])


def hash_embed(rows: DataFrame, key: str, text: str, dim: int = EMBED_DIM) -> DataFrame:
    """(key, i, x): the non-zero entries of each row's hashed token vector, of length 1.

    Tokens are parted at / _ . and blanks; index and sign come from the md5's last byte (dim up to 128). One
    row a token goes through one aggregation; a row without tokens gives no entry.
    """
    toks = rows.select(key, F.explode(F.split(F.lower(F.col(text)), r"[/_.\s]+")).alias("t")).where("t <> ''")
    low = F.conv(F.substring(F.md5("t"), 31, 2), 16, 10).cast("int")
    hits = toks.select(key, low.alias("v")).select(key, (F.col("v") % dim).alias("i"), F.when(F.floor(F.col("v") / dim) % 2 == 0, 1.0).otherwise(-1.0).alias("s"))
    sums = hits.groupBy(key, "i").agg(F.sum("s").alias("x")).where("x <> 0")
    norm = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return sums.join(norm, key).select(key, "i", (F.col("x") / F.col("norm")).alias("x"))


def split_group(path: Column) -> Column:
    """Key of related files: the first three segments of longer paths, else the path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, 3), "/")).otherwise(path)


def compose_text(path: Column, content: Column, keep: int | None = None) -> Column:
    """path, line feed, content (its first `keep` characters if given)."""
    return F.concat(path, F.lit("\n"), content if keep is None else F.substring(content, 1, keep))


def layer(path: Column, label: Column) -> Column:
    """Layer of a file: its label if that is one, else by its path (the patterns are fixed values)."""
    p, lab = F.lower(path), F.lower(F.coalesce(label, F.lit("")))
    return (
        F.when(lab.isin(*LAYERS), lab)
        .when(p.rlike(r"(^|/)(api|routes?|endpoints?|controllers?)(/|$)") | p.rlike("route|endpoint|controller"), "api")
        .when(p.rlike(r"(^|/)(db|database|models?|schema|datastore|migrations?)(/|$)") | p.rlike(r"\.sql$"), "database")
        .when(p.rlike(r"\.(jsx|tsx|vue|svelte|css|scss|html)$") | p.rlike(r"(^|/)(components?|pages?|views?|ui|frontend|client|public)(/|$)"), "frontend")
        .when(p.rlike(r"\.(py|go|java|rb|php|rs|cs|ts|js)$") | p.rlike(r"(^|/)(server|backend|services?|core)(/|$)"), "backend")
        .otherwise("other")
    )


def edge_weight(type_probs: Column, edge_type: str, exists: Column) -> Column:
    return F.coalesce(F.try_element_at(type_probs, F.lit(edge_type)), exists, F.lit(0.5))


def module_of(path: Column) -> Column:
    """First two segments; of shorter paths the folder, or the path itself."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, 2), "/")).when(F.size(parts) == 2, F.element_at(parts, 1)).otherwise(path)


def role_of(path: Column) -> Column:
    """Role of a file by its path (the parts it looks for are fixed values)."""
    p = F.lower(path)
    return (
        F.when(p.contains("/components/") | p.contains("/pages/") | p.endswith(".jsx") | p.endswith(".tsx") | p.contains("/hooks/"), "FRONTEND")
        .when(p.contains("/api/") | p.contains("endpoint") | p.contains("/server/"), "API")
        .when(p.contains("/db/") | p.contains("database") | p.contains("schema"), "DB")
        .otherwise("OTHER")
    )


def radius(degree: Column, base: float = 6.0) -> Column:
    return F.lit(base) + 3.2 * F.sqrt(degree + 1)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(xs: Column) -> Column:
    top = F.array_max(xs)
    e = F.transform(xs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def focal_loss(p: Column, gamma: float = 2.0, alpha: Column | None = None) -> Column:
    """Focal loss of the true class's probability."""
    loss = -F.pow(1 - p, F.lit(gamma)) * F.log(p)
    return loss if alpha is None else alpha * loss
