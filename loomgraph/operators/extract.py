"""Source code to records: calls, data flow, variables, classes and imports. One parse a file, all record kinds at once."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import braces

SCHEMA = "kind string, repo_url string, source_file string, name string, a string, b string, pos int, items array<string>, language string, seq int"


def dotted(node: ast.AST) -> str | None:
    """Name of an expression made of names and attributes only, else None."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.insert(0, node.attr)
        node = node.value
    return ".".join([node.id, *parts]) if isinstance(node, ast.Name) else None


_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_FAILURES = (SyntaxError, ValueError, RecursionError, MemoryError)


def _targets(node: ast.AST) -> list[ast.AST]:
    return node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []


def _class_record(node: ast.ClassDef) -> dict[str, list[str]]:
    """Bases (last segment), attributes of the body and of self in its methods, signatures of its methods."""
    methods = [m for m in node.body if isinstance(m, _FUNCTION)]
    own = {t.id for n in node.body for t in _targets(n) if isinstance(t, ast.Name)}
    own |= {t.attr for m in methods for n in ast.walk(m) for t in _targets(n) if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self"}
    bases = [b.id if isinstance(b, ast.Name) else b.attr for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
    return {"class_bases": bases, "class_attributes": sorted(own), "class_methods": [f"{m.name}({', '.join(a.arg for a in m.args.args)})" for m in methods]}


class _Reader:
    """One pass over a module: what happens where belongs to the innermost function, names to every function around."""

    def __init__(self) -> None:
        self.calls: dict[str, dict[str, None]] = {}
        self.flows: list[tuple[str, str, str, int]] = []
        self.variables: dict[str, list[str]] = {}
        self.classes: dict[str, dict[str, list[str]]] = {}
        self.functions: list[tuple[str, set[str]]] = []
        self.modules: dict[str, tuple[int, str]] = {}  # local name: depth of the import that counts, module

    def imported(self, name: str, module: str, depth: int) -> None:
        # of several imports of a name the deepest counts, of equally deep ones the last
        if depth >= self.modules.get(name, (0, ""))[0]:
            self.modules[name] = depth, module

    def read(self, node: ast.AST, fn: str | None, cls: str | None, around: tuple[set[str], ...], depth: int = 0) -> None:
        for x in ast.iter_child_nodes(node):
            inner_fn, inner_cls, inner = fn, cls, around
            if isinstance(x, _FUNCTION):
                inner_fn = f"{cls}.{x.name}" if cls else x.name
                names: set[str] = set()
                self.functions.append((inner_fn, names))
                inner = (*around, names)
                self.variables.setdefault(inner_fn, []).extend(f"param:{a.arg}" for a in x.args.args if a.arg != "self")
            elif isinstance(x, ast.ClassDef):
                inner_cls = x.name
                self.classes[x.name] = _class_record(x)
            elif isinstance(x, ast.Name):
                for names in around:
                    names.add(x.id)
            elif isinstance(x, ast.Import):
                for a in x.names:
                    self.imported(a.asname or a.name.partition(".")[0], a.name, depth)
            elif isinstance(x, ast.ImportFrom):
                for a in x.names:
                    self.imported(a.asname or a.name, x.module or "", depth)
            elif fn and isinstance(x, ast.Assign):
                self.variables[fn] += [t.id for t in x.targets if isinstance(t, ast.Name)]
            elif fn and isinstance(x, ast.Call):
                callee = dotted(x.func)
                if callee:
                    self.calls.setdefault(fn, {})[callee] = None
                self.flows += [(fn, a.id, callee or "<unknown>", i) for i, a in enumerate(x.args) if isinstance(a, ast.Name)]
            self.read(x, inner_fn, inner_cls, inner, depth + 1)


def python_records(code: str) -> list[tuple]:
    """(kind, name, a, b, pos, items) of a Python text: call_flow, data_flow, variables, class_*, imports; or error.

    A call on a call's result has no name: it is no call and flows to <unknown>. Functions without calls give no
    call_flow. Functions of one qualified name share a record; of classes of one name the last counts.
    """
    r = _Reader()
    try:
        r.read(ast.parse(code), None, None, ())
    except _FAILURES as e:
        return [("error", type(e).__name__, f"{type(e).__name__}: {e}", None, None, None)]
    out: list[tuple] = [("call_flow", f, None, None, None, list(c)) for f, c in r.calls.items()]
    out += [("data_flow", f, v, c, i, None) for f, v, c, i in r.flows]
    out += [("variables", f, None, None, None, v) for f, v in r.variables.items()]
    out += [(k, c, None, None, None, v) for c, d in r.classes.items() for k, v in d.items()]
    for f, names in r.functions:
        used = sorted({r.modules[n][1] for n in names if n in r.modules})
        if used:
            out.append(("imports", f, None, None, None, used))
    return out


def extract(sources: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """All records of all files, one row each, with the kind in front; unreadable files give one error row.

    With `kinds` only those leave the workers.
    """
    wanted = frozenset(kinds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, path, code in b.itertuples(index=False):
                ext = path.rpartition(".")[2].lower()
                got, lang = (python_records(code), "Python") if ext == "py" else (braces.records(code, ext), ext)
                rows += [(k, repo, path, n, a, c, p, items, lang, i) for i, (k, n, a, c, p, items) in enumerate(got) if not wanted or k in wanted]
            f = pd.DataFrame(rows, columns=["kind", "repo_url", "source_file", "name", "a", "b", "pos", "items", "language", "seq"])
            f["pos"] = f["pos"].astype("Int32")
            yield f

    return sources.select("repo_url", "filepath", "code").where("code IS NOT NULL AND filepath IS NOT NULL").mapInPandas(run, SCHEMA)


def file_index(sources: DataFrame) -> DataFrame:
    """(repo_url, filepath, filename, language, analysed, reason): whether a file could be read, and why not.

    Python files are analysed if they parse, files of the brace languages if they have text; others never are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, path, code in b.itertuples(index=False):
                ext, ok, why = path.rpartition(".")[2].lower(), False, None
                if code is not None and ext == "py":
                    try:
                        ast.parse(code)
                        ok = True
                    except _FAILURES as e:
                        why = f"{type(e).__name__}: {e}"
                elif code is not None and ext in braces.STYLE:
                    ok = True
                rows.append((repo, path, ok, why))
            yield pd.DataFrame(rows, columns=["repo_url", "filepath", "analysed", "reason"])

    told = sources.select("repo_url", "filepath", "code").where("filepath IS NOT NULL").mapInPandas(run, "repo_url string, filepath string, analysed boolean, reason string")
    return told.select("repo_url", "filepath", F.element_at(F.split("filepath", "/"), -1).alias("filename"), S.detect_language(F.col("filepath")).alias("language"), "analysed", "reason")


def tables(records: DataFrame) -> dict[str, DataFrame]:
    """The record tables by name, of extracted records: one column a field."""
    keys = ["source_file", "language", "repo_url"]
    of = lambda kind: records.where(F.col("kind") == kind)
    is_param = lambda x: x.startswith("param:")
    v = of("variables")
    params = F.transform(F.filter("items", is_param), lambda x: F.substring(x, 7, 1 << 30))
    parts = ("bases", "attributes", "methods")
    c = records.where(F.col("kind").isin(*[f"class_{k}" for k in parts])).groupBy(F.col("name").alias("class"), *keys)
    return {
        "function_call_flow": of("call_flow").select(F.col("name").alias("function"), F.col("items").alias("calls"), *keys),
        "data_flow": of("data_flow").select(F.col("name").alias("function"), F.col("a").alias("variable"), F.col("b").alias("passed_to"), F.col("pos").alias("arg_position"), *keys),
        "variables_per_function": v.select(F.col("name").alias("function"), params.alias("params"), F.filter("items", lambda x: ~is_param(x)).alias("assigns"), *keys),
        "class_diagram": c.agg(*[F.max(F.when(F.col("kind") == f"class_{k}", F.col("items"))).alias(k) for k in parts]).select("class", *parts, *keys),
        "import_flow": of("imports").select(F.col("name").alias("function"), F.col("items").alias("imports_used"), *keys),
    }
