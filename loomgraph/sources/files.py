"""Reading repositories, record tables and predictions; writing tables, graphs and splits."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S

#: Folders that are not analysed.
SKIP_DIRS = (".git", ".github", ".gitlab", "__pycache__", "node_modules", ".venv", "venv", "env", ".env", "dist", "build", ".tox", "site-packages", ".mypy_cache", ".pytest_cache", ".eggs", "migrations")
PREDICTION_SCHEMA = "filepath string, repo_url string, predicted_label string, confidence double, is_confident boolean, all_labels array<struct<label:string,confidence:double>>"
EDGE_SCHEMA = "source_id string, target_id string, source_filepath string, target_filepath string, edge_exists_prob double, predicted_types array<string>, type_probs map<string,double>"
_KEYS = "source_file string, language string, repo_url string"
RECORD_SCHEMAS = {
    "function_call_flow": f"function string, calls array<string>, {_KEYS}", "data_flow": f"function string, variable string, passed_to string, arg_position int, {_KEYS}",
    "variables_per_function": f"function string, params array<string>, assigns array<string>, {_KEYS}", "class_diagram": f"class string, bases array<string>, attributes array<string>, methods array<string>, {_KEYS}",
    "import_flow": f"function string, imports_used array<string>, {_KEYS}", "file_index": "filepath string, filename string, language string, repo_url string, analysed boolean, reason string",
}
MANY_FILES = 100_000  # a list of files up to this length may be broadcast
RECORD_TABLES = ("function_call_flow", "data_flow", "variables_per_function", "class_diagram", "import_flow", "file_index")


def kept_paths(folder: str, keep: Iterable[str] = tuple(S.LANGUAGE_OF), skip: Iterable[str] = SKIP_DIRS, hidden: bool = True) -> list[str]:
    """Paths below a local folder, sorted; skipped folders are never entered, nor hidden ones unless wanted."""
    skipped, wanted, out = set(skip), tuple({k.lower() for k in keep}), []
    for at, dirs, names in os.walk(folder):
        dirs[:] = sorted(d for d in dirs if d not in skipped and (hidden or not d.startswith(".")))
        out += [os.path.relpath(os.path.join(at, n), folder) for n in names if os.path.splitext(n)[1].lower() in wanted]
    return sorted(out)


def read_repos(spark: SparkSession, folder: str, repo_url: str | None = None, keep: tuple[str, ...] = tuple(S.LANGUAGE_OF), skip: tuple[str, ...] = SKIP_DIRS, slices: int | None = None) -> DataFrame:
    """sources of one repository, or (repo_url=None) of a folder of repositories; bytes that are no UTF-8 are replaced.

    The folder must be mounted on all workers. The driver lists folders, pruning skipped ones as it walks; each
    worker opens the files of its slice of the list. Files that cannot be read are left out.
    """
    root = os.path.abspath(re.sub(r"^file:/*", "/", folder))
    listed = pd.DataFrame({"rel": kept_paths(root, keep, skip)}, dtype=object)
    if not len(listed):
        listed = spark.createDataFrame([], "rel string")
    else:
        listed = spark.createDataFrame(listed).repartition(slices or spark.sparkContext.defaultParallelism)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rel in b["rel"]:
                try:
                    with open(os.path.join(root, rel), encoding="utf-8", errors="replace", newline="") as f:
                        rows.append((rel, f.read()))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["rel", "code"])

    files = listed.mapInPandas(read, "rel string, code string")
    repo = F.lit(repo_url) if repo_url else F.element_at(F.split("rel", "/"), 1)
    path = F.col("rel") if repo_url else F.regexp_replace("rel", "^[^/]+/", "")
    return files.select(repo.alias("repo_url"), path.alias("filepath"), F.element_at(F.split(path, "/"), -1).alias("filename"), S.detect_language(path).alias("language"), "code")


def read_repo_list(spark: SparkSession, path: str) -> DataFrame:
    """(url, branch) of a list file: one 'url [branch]' a line, # comments."""
    line = F.trim(F.regexp_replace("value", r"(^|\s)#.*$", ""))
    parts = F.split(line, r"\s+")
    return spark.read.text(path).where(line != "").select(parts[0].alias("url"), F.when(F.size(parts) > 1, parts[1]).alias("branch"))


#: Folders that the scan for the other languages leaves out; folders beginning with a dot as well.
OTHER_SKIP_DIRS = ("node_modules", "vendor", "dist", "build", "target", "__pycache__", "venv")


def read_predictions(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, files) of a glob: predictions with `file` and the file's rank in path order; files with their state.

    A file's state is ok, empty or broken; broken and empty files give no predictions. A file is an array of
    predictions, read by one task.
    """
    raw = spark.read.option("wholetext", "true").text(pattern).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("text"))
    parsed = raw.withColumn("p", F.from_json("text", f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in PREDICTION_SCHEMA.split(', '))}>>"))
    ends = (F.col("text").startswith("[") & F.col("text").endswith("]")) | (F.col("text") == "")
    state = F.when((F.col("text") == "") | F.col("text").rlike(r"^\[\s*\]$"), "empty").when(F.col("p").isNull() | ~ends, "broken").otherwise("ok")
    told = parsed.withColumn("state", state)
    rank = F.row_number().over(Window.orderBy("file"))  # a row a file
    files = told.select("file", "state").withColumn("rank", rank)
    rows = told.where("state = 'ok'").select("file", F.posexplode("p").alias("pos", "e")).select("file", "pos", "e.*").where("filepath IS NOT NULL")
    return rows.join(F.broadcast(files.select("file", "rank")) if files.count() <= MANY_FILES else files.select("file", "rank"), "file"), files


def merge_predictions(predictions: DataFrame, least: float = 0.0, confident: bool = False) -> DataFrame:
    """The predictions of read_predictions that pass the filters, the first of each file path by file rank and position."""
    kept = predictions.where(F.coalesce("confidence", F.lit(0.0)) >= least)
    if confident:
        kept = kept.where(F.coalesce("is_confident", F.lit(False)))
    order = F.struct("rank", "pos")
    first = kept.groupBy("repo_url", "filepath").agg(F.min_by(F.struct("predicted_label", "confidence", "is_confident", "all_labels"), order).alias("p"))
    return first.select("repo_url", "filepath", "p.*")


def create_or_load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The record tables below a folder; a table that is missing or unreadable is empty."""
    out = {}
    for name in RECORD_TABLES:
        out[name], _ = read_with_fallback(spark, [os.path.join(folder, name)], RECORD_SCHEMAS[name])
    return out


def read_json_folder(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All JSON files of a folder (one object or array each), broken ones left out."""
    raw = spark.read.schema(schema + ", _broken string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_broken").json(os.path.join(folder, "*.json"))
    return raw.where("_broken IS NULL").drop("_broken")


def merge_records(tables: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Record tables of several sources as one each; repeated rows stay."""
    out: dict[str, DataFrame] = {}
    for t in tables:
        for name, df in t.items():
            out[name] = df if name not in out else out[name].unionByName(df, allowMissingColumns=True)
    return out


def sniff(path: str) -> str:
    """graph (nodes and edges) or records (a file index) by the top-level keys of a JSON file; anything else is an error."""
    keys = set()
    with open(path, encoding="utf-8") as f:
        depth, text, at = 0, f.read(), 0
    for m in re.finditer(r'"((?:[^"\\]|\\.)*)"\s*(:?)|[\[{]|[\]}]', text):
        if m.group()[0] == '"':
            if depth == 1 and m.group(2):
                keys.add(m.group(1))
        else:
            depth += 1 if m.group() in "[{" else -1
        at = m.end()
    if at and {"nodes", "edges"} <= keys:
        return "graph"
    if "file_index" in keys:
        return "records"
    raise ValueError(f"{path} holds neither nodes and edges nor a file index")


def read_with_fallback(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame, str | None]:
    """The first readable of several JSON paths and its name; an empty table if none is."""
    for p in paths:
        try:
            return spark.read.schema(schema).option("multiLine", "true").json(p), p
        except Exception:  # noqa: BLE001 - any unreadable path falls through to the next
            continue
    return spark.createDataFrame([], schema), None


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("filepath string, text string, label string, original_label string, remap_method string, split string").json(path)


def write_records(records: DataFrame, folder: str) -> None:
    """The extracted records, one folder a kind."""
    records.write.mode("overwrite").partitionBy("kind").parquet(folder)


def graph_json(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of node and edge JSON with all their attributes; an edge's id is e<rank of its content hash>, free of a global sort."""
    n = nodes.select(F.to_json(F.struct(*nodes.columns)).alias("value"))
    rest = [c for c in edges.columns if c != "id"]
    e = edges.select(F.concat(F.lit("e"), F.sha2(F.concat_ws("|", "source", "target", "type"), 256).substr(1, 16)).alias("id"), *rest)
    return n, e.select(F.to_json(F.struct("id", *rest)).alias("value"))


def write_predicted_edges(edges: DataFrame, folder: str) -> None:
    """The scored edges in their order (they are at most the top of a graph), one JSON object a line."""
    edges.orderBy(F.desc("edge_exists_prob"), "source_id", "target_id").coalesce(1).write.mode("overwrite").json(folder)


def write_merged(predictions: DataFrame, stats: DataFrame, folder: str) -> None:
    """Merged predictions and their statistics side by side."""
    predictions.write.mode("overwrite").json(os.path.join(folder, "merged"))
    stats.coalesce(1).write.mode("overwrite").json(os.path.join(folder, "stats"))


def write_labels(rows: DataFrame, folder: str) -> None:
    """The sorted labels of a data set with their numbers: labels.json."""
    labels = rows.where("label IS NOT NULL").select("label").distinct()
    numbered = labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("idx"))  # a row a label
    numbered.coalesce(1).write.mode("overwrite").json(os.path.join(folder, "labels"))


def cached_table(df_of: Callable[[], DataFrame], spark: SparkSession, path: str) -> DataFrame:
    """A table that is written once: read from `path` if it is whole there, else made, written and read."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")):
        df_of().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Colours of modules and of everything else in the drawn import graph.
NODE_COLOURS = ("#f76f4f", "#4f8ef7")


def drawn_graph(edges: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for a drawing of edges(src, dst): nodes with label, degree as value and colour; modules(id) stand out."""
    d = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("value"))
    j = d.join(modules.select("id").distinct().withColumn("m", F.lit(True)), "id", "left")
    colour = F.when(F.col("m"), NODE_COLOURS[0]).otherwise(NODE_COLOURS[1])
    nodes = j.select("id", F.element_at(F.split("id", "::"), -1).alias("label"), "value", F.col("id").alias("title"), colour.alias("color"))
    return nodes, edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.lit("to").alias("arrows"))


def write_split_jsonl(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").partitionBy("split").json(folder)


def write_predictions(preds: DataFrame, folder: str) -> None:
    preds.withColumn("repo", S.repo_slug(F.col("repo_url"))).write.mode("overwrite").partitionBy("repo").json(folder)
