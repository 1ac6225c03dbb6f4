"""Repository jobs, prediction files, record tables and sinks."""

import json
import os
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import extract, graph, models, resolve, serving, viewsets
from loomgraph.sources import files, repos
from loomgraph.streaming import ingest


def test_jobs_of_a_command_line(tmp_path):
    (tmp_path / "l.txt").write_text("# all\nhttps://h/x dev\n\nhttps://h/y # note\nhttps://h/z a b\n")
    j = repos.parse_jobs(["https://h/a", "--branch", "dev", "https://h/b", "-c", "cache", "-m", "m1/", "-m", "m2", "-f", str(tmp_path / "l.txt")])
    assert j.repos == [("https://h/a", "dev"), ("https://h/b", None), ("https://h/x", "dev"), ("https://h/y", None), ("https://h/z", "a")]
    assert (j.folders, j.cache_dir) == (["m1", "m2"], "cache")
    assert repos.read_list("a b c\n")[1] == ["a b c"] and repos.parse_jobs([]).repos == []
    with pytest.raises(SystemExit):
        repos.parse_jobs(["--branch", "dev"])


def test_checkout_clones_caches_and_cleans_up(tmp_path, monkeypatch):
    cloned = []

    def fake(url, into, branch=None):
        os.makedirs(into)
        cloned.append(into)
        return into

    monkeypatch.setattr(repos, "clone", fake)
    with repos.checkout("https://h/o/r.git") as place:
        assert os.path.isdir(place)
    assert not os.path.exists(place)
    cache = str(tmp_path / "cache")
    with repos.checkout("https://h/o/r.git", cache_dir=cache, keep=True) as place:
        assert place == os.path.join(cache, "r")
    assert os.path.isdir(place)
    with repos.checkout("https://h/o/r", cache_dir=cache) as place:
        assert place == os.path.join(cache, "r")
    assert len(cloned) == 2
    with repos.checkout(str(tmp_path)) as place:
        assert place == str(tmp_path)
    with pytest.raises(FileNotFoundError), repos.checkout(str(tmp_path / "none")):
        pass
    assert repos.locate("https://h/o/r.git", [str(tmp_path), cache]) == os.path.join(cache, "r") and repos.locate("https://h/o/q", [cache]) is None


@pytest.mark.skipif(shutil.which("git") is None, reason="needs git")
def test_clone_of_a_local_repository(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    env = {**os.environ, "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"}
    (src / "a.py").write_text("x = 1\n")
    for cmd in (["init", "-q"], ["add", "."], ["commit", "-qm", "x"]):
        subprocess.run(["git", *cmd], cwd=src, check=True, env=env, capture_output=True)
    assert os.path.exists(os.path.join(repos.clone(f"file://{src}", str(tmp_path / "out")), "a.py"))
    with pytest.raises(subprocess.CalledProcessError):
        repos.clone(f"file://{tmp_path}/nothing", str(tmp_path / "out2"))


def test_one_match(tmp_path):
    for n in ("a.json", "b.json"):
        (tmp_path / n).write_text("{}")
    assert repos.only_match(str(tmp_path / "a*.json")).endswith("a.json")
    for bad in ("*.json", "z*.json"):
        with pytest.raises(ValueError, match="one file"):
            repos.only_match(str(tmp_path / bad))
    with pytest.raises(FileNotFoundError):
        repos.only_match("*", str(tmp_path / "none"))


def test_scan_prunes_folders(tmp_path):
    for p in ("a/x.py", "a/node_modules/y.js", ".hidden/z.py", "vendor/q.go", "b/n.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("1")
    assert files.kept_paths(str(tmp_path)) == [".hidden/z.py", "a/x.py", "vendor/q.go"]
    assert files.kept_paths(str(tmp_path), skip=files.OTHER_SKIP_DIRS, hidden=False) == ["a/x.py"]


def test_prediction_files(spark, tmp_path):
    p = {"filepath": "a.py", "repo_url": "r", "predicted_label": "x", "confidence": 0.9, "is_confident": True, "all_labels": []}
    (tmp_path / "Prediction_1.json").write_text(json.dumps([p, {**p, "filepath": "b.py", "confidence": 0.1, "is_confident": False}]))
    (tmp_path / "Prediction_2.json").write_text("[]")
    (tmp_path / "Prediction_3.json").write_text('[{"filepath": ')
    (tmp_path / "Prediction_4.json").write_text(json.dumps([{**p, "predicted_label": "late"}, {**p, "filepath": "c.py"}]))
    rows, state = files.read_predictions(spark, str(tmp_path / "Prediction_*.json"))
    assert [r.state for r in state.orderBy("rank").collect()] == ["ok", "empty", "broken", "ok"]
    merged = {r.filepath: r.predicted_label for r in files.merge_predictions(rows).collect()}
    assert merged == {"a.py": "x", "b.py": "x", "c.py": "x"}
    assert {r.filepath for r in files.merge_predictions(rows, 0.5, True).collect()} == {"a.py", "c.py"}
    files.write_merged(files.merge_predictions(rows), state.groupBy("state").count(), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "merged")).count() == 3


def test_records_sniffing_and_folders(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"edges": 1}], "edges": []}')
    (tmp_path / "r.json").write_text('{"file_index": [{"nodes": "a"}]}')
    (tmp_path / "x.json").write_text('{"a": {"nodes": 1, "edges": 2}}')
    assert files.sniff(str(tmp_path / "g.json")) == "graph" and files.sniff(str(tmp_path / "r.json")) == "records"
    with pytest.raises(ValueError, match="neither"):
        files.sniff(str(tmp_path / "x.json"))
    empty = files.create_or_load(spark, str(tmp_path / "none"))
    assert set(empty) == set(files.RECORD_TABLES) and all(t.count() == 0 for t in empty.values())
    more = {"data_flow": spark.createDataFrame([("f", "v", "g", 0, "s", None, "r")], files.RECORD_SCHEMAS["data_flow"])}
    assert files.merge_records([empty, more, more])["data_flow"].count() == 2
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "1.json").write_text('{"a": 1}')
    (folder / "2.json").write_text("{broken")
    assert [r.a for r in files.read_json_folder(spark, str(folder), "a int").collect()] == [1]


def test_graph_sinks(spark, tmp_path):
    f = spark.createDataFrame([("r", "a.py", "f", 1), ("r", "b.py", "g", 2)], "repo_url string, source_file string, function string, ord long")
    c = spark.createDataFrame([("r", "a.py", "f", "x.g()", 1), ("r", "b.py", "g", "print", 2)], "repo_url string, source_file string, function string, raw_call string, ord long")
    fl = spark.createDataFrame([("r", "a.py", "f", "v", "g", 0, 1), ("r", "z.py", "h", "v", "g", 0, 2)], "repo_url string, source_file string, function string, variable string, passed_to string, arg_position int, ord long")
    fi = spark.createDataFrame([("r", "a.py", "Python", True), ("r", "b.py", "Python", False)], "repo_url string, source_file string, language string, analysed boolean")
    v = resolve.variables(spark.createDataFrame([("r", "a.py", "f", ["param:p", "q"], 1)], "repo_url string, source_file string, function string, items array<string>, ord long"))
    nodes, edges = resolve.unified_graph(fi, f, c, flows=fl, with_variables=True, variables=v)
    n = {r.id: r for r in nodes.collect()}
    assert n["file::r::b.py"].analysed is False and n["file::r::a.py"].language == "Python" and n["func::r::a.py::f"].params == ["param:p"] and n["func::r::a.py::f"].assigns == ["q"]
    assert n["var::r::a.py::f::v"].source_file == "a.py" and n["external::print"].type == "External"
    e = {(r.source, r.target, r.type): r for r in edges.collect()}
    assert e["func::r::a.py::f", "func::r::b.py::g", "CALLS"].raw == "x.g()" and e["var::r::a.py::f::v", "func::r::b.py::g", "FLOWS_TO"].arg_position == 0
    assert len(e) == 2 + 2 + 2
    jn, je = files.graph_json(nodes, edges)
    assert {json.loads(r.value)["id"] for r in jn.collect()} == set(n) and all(json.loads(r.value)["id"].startswith("e") for r in je.collect())
    drawn, lines = files.drawn_graph(edges.select(F.col("source").alias("src"), F.col("target").alias("dst")), nodes.where("type = 'External'"))
    d = {r.id: r for r in drawn.collect()}
    assert d["external::print"].color == files.NODE_COLOURS[0] and d["func::r::b.py::g"].value == 4 and lines.columns == ["from", "to", "arrows"]
    made = []

    def once():
        made.append(1)
        return nodes

    for _ in range(2):
        assert files.cached_table(once, spark, str(tmp_path / "t")).count() == len(n)
    assert len(made) == 1
    files.write_labels(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "label string"), str(tmp_path))
    assert {(r.label, r.idx) for r in spark.read.json(str(tmp_path / "labels")).collect()} == {("a", 0), ("b", 1)}


def test_labels_and_colours(spark):
    df = spark.createDataFrame([("a", 1, "start", "module"), ("b", 2, "end", None), ("c", 3, "mid", "module"), ("d", 4, "mid", "x")], "id string, seq int, role string, kind string")
    got = df.select(serving.display_label(F.col("id"), F.col("seq"), F.col("role")).alias("l"), serving.node_colour(F.col("role"), F.col("kind"), {"module": "blue"}).alias("c")).collect()
    assert [tuple(r) for r in got] == [("▶ [1] a", "limegreen"), ("■ [2] b", "tomato"), ("[3] c", "blue"), ("[4] d", "orange")]


def test_scoring_learns_a_simple_rule(spark, tmp_path):
    rows = [(i, [float(i % 2), float(i % 3)]) for i in range(60)]
    z = spark.createDataFrame(rows, "id int, x array<double>")
    edges = [(i, j, ["CALLS"] if i % 3 == 0 else ["FLOWS_TO"]) for i in range(60) for j in range(60) if i != j and i % 2 == 1 and j % 2 == 1 and (i + j) % 4 == 0]
    typed = spark.createDataFrame(edges, "src int, dst int, types array<string>")
    fitted = models.fit_edges(z, typed)
    groups = spark.createDataFrame([(i, 0) for i in range(60)], "id int, grp int")
    out = models.score_graph(groups.select("id", F.lit(None).cast("string").alias("filepath")), typed, z, fitted, groups, top=100)
    got = out.collect()
    assert 0 < len(got) <= 100 and all(r.source_id % 2 == 1 and r.target_id % 2 == 1 for r in got) and all(set(r.type_probs) == set(models.TYPES) for r in got)
    known = {(a, b) for a, b, _ in edges}
    assert not any((r.source_id, r.target_id) in known for r in got)
    files.write_predicted_edges(out.withColumn("source_id", F.col("source_id").cast("string")), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == len(got)
    one_class = models.fit_binary(spark.createDataFrame([([1.0], True)], "x array<double>, y boolean"), "y")
    assert isinstance(one_class, models.Constant) and one_class.p == 1.0


def test_file_rows_of_the_extraction(spark):
    rows = [("r", "a.py", "def ("), ("r", "b.py", "x = 1"), ("r", "c.js", "f()"), ("r", "d.txt", "x"), ("r", "e.py", None)]
    got = {r.filepath: r for r in extract.file_index(spark.createDataFrame(rows, "repo_url string, filepath string, code string")).collect()}
    assert got["a.py"].analysed is False and got["a.py"].reason.startswith("SyntaxError:") and got["b.py"].analysed and got["b.py"].reason is None
    assert got["c.js"].analysed and not got["d.txt"].analysed and not got["e.py"].analysed and got["b.py"].language == "Python"


def test_predictions_by_repository_and_any_scorer(spark, tmp_path):
    df = spark.createDataFrame([("a.py", "https://h/o/r1", "x", 0.5), ("b.py", "https://h/o/r2.git", "y", 0.6)], "filepath string, repo_url string, predicted_label string, confidence double")
    files.write_predictions(df, str(tmp_path / "p"))
    assert {r.repo for r in spark.read.json(str(tmp_path / "p")).select("repo").distinct().collect()} == {"r1", "r2"}
    files.write_records(spark.createDataFrame([("call_flow", "r"), ("imports", "r")], "kind string, repo_url string"), str(tmp_path / "k"))
    assert spark.read.parquet(str(tmp_path / "k")).where("kind = 'imports'").count() == 1
    got = viewsets.score_files(df, lambda b: b[["filepath"]].assign(n=b["filepath"].str.len()), "filepath string, n long").collect()
    assert {(r.filepath, r.n) for r in got} == {("a.py", 4), ("b.py", 4)}


def test_event_windows_on_a_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 2.0D UNION ALL SELECT timestamp'2024-01-01 01:10:00', 'a', 4.0D")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = ingest.event_windows(ingest.events_stream(spark, str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.n, r.total) for r in spark.table("windows").collect()) == [(1, 4.0), (2, 3.0)]


def test_layers_of_a_chain_with_a_cycle_behind(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(5, 20), (20, 21), (21, 20)], "src int, dst int").withColumn("type", F.lit("x"))
    got = {r.id: r.seq_layer for r in graph.topological_sequence(e).collect()}
    assert [got[i] for i in range(7)] == list(range(7)) and got[20] == got[21] == -1
    assert graph.topological_sequence(e.limit(0)).count() == 0
