"""Core operators on hand-worked inputs."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomgraph.functions import digests, roles
from loomgraph.functions import scalars as S
from loomgraph.operators import arrays, braces, extract, features, graph, models, pairs, resolve, rollups, skew, splits
from loomgraph.plans import core_queries, graph_queries, model_queries, serving_queries, skew_queries
from loomgraph.session import ensure_checkpoint_dir
from loomgraph.sources import files, views
from loomgraph.streaming import ingest

SMALL = "/root/testdata/sf0.001"
EDGES = "src string, dst string, type string, p double"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("url", "slug"), [("https://h/o/my repo.git/", "my_repo"), ("https://h/o/a.git", "a"), ("https://h/o/___", "repo")])
def test_slug(spark, url, slug):
    assert one(spark, url, S.repo_slug) == slug


@pytest.mark.parametrize(("raw", "name"), [("obj.fn1()", "fn1"), ("a.b.c(x, y)", "c"), ("g", "g")])
def test_call_name(spark, raw, name):
    assert one(spark, raw, S.call_name) == name


def test_path_features_of_a_root_file(spark):
    r = spark.createDataFrame([("setup.py",), ("src/app/x.py",)], "p string").select("p", *S.path_features(F.col("p"))).orderBy("p").collect()
    assert (r[0].depth, r[0].is_root) == (0, 1.0)
    assert r[1].parent_hash == round(491 / 997, 6)


def test_language(spark):
    got = [one(spark, p, S.detect_language) for p in ("a/b.py", "a/b.yml", "Makefile", "x.SH")]
    assert got == ["Python", "Unknown (.yml)", "Unknown", "Shell"]


def records(code):
    return {(k, n): items for k, n, a, b, p, items in extract.python_records(code)}


def test_python_extraction():
    assert records("def f():\n  g(); h(); g()")[("call_flow", "f")] == ["g", "h"]
    r = records("def a():\n  b()\ndef b():\n  pass")
    assert ("call_flow", "a") in r and ("call_flow", "b") not in r
    r = records("class C:\n  def m(self):\n    self.n()\n  def n(self):\n    print(1)")
    assert r[("call_flow", "C.m")] == ["self.n"]
    flows = [x for x in extract.python_records("def f(a):\n  g(1, a, k=a)") if x[0] == "data_flow"]
    assert flows == [("data_flow", "f", "a", "g", 1, None)]
    assert [x[3] for x in extract.python_records("def f(x):\n  g()(x)") if x[0] == "data_flow"] == ["<unknown>"]
    assert records("import numpy as np\nfrom a.b import c\ndef f():\n  np.x(); c()")[("imports", "f")] == ["a.b", "numpy"]
    assert extract.python_records("def (")[0][:2] == ("error", "SyntaxError")
    assert records("g()") == {}


def test_python_extraction_of_nested_and_nameless_things():
    def flows(code):
        return [x[1:5] for x in extract.python_records(code) if x[0] == "data_flow"]

    r = records("def f(a):\n  g().h(a)\n  x[0].k(a)\n  m.n.o(a)")
    assert r[("call_flow", "f")] == ["g", "m.n.o"]
    assert flows("def f(a):\n  g().h(a)\n  x[0].k(a)") == [("f", "a", "<unknown>", 0)] * 2
    r = records("def f(a, /, b, self, *args, c=1, **kw):\n  d = e = 1\n  i: int = 2\n  (g, h) = 1, 2")
    assert r[("variables", "f")] == ["param:b", "d", "e"]
    r = records("import q\nclass A(m.B, c, d[0], metaclass=z):\n  x = 1\n  y: int\n  def f(self, v):\n    self.w = v\n    def g():\n      self.u = q.t()\n")
    assert r[("class_bases", "A")] == ["B", "c"] and r[("class_attributes", "A")] == ["u", "w", "x", "y"] and r[("class_methods", "A")] == ["f(self, v)"]
    # names used inside a nested function count for the outer one too, its calls only for itself
    assert r[("imports", "A.f")] == r[("imports", "A.g")] == ["q"] and ("call_flow", "A.f") not in r and r[("call_flow", "A.g")] == ["q.t"]
    # what a class inside a function does belongs to the function
    r = records("def f():\n  class C:\n    x = g()\n    def m(self):\n      h()\n")
    assert r[("call_flow", "f")] == ["g"] and r[("call_flow", "C.m")] == ["h"]
    r = records("class A:\n  def f(self):\n    a()\nclass A(B):\n  def f(self):\n    b()")
    assert r[("class_bases", "A")] == ["B"] and r[("call_flow", "A.f")] == ["a", "b"]


def of(code, ext):
    return {(k, n): items for k, n, a, b, p, items in braces.records(code, ext) if k != "data_flow"}, [x[1:5] for x in braces.records(code, ext) if x[0] == "data_flow"]


def test_javascript_records():
    r, flows = of("function f(a, b = 1, ...c) {\n  g(a); // h(x)\n  if (a) { k.l(a, 'x', b); }\n  const q = 1, s = 2; let t;\n  t = new M(b)\n}\nconst q = (x) => {\n  return m(x);\n};\nconst p = y => z(y);\nfunction none() {}", "js")
    assert r[("call_flow", "f")] == ["g", "l", "M"] and r[("call_flow", "q")] == ["m"] and r[("call_flow", "p")] == ["z"] and r[("call_flow", "none")] == []
    assert r[("variables", "f")][:3] == ["param:a", "param:b", "param:c"] and set(r[("variables", "f")][3:]) == {"q", "s", "t"}
    assert flows == [("f", "a", "g", 0), ("f", "a", "l", 0), ("f", "b", "l", 2), ("f", "b", "M", 0), ("q", "x", "m", 0), ("p", "y", "z", 0)]
    r, _ = of("class A extends n.B {\n  w = 1;\n  constructor(x) { super(x); this.y = x; }\n  async go(a, {b}) { await this.run(a); }\n}\nexport default class { z() { q(); } }", "ts")
    assert r[("class_bases", "A")] == ["n.B"] and r[("class_attributes", "A")] == ["w", "y"] and r[("class_methods", "A")] == ["constructor(x)", "go(a, b)"] and r[("call_flow", "A.go")] == ["run"]


def test_go_records():
    code = "package p\n\ntype S struct {\n\tA, B int\n\tc *T `json:\"c\"`\n}\n\nfunc (s *S) Do(x, y int, f func(int) error) (int, error) {\n\ts.c = New(x)\n\tif v, ok := m[x]; ok {\n\t\tgo func() { fmt.Println(v, y) }()\n\t}\n\treturn f(x)\n}\n\nfunc main() {}\n"
    r, flows = of(code, "go")
    assert r[("class_attributes", "S")] == ["A", "B", "c"] and r[("class_methods", "S")] == ["Do(x, y, f)"] and r[("class_bases", "S")] == []
    assert r[("call_flow", "Do")] == ["New", "Println", "f"] and r[("call_flow", "main")] == [] and r[("variables", "Do")] == ["param:x", "param:y", "param:f"]
    assert ("Do", "y", "Println", 1) in flows


def test_java_records():
    code = "public class A<T> extends B<T> implements C, D {\n  private int n = 1, k;\n  A(String s) { this.m = s; }\n  @Override public void run(final List<T> xs, int i) throws E {\n    int y = f(i); for (T t : xs) { t.go(y, i); }\n    z = new Foo(y);\n  }\n  abstract int size(int q);\n  class In { void g() { h(); } }\n}\ninterface I { void w(int a); }"
    r, flows = of(code, "java")
    assert r[("class_bases", "A")] == ["B", "C", "D"] and r[("class_attributes", "A")] == ["k", "m", "n"] and r[("class_methods", "A")] == ["A(s)", "run(xs, i)", "size(q)"]
    assert r[("call_flow", "A.run")] == ["f", "go", "Foo"] and r[("call_flow", "A.In.g")] == ["h"] and r[("class_methods", "I")] == ["w(a)"]
    assert r[("variables", "A.run")] == ["param:xs", "param:i", "y", "z"] and ("A.run", "y", "go", 0) in flows and ("A.run", "i", "go", 1) in flows


def test_c_records():
    code = "#include <x.h>\nstruct P { int a; char *b[3]; };\nstatic int f(const char *s, int n) {\n  int k = g(n);\n  p->a = k; s[0] = 1;\n  while (k) { k -= h(s, k); }\n  return k;\n}\n"
    r, flows = of(code, "c")
    assert r[("class_attributes", "P")] == ["a", "b"] and r[("call_flow", "f")] == ["g", "h"] and r[("variables", "f")] == ["param:s", "param:n", "k", "p", "s", "k"]
    assert flows == [("f", "n", "g", 0), ("f", "s", "h", 0), ("f", "k", "h", 1)]
    r, _ = of("namespace n { class A : public B, private m::C {\n public:\n  A(int x) : x_(x) { init(x); }\n  int get() const { return x_; }\n private:\n  int x_ = 0;\n};\n}\nvoid A::run(int q) { step(q); }", "cpp")
    assert r[("class_bases", "A")] == ["B", "C"] and "x_" in r[("class_attributes", "A")] and r[("class_methods", "A")] == ["A(x)", "get()"] and r[("call_flow", "run")] == ["step"]


@pytest.mark.parametrize("ext", ["js", "go", "java", "c", "cpp"])
def test_brace_records_survive_anything(ext):
    rnd = random.Random(1)
    for _ in range(200):
        braces.records("".join(rnd.choice(["{", "}", "(", ")", "[", "]", "class ", "func ", "a", "=", "=>", ";", "\n", "\"", "function ", ",", "struct ", ".", "this"]) for _ in range(rnd.randrange(60))), ext)


def test_extract_survives_anything(spark):
    rows = [("r", "a.py", "def f(:\n"), ("r", "b.py", None), ("r", "c.js", "function ("), (None, "d.go", ""), ("r", "e.py", "x = 1")]
    got = extract.extract(spark.createDataFrame(rows, "repo_url string, filepath string, code string").withColumn("kind", F.lit(1)))
    assert {(r.source_file, r.kind) for r in got.collect()} == {("a.py", "error")}


def test_resolution_tiers_and_order(spark):
    fns = spark.createDataFrame([("r", "f2", "h", 5), ("r", "f1", "h", 9), ("r", "f3", "own", 1)], "repo_url string, source_file string, function string, ord long")
    calls = spark.createDataFrame([("r", "f3", "own", "x.h()", 1), ("r", "f3", "own", "own", 2), ("r", "f3", "own", "zzz()", 3)], "repo_url string, source_file string, function string, raw_call string, ord long")
    got = {r.ord: (r.tier, r.target_id) for r in resolve.resolve_calls(calls, fns).collect()}
    assert got == {1: ("same_repo", "func::r::f2::h"), 2: ("same_file", "func::r::f3::own"), 3: ("external", "external::zzz")}


def test_last_class_wins(spark):
    c = spark.createDataFrame([("r", "f1", "B", [], 1), ("r", "f2", "B", [], 2), ("r", "f3", "D", ["x.B"], 3)], "repo_url string, source_file string, class string, bases array<string>, ord long")
    assert resolve.resolve_bases(c).select("target").first().target == "class::r::f2::B"


def test_triangle(spark):
    e = spark.createDataFrame([("a", "b", "CALLS", 0.5), ("b", "c", "CALLS", 0.5), ("c", "a", "CALLS", 0.5)], EDGES)
    assert {r.clustering for r in graph.clustering(e).collect()} == {1.0}
    assert all(math.isclose(r["rank"], 1 / 3, abs_tol=1e-6) for r in graph.pagerank(e).collect())
    m = {r.id: (r.betweenness, r.closeness) for r in graph.shortest_path_measures(e).collect()}
    assert all(math.isclose(b, 0.5) and math.isclose(c, 2 / 3) for b, c in m.values())


def test_pagerank_sums_to_one_with_dangling_nodes(spark):
    e = spark.createDataFrame([("a", "b", "x", 1.0), ("b", "c", "x", 1.0), ("d", "c", "x", 1.0), ("d", "c", "x", 1.0)], EDGES)
    assert math.isclose(sum(r["rank"] for r in graph.pagerank(e).collect()), 1.0, abs_tol=1e-6)


def test_path_betweenness(spark):
    e = spark.createDataFrame([("a", "b", "x", 1.0), ("b", "c", "x", 1.0), ("c", "d", "x", 1.0)], EDGES)
    got = {r.id: r.betweenness for r in graph.shortest_path_measures(e).collect()}
    assert math.isclose(got["b"], 2 / 6) and math.isclose(got["c"], 2 / 6) and got["a"] == got["d"] == 0


def test_closeness_is_exact_when_betweenness_is_sampled(spark):
    rnd = random.Random(4)
    links = {(f"n{rnd.randrange(150)}", f"n{rnd.randrange(150)}") for _ in range(260)} | {(f"p{i}", f"p{i + 1}") for i in range(70)}
    into, ids = {}, {x for e in links for x in e}
    for a, b in links:
        into.setdefault(b, set()).add(a)
    want = {}
    for v in ids:
        dist, layer, k = {v: 0}, [v], 0
        while layer:
            k += 1
            layer = list({a for x in layer for a in into.get(x, ()) if a not in dist})
            dist.update(dict.fromkeys(layer, k))
        total, r = sum(dist.values()), len(dist) - 1
        want[v] = r / total * r / (len(ids) - 1) if total else 0.0
    e = spark.createDataFrame([(a, b, "x", 1.0) for a, b in links], EDGES)
    got = {r.id: r.closeness for r in graph.shortest_path_measures(e, exact=10, sources=5).collect()}
    assert set(got) == ids and all(math.isclose(got[v], want[v], abs_tol=1e-12) for v in ids)


@pytest.mark.parametrize("width", (30, 400))
def test_distances_are_whole_beyond_any_number_of_links(spark, monkeypatch, width):
    """A bound on the links is no more, and a few links at a time give what all at once do; hubs and chains are in it."""
    monkeypatch.setattr(graph, "MAX_LINKS", 10, raising=False)
    rnd = random.Random(width)
    links = {(rnd.randrange(width), rnd.randrange(width)) for _ in range(500)} | {(0, i) for i in range(60)} | {(i, 1) for i in range(60)} | {(1000 + i, 1001 + i) for i in range(30)}
    nodes, to = {x for e in links for x in e}, {}
    for a, b in links:
        if a != b:
            to.setdefault(a, set()).add(b)
    between, far, n = dict.fromkeys(nodes, 0.0), {v: [] for v in nodes}, len(nodes)
    for s in nodes:
        dist, sigma, order = {s: 0}, {s: 1}, [s]
        for u in order:
            for w in to.get(u, ()):
                if w not in dist:
                    dist[w], sigma[w] = dist[u] + 1, 0
                    order.append(w)
                if dist[w] == dist[u] + 1:
                    sigma[w] += sigma[u]
        delta = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            delta[u] = sum(sigma[u] / sigma[w] * (1 + delta[w]) for w in to.get(u, ()) if dist[w] == dist[u] + 1)
            if u != s:
                between[u] += delta[u] / ((n - 1) * (n - 2))
                far[u].append(dist[u])
    e = spark.createDataFrame([(a, b, "x", 1.0) for a, b in links], "src long, dst long, type string, p double")
    got = {r.id: r for r in graph.shortest_path_measures(e, at_once=7).collect()}
    assert set(got) == nodes
    for v, d in far.items():
        assert math.isclose(got[v].betweenness, between[v], abs_tol=1e-12) and math.isclose(got[v].closeness, len(d) / sum(d) * len(d) / (n - 1) if d else 0.0, abs_tol=1e-12)


def test_betweenness_is_exact_beyond_any_number_of_nodes(spark):
    """Chains a > b > c, all before h > t: more nodes than the old bound, beyond which 500 sources were sampled."""
    chains = 1_700
    links = [x for i in range(chains) for x in ((3 * i, 3 * i + 1), (3 * i + 1, 3 * i + 2), (3 * i + 2, 9_000))] + [(9_000, 9_001)]
    got = {r.id: r.betweenness for r in graph.shortest_path_measures(spark.createDataFrame(links, "src long, dst long")).collect()}
    n = 3 * chains + 2
    assert len(got) == n and n > 5_000
    through = {v: (0, 3, 4)[v % 3] for v in range(3 * chains)} | {9_000: 3 * chains, 9_001: 0}
    assert all(math.isclose(got[v] * (n - 1) * (n - 2), through[v], rel_tol=1e-9, abs_tol=1e-9) for v in got)


def test_features_of_a_graph_with_more_links_than_the_old_bound(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_LINKS", 2, raising=False)
    ids = "abcdz"
    nodes = spark.createDataFrame([(i, "File", i, f"d/{i}.py", "Python", True) for i in ids], "id string, type string, label string, filepath string, language string, analysed boolean")
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in ("ab", "bc", "cd", "ad", "zy")], "source string, target string, type string")
    got = {r.id: dict(zip(features.NAMES, r.x, strict=True)) for r in features.assemble(nodes, edges).collect()}
    assert set(got) == set(ids) and {len(x) for x in got.values()} == {76}
    assert [got[i]["betweenness"] for i in ids] == pytest.approx([0, 1 / 6, 1 / 6, 0, 0])
    assert [got[i]["closeness"] for i in ids] == pytest.approx([0, 1 / 3, 2 / 3 * 2 / 3, 3 / 4, 0])


def test_empty_graph(spark):
    e = spark.createDataFrame([], EDGES)
    assert graph.pagerank(e).count() == graph.clustering(e).count() == graph.degrees(e).count() == graph.negatives(e, 5).count() == 0


def test_topological_layers(spark):
    e = spark.createDataFrame([("a", "b", "x", 1.0), ("b", "c", "x", 1.0), ("d", "e", "x", 1.0), ("e", "d", "x", 1.0)], EDGES)
    assert {r.id: r.seq_layer for r in graph.topological_sequence(e).collect()} == {"a": 0, "b": 1, "c": 2, "d": -1, "e": -1}


def test_sequence_numbers_with_and_without_a_cycle(spark):
    def seq(pairs):
        return {r.id: r.seq for r in graph.sequence_numbers(spark.createDataFrame([(a, b, "x", 1.0) for a, b in pairs], EDGES)).collect()}

    assert seq(["ca", "ab", "cb", "cb"]) == {"c": 1, "a": 2, "b": 3}
    # one cycle: all nodes by in-degree, then id; a repeated edge counts once
    assert seq(["ab", "bc", "cb", "zc", "zc", "bd"]) == {"a": 1, "z": 2, "d": 3, "b": 4, "c": 5}
    assert seq(["aa", "ba"]) == {"b": 1, "a": 2}
    assert seq([]) == {}


def test_layers_query_keeps_every_edge(spark):
    d = "/root/testdata/sf0.001"
    got = entry.queries()["topological_layers"](spark, d).collect()
    assert len(got) == graph.node_ids(views.edges(spark, d)).count()
    assert sorted(r.seq for r in got) == list(range(1, len(got) + 1)) and any(r.seq_layer < 0 for r in got)


def test_negatives_are_no_edges(spark):
    e = spark.createDataFrame([(str(i), str((i * 7 + 1) % 20), "x", 1.0) for i in range(20)], EDGES)
    n = {(r.src, r.dst) for r in graph.negatives(e, 15).collect()}
    assert len(n) == 15 and not n & {(r.src, r.dst) for r in e.collect()} and all(a != b for a, b in n)


@pytest.mark.parametrize("mode", ("new", "all"))
def test_candidates_of_overlapping_groups_are_made_once_and_not_shuffled(spark, mode):
    rnd = random.Random(5)
    groups = [(i, rnd.randrange(6)) for i in range(40) for _ in range(rnd.randrange(1, 5))] + [(7, None), (None, 1)]
    edges = [(rnd.randrange(45), rnd.randrange(45), "x", 0.5) for _ in range(300)] + [(None, 3, "x", 0.5)]
    g, e = spark.createDataFrame(groups, "id long, grp int"), spark.createDataFrame(edges, "src int, dst int, type string, p double")
    pairs = graph.candidate_pairs(g, e, mode)
    known = {(a, b) for a, b, *_ in edges} if mode == "new" else set()
    want = {(a, b) for a, x in groups for b, y in groups if None not in (a, b, x) and x == y and a != b} - known
    assert sorted((r.src, r.dst) for r in pairs.collect()) == sorted(want)
    assert not re.search(r"hashpartitioning\(src#\w+, dst#", pairs._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("long", (0, 30, 45))
def test_digests_of_pairs(long):
    left, right = ([f"{i:03d}é".encode() + b"x" * long for i in range(n)] for n in (3, 4))
    both = [np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (left, right)]
    want = [int(hashlib.md5(b"seed|" + a + b">" + b).hexdigest()[:8], 16) for a in left for b in right]
    assert digests.pair_heads(b"seed|", both[0], b">", both[1]).tolist() == want


@pytest.mark.parametrize(("mode", "most"), (("new", 25), ("new", 100_000), ("all", 25), ("all", 1)))
def test_capped_candidates_are_the_capped_pairs_and_make_no_row_a_pair(spark, monkeypatch, mode, most):
    rnd = random.Random(6)
    names = [f"n{i * i}/é" for i in range(60)]
    groups = [(n, rnd.randrange(4)) for n in names for _ in range(2)] + [("n1/é", None)]
    edges = [(rnd.choice(names), rnd.choice(names), "x", 0.5) for _ in range(2_000)]
    g, e = spark.createDataFrame(groups, "id string, grp int"), spark.createDataFrame(edges, EDGES)
    want = [tuple(r) for r in graph.capped(graph.candidate_pairs(g, e, mode), most).collect()]
    monkeypatch.setattr(graph, "candidate_pairs", None)
    assert [tuple(r) for r in graph.capped_candidates(g, e, most, mode).collect()] == want and len(want) > 0


def test_scoring_a_graph_makes_no_row_a_pair(spark, monkeypatch):
    """The capped candidates of a scored graph are those of all pairs, found without a table of all pairs."""
    ids = [f"n{i}" for i in range(30)]
    nodes, groups = spark.createDataFrame([(i, None) for i in ids], "id string, filepath string"), spark.createDataFrame([(i, k % 3) for k, i in enumerate(ids)], "id string, grp int")
    e = spark.createDataFrame([(ids[i], ids[(i * 7 + 3) % 30], ["CALLS"]) for i in range(30)], "src string, dst string, types array<string>")
    z = spark.createDataFrame([(i, [1.0, 2.0]) for i in ids], "id string, x array<double>")
    want = {tuple(r) for r in graph.capped(graph.candidate_pairs(groups, e, "new"), 40).collect()}
    monkeypatch.setattr(graph, "candidate_pairs", None)
    fitted = {"exists": models.Constant(0.9), "CALLS": models.Constant(0.8), "FLOWS_TO": models.Constant(0.1)}
    got = models.score_graph(nodes, e, z, fitted, groups, most=40).collect()
    assert {(r.source_id, r.target_id) for r in got} == want and len(got) == 40 and {tuple(r.predicted_types) for r in got} == {("CALLS",)}


@pytest.mark.parametrize(("mode", "margins"), (("new", 1 << 18), ("new", 5_000), ("all", 5_000)))
def test_a_scored_graph_is_of_all_pairs(spark, monkeypatch, mode, margins):
    """More pairs than the old cap (500,000): the surest of all of them, with ties, known pairs and ids of several groups."""
    monkeypatch.setattr(graph, "candidate_pairs", None)  # it would make a row a pair
    monkeypatch.setattr(pairs, "MARGINS", margins, raising=False)
    rnd = random.Random(12)
    ids = [f"n{i * i}é" for i in range(740)]
    x = {i: [rnd.random(), rnd.choice((0.0, 1.0))] for i in ids}
    groups = [(i, 0) for i in ids[:720]] + [(i, 1) for i in ids[700:]] + [(i, 2) for i in ids[:30]] + [("no vector", 0), (None, 0), (ids[0], None)]
    nodes = spark.createDataFrame([(i, f"d/{i}" if k % 2 else None) for k, i in enumerate(ids[:735])], "id string, filepath string")
    z = spark.createDataFrame(list(x.items()), "id string, x array<double>")
    by = sorted(ids, key=lambda i: -sum(x[i]))
    known = {(a, b) for a in by[:40] for b in by[20:60] if a != b} | {(ids[1], "else")}
    e = spark.createDataFrame(list(known), "src string, dst string")
    coef = {"exists": ([2.0, 0.5, 1.0, 0.25, 2.0, -0.5], -3.0), "CALLS": ([1.0, -1.0, 0.0, 0.0, 0.5, 0.0], 0.1)}
    fitted = {t: pairs.Linear(np.array(c), b) for t, (c, b) in coef.items()} | {"FLOWS_TO": models.Constant(0.25)}
    tell = lambda t, a, b: 1 / (1 + math.exp(-(sum(c * v for c, v in zip(coef[t][0], [*x[a], *x[b], x[a][0] * x[b][0], x[a][1] * x[b][1]], strict=True)) + coef[t][1])))
    inside = [(a, b) for part in (ids[:720], ids[700:735]) for a in part for b in part if a != b]
    scored = {(a, b): tell("exists", a, b) for a, b in inside if mode == "all" or (a, b) not in known}
    assert len(scored) > 500_000
    want = sorted((-round(v, 4), a, b) for (a, b), v in scored.items() if v >= 0.5)[:1_000]
    got = models.score_graph(nodes, e, z, fitted, spark.createDataFrame(groups, "id string, grp int"), mode).collect()
    assert [(-r.edge_exists_prob, r.source_id, r.target_id) for r in got] == want and len(want) == 1_000
    assert all(r.type_probs == {"CALLS": pytest.approx(tell("CALLS", r.source_id, r.target_id), abs=6e-5), "FLOWS_TO": 0.25} and r.target_filepath.endswith(r.target_id) for r in got)


@pytest.mark.parametrize(("p", "least", "n"), ((0.12345, 0.1, 7), (0.4, 0.5, 0), (1.0, 1.0, 100)))
def test_surest_pairs_of_one_probability_are_the_first(spark, p, least, n):
    ids = [f"n{i}" for i in range(9)]
    z = pairs.Vectors.of(spark.createDataFrame([(i, [1.0]) for i in ids], "id string, x array<double>"))
    got = pairs.surest(spark.createDataFrame([(i, 0) for i in ids], "id string, grp int"), None, z, p, least, n or 5).collect()
    assert [(r.src, r.dst) for r in got] == [(a, b) for a in ids for b in ids if a != b][:n]


def test_probabilities_are_rounded_as_spark_rounds_them(spark):
    rnd = random.Random(3)
    values = [rnd.random() for _ in range(500)] + [(2 * rnd.randrange(10_000) + 1) / 20_000 for _ in range(500)] + [0.0, 1.0, 0.99995, 0.99994999]
    got = pairs._rounded(np.array(values)).tolist()
    assert got == [round(r.r * 10_000) for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 4).alias("r")).collect()]


def test_pair_models_are_those_of_rows_with_all_numbers(spark, monkeypatch):
    """The same negative pairs, coefficients and means as with 3 * width numbers a pair in rows, which are made no more."""
    rnd = random.Random(8)
    ids = [f"n{i:03d}" for i in range(120)]
    # the last entry is the same for all ends of known pairs only
    x = spark.createDataFrame([(i, [rnd.random(), 3.5, float(rnd.randrange(3)), -rnd.random(), 0.5 if k < 90 else 0.75]) for k, i in enumerate(ids)], "id string, x array<double>")
    links = [(rnd.choice(ids[:90]), rnd.choice(ids[:90])) for _ in range(700)] + [(ids[0], i) for i in ids[:90]] * 2
    e = spark.createDataFrame([*links, ("no", ids[1]), (ids[1], "no")], "src string, dst string")
    typed = e.where("src <> dst AND src <> 'no' AND dst <> 'no'").distinct().withColumn("types", F.when(F.col("src") < F.col("dst"), F.array(F.lit("CALLS"))).otherwise(F.array(F.lit("USES"))))
    z = models.encode(x, e)
    monkeypatch.setattr(graph, "mean_neighbours", None)
    v = models.encoded(x, e)
    got = models.fit_edges(v, typed, rounds=8)
    want = {r.id: r.x for r in z.collect()}
    rows = np.hstack(v.open())
    assert rows.shape == (120, 10) and all(np.allclose(rows[k], want[i], rtol=1e-13) for k, i in enumerate(ids))
    pos = typed.collect()
    neg = graph.negatives(typed, len(pos), nodes=x).collect()
    numbers = {(r.a, r.b) for r in graph.negative_numbers(typed.select(v.index.of("src").alias("a"), v.index.of("dst").alias("b")), len(pos), 120).collect()}
    assert numbers == {(ids.index(r.src), ids.index(r.dst)) for r in neg} and len(numbers) == len(pos)

    def made(a, b):
        p, q = np.array(want[a]), np.array(want[b])
        return [*p.tolist(), *q.tolist(), *(p * q).tolist()]

    both = [(made(r.src, r.dst), True, "CALLS" in r.types) for r in pos] + [(made(r.src, r.dst), False, None) for r in neg]
    data = spark.createDataFrame(both, "x array<double>, exists boolean, calls boolean")
    for name, told in (("exists", models.fit_binary(data, "exists", 8)), ("CALLS", models.fit_binary(data.where("exists"), "calls", 8))):
        assert np.allclose(got[name].coef, told.coefficients.toArray(), rtol=1e-6, atol=1e-9) and math.isclose(got[name].intercept, told.intercept, rel_tol=1e-6)
    assert got["FLOWS_TO"].p == 0.0 and not got["exists"].coef[1] and got["exists"].coef[4] and not got["CALLS"].coef[4]


@pytest.mark.parametrize("plain", (True, False))
def test_arrays_in_a_shared_folder_or_broadcast(spark, monkeypatch, plain):
    if not plain:
        monkeypatch.setattr(arrays, "_folder", lambda _: None)
    x = spark.createDataFrame([(k, [float(k), 1.0]) for k in (3, 1, 7)], "id int, x array<double>")
    v = pairs.Vectors.of(x).with_means(spark.createDataFrame([(1, 7), (3, 7), (3, 7), (9, 1)], "src long, dst long"), 2)
    assert np.hstack(v.open()).tolist() == [[1, 1, 0, 0], [3, 1, 0, 0], [7, 1, pytest.approx(7 / 3), 1]]
    assert [r[0] for r in spark.createDataFrame([(7,), (2,), (None,)], "i long").select(v.index.of("i")).collect()] == [2, -1, -1]
    v.parts[0].close()


def test_first_words_of_digests_need_no_last_steps(monkeypatch):
    """Texts of one block and of two: the last block ends when the first word is known, a block before it does not."""
    done = []
    block = digests._block
    monkeypatch.setattr(digests, "_block", lambda state, words, steps=64: done.append(steps) or block(state, words, steps))
    for prefix in (b"cap|", b"p" * 70):
        left, right = np.array([list(b"12"), list(b"98")], np.uint8), np.array([list(b"345"), list(b"700"), list(b"001")], np.uint8)
        want = [int.from_bytes(hashlib.md5(prefix + a.tobytes() + b">" + b.tobytes()).digest()[:4], "big") for a in left for b in right]
        assert digests.pair_heads(prefix, left, b">", right).tolist() == want
    assert done == [61, 64, 61]


def test_packed_edges_need_no_row_an_edge(spark):
    """Ends, means and pairs of packed edges are those of rows; null ends, loops, repeated edges and hubs are among them."""
    rnd = random.Random(5)
    ids = [*range(-3, 60), 10**12]
    links = [(rnd.choice(ids), rnd.choice(ids), rnd.choice((1, 3, 5))) for _ in range(900)] + [(7, 9, 1)] * 600 + [(None, 4, 1), (5, None, 3), (8, 8, 3)]
    e = arrays.Packed(spark.createDataFrame(links, "src long, dst long, flags int"))
    assert sorted(r.id for r in e.ends().collect()) == sorted({x for a, b, _ in links for x in (a, b)} - {None})
    x = spark.createDataFrame([(str(i), [float(i), rnd.random(), 1.0]) for i in ids if i != 11], "id string, x array<double>")
    own = pairs.Vectors.of(x)
    whole = arrays.Whole(own.index)
    by_rows = own.with_means(spark.createDataFrame(links, "src long, dst long, flags int"), 3)
    packed = own.with_means(e, 3, whole)
    want = {r.id: r.x for r in models.encode(x, spark.createDataFrame([v[:2] for v in links], "src string, dst string")).collect()}
    names = sorted(want)
    assert np.allclose(packed.open()[0], [want[i] for i in names], rtol=1e-12) and (packed.open()[0] == by_rows.open()[0]).all()
    on = [i for i in names if int(i) % 2 == 0]
    chosen = arrays.placed(spark.createDataFrame([(names.index(i), b"\x01") for i in on], "at long, row binary"), len(names), 1, "u1")
    got = sorted((r.src, r.dst, r.a, r.b, r.flags) for r in e.within(whole, chosen).collect())
    assert got == sorted((a, b, names.index(str(a)), names.index(str(b)), f) for a, b, f in links if a != b and str(a) in on and str(b) in on)
    assert "1000000000000" in on and {f for *_, f in got} == {1, 3, 5}


def test_losses_of_pairs_by_runs_are_those_of_all_numbers():
    rng = np.random.default_rng(3)
    parts, a, b = [rng.normal(size=(40, 3)), rng.normal(size=(40, 2))], np.sort(rng.integers(0, 40, 1_300)), rng.integers(0, 40, 1_300)
    flags, weight, label = rng.integers(0, 4, 1_300).astype(np.uint8), rng.random((256, 2)), rng.integers(0, 2, (256, 2)).astype(float)
    coef, shift = rng.normal(size=(15, 2)), rng.normal(size=2)
    x = np.hstack(parts)
    x = np.hstack([x[a], x[b], x[a] * x[b]])
    m, y, w = x @ coef + shift, label[flags], weight[flags]
    r = w * (1 / (1 + np.exp(-m)) - y)
    for rows in (parts, [np.hstack(parts)]):
        loss, total, moved = pairs._losses(pairs._losses(None, rows, a[:700], b[:700], flags[:700], coef, shift, weight, label), rows, a[700:], b[700:], flags[700:], coef, shift, weight, label)
        assert np.allclose(loss, (w * (np.log1p(np.exp(m)) - y * m)).sum(axis=0)) and np.allclose(total, r.sum(axis=0)) and np.allclose(moved, x.T @ r)


def test_a_number_that_is_the_same_in_all_rows_of_a_model_has_no_deviation():
    """Its mean is off by rounding; scaled up, that spoiled the models of the types."""
    x = np.column_stack([np.full(70, 0.1), np.arange(70.0)])
    x[60:, 0] = 0.7
    flags = np.array([1, 3] * 30 + [0] * 10, np.uint8)
    by = pairs._moments(pairs._moments(None, x[:33], flags[:33]), x[33:], flags[33:])
    assert pairs.Problem(by, 2, 1, 20.0, 1e-3).std[0] == 0 < pairs.Problem(by, 1, 0, 20.0, 1e-3).std[0]
    assert math.isclose(pairs.Problem(by, 2, 1, 20.0, 1e-3).std[1], np.std(np.arange(60.0), ddof=1))


def test_static_features_as_bytes_are_those_in_arrays_and_zeros_are_left_out(spark):
    rows = [("a", "File", "x.py", "src/d1/x.PY", "Python", True), ("b", "Odd", None, None, "Klingon", None), ("c", None, "é f", "/y", None, False), ("d", "OTHER", "", "a/b/.c", "OTHER", True)]
    nodes = spark.createDataFrame(rows, "id string, type string, label string, filepath string, language string, analysed boolean")
    want = {r.id: r.x for r in features.static(nodes).collect()}
    got = {r.id: np.frombuffer(r.row).tolist() for r in features.static_bytes(nodes).collect()}
    assert got == want and len(want["a"]) == features.STATIC
    v = pairs.Vectors.of(features.static_bytes(nodes), zeros=False)
    every = np.array([want[k] for k in sorted(want)])
    assert v.width < features.STATIC and (v.open()[0] == every[:, (every != 0).any(axis=0)]).all()


@pytest.mark.parametrize("far", (0, 10**14))
def test_whole_numbers_are_found_by_table_or_search(spark, far):
    """Near one another they have places in a table; one far off, and they are searched for."""
    ids = [5, 9, -3, 40, 2**62 - far]
    x = spark.createDataFrame([(str(i), [1.0]) for i in (ids if far else ids[:-1])], "id string, x array<double>")
    own = pairs.Vectors.of(x)
    whole, names = arrays.Whole(own.index), sorted(r.id for r in x.collect())
    asked = np.array([9, -4, -3, 41, 40, 0, arrays.NONE, 2**63 - 1])
    assert whole.open()(asked).tolist() == [names.index(str(i)) if str(i) in names else -1 for i in asked.tolist()]
    v = np.array([*range(-4, 9), 3, 3, far])
    assert arrays._distinct(v).tolist() == sorted({*v.tolist()})


def test_a_long_run_of_pairs_is_some_runs(monkeypatch):
    """No product of a pair is made, and of a first end with many pairs so many at a time."""
    monkeypatch.setattr(pairs, "PRODUCTS", 8)
    rng = np.random.default_rng(4)
    x, a, b = rng.normal(size=(30, 4)), np.sort(np.r_[np.full(21, 7), rng.integers(0, 30, 60)]), rng.integers(0, 30, 81)
    flags, weight, label = rng.integers(0, 4, 81).astype(np.uint8), rng.random((256, 2)), rng.integers(0, 2, (256, 2)).astype(float)
    coef, shift, seen, taken = rng.normal(size=(12, 2)), rng.normal(size=2), [], pairs._taken
    monkeypatch.setattr(pairs, "_taken", lambda rows, at: seen.append(len(at)) or taken(rows, at))
    loss, total, moved = pairs._losses(None, [x], a, b, flags, coef, shift, weight, label)
    z = np.hstack([x[a], x[b], x[a] * x[b]])
    m, y, w = z @ coef + shift, label[flags], weight[flags]
    r = w * (1 / (1 + np.exp(-m)) - y)
    assert np.allclose(loss, (w * (np.log1p(np.exp(m)) - y * m)).sum(axis=0)) and np.allclose(total, r.sum(axis=0)) and np.allclose(moved, z.T @ r) and max(seen) <= 8


def test_steps_of_digests_whose_words_are_the_same_in_a_row_are_made_once_for_it(monkeypatch):
    shapes = []
    add = np.left_shift

    class Watched:
        def __getattr__(self, name):
            return (lambda *a: shapes.append(a[0].shape) or add(*a)) if name == "left_shift" else getattr(np, name)

    monkeypatch.setattr(digests, "np", Watched())
    left, right = np.array([list(b"123456"), list(b"987654")], np.uint8), np.array([list(b"345"), list(b"700"), list(b"001")], np.uint8)
    want = [int.from_bytes(hashlib.md5(b"cap|" + a.tobytes() + b">" + b.tobytes()).digest()[:4], "big") for a in left for b in right]
    assert digests.pair_heads(b"cap|", left, b">", right).tolist() == want
    assert shapes[:3] == [(1, 1), (2, 1), (2, 3)] and set(shapes[3:]) == {(2, 3)}


@pytest.mark.parametrize("repeated", (True, False))
def test_edges_are_joined_with_their_sources_as_blocks(spark, monkeypatch, repeated):
    """As an inner join, with null keys and ends, keys on one side only, and keys that have several sources."""
    monkeypatch.setattr(arrays, "BLOCK", 7)
    rnd = random.Random(9)
    edges = [(rnd.choice((None, *range(-5, 40))), rnd.choice((None, *range(9))), rnd.randrange(6)) for _ in range(300)]
    sources = [(k, rnd.choice((None, 2**40, 5, -7))) for k in (None, *range(-2, 50))] * (1 + repeated) + [(7, 1)] * (3 * repeated)
    e, s = spark.createDataFrame(edges, "key int, dst long, flags int"), spark.createDataFrame(sources, "key long, src long")
    end = lambda v: arrays.NONE if v is None else v
    want = sorted((end(src), end(dst), f) for key, dst, f in edges for k, src in sources if key is not None and key == k)
    got = [tuple(np.frombuffer(r[c], t).tolist() for c, t in (("src", "i8"), ("dst", "i8"), ("flags", "u1"))) for r in arrays.Packed.joined(e, s).written.collect()]
    assert sorted(v for block in got for v in zip(*block, strict=True)) == want and max(len(x[0]) for x in got) <= 7
    assert arrays.Packed.joined(e.where("key = 999"), s).written.count() == 0 == arrays.Packed.joined(e, s.where("key = 999")).ends().count()


def test_edges_by_their_parts_are_the_edges(spark):
    to, of = views.edge_parts(spark, SMALL)
    rows = lambda x: sorted(tuple(r) for r in x.select("src", "dst", "type").collect())
    assert rows(to.join(of, "key")) == rows(views.edges(spark, SMALL)) != []


@pytest.mark.parametrize(("n", "known"), ((40, 300), (2_000, 5_000), (5, 18), (1, 0)))
def test_training_pairs_are_dealt_as_blocks(spark, monkeypatch, n, known):
    """The known pairs, repeated ones too, and the first draws that are none, as negative_numbers has them; few rows are shuffled."""
    monkeypatch.setattr(pairs, "BLOCK", 64)
    rnd = random.Random(n)
    rows = [(rnd.randrange(n), rnd.randrange(n), rnd.randrange(1, 6)) for _ in range(known)] + [(-1, 0, 1), (0, -1, 3)]
    pos = spark.createDataFrame(rows, "a long, b long, flags int")
    neg = [(r.a, r.b, 0) for r in graph.negative_numbers(pos, len(rows), n).collect()]
    monkeypatch.setattr(graph, "negative_numbers", None)
    written = pairs.training(pos, len(rows), n, 3)
    got = [[np.frombuffer(r[c], t).tolist() for c, t in (("a", "i4"), ("b", "i4"), ("flags", "u1"))] for r in written.collect()]
    assert sorted(v for block in got for v in zip(*block, strict=True)) == sorted([r for r in rows if min(r[:2]) >= 0] + neg)
    assert all(block[0] == sorted(block[0]) and len(block[0]) <= 64 for block in got) and (len(neg) == len(rows) or n < 100)


def test_layer_flow_tie_goes_to_the_first_name(spark):
    e = spark.createDataFrame([("1", "2", "x", 0.2), ("2", "1", "x", 0.4)], EDGES)
    layers = spark.createDataFrame([("1", "api"), ("2", "backend")], "id string, layer string")
    r = rollups.layer_flow(e, layers).first()
    assert (r.s, r.t, r.weight, r.ab, r.ba, r.mean_p) == ("api", "backend", 2, 1, 1, 0.3)


def test_small_strata(spark):
    rows = spark.createDataFrame([(k, f"{k}{i}") for k, n in (("a", 1), ("b", 2), ("c", 3), ("d", 10)) for i in range(n)], "s string, k string")
    got = {}
    for r in splits.stratified(rows, "s", "k").groupBy("s", "split").count().collect():
        got.setdefault(r.s, {})[r.split] = r["count"]
    assert got == {"a": {"train": 1}, "b": {"train": 2}, "c": {"train": 2, "val": 1}, "d": {"train": 7, "val": 2, "test": 1}}


def test_groups_stay_together(spark):
    rows = spark.createDataFrame([(f"g{i % 17}", i) for i in range(200)], "g string, i int")
    assert splits.grouped(rows, "g").groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_classification_without_code(spark):
    r = roles.classify(spark.createDataFrame([("tests/x.py", None), ("", "")], "filepath string, code string")).collect()
    assert r[0].predicted_label == "test" and r[0].is_confident


def brute(rows):
    out = {}
    for repo, label, path, conf in rows:
        for field, value in (("repo_url", repo), ("predicted_label", label)):
            if value is not None:
                o = out.setdefault((field, value), [0, set(), []])
                o[0] += 1
                if path is not None:
                    o[1].add((repo, path))
                if conf is not None and 0 <= conf <= 1:
                    o[2].append(conf)
    return {k: (n, len(f), len(c), round(sum(c) / len(c), 6) if c else None) for k, (n, f, c) in out.items()}


def test_per_key_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", "b", None]), rnd.choice(["x", "X", None]), rnd.choice([None, *map(str, range(9))]), rnd.choice([None, 0.5, 0.25, 1.5, -1.0, float("nan")])) for _ in range(500)]
    df = spark.createDataFrame(rows, "repo_url string, predicted_label string, filepath string, confidence double").withColumn("ent", F.lit("clash")).withColumn("key_value", F.lit(1))
    got = {(r.key_field, r.key_value): (r.n_rows, r.n_files, r.n_usable, r.mean_confidence) for r in skew.per_key(df).collect()}
    assert got == brute([(a, b, c, None if d != d else d) for a, b, c, d in rows])
    assert {r.key_value for r in skew.heavy_keys(df, 40).collect()} >= {"hot"}
    # more partitions than a key or an entity has rows: every state is stitched
    many = {(r.key_field, r.key_value): (r.n_rows, r.n_files, r.n_usable, r.mean_confidence) for r in skew.per_key(df, partitions=60).collect()}
    assert many == got


def test_a_repeated_entity_is_split(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("repo_url"), F.lit("x").alias("predicted_label"), F.when(F.col("id") % 2 == 0, "same").alias("filepath"), F.lit(0.5).alias("confidence"))
    k = skew.keyed(df, ["repo_url"], ["repo_url", "filepath"], "confidence")
    sizes = [r["count"] for r in k.repartitionByRange(8, "key_field", "key_value", "has", "e1", "e2", "o").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    got = skew.per_key(df, partitions=8).collect()
    assert {(r.key_value, r.n_rows, r.n_files) for r in got} == {("hot", 20_000, 1), ("x", 20_000, 1)}


def test_per_key_without_a_usable_measure(spark):
    df = spark.createDataFrame([("a", "x", "f", None), ("a", "x", "g", 2.0)], "repo_url string, predicted_label string, filepath string, confidence double")
    assert {(r.key_value, r.n_rows, r.n_usable, r.mean_confidence) for r in skew.per_key(df).collect()} == {("a", 2, 0, None), ("x", 2, 0, None)}


def test_per_key_of_nothing(spark):
    df = spark.createDataFrame([], "repo_url string, predicted_label string, filepath string, confidence double")
    assert skew.per_key(df).count() == skew.heavy_keys(df).count() == 0


def test_repo_reading_and_lists(spark, tmp_path):
    (tmp_path / "r1" / "src").mkdir(parents=True)
    (tmp_path / "r1" / "node_modules").mkdir()
    (tmp_path / "r1" / "src" / "a.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / "r1" / "node_modules" / "b.js").write_text("1")
    got = files.read_repos(spark, str(tmp_path)).collect()
    assert [(r.repo_url, r.filepath, r.language) for r in got] == [("r1", "src/a.py", "Python")] and "�" in got[0].code
    (tmp_path / "list.txt").write_text("# all\nhttps://h/a main\n\nhttps://h/b # note\n")
    assert [(r.url, r.branch) for r in files.read_repo_list(spark, str(tmp_path / "list.txt")).collect()] == [("https://h/a", "main"), ("https://h/b", None)]


def test_checkpoint_folder_is_ours_on_local_masters_only(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return {}

    fake = type("Session", (), {"sparkContext": Context(), "conf": {}})()
    with pytest.raises(ValueError, match="checkpoint"):
        ensure_checkpoint_dir(fake)
    assert ensure_checkpoint_dir(spark)


def test_json_and_split_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t", "l", "o", "m", "train"), ("b", "t", "l", "o", "m", "val")], "filepath string, text string, label string, original_label string, remap_method string, split string")
    files.write_split_jsonl(rows, str(tmp_path / "x"))
    assert files.read_examples(spark, str(tmp_path / "x")).count() == 2
    df, path = files.read_with_fallback(spark, [str(tmp_path / "none"), str(tmp_path / "x")], "filepath string")
    assert path.endswith("x") and df.count() == 2


def test_stream_keeps_the_latest_records(spark, tmp_path):
    schema = "repo_url string, source_file string, function string, ord long"
    src = str(tmp_path / "in")
    spark.createDataFrame([("r", "f", "old", 1), ("r", "g", "keep", 1)], schema).coalesce(1).write.parquet(src)
    q = ingest.replace_stream(spark.readStream.schema(schema).parquet(src), str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination(60)
    spark.createDataFrame([("r", "f", "new", 2)], schema).coalesce(1).write.mode("append").parquet(src)
    q = ingest.replace_stream(spark.readStream.schema(schema).parquet(src), str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination(60)
    typed = spark.createDataFrame([], schema).schema
    assert sorted(r.function for r in ingest.current(spark, str(tmp_path / "t"), typed).collect()) == ["keep", "new"]
    ingest.compact(spark, str(tmp_path / "t"), str(tmp_path / "u"), typed)
    assert sorted(r.function for r in ingest.current(spark, str(tmp_path / "u"), typed).collect()) == ["keep", "new"]


def norm(rows):
    def f(x):
        if isinstance(x, float):
            return round(x, 5) + 0.0
        return [f(i) for i in x] if isinstance(x, (list, tuple)) else x

    return sorted((repr([f(v) for _, v in sorted(r.items())]) for r in rows))


@pytest.mark.parametrize("name", sorted({**core_queries.SQL, **skew_queries.SQL, **graph_queries.SQL, **serving_queries.SQL, **model_queries.SQL}))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings sources file_index predictions examples label_meta label_targets eval_items".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = entry.queries()[name](spark, SMALL).collect()
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert norm([r.asDict() for r in got]) == norm([dict(zip(cols, r, strict=True)) for r in cur.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
