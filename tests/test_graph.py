"""The graph kernel on small graphs with cycles, self-loops, repeats, gaps and nulls."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codeloom.graph import Graph, Scope
from codeloom.operators import metrics, relations, traversal as tr
from codeloom.session import checkpoint_dir
from codeloom.sources import tables

NODES = "id string, kind string, name string, path string, line_number int, lang string, source string, docstring string, cyclomatic_complexity int, qualified_name string, visibility string, branch string, repository_path string"
EDGES = "src string, dst string, kind string, callee_name string, line_number int, jaccard double, confidence double, provenance string"


def node(id, kind="FUNCTION", name=None, path="/r/a.py", line=1, repo="/r", branch="main", source=None, visibility=None):
    return (id, kind, name or id, path, line, None, source, None, None, None, visibility, branch, repo)


def edge(src, dst, kind="CALLS", confidence=None, callee=None):
    return (src, dst, kind, callee, 1, None, confidence, None)


def graph(spark, nodes, edges):
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def pairs(spark, *links):
    return spark.createDataFrame([tuple(x) for x in links], "src string, dst string")


def roots(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "root string")


def got(df, *columns):
    return {tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_reach(spark):
    e = pairs(spark, "cb", "ba", "eb", "da", "xy", "yx", "ba")
    r = {x["id"]: x for x in tr.reach_index(e).collect()}
    assert r["a"]["d1_count"] == 3 and r["a"]["d3_count"] == 4 and r["a"]["ids"] == "b,d,c,e"
    assert "x" in r["x"]["ids"].split(",") and not r["x"]["truncated"]
    assert {x["id"]: x["truncated"] for x in tr.reach_index(e, 1).collect()}["a"]


def brute(links, root, depth):
    seen, level, out = set(), {root}, {}
    for d in range(1, depth + 1):
        level = {b for a, b in links for x in level if a == x} - seen
        for x in level:
            out.setdefault(x, d)
        seen |= level
    return {(root, k, v) for k, v in out.items()}


def test_closure_is_brute_force(spark):
    rng = random.Random(5)
    links = [(rng.choice("abcdefgh"), rng.choice("abcdefgh")) for _ in range(14)]
    e, r = pairs(spark, *links), roots(spark, *"abcdefgh")
    assert got(tr.closure(e, r, 4), "root", "id", "depth") == set().union(*(brute(links, x, 4) for x in "abcdefgh"))
    assert tr.closure(e.limit(0), r, 3).count() == 0
    assert got(tr.closure(pairs(spark, "aa"), roots(spark, "a"), 9, itself=True), "id", "depth") == {("a", 0)}


def test_paths(spark):
    e = pairs(spark, "ab", "bd", "ac", "cd", "da", "dd")
    assert ("a", "d", 2, "a > b > d") in got(tr.shortest_paths(e, roots(spark, "a"), 5), "root", "id", "depth", "path")
    p = tr.simple_paths(e, roots(spark, "a"), 5).select(F.array_join("nodes", "").alias("p"))
    assert got(p, "p") == {"ab", "ac", "abd", "acd"}
    assert got(tr.cycles(e, 4), "members") == {"a > b > d", "a > c > d", "d"}


def test_pagerank_sums_to_one(spark):
    e = pairs(spark, "ab", "bc", "cb", "ad", "dz")
    ids = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    ranks = {r["id"]: r["score"] for r in tr.pagerank(e, ids).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["b"] > ranks["a"]
    assert tr.pagerank(e, ids.limit(0)).count() == 0


def test_calls_stay_in_their_scope(spark):
    g = graph(
        spark,
        [node("f1", name="f"), node("g1", name="g"), node("g1", name="g"), node("g2", name="g", repo="/other"), node("g3", name="g", branch="dev"), node("call_target:g", "CALL_TARGET", "g", None, None, None, None), (None, *node("x")[1:])],
        [edge("f1", "call_target:g"), edge("f1", "call_target:g", confidence=0.4), edge("f1", "call_target:h"), edge(None, "g1"), edge("f1", "m", "IMPORTS")],
    )
    assert got(g.calls, "src", "dst") == {("f1", "g1")}
    assert got(relations.callers(g, "g", Scope("/r", "main")), "id") == {"f1"} and not got(relations.callers(g, "g", Scope("/other")), "id")
    assert got(relations.unresolved(g), "callee_name") == {"h"}
    assert ("f1", "m", "IMPORTS") in got(relations.dangling(g), "src", "dst", "kind")


def test_empty_graph(spark):
    g = graph(spark, [], [])
    for df in (g.calls, metrics.analyze_module(g), metrics.dead_code(g), relations.quick_info(g), relations.impact_graph(g, roots(spark, "a")), metrics.coupling(g), relations.compare_repositories(g), tr.reach_index(g.calls)):
        assert df.count() == 0


def test_three_rules_of_dead_code(spark):
    names = ["main", "new", "test_x", "_p", "plain", "used"]
    g = graph(spark, [node(n) for n in names] + [node("caller", path="/r/b.py")], [edge("caller", "call_target:used")])
    assert got(metrics.dead_code(g), "name") == {"test_x", "_p", "plain", "caller"}
    assert got(metrics.dead_code_scoped(g, Scope("/r")), "name") == {"plain", "caller", "new"}
    assert got(metrics.dead_code_everywhere(g), "name") == {"main", "new", "test_x", "_p", "plain", "caller"}


def test_hierarchy(spark):
    g = graph(spark, [node(x, "CLASS") for x in "ABC"], [edge("A", "B", "INHERITS"), edge("B", "C", "INHERITS"), edge("C", "A", "IMPLEMENTS")])
    assert got(relations.hierarchy(g, roots(spark, "A")), "id", "depth") == {("A", 0), ("B", 1), ("C", 2)}
    assert got(relations.hierarchy(g, roots(spark, "A"), up=False), "id", "depth") == {("A", 0), ("C", 1), ("B", 2)}


def test_impact_takes_the_nearest_relation(spark):
    g = graph(
        spark, [node("a"), node("b"), node("c"), node("file", "FILE", "a.py")],
        [edge("b", "call_target:a", confidence=0.5), edge("c", "call_target:b"), edge("c", "call_target:a"), edge("file", "a", "CONTAINS"), edge("b", "module:a", "IMPORTS")],
    )
    r = {(x["id"]): (x["relation"], x["confidence"]) for x in relations.impact_graph(g, roots(spark, "a")).collect()}
    assert r == {"b": ("direct_caller", 0.5), "c": ("direct_caller", 1.0)}


def test_branch_diff(spark):
    g = graph(
        spark,
        [node("1", name="same", source="def same():\n  1"), node("2", name="same", branch="dev", source="def same():\n  1"), node("3", name="body", source="def body():\n  1"), node("4", name="body", branch="dev", source="def body():\n  2"),
         node("5", name="sig", source="def sig(a):\n  1"), node("6", name="sig", branch="dev", source="def sig(b):\n  1"), node("7", name="only"), node("8", name="none"), node("9", name="none", branch="dev", source="x")],
        [],
    )
    on = lambda b: F.col("branch") == b
    assert got(relations.modified(g, on("main"), on("dev")), "name", "change") == {("body", "body"), ("sig", "signature")}
    assert got(relations.branch_only(g, "main", "dev"), "name") == {"only"}


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, v int")
    new = spark.createDataFrame([("b", 5), ("b", 4), ("c", 6), (None, 7)], "id string, v int")
    assert got(tables.upsert_nodes(old, new), "id", "v") == {("a", 1), ("b", 5), ("c", 6)}
    before = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "path string, content_hash string")
    after = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "3"), ("n", "8")], "path string, content_hash string")
    assert got(tables.changed_files(before, after), "path", "state") == {("y", "changed"), ("z", "deleted"), ("w", "renamed"), ("n", "added")}


def test_bundle_comes_back(spark, tmp_path):
    g = graph(spark, [node("a"), node("b"), node("c", repo="/o")], [edge("a", "b", "CONTAINS"), edge("a", "c", "CONTAINS")])
    tables.export_bundle(g, "/r", str(tmp_path))
    back = tables.import_bundle(spark, str(tmp_path))
    assert got(back.nodes, "id") == {"a", "b"} and got(back.links("CONTAINS"), "src", "dst") == {("a", "b")}


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://elsewhere:7077"

            @staticmethod
            def getConf():
                return Elsewhere.conf

    monkeypatch.delenv("CODELOOM_CHECKPOINTS", raising=False)
    with pytest.raises(ValueError):
        checkpoint_dir(Elsewhere)
