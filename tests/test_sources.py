"""Git rows on a repository of a few commits, scans of a folder, the Cypher subset and the tools."""

from __future__ import annotations

import subprocess

import pytest

from codeloom.graph import Graph, Scope
from codeloom.plans.cypher import CypherError, cypher
from codeloom.sources import git, tables
from codeloom.tools import PURPOSES, Tools
from tests.test_graph import edge, got, graph, node


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    folder = tmp_path_factory.mktemp("repo")

    def run(*args):
        subprocess.run(["git", "-C", str(folder), "-c", "user.name=A", "-c", "user.email=a@b.c", *args], check=True, capture_output=True)

    run("init", "-b", "main")
    (folder / "a.py").write_text("one\ntwo\n")
    run("add", "."), run("commit", "-m", "first")
    run("checkout", "-b", "dev")
    (folder / "a.py").write_text("one\n2\nthree\n")
    (folder / "b.py").write_text("def f():\n    pass\n")
    run("add", "."), run("commit", "-m", "second")
    return str(folder)


def test_git(spark, repo):
    assert [r["subject"] for r in git.history(spark, repo, branch="dev").collect()] == ["second", "first"]
    assert git.history(spark, repo, 1, "b.py", "dev").count() == 1
    counts, commits, files = git.branch_compare(spark, repo, "main", "dev")
    assert tuple(counts.first()) == (1, 0) and commits.count() == 1 and got(files, "path", "state") == {("a.py", "changed"), ("b.py", "added")}
    assert [r["line"] for r in git.blame(spark, repo, "a.py", "dev").orderBy("line_number").collect()] == ["one", "2", "three"]
    diff = "--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n@@ -9 +10 @@\n@@ -20,2 +21,0 @@\n"
    assert got(git.changed_lines(spark, diff), "path", "first", "last") == {("x", 1, 3), ("x", 10, 10)}
    assert got(git.explicit_files(spark, ["./a.py", "a.py", "/r/b.py", "../x", "/other/c.py", "d\\e.py"], "/r"), "path") == {"a.py", "b.py", "d/e.py"}
    with pytest.raises(ValueError):
        git.history(spark, repo + "/none")


def test_scan(spark, repo):
    found = tables.scan_tree(spark, repo)
    assert {(r["path"].rsplit("/", 1)[1], r["language"]) for r in found.collect()} == {("a.py", "python"), ("b.py", "python")}


def small(spark):
    return graph(
        spark, [node("f", name="f"), node("g", name="g", path="/r/b.py"), node("h", name="h"), node("call_target:g", "CALL_TARGET", "g", None, None, None, None)],
        [edge("f", "call_target:g", confidence=0.5), edge("f", "g", "SIMILAR_TO"), edge("g", "h", "SIMILAR_TO"), edge("h", "f", "SIMILAR_TO")],
    )


def test_cypher(spark):
    g = small(spark)
    assert got(cypher(g, "MATCH (a)-[:SIMILAR_TO*1..2]->(b {name: 'h'}) RETURN a.id AS a, b.id AS b"), "a", "b") == {("f", "h"), ("g", "h")}
    assert got(cypher(g, "MATCH (a:Function)-[r:SIMILAR_TO*]->(b) WHERE a.name = $n RETURN b.id AS b, length(r) AS n", n="f"), "b", "n") == {("g", 1), ("h", 2), ("f", 3)}
    assert got(cypher(g, "MATCH (a:Function) WHERE NOT (a)-[:CALLS]->() AND a.name <> 'h' RETURN a.name AS n"), "n") == {"g"}
    assert got(cypher(g, "MATCH (a:Function)--(b:CallTarget) RETURN a.name AS n"), "n") == {"f"}
    assert [r["n"] for r in cypher(g, "MATCH (a:Function) RETURN a.name AS n ORDER BY a.name DESC SKIP 1 LIMIT 1").collect()] == ["g"]
    assert cypher(g, "MATCH (a:Function) WHERE a.name IN ['f', 'h'] OR a.path ENDS WITH 'b.py' RETURN count(*) AS n").first()["n"] == 3
    assert got(cypher(g, "MATCH (a:Function) WHERE a.name = $n RETURN a.id AS id", n="f' OR 1=1"), "id") == set()
    for bad in ("MATCH (a)", "MATCH (a) RETURN b.id", "FOO", "MATCH (a) WHERE a.name = $x RETURN a.id", "MATCH (a) RETURN nope(a.id)"):
        with pytest.raises(CypherError):
            cypher(g, bad)


def test_tools(spark, tmp_path):
    t = Tools(small(spark))
    assert got(t.find_code("f"), "id") == {"f"} and got(t.analyze_code_relationships("find_callers", "g"), "id") == {"f"}
    assert got(t.search_logic_flow("f", "g"), "path") == {"f > g"} and got(t.get_impact_graph("g"), "id") == {"f"}
    assert t.recommend_tools("who calls a function, callers").count() > 0 and set(PURPOSES) - {"execute_query"} <= {m for m in dir(Tools)}
    index = t.vector_index_repository(Scope("/r"))
    assert t.vector_index_status(index).first()["n"] == 3 and t.vector_delete_repository(index, "/r").count() == 0
    left = t.delete_repository("/r")
    assert isinstance(left, Graph) and got(left.nodes, "id") == {"call_target:g"}
    t.export_bundle("/r", str(tmp_path))
    assert got(t.load_bundle(str(tmp_path)).nodes, "id") == {"f", "g", "h"}
