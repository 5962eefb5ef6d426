"""Queries in Cypher, checked by SQL."""

from __future__ import annotations

from codeloom.plans.cypher import cypher
from codeloom.plans.registry import Workspace, query

HOT = "/srv/checkouts/weighted-digest-service"


@query(f"SELECT id, name FROM n WHERE kind = 'FUNCTION' AND repository_path = '{HOT}' AND (contains(name, 'graph') OR starts_with(name, 'build')) ORDER BY name, id LIMIT 20")
def cypher_match(w: Workspace):
    return cypher(w.graph, "MATCH (f:Function {repository_path: $repo}) WHERE f.name CONTAINS 'graph' OR f.name STARTS WITH 'build' RETURN f.id AS id, f.name AS name ORDER BY f.name, f.id LIMIT 20", repo=HOT)


@query("SELECT t.name AS callee, count(*) AS calls, count(DISTINCT s.path) AS files FROM e JOIN n s ON s.id = e.src JOIN n t ON t.id = e.dst WHERE e.kind = 'CALLS' AND s.kind = 'METHOD' GROUP BY 1 HAVING count(*) > 2")
def cypher_aggregate(w: Workspace):
    return cypher(
        w.graph, "MATCH (m:Method)-[r:CALLS]->(t:CallTarget) WITH t.name AS callee, count(*) AS calls, count(DISTINCT m.path) AS files WHERE calls > 2 RETURN callee, calls, files"
    )


@query("SELECT f.id AS id, c.name AS file FROM f JOIN (SELECT e.dst, n.name FROM e JOIN n ON n.id = e.src AND n.kind = 'FILE' WHERE e.kind = 'CONTAINS' GROUP BY ALL) c ON c.dst = f.id WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = f.id AND e.kind = 'CALLS') AND f.kind = 'FUNCTION'")
def cypher_anti_pattern(w: Workspace):
    return cypher(w.graph, "MATCH (d:File)-[:CONTAINS]->(f:Function) WHERE NOT (f)-[:CALLS]->() RETURN DISTINCT f.id AS id, d.name AS file")


@query(
    "SELECT n.id AS id, count(DISTINCT e.dst) AS similar FROM n LEFT JOIN e ON e.src = n.id AND e.kind = 'SIMILAR_TO' WHERE n.kind IN ('METHOD', 'FUNCTION') AND contains(n.name, 'scope') GROUP BY 1"
)
def cypher_optional(w: Workspace):
    return cypher(w.graph, "MATCH (n:Method|Function) WHERE n.name CONTAINS 'scope' OPTIONAL MATCH (n)-[:SIMILAR_TO]->(o) RETURN n.id AS id, count(DISTINCT o.id) AS similar")


@query(
    "r AS (SELECT src AS root, dst AS id, 1 AS depth FROM e WHERE kind IN ('CONTAINS', 'CALLS') UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id AND e.kind IN ('CONTAINS', 'CALLS') WHERE r.depth < 3);; "
    f"SELECT f.path AS path, t.name AS name, min(r.depth) AS steps FROM r JOIN n f ON f.id = r.root AND f.kind = 'FILE' AND f.repository_path = '{HOT}' JOIN n t ON t.id = r.id AND t.kind = 'CALL_TARGET' GROUP BY ALL",
    recursive=True,
)
def cypher_variable_length(w: Workspace):
    return cypher(w.graph, "MATCH (f:File {repository_path: $repo})-[p:CONTAINS|CALLS*1..3]->(t:CallTarget) RETURN DISTINCT f.path AS path, t.name AS name, length(p) AS steps", repo=HOT)


@query("SELECT id, CASE WHEN coalesce(cyclomatic_complexity, 1) > 5 THEN 'high' ELSE 'low' END AS level FROM n WHERE name IN ('unwrap', 'build_symbol', 'collect_branch')")
def cypher_unwind_case(w: Workspace):
    return cypher(
        w.graph, "UNWIND $names AS wanted MATCH (n) WHERE n.name = wanted RETURN n.id AS id, CASE WHEN coalesce(n.cyclomatic_complexity, 1) > 5 THEN 'high' ELSE 'low' END AS level",
        names=["unwrap", "build_symbol", "collect_branch"],
    )


@query("SELECT a.id AS caller, b.name AS target, e.confidence AS confidence FROM e JOIN n b ON b.id = e.dst JOIN n a ON a.id = e.src WHERE e.kind = 'CALLS' AND e.confidence >= 0.9 AND regexp_full_match(b.name, 'un.*') AND a.docstring IS NULL")
def cypher_edge_properties(w: Workspace):
    return cypher(w.graph, "MATCH (b)<-[r:CALLS]-(a) WHERE r.confidence >= 0.9 AND b.name =~ 'un.*' AND a.docstring IS NULL RETURN a.id AS caller, b.name AS target, r.confidence AS confidence")
