"""Queries that aggregate the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.graph import Scope
from codeloom.operators import metrics as op
from codeloom.plans.registry import Workspace, query

HOT = "/srv/checkouts/weighted-digest-service"
SCOPE = Scope(HOT, "main")
IN = f"repository_path = '{HOT}' AND branch = 'main'"
MODULE = "CASE WHEN regexp_extract({0}, '^(.*)/[^/]*$', 1) = '' THEN 'root' ELSE regexp_extract({0}, '^(.*)/[^/]*$', 1) END"
DEG = "i AS (SELECT dst AS id, count(*) AS k FROM c GROUP BY 1), o AS (SELECT src AS id, count(*) AS k FROM c GROUP BY 1)"
STEM = "regexp_extract({0}, '([^/]+?)(?:\\.[^./]+)?$', 1)"


def names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query(
    f"{DEG};; SELECT f.id, name, path, coalesce(o.k, 0) AS callees FROM f LEFT JOIN o ON o.id = f.id WHERE f.id NOT IN (SELECT id FROM i) AND lower(name) NOT IN ({names(op.STARTERS)})"
)
def dead_code(w: Workspace):
    return op.dead_code(w.graph)


@query(
    f"{DEG};; SELECT f.id, name, path, coalesce(o.k, 0) AS callees FROM f LEFT JOIN o ON o.id = f.id WHERE f.id NOT IN (SELECT id FROM i) AND lower(name) NOT IN ({names(op.STARTERS)}) "
    "ORDER BY 4 DESC, path, name, id LIMIT 500"
)
def dead_code_top(w: Workspace):
    return op.dead_code(w.graph, limit=500)


@query(
    f"SELECT id, name, path FROM f WHERE {IN} AND NOT EXISTS (SELECT 1 FROM sites s WHERE s.callee_name = f.name AND s.{IN.replace(' AND branch', ' AND s.branch')}) AND "
    + " AND ".join(f"NOT starts_with(lower(name), '{p}')" for p in op.ENTRY_PREFIXES)
)
def dead_code_scoped(w: Workspace):
    return op.dead_code_scoped(w.graph, SCOPE)


@query("SELECT id, name, repository_path FROM f WHERE name NOT IN (SELECT callee_name FROM sites)")
def dead_code_everywhere(w: Workspace):
    return op.dead_code_everywhere(w.graph)


@query(
    "SELECT id, name, path FROM f WHERE id NOT IN (SELECT dst FROM c) AND (lower(name) IN ('main', 'run', 'start', 'init', 'setup', 'handler', 'index') "
    "OR starts_with(lower(name), 'handle') OR starts_with(lower(name), 'on_') OR starts_with(lower(name), 'run') OR starts_with(lower(name), 'start'))"
)
def entry_points(w: Workspace):
    return op.entry_points(w.graph)


@query(
    f"m AS (SELECT id, name, repository_path, branch, {MODULE.format('path')} AS module FROM f), own AS (SELECT DISTINCT module, name, repository_path, branch FROM m), "
    "st AS (SELECT s.*, m.module AS from_module FROM sites s JOIN m ON m.id = s.src), "
    "fo AS (SELECT st.from_module AS module, count(DISTINCT callee_name) AS k FROM st WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.module = st.from_module AND own.name = st.callee_name "
    "AND own.repository_path = st.repository_path AND own.branch = st.branch) GROUP BY 1), "
    "fi AS (SELECT own.module, count(DISTINCT src) AS k FROM st JOIN own ON own.name = st.callee_name AND own.repository_path = st.repository_path AND own.branch = st.branch "
    "WHERE own.module <> st.from_module GROUP BY 1);; SELECT m.module, count(DISTINCT m.id) AS functions, coalesce(any_value(fi.k), 0) AS fan_in, coalesce(any_value(fo.k), 0) AS fan_out, "
    "coalesce(any_value(fi.k), 0) + coalesce(any_value(fo.k), 0) AS coupling FROM m LEFT JOIN fi ON fi.module = m.module LEFT JOIN fo ON fo.module = m.module GROUP BY 1"
)
def analyze_module(w: Workspace):
    return op.analyze_module(w.graph)


@query(
    "SELECT repository_path, count(*) FILTER (kind = 'FILE') AS files, count(*) FILTER (kind = 'FUNCTION') AS functions, count(*) FILTER (kind = 'METHOD') AS methods, "
    "count(*) FILTER (kind = 'CLASS') AS classes, coalesce(sum(CASE WHEN kind = 'FILE' THEN length(source) - length(replace(source, chr(10), '')) END), 0)::BIGINT AS lines "
    "FROM n WHERE repository_path IS NOT NULL GROUP BY 1"
)
def repository_stats(w: Workspace):
    return op.repository_stats(w.graph)


@query(
    "SELECT count(*) AS nodes, count(*) FILTER (kind = 'FILE') AS files, count(*) FILTER (kind = 'FUNCTION') AS functions, count(*) FILTER (kind = 'CLASS') AS classes, "
    f"count(*) FILTER (kind = 'METHOD') AS methods FROM n WHERE {IN}"
)
def branch_stats(w: Workspace):
    return op.branch_stats(w.graph, SCOPE)


@query("SELECT kind, count(*) AS n FROM n GROUP BY 1")
def count_by_kind(w: Workspace):
    return op.count_by_kind(w.graph)


@query(
    "SELECT repository_path, branch, count(*) AS nodes, count(*) FILTER (kind = 'FILE') AS files, count(*) FILTER (kind = 'FUNCTION') AS functions, "
    "count(*) FILTER (kind = 'CLASS') AS classes, round(avg(cyclomatic_complexity), 6) AS complexity FROM n WHERE repository_path IS NOT NULL GROUP BY ALL"
)
def list_repositories_with_stats(w: Workspace):
    return op.repositories(w.graph)


@query("SELECT id, name, path, repository_path FROM n WHERE kind = 'REPOSITORY'")
def list_repositories(w: Workspace):
    return w.graph.of_kind("REPOSITORY").select("id", "name", "path", "repository_path")


SIMILAR = (
    "p AS (SELECT name, kind, repository_path, count(*) AS copies FROM n WHERE kind IN ('FUNCTION', 'METHOD', 'CLASS') AND repository_path IS NOT NULL GROUP BY ALL);; "
    "SELECT name, kind, count(*) AS repositories, sum(copies)::BIGINT AS copies FROM p {} GROUP BY ALL HAVING count(*) >= {}"
)


@query(SIMILAR.format("", 2))
def find_similar_across_repos(w: Workspace):
    return op.similar_across(w.graph)


@query(SIMILAR.format("WHERE contains(lower(name), 'graph')", 2))
def find_similar_symbols(w: Workspace):
    return op.similar_across(w.graph).where(F.lower("name").contains("graph"))


@query(
    "p AS (SELECT l.dst, n.repository_path, count(*) AS imports FROM (SELECT DISTINCT src, dst FROM e WHERE kind = 'IMPORTS') l JOIN n ON n.id = l.src GROUP BY ALL);; "
    "SELECT substr(dst, 8) AS module, count(*) AS repositories, sum(imports)::BIGINT AS imports FROM p GROUP BY 1 HAVING count(*) >= 2"
)
def find_shared_dependencies(w: Workspace):
    return op.shared_dependencies(w.graph)


@query(
    "SELECT DISTINCT e.src AS id, substr(e.dst, 8) AS module FROM e JOIN n ON n.id = e.src AND n.kind = 'FILE' AND n.source IS NOT NULL WHERE e.kind = 'IMPORTS' "
    "AND (length(n.source) - length(replace(n.source, split_part(substr(e.dst, 8), '.', -1), ''))) / length(split_part(substr(e.dst, 8), '.', -1)) <= 1"
)
def unused_imports(w: Workspace):
    return op.unused_imports(w.graph)


COUPLING = (
    f"q AS (SELECT id, {MODULE.format('path')} AS module, repository_path, {STEM.format('path')} AS stem FROM n WHERE kind = 'FILE'), "
    "im AS (SELECT DISTINCT q.module AS from_module, q.repository_path, split_part(substr(e.dst, 8), '.', -1) AS stem FROM e JOIN q ON q.id = e.src WHERE e.kind = 'IMPORTS'), "
    "pr AS (SELECT DISTINCT im.from_module, q.module FROM im JOIN q ON q.repository_path = im.repository_path AND q.stem = im.stem WHERE q.module <> im.from_module), "
    "cp AS (SELECT module, (SELECT count(*) FROM pr WHERE pr.module = x.module) AS ca, (SELECT count(*) FROM pr WHERE pr.from_module = x.module) AS ce FROM (SELECT DISTINCT module FROM q) x), "
    "cc AS (SELECT *, round(CASE WHEN ca + ce > 0 THEN ce / (ca + ce) ELSE 0.0 END, 6) AS instability FROM cp);; "
)


@query(COUPLING + "SELECT * FROM cc")
def import_coupling(w: Workspace):
    return op.coupling(w.graph)


CALL_COUPLING = (
    f"q AS (SELECT id, name, {MODULE.format('path')} AS module, repository_path FROM f), "
    "im AS (SELECT DISTINCT q.module AS from_module, s.repository_path, s.callee_name AS name FROM sites s JOIN q ON q.id = s.src), "
    "pr AS (SELECT DISTINCT im.from_module, q.module FROM im JOIN q ON q.repository_path = im.repository_path AND q.name = im.name WHERE q.module <> im.from_module), "
    "cp AS (SELECT module, (SELECT count(*) FROM pr WHERE pr.module = x.module) AS ca, (SELECT count(*) FROM pr WHERE pr.from_module = x.module) AS ce FROM (SELECT DISTINCT module FROM q) x), "
    "cc AS (SELECT *, round(CASE WHEN ca + ce > 0 THEN ce / (ca + ce) ELSE 0.0 END, 6) AS instability FROM cp);; "
)


@query(CALL_COUPLING + "SELECT * FROM cc")
def call_coupling(w: Workspace):
    return op.call_coupling(w.graph)


@query(CALL_COUPLING + "SELECT * FROM cc WHERE instability > 0.7 OR (instability < 0.3 AND ca > 0)")
def unstable_modules(w: Workspace):
    return op.unstable(op.call_coupling(w.graph))


@query(CALL_COUPLING + "SELECT count(*) AS modules, round(avg(instability), 6) AS score FROM cc")
def system_coupling(w: Workspace):
    return op.system_coupling(op.call_coupling(w.graph))


LEVELS = "CASE WHEN score >= 0.9 THEN 'functional' WHEN score >= 0.75 THEN 'sequential' WHEN score >= 0.6 THEN 'communicational' WHEN score >= 0.5 THEN 'procedural' WHEN score >= 0.4 THEN 'temporal' WHEN score >= 0.2 THEN 'logical' ELSE 'coincidental' END"


@query(
    "mm AS (SELECT class_id, method_id FROM (SELECT m.id AS method_id, k.id AS class_id, row_number() OVER (PARTITION BY m.id ORDER BY k.line_number DESC, k.id DESC) AS i "
    "FROM n m JOIN n k ON k.path = m.path AND k.kind = 'CLASS' AND k.line_number <= m.line_number WHERE m.kind = 'METHOD') WHERE i = 1), "
    "us AS (SELECT DISTINCT mm.class_id, mm.method_id, s.callee_name AS name FROM mm JOIN sites s ON s.src = mm.method_id), "
    "pa AS (SELECT class_id, count(*) AS pairs FROM (SELECT DISTINCT a.class_id, a.method_id, b.method_id AS other FROM us a JOIN us b ON a.class_id = b.class_id AND a.name = b.name AND a.method_id < b.method_id) GROUP BY 1), "
    "sc AS (SELECT mm.class_id, count(DISTINCT method_id) AS methods, coalesce(any_value(pa.pairs), 0) AS pairs FROM mm LEFT JOIN pa ON pa.class_id = mm.class_id GROUP BY 1), "
    "fs AS (SELECT *, round(CASE WHEN methods > 1 THEN pairs / (methods * (methods - 1) / 2) ELSE 1.0 END, 6) AS score FROM sc);; "
    f"SELECT *, {LEVELS} AS cohesion FROM fs"
)
def class_cohesion(w: Workspace):
    from codeloom.operators.relations import type_members

    uses = w.graph.call_sites.select(F.col("src").alias("method_id"), F.col("callee_name").alias("name"))
    return op.cohesion(type_members(w.graph), uses)


@query(
    f"d AS (SELECT name, count(DISTINCT id) AS definitions, count(DISTINCT {MODULE.format('path')}) AS modules FROM f WHERE name IS NOT NULL GROUP BY 1), "
    "k AS (SELECT callee_name AS name, count(DISTINCT src) AS callers FROM sites GROUP BY 1);; "
    "SELECT coalesce(d.name, k.name) AS name, coalesce(definitions, 0) AS definitions, coalesce(callers, 0) AS callers, coalesce(modules, 0) AS modules FROM d FULL JOIN k ON d.name = k.name"
)
def symbol_index(w: Workspace):
    return op.symbol_index(w.graph)


@query("SELECT id, name, path, coalesce(cyclomatic_complexity, 1) AS complexity FROM n ORDER BY 4 DESC, path NULLS FIRST, name, id LIMIT 50")
def complexity_top(w: Workspace):
    return op.most_complex(w.graph, 50)


@query("SELECT id, name, path, coalesce(cyclomatic_complexity, 1) AS complexity FROM n WHERE kind IN ('FUNCTION', 'METHOD') AND cyclomatic_complexity > 1 ORDER BY 4 DESC, path, name, id LIMIT 20")
def find_most_complex(w: Workspace):
    return op.most_complex(w.graph, 20, ("FUNCTION", "METHOD"), 1)


@query(
    f"s AS (SELECT path, coalesce(cyclomatic_complexity, 1)::DOUBLE AS score FROM f WHERE path IS NOT NULL), u AS (SELECT path AS place, score FROM s UNION ALL SELECT {MODULE.format('path')}, score * 0.8 FROM s);; "
    "SELECT place, round(sum(score), 6) AS score FROM u GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
)
def extract_relevant_paths(w: Workspace):
    scored = w.graph.callables.where(F.col("path").isNotNull()).select("path", F.coalesce("cyclomatic_complexity", F.lit(1)).cast("double").alias("score"))
    return op.hot_paths(scored)


@query(f"SELECT DISTINCT {MODULE.format('path')} AS module, regexp_extract(path, '[^/]+$', 0) AS file FROM n WHERE kind = 'FILE'")
def module_of_path(w: Workspace):
    return w.graph.of_kind("FILE").select(paths.module("path").alias("module"), paths.basename("path").alias("file")).distinct()


@query(
    "SELECT id, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) "
    + " ".join(f"WHEN '{x}' THEN '{k}'" for k, v in paths.EXTENSIONS.items() for x in v.split())
    + " END AS language FROM n WHERE kind = 'FILE'"
)
def language_sniff(w: Workspace):
    return w.graph.of_kind("FILE").select("id", paths.language("path").alias("language"))


@query("SELECT id, concat_ws('::', replace(ltrim(regexp_replace(regexp_replace(path, '\\.[^./]+$', ''), '/(mod|__init__|index)$', ''), '/'), '/', '::'), name) AS qualified FROM f")
def qualified_names(w: Workspace):
    return w.graph.callables.select("id", paths.qualified("path", "name").alias("qualified"))
