"""Queries along edges: joins, traversals, definitions, diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.graph import Scope
from codeloom.operators import relations as op, traversal as tr
from codeloom.plans.registry import Workspace, query

HOT, OTHER = "/srv/checkouts/weighted-digest-service", "/srv/checkouts/atlas-monorepo"
SCOPE = Scope(HOT, "main")
IN = f"repository_path = '{HOT}' AND branch = 'main'"
NAME = "build_symbol"
REACH = "reach AS (SELECT {root} AS root, {id} AS id, 1 AS depth FROM c {seed} UNION SELECT r.root, c.{id}, r.depth + 1 FROM reach r JOIN c ON c.{on} = r.id WHERE r.depth < {depth});; "


def hot_roots(w: Workspace):
    return w.graph.callables.where(F.col("repository_path") == HOT).select(F.col("id").alias("root"))


@query(f"SELECT id, name, path, line_number FROM n WHERE id IN (SELECT src FROM sites WHERE callee_name = '{NAME}')")
def callers(w: Workspace):
    return op.callers(w.graph, NAME)


@query(f"SELECT id, name, path, line_number FROM n WHERE id IN (SELECT src FROM sites WHERE callee_name = 'unwrap' AND {IN})")
def callers_scoped(w: Workspace):
    return op.callers(w.graph, "unwrap", SCOPE)


@query(
    "SELECT s.callee_name, count(DISTINCT t.id) AS resolved FROM sites s LEFT JOIN f t ON t.name = s.callee_name AND t.repository_path = s.repository_path "
    "AND t.branch = s.branch WHERE s.src IN (SELECT id FROM f WHERE name = 'collect_branch') GROUP BY 1"
)
def callees(w: Workspace):
    return op.callees(w.graph, "collect_branch")


NEIGHBOUR = "SELECT c.{near} AS id, c.{far} AS other, b.name AS other_name, b.path AS other_path FROM c JOIN f a ON c.{near} = a.id JOIN f b ON c.{far} = b.id"


@query(NEIGHBOUR.format(near="dst", far="src"))
def callers_of_all(w: Workspace):
    return op.neighbours(w.graph, True)


@query(NEIGHBOUR.format(near="src", far="dst"))
def callees_of_all(w: Workspace):
    return op.neighbours(w.graph, False)


@query(NEIGHBOUR.format(near="dst", far="src") + f" WHERE a.repository_path = '{HOT}' AND a.branch = 'main' AND b.repository_path = '{HOT}' AND b.branch = 'main'")
def scoped_callers_by_id(w: Workspace):
    return op.neighbours(w.graph, True, SCOPE)


@query(NEIGHBOUR.format(near="src", far="dst") + f" WHERE a.repository_path = '{HOT}' AND a.branch = 'main' AND b.repository_path = '{HOT}' AND b.branch = 'main'")
def scoped_callees_by_id(w: Workspace):
    return op.neighbours(w.graph, False, SCOPE)


ALL = "SELECT root, id, min(depth) AS depth FROM reach GROUP BY ALL"


@query(REACH.format(root="dst", id="src", on="dst", depth=10, seed="") + ALL, recursive=True)
def who_calls(w: Workspace):
    return tr.closure(tr.reverse(w.graph.calls), w.graph.calls.select(F.col("dst").alias("root")), 10)


@query(REACH.format(root="src", id="dst", on="src", depth=10, seed="") + ALL, recursive=True)
def what_calls(w: Workspace):
    return tr.closure(w.graph.calls, w.graph.calls.select(F.col("src").alias("root")), 10)


@query(REACH.format(root="dst", id="src", on="dst", depth=20, seed=f"WHERE dst IN (SELECT id FROM f WHERE name = '{NAME}')") + ALL, recursive=True)
def all_callers(w: Workspace):
    return op.all_callers(w.graph, NAME)


@query(REACH.format(root="src", id="dst", on="src", depth=20, seed=f"WHERE src IN (SELECT id FROM f WHERE {IN} AND name LIKE 'build%')") + ALL, recursive=True)
def all_callees(w: Workspace):
    roots = w.graph.callables.where(SCOPE.of() & F.col("name").startswith("build")).select(F.col("id").alias("root"))
    return tr.closure(w.graph.calls, roots, 20)


PATHS = (
    "p AS (SELECT src AS root, dst AS id, 1 AS depth, [src, dst] AS nodes FROM c WHERE {seed} UNION ALL "
    "SELECT p.root, c.dst, p.depth + 1, list_append(p.nodes, c.dst) FROM p JOIN c ON c.src = p.id WHERE p.depth < {depth} AND NOT list_contains(p.nodes, c.dst));; "
)
SHORTEST = (
    "SELECT root, id, depth, path FROM (SELECT root, id, depth, min(array_to_string(nodes, ' > ')) AS path, min(depth) OVER (PARTITION BY root, id) AS least "
    "FROM p WHERE root <> id GROUP BY root, id, depth) WHERE depth = least"
)
HOT_IDS = f"src IN (SELECT id FROM f WHERE repository_path = '{HOT}')"


@query(PATHS.format(seed=HOT_IDS, depth=6) + SHORTEST, recursive=True)
def call_chains(w: Workspace):
    return tr.shortest_paths(w.graph.calls, hot_roots(w), 6)


@query(PATHS.format(seed="src IN (SELECT id FROM f WHERE name = 'collect_branch')", depth=6) + SHORTEST + f" AND id IN (SELECT id FROM f WHERE name = '{NAME}')", recursive=True)
def call_chain(w: Workspace):
    return op.call_chain(w.graph, "collect_branch", NAME, 6)


@query(PATHS.format(seed=HOT_IDS, depth=4) + "SELECT root, id, depth, array_to_string(nodes, ' > ') AS path FROM p WHERE root <> id", recursive=True)
def simple_paths(w: Workspace):
    p = tr.simple_paths(w.graph.calls, hot_roots(w), 4)
    return p.select("root", "id", "depth", F.array_join("nodes", tr.ARROW).alias("path"))


@query(
    "h AS (SELECT src AS root, src AS id, 0 AS depth FROM e WHERE kind = 'SIMILAR_TO' UNION SELECT h.root, e.dst, h.depth + 1 FROM h JOIN e ON e.src = h.id "
    "AND e.kind = 'SIMILAR_TO' WHERE h.depth < 10);; SELECT root, id, min(depth) AS depth FROM h GROUP BY ALL",
    recursive=True,
)
def chain_closure(w: Workspace):
    """The hierarchy walk over the only edges of these tables that chain nodes of one kind."""
    edges = w.graph.links("SIMILAR_TO")
    return tr.closure(edges, edges.select(F.col("src").alias("root")), 10, itself=True)


HIERARCHY = (
    "h AS (SELECT id AS root, id, 0 AS depth FROM n WHERE kind = 'CLASS' UNION SELECT h.root, e.{to}, h.depth + 1 FROM h JOIN e ON e.{at} = h.id "
    "AND e.kind IN ('INHERITS', 'IMPLEMENTS') WHERE h.depth < 10);; SELECT root, id, min(depth) AS depth FROM h GROUP BY ALL"
)


@query(HIERARCHY.format(to="dst", at="src"), recursive=True)
def class_ancestors(w: Workspace):
    return op.hierarchy(w.graph, w.graph.of_kind("CLASS").select(F.col("id").alias("root")))


@query(HIERARCHY.format(to="src", at="dst"), recursive=True)
def class_descendants(w: Workspace):
    return op.hierarchy(w.graph, w.graph.of_kind("CLASS").select(F.col("id").alias("root")), up=False)


@query(f"SELECT DISTINCT e.src AS id, e.dst AS owner, o.name AS owner_name FROM e JOIN f ON e.src = f.id AND f.name = '{NAME}' JOIN n o ON e.dst = o.id WHERE e.kind IN ('DEFINED_IN', 'MEMBER_OF')")
def overrides(w: Workspace):
    return op.overrides(w.graph, NAME)


@query("SELECT DISTINCT e.dst AS id, e.src AS owner, o.path AS owner_path FROM e JOIN f ON e.dst = f.id AND f.name = 'collect_branch' JOIN n o ON e.src = o.id WHERE e.kind = 'CONTAINS'")
def owners(w: Workspace):
    return op.owners(w.graph, "collect_branch")


@query("SELECT DISTINCT e.src AS id, n.path, substr(e.dst, 8) AS module FROM e JOIN n ON e.src = n.id WHERE e.kind = 'IMPORTS' AND (e.dst = 'module:ledger' OR starts_with(e.dst, 'module:ledger::'))")
def find_importers(w: Workspace):
    return op.importers(w.graph, "ledger")


@query("SELECT DISTINCT e.src AS id, n.path, substr(e.dst, 8) AS module FROM e JOIN n ON e.src = n.id WHERE e.kind = 'IMPORTS' AND (e.dst = 'module:graph' OR starts_with(e.dst, 'module:graph::'))")
def module_dependencies(w: Workspace):
    return op.importers(w.graph, "graph")


@query(
    f"g AS (SELECT DISTINCT src, dst FROM e WHERE kind IN ('IMPORTS', 'CONTAINS')), p AS (SELECT id AS root, id, 0 AS depth, id AS path FROM n WHERE kind = 'FILE' AND repository_path = '{HOT}' "
    "UNION ALL SELECT p.root, g.dst, p.depth + 1, p.path || ' > ' || g.dst FROM p JOIN g ON g.src = p.id WHERE p.depth < 5);; SELECT root, id, depth, path FROM p WHERE depth > 0",
    recursive=True,
)
def dependency_graph(w: Workspace):
    files = w.graph.of_kind("FILE").where(F.col("repository_path") == HOT).select(F.col("id").alias("root"))
    return op.dependency_paths(w.graph, files)


@query("SELECT DISTINCT n.id, e.src AS holder, e.kind AS edge_kind FROM n LEFT JOIN e ON e.dst = n.id WHERE n.kind IN ('CLASS', 'VARIABLE', 'CONSTANT')")
def variable_scope(w: Workspace):
    return op.variable_scope(w.graph, ("CLASS", "VARIABLE", "CONSTANT"))


@query(
    "g AS (SELECT src, dst FROM c UNION SELECT src, dst FROM e WHERE kind IN ('INHERITS', 'IMPLEMENTS', 'IMPORTS')), "
    f"r AS (SELECT src AS root, dst AS id, 1 AS depth FROM g WHERE {HOT_IDS} UNION SELECT r.root, g.dst, r.depth + 1 FROM r JOIN g ON g.src = r.id WHERE r.depth < 5);; "
    "SELECT root, id, min(depth) AS depth FROM r GROUP BY ALL",
    recursive=True,
)
def find_impact_graph(w: Workspace):
    return op.impact_paths(w.graph, hot_roots(w), 5)


IMPACT = (
    REACH.format(root="dst", id="src", on="dst", depth=3, seed="").rstrip(";; ") + ", "
    "near AS (SELECT root, id, min(depth) AS depth FROM reach GROUP BY ALL), "
    "conf AS (SELECT src, callee_name, max(confidence) AS confidence FROM e WHERE kind = 'CALLS' GROUP BY ALL), "
    "byc AS (SELECT near.root, near.id, CASE WHEN depth = 1 THEN 1 ELSE 2 END AS priority, depth, CASE WHEN depth = 1 THEN coalesce(conf.confidence, 1.0) "
    "ELSE pow(0.9, depth - 1) END AS confidence FROM near JOIN n ON n.id = near.root LEFT JOIN conf ON conf.src = near.id AND conf.callee_name = n.name), "
    "home AS (SELECT DISTINCT e.dst AS root, regexp_extract(x.path, '([^/]+?)(?:\\.[^./]+)?$', 1) AS module FROM e JOIN n x ON x.id = e.src AND x.kind = 'FILE' WHERE e.kind = 'CONTAINS' AND e.dst IN (SELECT dst FROM c)), "
    "byi AS (SELECT DISTINCT home.root, e.src AS id, 3 AS priority, 1 AS depth, 0.8 AS confidence FROM home JOIN e ON e.kind = 'IMPORTS' AND substr(e.dst, 8) = home.module), "
    "u AS (SELECT * FROM byc UNION ALL SELECT * FROM byi), "
    "impact AS (SELECT root, id, CASE priority WHEN 1 THEN 'direct_caller' WHEN 2 THEN 'transitive_caller' ELSE 'importer' END AS relation, depth, round(confidence, 6) AS confidence "
    "FROM (SELECT *, row_number() OVER (PARTITION BY root, id ORDER BY priority, depth, confidence DESC) AS i FROM u) WHERE i = 1);; "
)


def impact(w: Workspace):
    return op.impact_graph(w.graph, w.graph.calls.select(F.col("dst").alias("root")))


@query(IMPACT + "SELECT * FROM impact", recursive=True)
def impact_graph(w: Workspace):
    return impact(w)


@query(
    IMPACT + "SELECT root, count(*) AS affected, count(*) FILTER (relation = 'direct_caller') AS direct, count(*) FILTER (relation = 'transitive_caller') AS transitive, "
    "count(*) FILTER (relation = 'importer') AS importers, CASE WHEN count(*) > 20 THEN 'high' WHEN count(*) > 5 THEN 'medium' ELSE 'low' END AS radius FROM impact GROUP BY 1",
    recursive=True,
)
def impact_summary(w: Workspace):
    return op.blast_radius(impact(w))


@query(
    IMPACT + "SELECT root, id, relation, depth, confidence FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY "
    "CASE relation WHEN 'direct_caller' THEN 1 WHEN 'transitive_caller' THEN 2 ELSE 3 END, depth, id) AS i FROM impact) WHERE i <= 3",
    recursive=True,
)
def impact_budget(w: Workspace):
    return op.impact_graph(w.graph, w.graph.calls.select(F.col("dst").alias("root")), most=3)


@query("SELECT id, kind, name, path, line_number FROM n WHERE id IN (SELECT dst FROM c)")
def fetch_by_ids(w: Workspace):
    return op.fetch(w.graph, w.graph.calls.select(F.col("dst").alias("id")))


@query(
    "conf AS (SELECT src, callee_name, max(coalesce(confidence, 1.0)) AS confidence FROM e WHERE kind = 'CALLS' GROUP BY ALL), "
    "wt AS (SELECT c.src, c.dst, coalesce(conf.confidence, 1.0) AS confidence FROM c JOIN f ON f.id = c.dst LEFT JOIN conf ON conf.src = c.src AND conf.callee_name = f.name), "
    f"p AS (SELECT src AS root, dst AS id, 1 AS length, [src, dst] AS nodes, confidence AS total FROM wt WHERE {HOT_IDS} UNION ALL SELECT p.root, wt.dst, p.length + 1, "
    "list_append(p.nodes, wt.dst), p.total + wt.confidence FROM p JOIN wt ON wt.src = p.id WHERE p.length < 4 AND NOT list_contains(p.nodes, wt.dst));; "
    "SELECT root, id, length, array_to_string(nodes, ' > ') AS path, round(0.4 / (1 + length) + 0.4 * total / length + 0.1, 6) AS score FROM p WHERE root <> id",
    recursive=True,
)
def search_logic_flow(w: Workspace):
    targets = w.graph.callables.select("id")
    return op.logic_flow(w.graph, hot_roots(w), targets, 4)


@query(
    "SELECT id, reason FROM (SELECT f.id, CASE WHEN f.id NOT IN (SELECT src FROM c) AND f.id NOT IN (SELECT dst FROM c) THEN 'isolated' "
    "WHEN f.id NOT IN (SELECT src FROM c) THEN 'no_callees' WHEN f.id NOT IN (SELECT dst FROM c) THEN 'no_callers' END AS reason FROM f) WHERE reason IS NOT NULL"
)
def flow_blockers(w: Workspace):
    return op.blockers(w.graph)


DEFS = (
    "mods AS (SELECT x.path, list(DISTINCT substr(e.dst, 8)) AS modules FROM e JOIN n x ON x.id = e.src AND x.kind = 'FILE' WHERE e.kind = 'IMPORTS' GROUP BY 1), "
    "st AS (SELECT DISTINCT s.src, s.callee_name AS name, t.id, CASE WHEN t.path = a.path THEN 1 "
    "WHEN coalesce(len(list_filter(mods.modules, lambda m: contains(t.path, m))) > 0, false) AND t.repository_path = a.repository_path THEN 2 "
    "WHEN regexp_replace(t.path, '/[^/]*$', '') = regexp_replace(a.path, '/[^/]*$', '') THEN 3 WHEN t.repository_path = a.repository_path THEN 4 ELSE 5 END AS stage "
    "FROM sites s JOIN n a ON a.id = s.src JOIN n t ON t.name = s.callee_name AND t.kind IN ('FUNCTION', 'METHOD', 'CLASS') LEFT JOIN mods ON mods.path = a.path);; "
)


@query(DEFS + "SELECT src, name, id, stage FROM (SELECT *, min(stage) OVER (PARTITION BY src, name) AS least FROM st) WHERE stage = least")
def go_to_definition(w: Workspace):
    return op.definitions(w.graph, w.graph.call_sites.select("src", F.col("callee_name").alias("name")))


@query("SELECT id, kind, path, line_number FROM n WHERE kind IN ('FUNCTION', 'METHOD', 'CLASS') AND name = 'collect_branch'")
def resolve_exact(w: Workspace):
    return op.exact_definitions(w.graph, "collect_branch")


@query("SELECT id, kind, name, path FROM n WHERE kind IN ('FUNCTION', 'METHOD', 'CLASS') AND contains(lower(name), 'branch')")
def resolve_fuzzy(w: Workspace):
    return op.fuzzy_definitions(w.graph, "Branch")


@query("SELECT id, 'exact' AS strategy FROM n WHERE kind IN ('FUNCTION', 'METHOD', 'CLASS') AND name = 'collect_branch'")
def resolve_definitions(w: Workspace):
    return op.resolve_definitions(w.graph, "collect_branch")


@query("SELECT name, levenshtein(name, 'colect_brnch') AS distance FROM (SELECT DISTINCT name FROM n WHERE kind IN ('FUNCTION', 'METHOD', 'CLASS') AND name IS NOT NULL) ORDER BY 2, 1 LIMIT 10")
def suggest_names(w: Workspace):
    return op.suggest_names(w.graph, "colect_brnch")


@query("SELECT DISTINCT a.id, b.id AS other FROM f a JOIN f b ON regexp_replace(a.path, '/[^/]*$', '') = regexp_replace(b.path, '/[^/]*$', '') AND a.id <> b.id WHERE a.name = 'collect_branch'")
def find_in_same_module(w: Workspace):
    from codeloom.functions import paths

    f = w.graph.callables.select("id", "name", paths.module("path").alias("module"))
    other = f.select(F.col("id").alias("other"), "module")
    return f.where(F.col("name") == "collect_branch").join(other, "module").where(F.col("id") != F.col("other")).select("id", "other")


@query("SELECT id, path FROM f WHERE qualified_name = (SELECT min(qualified_name) FROM f WHERE name = 'collect_branch')")
def find_by_qualified_name(w: Workspace):
    f = w.graph.callables
    first = f.where(F.col("name") == "collect_branch").agg(F.min("qualified_name").alias("qualified_name"))
    return f.join(F.broadcast(first), "qualified_name", "left_semi").select("id", "path")


@query(
    "SELECT DISTINCT coalesce(e.callee_name, e.dst) AS target, e.src AS user, n.path, e.line_number, CASE e.kind WHEN 'CALLS' THEN 'call' ELSE 'import' END AS usage "
    "FROM e JOIN n ON n.id = e.src WHERE e.kind IN ('CALLS', 'IMPORTS', 'TYPE_REFERENCE', 'FIELD_ACCESS', 'INHERITS', 'IMPLEMENTS')"
)
def find_all_usages(w: Workspace):
    return op.usages(w.graph)


@query("SELECT DISTINCT coalesce(e.callee_name, e.dst) AS target, e.src AS user, n.path, e.line_number, 'import' AS usage FROM e JOIN n ON n.id = e.src WHERE e.kind = 'IMPORTS'")
def usages_of_kind(w: Workspace):
    return op.usages(w.graph, ("IMPORTS",))


@query(
    "SELECT n.id, n.name, n.kind, (SELECT count(*) FROM c WHERE c.dst = n.id) AS callers, (SELECT count(*) FROM c WHERE c.src = n.id) AS callees, "
    "(SELECT count(*) FROM (SELECT DISTINCT src, dst FROM e WHERE kind IN ('CONTAINS', 'SIMILAR_TO')) h WHERE h.dst = n.id) AS uses FROM n WHERE kind IN ('FUNCTION', 'METHOD', 'CLASS')"
)
def quick_info(w: Workspace):
    return op.quick_info(w.graph)


SYMBOLS = "SELECT DISTINCT repository_path, name, kind FROM n WHERE kind IN ('FUNCTION', 'METHOD', 'CLASS') AND repository_path IS NOT NULL AND branch = '{}'"


@query(SYMBOLS.format("main") + " EXCEPT " + SYMBOLS.format("develop"))
def branch_only_symbols(w: Workspace):
    return op.branch_only(w.graph, "main", "develop")


MODIFIED = "SELECT name, kind, arg_min(md5(source), id) AS body, arg_min(trim(split_part(replace(source, chr(13), ''), chr(10), 1)), id) AS head FROM f WHERE source IS NOT NULL AND branch = '{}' GROUP BY ALL"


@query(
    f"a AS ({MODIFIED.format('main')}), b AS ({MODIFIED.format('develop')});; SELECT a.name, a.kind, CASE WHEN a.head <> b.head THEN 'signature' ELSE 'body' END AS change "
    "FROM a JOIN b ON a.name = b.name AND a.kind = b.kind WHERE a.body <> b.body"
)
def modified_symbols(w: Workspace):
    return op.modified(w.graph, F.col("branch") == "main", F.col("branch") == "develop")


@query(f"SELECT c.src AS id, c.dst AS changed FROM c WHERE c.dst IN (SELECT id FROM f WHERE {IN})")
def affected_by_change(w: Workspace):
    return op.affected_by(w.graph, w.graph.callables.where(SCOPE.of()))


@query(
    "s AS (SELECT repository_path, name, kind, bool_or(branch = 'main') AS a, bool_or(branch = 'develop') AS b FROM n WHERE kind IN ('FUNCTION', 'METHOD', 'CLASS') "
    "AND branch IN ('main', 'develop') AND repository_path IS NOT NULL GROUP BY ALL);; SELECT repository_path, count(*) FILTER (NOT a AND b) AS added, "
    "count(*) FILTER (a AND NOT b) AS removed, count(*) FILTER (a AND b) AS common FROM s GROUP BY 1"
)
def branch_structural_diff(w: Workspace):
    return op.structural_diff(w.graph, "main", "develop")


@query("SELECT src, dst FROM c WHERE dst IN (SELECT id FROM f)")
def resolve_call_targets(w: Workspace):
    return op.resolve(w.graph, "CALLS", ("FUNCTION", "METHOD"))


@query("SELECT DISTINCT s.src, t.id AS dst FROM sites s JOIN n t ON t.name = s.callee_name AND t.repository_path = s.repository_path AND t.branch = s.branch AND t.kind IN ('CLASS', 'STRUCT', 'ENUM')")
def resolve_type_references(w: Workspace):
    """Type resolution, over call edges here, since these tables hold no type references."""
    return op.resolve(w.graph, "CALLS", ("CLASS", "STRUCT", "ENUM"))


@query("SELECT src, dst FROM e WHERE kind = 'FIELD_ACCESS'")
def resolve_field_accesses(w: Workspace):
    return op.resolve(w.graph, "FIELD_ACCESS", ("FIELD", "PROPERTY", "VARIABLE", "CONSTANT"))


@query("SELECT src, callee_name FROM sites s WHERE NOT EXISTS (SELECT 1 FROM f t WHERE t.name = s.callee_name AND t.repository_path = s.repository_path AND t.branch = s.branch)")
def unresolved_calls(w: Workspace):
    return op.unresolved(w.graph)


@query("SELECT DISTINCT 'call_target:' || callee_name AS id, callee_name AS name FROM e WHERE kind = 'CALLS' AND callee_name IS NOT NULL")
def upsert_placeholders(w: Workspace):
    return op.placeholders(w.graph)


@query("SELECT id FROM n WHERE kind = 'CALL_TARGET' AND id NOT IN (SELECT dst FROM e)")
def orphan_placeholders(w: Workspace):
    return op.orphans(w.graph)


@query("SELECT DISTINCT src, dst, kind FROM e WHERE dst NOT IN (SELECT id FROM n) OR src NOT IN (SELECT id FROM n)")
def dangling_edges(w: Workspace):
    return op.dangling(w.graph)


@query(
    "SELECT class_id, method_id FROM (SELECT m.id AS method_id, k.id AS class_id, row_number() OVER (PARTITION BY m.id ORDER BY k.line_number DESC, k.id DESC) AS i "
    "FROM n m JOIN n k ON k.path = m.path AND k.kind = 'CLASS' AND k.line_number <= m.line_number WHERE m.kind = 'METHOD') WHERE i = 1"
)
def member_of(w: Workspace):
    return op.type_members(w.graph)


@query(
    "s AS (SELECT DISTINCT repository_path, name FROM f WHERE repository_path IS NOT NULL);; SELECT a.repository_path AS repo_a, b.repository_path AS repo_b, count(*) AS shared "
    "FROM s a JOIN s b ON a.name = b.name AND a.repository_path < b.repository_path GROUP BY ALL"
)
def compare_repositories(w: Workspace):
    return op.compare_repositories(w.graph)


@query(
    f"s AS (SELECT name, bool_or(repository_path = '{HOT}') AS a, bool_or(repository_path = '{OTHER}') AS b FROM f WHERE coalesce(visibility, 'public') = 'public' "
    f"AND repository_path IN ('{HOT}', '{OTHER}') GROUP BY 1), t AS (SELECT count(*) FILTER (a AND b) AS shared, count(*) FILTER (a AND NOT b) AS only_one, "
    "count(*) FILTER (NOT a AND b) AS only_other FROM s);; SELECT *, round(CASE WHEN shared + only_one + only_other > 0 THEN 2.0 * shared / (2 * shared + only_one + only_other) ELSE 0.0 END, 6) AS similarity FROM t"
)
def compare_api_surface(w: Workspace):
    return op.api_surface(w.graph, HOT, OTHER)


@query(
    "SELECT src, dst, max(confidence) AS confidence, nullif(max((coalesce(confidence, -1.0), coalesce(provenance, '')))[2], '') AS provenance FROM e WHERE kind = 'CALLS' GROUP BY ALL"
)
def merge_lsp_edges(w: Workspace):
    calls = w.graph.edges.where(F.col("kind") == "CALLS")
    lsp = F.coalesce(F.col("provenance") == "lsp", F.lit(False))
    return op.merge_lsp(calls.where(~lsp), calls.where(lsp))


@query(
    "b AS (SELECT src AS id, dst AS other FROM e WHERE kind = 'SIMILAR_TO' UNION SELECT dst, src FROM e WHERE kind = 'SIMILAR_TO');; "
    "SELECT id, array_to_string(list_sort(list(DISTINCT other)), ',') AS linked_to FROM b WHERE id <> other GROUP BY 1"
)
def link_observations(w: Workspace):
    return op.linked(w.graph.links("SIMILAR_TO"))


@query(
    "b AS (SELECT src AS id, dst AS other FROM e WHERE kind = 'SIMILAR_TO' UNION SELECT dst, src FROM e WHERE kind = 'SIMILAR_TO');; "
    "SELECT b.id, b.other, n.name FROM b JOIN n ON n.id = b.other"
)
def related_observations(w: Workspace):
    return op.related(w.graph.links("SIMILAR_TO"), w.graph.nodes)


@query(
    "one AS (SELECT DISTINCT dst AS id, src AS caller FROM c), two AS (SELECT DISTINCT a.id, b.caller FROM one a JOIN one b ON a.caller = b.id), "
    "three AS (SELECT DISTINCT a.id, b.caller FROM two a JOIN one b ON a.caller = b.id), near AS (SELECT id, caller, min(depth) AS depth FROM "
    "(SELECT *, 1 AS depth FROM one UNION ALL SELECT *, 2 FROM two UNION ALL SELECT *, 3 FROM three) GROUP BY ALL), d AS (SELECT dst AS id, count(*) AS d1_count FROM c GROUP BY 1);; "
    "SELECT near.id, any_value(d.d1_count) AS d1_count, count(*) FILTER (depth <= 2) AS d2_count, count(*) AS d3_count, "
    "array_to_string(list(caller ORDER BY depth, caller)[1:64], ',') AS ids, count(*) > 64 AS truncated FROM near JOIN d ON d.id = near.id GROUP BY near.id"
)
def reach_index(w: Workspace):
    return tr.reach_index(w.graph.calls)


@query(
    "cyc AS (SELECT src AS root, dst AS id, [src, dst] AS nodes, 2 AS length FROM c WHERE src < dst UNION ALL SELECT cyc.root, c.dst, list_append(nodes, c.dst), length + 1 FROM cyc JOIN c ON c.src = cyc.id "
    "WHERE length < 5 AND c.dst > cyc.root AND NOT list_contains(nodes, c.dst));; SELECT DISTINCT array_to_string(list_sort(nodes), ' > ') AS members, length FROM cyc "
    "WHERE EXISTS (SELECT 1 FROM c WHERE c.src = cyc.id AND c.dst = cyc.root) UNION SELECT src, 1 FROM c WHERE src = dst",
    recursive=True,
)
def circular_dependencies(w: Workspace):
    return tr.cycles(w.graph.calls, 5)


def _pagerank_sql(iterations: int) -> str:
    """The same ranks as unrolled steps."""
    steps = ["g AS (SELECT DISTINCT c.src, c.dst FROM c JOIN f a ON a.id = c.src JOIN f b ON b.id = c.dst)", "deg AS (SELECT src, count(*) AS d FROM g GROUP BY 1)",
             "m AS (SELECT count(*)::DOUBLE AS n FROM f)", "r0 AS MATERIALIZED (SELECT f.id, 1.0 / m.n AS score, deg.d FROM f CROSS JOIN m LEFT JOIN deg ON deg.src = f.id)"]
    for i in range(iterations):
        steps.append(
            f"r{i + 1} AS MATERIALIZED (SELECT r.id, 0.15 / m.n + 0.85 * l.loose / m.n + 0.85 * coalesce(x.got, 0) AS score, r.d FROM r{i} r CROSS JOIN m "
            f"CROSS JOIN (SELECT coalesce(sum(score), 0) AS loose FROM r{i} WHERE d IS NULL) l LEFT JOIN (SELECT g.dst, sum(q.score / q.d) AS got FROM g JOIN r{i} q ON q.id = g.src GROUP BY 1) x ON x.dst = r.id)"
        )
    return ", ".join(steps) + f";; SELECT id, round(score, 8) AS score FROM r{iterations}"


@query(_pagerank_sql(20))
def pagerank(w: Workspace):
    return tr.pagerank(w.graph.calls, w.graph.callables).select("id", F.round("score", 8).alias("score"))


@query(_pagerank_sql(20).rpartition(";;")[0] + ";; SELECT id, round(score, 8) AS score FROM r20 ORDER BY round(score, 8) DESC, id LIMIT 20")
def top_nodes(w: Workspace):
    ranks = tr.pagerank(w.graph.calls, w.graph.callables).select("id", F.round("score", 8).alias("score"))
    return ranks.orderBy(F.desc("score"), "id").limit(20)


@query(
    "i AS (SELECT dst AS id, count(*) AS k FROM c GROUP BY 1), o AS (SELECT src AS id, count(*) AS k FROM c GROUP BY 1);; SELECT f.id, coalesce(i.k, 0) AS in_degree, "
    "coalesce(o.k, 0) AS out_degree, (coalesce(i.k, 0) + coalesce(o.k, 0)) / ((SELECT count(*) FROM f) - 1) AS centrality FROM f LEFT JOIN i ON i.id = f.id LEFT JOIN o ON o.id = f.id"
)
def degree_centrality(w: Workspace):
    return tr.degree_centrality(w.graph.calls, w.graph.callables)


@query(
    PATHS.format(seed=HOT_IDS, depth=6).rstrip(";; ") + f", sp AS ({SHORTEST});; SELECT id, count(*) AS paths FROM (SELECT unnest(string_split(path, ' > ')[2:depth]) AS id FROM sp WHERE depth > 1) GROUP BY 1",
    recursive=True,
)
def betweenness(w: Workspace):
    return tr.betweenness(w.graph.calls, hot_roots(w), 6)


@query(REACH.format(root="dst", id="src", on="dst", depth=5, seed="") + "SELECT depth, count(*) AS pairs FROM (SELECT root, id, min(depth) AS depth FROM reach GROUP BY ALL) GROUP BY 1", recursive=True)
def calculate_depth(w: Workspace):
    c = w.graph.calls
    return tr.closure(tr.reverse(c), c.select(F.col("dst").alias("root")), 5).groupBy("depth").agg(F.count("*").alias("pairs"))
