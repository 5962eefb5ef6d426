"""Queries that find symbols (scans, filters, predicates)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.graph import DEFINITIONS, Scope
from codeloom.operators import lookup as op
from codeloom.plans.registry import Workspace, query

# The parameters of the registered queries.
HOT = "/srv/checkouts/weighted-digest-service"
SCOPE = Scope(HOT, "main")
NAME, TEXT = "unwrap", "cache"
COLS = "id, kind, name, path, line_number"
IN = f"repository_path = '{HOT}' AND branch = 'main'"
TEST = "(starts_with(lower(name), 'test') OR contains(lower(path), '/tests/') OR contains(lower(path), '_test.') OR contains(lower(path), '/test/'))"


@query(f"SELECT {COLS} FROM n WHERE kind = 'FILE'")
def scan_label(w: Workspace):
    return op.definitional(w.graph, ["FILE"])


@query(f"SELECT {COLS} FROM n WHERE name = 'build_symbol'")
def find_code_name(w: Workspace):
    return op.find_code(w.graph, "build_symbol")


@query(f"SELECT {COLS} FROM n WHERE contains(name, '{TEXT}')")
def find_code_pattern(w: Workspace):
    return op.find_code(w.graph, TEXT, "pattern")


@query(f"SELECT {COLS} FROM n WHERE kind = 'CLASS' AND contains(path, 'src')")
def find_code_kind(w: Workspace):
    return op.find_code(w.graph, "class", "kind", "src")


@query(f"SELECT {COLS} FROM n WHERE contains(source, 'spill')")
def find_code_content(w: Workspace):
    return op.find_code(w.graph, "spill", "content")


@query(f"SELECT {COLS} FROM n WHERE contains(name, 'index') ORDER BY path, line_number NULLS FIRST, id LIMIT 100")
def find_code_top(w: Workspace):
    return op.find_code(w.graph, "index", "pattern", limit=100)


@query(f"SELECT {COLS} FROM f WHERE contains(name, '{TEXT}')")
def find_functions(w: Workspace):
    return op.find_functions(w.graph, TEXT)


@query("SELECT id, name, path, line_number, docstring FROM f WHERE name = 'collect_branch'")
def get_function(w: Workspace):
    return op.get_function(w.graph, "collect_branch")


@query(f"SELECT {COLS} FROM n WHERE name = 'unwrap' AND kind = 'CALL_TARGET'")
def find_by_name(w: Workspace):
    return op.find_by_name(w.graph, NAME, "CALL_TARGET")


@query(f"SELECT {COLS} FROM n WHERE regexp_full_match(name, 'build.*[mM]ap') AND {IN}")
def find_by_pattern(w: Workspace):
    return op.find_by_pattern(w.graph, "build.*[mM]ap", SCOPE)


@query(f"SELECT {COLS} FROM n WHERE starts_with(path, '{HOT}/lib/')")
def find_by_path_prefix(w: Workspace):
    return op.find_by_path_prefix(w.graph, HOT + "/lib/")


@query(f"SELECT {COLS} FROM n WHERE contains(path, 'cache_')")
def find_by_file(w: Workspace):
    return op.find_by_file(w.graph, "cache_")


@query(f"SELECT {COLS} FROM f WHERE contains(path, '/lib/')")
def find_in_module(w: Workspace):
    return op.find_in_module(w.graph, "/lib/")


@query(f"SELECT {COLS} FROM f WHERE contains(lower(name), 'edge') AND name <> 'edge'")
def find_similar(w: Workspace):
    return op.find_similar(w.graph, "edge")


@query(f"SELECT DISTINCT {COLS} FROM nodes WHERE id IS NOT NULL AND contains(properties['indexed_at'], '2025-03-01T0')", graph=False)
def find_by_property(w: Workspace):
    return op.find_by_decorator(w.graph, "2025-03-01T0", ("indexed_at",))


@query(f"SELECT DISTINCT {COLS} FROM nodes WHERE contains(properties['annotations'], 'Override') OR contains(properties['decorators'], 'Override')", graph=False)
def find_by_annotation(w: Workspace):
    return op.find_by_annotation(w.graph, "Override")


@query(f"SELECT DISTINCT {COLS} FROM nodes WHERE contains(properties['decorators'], 'cached')", graph=False)
def find_by_decorator(w: Workspace):
    return op.find_by_decorator(w.graph, "cached")


@query(
    "SELECT f.id, f.kind, f.name, f.path, f.line_number FROM f WHERE f.id IN "
    "(SELECT e.src FROM e JOIN n p ON e.dst = p.id AND p.kind = 'PARAMETER' AND p.name = 'limit' WHERE e.kind = 'HAS_PARAMETER')"
)
def find_by_argument(w: Workspace):
    return op.find_by_argument(w.graph, "limit")


@query(f"SELECT {COLS} FROM f WHERE {TEST}")
def find_tests(w: Workspace):
    return op.find_tests(w.graph)


@query(f"SELECT {COLS} FROM f WHERE {TEST} AND (contains(lower(name), 'graph') OR id IN (SELECT src FROM sites WHERE callee_name = 'graph'))")
def find_tests_for(w: Workspace):
    return op.find_tests_for(w.graph, "graph")


@query(
    f"SELECT {COLS} FROM f WHERE {IN} AND {TEST} AND (id IN (SELECT src FROM sites WHERE callee_name = 'unwrap') "
    "OR contains(source, 'unwrap') OR contains(docstring, 'unwrap'))"
)
def scoped_tests(w: Workspace):
    return op.scoped_tests(w.graph, NAME, SCOPE)


@query("SELECT id, name, path, coalesce(cyclomatic_complexity, 1) AS complexity FROM n WHERE name = 'collect_branch'")
def find_complexity(w: Workspace):
    return op.find_complexity(w.graph, "collect_branch")


@query(f"SELECT repository_path, {COLS} FROM n WHERE repository_path IN ('{HOT}', '/srv/checkouts/fresh-cache') AND contains(name, 'graph') AND branch = 'main'")
def across_repositories(w: Workspace):
    return op.across_repositories(w.graph, [HOT, "/srv/checkouts/fresh-cache"], "graph", "main")


@query(f"SELECT {COLS} FROM n WHERE {IN}")
def in_scope(w: Workspace):
    return op.in_scope(w.graph, SCOPE)


@query(
    f"SELECT {COLS} FROM n WHERE (contains(path, '/src/') OR regexp_matches(path, '^(?:.*/)?[^/]*\\.py$')) "
    "AND NOT (contains(path, '/tests/')) AND path IS NOT NULL"
)
def path_filter(w: Workspace):
    return op.in_paths(w.graph, ["src", "**/*.py"], ["tests"])


@query(
    "SELECT c.src, c.dst FROM c JOIN f a ON c.src = a.id JOIN f b ON c.dst = b.id WHERE NOT (contains(a.path, '/tests/') OR contains(b.path, '/tests/')) "
    "AND (contains(a.path, '/src/') OR contains(b.path, '/src/'))"
)
def multi_path_filter(w: Workspace):
    return op.edges_in_paths(w.graph, ["src"], ["tests"])


@query(f"SELECT {COLS} FROM n WHERE kind IN ({', '.join(repr(k) for k in DEFINITIONS)})")
def definitional_kinds(w: Workspace):
    return op.definitional(w.graph, DEFINITIONS)


@query(f"SELECT {COLS} FROM f")
def callable_kinds(w: Workspace):
    return op.callables(w.graph)


@query("SELECT id, contains(lower(path), '/test') OR contains(lower(path), '_test.') AS is_test FROM n WHERE kind = 'FILE'")
def is_test_path(w: Workspace):
    return w.graph.of_kind("FILE").select("id", paths.is_test_path("path").alias("is_test"))


@query(
    r"SELECT id, coalesce(regexp_matches(lower(path), '(^|/)(tests?|spec|__tests__)/|(_test|\.test|\.spec|_spec)\.[^/]+$|(^|/)test_[^/]*$') "
    "OR regexp_matches(lower(name), '^test_|_test$'), false) AS is_test FROM f"
)
def is_test_artifact(w: Workspace):
    return w.graph.callables.select("id", paths.is_test_artifact("path", "name").alias("is_test"))


@query("SELECT id, path FROM n WHERE regexp_extract(path, '[^/]+$', 0) = 'index_path.py' OR ends_with(path, '/index_path.py')")
def file_match(w: Workspace):
    return w.graph.nodes.where(paths.is_file(F.col("path"), "index_path.py")).select("id", "path")


@query(r"SELECT id, path FROM n WHERE regexp_matches(path, '^/srv/[^/]*/[^/]*/lib/(?:.*/)?[^/]*_[a-m][^/]*\.[ch]$')")
def glob_match(w: Workspace):
    return w.graph.nodes.where(paths.matches(F.col("path"), "/srv/*/*/lib/**/*_[a-m]*.[ch]")).select("id", "path")


@query("SELECT src, dst FROM e WHERE kind = 'IMPORTS' AND (dst = 'module:ledger' OR starts_with(dst, 'module:ledger::') OR starts_with('module:ledger', dst || '::')) GROUP BY ALL")
def import_match(w: Workspace):
    return w.graph.links("IMPORTS").where(paths.import_matches(F.col("dst"), "module:ledger"))


@query(
    "SELECT DISTINCT id, i AS line_number, line FROM (SELECT id, unnest(string_split(source, chr(10))) AS line, "
    "generate_subscripts(string_split(source, chr(10)), 1) AS i FROM n WHERE kind = 'FILE' AND source IS NOT NULL) WHERE regexp_matches(line, '\\bTODO\\b|retry [a-z]+ done')"
)
def ctx_grep(w: Workspace):
    return op.grep(w.graph.of_kind("FILE"), "id", "source", r"\bTODO\b|retry [a-z]+ done")


@query(
    "SELECT id, i AS line_number, line FROM (SELECT id, unnest(string_split(source, chr(10))) AS line, "
    "generate_subscripts(string_split(source, chr(10)), 1) AS i FROM n WHERE kind = 'FILE' AND source IS NOT NULL) WHERE i BETWEEN 3 AND 6"
)
def ctx_slice(w: Workspace):
    return op.slice_lines(w.graph.of_kind("FILE"), "id", "source", 3, 6)


@query("SELECT id, substr(source, 1, 200) AS head, length(source) AS size FROM n WHERE kind = 'FILE'")
def ctx_peek(w: Workspace):
    return op.peek(w.graph.of_kind("FILE"), "id", "source")


@query(
    "SELECT vec_id, node_id FROM (SELECT vec_id, max(node_id) AS node_id, max(model) AS model, max(batch_index) AS batch_index FROM code_vectors "
    "WHERE vec_id IS NOT NULL GROUP BY 1) WHERE model = 'static-128' AND batch_index IN (0, 1, 2)",
    graph=False,
)
def vector_metadata_filter(w: Workspace):
    from codeloom.operators.vectors import VectorTable

    return VectorTable(w.table("code_vectors")).where(model="static-128", batch_index=[0, 1, 2]).select("vec_id", "node_id")
