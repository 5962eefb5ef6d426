"""Queries for contexts, freshness, memory and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.graph import EDGE_KINDS, NODE_KINDS, Scope
from codeloom.operators import context as op
from codeloom.plans.control import FILES, RECORDS, files, records
from codeloom.plans.registry import Workspace, query

HOT = "/srv/checkouts/weighted-digest-service"
SCOPE = Scope(HOT, "main")
IN = f"repository_path = '{HOT}' AND branch = 'main'"
PREVIEW = "trim(regexp_replace(regexp_extract(source, '(?s)^(.*?)(?:\\{|:[ \\t]*(?:\\n|$)|\\z)', 1), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"


@query(
    f"SELECT id, name, coalesce({PREVIEW}, name) AS signature, docstring IS NOT NULL AS documented, (SELECT count(DISTINCT src) FROM sites s WHERE s.callee_name = f.name AND s.repository_path = '{HOT}' AND s.branch = 'main') AS callers "
    f"FROM f WHERE {IN} AND coalesce(visibility, 'public') = 'public'"
)
def get_api_contract(w: Workspace):
    return op.api_contract(w.graph, SCOPE)


@query(
    f"k AS (SELECT id, name, (length(regexp_replace(array_to_string(string_split(coalesce(source, ''), chr(10))[1:8], chr(10)), '(?im)^[^\\n]*(?:api_key|apikey|secret|password|token|authorization:|private_key)[^\\n]*$', '[REDACTED_SECRET_LINE]', 'g')) // 4 + 48)::INTEGER AS cost "
    f"FROM f WHERE {IN} AND (contains(lower(name), 'graph') OR contains(lower(name), 'scope'))), r AS (SELECT *, sum(cost) OVER (ORDER BY name, id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM k);; SELECT id, name, cost, spent FROM r WHERE spent <= 1744"
)
def get_patch_context(w: Workspace):
    return op.patch_context(w.graph, ["graph", "scope"], SCOPE, 2000).select("id", "name", "cost", "spent")


SYM = "SELECT DISTINCT repository_path, name, kind FROM n WHERE kind IN ('FUNCTION', 'METHOD', 'CLASS') AND repository_path IS NOT NULL AND branch = '{}'"


@query(
    f"a AS ({SYM.format('develop')} EXCEPT {SYM.format('main')}), b AS ({SYM.format('main')} EXCEPT {SYM.format('develop')}), u AS (SELECT *, 'added' AS change FROM a UNION ALL SELECT *, 'removed' FROM b), k AS (SELECT *, (length(name) // 4 + 32)::INTEGER AS cost FROM u), "
    "r AS (SELECT *, sum(cost) OVER (PARTITION BY repository_path ORDER BY change, name, kind ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM k);; SELECT * FROM r WHERE spent <= 1000"
)
def get_delta_context(w: Workspace):
    return op.delta_context(w.graph, "main", "develop", 1000)


TEST = "coalesce(regexp_matches(lower(path), '(^|/)(tests?|spec|__tests__)/|(_test|\\.test|\\.spec|_spec)\\.[^/]+$|(^|/)test_[^/]*$') OR regexp_matches(lower(name), '^test_|_test$'), false)"


@query(f"SELECT id, path, {TEST} AS is_test FROM n WHERE id IN (SELECT src FROM sites WHERE callee_name = 'unwrap') AND starts_with(path, '/srv')")
def analyze_refactoring(w: Workspace):
    return op.refactoring_impact(w.graph, "unwrap", "signature", "/srv")


@query(
    f"i AS (SELECT id, path, {TEST} AS is_test FROM n WHERE id IN (SELECT src FROM sites WHERE callee_name = 'build_symbol' UNION SELECT e.src FROM e JOIN f ON e.dst = f.id AND f.name = 'build_symbol' WHERE e.kind IN ('IMPORTS', 'REFERENCES')) AND path IS NOT NULL);; "
    "SELECT count(*) AS users, count(DISTINCT path) AS files, count(*) FILTER (is_test) AS tests, count(DISTINCT path) > 10 AS warning FROM i"
)
def refactoring_risk(w: Workspace):
    return op.refactoring_risk(op.refactoring_impact(w.graph, "build_symbol", "rename"))


@query(f"WITH {RECORDS}, {FILES} SELECT r.path, CASE WHEN r.content_hash IS NULL THEN 'partial' WHEN fl.content_hash IS NULL THEN 'unknown' WHEN r.content_hash = fl.content_hash THEN 'fresh' ELSE 'stale' END AS freshness FROM r LEFT JOIN fl ON fl.path = r.path", graph=False)
def explain_index_freshness(w: Workspace):
    return op.freshness(records(w), files(w))


@query("SELECT repository_path, branch, count(*) AS nodes, count(*) FILTER (kind = 'FILE') AS files, count(source) AS sourced, max(line_number) AS last_line FROM n WHERE repository_path IS NOT NULL GROUP BY ALL")
def index_status(w: Workspace):
    return op.index_status(w.graph)


KINDS, EDGES = (", ".join(f"'{k}'" for k in sorted(s)) for s in (NODE_KINDS, EDGE_KINDS))


@query(
    "WITH n AS (SELECT count(*) FILTER (id IS NULL) AS node_without_id, count(*) FILTER (kind IS NULL) AS node_without_kind, " + f"count(*) FILTER (kind NOT IN ({KINDS})) AS unknown_node_kind, count(*) FILTER (kind = 'FILE' AND source IS NULL) AS file_without_source FROM nodes), "
    f"e AS (SELECT count(*) FILTER (src IS NULL OR dst IS NULL) AS edge_without_end, count(*) FILTER (kind NOT IN ({EDGES})) AS unknown_edge_kind, count(*) FILTER (confidence < 0 OR confidence > 1) AS confidence_out_of_range FROM edges) "
    'SELECT "check", bad FROM (UNPIVOT n ON COLUMNS(*) INTO NAME "check" VALUE bad) UNION ALL SELECT "check", bad FROM (UNPIVOT e ON COLUMNS(*) INTO NAME "check" VALUE bad)',
    graph=False,
)
def check_health(w: Workspace):
    return op.health(w.graph)


@query("SELECT repository_path, branch, count(*) AS nodes FROM n WHERE branch IS NOT NULL GROUP BY ALL")
def list_branches(w: Workspace):
    return op.find_branches(w.graph)


@query("SELECT id, CASE WHEN name = 'graph' THEN 'exact name' WHEN lower(name) = 'graph' THEN 'name in another case' WHEN starts_with(lower(name), 'graph') THEN 'name begins with it' ELSE 'name holds it' END AS reason FROM n WHERE contains(name, 'graph')")
def explain_result(w: Workspace):
    return op.explain(w.graph, "graph")


@query("SELECT doc_id, position FROM (SELECT doc_id, row_number() OVER (PARTITION BY repository_path ORDER BY collected_at DESC NULLS LAST, doc_id DESC) AS position FROM documents WHERE doc_id IS NOT NULL) WHERE position <= 5", graph=False)
def get_session_context(w: Workspace):
    d = w.table("documents").where(F.col("doc_id").isNotNull())
    return op.session_context(d, "repository_path", "collected_at", "doc_id", 5).select("doc_id", "position")


@query()
def search_memory(w: Workspace):
    """BM25 over observations; BM25 itself is checked by SQL."""
    return op.search_memory(w.table("documents"), "doc_id", "text", "snapshot index retry", 10)


@query(
    "WITH d AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL) SELECT doc_id, CASE WHEN coalesce(trim(text, ' '), '') = '' THEN 'empty' WHEN strlen(text) > 8192 THEN 'too_long' WHEN "
    + " OR ".join(f"contains(lower(text), '{c}')" for c in ("password=", "secret=", "api_key", "apikey", "token=", "bearer ", "begin private key", "begin rsa private key", "aws_access_key_id", "aws_secret_access_key", "x-api-key"))
    + " THEN 'sensitive' ELSE 'accepted' END AS verdict FROM d WHERE NOT regexp_matches(text, '[^ \\t\\n\\x0b\\f\\r]{32,}')",
    graph=False,
)
def save_observation(w: Workspace):
    """Texts without long words, so that cues alone decide; the rule for long words is checked by looks_sensitive."""
    d = w.table("documents").where(F.col("doc_id").isNotNull() & ~F.col("text").rlike(r"\S{32,}"))
    return op.accepted_observations(d, "doc_id", "text")


@query()
def vector_index_repository(w: Workspace):
    e = op.embed_symbols(w.graph, 32)
    return e.select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"))


@query()
def search_across_projects(w: Workspace):
    return op.across_projects(w.graph, "graph snapshot")


@query(
    "SELECT path, CASE WHEN ends_with(path, '.py') THEN 'pytest ' || path WHEN ends_with(path, '.rs') THEN 'cargo test ' || path WHEN ends_with(path, '.go') THEN 'go test ' || path END AS command "
    "FROM n WHERE kind = 'FILE' AND regexp_matches(path, '\\.(py|rs|go|c)$')"
)
def test_commands(w: Workspace):
    f = w.graph.of_kind("FILE").where(F.col("path").rlike(r"\.(py|rs|go|c)$"))
    return f.select("path", op.test_command(paths.language("path"), F.col("path")).alias("command"))
