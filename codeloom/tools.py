"""The tools of the query surface, by name, over one workspace.

Each takes a graph (or the tables it names) and returns a DataFrame; parameters
have the defaults of the tools.  Tools that control processes rather than data
(daemons, agents, installers) have no counterpart here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.functions import text as tx
from codeloom.graph import CALLABLE, Graph, Scope
from codeloom.operators import clones, context, control, lookup, metrics, ranking, relations, smells, traversal, vectors
from codeloom.sources import extract, tables

RELATIONSHIPS: dict[str, Callable] = {
    "find_callers": relations.callers, "find_callees": relations.callees, "find_all_callers": relations.all_callers, "find_all_callees": relations.all_callees,
    "find_importers": relations.importers, "overrides": relations.overrides, "call_chain": relations.call_chain, "find_by_decorator": lookup.find_by_decorator,
    "find_by_argument": lookup.find_by_argument, "find_complexity": lookup.find_complexity, "find_functions": lookup.find_functions, "find_tests_for": lookup.find_tests_for,
}

# What the tools are for, as words to search.
PURPOSES = {
    "find_code": "search symbols by name pattern kind content", "analyze_code_relationships": "callers callees imports hierarchy chains", "execute_query": "sql query over nodes and edges",
    "find_dead_code": "unused functions without callers", "find_clones": "similar duplicated functions", "go_to_definition": "where a name is defined", "find_all_usages": "uses of a symbol",
    "quick_info": "counts of callers callees uses", "branch_structural_diff": "symbols added removed between branches", "pr_review": "smells in changed files", "find_similar_across_projects": "symbols in several repositories",
    "find_shared_dependencies": "modules imported by several repositories", "compare_api_surface": "public functions of two repositories", "calculate_cyclomatic_complexity": "complexity of functions",
    "vector_search": "nearest vectors", "vector_search_hybrid": "vectors and words fused", "get_context_capsule": "symbols worth reading for a query", "get_impact_graph": "what a change affects",
    "search_logic_flow": "call paths between symbols", "get_skeleton": "declarations of a file", "get_signature": "first line of a function", "find_tests": "tests of the code", "find_patterns": "design patterns",
    "summarize_module": "numbers of a file", "get_api_contract": "public signatures", "analyze_refactoring": "users of a name before a change", "get_patch_context": "functions for a task", "get_delta_context": "symbols of a branch",
    "search_memory": "saved observations", "check_health": "faults of the graph", "explain_index_freshness": "stale files", "list_branches": "branches of repositories", "diagnose": "faults and freshness",
}


class Tools:
    def __init__(self, g: Graph):
        self.g = g
        self.spark: SparkSession = g.raw_nodes.sparkSession

    # -- graph

    def find_code(self, text: str, by: str = "name", path: str | None = None, limit: int | None = 100) -> DataFrame:
        return lookup.find_code(self.g, text, by, path, limit=limit)

    def analyze_code_relationships(self, query_type: str, *args) -> DataFrame:
        return RELATIONSHIPS[query_type](self.g, *args)

    def execute_query(self, sql: str, **values) -> DataFrame:
        return tables.query_tables(self.g, sql, **values)

    def find_dead_code(self, limit: int | None = 500) -> DataFrame:
        return metrics.dead_code(self.g, limit=limit)

    def find_clones(self, bodies: DataFrame, threshold: float = 0.85) -> DataFrame:
        return clones.similar_classes(bodies, "id", "tokens", threshold)[0]

    def go_to_definition(self, name: str) -> DataFrame:
        return relations.resolve_definitions(self.g, name)

    def find_all_usages(self) -> DataFrame:
        return relations.usages(self.g)

    def quick_info(self) -> DataFrame:
        return relations.quick_info(self.g)

    def branch_structural_diff(self, here: str, there: str) -> DataFrame:
        return relations.structural_diff(self.g, here, there)

    project_branch_diff = branch_structural_diff

    def pr_review(self, changed: DataFrame, most: int = 50) -> DataFrame:
        return smells.review(smells.text_findings(self.g.callables), self.g.callables, changed, most)

    def find_similar_across_projects(self, least: int = 2) -> DataFrame:
        return metrics.similar_across(self.g, least)

    def find_shared_dependencies(self, least: int = 2) -> DataFrame:
        return metrics.shared_dependencies(self.g, least)

    def compare_api_surface(self, one: str, other: str) -> DataFrame:
        return relations.api_surface(self.g, one, other)

    def calculate_cyclomatic_complexity(self, n: int = 20) -> DataFrame:
        return metrics.most_complex(self.g, n, CALLABLE)

    def get_impact_graph(self, name: str, depth: int = 3) -> DataFrame:
        roots = self.g.callables.where(F.col("name") == name).select(F.col("id").alias("root"))
        return relations.impact_graph(self.g, roots, depth)

    def search_logic_flow(self, source: str, target: str, depth: int = 6) -> DataFrame:
        f = self.g.callables
        return relations.logic_flow(self.g, f.where(F.col("name") == source).select(F.col("id").alias("root")), f.where(F.col("name") == target), depth)

    def get_skeleton(self, path: str) -> DataFrame:
        files = self.g.of_kind("FILE").where(F.col("path").endswith(path))
        return files.select("path", tx.skeleton(F.col("source")).alias("skeleton"))

    def get_signature(self, name: str) -> DataFrame:
        return self.g.callables.where(F.col("name") == name).select("id", tx.signature_preview(F.col("source")).alias("signature"))

    def find_tests(self) -> DataFrame:
        return lookup.find_tests(self.g)

    def find_patterns(self, least: float = 0.5) -> DataFrame:
        return smells.patterns(self.g.of_kind("FUNCTION", "METHOD", "CLASS"), least)

    def analyze_refactoring(self, name: str, change: str) -> DataFrame:
        return context.refactoring_impact(self.g, name, change)

    def explain_result(self, name: str) -> DataFrame:
        return context.explain(self.g, name)

    # -- vectors

    def vector_index_repository(self, scope: Scope | None = None, dim: int = 128) -> vectors.VectorTable:
        rows = context.embed_symbols(self.g, dim)
        return vectors.VectorTable(rows if scope is None else rows.where(scope.of()), "id")

    def vector_index_file(self, path: str, dim: int = 128) -> vectors.VectorTable:
        return vectors.VectorTable(context.embed_symbols(self.g, dim).where(F.col("path") == path), "id")

    def vector_search(self, index: vectors.VectorTable, queries: DataFrame, k: int = 10, **equal) -> DataFrame:
        return index.top(queries, k, **equal)

    def vector_search_hybrid(self, index: vectors.VectorTable, queries: DataFrame, words: str, k: int = 10) -> DataFrame:
        """Cosine and BM25 over names and texts, fused; ``queries`` is ``query, embedding``."""
        f = self.g.callables.select("id", F.concat_ws(" ", "name", "path", "source").alias("doc"))
        best = ranking.bm25(f, "id", "doc", words).join(queries.select("query"))
        second = vectors.top_k(best.select("query", "id", "score"), "query", "score", "id", 3 * k)
        return vectors.fuse([index.top(queries, 3 * k), second]).where(F.col("rank") <= k)

    def vector_index_status(self, index: vectors.VectorTable) -> DataFrame:
        return index.count()

    def vector_delete_repository(self, index: vectors.VectorTable, repository: str) -> DataFrame:
        return index.without(index.where(repository_path=repository))

    def search_across_projects(self, query: str) -> DataFrame:
        return context.across_projects(self.g, query)

    # -- context

    def get_context_capsule(self, query: str, intent: str = "explore", tokens: int = 4000) -> DataFrame:
        f = self.g.callables
        central = traversal.degree_centrality(self.g.calls, f).select("id", "centrality")
        return ranking.capsule(f.select("id", "name", "path", "source"), central, query, intent, tokens=tokens)

    def get_patch_context(self, task: str, scope: Scope, tokens: int = 4000) -> DataFrame:
        return context.patch_context(self.g, ranking.query_terms(task), scope, tokens)

    def get_delta_context(self, here: str, there: str, tokens: int = 4000) -> DataFrame:
        return context.delta_context(self.g, here, there, tokens)

    def get_api_contract(self, scope: Scope) -> DataFrame:
        return context.api_contract(self.g, scope)

    def get_test_context(self, most: int = 20) -> DataFrame:
        """``path, cost``: the files with most tests, with what reading them is estimated to cost."""
        tests = lookup.find_tests(self.g).groupBy("path").agg(F.count("*").alias("n"))
        return tests.orderBy(F.desc("n"), "path").limit(most).select("path", (F.col("n") * 96 + 128).alias("cost"))

    def summarize_module(self) -> DataFrame:
        """``module, functions, fan_in, fan_out, coupling`` of every folder."""
        return metrics.analyze_module(self.g)

    def estimate_context_cost(self) -> DataFrame:
        return self.g.nodes.groupBy("kind").agg(F.sum(F.coalesce(tx.token_estimate(F.col("source")), F.lit(0))).alias("tokens"))

    def ctx_grep(self, texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
        return lookup.grep(texts, key, text, pattern)

    def ctx_slice(self, texts: DataFrame, key: str, text: str, first: int, last: int) -> DataFrame:
        return lookup.slice_lines(texts, key, text, first, last)

    def ctx_peek(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        return lookup.peek(texts, key, text)

    # -- index

    def add_code_to_graph(self, folder: str) -> DataFrame:
        return extract.extract(tables.scan_tree(self.spark, folder))

    def index_status(self) -> DataFrame:
        return context.index_status(self.g)

    def list_indexed_repositories(self) -> DataFrame:
        return metrics.repositories(self.g)

    def get_repository_stats(self) -> DataFrame:
        return metrics.repository_stats(self.g)

    def list_projects(self) -> DataFrame:
        return self.g.of_kind("REPOSITORY").select("id", "name", "path")

    def project_status(self, records: DataFrame) -> DataFrame:
        """``freshness, files`` over all rebuild records."""
        return self.explain_index_freshness(records).groupBy("freshness").agg(F.count("*").alias("files"))

    def list_branches(self) -> DataFrame:
        return context.find_branches(self.g)

    def delete_repository(self, repository: str) -> Graph:
        nodes, links = tables.delete_repository(self.g, repository)
        return Graph(nodes, self.g.raw_edges.join(links, ["src", "dst", "kind"], "left_semi"))

    def explain_index_freshness(self, records: DataFrame) -> DataFrame:
        files = self.g.of_kind("FILE").where(F.col("source").isNotNull()).select("path", F.md5("source").alias("content_hash"))
        return context.freshness(records, files)

    def check_health(self) -> DataFrame:
        return context.health(self.g)

    diagnose = check_health

    def submit_lsp_edges(self, incoming: DataFrame) -> DataFrame:
        return relations.merge_lsp(self.g.edges.where(F.col("kind") == "CALLS"), incoming)

    def export_bundle(self, repository: str, folder: str) -> None:
        tables.export_bundle(self.g, repository, folder)

    def load_bundle(self, folder: str) -> Graph:
        return tables.import_bundle(self.spark, folder)

    # -- memory, jobs, telemetry

    def save_observation(self, existing: DataFrame, incoming: DataFrame, key: str, text: str, order: str) -> DataFrame:
        fine = incoming.join(context.accepted_observations(incoming, key, text).where("verdict = 'accepted'"), key, "left_semi")
        return control.append_insights(existing, fine, key, [order])

    def search_memory(self, observations: DataFrame, key: str, text: str, query: str, k: int = 10) -> DataFrame:
        return context.search_memory(observations, key, text, query, k)

    def get_session_context(self, observations: DataFrame, session: str, time: str, key: str, n: int = 20) -> DataFrame:
        return context.session_context(observations, session, time, key, n)

    def list_jobs(self, jobs: DataFrame, n: int = 100) -> DataFrame:
        return jobs.orderBy(F.desc("created_at"), "job_id").limit(n)

    def check_job_status(self, jobs: DataFrame, job_id) -> DataFrame:
        return jobs.where(F.col("job_id") == job_id)

    def project_queue_status(self, jobs: DataFrame) -> DataFrame:
        return control.status_counts(jobs, "status")

    def project_metrics(self, calls: DataFrame, tool: str, value: str, failed) -> DataFrame:
        return control.tool_stats(calls, tool, value, failed)

    # -- the tools themselves

    def tools_search(self, query: str) -> DataFrame:
        """``tool, purpose, score``: tools by how many words of a query their purpose holds."""
        words = set(ranking.query_terms(query))
        rows = [(t, p, len(words & set(f"{t.replace('_', ' ')} {p}".split()))) for t, p in PURPOSES.items()]
        found = self.spark.createDataFrame(rows, "tool string, purpose string, score int")
        return found.where(F.col("score") > 0).orderBy(F.desc("score"), "tool")

    def recommend_tools(self, task: str, n: int = 3) -> DataFrame:
        return self.tools_search(task).limit(n)

    def get_tool_guidance(self, tool: str) -> DataFrame:
        return self.spark.createDataFrame([(tool, PURPOSES.get(tool))], "tool string, purpose string")
