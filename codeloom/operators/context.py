"""Context for readers: contracts, change packs, refactoring impact, memory, freshness, health.

Operators return one row for each symbol or finding; token costs are a quarter
of the characters plus a fixed part, and budgets stop at the first overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions import paths, text as tx
from codeloom.graph import Graph, Scope
from codeloom.operators import lookup, ranking, relations


def api_contract(g: Graph, scope: Scope) -> DataFrame:
    """``id, name, signature, documented, callers``: the public functions of a scope with their first lines."""
    callers = g.call_sites.where(scope.of()).groupBy(F.col("callee_name").alias("name")).agg(F.countDistinct("src").alias("callers"))
    public = g.callables.where(scope.of() & (F.coalesce("visibility", F.lit("public")) == "public"))
    shown = F.coalesce(tx.signature_preview(F.col("source")), F.col("name"))
    rows = public.select("id", "name", shown.alias("signature"), F.col("docstring").isNotNull().alias("documented"))
    return rows.join(callers, "name", "left").fillna(0, ["callers"])


def patch_context(g: Graph, words: list[str], scope: Scope, tokens: int = 4000) -> DataFrame:
    """``id, name, excerpt, cost, spent``: functions whose names hold a word of a task, the first eight lines redacted, within a budget."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower("name").contains(w.lower())
    excerpt = tx.redact(F.array_join(F.slice(F.split(F.coalesce("source", F.lit("")), "\n"), 1, 8), "\n"))
    rows = g.callables.where(scope.of() & hit).select("id", "name", excerpt.alias("excerpt"))
    costed = rows.withColumn("cost", (F.floor(F.length("excerpt") / 4) + 48).cast("int"))
    return ranking.budget(costed, None, ["name", "id"], "cost", tokens - 256, least=48)


def delta_context(g: Graph, here: str, there: str, tokens: int = 4000) -> DataFrame:
    """``repository_path, name, kind, change, cost, spent``: symbols that a branch adds or lacks, within a budget for each repository."""
    added = relations.branch_only(g, there, here).withColumn("change", F.lit("added"))
    removed = relations.branch_only(g, here, there).withColumn("change", F.lit("removed"))
    costed = added.unionByName(removed).withColumn("cost", (F.floor(F.length("name") / 4) + 32).cast("int"))
    return ranking.budget(costed, "repository_path", ["change", "name", "kind"], "cost", tokens)


def refactoring_impact(g: Graph, name: str, change: str, path_prefix: str = "") -> DataFrame:
    """``id, path, is_test``: what calls a name directly, and for a rename imports or references it, below a path."""
    kinds = {"signature": (), "delete": (), "rename": ("IMPORTS", "REFERENCES")}[change]
    users = g.call_sites.where(F.col("callee_name") == name).select(F.col("src").alias("id")).distinct()
    if kinds:
        targets = g.callables.where(F.col("name") == name).select(F.col("id").alias("dst"))
        users = users.union(g.links(*kinds).join(targets, "dst", "left_semi").select("src")).distinct()
    rows = g.nodes.join(users, "id", "left_semi")
    return rows.where(F.col("path").startswith(path_prefix)).select("id", "path", paths.is_test_artifact("path", "name").alias("is_test"))


def refactoring_risk(impact: DataFrame) -> DataFrame:
    """``users, files, tests, warning``: warned above ten files."""
    out = impact.agg(F.count("*").alias("users"), F.countDistinct("path").alias("files"), F.count_if("is_test").alias("tests"))
    return out.withColumn("warning", F.col("files") > 10)


def freshness(records: DataFrame, files: DataFrame) -> DataFrame:
    """``path, freshness``: records ``path, content_hash`` against the files' digests: fresh, stale, partial without a digest, unknown without a file."""
    j = records.select("path", F.col("content_hash").alias("a")).join(files.select("path", F.col("content_hash").alias("b")), "path", "left")
    state = F.when(F.col("a").isNull(), "partial").when(F.col("b").isNull(), "unknown").when(F.col("a") == F.col("b"), "fresh").otherwise("stale")
    return j.select("path", state.alias("freshness"))


def index_status(g: Graph) -> DataFrame:
    """``repository_path, branch, nodes, files, sourced, last_line``: what is indexed."""
    return g.nodes.where(F.col("repository_path").isNotNull()).groupBy("repository_path", "branch").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("kind") == "FILE").alias("files"), F.count("source").alias("sourced"), F.max("line_number").alias("last_line")
    )


def health(g: Graph) -> DataFrame:
    """``check, bad``: rows that a check of the graph finds: nodes without id or kind, unknown kinds, dangling edges, calls without a name, confidence out of range."""
    from codeloom.graph import EDGE_KINDS, NODE_KINDS

    n = g.raw_nodes.agg(
        F.count_if(F.col("id").isNull()).alias("node_without_id"), F.count_if(F.col("kind").isNull()).alias("node_without_kind"),
        F.count_if(~F.col("kind").isin(*sorted(NODE_KINDS))).alias("unknown_node_kind"), F.count_if((F.col("kind") == "FILE") & F.col("source").isNull()).alias("file_without_source"),
    )
    e = g.raw_edges.agg(
        F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("edge_without_end"), F.count_if(~F.col("kind").isin(*sorted(EDGE_KINDS))).alias("unknown_edge_kind"),
        F.count_if((F.col("confidence") < 0) | (F.col("confidence") > 1)).alias("confidence_out_of_range"),
    )
    rows = lambda df: df.select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c))])).alias("check", "bad"))
    return rows(n).unionByName(rows(e))


def search_memory(observations: DataFrame, key: str, text: str, query: str, k: int) -> DataFrame:
    """``key, score``: the k observations that BM25 ranks first for a query; ties by key."""
    return ranking.bm25(observations, key, text, query).orderBy(F.desc("score"), key).limit(k)


def session_context(observations: DataFrame, session: str, time: str, key: str, n: int) -> DataFrame:
    """The last n observations of each session."""
    w = Window.partitionBy(session).orderBy(F.desc(time), F.desc(key))
    return observations.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def accepted_observations(rows: DataFrame, key: str, text: str, most_bytes: int = 8192) -> DataFrame:
    """``key, verdict``: whether an observation may be saved: not empty, not over 8 KiB, nothing sensitive in it."""
    verdict = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(F.octet_length(text) > most_bytes, "too_long").when(tx.looks_sensitive(F.col(text)), "sensitive").otherwise("accepted")
    return rows.select(key, verdict.alias("verdict"))


def embed_symbols(g: Graph, dim: int = 128) -> DataFrame:
    """``id, embedding, name, kind, path, repository_path, branch``: symbols as static vectors of their names and texts, ready for a vector table."""
    words = tx.body_tokens(F.concat_ws(" ", F.regexp_replace("name", r"([a-z])([A-Z])", "$1 $2"), F.substring("docstring", 1, 1 << 20)))
    rows = g.of_kind("FUNCTION", "METHOD", "CLASS").select("id", words.alias("w"), "name", "kind", "path", "repository_path", "branch")
    return rows.select("id", tx.static_embedding(F.col("w"), dim).alias("embedding"), "name", "kind", "path", "repository_path", "branch")


def across_projects(g: Graph, query: str) -> DataFrame:
    """``repository_path, id, score``: the best symbols of each repository by their names, ties by id."""
    from codeloom.functions import scores
    from codeloom.operators.vectors import top_k

    rows = g.callables.where(F.col("repository_path").isNotNull()).select("repository_path", "id", F.round(scores.fuzzy(query.lower(), F.lower("name")), 6).alias("score"))
    return top_k(rows.where(F.col("score") > 0), "repository_path", "score", "id", 5)


def test_command(language: Column, path: Column) -> Column:
    """The command that runs the tests of a file, by its language; null where none is known."""
    table = {"python": "pytest ", "rust": "cargo test ", "go": "go test ", "javascript": "npx jest ", "typescript": "npx jest ", "ruby": "bundle exec rspec ", "java": "mvn test -Dtest=", "kotlin": "gradle test --tests ", "php": "vendor/bin/phpunit ", "swift": "swift test --filter "}
    out = F
    for name, command in table.items():
        out = out.when(language == name, F.concat(F.lit(command), path))
    return out


def find_branches(g: Graph) -> DataFrame:
    return g.nodes.where(F.col("branch").isNotNull()).groupBy("repository_path", "branch").agg(F.count("*").alias("nodes"))


def explain(g: Graph, name: str) -> DataFrame:
    """``id, reason``: why a search for a name finds a symbol."""
    n = F.lower("name")
    reason = F.when(F.col("name") == name, "exact name").when(n == name.lower(), "name in another case").when(n.startswith(name.lower()), "name begins with it").otherwise("name holds it")
    return lookup.find_code(g, name, "pattern").select("id", reason.alias("reason"))
