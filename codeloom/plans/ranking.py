"""Queries that rank texts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from codeloom.functions import text as tx
from codeloom.operators import metrics, ranking as op, traversal, vectors as vec
from codeloom.plans.registry import Workspace, query

TERMS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: strlen(x) > 1)"
ASK = "snapshot index retry scope"
Q = ", ".join(f"'{t}'" for t in ASK.split())
BASE = (
    "WITH d AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL), w AS (SELECT doc_id, " + TERMS.format("text") + " AS t FROM d), sz AS (SELECT doc_id, t, len(t) AS size FROM w WHERE len(t) > 0), "
    "x AS (SELECT doc_id, size, unnest(t) AS term FROM sz), n AS (SELECT doc_id, size, term, count(*) AS n FROM x GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM n GROUP BY 1), "
    "tot AS (SELECT count(*) AS total, (SELECT avg(coalesce(len(t), 0)) FROM w) AS mean FROM d) "
)


def docs(w: Workspace):
    return w.table("documents").where(F.col("doc_id").isNotNull())


@query(BASE + "SELECT doc_id, term, round(n / size, 8) AS tf FROM n", graph=False)
def term_frequency(w: Workspace):
    return op.term_frequency(docs(w), "doc_id", "text")


@query(BASE + "SELECT term, df, round(ln((total + 1) / (df + 1)) + 1, 8) AS idf FROM df, tot", graph=False)
def document_frequency(w: Workspace):
    return op.document_frequency(docs(w), "doc_id", "text")


TFIDF = f"s AS (SELECT doc_id, round(sum(n / size * (ln((total + 1) / (df + 1)) + 1)) / sqrt(any_value(size)), 6) AS score FROM n JOIN df USING (term), tot WHERE term IN ({Q}) GROUP BY doc_id)"
BM25 = (
    f"s AS (SELECT doc_id, round(sum(ln((total - df + 0.5) / (df + 0.5) + 1) * (n / size) * 2.2 / ((n / size) + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score "
    f"FROM n JOIN df USING (term), tot WHERE term IN ({Q}) GROUP BY doc_id)"
)


@query(BASE + f", {TFIDF} SELECT * FROM s WHERE score > 0", graph=False)
def tfidf(w: Workspace):
    return op.tfidf(docs(w), "doc_id", "text", ASK)


@query(BASE + f", {BM25} SELECT * FROM s WHERE score > 0", graph=False)
def bm25(w: Workspace):
    return op.bm25(docs(w), "doc_id", "text", ASK)


@query(BASE + f", {BM25} SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20", graph=False)
def bm25_top(w: Workspace):
    return op.bm25(docs(w), "doc_id", "text", ASK).orderBy(F.desc("score"), "doc_id").limit(20)


@query(BASE + f"SELECT doc_id, round(sum(n / size * 2) / ln(2 + any_value(size)), 6) AS score FROM n WHERE term IN ({Q}) GROUP BY doc_id", graph=False)
def simple_tfidf(w: Workspace):
    return op.simple_tfidf(docs(w), "doc_id", "text", ASK)


COSTED = BASE + f", {BM25}, k AS (SELECT s.doc_id, s.score, (strlen(substr(text, 1, 320)) // 4 + 32)::INTEGER AS cost FROM s JOIN d USING (doc_id) WHERE score > 0), r AS (SELECT *, sum(cost) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM k) "


def costed(w: Workspace):
    cost = (F.floor(F.octet_length(F.substring("text", 1, 320)) / 4) + 32).cast("int")
    return op.bm25(docs(w), "doc_id", "text", ASK).join(docs(w).select("doc_id", cost.alias("cost")), "doc_id")


@query(COSTED + "SELECT doc_id, score, cost, spent FROM r WHERE spent <= 3000", graph=False)
def token_budget(w: Workspace):
    return op.budget(costed(w), None, [F.desc("score"), "doc_id"], "cost", 3000, least=32)


GROUPED = "WITH k AS (SELECT doc_id, source, (coalesce(length(text), 0) // 4 + 32)::INTEGER AS cost FROM documents WHERE doc_id IS NOT NULL), r AS (SELECT *, sum(cost) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM k) "


@query(GROUPED + "SELECT doc_id, source, cost, spent FROM r WHERE spent <= 5000", graph=False)
def token_budget_by_source(w: Workspace):
    d = docs(w).select("doc_id", "source", (F.floor(F.coalesce(F.length("text"), F.lit(0)) / 4) + 32).cast("int").alias("cost"))
    return op.budget(d, "source", ["doc_id"], "cost", 5000)


# Retrieval: the name of a symbol as the query, names that hold its first word as the answers, the symbols themselves as gold.
RANKED = (
    "q AS (SELECT id AS query, name FROM f WHERE kind = 'METHOD' AND name IS NOT NULL), cand AS (SELECT q.query, f.id, levenshtein(q.name, f.name) AS distance, length(f.path) AS cost "
    "FROM q JOIN f ON f.path = split_part(substr(q.query, 8), ':', 1)), rk AS (SELECT query, id, cost, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM cand);; "
)


def ranked(w: Workspace):
    f = w.graph.callables
    q = f.where((F.col("kind") == "METHOD") & F.col("name").isNotNull()).select(F.col("id").alias("query"), F.col("name").alias("asked"), "path")
    cand = q.join(f.select("id", "name", "path"), "path").select("query", "id", F.levenshtein("asked", "name").alias("distance"), F.length("path").alias("cost"))
    return cand.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).select("query", "id", "cost", "rank")


def gold(w: Workspace):
    return ranked(w).select("query", F.col("query").alias("id")).distinct()


@query(RANKED + "SELECT query, min(rank) AS first FROM rk WHERE id = query GROUP BY 1")
def first_hit_rank(w: Workspace):
    return op.first_hit(ranked(w), gold(w))


@query(
    RANKED.replace(";; ", ", fh AS (SELECT query, min(rank) AS first FROM rk WHERE id = query GROUP BY 1);; ") + "SELECT count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS r_at_1, "
    "round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS r_at_5, round(avg(CASE WHEN first <= 20 THEN 1.0 ELSE 0.0 END), 6) AS r_at_20, round(avg(1.0 / first), 6) AS mrr FROM fh"
)
def retrieval_metrics(w: Workspace):
    return op.retrieval_metrics(ranked(w), gold(w))


@query(
    RANKED.replace(";; ", ", b AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY query ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rk), "
    "h AS (SELECT query, max(CASE WHEN before < 200 AND id = query THEN 1.0 ELSE 0.0 END) AS hit FROM b GROUP BY 1);; ") + "SELECT count(*) AS queries, round(avg(hit), 6) AS recall FROM h"
)
def token_budget_recall(w: Workspace):
    return op.budget_recall(ranked(w), gold(w), "cost", 200)


@query()
def context_capsule(w: Workspace):
    """The whole composition; its parts have SQL of their own."""
    f = w.graph.callables
    centrality = traversal.degree_centrality(w.graph.calls, f).select("id", "centrality")
    return op.capsule(f.select("id", "name", "path", "source"), centrality, "graph snapshot", "explore", ("/srv/checkouts/weighted-digest-service/lib",))


@query()
def hybrid_search(w: Workspace):
    """Vectors of symbols ranked by cosine, by names, and fused; the queries are each twentieth vector."""
    from codeloom.functions import scores
    from codeloom.plans.vectors import asked, table

    near = table(w).top(asked(w), 30)
    names = table(w).frame.select(F.col("vec_id").alias("id"), "node_id").join(w.graph.nodes.select(F.col("id").alias("node_id"), "name", "kind", "path"), "node_id")
    q = names.select(F.col("id").alias("query"), F.col("name").alias("asked"))
    both = near.join(names, "id").join(q, "query")
    overlap = F.size(F.array_intersect(scores.ngrams("asked"), scores.ngrams("name"))) / F.greatest(F.size(scores.ngrams("asked")), F.lit(1))
    linear = 0.65 * F.col("score") + 0.2 * overlap - scores.vendor_penalty(F.col("path"))
    second = vec.top_k(both.select("query", "id", F.round(linear, 6).alias("score")), "query", "score", "id", 30)
    return vec.fuse([near, second]).where(F.col("rank") <= 10)


@query()
def centrality_of_results(w: Workspace):
    """Ranks over the symbols of the same file as linked both ways through the file, not as pairs."""
    g = w.graph
    star = g.links("CONTAINS")
    both = star.unionByName(traversal.reverse(star))
    return traversal.pagerank(both, g.of_kind("FILE", "FUNCTION", "METHOD", "CLASS"), 5).select("id", F.round("score", 8).alias("score"))


@query("SELECT path, count(*) AS symbols, round(avg(coalesce(cyclomatic_complexity, 1)), 6) AS complexity, max(line_number) AS last_line, count(*) FILTER (docstring IS NOT NULL) AS documented FROM f WHERE path IS NOT NULL GROUP BY 1")
def summarize_module(w: Workspace):
    return w.graph.callables.where(F.col("path").isNotNull()).groupBy("path").agg(
        F.count("*").alias("symbols"), F.round(F.avg(F.coalesce("cyclomatic_complexity", F.lit(1))), 6).alias("complexity"), F.max("line_number").alias("last_line"), F.count("docstring").alias("documented")
    )


@query("SELECT path, count(*) * 96 + 128 AS cost FROM f WHERE contains(lower(path), '/tests/') GROUP BY 1")
def get_test_context(w: Workspace):
    tests = w.graph.callables.where(F.lower("path").contains("/tests/"))
    return tests.groupBy("path").agg((F.count("*") * 96 + 128).alias("cost"))


@query("SELECT kind, sum(CASE WHEN source IS NULL THEN 0 WHEN length(source) = 0 THEN 0 ELSE greatest(ceil(length(source) / 4.0), 1) END)::BIGINT AS tokens FROM n GROUP BY 1")
def estimate_context_cost(w: Workspace):
    return w.graph.nodes.groupBy("kind").agg(F.sum(F.coalesce(tx.token_estimate(F.col("source")), F.lit(0))).alias("tokens"))
