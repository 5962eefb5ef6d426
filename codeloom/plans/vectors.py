"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import vectors as op
from codeloom.plans.registry import Workspace, query
from codeloom.session import cut

META = "max(node_id) AS node_id, max(batch_index) AS batch_index, max(model) AS model, max(created_at) AS created_at, max(embedding) AS embedding"
V = f"v AS (SELECT vec_id, {META} FROM code_vectors WHERE vec_id IS NOT NULL GROUP BY 1)"
COS = (
    "coalesce(CASE WHEN len(a.embedding) = len(b.embedding) AND len(a.embedding) > 0 AND list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x)) > 0 AND list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x)) > 0 "
    "AND NOT isnan(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE))) AND NOT isnan(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE))) "
    "THEN list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x))) "
    "* sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x)))) ELSE 0.0 END, 0.0)"
)


def table(w: Workspace) -> op.VectorTable:
    return op.VectorTable(w.table("code_vectors"))


def asked(w: Workspace):
    return table(w).frame.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query"), "embedding")


TOP = f"WITH {V}, s AS (SELECT a.vec_id AS query, b.vec_id AS id, round({COS}, 6) AS score FROM v a, v b WHERE a.vec_id % 20 = 0 {{}}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) "


@query(TOP.format("") + "SELECT query, id, score, rank FROM r WHERE rank <= 10", graph=False)
def vector_top_k(w: Workspace):
    """Each twentieth vector against all, the stated query set."""
    return table(w).top(asked(w), 10)


@query(TOP.format("AND b.batch_index IN (0, 1)") + "SELECT query, id, score, rank FROM r WHERE rank <= 5", graph=False)
def vector_top_k_filtered(w: Workspace):
    return table(w).top(asked(w), 5, batch_index=[0, 1])


@query(TOP.format("") + "SELECT query, id, score, rank FROM r WHERE rank <= 10 AND score >= 0.5", graph=False)
def vector_top_k_least(w: Workspace):
    return table(w).top(asked(w), 10, 0.5)


@query(f"WITH {V} SELECT vec_id, node_id, model FROM v WHERE vec_id % 7 = 0", graph=False)
def vector_get(w: Workspace):
    ids = w.table("code_vectors").where(F.col("vec_id") % 7 == 0).select("vec_id")
    return table(w).get(ids).select("vec_id", "node_id", "model")


@query(f"WITH {V} SELECT vec_id, node_id, model FROM v WHERE vec_id % 7 <> 0", graph=False)
def vector_delete(w: Workspace):
    ids = w.table("code_vectors").where(F.col("vec_id") % 7 == 0).select("vec_id")
    return table(w).without(ids).select("vec_id", "node_id", "model")


@query(f"WITH {V} SELECT vec_id, node_id FROM v WHERE NOT coalesce(batch_index = 1, false)", graph=False)
def vector_delete_by_filter(w: Workspace):
    t = table(w)
    return t.without(t.where(batch_index=1).select("vec_id")).select("vec_id", "node_id")


@query(f"WITH {V} SELECT count(*) AS n FROM v", graph=False)
def vector_count(w: Workspace):
    return table(w).count()


@query(f"WITH {V} SELECT count(*) AS n FROM v WHERE model = 'static-128' AND batch_index = 1", graph=False)
def vector_count_by_filter(w: Workspace):
    return table(w).count(model="static-128", batch_index=1)


@query(
    f"WITH u AS (SELECT vec_id, coalesce(arg_max(x.node_id, x.new), max(x.node_id)) AS node_id FROM (SELECT vec_id, node_id, 0 AS new FROM code_vectors) x WHERE vec_id IS NOT NULL GROUP BY 1) "
    "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'new' ELSE node_id END AS node_id FROM u",
    graph=False,
)
def vector_upsert(w: Workspace):
    rows = w.table("code_vectors")
    new = rows.where(F.col("vec_id") % 5 == 0).withColumn("node_id", F.lit("new"))
    return table(w).upserted(new).select("vec_id", "node_id")


@query(
    f"WITH {V}, u AS (SELECT DISTINCT vec_id FROM v WHERE len(embedding) = 128) SELECT len(embedding) AS dim, count(*) AS n FROM v GROUP BY 1", graph=False
)
def vector_dimensions(w: Workspace):
    return table(w).frame.select(F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim")).groupBy("dim").agg(F.count("*").alias("n"))


@query(
    f"WITH {V}, nn AS (SELECT id, max(repository_path) AS repository_path FROM nodes WHERE id IS NOT NULL GROUP BY 1), j AS (SELECT v.*, nn.repository_path FROM v LEFT JOIN nn ON nn.id = v.node_id), "
    f"s AS (SELECT a.vec_id AS query, b.vec_id AS id, round({COS}, 6) AS score FROM j a, j b WHERE a.vec_id % 20 = 0 AND NOT coalesce(a.repository_path = b.repository_path, false)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) SELECT query, id, score, rank FROM r WHERE rank <= 5",
    graph=False,
)
def similar_in_other_projects(w: Workspace):
    """The best in other repositories; a vector without repository belongs to none and counts."""
    where = w.graph.nodes.select(F.col("id").alias("node_id"), F.col("repository_path").alias("label"))
    base = table(w).frame.join(where, "node_id", "left").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    ask = base.where(F.col("id") % 20 == 0).select(F.col("id").alias("query"), "v", "label")
    return op.top_k(op.compared(ask, base, 5), "query", "score", "id", 5)


@query(
    TOP.format("") + ", n1 AS (SELECT query, id, rank FROM r WHERE rank <= 15), n2 AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY id) AS rank FROM n1), "
    "u AS (SELECT query, id, 1.0 / (60 + rank) AS part FROM n1 UNION ALL SELECT query, id, 1.0 / (60 + rank) FROM n2), t AS (SELECT query, id, round(sum(part::DOUBLE), 8) AS score FROM u GROUP BY ALL) "
    "SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM t",
    graph=False,
)
def rank_fusion(w: Workspace):
    """The best fifteen by cosine fused with the same in the order of their ids."""
    from pyspark.sql import Window

    first = cut(table(w).top(asked(w), 15))  # read twice
    second = first.select("query", "id").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("id")))
    return op.fuse([first, second])
