"""The graph kernel on a dense graph: parts that follow each other in an order.

The call edges of the code tables resolve sparsely; here each part calls the
part on the next line of an order (29,000 edges over 2,000 parts at the smallest
scale that is checked), which has cycles and hubs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeloom.operators import traversal as tr
from codeloom.plans.registry import Workspace, query

G = (
    "WITH RECURSIVE l AS (SELECT l_orderkey AS o, l_linenumber AS i, l_partkey AS p, l_quantity AS q, l_returnflag AS f FROM lineitem), "
    "c AS MATERIALIZED (SELECT DISTINCT 'p' || a.p AS src, 'p' || b.p AS dst FROM l a JOIN l b ON a.o = b.o AND b.i = a.i + 1 WHERE {}), v AS (SELECT DISTINCT src AS id FROM c UNION SELECT dst FROM c) "
)
DENSE, MEDIUM, SPARSE = G.format("true"), G.format("a.f = 'R' AND b.f = 'R'"), G.format("a.q >= 48 AND b.q >= 48")


def edges(w: Workspace, rule=None) -> DataFrame:
    l = w.table("lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), F.col("l_partkey")).alias("p"), "l_quantity", "l_returnflag")
    if rule is not None:
        l = l.where(rule)
    a = l.select("l_orderkey", "l_linenumber", F.col("p").alias("src"))
    b = l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("p").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).select("src", "dst").distinct()


def medium(w: Workspace) -> DataFrame:
    return edges(w, F.col("l_returnflag") == "R")


def sparse(w: Workspace) -> DataFrame:
    return edges(w, F.col("l_quantity") >= 48)


def ids(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()


@query(DENSE + "SELECT v.id, (SELECT count(*) FROM c WHERE dst = v.id) AS fan_in, (SELECT count(*) FROM c WHERE src = v.id) AS fan_out FROM v", graph=False)
def dense_degrees(w: Workspace):
    return tr.degree_centrality(edges(w), ids(edges(w))).select("id", F.col("in_degree").alias("fan_in"), F.col("out_degree").alias("fan_out"))


CLOSURE = ", r AS (SELECT src AS root, dst AS id, 1 AS depth FROM c UNION SELECT r.root, c.dst, r.depth + 1 FROM r JOIN c ON c.src = r.id WHERE r.depth < {}) "


@query(MEDIUM + CLOSURE.format(3) + "SELECT root, id, min(depth) AS depth FROM r GROUP BY ALL", graph=False)
def dense_closure(w: Workspace):
    e = medium(w)
    return tr.closure(e, e.select(F.col("src").alias("root")), 3)


@query(SPARSE + CLOSURE.format(20) + "SELECT root, id, min(depth) AS depth FROM r GROUP BY ALL", graph=False)
def sparse_closure(w: Workspace):
    e = sparse(w)
    return tr.closure(e, e.select(F.col("src").alias("root")), 20)


PATHS = ", p AS (SELECT src AS root, dst AS id, 1 AS depth, [src, dst] AS nodes FROM c WHERE src <> dst UNION ALL SELECT p.root, c.dst, p.depth + 1, list_append(p.nodes, c.dst) FROM p JOIN c ON c.src = p.id WHERE p.depth < 6 AND NOT list_contains(p.nodes, c.dst)) "


@query(SPARSE + PATHS + "SELECT root, id, depth, array_to_string(nodes, ' > ') AS path FROM p", graph=False)
def sparse_paths(w: Workspace):
    e = sparse(w)
    p = tr.simple_paths(e, e.select(F.col("src").alias("root")), 6)
    return p.select("root", "id", "depth", F.array_join("nodes", tr.ARROW).alias("path"))


@query(
    SPARSE + PATHS + ", s AS (SELECT root, id, depth, min(array_to_string(nodes, ' > ')) AS path, min(depth) OVER (PARTITION BY root, id) AS least FROM p GROUP BY root, id, depth) SELECT root, id, depth, path FROM s WHERE depth = least",
    graph=False,
)
def sparse_shortest(w: Workspace):
    e = sparse(w)
    return tr.shortest_paths(e, e.select(F.col("src").alias("root")), 6)


@query(
    MEDIUM + ", y AS (SELECT src AS root, dst AS id, [src, dst] AS nodes, 2 AS length FROM c WHERE src < dst UNION ALL SELECT y.root, c.dst, list_append(nodes, c.dst), length + 1 FROM y JOIN c ON c.src = y.id WHERE length < 4 AND c.dst > y.root AND NOT list_contains(nodes, c.dst)) "
    "SELECT DISTINCT array_to_string(list_sort(nodes), ' > ') AS members, length FROM y WHERE EXISTS (SELECT 1 FROM c WHERE c.src = y.id AND c.dst = y.root) UNION SELECT src, 1 FROM c WHERE src = dst",
    graph=False,
)
def dense_cycles(w: Workspace):
    return tr.cycles(medium(w), 4)


@query(
    MEDIUM + ", one AS (SELECT DISTINCT dst AS id, src AS caller FROM c), two AS (SELECT DISTINCT a.id, b.caller FROM one a JOIN one b ON a.caller = b.id), three AS (SELECT DISTINCT a.id, b.caller FROM two a JOIN one b ON a.caller = b.id), "
    "near AS (SELECT id, caller, min(depth) AS depth FROM (SELECT *, 1 AS depth FROM one UNION ALL SELECT *, 2 FROM two UNION ALL SELECT *, 3 FROM three) GROUP BY ALL), d AS (SELECT dst AS id, count(*) AS d1_count FROM c GROUP BY 1) "
    "SELECT near.id, any_value(d.d1_count) AS d1_count, count(*) FILTER (depth <= 2) AS d2_count, count(*) AS d3_count, array_to_string(list(caller ORDER BY depth, caller)[1:64], ',') AS ids, count(*) > 64 AS truncated FROM near JOIN d ON d.id = near.id GROUP BY near.id",
    graph=False,
)
def dense_reach(w: Workspace):
    return tr.reach_index(medium(w))


def _rank_sql(n: int) -> str:
    s = ["deg AS (SELECT src, count(*) AS d FROM c GROUP BY 1)", "m AS (SELECT count(*)::DOUBLE AS n FROM v)", "r0 AS MATERIALIZED (SELECT v.id, 1.0 / m.n AS score, deg.d FROM v CROSS JOIN m LEFT JOIN deg ON deg.src = v.id)"]
    for i in range(n):
        s.append(
            f"r{i + 1} AS MATERIALIZED (SELECT r.id, 0.15 / m.n + 0.85 * l.loose / m.n + 0.85 * coalesce(x.got, 0) AS score, r.d FROM r{i} r CROSS JOIN m CROSS JOIN (SELECT coalesce(sum(score), 0) AS loose FROM r{i} WHERE d IS NULL) l "
            f"LEFT JOIN (SELECT c.dst, sum(q.score / q.d) AS got FROM c JOIN r{i} q ON q.id = c.src GROUP BY 1) x ON x.dst = r.id)"
        )
    return DENSE + ", " + ", ".join(s) + f" SELECT id, round(score, 8) AS score FROM r{n}"


@query(_rank_sql(20), graph=False)
def dense_pagerank(w: Workspace):
    e = edges(w)
    return tr.pagerank(e, ids(e)).select("id", F.round("score", 8).alias("score"))


@query(DENSE + ", i AS (SELECT dst AS id, count(*) AS k FROM c GROUP BY 1) SELECT id FROM v WHERE id NOT IN (SELECT id FROM i)", graph=False)
def dense_dead(w: Workspace):
    e = edges(w)
    return ids(e).join(e.select(F.col("dst").alias("id")), "id", "left_anti")
