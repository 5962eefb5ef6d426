"""Queries for clones and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import clones as op
from codeloom.plans.registry import Workspace, query

SETS = "s AS (SELECT DISTINCT id AS key, list_sort(list_distinct(list_filter(tokens, lambda t: t IS NOT NULL))) AS items FROM function_bodies WHERE id IS NOT NULL AND len(list_filter(tokens, lambda t: t IS NOT NULL)) >= 50)"
HASH = "(('0x' || substr(md5({0}), 1, 15))::BIGINT % 2147483647)"
COEFF = "[" + ", ".join(f"{{'a': {a}::BIGINT, 'b': {b}::BIGINT}}" for a, b in map(tx.coefficients, range(tx.SLOTS))) + "]"
SIGNED = (
    f"WITH {SETS}, k AS (SELECT sha1(array_to_string(items, chr(31))) AS class, any_value(items) AS items FROM s GROUP BY 1), h AS (SELECT class, items, list_transform(items, lambda x: {HASH.format('x')}) AS h FROM k), "
    f"g AS MATERIALIZED (SELECT class, items, list_transform({COEFF}, lambda p: list_min(list_transform(h, lambda x: (p.a * x + p.b) % 2147483647))) AS sig FROM h), "
    "bd AS (SELECT class, i || ':' || array_to_string(sig[i * 4 + 1:i * 4 + 4], ',') AS band FROM g, range(16) r(i)), pr AS (SELECT DISTINCT x.class AS a, y.class AS b FROM bd x JOIN bd y ON x.band = y.band AND x.class < y.class), "
    "e AS (SELECT a, b, list_sum(list_transform(list_zip(x.sig, y.sig), lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END)) / 64.0 AS estimate, "
    "len(list_intersect(x.items, y.items)) / len(list_distinct(list_concat(x.items, y.items))) AS jaccard FROM pr JOIN g x ON x.class = a JOIN g y ON y.class = b) "
)


@query(SIGNED + "SELECT a, b, round(estimate::DOUBLE, 6) AS estimate, round(jaccard, 6) AS jaccard FROM e WHERE estimate >= 0.85", graph=False)
def find_clone_pairs(w: Workspace):
    pairs, _ = op.similar_classes(w.table("function_bodies"), "id", "tokens", 0.85)
    return pairs


@query(SIGNED + ", m AS (SELECT a AS class FROM e WHERE estimate >= 0.85 UNION ALL SELECT b FROM e WHERE estimate >= 0.85) SELECT s.key, sha1(array_to_string(s.items, chr(31))) AS class, (SELECT count(*) FROM m WHERE m.class = sha1(array_to_string(s.items, chr(31)))) AS links FROM s", graph=False)
def clone_index(w: Workspace):
    """Every body with its class and how many other classes are clones of it."""
    pairs, members = op.similar_classes(w.table("function_bodies"), "id", "tokens", 0.85)
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(ends, "class", "left").fillna(0, ["links"]).select("key", "class", "links")


@query(f"WITH {SETS} SELECT sha1(array_to_string(items, chr(31))) AS class, count(DISTINCT key) AS copies, min(key) AS first FROM s GROUP BY 1", graph=False)
def clone_groups(w: Workspace):
    return op.clone_groups(w.table("function_bodies"), "id", "tokens")


@query("SELECT src, dst, round(max(jaccard), 6) AS jaccard FROM e WHERE kind = 'SIMILAR_TO' AND jaccard >= 0.9 GROUP BY ALL")
def find_clones(w: Workspace):
    e = w.graph.edges.where((F.col("kind") == "SIMILAR_TO") & (F.col("jaccard") >= 0.9))
    return e.groupBy("src", "dst").agg(F.round(F.max("jaccard"), 6).alias("jaccard"))


@query(
    "WITH c AS (SELECT DISTINCT least(id_a, id_b) AS a, greatest(id_a, id_b) AS b FROM clone_candidates WHERE id_a IS NOT NULL AND id_b IS NOT NULL AND id_a <> id_b), "
    "t AS (SELECT id, max(list_sort(list_distinct(list_filter(tokens, lambda t: t IS NOT NULL)))) AS t FROM function_bodies WHERE id IS NOT NULL GROUP BY 1) "
    "SELECT a, b, round(CASE WHEN len(list_distinct(list_concat(x.t, y.t))) > 0 THEN len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) ELSE 0.0 END, 6) AS jaccard "
    "FROM c JOIN t x ON x.id = a JOIN t y ON y.id = b WHERE x.t IS NOT NULL AND y.t IS NOT NULL",
    graph=False,
)
def verify_candidates(w: Workspace):
    """The true similarity of pairs that an earlier run estimated."""
    c = w.table("clone_candidates").where(F.col("id_a").isNotNull() & F.col("id_b").isNotNull() & (F.col("id_a") != F.col("id_b")))
    pairs = c.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
    items = F.array_sort(F.array_distinct(F.filter("tokens", lambda t: t.isNotNull())))
    t = w.table("function_bodies").where(F.col("id").isNotNull()).groupBy("id").agg(F.max(items).alias("t")).where(F.col("t").isNotNull())
    both = pairs.join(t.select(F.col("id").alias("a"), F.col("t").alias("x")), "a").join(t.select(F.col("id").alias("b"), F.col("t").alias("y")), "b")
    return both.select("a", "b", F.round(tx.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


FILES = "s AS (SELECT id, source FROM n WHERE kind = 'FILE' AND source IS NOT NULL)"
LINES = "l AS (SELECT id, unnest(string_split(source, chr(10))) AS line FROM s), k AS (SELECT id, md5(trim(regexp_replace(line, '[ \\t\\r]+', ' ', 'g'))) AS line, length(trim(regexp_replace(line, '[ \\t\\r]+', ' ', 'g'))) AS n FROM l)"


def files(w: Workspace):
    return w.graph.of_kind("FILE").where(F.col("source").isNotNull()).select("id", "source")


@query(f"{FILES}, {LINES};; SELECT line, count(DISTINCT id) AS files, count(*) AS times FROM k WHERE n >= 12 GROUP BY 1 HAVING count(*) > 1")
def duplicate_lines(w: Workspace):
    return op.repeated_lines(files(w), "id", "source")


WINDOWS = (
    f"{FILES}, t AS (SELECT id, list_transform(string_split(source, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS l FROM s), "
    "w AS (SELECT id, i AS start, md5(array_to_string(l[i:i + 5], chr(10))) AS block FROM (SELECT id, l, unnest(range(1, len(l) - 4)) AS i FROM t WHERE len(l) >= 6))"
)


@query(f"{WINDOWS};; SELECT block, count(*) AS places, count(DISTINCT id) AS files FROM w GROUP BY 1 HAVING count(*) > 1")
def find_duplicates(w: Workspace):
    return op.duplicate_blocks(files(w), "id", "source")


@query(f"{WINDOWS};; SELECT id, block, count(*) AS places FROM w GROUP BY ALL HAVING count(*) > 1")
def find_duplicates_in_file(w: Workspace):
    return op.duplicates_in_file(files(w), "id", "source")


@query(
    f"{WINDOWS}, sh AS (SELECT block FROM w GROUP BY 1 HAVING count(*) > 1), cv AS (SELECT DISTINCT id, unnest(range(start, start + 6)) AS line FROM w WHERE block IN (SELECT block FROM sh)), "
    "p AS (SELECT id, count(*) AS duplicated FROM cv GROUP BY 1);; SELECT t.id, len(l) AS lines, coalesce(duplicated, 0) AS duplicated, round(coalesce(duplicated, 0) / len(l), 6) AS share FROM t LEFT JOIN p ON p.id = t.id"
)
def duplication_percentage(w: Workspace):
    return op.duplication_share(files(w), "id", "source")


@query(f"{WINDOWS};; SELECT count(*) AS windows, count(DISTINCT block) AS blocks FROM w")
def sliding_line_windows(w: Workspace):
    return op.windows(files(w), "id", "source", 6).agg(F.count("*").alias("windows"), F.countDistinct("block").alias("blocks"))
