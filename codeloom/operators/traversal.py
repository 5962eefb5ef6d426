"""Walking the graph: closures, shortest paths, simple paths, cycles, reach.

All walks are frontier joins: the nodes of one level meet the edges, what was
seen before is taken out with an anti join on (root, node), and the lineage is
cut after each level, so a walk holds one row for each root and node it reaches
and ends on cycles.  Nothing of it comes to the driver but whether a level is
empty.  Edges are ``src, dst``; self-loops and repeated edges are harmless.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from codeloom.session import cut

#: Between the nodes of a path as text; lower than any character of an id, so paths sort by their nodes.
ARROW = " > "


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def closure(edges: DataFrame, roots: DataFrame, max_depth: int, itself: bool = False) -> DataFrame:
    """``root, id, depth``: the nodes that each root reaches in at most so many steps, with the least number of steps.

    ``roots`` is ``root``.  The root is only in it at depth 0 with ``itself``,
    else where a cycle leads back to it.
    """
    links = edges.select("src", "dst").distinct()
    start = roots.select("root").distinct()
    frontier = start.select("root", F.col("root").alias("id"))
    levels = [frontier.withColumn("depth", F.lit(0))] if itself else []
    seen = frontier if itself else None
    for depth in range(1, max_depth + 1):
        step = frontier.join(links, frontier["id"] == links["src"]).select("root", F.col("dst").alias("id")).distinct()
        if seen is not None:
            step = step.join(seen, ["root", "id"], "left_anti")
        frontier = cut(step)
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(depth)))
        seen = frontier if seen is None else seen.unionByName(frontier)
    if not levels:
        return frontier.withColumn("depth", F.lit(0))
    return reduce(DataFrame.unionByName, levels)


def shortest_paths(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """``root, id, depth, path``: one shortest path to each node reached, the first of them in the order of their ids."""
    links = edges.select("src", "dst").distinct()
    frontier = roots.select("root", F.col("root").alias("id"), F.col("root").alias("path")).distinct()
    seen, levels = frontier.select("root", "id"), []
    for depth in range(1, max_depth + 1):
        step = (
            frontier.join(links, frontier["id"] == links["src"])
            .select("root", F.col("dst").alias("id"), F.concat("path", F.lit(ARROW), "dst").alias("path"))
            .groupBy("root", "id")
            .agg(F.min("path").alias("path"))
            .join(seen, ["root", "id"], "left_anti")
        )
        frontier = cut(step)
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier.select("root", "id"))
    if not levels:
        return frontier.withColumn("depth", F.lit(0)).select("root", "id", "depth", "path")
    return reduce(DataFrame.unionByName, levels).select("root", "id", "depth", "path")


def simple_paths(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """``root, id, depth, nodes``: every path without a repeated node, of 1 to ``max_depth`` steps.

    Their number grows with the power of the depth; it is for few roots or a
    small depth.
    """
    links = edges.select("src", "dst").distinct()
    frontier = roots.select("root", F.col("root").alias("id"), F.array("root").alias("nodes")).distinct()
    levels = []
    for depth in range(1, max_depth + 1):
        step = (
            frontier.join(links, frontier["id"] == links["src"])
            .where(~F.array_contains("nodes", F.col("dst")))
            .select("root", F.col("dst").alias("id"), F.array_append("nodes", F.col("dst")).alias("nodes"))
        )
        frontier = cut(step)
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(depth)))
    if not levels:
        return frontier.withColumn("depth", F.lit(0)).select("root", "id", "depth", "nodes")
    return reduce(DataFrame.unionByName, levels).select("root", "id", "depth", "nodes")


def cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """``members, length``: simple cycles of at most so many nodes, once for each set of nodes, their ids sorted and joined.

    A cycle is walked from its least node only, and never below it.
    """
    links = edges.select("src", "dst").distinct()
    loops = links.where(F.col("src") == F.col("dst")).select(F.col("src").alias("members"), F.lit(1).alias("length"))
    found = [loops]
    frontier = links.where(F.col("src") < F.col("dst")).select(F.col("src").alias("root"), F.col("dst").alias("id"), F.array("src", "dst").alias("nodes"))
    back = links.select(F.col("src").alias("id"), F.col("dst").alias("root"))
    for length in range(2, max_length + 1):
        frontier = cut(frontier)
        if frontier.isEmpty():
            break
        closed = frontier.join(back, ["id", "root"]).select(F.array_join(F.array_sort("nodes"), ARROW).alias("members"), F.lit(length).alias("length"))
        found.append(closed)
        frontier = (
            frontier.join(links, frontier["id"] == links["src"])
            .where((F.col("dst") > F.col("root")) & ~F.array_contains("nodes", F.col("dst")))
            .select("root", F.col("dst").alias("id"), F.array_append("nodes", F.col("dst")).alias("nodes"))
        )
    return reduce(DataFrame.unionByName, found).distinct()


def reach_index(edges: DataFrame, keep: int | None = 64) -> DataFrame:
    """``id, d1_count, d2_count, d3_count, ids, truncated`` of every called symbol: who reaches it within three calls.

    ``d1_count`` counts the calls themselves, repeated ones too; the others
    count distinct callers by their least distance.  ``ids`` holds the nearest
    callers, in the order of distance and id, at most ``keep`` of them, and
    ``truncated`` says whether there are more: the index entry is bounded by
    design, the counts are not.  A symbol on a cycle may reach itself.
    """
    direct = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("d1_count"))
    one = edges.select(F.col("dst").alias("id"), F.col("src").alias("caller")).distinct()
    two = one.join(one.select(F.col("id").alias("caller"), F.col("caller").alias("next")), "caller").select("id", F.col("next").alias("caller")).distinct()
    three = two.join(one.select(F.col("id").alias("caller"), F.col("caller").alias("next")), "caller").select("id", F.col("next").alias("caller")).distinct()
    nearest = (
        one.withColumn("depth", F.lit(1))
        .union(two.withColumn("depth", F.lit(2)))
        .union(three.withColumn("depth", F.lit(3)))
        .groupBy("id", "caller")
        .agg(F.min("depth").alias("depth"))
    )
    counted = nearest.groupBy("id").agg(
        F.count_if(F.col("depth") <= 2).alias("d2_count"),
        F.count("*").alias("d3_count"),
        F.array_sort(F.collect_list(F.struct("depth", "caller"))).alias("near"),
    )
    ids = F.transform("near", lambda x: x["caller"])
    return direct.join(counted, "id").select(
        "id", "d1_count", "d2_count", "d3_count",
        F.array_join(ids if keep is None else F.slice(ids, 1, keep), ",").alias("ids"),
        (F.lit(False) if keep is None else F.col("d3_count") > keep).alias("truncated"),
    )


def pagerank(edges: DataFrame, nodes: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """``id, score``: the rank of every node; what nodes without outgoing edges hold is spread over all.

    ``nodes`` is ``id``; edges from or to other ids do not count.  The ranks sum
    to 1.  An empty graph gives no rows.
    """
    ids = cut(nodes.select("id").distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("score", F.lit(0.0))
    inside = (
        edges.select("src", "dst").distinct()
        .join(ids.select(F.col("id").alias("src")), "src", "left_semi")
        .join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    )
    degree = inside.groupBy("src").agg(F.count("*").alias("degree"))
    links = cut(inside.join(degree, "src"))
    ranks = ids.join(degree.withColumnRenamed("src", "id"), "id", "left").select("id", "degree", F.lit(1.0 / n).alias("score"))
    for i in range(iterations):
        ranks = cut(ranks)  # one small row a node
        loose = ranks.where(F.col("degree").isNull()).agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        given = (
            links.join(ranks.select(F.col("id").alias("src"), "score"), "src")
            .groupBy(F.col("dst").alias("id"))
            .agg(F.sum(F.col("score") / F.col("degree")).alias("got"))
        )
        base = (1 - damping) / n + damping * loose / n
        ranks = ranks.select("id", "degree").join(given, "id", "left").select(
            "id", "degree", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("score")
        )
    return ranks.select("id", "score")


def degree_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, in_degree, out_degree, centrality``: (in + out) / (n - 1) over distinct edges; 0 for a single node."""
    ids = nodes.select("id").distinct()
    links = edges.select("src", "dst").distinct()
    both = links.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        links.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    counts = both.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    total = ids.agg(F.count("*").alias("n"))
    return (
        ids.join(counts, "id", "left")
        .select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))
        .join(F.broadcast(total))  # one row
        .select("id", "in_degree", "out_degree", F.when(F.col("n") > 1, (F.col("in_degree") + F.col("out_degree")) / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))
    )


def betweenness(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """``id, paths``: on how many of the chosen shortest paths from these roots a node lies, ends aside."""
    inner = F.slice(F.split("path", ARROW), 2, F.greatest(F.col("depth") - 1, F.lit(0)))
    return shortest_paths(edges, roots, max_depth).select(F.explode(inner).alias("id")).groupBy("id").agg(F.count("*").alias("paths"))
