"""Aggregates over the graph: dead code, coupling, cohesion, counts, dependencies.

Degrees are counted on the edges first and joined to the nodes afterwards, so a
hot target is one row when it meets them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions import paths
from codeloom.graph import Graph, Scope

# Names that run without a caller, and prefixes that say so.
STARTERS = ("main", "new", "default", "drop", "fmt", "from")
ENTRY_PREFIXES = ("test_", "test", "_", "handle", "on_", "get_", "set_", "setup", "run", "main")


def degrees(g: Graph) -> DataFrame:
    """``id, callers, callees``: distinct resolved calls in and out of every function that has any."""
    c = g.calls
    both = c.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(c.select("src", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("i").alias("callers"), F.sum("o").alias("callees"))


def with_degrees(g: Graph) -> DataFrame:
    return g.callables.join(degrees(g), "id", "left").fillna(0, ["callers", "callees"])


def dead_code(g: Graph, starters: Sequence[str] = STARTERS, limit: int | None = None) -> DataFrame:
    """``id, name, path, callees``: functions nobody calls, and whose names are not started from outside."""
    found = with_degrees(g).where((F.col("callers") == 0) & ~F.lower("name").isin(*starters)).select("id", "name", "path", "callees")
    return found if limit is None else found.orderBy(F.desc("callees"), "path", "name", "id").limit(limit)


def dead_code_scoped(g: Graph, scope: Scope, prefixes: Sequence[str] = ENTRY_PREFIXES) -> DataFrame:
    """``id, name, path``: functions of a scope that no call names, prefixes of entry points aside."""
    named = g.call_sites.where(scope.of()).select(F.col("callee_name").alias("name")).distinct()
    outside = F.lit(True)
    for p in prefixes:
        outside = outside & ~F.lower("name").startswith(p)
    return g.callables.where(scope.of() & outside).join(named, "name", "left_anti").select("id", "name", "path")


def dead_code_everywhere(g: Graph) -> DataFrame:
    """``id, name, repository_path``: functions whose name no call of any repository holds."""
    named = g.call_sites.select(F.col("callee_name").alias("name")).distinct()
    return g.callables.join(named, "name", "left_anti").select("id", "name", "repository_path")


def entry_points(g: Graph) -> DataFrame:
    """``id, name, path``: functions without callers that a name marks as an entry."""
    n = F.lower("name")
    rule = n.isin("main", "run", "start", "init", "setup", "handler", "index") | n.startswith("handle") | n.startswith("on_") | n.startswith("run") | n.startswith("start")
    return with_degrees(g).where((F.col("callers") == 0) & rule).select("id", "name", "path")


def analyze_module(g: Graph) -> DataFrame:
    """``module, functions, fan_in, fan_out, coupling``: names called in from other folders, and called out of this one.

    Calls are counted by name and caller, resolved or not: ``fan_out`` distinct
    names that a module calls and does not define, ``fan_in`` distinct callers
    elsewhere of the names it defines.
    """
    f = g.callables.select("id", "name", "repository_path", "branch", paths.module("path").alias("module"))
    size = f.groupBy("module").agg(F.countDistinct("id").alias("functions"))
    sites = g.call_sites.join(f.select(F.col("id").alias("src"), F.col("module").alias("from_module")), "src")
    own = f.select("module", F.col("name").alias("callee_name"), "repository_path", "branch").distinct()
    out = (
        sites.select(F.col("from_module").alias("module"), "callee_name", "repository_path", "branch").distinct()
        .join(own, ["module", "callee_name", "repository_path", "branch"], "left_anti")
        .groupBy("module").agg(F.countDistinct("callee_name").alias("fan_out"))
    )
    into = (
        sites.join(own, ["callee_name", "repository_path", "branch"]).where(F.col("module") != F.col("from_module"))
        .groupBy("module").agg(F.countDistinct("src").alias("fan_in"))
    )
    joined = size.join(out, "module", "left").join(into, "module", "left").fillna(0, ["fan_in", "fan_out"])
    return joined.select("module", "functions", "fan_in", "fan_out", (F.col("fan_in") + F.col("fan_out")).alias("coupling"))


def repository_stats(g: Graph) -> DataFrame:
    """``repository_path, files, functions, methods, classes, lines``: what each repository holds; lines as the files' line ends."""
    lines = F.when(F.col("kind") == "FILE", F.length("source") - F.length(F.replace("source", F.lit("\n"), F.lit(""))))
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return g.nodes.where(F.col("repository_path").isNotNull()).groupBy("repository_path").agg(
        count("FILE").alias("files"), count("FUNCTION").alias("functions"), count("METHOD").alias("methods"), count("CLASS").alias("classes"),
        F.coalesce(F.sum(lines), F.lit(0)).alias("lines"),
    )


def branch_stats(g: Graph, scope: Scope) -> DataFrame:
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return g.nodes.where(scope.of()).agg(
        F.count("*").alias("nodes"), count("FILE").alias("files"), count("FUNCTION").alias("functions"), count("CLASS").alias("classes"), count("METHOD").alias("methods")
    )


def count_by_kind(g: Graph) -> DataFrame:
    return g.nodes.groupBy("kind").agg(F.count("*").alias("n"))


def repositories(g: Graph) -> DataFrame:
    """``repository_path, branch, nodes, files, functions, classes, complexity``: the indexed repositories and branches."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return g.nodes.where(F.col("repository_path").isNotNull()).groupBy("repository_path", "branch").agg(
        F.count("*").alias("nodes"), count("FILE").alias("files"), count("FUNCTION").alias("functions"), count("CLASS").alias("classes"),
        F.round(F.avg("cyclomatic_complexity"), 6).alias("complexity"),
    )


def similar_across(g: Graph, least: int = 2) -> DataFrame:
    """``name, kind, repositories, copies``: symbols that at least so many repositories define."""
    s = g.of_kind("FUNCTION", "METHOD", "CLASS").where(F.col("repository_path").isNotNull())
    per = s.groupBy("name", "kind", "repository_path").agg(F.count("*").alias("copies"))
    return per.groupBy("name", "kind").agg(F.count("*").alias("repositories"), F.sum("copies").alias("copies")).where(F.col("repositories") >= least)


def shared_dependencies(g: Graph, least: int = 2) -> DataFrame:
    """``module, repositories, imports``: modules that files of at least so many repositories import."""
    who = g.nodes.select(F.col("id").alias("src"), "repository_path")
    per = g.links("IMPORTS").join(who, "src").groupBy("dst", "repository_path").agg(F.count("*").alias("imports"))
    out = per.groupBy(F.regexp_replace("dst", "^module:", "").alias("module")).agg(F.count("*").alias("repositories"), F.sum("imports").alias("imports"))
    return out.where(F.col("repositories") >= least)


def unused_imports(g: Graph) -> DataFrame:
    """``id, module``: imports whose module's last name the file's source holds but once or never; files without source are not judged."""
    files = g.of_kind("FILE").where(F.col("source").isNotNull()).select("id", "source")
    imports = g.links("IMPORTS").select(F.col("src").alias("id"), F.regexp_replace("dst", "^module:", "").alias("module"))
    last = F.substring_index(F.substring_index("module", ".", -1), "::", -1)
    times = (F.length("source") - F.length(F.replace("source", last, F.lit("")))) / F.length(last)
    return imports.join(files, "id").where(times <= 1).select("id", "module")


def coupling(g: Graph) -> DataFrame:
    """``module, ca, ce, instability``: distinct other folders that import a folder's files or that its files import, by name.

    A folder is imported where an imported module's name is the stem of one of
    its files in the same repository.
    """
    f = g.of_kind("FILE").select("id", paths.module("path").alias("module"), "repository_path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("stem"))
    imports = g.links("IMPORTS").select(F.col("src").alias("id"), F.element_at(F.split(F.regexp_replace("dst", "^module:", ""), r"[.:/]+"), -1).alias("stem"))
    source = imports.join(f.select("id", F.col("module").alias("from_module"), "repository_path"), "id").select("from_module", "repository_path", "stem").distinct()
    target = f.select("module", "repository_path", "stem").distinct()
    pairs = source.join(target, ["repository_path", "stem"]).where(F.col("module") != F.col("from_module")).select("from_module", "module").distinct()
    ca = pairs.groupBy("module").agg(F.count("*").alias("ca"))
    ce = pairs.groupBy(F.col("from_module").alias("module")).agg(F.count("*").alias("ce"))
    every = f.select("module").distinct().join(ca, "module", "left").join(ce, "module", "left").fillna(0, ["ca", "ce"])
    total = F.col("ca") + F.col("ce")
    return every.withColumn("instability", F.round(F.when(total > 0, F.col("ce") / total).otherwise(0.0), 6))


def call_coupling(g: Graph) -> DataFrame:
    """``module, ca, ce, instability`` by the names that folders call of each other within a repository."""
    f = g.callables.select("id", "name", "repository_path", paths.module("path").alias("module"))
    calls = g.call_sites.join(f.select(F.col("id").alias("src"), F.col("module").alias("from_module")), "src").select("from_module", "repository_path", F.col("callee_name").alias("name")).distinct()
    pairs = calls.join(f.select("name", "repository_path", "module").distinct(), ["repository_path", "name"]).where(F.col("module") != F.col("from_module"))
    pairs = pairs.select("from_module", "module").distinct()
    both = pairs.select("module", F.lit(1).alias("a"), F.lit(0).alias("e")).union(pairs.select("from_module", F.lit(0), F.lit(1)))
    sums = both.groupBy("module").agg(F.sum("a").alias("ca"), F.sum("e").alias("ce"))
    every = f.select("module").distinct().join(sums, "module", "left").fillna(0, ["ca", "ce"])
    total = F.col("ca") + F.col("ce")
    return every.withColumn("instability", F.round(F.when(total > 0, F.col("ce") / total).otherwise(0.0), 6))


def unstable(modules: DataFrame) -> DataFrame:
    """Modules that are unstable (above 0.7), or depended upon although nearly everything depends on them (below 0.3)."""
    i = F.col("instability")
    return modules.where((i > 0.7) | ((i < 0.3) & (F.col("ca") > 0)))


def system_coupling(modules: DataFrame) -> DataFrame:
    return modules.agg(F.count("*").alias("modules"), F.round(F.avg("instability"), 6).alias("score"))


def cohesion_type(score: Column) -> Column:
    """Seven levels of cohesion by thresholds."""
    out = None
    for least, name in ((0.9, "functional"), (0.75, "sequential"), (0.6, "communicational"), (0.5, "procedural"), (0.4, "temporal"), (0.2, "logical")):
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("coincidental")


def cohesion(members: DataFrame, uses: DataFrame) -> DataFrame:
    """``class_id, methods, pairs, score, cohesion``: the share of a class's method pairs that use a name in common.

    ``members`` is ``class_id, method_id``, ``uses`` is ``method_id, name``.
    Pairs are found over the shared names, not by crossing methods; a class with
    fewer than two methods scores 1.
    """
    size = members.groupBy("class_id").agg(F.countDistinct("method_id").alias("methods"))
    used = members.join(uses, "method_id").select("class_id", "name", "method_id").distinct()
    a, b = used.withColumnRenamed("method_id", "a"), used.withColumnRenamed("method_id", "b")
    pairs = a.join(b, ["class_id", "name"]).where(F.col("a") < F.col("b")).select("class_id", "a", "b").distinct().groupBy("class_id").agg(F.count("*").alias("pairs"))
    joined = size.join(pairs, "class_id", "left").fillna(0, ["pairs"])
    every = F.col("methods") * (F.col("methods") - 1) / 2
    score = F.round(F.when(F.col("methods") > 1, F.col("pairs") / every).otherwise(1.0), 6)
    return joined.withColumn("score", score).withColumn("cohesion", cohesion_type(F.col("score")))


def symbol_index(g: Graph) -> DataFrame:
    """``name, definitions, callers, modules``: for every name, where it is defined and who calls it."""
    d = g.callables.where(F.col("name").isNotNull()).groupBy("name").agg(F.countDistinct("id").alias("definitions"), F.countDistinct(paths.module("path")).alias("modules"))
    c = g.call_sites.groupBy(F.col("callee_name").alias("name")).agg(F.countDistinct("src").alias("callers"))
    return d.join(c, "name", "full").fillna(0, ["definitions", "callers", "modules"])


def most_complex(g: Graph, n: int, kinds: Sequence[str] | None = None, above: int = 0) -> DataFrame:
    """``id, name, path, complexity``: the n most complex nodes; a missing complexity is 1."""
    base = g.nodes if kinds is None else g.of_kind(*kinds)
    c = base.select("id", "name", "path", F.coalesce("cyclomatic_complexity", F.lit(1)).alias("complexity")).where(F.col("complexity") > above)
    return c.orderBy(F.desc("complexity"), "path", "name", "id").limit(n)


def hot_paths(scored: DataFrame, n: int = 10, parent: float = 0.8) -> DataFrame:
    """``place, score``: the n places with the greatest summed score; a file gives its folder a share."""
    here = scored.select(F.col("path").alias("place"), "score")
    above = scored.select(paths.module("path").alias("place"), (F.col("score") * parent).alias("score"))
    return here.unionByName(above).groupBy("place").agg(F.round(F.sum("score"), 6).alias("score")).orderBy(F.desc("score"), "place").limit(n)
