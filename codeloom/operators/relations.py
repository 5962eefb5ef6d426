"""Joins along edges: callers and callees, usages, definitions, imports, diffs.

The one-hop operators read the resolved calls of the graph.  Ends are joined
after the edges are filtered or made distinct, so a hot target costs its edges
once; names are only brought in at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions import paths
from codeloom.graph import Graph, Scope
from codeloom.operators import traversal

USES = {
    "CALLS": "call", "IMPORTS": "import", "TYPE_REFERENCE": "type_reference", "FIELD_ACCESS": "field_access", "INHERITS": "inheritance",
    "IMPLEMENTS": "implementation",
}


def _ends(g: Graph, prefix: str) -> DataFrame:
    """Nodes as one end of an edge, with all columns under a prefix."""
    names = {c: f"{prefix}_{c}" for c in ("id", "kind", "name", "path", "line_number", "repository_path", "branch")}
    return g.nodes.select(*[F.col(c).alias(a) for c, a in names.items()])


def _named(g: Graph, name: str, scope: Scope | None) -> DataFrame:
    found = g.callables.where(F.col("name") == name)
    return found if scope is None else found.where(scope.of())


def callers(g: Graph, name: str, scope: Scope | None = None) -> DataFrame:
    """``id, name, path, line_number`` of who calls a name, resolved or not; a scope holds for caller and callee alike."""
    sites = g.call_sites.where(F.col("callee_name") == name)
    if scope is not None:
        sites = sites.where(scope.of())
    return g.nodes.join(sites.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select("id", "name", "path", "line_number")


def callees(g: Graph, name: str, scope: Scope | None = None) -> DataFrame:
    """``callee_name, resolved``: the names that the functions of a name call, and to how many functions each resolves."""
    who = _named(g, name, scope).select(F.col("id").alias("src"))
    sites = g.call_sites.join(who, "src", "left_semi")
    target = g.callables.select(F.col("name").alias("callee_name"), "repository_path", "branch", "id")
    return sites.join(target, ["repository_path", "branch", "callee_name"], "left").groupBy("callee_name").agg(F.countDistinct("id").alias("resolved"))


def neighbours(g: Graph, incoming: bool, scope: Scope | None = None, same_scope: bool = True) -> DataFrame:
    """``id, other, other_name, other_path``: for all functions of a scope, who calls them or whom they call."""
    near, far = ("dst", "src") if incoming else ("src", "dst")
    ends = g.callables.select("id", "name", "path", "repository_path", "branch")
    here = ends if scope is None else ends.where(scope.of())
    there = here if same_scope else ends
    return (
        g.calls.join(here.select(F.col("id").alias(near)), near, "left_semi")
        .join(there.select(F.col("id").alias(far), F.col("name").alias("other_name"), F.col("path").alias("other_path")), far)
        .select(F.col(near).alias("id"), F.col(far).alias("other"), "other_name", "other_path")
    )


def all_callers(g: Graph, name: str, depth: int = 20, scope: Scope | None = None) -> DataFrame:
    """``root, id, depth``: who reaches the functions of a name through calls."""
    roots = _named(g, name, scope).select(F.col("id").alias("root"))
    return traversal.closure(traversal.reverse(g.calls), roots, depth)


def all_callees(g: Graph, name: str, depth: int = 20, scope: Scope | None = None) -> DataFrame:
    roots = _named(g, name, scope).select(F.col("id").alias("root"))
    return traversal.closure(g.calls, roots, depth)


def call_chain(g: Graph, source: str, target: str, depth: int = 15) -> DataFrame:
    """``root, id, depth, path``: a shortest chain of calls from each function of one name to each of another."""
    roots = _named(g, source, None).select(F.col("id").alias("root"))
    goals = _named(g, target, None).select("id")
    return traversal.shortest_paths(g.calls, roots, depth).join(goals, "id", "left_semi")


def hierarchy(g: Graph, roots: DataFrame, depth: int = 10, up: bool = True, kinds: tuple[str, ...] = ("INHERITS", "IMPLEMENTS")) -> DataFrame:
    """``root, id, depth``: the ancestors of types (edges go from child to parent), or their descendants; depth 0 is the type."""
    edges = g.links(*kinds)
    return traversal.closure(edges if up else traversal.reverse(edges), roots, depth, itself=True)


def overrides(g: Graph, name: str) -> DataFrame:
    """``id, owner, owner_name``: functions of a name and where they are defined, over DEFINED_IN and MEMBER_OF."""
    who = _named(g, name, None).select(F.col("id").alias("src"))
    owners = g.nodes.select(F.col("id").alias("dst"), F.col("name").alias("owner_name"))
    return g.links("DEFINED_IN", "MEMBER_OF").join(who, "src", "left_semi").join(owners, "dst").select(F.col("src").alias("id"), F.col("dst").alias("owner"), "owner_name")


def owners(g: Graph, name: str) -> DataFrame:
    """``id, owner, owner_path``: the files that contain the functions of a name."""
    who = _named(g, name, None).select(F.col("id").alias("dst"))
    return (
        g.links("CONTAINS").join(who, "dst", "left_semi")
        .join(g.nodes.select(F.col("id").alias("src"), F.col("path").alias("owner_path")), "src")
        .select(F.col("dst").alias("id"), F.col("src").alias("owner"), "owner_path")
    )


def importers(g: Graph, module: str) -> DataFrame:
    """``id, path, module``: files that import a module, by equality, prefix or group."""
    found = g.links("IMPORTS").select("src", F.regexp_replace("dst", "^module:", "").alias("module"))
    found = found.where(paths.import_matches(F.col("module"), module))
    return found.join(g.nodes.select(F.col("id").alias("src"), "path"), "src").select(F.col("src").alias("id"), "path", "module")


def dependency_paths(g: Graph, roots: DataFrame, depth: int = 5, kinds: tuple[str, ...] = ("IMPORTS", "CONTAINS")) -> DataFrame:
    """``root, id, depth, path``: what roots depend on over edges of these kinds."""
    return traversal.shortest_paths(g.links(*kinds), roots, depth)


def variable_scope(g: Graph, kinds: tuple[str, ...]) -> DataFrame:
    """``id, holder, edge_kind``: nodes of some kinds with every edge into them; without any, the holder is null."""
    into = g.edges.select(F.col("dst").alias("id"), F.col("src").alias("holder"), F.col("kind").alias("edge_kind")).distinct()
    return g.of_kind(*kinds).select("id").join(into, "id", "left")


def impact_paths(g: Graph, roots: DataFrame, depth: int) -> DataFrame:
    """``root, id, depth``: what roots touch, going out over calls, types and imports."""
    out = g.calls.unionByName(g.links("INHERITS", "IMPLEMENTS", "IMPORTS"))
    return traversal.closure(out, roots, depth)


def fetch(g: Graph, ids: DataFrame) -> DataFrame:
    """``id, kind, name, path, line_number`` of given ids; unknown ones give no row."""
    return g.nodes.join(ids.select("id").distinct(), "id", "left_semi").select("id", "kind", "name", "path", "line_number")


def impact_graph(g: Graph, roots: DataFrame, depth: int = 3, decay: float = 0.9, most: int | None = None) -> DataFrame:
    """``root, id, relation, depth, confidence``: who is affected when a symbol changes, by the nearest relation.

    Direct callers count before transitive ones, these before importers of the
    symbol's file, these before implementers.  A direct caller has the greatest
    confidence of its calls (1 without one), a transitive one 0.9 to the power
    of the further steps.  ``most`` keeps the first of each root by (relation,
    depth, id), as a budget.
    """
    seeds = roots.select("root").distinct()
    walked = traversal.closure(traversal.reverse(g.calls), seeds, depth)
    sites = g.edges.where(F.col("kind") == "CALLS").groupBy("src", "callee_name").agg(F.max("confidence").alias("confidence"))
    names = g.nodes.select(F.col("id").alias("root"), F.col("name").alias("callee_name"))
    called = walked.join(names, "root").join(sites.withColumnRenamed("src", "id"), ["id", "callee_name"], "left")
    by_call = called.select(
        "root", "id", F.when(F.col("depth") == 1, 1).otherwise(2).alias("priority"), "depth",
        F.when(F.col("depth") == 1, F.coalesce("confidence", F.lit(1.0))).otherwise(F.pow(F.lit(decay), F.col("depth") - 1)).alias("confidence"),
    )
    home = g.links("CONTAINS").select(F.col("dst").alias("root"), F.col("src").alias("file")).join(seeds, "root", "left_semi")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    modules = home.join(g.of_kind("FILE").select(F.col("id").alias("file"), stem.alias("module")), "file")
    imports = g.links("IMPORTS").select(F.col("src").alias("id"), F.regexp_replace("dst", "^module:", "").alias("module"))
    by_import = modules.join(imports, "module").select("root", "id", F.lit(3).alias("priority"), F.lit(1).alias("depth"), F.lit(0.8).alias("confidence"))
    types = g.links("IMPLEMENTS", "INHERITS").select(F.col("dst").alias("root"), F.col("src").alias("id")).join(seeds, "root", "left_semi")
    by_type = types.select("root", "id", F.lit(4).alias("priority"), F.lit(1).alias("depth"), F.lit(0.9).alias("confidence"))
    first = F.min_by(F.struct("priority", "depth", "confidence"), F.struct("priority", "depth", -F.col("confidence")))
    merged = by_call.unionByName(by_import).unionByName(by_type).groupBy("root", "id").agg(first.alias("x")).select("root", "id", "x.*")
    if most is not None:
        order = Window.partitionBy("root").orderBy("priority", "depth", "id")
        merged = merged.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= most)
    names_of = F.element_at(F.array(*[F.lit(x) for x in ("direct_caller", "transitive_caller", "importer", "implementer")]), F.col("priority"))
    return merged.select("root", "id", names_of.alias("relation"), "depth", F.round("confidence", 6).alias("confidence"))


def blast_radius(impact: DataFrame) -> DataFrame:
    """``root, affected, direct, transitive, importers, radius``: low to 5, medium to 20, high above."""
    counts = impact.groupBy("root").agg(
        F.count("*").alias("affected"),
        *[F.count_if(F.col("relation") == r).alias(a) for r, a in (("direct_caller", "direct"), ("transitive_caller", "transitive"), ("importer", "importers"))],
    )
    return counts.withColumn("radius", F.when(F.col("affected") > 20, "high").when(F.col("affected") > 5, "medium").otherwise("low"))


def logic_flow(g: Graph, sources: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """``root, id, length, path, score``: every simple path of calls between two sets, ranked.

    The score is 0.4 / (1 + length) + 0.4 x mean confidence of the calls + 0.1;
    a call without confidence counts as 1.
    """
    sites = g.edges.where(F.col("kind") == "CALLS").groupBy("src", "callee_name").agg(F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"))
    name = g.callables.select(F.col("id").alias("dst"), F.col("name").alias("callee_name"))
    weight = g.calls.join(name, "dst").join(sites, ["src", "callee_name"], "left").select("src", "dst", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
    found = traversal.simple_paths(g.calls, sources, depth).join(targets.select("id"), "id", "left_semi")
    step = found.select("root", "id", "nodes", "depth", F.posexplode(F.slice("nodes", 1, F.size("nodes") - 1)).alias("i", "src"))
    step = step.withColumn("dst", F.element_at("nodes", F.col("i") + 2)).join(weight, ["src", "dst"])
    per_path = step.groupBy("root", "id", "depth", F.array_join("nodes", traversal.ARROW).alias("path")).agg(F.avg("confidence").alias("mean"))
    score = F.lit(0.4) / (1 + F.col("depth")) + 0.4 * F.col("mean") + 0.1
    return per_path.select("root", "id", F.col("depth").alias("length"), "path", F.round(score, 6).alias("score"))


def blockers(g: Graph, scope: Scope | None = None) -> DataFrame:
    """``id, reason``: functions from or to which no chain leads, and why: no resolved callee, no caller, or neither."""
    f = g.callables if scope is None else g.callables.where(scope.of())
    out = g.calls.select(F.col("src").alias("id")).distinct().withColumn("calls", F.lit(True))
    into = g.calls.select(F.col("dst").alias("id")).distinct().withColumn("called", F.lit(True))
    joined = f.select("id").join(out, "id", "left").join(into, "id", "left")
    reason = F.when(F.col("calls").isNull() & F.col("called").isNull(), "isolated").when(F.col("calls").isNull(), "no_callees").when(F.col("called").isNull(), "no_callers")
    return joined.select("id", reason.alias("reason")).where(F.col("reason").isNotNull())


# -- definitions and usages


def definitions(g: Graph, sites: DataFrame) -> DataFrame:
    """``src, name, id, stage``: where each used name is defined, by the first stage that finds any.

    ``sites`` is ``src, name``.  Stages: 1 the same file, 2 a module that the
    file imports (its name is in the path), 3 the same folder, 4 the same
    repository, 5 anywhere.
    """
    files = g.nodes.select(F.col("id").alias("src"), F.col("path").alias("from_path"), F.col("repository_path").alias("from_repo"))
    used = sites.select("src", "name").distinct().join(files, "src")
    targets = g.of_kind("FUNCTION", "METHOD", "CLASS").select("id", "name", "path", "repository_path")
    met = used.join(targets, "name")
    home = g.of_kind("FILE").select(F.col("path").alias("from_path"), F.col("id").alias("file"))
    imported = (
        g.links("IMPORTS").select(F.col("src").alias("file"), F.regexp_replace("dst", "^module:", "").alias("module")).join(home, "file")
        .groupBy("from_path").agg(F.collect_set("module").alias("modules"))
    )
    met = met.join(imported, "from_path", "left")
    via = F.coalesce(F.exists("modules", lambda m: F.col("path").contains(m)), F.lit(False))
    stage = (
        F.when(F.col("path") == F.col("from_path"), 1).when(via & (F.col("repository_path") == F.col("from_repo")), 2)
        .when(paths.module("path") == paths.module("from_path"), 3).when(F.col("repository_path") == F.col("from_repo"), 4).otherwise(5)
    )
    staged = met.select("src", "name", "id", stage.alias("stage"))
    best = staged.groupBy("src", "name").agg(F.min("stage").alias("stage"))
    return staged.join(best, ["src", "name", "stage"])


def usages(g: Graph, kinds: tuple[str, ...] = tuple(USES)) -> DataFrame:
    """``target, user, path, line_number, usage``: every use of a symbol over edges of these kinds, once."""
    uses = F.create_map(*[F.lit(x) for kv in USES.items() for x in kv])
    where = g.nodes.select(F.col("id").alias("src"), "path")
    return (
        g.edges.where(F.col("kind").isin(*kinds)).join(where, "src")
        .select(F.coalesce("callee_name", "dst").alias("target"), F.col("src").alias("user"), "path", "line_number", uses[F.col("kind")].alias("usage"))
        .distinct()
    )


def quick_info(g: Graph) -> DataFrame:
    """``id, name, kind, callers, callees, uses``: counts for every callable and class, each from its own aggregate."""
    into = g.calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    out = g.calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
    held = g.links("CONTAINS", "SIMILAR_TO").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("uses"))
    base = g.of_kind("FUNCTION", "METHOD", "CLASS").select("id", "name", "kind")
    for part in (into, out, held):
        base = base.join(part, "id", "left")
    return base.fillna(0, ["callers", "callees", "uses"])


def exact_definitions(g: Graph, name: str) -> DataFrame:
    return g.of_kind("FUNCTION", "METHOD", "CLASS").where(F.col("name") == name).select("id", "kind", "path", "line_number")


def fuzzy_definitions(g: Graph, text: str) -> DataFrame:
    return g.of_kind("FUNCTION", "METHOD", "CLASS").where(F.lower("name").contains(text.lower())).select("id", "kind", "name", "path")


def suggest_names(g: Graph, name: str, most: int = 10) -> DataFrame:
    """``name, distance``: the known names nearest to a misspelled one."""
    known = g.of_kind("FUNCTION", "METHOD", "CLASS").select("name").distinct().where(F.col("name").isNotNull())
    return known.select("name", F.levenshtein("name", F.lit(name)).alias("distance")).orderBy("distance", "name").limit(most)


def resolve_definitions(g: Graph, name: str) -> DataFrame:
    """``id, strategy``: exact matches if there are any, else those that differ in case, else fuzzy ones."""
    d = g.of_kind("FUNCTION", "METHOD", "CLASS").select("id", "name")
    low = name.lower()
    rank = F.when(F.col("name") == name, 1).when(F.lower("name") == low, 2).when(F.lower("name").contains(low), 3)
    ranked = d.select("id", rank.alias("rank")).where(F.col("rank").isNotNull())
    best = ranked.agg(F.min("rank").alias("rank"))
    strategy = F.element_at(F.array(F.lit("exact"), F.lit("ignore_case"), F.lit("fuzzy")), F.col("rank"))
    return ranked.join(F.broadcast(best), "rank", "left_semi").select("id", strategy.alias("strategy"))  # one row


# -- resolution of placeholders


def resolve(g: Graph, kind: str, target_kinds: tuple[str, ...]) -> DataFrame:
    """``src, dst``: edges of a kind from placeholders to the nodes of some kinds with that name, in the same repository and branch."""
    sites = g.edges.where((F.col("kind") == kind) & F.col("callee_name").isNotNull()).select("src", "callee_name").distinct()
    who = g.nodes.select(F.col("id").alias("src"), "repository_path", "branch")
    target = g.of_kind(*target_kinds).select(F.col("id").alias("dst"), F.col("name").alias("callee_name"), "repository_path", "branch")
    return sites.join(who, "src").join(target, ["repository_path", "branch", "callee_name"]).select("src", "dst").distinct()


def unresolved(g: Graph) -> DataFrame:
    """``src, callee_name`` of the calls that no function in the caller's repository and branch answers."""
    target = g.callables.select(F.col("name").alias("callee_name"), "repository_path", "branch").distinct()
    return g.call_sites.join(target, ["repository_path", "branch", "callee_name"], "left_anti").select("src", "callee_name")


def placeholders(g: Graph) -> DataFrame:
    """``id, name``: the placeholder nodes that calls need."""
    return g.edges.where((F.col("kind") == "CALLS") & F.col("callee_name").isNotNull()).select(
        F.concat(F.lit("call_target:"), "callee_name").alias("id"), F.col("callee_name").alias("name")
    ).distinct()


def orphans(g: Graph) -> DataFrame:
    """``id`` of the placeholders that no edge leads to."""
    return g.of_kind("CALL_TARGET").select("id").join(g.raw_edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def dangling(g: Graph) -> DataFrame:
    """``src, dst, kind`` of the edges one end of which is no node."""
    ids = g.raw_nodes.where(F.col("id").isNotNull()).select("id").distinct()
    links = g.edges.select("src", "dst", "kind").distinct()
    no_dst = links.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "kind")
    no_src = links.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst", "kind")
    return no_dst.union(no_src).distinct()


def type_members(g: Graph) -> DataFrame:
    """``class_id, method_id``: methods and the class whose definition comes last before them in the same file."""
    c = g.of_kind("CLASS").select(F.col("id").alias("class_id"), "path", F.col("line_number").alias("at"))
    m = g.of_kind("METHOD").select(F.col("id").alias("method_id"), "path", "line_number")
    marks = c.select("path", F.col("at").alias("line"), "class_id", F.lit(None).cast("string").alias("method_id")).union(
        m.select("path", F.col("line_number").alias("line"), F.lit(None).cast("string").alias("class_id"), "method_id")
    )
    w = Window.partitionBy("path").orderBy("line", F.col("class_id").isNull(), "class_id").rowsBetween(Window.unboundedPreceding, 0)
    held = marks.withColumn("class_id", F.last("class_id", ignorenulls=True).over(w))
    return held.where(F.col("method_id").isNotNull() & F.col("class_id").isNotNull()).select("class_id", "method_id")


# -- branches and repositories


def branch_only(g: Graph, here: str, there: str, kinds: tuple[str, ...] = ("FUNCTION", "METHOD", "CLASS")) -> DataFrame:
    """``repository_path, name, kind`` of the symbols of one branch that another of the same repository lacks."""
    s = g.of_kind(*kinds).select("repository_path", "branch", "name", "kind").where(F.col("repository_path").isNotNull())
    key = ["repository_path", "name", "kind"]
    a = s.where(F.col("branch") == here).select(*key).distinct()
    return a.join(s.where(F.col("branch") == there).select(*key), key, "left_anti")


def modified(g: Graph, left: Column, right: Column, kinds: tuple[str, ...] = ("FUNCTION", "METHOD")) -> DataFrame:
    """``name, kind, change``: symbols in both of two sets of nodes that differ: ``signature`` if their first lines do, else ``body``.

    Symbols without source on a side are not compared.  Several of a name on a
    side are compared by the first in the order of their ids.
    """
    base = g.of_kind(*kinds).where(F.col("source").isNotNull())
    head = F.trim(F.substring_index(F.regexp_replace("source", r"\r", ""), "\n", 1))

    def side(rule: Column, tag: str) -> DataFrame:
        first = F.min_by(F.struct(F.md5("source").alias("body"), head.alias("head")), "id")
        return base.where(rule).groupBy("name", "kind").agg(first.alias(tag))

    both = side(left, "a").join(side(right, "b"), ["name", "kind"]).where(F.col("a.body") != F.col("b.body"))
    return both.select("name", "kind", F.when(F.col("a.head") != F.col("b.head"), "signature").otherwise("body").alias("change"))


def affected_by(g: Graph, changed: DataFrame, kinds: tuple[str, ...] = ("INHERITS", "IMPLEMENTS", "TYPE_REFERENCE", "FIELD_ACCESS")) -> DataFrame:
    """``id, changed``: who calls or uses changed symbols (``id``) directly."""
    into = g.calls.unionByName(g.links(*kinds))
    return into.join(changed.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("changed"))


def structural_diff(g: Graph, here: str, there: str) -> DataFrame:
    """``repository_path, added, removed, common``: symbols of each repository by the branches that hold them."""
    s = g.of_kind("FUNCTION", "METHOD", "CLASS").where(F.col("branch").isin(here, there) & F.col("repository_path").isNotNull())
    per = s.groupBy("repository_path", "name", "kind").agg(F.max((F.col("branch") == here)).alias("a"), F.max(F.col("branch") == there).alias("b"))
    return per.groupBy("repository_path").agg(
        F.count_if(~F.col("a") & F.col("b")).alias("added"), F.count_if(F.col("a") & ~F.col("b")).alias("removed"), F.count_if(F.col("a") & F.col("b")).alias("common")
    )


def compare_repositories(g: Graph) -> DataFrame:
    """``repo_a, repo_b, shared``: how many function names each two repositories share.

    Names are first reduced to one row for each repository; a name that many
    repositories hold still meets each other repository once.
    """
    names = g.callables.where(F.col("repository_path").isNotNull()).select("repository_path", "name").distinct()
    a, b = names.withColumnRenamed("repository_path", "repo_a"), names.withColumnRenamed("repository_path", "repo_b")
    return a.join(b, "name").where(F.col("repo_a") < F.col("repo_b")).groupBy("repo_a", "repo_b").agg(F.count("*").alias("shared"))


def api_surface(g: Graph, one: str, other: str) -> DataFrame:
    """``shared, only_one, only_other, similarity`` of the public functions of two repositories (an unset visibility is public); Dice."""
    public = g.callables.where(F.coalesce("visibility", F.lit("public")) == "public")
    per = public.where(F.col("repository_path").isin(one, other)).groupBy("name").agg(
        F.max(F.col("repository_path") == one).alias("a"), F.max(F.col("repository_path") == other).alias("b")
    )
    out = per.agg(
        F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count_if(F.col("a") & ~F.col("b")).alias("only_one"), F.count_if(~F.col("a") & F.col("b")).alias("only_other")
    )
    total = 2 * F.col("shared") + F.col("only_one") + F.col("only_other")
    return out.withColumn("similarity", F.round(F.when(total > 0, 2 * F.col("shared") / total).otherwise(0.0), 6))


# -- merged links


def merge_lsp(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``src, dst, confidence, provenance``: known call edges with the observed ones merged in; the greater confidence of a pair counts."""
    both = existing.select("src", "dst", "confidence", "provenance").unionByName(incoming.select("src", "dst", "confidence", "provenance"))
    source = F.coalesce("provenance", F.lit(""))
    best = F.max(F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), source.alias("p")))
    return both.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"), F.nullif(best["p"], F.lit("")).alias("provenance"))


def linked(pairs: DataFrame) -> DataFrame:
    """``id, linked_to``: symmetric links, each side with the sorted others joined by commas; a link to itself counts not."""
    both = pairs.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(pairs.select(F.col("dst"), F.col("src")))
    return both.where(F.col("id") != F.col("other")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("linked_to"))


def related(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``id, other, name``: what each id is linked to, with the other's name."""
    both = pairs.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(pairs.select(F.col("dst"), F.col("src"))).distinct()
    return both.join(rows.select(F.col("id").alias("other"), "name"), "other")
