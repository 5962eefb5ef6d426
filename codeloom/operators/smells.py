"""Smells of code: findings over function texts, classes and the call graph.

Every detector returns ``id, smell, value, severity``.  Texts are judged by
built-in expressions in one pass; detectors over the graph aggregate edges first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions import paths, text as tx
from codeloom.graph import Graph

# Default limits of the detectors.
LIMITS = {
    "long_function": 50, "deep_nesting": 4, "too_many_parameters": 5, "too_many_returns": 5, "switch_statements": 5, "large_class": 20, "message_chains": 3, "todo_comments": 5,
    "commented_code": 3, "primitive_obsession": 4, "shotgun_surgery": 5, "lazy_class": 3, "intimacy": 5, "high_complexity": 15, "magic_numbers": 3,
}
# The first technique for each smell, and its category.
TECHNIQUES = {
    "long_function": ("extract_method", "bloater"), "large_class": ("extract_class", "bloater"), "primitive_obsession": ("replace_array_with_object", "bloater"),
    "too_many_parameters": ("introduce_parameter_object", "bloater"), "data_clumps": ("extract_class", "bloater"), "switch_statements": ("replace_conditional_with_polymorphism", "object_orientation"),
    "deep_nesting": ("decompose_conditional", "bloater"), "too_many_returns": ("extract_method", "bloater"), "magic_numbers": ("replace_magic_literal", "bloater"),
    "message_chains": ("hide_delegate", "coupler"), "feature_envy": ("move_method", "coupler"), "intimacy": ("move_method", "coupler"), "middle_man": ("remove_middle_man", "coupler"),
    "shotgun_surgery": ("move_method", "change_preventer"), "divergent_change": ("extract_class", "change_preventer"), "comments": ("extract_method", "dispensable"),
    "todo_comments": ("extract_method", "dispensable"), "commented_code": ("remove_dead_code", "dispensable"), "dead_code": ("remove_dead_code", "dispensable"),
    "lazy_class": ("inline_class", "dispensable"), "duplicate_code": ("extract_method", "dispensable"), "empty_block": ("remove_dead_code", "dispensable"), "high_complexity": ("decompose_conditional", "bloater"),
    "unreachable_code": ("remove_dead_code", "dispensable"),
}
PRIMITIVES = r"\b(?:int|long|short|byte|float|double|bool|boolean|char|string|str|String|Int|Long|Double|Bool|i32|i64|u32|u64|f32|f64|usize|number)\b"
_COMMENT = r"^(?://|#|\*|/\*|--)"


def count_severity(value, most: float) -> Column:
    """critical above twice the limit, error above the limit and three, else warning."""
    return F.when(value > 2 * most, "critical").when(value > most + 3, "error").otherwise("warning")


def length_severity(value, most: float) -> Column:
    return F.when(value > 2 * most, "critical").when(value > 1.5 * most, "error").otherwise("warning")


def _lines(text: str) -> Column:
    return F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")


def signature(text: str = "source") -> Column:
    """The text within the first parentheses, on one line."""
    return F.regexp_replace(F.regexp_extract(text, r"(?s)\(([^()]*)\)", 1), r"\s+", " ")


def parameter_names(text: str = "source") -> Column:
    """The words before a colon or at the end of each parameter, ``self`` and receivers aside."""
    parts = F.filter(F.transform(F.split(signature(text), ","), F.trim), lambda p: (p != "") & ~p.isin("self", "&self", "&mut self", "this", "cls"))
    name = lambda p: F.regexp_replace(F.when(p.contains(":"), F.substring_index(F.trim(F.substring_index(p, ":", 1)), " ", -1)).otherwise(F.substring_index(p, " ", -1)), r"[^\w]", "")
    return F.filter(F.transform(parts, name), lambda x: x != "")


def measures() -> dict[str, Column]:
    """What the detectors over one text measure, by smell."""
    lines = _lines("source")
    code = F.filter(lines, lambda x: F.trim(x) != "")
    indent = F.transform(code, lambda x: F.floor((F.length(F.replace(x, F.lit("\t"), F.lit("    "))) - F.length(F.ltrim(F.replace(x, F.lit("\t"), F.lit("    "))))) / 4))
    trimmed = F.transform(lines, lambda x: F.btrim(x, F.lit(" \t")))
    comment = F.filter(trimmed, lambda x: x.rlike(_COMMENT))
    return {
        "long_function": tx.line_count(F.col("source")),
        "deep_nesting": F.coalesce(F.array_max(indent), F.lit(0)),
        "too_many_parameters": F.size(parameter_names()),
        "too_many_returns": F.regexp_count("source", F.lit(r"\breturn\b")),
        "switch_statements": F.regexp_count("source", F.lit(r"\bcase\b|\bwhen\b")),
        "message_chains": F.coalesce(F.array_max(F.transform(F.regexp_extract_all("source", F.lit(r"(\w+(?:\.\w+\([^()\n]*\)){2,})"), F.lit(1)), lambda x: F.regexp_count(x, F.lit(r"\.\w+\(")))), F.lit(0)),
        "todo_comments": F.regexp_count("source", F.lit(r"\b(?:TODO|FIXME|XXX|HACK)\b")),
        "commented_code": F.size(F.filter(comment, lambda x: x.rlike(r"[;{}]$|\)\s*$|^(?://|#)\s*\w+\s*=\s*"))),
        "primitive_obsession": F.regexp_count(signature(), F.lit(PRIMITIVES)),
        "high_complexity": tx.cyclomatic(F.col("source")),
        "magic_numbers": F.size(F.filter(F.regexp_extract_all(F.array_join(F.filter(trimmed, lambda x: ~x.rlike(r"^(?:const|static|final|val)\b|\[.*\]")), "\n"), F.lit(r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w.])"), F.lit(1)), lambda x: ~x.isin("0", "1"))),
        "empty_block": F.regexp_count("source", F.lit(r"\{\s*\}")),
        "unreachable_code": F.regexp_count("source", F.lit(r"(?m)^[ \t]*return\b[^\n{]*;[ \t]*\n[ \t]*[a-zA-Z_]\w*[ \t]*[=(]")),
    }


def text_findings(rows: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Findings over ``id, source``: one pass, one row for each limit that a text is above; a null source has none."""
    most = {**LIMITS, "empty_block": 0, "unreachable_code": 0, **(limits or {})}
    found = [
        F.when(value > most[name], F.struct(F.lit(name).alias("smell"), value.cast("int").alias("value"), (length_severity if name == "long_function" else count_severity)(value, max(most[name], 1)).alias("severity")))
        for name, value in measures().items()
    ]
    kept = rows.where(F.col("source").isNotNull()).select("id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
    return kept.select("id", "x.*")


def comment_ratio(rows: DataFrame, most: float = 0.3) -> DataFrame:
    """Texts whose comment lines are more than a share of the lines that hold anything; ``value`` in percent."""
    lines = F.filter(F.transform(_lines("source"), lambda x: F.btrim(x, F.lit(" \t"))), lambda x: x != "")
    ratio = F.size(F.filter("l", lambda x: x.rlike(_COMMENT))) / F.size("l")
    r = rows.where(F.col("source").isNotNull()).select("id", lines.alias("l")).where(F.size("l") > 0).select("id", ratio.alias("r")).where(F.col("r") > most)
    return r.select("id", F.lit("comments").alias("smell"), F.floor(F.col("r") * 100).cast("int").alias("value"), F.lit("warning").alias("severity"))


def large_classes(members: DataFrame, most: int = LIMITS["large_class"]) -> DataFrame:
    per = members.groupBy("class_id").agg(F.count("*").cast("int").alias("value")).where(F.col("value") > most)
    return per.select(F.col("class_id").alias("id"), F.lit("large_class").alias("smell"), "value", count_severity(F.col("value"), most).alias("severity"))


def lazy_classes(classes: DataFrame, members: DataFrame, most: int = LIMITS["lazy_class"]) -> DataFrame:
    """Classes (``id``) with at most so many methods."""
    per = members.groupBy(F.col("class_id").alias("id")).agg(F.count("*").cast("int").alias("value"))
    all_ = classes.select("id").join(per, "id", "left").fillna(0, ["value"]).where(F.col("value") <= most)
    return all_.select("id", F.lit("lazy_class").alias("smell"), "value", F.lit("info").alias("severity"))


def shotgun_surgery(g: Graph, least: int = LIMITS["shotgun_surgery"]) -> DataFrame:
    """Functions whose name at least so many others of the repository call."""
    callers = g.call_sites.groupBy("repository_path", "branch", F.col("callee_name").alias("name")).agg(F.countDistinct("src").cast("int").alias("value")).where(F.col("value") >= least)
    found = g.callables.select("id", "name", "repository_path", "branch").join(callers, ["repository_path", "branch", "name"])
    return found.select("id", F.lit("shotgun_surgery").alias("smell"), "value", F.when(F.col("value") >= 10, "error").otherwise("warning").alias("severity"))


def feature_envy(g: Graph, least: int = 3) -> DataFrame:
    """Functions that call more names of one other file than of their own, and at least so many."""
    f = g.callables.select("id", "name", "path", "repository_path", "branch")
    sites = g.call_sites.join(f.select(F.col("id").alias("src"), F.col("path").alias("from_path")), "src")
    met = sites.join(f.select(F.col("name").alias("callee_name"), "path", "repository_path", "branch").distinct(), ["callee_name", "repository_path", "branch"])
    per = met.groupBy("src", "from_path", "path").agg(F.countDistinct("callee_name").alias("n"))
    own = per.groupBy("src").agg(F.max(F.when(F.col("path") == F.col("from_path"), F.col("n")).otherwise(0)).alias("own"), F.max(F.when(F.col("path") != F.col("from_path"), F.col("n")).otherwise(0)).alias("value"))
    kept = own.where((F.col("value") > F.col("own")) & (F.col("value") >= least))
    return kept.select(F.col("src").alias("id"), F.lit("feature_envy").alias("smell"), F.col("value").cast("int").alias("value"), F.lit("warning").alias("severity"))


def intimacy(g: Graph, least: int = LIMITS["intimacy"]) -> DataFrame:
    """``a, b, calls``: two files that call each other's names at least so often together, both ways."""
    f = g.callables.select("id", "name", "path", "repository_path", "branch")
    sites = g.call_sites.join(f.select(F.col("id").alias("src"), F.col("path").alias("p")), "src")
    met = sites.join(f.select(F.col("name").alias("callee_name"), F.col("path").alias("q"), "repository_path", "branch").distinct(), ["callee_name", "repository_path", "branch"])
    per = met.where(F.col("p") != F.col("q")).groupBy("p", "q").agg(F.count("*").alias("n"))
    both = per.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "n", (F.col("p") < F.col("q")).alias("forth"))
    sums = both.groupBy("a", "b").agg(F.sum("n").alias("calls"), F.countDistinct("forth").alias("ways"))
    return sums.where((F.col("ways") == 2) & (F.col("calls") >= least)).select("a", "b", "calls")


def data_clumps(rows: DataFrame, least: int = 3, similarity: float = 0.7) -> DataFrame:
    """``a, b, shared``: functions of one file (``id, path, source``) whose parameter names largely agree.

    Only functions with so many names take part; they meet by a name they share,
    within their file, so functions without a common name are never paired.
    """
    names = F.array_sort(F.array_distinct(parameter_names()))
    p = rows.where(F.col("source").isNotNull()).select("id", "path", names.alias("names")).where(F.size("names") >= least)
    by = p.select("id", "path", "names", F.explode("names").alias("name"))
    met = by.select(F.col("id").alias("a"), "path", "name", F.col("names").alias("x")).join(by.select(F.col("id").alias("b"), "path", "name", F.col("names").alias("y")), ["path", "name"])
    pairs = met.where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("shared"), F.first(F.size("x") + F.size("y")).alias("total"))
    return pairs.where((F.col("shared") >= least) & (F.col("shared") / (F.col("total") - F.col("shared")) >= similarity)).select("a", "b", "shared")


def alternative_classes(members: DataFrame, names: DataFrame, least: float = 0.8, common: int = 3) -> DataFrame:
    """``a, b, shared, similarity``: classes with nearly the same method names; ``names`` is ``method_id, name``."""
    m = members.join(names, "method_id").select("class_id", "name").distinct()
    size = m.groupBy("class_id").agg(F.count("*").alias("n"))
    met = m.withColumnRenamed("class_id", "a").join(m.withColumnRenamed("class_id", "b"), "name").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= common)
    both = met.join(size.select(F.col("class_id").alias("a"), F.col("n").alias("x")), "a").join(size.select(F.col("class_id").alias("b"), F.col("n").alias("y")), "b")
    s = F.col("shared") / (F.col("x") + F.col("y") - F.col("shared"))
    return both.withColumn("similarity", F.round(s, 6)).where(F.col("similarity") >= least).select("a", "b", "shared", "similarity")


def middle_men(rows: DataFrame, members: DataFrame, least: float = 0.8, methods: int = 3) -> DataFrame:
    """Classes most of whose methods (``id, source``) only pass a call on; ``value`` in percent."""
    lines = F.filter(F.transform(_lines("source"), lambda x: F.btrim(x, F.lit(" \t"))), lambda x: (x != "") & ~x.isin("}", "{", "end") & ~x.rlike(_COMMENT))
    passes = (F.size(lines) == 2) & F.try_element_at(lines, F.lit(2)).rlike(r"^(?:return\s+)?[\w.$>-]+\([^()]*\);?$")
    judged = rows.where(F.col("source").isNotNull()).select(F.col("id").alias("method_id"), F.coalesce(passes, F.lit(False)).cast("int").alias("passes"))
    per = members.join(judged, "method_id").groupBy("class_id").agg(F.avg("passes").alias("r"), F.count("*").alias("n")).where((F.col("n") >= methods) & (F.col("r") >= least))
    return per.select(F.col("class_id").alias("id"), F.lit("middle_man").alias("smell"), F.floor(F.col("r") * 100).cast("int").alias("value"), F.lit("warning").alias("severity"))


def divergent_change(members: DataFrame, names: DataFrame, groups: int = 2, methods: int = 5) -> DataFrame:
    """Classes with more than so many methods whose names begin with several different verbs; ``value`` is their number."""
    verb = F.lower(F.regexp_extract("name", r"^([a-z]+)", 1))
    per = members.join(names, "method_id").groupBy("class_id").agg(F.countDistinct(verb).cast("int").alias("value"), F.count("*").alias("n")).where((F.col("n") > methods) & (F.col("value") >= groups))
    return per.select(F.col("class_id").alias("id"), F.lit("divergent_change").alias("smell"), "value", F.lit("info").alias("severity"))


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def by_category(findings: DataFrame) -> DataFrame:
    """``category, smell, findings``."""
    table = F.create_map(*[F.lit(x) for k, v in TECHNIQUES.items() for x in (k, v[1])])
    return findings.groupBy(table[F.col("smell")].alias("category"), "smell").agg(F.count("*").alias("findings"))


def recommendations(findings: DataFrame, least: str = "warning") -> DataFrame:
    """``id, smell, technique, category, priority``: the first technique for each finding of at least a severity; 1 is most urgent."""
    rank = {"info": 4, "warning": 3, "error": 2, "critical": 1}
    first = F.create_map(*[F.lit(x) for k, v in TECHNIQUES.items() for x in (k, v[0])])
    kind = F.create_map(*[F.lit(x) for k, v in TECHNIQUES.items() for x in (k, v[1])])
    priority = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("severity")]
    rows = findings.select("id", "smell", first[F.col("smell")].alias("technique"), kind[F.col("smell")].alias("category"), priority.alias("priority"))
    return rows.where(F.col("priority") <= rank[least])


def review(findings: DataFrame, nodes: DataFrame, changed: DataFrame, most: int) -> DataFrame:
    """``id, path, line_number, smell, severity``: the findings in changed files (``path``), the worst first, at most so many."""
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "error", 1).when(F.col("severity") == "warning", 2).otherwise(3)
    placed = findings.join(nodes.select("id", "path", "line_number"), "id").join(changed.select("path").distinct(), "path", "left_semi")
    return placed.orderBy(order, "path", "line_number", "smell", "id").limit(most).select("id", "path", "line_number", "smell", "severity")


# Cues of design patterns in names and in texts.
PATTERNS = {
    "singleton": (("singleton", "instance"), ("getInstance", "static instance", "OnceLock")), "factory": (("factory", "creator"), ("create", "new ", "build")), "builder": (("builder",), ("build()", "with_", "return self")),
    "observer": (("observer", "listener", "subscriber"), ("subscribe", "notify", "on_event")), "strategy": (("strategy", "policy"), ("execute", "trait ", "interface ")), "adapter": (("adapter", "wrapper"), ("inner", "adapt", "delegate")),
    "decorator": (("decorator",), ("wrapped", "inner", "super.")), "visitor": (("visitor", "visit"), ("accept", "visit_", "visit(")), "iterator": (("iterator", "iter", "cursor"), ("next(", "has_next", "yield")),
    "repository": (("repository", "repo", "store"), ("find", "save", "delete")), "command": (("command",), ("execute", "undo", "run(")), "proxy": (("proxy",), ("target", "forward", "delegate")),
    "facade": (("facade", "service"), ("client", "api", "facade")), "state": (("state",), ("transition", "next_state", "match ")), "pool": (("pool",), ("acquire", "release", "available")),
}


def patterns(nodes: DataFrame, least: float = 0.5) -> DataFrame:
    """``id, pattern, confidence``: design patterns by cues: 0.4 for a name, 0.15 for each cue in the text; at most 1."""
    name, source = F.lower(F.coalesce("name", F.lit(""))), F.coalesce("source", F.lit(""))
    found = []
    for pattern, (names, cues) in PATTERNS.items():
        named = reduce(lambda a, b: a | b, [name.contains(x) for x in names])
        score = reduce(lambda a, b: a + b, [F.when(source.contains(c), 0.15).otherwise(0.0) for c in cues], F.lit(0.4))
        found.append(F.when(named, F.struct(F.lit(pattern).alias("pattern"), F.round(F.least(score, F.lit(1.0)), 2).alias("confidence"))))
    rows = nodes.select("id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("id", "x.*")
    return rows.where(F.col("confidence") >= least)


def in_file_order(nodes: DataFrame) -> DataFrame:
    """``id, next_id, gap``: each function with the next one of its file and the lines between their starts."""
    w = Window.partitionBy("path").orderBy("line_number", "id")
    rows = nodes.where(F.col("path").isNotNull() & F.col("line_number").isNotNull())
    out = rows.select("id", F.lead("id").over(w).alias("next_id"), (F.lead("line_number").over(w) - F.col("line_number")).alias("gap"))
    return out.where(F.col("next_id").isNotNull())


def module_findings(g: Graph) -> DataFrame:
    """``module, smell, findings``: the text findings of each folder."""
    f = g.callables.select("id", paths.module("path").alias("module"), "source")
    return text_findings(f.select("id", "source")).join(f.select("id", "module"), "id").groupBy("module", "smell").agg(F.count("*").alias("findings"))
