"""Queries for smells, reviews and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import relations, smells as op
from codeloom.plans.registry import Workspace, query

B = "b AS (SELECT id, path, name, line_number, source, replace(source, chr(13), '') AS src FROM f WHERE source IS NOT NULL)"
LINES = "(CASE WHEN length(source) = 0 THEN 0 ELSE length(source) - length(replace(source, chr(10), '')) + CASE WHEN ends_with(source, chr(10)) THEN 0 ELSE 1 END END)"


def bodies(w: Workspace):
    return w.graph.callables.where(F.col("source").isNotNull())


def one(w: Workspace, smell: str, limit: int):
    """The findings of one detector, with a limit that these texts reach."""
    value = op.measures()[smell]
    return bodies(w).select("id", value.cast("int").alias("value")).where(F.col("value") > limit)


def over(value: str, limit: int) -> str:
    return f"{B};; SELECT id, value FROM (SELECT id, ({value})::INTEGER AS value FROM b) WHERE value > {limit}"


@query(over(LINES, 12))
def smell_long_functions(w: Workspace):
    return one(w, "long_function", 12)


@query(over("coalesce(list_max(list_transform(list_filter(string_split(src, chr(10)), lambda x: trim(x, ' ') <> ''), lambda x: (length(replace(x, chr(9), '    ')) - length(ltrim(replace(x, chr(9), '    '), ' '))) // 4)), 0)", 2))
def smell_deep_nesting(w: Workspace):
    return one(w, "deep_nesting", 2)


SIG = "regexp_replace(regexp_extract(source, '(?s)\\(([^()]*)\\)', 1), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')"
NAMES = (
    f"list_filter(list_transform(list_filter(list_transform(string_split({SIG}, ','), lambda p: trim(p, ' ')), lambda p: p <> '' AND p NOT IN ('self', '&self', '&mut self', 'this', 'cls')), "
    "lambda p: regexp_replace(CASE WHEN contains(p, ':') THEN split_part(trim(split_part(p, ':', 1), ' '), ' ', -1) ELSE split_part(p, ' ', -1) END, '[^\\w]', '', 'g')), lambda x: x <> '')"
)


@query(over(f"len({NAMES})", 1))
def smell_too_many_parameters(w: Workspace):
    return one(w, "too_many_parameters", 1)


@query(f"{B};; SELECT id, array_to_string({NAMES}, ',') AS names FROM b")
def count_parameters(w: Workspace):
    return bodies(w).select("id", F.array_join(op.parameter_names(), ",").alias("names"))


@query(over("len(regexp_extract_all(source, '\\breturn\\b'))", 1))
def smell_too_many_returns(w: Workspace):
    return one(w, "too_many_returns", 1)


@query(over("len(regexp_extract_all(source, '\\bcase\\b|\\bwhen\\b'))", 0))
def smell_switch_statements(w: Workspace):
    return one(w, "switch_statements", 0)


@query(over("coalesce(list_max(list_transform(regexp_extract_all(source, '(\\w+(?:\\.\\w+\\([^()\\n]*\\)){2,})', 1), lambda x: len(regexp_extract_all(x, '\\.\\w+\\(')))), 0)", 0))
def smell_message_chains(w: Workspace):
    return one(w, "message_chains", 0)


@query(over("len(regexp_extract_all(source, '\\b(?:TODO|FIXME|XXX|HACK)\\b'))", 0))
def smell_todo_comments(w: Workspace):
    return one(w, "todo_comments", 0)


TRIMMED = "list_transform(string_split(src, chr(10)), lambda x: trim(x, ' ' || chr(9)))"


@query(over(f"len(list_filter(list_filter({TRIMMED}, lambda x: regexp_matches(x, '^(?://|#|\\*|/\\*|--)')), lambda x: regexp_matches(x, '[;{{}}]$|\\)\\s*$|^(?://|#)\\s*\\w+\\s*=\\s*')))".replace("{{}}", "{}"), 0))
def smell_commented_code(w: Workspace):
    return one(w, "commented_code", 0)


@query(over(f"len(regexp_extract_all({SIG}, '{op.PRIMITIVES}'))", 1))
def smell_primitive_obsession(w: Workspace):
    return one(w, "primitive_obsession", 1)


CYCLO = "1 + " + " + ".join(f"((length(source) - length(replace(source, '{t}', ''))) // {len(t)})" for t in tx.BRANCHES)


@query(over(CYCLO, 3))
def smell_high_complexity(w: Workspace):
    return one(w, "high_complexity", 3)


@query()
def smell_magic_numbers(w: Workspace):
    return one(w, "magic_numbers", 1)


@query(over("len(regexp_extract_all(source, '\\{\\s*\\}'))", 0))
def smell_empty_blocks(w: Workspace):
    return one(w, "empty_block", 0)


@query(over("len(regexp_extract_all(source, '(?m)^[ \\t]*return\\b[^\\n{]*;[ \\t]*\\n[ \\t]*[a-zA-Z_]\\w*[ \\t]*[=(]'))", 0))
def smell_unreachable_code(w: Workspace):
    return one(w, "unreachable_code", 0)


@query(
    f"{B}, l AS (SELECT id, list_filter({TRIMMED}, lambda x: x <> '') AS l FROM b), r AS (SELECT id, len(list_filter(l, lambda x: regexp_matches(x, '^(?://|#|\\*|/\\*|--)'))) / len(l) AS r FROM l WHERE len(l) > 0);; "
    "SELECT id, 'comments' AS smell, floor(r * 100)::INTEGER AS value, 'warning' AS severity FROM r WHERE r > 0.1"
)
def smell_comments(w: Workspace):
    return op.comment_ratio(bodies(w), 0.1)


MEMBERS = (
    "mm AS (SELECT class_id, method_id FROM (SELECT m.id AS method_id, k.id AS class_id, row_number() OVER (PARTITION BY m.id ORDER BY k.line_number DESC, k.id DESC) AS i "
    "FROM n m JOIN n k ON k.path = m.path AND k.kind = 'CLASS' AND k.line_number <= m.line_number WHERE m.kind = 'METHOD') WHERE i = 1)"
)
SEVERE = "CASE WHEN {0} > 2 * {1} THEN 'critical' WHEN {0} > {1} + 3 THEN 'error' ELSE 'warning' END"


@query(f"{MEMBERS};; SELECT class_id AS id, 'large_class' AS smell, count(*)::INTEGER AS value, {SEVERE.format('count(*)', 5)} AS severity FROM mm GROUP BY 1 HAVING count(*) > 5")
def smell_large_classes(w: Workspace):
    return op.large_classes(relations.type_members(w.graph), 5)


@query(f"{MEMBERS};; SELECT n.id, 'lazy_class' AS smell, count(mm.method_id)::INTEGER AS value, 'info' AS severity FROM n LEFT JOIN mm ON mm.class_id = n.id WHERE n.kind = 'CLASS' GROUP BY 1 HAVING count(mm.method_id) <= 3")
def smell_lazy_classes(w: Workspace):
    return op.lazy_classes(w.graph.of_kind("CLASS"), relations.type_members(w.graph))


@query(
    "s AS (SELECT repository_path, branch, callee_name AS name, count(DISTINCT src) AS k FROM sites GROUP BY ALL HAVING count(DISTINCT src) >= 2);; SELECT f.id, 'shotgun_surgery' AS smell, s.k::INTEGER AS value, "
    "CASE WHEN s.k >= 10 THEN 'error' ELSE 'warning' END AS severity FROM f JOIN s ON s.repository_path = f.repository_path AND s.branch = f.branch AND s.name = f.name"
)
def smell_shotgun_surgery(w: Workspace):
    return op.shotgun_surgery(w.graph, 2)


MET = "met AS (SELECT s.src, a.path AS from_path, s.callee_name, t.path FROM sites s JOIN f a ON a.id = s.src JOIN (SELECT DISTINCT name, path, repository_path, branch FROM f) t ON t.name = s.callee_name AND t.repository_path = s.repository_path AND t.branch = s.branch)"


@query(
    f"{MET}, p AS (SELECT src, from_path, path, count(DISTINCT callee_name) AS k FROM met GROUP BY ALL), o AS (SELECT src, max(CASE WHEN path = from_path THEN k ELSE 0 END) AS own, max(CASE WHEN path <> from_path THEN k ELSE 0 END) AS value FROM p GROUP BY 1);; "
    "SELECT src AS id, 'feature_envy' AS smell, value::INTEGER AS value, 'warning' AS severity FROM o WHERE value > own AND value >= 1"
)
def smell_feature_envy(w: Workspace):
    return op.feature_envy(w.graph, 1)


@query(f"{MET}, p AS (SELECT least(from_path, path) AS a, greatest(from_path, path) AS b, from_path < path AS forth FROM met WHERE from_path <> path);; SELECT a, b, count(*) AS calls FROM p GROUP BY ALL HAVING count(DISTINCT forth) = 2 AND count(*) >= 2")
def smell_inappropriate_intimacy(w: Workspace):
    return op.intimacy(w.graph, 2)


@query(
    f"{B}, p AS (SELECT id, path, list_sort(list_distinct({NAMES})) AS names FROM b), q AS (SELECT * FROM p WHERE len(names) >= 2);; SELECT x.id AS a, y.id AS b, len(list_intersect(x.names, y.names)) AS shared FROM q x JOIN q y ON x.path = y.path AND x.id < y.id "
    "WHERE len(list_intersect(x.names, y.names)) >= 2 AND len(list_intersect(x.names, y.names)) / (len(x.names) + len(y.names) - len(list_intersect(x.names, y.names))) >= 0.7"
)
def smell_data_clumps(w: Workspace):
    return op.data_clumps(bodies(w), 2)


@query(
    f"{MEMBERS}, m AS (SELECT DISTINCT mm.class_id, n.name FROM mm JOIN n ON n.id = mm.method_id WHERE n.name IS NOT NULL), z AS (SELECT class_id, count(*) AS k FROM m GROUP BY 1), "
    "p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS shared FROM m a JOIN m b ON a.name = b.name AND a.class_id < b.class_id GROUP BY ALL HAVING count(*) >= 2);; "
    "SELECT p.a, p.b, p.shared, round(shared / (x.k + y.k - shared), 6) AS similarity FROM p JOIN z x ON x.class_id = p.a JOIN z y ON y.class_id = p.b WHERE round(shared / (x.k + y.k - shared), 6) >= 0.5"
)
def smell_alternative_classes(w: Workspace):
    names = w.graph.nodes.where(F.col("name").isNotNull()).select(F.col("id").alias("method_id"), "name")
    return op.alternative_classes(relations.type_members(w.graph), names, 0.5, 2)


@query()
def smell_middle_man(w: Workspace):
    return op.middle_men(w.graph.of_kind("METHOD"), relations.type_members(w.graph), 0.2, 1)


@query(
    f"{MEMBERS};; SELECT mm.class_id AS id, 'divergent_change' AS smell, count(DISTINCT lower(regexp_extract(n.name, '^([a-z]+)', 1)))::INTEGER AS value, 'info' AS severity FROM mm JOIN n ON n.id = mm.method_id "
    "GROUP BY 1 HAVING count(*) > 5 AND count(DISTINCT lower(regexp_extract(n.name, '^([a-z]+)', 1))) >= 2"
)
def smell_divergent_change(w: Workspace):
    names = w.graph.nodes.select(F.col("id").alias("method_id"), "name")
    return op.divergent_change(relations.type_members(w.graph), names)


@query("SELECT id, 'dead_code' AS smell FROM f WHERE id NOT IN (SELECT dst FROM c) AND name NOT IN (SELECT callee_name FROM sites)")
def smell_dead_code(w: Workspace):
    f = w.graph.callables.join(w.graph.calls.select(F.col("dst").alias("id")), "id", "left_anti")
    return f.join(w.graph.call_sites.select(F.col("callee_name").alias("name")), "name", "left_anti").select("id", F.lit("dead_code").alias("smell"))


TIGHT = {"long_function": 12, "too_many_returns": 1, "high_complexity": 3, "deep_nesting": 2}


def findings(w: Workspace):
    return op.text_findings(bodies(w), {**{k: 1 << 20 for k in op.measures()}, **TIGHT})


def severity(value: str, most: int, length: bool) -> str:
    return f"CASE WHEN {value} > {2 * most} THEN 'critical' WHEN {value} > {1.5 * most if length else most + 3} THEN 'error' ELSE 'warning' END"


VALUES = {
    "long_function": LINES, "too_many_returns": "len(regexp_extract_all(source, '\\breturn\\b'))", "high_complexity": CYCLO,
    "deep_nesting": "coalesce(list_max(list_transform(list_filter(string_split(src, chr(10)), lambda x: trim(x, ' ') <> ''), lambda x: (length(replace(x, chr(9), '    ')) - length(ltrim(replace(x, chr(9), '    '), ' '))) // 4)), 0)",
}
FINDINGS = f"{B}, fd AS (" + " UNION ALL ".join(
    f"SELECT id, '{k}' AS smell, value::INTEGER AS value, {severity('value', TIGHT[k], k == 'long_function')} AS severity FROM (SELECT id, {v} AS value FROM b) WHERE value > {TIGHT[k]}" for k, v in VALUES.items()
) + ")"


@query(f"{FINDINGS};; SELECT * FROM fd")
def detect_smells(w: Workspace):
    return findings(w)


@query(f"{FINDINGS};; SELECT severity, count(*) AS n FROM fd GROUP BY 1")
def smell_summary(w: Workspace):
    return op.summary(findings(w))


CATEGORY = "CASE smell " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in op.TECHNIQUES.items()) + " END"
TECHNIQUE = "CASE smell " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in op.TECHNIQUES.items()) + " END"
PRIORITY = "CASE severity WHEN 'info' THEN 4 WHEN 'warning' THEN 3 WHEN 'error' THEN 2 ELSE 1 END"


@query(f"{FINDINGS};; SELECT {CATEGORY} AS category, smell, count(*) AS findings FROM fd GROUP BY ALL")
def smells_by_category(w: Workspace):
    return op.by_category(findings(w))


@query(f"{FINDINGS};; SELECT id, smell, {TECHNIQUE} AS technique, {CATEGORY} AS category, {PRIORITY} AS priority FROM fd WHERE {PRIORITY} <= 2")
def refactoring_recommendations(w: Workspace):
    return op.recommendations(findings(w), "error")


@query(f"{FINDINGS};; SELECT {TECHNIQUE} AS technique, {PRIORITY} AS priority, count(*) AS n FROM fd GROUP BY ALL")
def refactoring_summary(w: Workspace):
    return op.recommendations(findings(w), "info").groupBy("technique", "priority").agg(F.count("*").alias("n"))


@query(f"{FINDINGS};; SELECT id, smell, {PRIORITY} AS priority FROM fd ORDER BY 3, id, smell LIMIT 25")
def prioritise_refactorings(w: Workspace):
    return op.recommendations(findings(w), "info").select("id", "smell", "priority").orderBy("priority", "id", "smell").limit(25)


@query(
    f"{FINDINGS};; SELECT fd.id, f.path, f.line_number, fd.smell, fd.severity FROM fd JOIN f ON f.id = fd.id WHERE contains(f.path, '/lib/') "
    "ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, f.path, f.line_number, smell, fd.id LIMIT 40"
)
def pr_review(w: Workspace):
    changed = w.graph.of_kind("FILE").where(F.col("path").contains("/lib/"))
    return op.review(findings(w), w.graph.callables, changed, 40)


@query()
def find_patterns(w: Workspace):
    return op.patterns(w.graph.of_kind("FUNCTION", "METHOD", "CLASS"))


@query("SELECT id, next_id, gap FROM (SELECT id, lead(id) OVER w AS next_id, lead(line_number) OVER w - line_number AS gap FROM f WHERE path IS NOT NULL AND line_number IS NOT NULL WINDOW w AS (PARTITION BY path ORDER BY line_number, id)) WHERE next_id IS NOT NULL")
def functions_in_order(w: Workspace):
    return op.in_file_order(w.graph.callables)
