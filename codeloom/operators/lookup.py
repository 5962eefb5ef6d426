"""Finding symbols by name, text, place and role: filters that reach the scan.

Every operator returns ``id, kind, name, path, line_number`` unless it says
otherwise, in no particular order; ``limit`` keeps the first by (path, line, id)
after all filters.  A null name, path or source matches nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions import paths
from codeloom.graph import CALLABLE, Graph, Scope

COLUMNS = ("id", "kind", "name", "path", "line_number")


def _result(df: DataFrame, limit: int | None = None, columns: Sequence[str] = COLUMNS) -> DataFrame:
    out = df.select(*columns)
    return out if limit is None else out.orderBy("path", "line_number", "id").limit(limit)


def find_code(
    g: Graph, text: str, by: str = "name", path: str | None = None, scope: Scope | None = None, limit: int | None = None
) -> DataFrame:
    """Nodes by exact ``name``, by ``pattern`` in the name, by ``kind``, or by ``content`` of the source."""
    rule: dict[str, Column] = {
        "name": F.col("name") == text,
        "pattern": F.col("name").contains(text),
        "kind": F.col("kind") == text.upper(),
        "content": F.col("source").contains(text),
    }
    found = g.nodes.where(rule[by])
    if path is not None:
        found = found.where(F.col("path").contains(path))
    return _result(found if scope is None else found.where(scope.of()), limit)


def find_functions(g: Graph, text: str, limit: int | None = None) -> DataFrame:
    return _result(g.callables.where(F.col("name").contains(text)), limit)


def get_function(g: Graph, name: str) -> DataFrame:
    """``id, name, path, line_number, docstring`` of the functions of a name."""
    return g.callables.where(F.col("name") == name).select("id", "name", "path", "line_number", "docstring")


def find_by_name(g: Graph, name: str, kind: str | None = None, scope: Scope | None = None) -> DataFrame:
    found = g.nodes.where(F.col("name") == name)
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    return _result(found if scope is None else found.where(scope.of()))


def find_by_pattern(g: Graph, pattern: str, scope: Scope | None = None) -> DataFrame:
    """Nodes whose whole name matches a regular expression."""
    found = g.nodes.where(F.col("name").rlike(f"^(?:{pattern})$"))
    return _result(found if scope is None else found.where(scope.of()))


def find_by_path_prefix(g: Graph, prefix: str) -> DataFrame:
    return _result(g.nodes.where(F.col("path").startswith(prefix)))


def find_by_file(g: Graph, path: str, limit: int | None = None) -> DataFrame:
    return _result(g.nodes.where(F.col("path").contains(path)), limit)


def find_in_module(g: Graph, module: str, limit: int | None = None) -> DataFrame:
    return _result(g.callables.where(F.col("path").contains(module)), limit)


def find_similar(g: Graph, name: str, limit: int | None = None) -> DataFrame:
    """Functions whose name holds another's, except of that very name."""
    return _result(g.callables.where(F.lower("name").contains(name.lower()) & (F.col("name") != name)), limit)


def find_by_decorator(g: Graph, text: str, columns: Sequence[str] = ("decorators",)) -> DataFrame:
    """Nodes one of whose ``properties`` of these names holds a text; nodes without properties match nothing."""
    held = F.lit(False)
    for c in columns:
        held = held | F.coalesce(F.try_element_at("properties", F.lit(c)).contains(text), F.lit(False))
    return _result(g.raw_nodes.where(F.col("id").isNotNull() & held)).distinct()


def find_by_annotation(g: Graph, text: str) -> DataFrame:
    return find_by_decorator(g, text, ("annotations", "decorators"))


def find_by_argument(g: Graph, name: str) -> DataFrame:
    """Functions with a parameter of a name, over HAS_PARAMETER edges."""
    parameter = g.of_kind("PARAMETER").where(F.col("name") == name).select(F.col("id").alias("dst"))
    owner = g.links("HAS_PARAMETER").join(parameter, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return _result(g.callables.join(owner, "id", "left_semi"))


def test_rule() -> Column:
    """Names and paths of tests."""
    name, path = F.lower("name"), F.lower("path")
    return name.startswith("test_") | name.startswith("test") | path.contains("/tests/") | path.contains("_test.") | path.contains("/test/")


def find_tests(g: Graph) -> DataFrame:
    return _result(g.callables.where(test_rule()))


def find_tests_for(g: Graph, symbol: str) -> DataFrame:
    """Tests whose name holds a symbol's, and tests that call it."""
    named = g.callables.where(test_rule() & F.lower("name").contains(symbol.lower()))
    callers = g.call_sites.where(F.col("callee_name") == symbol).select(F.col("src").alias("id")).distinct()
    return _result(named).union(_result(g.callables.where(test_rule()).join(callers, "id", "left_semi"))).distinct()


def scoped_tests(g: Graph, symbol: str, scope: Scope) -> DataFrame:
    """Tests of a scope that call a symbol, or whose text mentions it."""
    callers = g.call_sites.where(F.col("callee_name") == symbol).select(F.col("src").alias("id"), F.lit(True).alias("calls")).distinct()
    tests = g.callables.where(scope.of() & test_rule()).join(callers, "id", "left")
    mention = F.coalesce(F.col("source").contains(symbol), F.lit(False)) | F.coalesce(F.col("docstring").contains(symbol), F.lit(False))
    return _result(tests.where(F.col("calls").isNotNull() | mention))


def find_complexity(g: Graph, name: str) -> DataFrame:
    """``id, name, path, complexity`` of a name; a missing complexity is 1."""
    return g.nodes.where(F.col("name") == name).select("id", "name", "path", F.coalesce("cyclomatic_complexity", F.lit(1)).alias("complexity"))


def across_repositories(g: Graph, repositories: Sequence[str], text: str, branch: str | None = None, limit: int | None = None) -> DataFrame:
    """``repository_path`` and the usual columns, of nodes in one of several repositories."""
    found = g.nodes.where(F.col("repository_path").isin(*repositories) & F.col("name").contains(text))
    if branch is not None:
        found = found.where(F.col("branch") == branch)
    out = found.select("repository_path", *COLUMNS)
    return out if limit is None else out.orderBy("repository_path", "name", "id").limit(limit)


def in_scope(g: Graph, scope: Scope) -> DataFrame:
    return _result(g.nodes.where(scope.of()))


def in_paths(g: Graph, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    return _result(g.nodes.where(paths.path_filter(F.col("path"), include, exclude)))


def edges_in_paths(g: Graph, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """``src, dst`` of resolved calls whose two ends pass a path filter together."""
    end = g.callables.select("id", "path")
    both = (
        g.calls.join(end.withColumnsRenamed({"id": "src", "path": "src_path"}), "src")
        .join(end.withColumnsRenamed({"id": "dst", "path": "dst_path"}), "dst")
    )
    return both.where(paths.multi_path_filter(F.array("src_path", "dst_path"), include, exclude)).select("src", "dst")


def definitional(g: Graph, kinds: Sequence[str]) -> DataFrame:
    return _result(g.of_kind(*kinds))


def callables(g: Graph) -> DataFrame:
    return _result(g.of_kind(*CALLABLE))


def grep(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """``key, line_number, line`` of the lines that match a regular expression; lines count from 1."""
    lines = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return lines.where(F.col("line").rlike(pattern)).select(key, (F.col("i") + 1).alias("line_number"), "line")


def slice_lines(texts: DataFrame, key: str, text: str, first: int, last: int) -> DataFrame:
    """``key, line_number, line`` of a range of lines, both ends included."""
    part = F.slice(F.split(text, "\n"), first, last - first + 1)
    return texts.where(F.col(text).isNotNull()).select(key, F.posexplode(part).alias("i", "line")).select(
        key, (F.col("i") + first).alias("line_number"), "line"
    )


def peek(texts: DataFrame, key: str, text: str, chars: int = 200) -> DataFrame:
    """``key, head, size``: the start of each text and its length."""
    return texts.select(key, F.substring(text, 1, chars).alias("head"), F.length(text).alias("size"))
