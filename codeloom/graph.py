"""The property graph: typed nodes and edges, cleaned once and shared by all operators.

Nodes and edges arrive repeatedly and in parts.  A node is one row for each id
and an edge one row for each (src, dst, kind, callee, line); of several values
of a column the greatest counts, so a value beats a missing one.  Both are plain
aggregates with a map-side combine, and an operator that reads few columns
shuffles few: the optimiser drops the aggregates nobody asks for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

NODE_COLUMNS = (
    "kind name path line_number lang source docstring cyclomatic_complexity qualified_name visibility branch repository_path"
).split()

# The kinds of nodes and of edges.
NODE_KINDS = frozenset(
    "REPOSITORY DIRECTORY FILE FUNCTION METHOD CLASS STRUCT TRAIT INTERFACE ENUM ENUM_VARIANT MACRO VARIABLE CONSTANT PARAMETER TYPE_ALIAS "
    "MODULE PROPERTY FIELD CALL_TARGET".split()
)
EDGE_KINDS = frozenset(
    "CONTAINS DEFINED_IN CALLS REFERENCES TYPE_REFERENCE FIELD_ACCESS IMPORTS INHERITS IMPLEMENTS USES HAS_PARAMETER THROWS RETURNS HAS_FIELD "
    "HAS_METHOD HAS_PROPERTY MEMBER_OF DOCUMENTS ANNOTATES SIMILAR_TO".split()
)
CALLABLE = ("FUNCTION", "METHOD")
DEFINITIONS = ("FUNCTION", "METHOD", "CLASS", "STRUCT", "TRAIT", "INTERFACE", "ENUM", "MACRO", "CONSTANT", "TYPE_ALIAS", "MODULE")


@dataclass(frozen=True)
class Scope:
    """A repository and, if given, one of its branches."""

    repository_path: str
    branch: str | None = None

    def of(self, prefix: str = ""):
        """The predicate on columns with this prefix."""
        held = F.col(prefix + "repository_path") == self.repository_path
        return held if self.branch is None else held & (F.col(prefix + "branch") == self.branch)


class Graph:
    """Nodes and edges of one workspace.

    Rows without id, or edges without an end, are no part of the graph.  Columns
    beyond the model are ignored; a missing model column counts as null.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.raw_nodes, self.raw_edges = nodes, edges

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> "Graph":
        return cls(spark.read.parquet(f"{folder}/nodes.parquet"), spark.read.parquet(f"{folder}/edges.parquet"))

    @cached_property
    def nodes(self) -> DataFrame:
        have = set(self.raw_nodes.columns)
        kept = self.raw_nodes.where(F.col("id").isNotNull())
        return kept.groupBy("id").agg(*[(F.max(c) if c in have else F.lit(None).cast("string")).alias(c) for c in NODE_COLUMNS])

    @cached_property
    def edges(self) -> DataFrame:
        """``src, dst, kind, callee_name, line_number, jaccard, confidence, provenance``."""
        target = F.when(F.col("dst").startswith("call_target:"), F.substring("dst", 13, 1 << 20))
        return (
            self.raw_edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
            .groupBy("src", "dst", "kind", F.coalesce("callee_name", target).alias("callee_name"), "line_number")
            .agg(F.max("jaccard").alias("jaccard"), F.max("confidence").alias("confidence"), F.max("provenance").alias("provenance"))
        )

    def of_kind(self, *kinds: str) -> DataFrame:
        return self.nodes.where(F.col("kind").isin(*kinds))

    def links(self, *kinds: str) -> DataFrame:
        """Distinct ``src, dst`` of the edges of these kinds, straight from the rows."""
        return (
            self.raw_edges.where(F.col("kind").isin(*kinds) & F.col("src").isNotNull() & F.col("dst").isNotNull())
            .select("src", "dst")
            .distinct()
        )

    @cached_property
    def callables(self) -> DataFrame:
        return self.of_kind(*CALLABLE)

    @cached_property
    def call_sites(self) -> DataFrame:
        """``src, callee_name, repository_path, branch``: who calls which name, and where; each once."""
        calls = self.edges.where((F.col("kind") == "CALLS") & F.col("callee_name").isNotNull()).select("src", "callee_name").distinct()
        who = self.nodes.select(F.col("id").alias("src"), "repository_path", "branch")
        return calls.join(who, "src")

    @cached_property
    def calls(self) -> DataFrame:
        """``src, dst``: calls resolved from placeholders to the functions of that name in the caller's repository and branch.

        One name may resolve to several functions.  Direct edges between
        functions count as they are.
        """
        target = self.callables.select(F.col("id").alias("dst"), F.col("name").alias("callee_name"), "repository_path", "branch")
        resolved = self.call_sites.join(target, ["repository_path", "branch", "callee_name"]).select("src", "dst")
        direct = self.links("CALLS").where(~F.col("dst").startswith("call_target:"))
        return resolved.union(direct).distinct()


# The same graph for DuckDB, as common table expressions.
SQL = {
    "n": "SELECT id, " + ", ".join(f"max({c}) AS {c}" for c in NODE_COLUMNS) + " FROM nodes WHERE id IS NOT NULL GROUP BY id",
    "e": (
        "SELECT src, dst, kind, coalesce(callee_name, CASE WHEN starts_with(dst, 'call_target:') THEN substr(dst, 13) END) AS callee_name, line_number, "
        "max(jaccard) AS jaccard, max(confidence) AS confidence, max(provenance) AS provenance FROM edges "
        "WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL"
    ),
    "f": "SELECT * FROM n WHERE kind IN ('FUNCTION', 'METHOD')",
    "sites": (
        "SELECT DISTINCT e.src, e.callee_name, s.repository_path, s.branch FROM e JOIN n s ON e.src = s.id "
        "WHERE e.kind = 'CALLS' AND e.callee_name IS NOT NULL"
    ),
    "c": (
        "SELECT s.src, f.id AS dst FROM sites s JOIN f ON f.name = s.callee_name AND f.repository_path = s.repository_path AND f.branch = s.branch "
        "UNION SELECT src, dst FROM e WHERE kind = 'CALLS' AND NOT starts_with(dst, 'call_target:')"
    ),
}


def with_graph(sql: str, recursive: bool = False) -> str:
    """A query over ``n, e, f, sites, c`` as one statement over the tables; a query may start with further expressions and a semicolon."""
    more, _, body = sql.rpartition(";;")
    views = ", ".join(f"{k} AS MATERIALIZED ({v})" if k == "c" else f"{k} AS ({v})" for k, v in SQL.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{', ' + more.strip() if more.strip() else ''} {body.strip()}"
