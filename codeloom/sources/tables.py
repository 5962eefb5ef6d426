"""Writing and reading the graph: upserts, tombstones, bundles, file listings.

A table is rewritten by an anti join and a union, which needs no update in
place; edges are only kept between nodes that exist.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.functions import paths
from codeloom.graph import Graph
from codeloom.session import cut

# Folders and endings that are never indexed.
IGNORED = ("**/node_modules/**", "**/target/**", "**/dist/**", "**/build/**", "**/.git/**", "**/vendor/**", "**/__pycache__/**", "**/*.min.js", "**/*.lock")


def upsert_nodes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Nodes with incoming ones in place of those of the same id; repeated incoming rows count once, the greatest value of a column."""
    columns = [c for c in existing.columns if c != "id" and not dict(existing.dtypes)[c].startswith("map")]
    new = incoming.where(F.col("id").isNotNull()).groupBy("id").agg(*[F.max(c).alias(c) for c in columns])
    old = existing.where(F.col("id").isNotNull()).select("id", *columns)
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


def upsert_edges(existing: DataFrame, incoming: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst, kind`` of all edges whose two ends are nodes, each once."""
    both = existing.select("src", "dst", "kind").unionByName(incoming.select("src", "dst", "kind")).distinct()
    ids = nodes.where(F.col("id").isNotNull()).select("id").distinct()
    return both.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "kind")


def delete_repository(g: Graph, repository: str) -> tuple[DataFrame, DataFrame]:
    """The nodes outside a repository, and the edges that touch none of its nodes."""
    gone = g.raw_nodes.where(F.col("repository_path") == repository).select("id").distinct()
    nodes = g.raw_nodes.where(F.col("id").isNotNull()).join(gone, "id", "left_anti")
    links = g.edges.select("src", "dst", "kind").distinct()
    kept = links.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes, kept.select("src", "dst", "kind")


def without_tombstones(nodes: DataFrame, tombstones: DataFrame, key: Sequence[str] = ("repository_path", "branch", "path")) -> DataFrame:
    """Nodes whose place has no tombstone."""
    return nodes.join(tombstones.select(*key).distinct(), list(key), "left_anti")


def changed_files(before: DataFrame, after: DataFrame, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """``path, state``: added, deleted, changed or renamed (one digest gone from one path and new at another), unchanged ones left out."""
    a = before.select(F.col(key), F.col(digest).alias("a")).distinct()
    b = after.select(F.col(key), F.col(digest).alias("b")).distinct()
    j = a.join(b, key, "full").where(F.col("a").isNull() | F.col("b").isNull() | (F.col("a") != F.col("b")))
    gone = j.where(F.col("b").isNull()).select(F.col("a").alias("b")).distinct().withColumn("moved", F.lit(True))
    j = j.join(gone, "b", "left")
    state = F.when(F.col("a").isNull() & F.col("moved"), "renamed").when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").otherwise("changed")
    return j.select(key, state.alias("state"))


def index_files(listing: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = IGNORED) -> DataFrame:
    """The files to index: known languages, none of the ignored places, and whatever is included by name."""
    known = paths.language("path").isNotNull()
    kept = known & paths.path_filter(F.col("path"), (), exclude)
    if include:
        kept = kept | paths.path_filter(F.col("path"), include)
    return listing.where(F.coalesce(kept, F.lit(False)))


def ignored(path, patterns: Sequence[str] = IGNORED):
    """Whether any pattern of an ignore list holds; later patterns with ``!`` take a path back."""
    out = F.lit(False)
    for p in patterns:
        hit = F.coalesce(paths.matches(path, p.removeprefix("!")), F.lit(False))
        out = out & ~hit if p.startswith("!") else out | hit
    return out


def scan_tree(spark: SparkSession, folder: str, include: Sequence[str] = (), exclude: Sequence[str] = IGNORED) -> DataFrame:
    """``path, source, content_hash, language`` of the files below a folder, read by the executors."""
    raw = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(folder)
    rows = raw.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"), F.col("value").alias("source"))
    return index_files(rows, include, exclude).withColumn("content_hash", F.md5("source")).withColumn("language", paths.language("path"))


def export_bundle(g: Graph, repository: str, folder: str) -> None:
    """A repository's nodes and inner edges as parquet."""
    nodes = g.nodes.where(F.col("repository_path") == repository)
    ids = nodes.select("id")
    inner = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    inner.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/edges")


def import_bundle(spark: SparkSession, folder: str) -> Graph:
    return Graph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))


def diff_hunks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_number, old_start, old_count, new_start, new_count``: the hunk heads of unified diffs within texts; an absent count is 1."""
    lines = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("i", "line")).where(F.col("line").startswith("@@ -"))
    rule = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    part = lambda n: F.regexp_extract("line", rule, n)
    count = lambda n: F.when(part(n) == "", 1).otherwise(F.expr(f"try_cast(regexp_extract(line, '{rule.replace(chr(92), chr(92) * 2)}', {n}) as int)"))
    return lines.where(F.col("line").rlike(rule)).select(
        key, (F.col("i") + 1).alias("line_number"), part(1).cast("int").alias("old_start"), count(2).alias("old_count"), part(3).cast("int").alias("new_start"), count(4).alias("new_count")
    )


# Files that name a build system.
BUILD_FILES = {
    "Cargo.toml": "cargo", "package.json": "npm", "pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle", "go.mod": "go", "pyproject.toml": "python",
    "setup.py": "python", "requirements.txt": "python", "Gemfile": "bundler", "composer.json": "composer", "Makefile": "make", "CMakeLists.txt": "cmake", "Package.swift": "swiftpm",
}


def build_systems(files: DataFrame) -> DataFrame:
    """``repository_path, build_system, files``: by the names of files."""
    table = F.create_map(*[F.lit(x) for kv in BUILD_FILES.items() for x in kv])
    named = files.select("repository_path", F.try_element_at(table, paths.basename("path")).alias("build_system")).where(F.col("build_system").isNotNull())
    return named.groupBy("repository_path", "build_system").agg(F.count("*").alias("files"))


def query_tables(g: Graph, sql: str, **values) -> DataFrame:
    """SQL over ``nodes`` and ``edges`` of a graph, with named parameters (``:name``), never spliced text."""
    return g.raw_nodes.sparkSession.sql(sql, args=values, nodes=g.nodes, edges=g.edges) if "{nodes}" in sql or "{edges}" in sql else g.raw_nodes.sparkSession.sql(sql, args=values)


def replace_table(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a table over itself: what was read is materialised first."""
    held = cut(rows)
    w = held.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
