"""Queries that parse source text into symbols and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.plans.registry import Workspace, query
from codeloom.sources import extract as op


def files(w: Workspace):
    f = w.graph.of_kind("FILE").where(F.col("source").isNotNull() & F.col("path").isNotNull())
    return f.select("path", paths.language("path").alias("language"), "source")


@query()
def parse_files(w: Workspace):
    return op.extract(files(w)).groupBy("record", "kind").agg(F.count("*").alias("n"))


@query()
def extracted_symbols(w: Workspace):
    """``language, kind, n``: what the extractor of each language finds."""
    parsed = op.extract(files(w)).where(F.col("record") == "node")
    return parsed.groupBy(paths.language("path").alias("language"), "kind").agg(F.count("*").alias("n"))


@query(
    r"SELECT path, count(*) AS functions FROM (SELECT path, unnest(regexp_extract_all(replace(source, chr(13), ''), '(?m)^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)', 1)) AS name FROM n WHERE kind = 'FILE' AND source IS NOT NULL AND ends_with(path, '.go')) GROUP BY 1"
)
def extract_go(w: Workspace):
    parsed = op.extract(files(w).where(F.col("language") == "go")).where((F.col("record") == "node") & (F.col("kind") == "FUNCTION"))
    return parsed.groupBy("path").agg(F.count("*").alias("functions"))


@query(
    r"SELECT path, count(*) AS functions FROM (SELECT path, unnest(regexp_extract_all(replace(source, chr(13), ''), '(?m)^[ \t]*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)', 1)) AS name FROM n WHERE kind = 'FILE' AND source IS NOT NULL AND ends_with(path, '.rb')) GROUP BY 1"
)
def extract_ruby(w: Workspace):
    parsed = op.extract(files(w).where(F.col("language") == "ruby")).where((F.col("record") == "node") & (F.col("kind") == "FUNCTION"))
    return parsed.groupBy("path").agg(F.count("*").alias("functions"))


@query(
    r"SELECT path, count(*) AS imports FROM (SELECT path, unnest(regexp_extract_all(replace(source, chr(13), ''), '(?m)^\s*(?:pub\s+)?use\s+([\w:{}, *]+);', 1)) AS name FROM n WHERE kind = 'FILE' AND source IS NOT NULL AND ends_with(path, '.rs')) GROUP BY 1"
)
def extract_rust_imports(w: Workspace):
    parsed = op.extract(files(w).where(F.col("language") == "rust")).where(F.col("kind") == "IMPORTS")
    return parsed.groupBy("path").agg(F.count("*").alias("imports"))


@query(
    "SELECT path, ((length(source) - length(replace(source, '\":', ''))) // 2)::INTEGER AS keys FROM n WHERE kind = 'FILE' AND source IS NOT NULL AND ends_with(path, '.json') AND contains(source, '\":')"
)
def extract_json(w: Workspace):
    parsed = op.extract(files(w).where(F.col("language") == "json"))
    return parsed.groupBy("path").agg(F.count("*").cast("int").alias("keys"))


@query()
def extracted_calls(w: Workspace):
    """``callee, callers, files``: the calls that the extractors find, by callee."""
    calls = op.extract(files(w)).where(F.col("kind") == "CALLS")
    return calls.groupBy(F.col("target").alias("callee")).agg(F.countDistinct("path", "name").alias("callers"), F.countDistinct("path").alias("files"))
