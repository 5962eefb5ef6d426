"""Whether a source is valid in a language, and the operator over tables."""

from __future__ import annotations

import hashlib
import sys

from pyspark.sql import DataFrame, functions as F

from codeloom.llm.common import canonical_language, files, language_of, map_columns
from codeloom.llm.syntax import braces, data, go, kotlin, php, rust, script, swift
from codeloom.llm.syntax.base import BAD, CONFLICT
from codeloom.llm.syntax.python import python_errors
from codeloom.llm.syntax.ruby import ruby_errors
from codeloom.llm.syntax.shell import shell_errors

PARSERS = {
    "c": (braces.C_LEXER, braces.C, None),
    "cpp": (braces.CPP_LEXER, braces.Cpp, None),
    "go": (go.GO_LEXER, go.Go, go.fold),
    "java": (braces.JAVA_LEXER, braces.Java, None),
    "javascript": (script.JS_LEXER, script.Script, script.fold),
    "json": (data.JSON_LEXER, data.Json, None),
    "kotlin": (kotlin.KOTLIN_LEXER, kotlin.Kotlin, kotlin.fold),
    "php": (php.PHP_LEXER, php.Php, None),
    "rust": (rust.RUST_LEXER, rust.Rust, None),
    "swift": (swift.SWIFT_LEXER, swift.Swift, swift.fold),
    "typescript": (script.TS_LEXER, script.TypeScript, script.fold),
}

#: Languages whose tokens depend on the grammar have functions of their own.
OWN = {"python": python_errors, "ruby": ruby_errors, "shell": shell_errors}

_LEXICAL = {CONFLICT: "conflict marker", BAD: "stray character or literal that is not closed"}


def original(kinds: str, folded: str, at: int) -> int:
    """The index in ``kinds`` of what is at ``at`` in the folded kinds, from which only line ends are missing."""
    ordinal = len(folded[:at].replace("\n", ""))
    for i, k in enumerate(kinds):
        if k != "\n":
            if not ordinal:
                return i
            ordinal -= 1
    return len(kinds)


def check(source: str, language: str) -> list[tuple[int, str]] | None:
    """``(line, message)`` of every error, lexical ones too, that recovery leads to, in order.

    None for a language without a parser and for a source that its parser came to
    a limit of its own with; no error in an empty source.
    """
    text = source.removeprefix("\ufeff").replace("\r\n", "\n")
    if language not in PARSERS and language not in OWN:
        return None
    # Python frames live on the heap, so nesting is bounded by memory alone.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 16 * len(text) + 10_000))
    if language in OWN:
        return OWN[language](text)
    lexer, parser, fold = PARSERS[language]
    kinds = lexer.kinds(text)
    if not kinds.strip("\n"):
        return []
    errors = {i: _LEXICAL[k] for i, k in enumerate(kinds) if k in _LEXICAL}
    folded = fold(kinds) if fold else kinds
    for at, message in parser(folded).run():
        errors.setdefault(original(kinds, folded, at), message)
    return [(line, errors[at]) for at, line in lines_of(lexer, text, sorted(errors))]


def lines_of(lexer, text: str, wanted: list[int]) -> list[tuple[int, int]]:
    """``(index, line)`` of the tokens that gave the kinds at these ascending indexes, in one pass; the last line past the end."""
    out, todo, seen, line, at = [], iter(wanted), 0, 1, 0
    index = next(todo, None)
    for m in lexer.pattern.finditer(text):
        if index is None:
            return out
        seen += len(lexer[m.group()])
        while index is not None and seen > index:
            line, at = line + text.count("\n", at, m.start()), m.start()
            out.append((index, line))
            index = next(todo, None)
    if index is not None:
        last = text.count("\n") + 1
        out += [(i, last) for i in (index, *todo)]
    return out


def _judge(cols: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"path": [], "repository_path": [], "language": [], "current": [], "errors": []}
    for path, source, records in zip(cols["path"], cols["source"], cols["records"]):
        digest = hashlib.md5(source.encode()).hexdigest()
        current = any(r["content_hash"] == digest for r in records)
        # The record of this text counts before others, then the latest.
        ranked = sorted(records, key=lambda r: (r["content_hash"] == digest, str(r["written_at"] or ""), str(r["spilled_at"] or "")), reverse=True)
        named = (canonical_language(r["language"]) for r in ranked)
        language = next((x for x in named if x), None) or language_of(path)
        errors = check(source, language) if language else None
        out["path"].append(path)
        out["repository_path"].append(next((r["repository_path"] for r in ranked if r["repository_path"] is not None), None))
        out["language"].append(language)
        out["current"].append(current)
        out["errors"].append(None if errors is None else [{"line": line, "message": message} for line, message in errors])
    return out


def judged_files(deferred: DataFrame, nodes: DataFrame) -> DataFrame:
    """``path, repository_path, language, errors`` of the deferred files that have a source.

    ``errors`` is null where no parser can judge a source, empty where every source
    is valid.  Of several sources of a path those count that a record's hash
    names, if any; null paths and sources give no row; repeated rows count once.
    """
    records = (
        deferred.where(F.col("path").isNotNull())
        .groupBy("path")
        .agg(F.collect_set(F.struct("language", "content_hash", "repository_path", "written_at", "spilled_at")).alias("records"))
    )
    joined = files(nodes).select("path", "source").join(records, "path").dropDuplicates(["path", "source"])
    schema = "path string, repository_path string, language string, current boolean, errors array<struct<line:int,message:string>>"
    judged = map_columns(joined, _judge, schema)
    return (
        judged.groupBy("path", "repository_path", "language")
        .agg(F.max("current").alias("known"), F.collect_list(F.struct("current", "errors")).alias("all"))
        .select("path", "repository_path", "language", F.expr("filter(all, x -> x.current = known)").alias("kept"))
        .select(
            "path", "repository_path", "language",
            F.expr("flatten(transform(filter(kept, x -> x.errors is not null), x -> x.errors))").alias("errors"),
            F.expr("exists(kept, x -> x.errors is null)").alias("open"),
        )
        # A source without a judgement leaves its path open, unless another one is known to be wrong.
        .select("path", "repository_path", "language", F.expr("if(open and size(errors) = 0, null, errors)").alias("errors"))
    )


def file_errors(deferred: DataFrame, nodes: DataFrame) -> DataFrame:
    """``path, language, line, message`` of every error in a deferred file."""
    return judged_files(deferred, nodes).select("path", "language", F.explode("errors").alias("e")).select("path", "language", "e.line", "e.message").distinct()


def invalid_files(deferred: DataFrame, nodes: DataFrame) -> DataFrame:
    """``path`` of the deferred files whose source is not valid."""
    return judged_files(deferred, nodes).where(F.size("errors") > 0).select("path").distinct()


def rates(deferred: DataFrame, nodes: DataFrame) -> DataFrame:
    """``repository_path, language, files, unjudged, invalid, rate``; ``rate`` is the share of the judged files and null if there are none."""
    counted = judged_files(deferred, nodes).groupBy("repository_path", "language").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("errors").isNull()).alias("unjudged"),
        F.count_if(F.coalesce(F.size("errors") > 0, F.lit(False))).alias("invalid"),
    )
    judged = F.col("files") - F.col("unjudged")
    return counted.withColumn("rate", F.when(judged > 0, F.round(F.col("invalid") / judged, 6)))
