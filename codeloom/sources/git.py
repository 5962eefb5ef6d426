"""Rows about commits, read from a repository by its own command; what it prints becomes a DataFrame.

The output of one command is bounded by the history asked for; a repository that
cannot be read is an error.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

COMMITS = "commit string, author string, email string, committed_at timestamp, subject string"
_FORMAT = "%H%x1f%an%x1f%ae%x1f%ct%x1f%s"


def _git(folder: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise ValueError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def _commits(spark: SparkSession, text: str) -> DataFrame:
    rows = [line.split("\x1f") for line in text.splitlines() if line.count("\x1f") == 4]
    frame = spark.createDataFrame([(a, b, c, int(t), s) for a, b, c, t, s in rows], "commit string, author string, email string, t long, subject string")
    return frame.selectExpr("commit", "author", "email", "timestamp_seconds(t) as committed_at", "subject")


def history(spark: SparkSession, folder: str, limit: int | None = None, path: str | None = None, branch: str = "HEAD") -> DataFrame:
    """Commits of a branch, the newest first, of one path if given."""
    args = ["log", f"--format={_FORMAT}", *([f"-{limit}"] if limit is not None else []), branch, "--", *([path] if path else [])]
    return _commits(spark, _git(folder, *args))


def branch_compare(spark: SparkSession, folder: str, base: str, other: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``ahead, behind``; the commits of ``other`` that ``base`` lacks; and ``path, state`` of the files that differ since they parted."""
    behind, ahead = map(int, _git(folder, "rev-list", "--left-right", "--count", f"{base}...{other}").split())
    counts = spark.createDataFrame([(ahead, behind)], "ahead long, behind long")
    commits = _commits(spark, _git(folder, "log", f"--format={_FORMAT}", f"{base}..{other}"))
    names = {"A": "added", "M": "changed", "D": "deleted", "R": "renamed", "C": "copied", "T": "changed"}
    files = [line.split("\t") for line in _git(folder, "diff", "--name-status", f"{base}...{other}").splitlines()]
    return counts, commits, spark.createDataFrame([(f[-1], names.get(f[0][0], "changed")) for f in files if len(f) > 1], "path string, state string")


def blame(spark: SparkSession, folder: str, path: str, revision: str = "HEAD") -> DataFrame:
    """``line_number, commit, author, line`` of a file."""
    rows, commit, authors, number = [], "", {}, 0
    for line in _git(folder, "blame", "--line-porcelain", revision, "--", path).splitlines():
        if m := re.match(r"([0-9a-f]{40}) \d+ (\d+)", line):
            commit, number = m.group(1), int(m.group(2))
        elif line.startswith("author "):
            authors[commit] = line[7:]
        elif line.startswith("\t"):
            rows.append((number, commit, authors.get(commit), line[1:]))
    return spark.createDataFrame(rows, "line_number int, commit string, author string, line string")


def changed_lines(spark: SparkSession, diff: str) -> DataFrame:
    """``path, first, last``: the ranges of lines that a unified diff puts into each file; a range of deletions alone is empty."""
    rows, path = [], None
    for line in diff.splitlines():
        if line.startswith("+++ "):
            path = re.sub(r"^b/", "", line[4:].split("\t")[0])
        elif m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line):
            start, count = int(m.group(1)), int(m.group(2) or 1)
            if path and path != "/dev/null" and count:
                rows.append((path, start, start + count - 1))
    return spark.createDataFrame(rows, "path string, first int, last int")


def explicit_files(spark: SparkSession, paths: Sequence[str], root: str = "") -> DataFrame:
    """``path`` of a supplied list: forward slashes, relative to a root, each once, none outside it."""
    base = root.replace("\\", "/").rstrip("/")
    out = set()
    for p in paths:
        p = re.sub(r"^(?:\./)+", "", p.strip().replace("\\", "/"))
        if base and p.startswith(base + "/"):
            p = p[len(base) + 1 :]
        if p and ".." not in p.split("/") and not (base and p.startswith("/")):
            out.add(p)
    return spark.createDataFrame([(p,) for p in sorted(out)], "path string")
