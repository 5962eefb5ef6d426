"""Column functions on paths: language, module, tests, and path filters."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# File extensions of the fourteen languages.
EXTENSIONS = {
    "c": "c h", "cpp": "cc cpp cxx hh hpp hxx", "go": "go", "java": "java", "javascript": "js mjs cjs jsx", "json": "json", "kotlin": "kt kts",
    "php": "php", "python": "py pyi", "ruby": "rb", "rust": "rs", "shell": "sh bash zsh", "swift": "swift", "typescript": "ts tsx mts cts",
}


def extension(path) -> Column:
    """The text after the last dot of the file name, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path) -> Column:
    """The language that a path's extension stands for, or null."""
    pairs = [F.lit(x) for lang, exts in EXTENSIONS.items() for e in exts.split() for x in (e, lang)]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def basename(path) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def module(path) -> Column:
    """The folder of a path, ``root`` without one."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(folder == "", "root").otherwise(folder)


def qualified(path, name) -> Column:
    """Path without extension and index files, with ``::``, and the name."""
    stem = F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), r"/(mod|__init__|index)$", "")
    return F.concat_ws("::", F.regexp_replace(F.ltrim(stem, F.lit("/")), "/", "::"), name)


def is_test_path(path) -> Column:
    p = F.lower(path)
    return p.contains("/test") | p.contains("/tests") | p.contains("_test.")


def is_test_artifact(path, name) -> Column:
    """A path in a test folder, a test file, or a test's name."""
    return F.coalesce(
        F.lower(path).rlike(r"(^|/)(tests?|spec|__tests__)/|(_test|\.test|\.spec|_spec)\.[^/]+$|(^|/)test_[^/]*$") | F.lower(name).rlike("^test_|_test$"),
        F.lit(False),
    )


def normal(path) -> Column:
    """Forward slashes, no leading ``./`` and no trailing slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", ""), "/+$", "")


def under(path, prefix: str) -> Column:
    """Whether a path is a folder, lies in it, or has it as a segment."""
    p = prefix.replace("\\", "/").removeprefix("./").rstrip("/")
    x = normal(path)
    return (x == p) | x.startswith(p + "/") | x.contains(f"/{p}/") | x.endswith("/" + p)


def is_file(path, name: str) -> Column:
    """Whether a path is a file of this name or ends with this relative path."""
    x = normal(path)
    return (basename(x) == name) | x.endswith("/" + name) | (x == name)


def glob(pattern: str) -> str:
    """A glob as a regular expression: ``**`` goes over folders, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            out, i = out + "[" + pattern[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return f"^{out}$"


def matches(path, pattern: str) -> Column:
    return normal(path).rlike(glob(pattern))


def path_filter(path, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Included by any folder, file or glob of ``include`` (all if empty), and by none of ``exclude``; a null path only passes without ``include``."""

    def hit(pattern: str) -> Column:
        return matches(path, pattern) if re.search(r"[*?\[]", pattern) else under(path, pattern) | is_file(path, pattern)

    def any_of(patterns: Sequence[str]) -> Column:
        found = F.lit(False)
        for p in patterns:
            found = found | F.coalesce(hit(p), F.lit(False))
        return found

    return (any_of(include) if include else F.lit(True)) & ~any_of(exclude)


def multi_path_filter(paths, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """As :func:`path_filter` for rows with several paths: none may be excluded, and one must be included."""
    clean = F.filter(paths, lambda p: p.isNotNull())
    kept = ~F.exists(clean, lambda p: ~path_filter(p, (), exclude))
    return kept & F.exists(clean, lambda p: path_filter(p, include)) if include else kept


def import_matches(imported, module_name: str) -> Column:
    """Whether an import names a module: equal, one a prefix of the other at ``::``, or in a group ``a::{b, c}``."""
    head = F.regexp_extract(imported, r"^(.*?)(?:::)?\{", 1)
    items = F.transform(F.split(F.regexp_extract(imported, r"\{(.*)\}", 1), ","), lambda x: F.concat(head, F.lit("::"), F.trim(x)))
    names = F.when(imported.contains("{"), items).otherwise(F.array(imported))
    target = F.lit(module_name)
    return F.exists(names, lambda x: (x == target) | x.startswith(F.concat(target, F.lit("::"))) | target.startswith(F.concat(x, F.lit("::"))))
