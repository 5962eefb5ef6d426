"""Symbols and edges from source text: definitions, calls, imports, heritage.

Python is read by its own parser, other languages by the patterns of their
declarations.  Files come in batches and leave as rows, without a shuffle; a
file that cannot be read gives no row.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, record string, kind string, name string, owner string, target string, line_number int"

_FN = {
    "c": r"^[A-Za-z_][\w\s\*]*?\b([A-Za-z_]\w*)\s*\([^;{}]*\)\s*\{", "cpp": r"^[ \t]*(?:[\w:<>,\*&~]+\s+)+\*?&?(?:\w+::)*([A-Za-z_~]\w*)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{",
    "go": r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", "java": r"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|native)\s+)*[\w<>\[\],.? ]+?\s+([A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:throws [\w., ]+)?\{",
    "javascript": r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)|^[ \t]*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>|^[ \t]+(?:async\s+|static\s+)*([A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*\{",
    "kotlin": r"^[ \t]*(?:(?:public|private|internal|protected|override|suspend|inline|open|abstract|operator|infix|tailrec)\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w<>?.]+\.)?([A-Za-z_]\w*)",
    "php": r"^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?([A-Za-z_]\w*)", "ruby": r"^[ \t]*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)",
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+([A-Za-z_]\w*)", "shell": r"^[ \t]*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{|^[ \t]*function\s+([A-Za-z_][\w-]*)",
    "swift": r"^[ \t]*(?:@\w+\s+)*(?:(?:public|private|internal|fileprivate|open|static|class|final|override|mutating)\s+)*func\s+([A-Za-z_]\w*)",
}
_FN["typescript"] = _FN["javascript"].replace(r"\([^;{}]*\)\s*\{", r"(?:<[^>]*>)?\([^;{}]*\)\s*(?::[^{};]+)?\{")
_TYPE = {
    "c": r"^(?:typedef\s+)?(struct|enum|union)\s+([A-Za-z_]\w*)\s*\{", "cpp": r"^[ \t]*(?:template\s*<[^>]*>\s*)?(class|struct|enum)\s+(?:class\s+)?([A-Za-z_]\w*)(?:\s*final)?\s*(?::\s*([^{;]+))?\{",
    "go": r"^type\s+([A-Za-z_]\w*)\s+(struct|interface)\b", "java": r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(class|interface|enum|record)\s+([A-Za-z_]\w*)(?:<[^{>]*>)?\s*(?:\([^)]*\)\s*)?((?:extends|implements)[^{]+)?\{",
    "javascript": r"^[ \t]*(?:export\s+)?(?:default\s+)?(class)\s+([A-Za-z_$][\w$]*)\s*(extends\s+[\w$.]+)?", "kotlin": r"^[ \t]*(?:\w+\s+)*?(class|interface|object)\s+([A-Za-z_]\w*)(?:<[^>]*>)?(?:\s*\([^)]*\))?\s*(?::\s*([^{\n]+))?",
    "php": r"^[ \t]*(?:abstract\s+|final\s+)*(class|interface|trait)\s+([A-Za-z_]\w*)\s*((?:extends|implements)[^{]+)?", "ruby": r"^[ \t]*(class|module)\s+([A-Z]\w*)(?:\s*<\s*([\w:]+))?",
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(struct|enum|trait|type|mod|const|static|macro_rules!)\s+([A-Za-z_]\w*)", "swift": r"^[ \t]*(?:(?:public|private|internal|final|open)\s+)*(class|struct|enum|protocol|extension|actor)\s+([A-Za-z_]\w*)(?:<[^>]*>)?\s*(?::\s*([^{\n]+))?",
}
_TYPE["typescript"] = r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+|declare\s+)*(class|interface|enum|type)\s+([A-Za-z_$][\w$]*)(?:<[^>{]*>)?\s*((?:extends|implements)[^{=]+)?"
_IMPORT = {
    "c": r"^\s*#\s*include\s*[<\"]([^>\"]+)", "go": r"^(?:import\s+)?\s*(?:[\w.]+\s+)?\"([^\"]+)\"\s*$", "java": r"^import\s+(?:static\s+)?([\w.*]+);", "javascript": r"^\s*import\b[^'\"]*['\"]([^'\"]+)['\"]|\brequire\(\s*['\"]([^'\"]+)['\"]",
    "kotlin": r"^import\s+([\w.*]+)", "php": r"^use\s+([\w\\]+)", "ruby": r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)", "rust": r"^\s*(?:pub\s+)?use\s+([\w:{}, *]+);", "shell": r"^\s*(?:\.|source)\s+(\S+)", "swift": r"^import\s+([\w.]+)",
}
_IMPORT["cpp"], _IMPORT["typescript"] = _IMPORT["c"], _IMPORT["javascript"]
_KINDS = {"class": "CLASS", "struct": "STRUCT", "enum": "ENUM", "union": "STRUCT", "interface": "INTERFACE", "trait": "TRAIT", "protocol": "INTERFACE", "object": "CLASS", "record": "CLASS", "module": "MODULE",
          "mod": "MODULE", "type": "TYPE_ALIAS", "const": "CONSTANT", "static": "CONSTANT", "macro_rules!": "MACRO", "extension": "CLASS", "actor": "CLASS"}
_CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_]\w*(?:\.|::|->))*[A-Za-z_]\w*)!?\(")
_NO_CALL = frozenset("if for while switch match return catch sizeof function fn func def class elif when until unless print and or not in new await yield throw typeof super".split())
_HERITAGE = re.compile(r"[A-Za-z_]\w*(?:(?:::|\.)\w+)*")
_SKIP = frozenset("extends implements public private protected virtual with".split())

Row = tuple[str, str, str | None, str | None, str | None, int]


def python_records(text: str) -> list[Row]:
    """``record, kind, name, owner, target, line`` of a Python file; nothing if it is not valid."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[Row] = []
    todo: list[tuple[ast.AST, str | None, str | None]] = [(tree, None, None)]
    while todo:
        node, owner, function = todo.pop()
        for child in ast.iter_child_nodes(node):
            o, f = owner, function
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(("node", "METHOD" if owner and isinstance(node, ast.ClassDef) else "FUNCTION", child.name, owner, None, child.lineno))
                for a in [*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs]:
                    out.append(("node", "PARAMETER", a.arg, child.name, None, a.lineno))
                f = child.name
            elif isinstance(child, ast.ClassDef):
                out.append(("node", "CLASS", child.name, owner, None, child.lineno))
                for b in child.bases:
                    out.append(("edge", "INHERITS", child.name, None, ast.unparse(b).split(".")[-1], child.lineno))
                o = child.name
            elif isinstance(child, ast.Call):
                name = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else None
                if name:
                    out.append(("edge", "CALLS", function, owner, name, child.lineno))
            elif isinstance(child, ast.Import):
                out += [("edge", "IMPORTS", None, None, a.name, child.lineno) for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                out.append(("edge", "IMPORTS", None, None, "." * child.level + (child.module or ""), child.lineno))
            todo.append((child, o, f))
    return out


def pattern_records(text: str, language: str) -> list[Row]:
    """The same by the patterns of a language: definitions, the calls on the lines of each function, imports and heritage."""
    out: list[Row] = []
    starts: list[tuple[int, str]] = []
    seen = set()
    if language in _TYPE:
        for m in re.finditer(_TYPE[language], text, re.M):
            kind, name = (m.group(2), m.group(1)) if language == "go" else (m.group(1), m.group(2))
            line = text.count("\n", 0, m.start(1)) + 1
            out.append(("node", _KINDS.get(kind, "CLASS"), name, None, None, line))
            if language not in ("go", "c", "rust") and m.lastindex and m.lastindex >= 3 and m.group(3):
                out += [("edge", "IMPLEMENTS" if "implements" in m.group(3) and "extends" not in m.group(3) else "INHERITS", name, None, re.split(r"::|\.", b)[-1], line) for b in _HERITAGE.findall(m.group(3)) if b not in _SKIP]
    if language == "rust":
        for m in re.finditer(r"^[ \t]*impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+([\w:]+)", text, re.M):
            out.append(("edge", "IMPLEMENTS", m.group(2).split("::")[-1], None, m.group(1).split("::")[-1], text.count("\n", 0, m.start(1)) + 1))
    if language in _FN:
        for m in re.finditer(_FN[language], text, re.M):
            name = next((x for x in m.groups() if x), None)
            line = text.count("\n", 0, m.start(m.lastindex)) + 1 if m.lastindex else 0
            if name and name not in _NO_CALL and (name, line) not in seen:
                seen.add((name, line))
                starts.append((line, name))
                out.append(("node", "FUNCTION", name, None, None, line))
    starts.sort()
    at = 0
    if language != "json":
        for number, row in enumerate(text.split("\n"), 1):
            while at < len(starts) and starts[at][0] <= number:
                at += 1
            caller = starts[at - 1][1] if at else None
            stripped = row.lstrip()
            if not caller or stripped.startswith(("//", "#", "*", "/*")) or (at and starts[at - 1][0] == number):
                continue
            out += [("edge", "CALLS", caller, None, re.split(r"\.|::|->", c)[-1], number) for c in _CALL.findall(re.sub(r"\"[^\"\n]*\"|'[^'\n]*'", '""', row)) if re.split(r"\.|::|->", c)[-1] not in _NO_CALL]
    if language in _IMPORT:
        for m in re.finditer(_IMPORT[language], text, re.M):
            name = next((x for x in m.groups() if x), None)
            if name:
                out.append(("edge", "IMPORTS", None, None, name, text.count("\n", 0, m.start(m.lastindex)) + 1))
    return out


def json_records(text: str) -> list[Row]:
    """The keys of a JSON object and of the objects in it."""
    return [("node", "PROPERTY", m.group(1), None, None, text.count("\n", 0, m.start()) + 1) for m in re.finditer(r"\"((?:[^\"\\\n]|\\.)*)\"\s*:", text)]


def records(text: str, language: str | None) -> list[Row]:
    text = text.replace("\r\n", "\n")
    if language == "python":
        return python_records(text)
    if language == "json":
        return json_records(text)
    return pattern_records(text, language) if language in _FN else []


def extract(files: DataFrame) -> DataFrame:
    """``path, record, kind, name, owner, target, line_number`` of all files (``path, language, source``); null sources give no row."""
    arrow = pa.schema([("path", pa.string()), ("record", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("owner", pa.string()), ("target", pa.string()), ("line_number", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, language, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if source:
                    rows += [(path, *r) for r in records(source, language)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)] if rows else [pa.array([], type=f.type) for f in arrow], schema=arrow)

    return files.select("path", "language", "source").mapInArrow(run, SCHEMA)
