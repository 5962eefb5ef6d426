"""Functions paired with the documentation written for them.

The documentation of a FUNCTION or METHOD is taken from the FILE's source: the
comment that ends on the line before the signature (attributes may lie between)
or, in Python, the string that is the first statement.  What remains after tags,
rulers, directives, placeholders and the function's own name is its description.

A method whose documentation only says that it is inherited gets that of the
method it overrides: classes and all their bases are read from the sources, and
the open methods are joined with the methods of the next base classes, round by
round, until every one is resolved or has run out of bases.  A base is the class
of that name in the same file, else those of the repository.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, functions as F

from codeloom.llm.common import canonical_language, files, language_of, map_columns
from codeloom.session import cut

#: A description has at least so many words.
MIN_WORDS = 6
PAIR = (
    "node_id string, name string, owner string, repo string, place string, inherits boolean, code string, description string, "
    "words int, origin string, position int"
)

# Tags whose text describes the function itself.
_DESCRIBING = r"(?:brief|short|summary|desc|description|details|remarks?|abstract|discussion)"
# Lines that only stand in for a description.
_PLACEHOLDER = re.compile(
    r"^\W*(?:wip|placeholder|stub|n/?a|none|\.+|no (?:description|docs?|documentation|comments?)(?: (?:yet|available|provided|given|here|found|needed|so far))*|"
    r"\(?no description\)?|auto-?generated (?:method|function|constructor|javadoc|doc|comment)?\s*stub.*|to be (?:documented|described|written).*|"
    r"not yet (?:documented|described|written)(?: [\w'-]+){0,4}|(?:add|insert|write|put|enter) (?:a )?(?:description|documentation|docs?|comment|summary) here.*|"
    r"describe (?:me|this)(?: [\w'-]+){0,5}|undocumented(?: \w+)?|missing (?:docs?|documentation|docstring)|lorem ipsum.*)\W*$",
    re.I,
)
# What opens a remark to the writers, up to the next empty line; not a word about such remarks.
_REMARK = re.compile(
    r"^\W*(?:(?i:todo|fixme|xxx|tbd|tba)(?!['-]?\w)(?! (?i:items?|lists?|entr(?:y|ies)|comments?|notes?|markers?|tasks?)\b)|HACK\b|(?i:hack)(?=\s*(?:[:(]|$)))"
)
# Comments that speak to a tool; a tool's name alone may begin a sentence.
_COMMAND = r"(?:ignore|disable|enable|off|on|skip|expect|suppress|fixme|start|stop|push|pop|next|all)\b"
_DIRECTIVE = re.compile(
    r"^\W*(?:"
    r"(?:pylint|eslint|tslint|jshint|jslint|jscs|istanbul|c8|v8|rubocop|swiftlint|swiftformat|ktlint|detekt|checkstyle|spotbugs|phpcs|phpstan|psalm|phan|"
    r"shellcheck|shfmt|cppcheck|iwyu|rustfmt|clippy|mypy|pyright|pyre|flake8|isort|yapf|autopep8|codecov|cspell|spell-checker|codespell|nosonar|nopmd|nosec|sourcery|bandit)"
    r"(?:\s*[:=(]|[-_/]\w|\s+[\w/-]+\s*[:=]|\s+" + _COMMAND + r"|\W*$)|"
    r"(?:standard|prettier|biome|deno|webpack|reek|spotless|pmd|sonar|coverity|coverage|lint|black|clang)"
    r"(?:\s*[:=]|-(?:format|tidy|analyzer|lint-ignore|fmt-ignore|ignore|disable|enable|off|on|suppress)\b|\.\w|\s+(?:ignore|disable|enable|off|skip)\b|\W*$)|"
    r"nolint\w*|noqa\b|nocover\b|noinspection\b\s*\w|fall-?through\W*$|go:\w|\+build\b|type:\s*ignore|fmt:|webpackChunkName|pragma(?::|\s+(?:mark|once|warning|clang|gcc|omp|region|no)\b|\W*$)|"
    r"(?<=#)region\b|(?:region|endregion)(?:\s+\S+){0,3}\W*$|(?<=#)endregion\b|mark:|vim?:|-\*-|@?ts-(?:ignore|nocheck|expect-error|check)|@flow\b|@jsx|@formatter|language=)",
    re.I,
)
_LEGAL = re.compile(
    r"SPDX-|©|all rights reserved|\b(?:copyright|\(c\))\W+(?:\(c\)\s*|by\s+)?(?:19|20)\d\d\b|\bcopyright\s*\(c\)|^\W*(?:portions )?copyright\b(?! (?:notice|line|header|holder|owner|year|text|comment)s?\b)|"
    r"^\W*\(c\) |^\W*(?:(?:this|the) [\w ]{1,40} is )?(?:dual[ -])?licen[sc]ed (?:under|in the|to)\b|see (?:the )?LICEN[SC]E",
    re.I,
)
# Tags that may follow other text on their line; any other name counts at the start of a line only.
_BLOCK = (
    r"(?:params?|arg|args|argument|arguments|returns?|retval|result|throws?|exception|raises?|yields?|see|seealso|sa|since|version|authors?|copyright|licen[sc]e|date|"
    r"deprecated|todo|fixme|bug|notes?|warnings?|attention|important|pre|post|invariant|examples?|code|snippet|usage|typeparam|tparam|template|type|typedef|property|prop|"
    r"default|defaultvalue|override|overrides|inherit[-_]?doc|memberof|member|class|module|namespace|package|category|group|ingroup|internal|private|protected|public|"
    r"access|api|async|static|abstract|constructor|function|method|name|alias|callback|event|fires|emits|listens|requires|implements|extends|augments|receiver|sample|"
    r"suppress\w*|serial\w*|hide|hidden|beta|alpha|experimental|test|covers|group|dataProvider|link|uses|var|global|ignore|readonly|virtual|remarks)"
)
_TAG = re.compile(
    r"(?:(?:^|(?<=\n))[\s*]*[@\\](?!" + _DESCRIBING + r"\b)[A-Za-z][\w-]*|(?:^|(?<=[\s.;:!?,)>*]))(?:[@\\](?!" + _DESCRIBING + r"\b)" + _BLOCK + r"\b|"
    r":(?:param|type|returns?|rtype|raises?|raise|arg|keyword|var|ivar|cvar|meta)\b[^:\n]*:|"
    r"\{@(?!link|code|literal|value|plain)\w+[^}]*\}|#+ (?:Arguments|Parameters|Returns?|Errors?|Panics?|Safety|Examples?|Throws|See Also|Notes?)\b|"
    r"(?:Args|Arguments|Parameters|Params|Returns?|Yields?|Raises|Throws|Exceptions?|Attributes|Examples?|Usage|See Also|Note|Notes|Warnings?|References|"
    r"Keyword Args|Other Parameters|Complexity)\s*:(?=\s|$)|"
    r"-\s*(?:Parameters?|Returns?|Throws|Note|Warning|Important|Complexity|Precondition)\b[^\n:]*:|"
    r"(?:Parameters|Returns|Raises|Yields|Examples?|Notes|See Also)\s*\n\s*-{3,}))",
)
# Commands within a sentence, which set the word after them.
_INLINE = re.compile(r"(?<![\w@\\])[@\\](?:c|p|a|e|em|b|ref|link|endlink|n)(?![\w-])\s?")
_DESCRIBED = re.compile(r"[@\\]" + _DESCRIBING + r"\b:?")
_INHERIT = re.compile(r"\{?@inherit[-_]?doc\}?|:inherit-?doc:|<inheritdoc\s*/?>|\(see (?:super|base|parent)\)", re.I)
# Letters with the marks that combine with them.
_LETTER = r"(?:[^\W_]|[\u0300-\u036f\u0591-\u05bd\u05bf-\u05c7\u0610-\u061a\u064b-\u065f\u0670\u0900-\u0963\u0966-\u0dff\u0e31-\u0e4e\u0eb1-\u0ecd\u102b-\u103e\u17b4-\u17d3])"
_WORD = re.compile(_LETTER + r"+(?:['’\-]" + _LETTER + r"+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
# Scripts without spaces whose words have about five signs.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")
_RULER = re.compile(r"^[\W_]*$")

_ATTRIBUTE = re.compile(r"^(?:@(?!interface\b)[\w.]+(?:\(.*\))?(?:\s+@[\w.]+(?:\(.*\))?)*|#!?\[.*\]|\[\[.*\]\]|\[[A-Z]\w*(?:\(.*\))?\]|template\s*<.*>|__attribute__\s*\(\(.*\)\))\s*(?://.*|/\*.*\*/\s*)?$")
_OPENS_ATTRIBUTE = re.compile(r"@(?!interface\b)[\w.]+\s*\(|#!?\[|\[\[|\[[A-Z]\w*|__attribute__|template\s*<")
_LINE_REMARK = re.compile(r"(?://|#).*|/\*.*\*/")
_CLASS = re.compile(
    r"^[ \t]*(?:(?:export|default|declare|public|private|protected|internal|fileprivate|final|abstract|static|strictfp|non-sealed|open|sealed|data|inner|value|annotation|partial|"
    r"actual|expect|fun|unsafe|readonly|pub(?:\([^)]*\))?|@(?!interface\b)[\w.]+(?:\([^()\n]*\))?)[ \t]+)*"
    r"(?:class|struct|interface|trait|object|module|protocol|actor|extension|record|enum class|impl(?:<(?:[^<>]|<[^<>]*>)*>)?)\s+"
    r"(?:[A-Z][A-Z0-9_]*(?:\([^()\n]*\))?[ \t]+(?=[A-Za-z_]\w*[ \t]*(?:final\b[ \t]*)?(?:[:{]|$)))?([^\W\d]\w*(?:(?:::|\.)\w+)*)(?:<(?:[^<>{]|<[^<>]*>)*>)?[ \t]*([^{\n]*)",
    re.M,
)
# A class's head goes on where it ends like this, or where the next line begins like that.
_GOES_ON = re.compile(r"(?:[,:(<]|\b(?:extends|implements|with|for|permits))\s*$")
_CONTINUES = re.compile(r"\s*(?:(?:extends|implements|with|where|permits|for)\b|[,:](?!:))")
_IMPL = re.compile(r"\s*(?:(?:pub|unsafe)\s+)*impl\b")
_BASE = re.compile(r"[^\W\d][\w.:]*")
_NOT_BASE = frozenset("extends implements with where public private protected virtual for metaclass override final open abstract".split())

_HASH = frozenset({"python", "ruby", "shell"})


def strip_comment(lines: list[str]) -> str:
    """The text of comment lines without their markers."""
    text = []
    for raw in lines:
        x = raw.strip()
        x = re.sub(r"^(?:/\*+!?<?|//[/!]*<?|\*+/|\*(?!\*)|#+!?(?=\s|$)|=begin|=end|--+|<!--)", "", x, count=1) if x else x
        x = re.sub(r"\*+/\s*$|-->\s*$", "", x)
        text.append(x.strip())
    return "\n".join(text)


def above_attributes(lines: list[str], at: int) -> int:
    """The last line before line ``at`` that is no attribute, of one or several lines, and no comment to a tool alone."""
    i = at - 1
    while i >= 0:
        x = lines[i].strip()
        if _ATTRIBUTE.match(x):
            i -= 1
            continue
        if _LINE_REMARK.fullmatch(x) and _DIRECTIVE.match(strip_comment([x])) and i and lines[i - 1].strip():
            i -= 1
            continue
        depth, j = 0, i
        if x.endswith((")", "]", ">")):
            while j >= 0 and lines[j].strip() and not lines[j].rstrip().endswith(";"):
                depth += sum(map(lines[j].count, ")]")) - sum(map(lines[j].count, "(["))
                if _OPENS_ATTRIBUTE.match(lines[j].strip()) and depth <= 0:
                    break
                if depth <= 0 and not x.endswith(">"):
                    j = -1
                    break
                j -= 1
            else:
                j = -1
            if j >= 0:
                i = j - 1
                continue
        return i
    return i


def block_above(lines: list[str], i: int) -> list[str]:
    """The block comment that ends line ``i``, if it begins a line; its text may hold the opening sign too."""
    begin, j = None, i
    while j >= 0:
        x = lines[j].strip()
        if j < i and "*/" in x:
            break
        if x.startswith("/*"):
            begin = j
            if x.startswith("/**") or j == i:
                break
        j -= 1
    return lines[begin : i + 1] if begin is not None else []


def comment_above(lines: list[str], at: int, lang: str | None) -> list[str]:
    """The comment lines that end directly before the signature on line ``at`` (from 0), attributes and comments to tools left aside."""
    hashes = lang in _HASH
    head = lines[at].lstrip()
    if not hashes and "*/" in head and (head.startswith("/*") or "/*" not in head[: head.index("*/")]):
        end = head.index("*/") + 2
        return block_above([*lines[:at], head[:end]], at)
    i = above_attributes(lines, at)
    if i < 0:
        return []
    x = lines[i].strip()
    if not hashes and "*/" in x and not x.endswith("*/") and _ATTRIBUTE.match(x[x.rindex("*/") + 2 :].strip()):
        x = x[: x.rindex("*/") + 2]
        return block_above([*lines[:i], x], i)
    if x.endswith("*/") and not x.startswith("//"):
        return block_above(lines, i)
    if x == "=end" and lang == "ruby":
        j = i
        while j >= 0 and lines[j].strip() != "=begin":
            j -= 1
        return lines[j : i + 1] if j >= 0 else []
    mark = "#" if hashes or (lang == "php" and x.startswith("#") and not x.startswith("#[")) else "//"
    if mark == "#" and x.startswith("#!"):
        return []
    j = i
    while j >= 0 and lines[j].strip().startswith(mark) and not lines[j].startswith("#!"):
        j -= 1
    return lines[j + 1 : i + 1]


_STRING_START = re.compile(r"\s*([rRuU]{0,2})(\"\"\"|'''|\"|')")
_PYTHON_TOKEN = re.compile(r"\"\"\"|'''|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|#.*|[()\[\]{}:]")


def head_end(lines: list[str], at: int) -> tuple[int, int] | None:
    """The line and the column after the colon that ends the head on line ``at``."""
    depth, quote = 0, None
    for i in range(at, len(lines)):
        col = 0
        while True:
            if quote:  # a default value of several lines
                end = lines[i].find(quote, col)
                if end < 0:
                    break
                quote, col = None, end + 3
                continue
            m = _PYTHON_TOKEN.search(lines[i], col)
            if not m:
                break
            t, col = m.group(), m.end()
            if t in ('"""', "'''"):
                quote = t
            elif t in "([{":
                depth += 1
            elif t in ")]}":
                depth -= 1
            elif t == ":" and depth <= 0:
                return i, col
    return None


def python_docstring(lines: list[str], at: int) -> str | None:
    """The string that is the first statement of the function whose signature is line ``at``; adjacent parts count as one."""
    found = head_end(lines, at)
    if not found:
        return None
    i, col = found
    rest = lines[i][col:]
    if not rest.strip() or rest.lstrip().startswith("#"):
        i += 1
        while i < len(lines) and (not lines[i].strip() or lines[i].lstrip().startswith("#")):
            i += 1
        if i >= len(lines):
            return None
        indent = len(lines[at]) - len(lines[at].lstrip())
        if len(lines[i]) - len(lines[i].lstrip()) <= indent:
            return None
        rest = lines[i]
    brackets = 0
    while rest.lstrip().startswith("("):
        brackets, rest = brackets + 1, rest.lstrip()[1:]
    parts: list[str] = []
    while True:
        while brackets and i + 1 < len(lines) and (not rest.strip() or rest.lstrip().startswith("#")):
            i += 1
            rest = lines[i]
        m = _STRING_START.match(rest)
        if not m:
            return "".join(parts) if parts else None
        quote, rest = m.group(2), rest[m.end() :]
        inside = re.compile(r"(?:\\.|(?!" + quote + r")[^\\])*")
        while True:
            n = inside.match(rest).end()
            parts.append(rest[:n])
            if rest.startswith(quote, n):
                rest = rest[n + len(quote) :]
                break
            # A line's end inside: of a long string, or after a backslash.
            if (len(quote) == 1 and rest[n:] != "\\") or i + 1 >= len(lines):
                return None
            parts.append("" if rest[n:] == "\\" else rest[n:] + "\n")
            i += 1
            rest = lines[i]


def description_of(text: str, name: str) -> tuple[str, int]:
    """The describing part of a documentation text and how many words it has.

    Words of the function's own name, tags with their text, placeholders,
    rulers and lines that speak to a tool are no description.
    """
    kept: list[str] = []
    remark = open_ = False
    for line in unicodedata.normalize("NFC", text).split("\n"):
        x = _INLINE.sub("", line.strip())
        tagged = _TAG.match(x) or _DESCRIBED.match(x)
        remark = bool(x) and (bool(_REMARK.match(x)) or (remark and not tagged))
        begins, open_ = not open_, False
        if not x or remark or _RULER.match(x) or _DIRECTIVE.match(x) or _LEGAL.search(x) or (begins and _PLACEHOLDER.search(x)):
            continue
        kept.append(x)
        open_ = not x.endswith((".", "!", "?", ":"))  # the sentence may go on
    # A tag's text ends where a describing tag begins.
    first, *rest = _DESCRIBED.split("\n".join(kept))
    joined = " ".join(part[: m.start()] if (m := _TAG.search(part)) else part for part in (first, *rest))
    description = " ".join(joined.split())
    own = {w.lower() for w in _CAMEL.findall(name)} | {name.lower()}
    words = [w for w in _WORD.findall(description) if w.lower() not in own and not all(p.lower() in own for p in _CAMEL.findall(w) or [w])]
    count = len(words) + sum(len(_CJK.findall(w)) // 2 + len(_UNSPACED.findall(w)) // 5 for w in words)
    return description, count


def bases_of(tail: str, lang: str | None) -> list[str]:
    """The simple names of all bases in what follows a class's name, in order."""
    tail = re.split(r"\bwhere\b", tail)[0]
    if lang == "python":
        tail = re.sub(r"\w+\s*=\s*[\w.]+", "", tail)
    else:
        for bracket in (r"\([^()]*\)", r"<[^<>]*>", r"\([^()]*\)", r"<[^<>]*>"):
            tail = re.sub(bracket, "", tail)
    return list(dict.fromkeys(m.group().split(".")[-1].split("::")[-1] for m in _BASE.finditer(tail) if m.group() not in _NOT_BASE))


def head_of(text: str, match: re.Match, lang: str | None) -> str:
    """What follows a class's name, without comments, over as many lines as its head has."""
    remark = r"#.*" if lang in _HASH else r"//.*|/\*.*?\*/"
    tail, at = re.sub(remark, "", match.group(2)), match.end()
    while at < len(text) and text[at] == "\n" and lang not in ("ruby", "shell") and ";" not in tail:
        end = text.find("\n", at + 1)
        line = text[at + 1 : end if end >= 0 else len(text)]
        opened = tail.count("(") > tail.count(")")
        if not (opened or (lang != "python" and (_GOES_ON.search(tail) or _CONTINUES.match(line)))) or _CLASS.match(line):
            break
        kept, brace, _ = re.sub(remark, "", line).partition("{")
        tail += " " + kept.strip()
        if brace and lang != "python":
            break
        at += 1 + len(line)
    return tail


def document(source: str, lang: str | None, functions: list[tuple[str, int]]) -> tuple[list[tuple], list[tuple[str, str | None, int]]]:
    """Documentation of the functions ``(name, line)`` of one file, and its classes ``(name, base, position)``, also those without a base."""
    text = source.removeprefix("\ufeff").replace("\r\n", "\n")
    lines = text.split("\n")
    classes, spans = [], []
    line, counted = 1, 0
    for m in _CLASS.finditer(text):
        name = re.split(r"::|\.", m.group(1))[-1]
        line, counted = line + text.count("\n", counted, m.start()), m.start()
        tail = head_of(text, m, lang)
        bases = bases_of(tail, lang)
        if _IMPL.match(m.group()):  # of a trait for a type, or of a type itself
            bases, name = ([name], bases[0]) if bases and tail.lstrip().startswith("for") else ([], name)
        spans.append((line, len(m.group()) - len(m.group().lstrip()), name))
        classes.append((name, None, -1))
        classes += [(name, base, i) for i, base in enumerate(bases)]
    found = []
    for name, number in functions:
        at = number - 1
        if not 0 <= at < len(lines):
            found.append((None, "", 0, False))
            continue
        doc = strip_comment(comment_above(lines, at, lang))
        description, count = description_of(doc, name)
        if lang == "python" and count < MIN_WORDS:
            inner = python_docstring(lines, at)
            if inner is not None:
                own, n = description_of(inner, name)
                if n > count or _INHERIT.search(inner):
                    doc, description, count = inner, own, n
        indent = len(lines[at]) - len(lines[at].lstrip())
        owner = next((c for line, left, c in reversed(spans) if line < number and left < indent), None)
        if owner is None and "::" in lines[at]:  # defined outside its class
            outside = re.search(r"([^\W\d]\w*)(?:<[^<>]*>)?::" + re.escape(name) + r"\s*\(", lines[at])
            owner = outside.group(1) if outside else None
        found.append((owner, description, count, bool(_INHERIT.search(doc))))
    return found, classes


def body_of(lines: list[str], at: int, lang: str | None) -> str:
    """The lines of the function that starts on line ``at``: to the dedent in Python, else to the closing line at its indent."""
    indent = len(lines[at]) - len(lines[at].lstrip())
    end = at + 1
    while end < len(lines):
        x = lines[end]
        if x.strip():
            left = len(x) - len(x.lstrip())
            if lang == "python":
                if left <= indent and not x.lstrip().startswith((")", "]", "}")):
                    break
            elif left <= indent and (x.lstrip().startswith(("}", "end")) or left < indent):
                end += 1
                break
        end += 1
    body = lines[at:end]
    while body and not body[-1].strip():
        body.pop()
    return "\n".join(body)


def known_members(members: list[dict]) -> list[dict]:
    """The members with names and sources that another delivery of the same one has, each once."""
    known: dict[tuple, dict] = {}
    for m in members:
        best = known.setdefault((m["id"], m["line_number"]), {"name": None, "source": None})
        for k in best:
            best[k] = max(filter(None, (best[k], m[k])), default=None)
    full = {(m["id"], m["line_number"], *(m[k] or known[m["id"], m["line_number"]][k] for k in ("name", "source"))) for m in members}
    return [dict(zip(("id", "line_number", "name", "source"), x)) for x in full]


def _extract(with_code: bool):
    def run(cols: dict[str, list]) -> dict[str, list]:
        names = ["node_id", "name", "owner", "repo", "place", "inherits", "code", "description", "words", "origin", "position"]
        out: dict[str, list] = {k: [] for k in names}
        for path, branch, repo, lang, source, members in zip(*(cols[c] for c in ("path", "branch", "repo", "lang", "source", "members"))):
            place, repo = f"{branch}:{path}", repo or ""
            language = canonical_language(lang) or language_of(path)
            members = known_members(members)
            own = [(m["name"] or "", m["line_number"] or 0) for m in members]
            found, classes = document(source, language, own)
            lines = source.removeprefix("\ufeff").replace("\r\n", "\n").split("\n") if with_code else []
            for m, (owner, description, count, inherits) in zip(members, found):
                at = (m["line_number"] or 0) - 1
                code = (m["source"] or (body_of(lines, at, language) if 0 <= at < len(lines) else None)) if with_code else None
                row = (m["id"], m["name"], owner, repo, place, inherits, code, description, count, m["id"] if count >= MIN_WORDS else None, None)
                for k, v in zip(names, row):
                    out[k].append(v)
            for name, base, position in classes:  # rows without a node carry the class hierarchy
                for k, v in zip(names, (None, name, base, repo, place, None, None, None, None, None, position)):
                    out[k].append(v)
        return out

    return run


def extract(nodes: DataFrame, with_code: bool = True) -> DataFrame:
    """Each FUNCTION and METHOD of a file with source, with its own documentation, and the file's classes; no row is dropped yet.

    The functions of a path and branch are gathered (a file bounds their number)
    and joined with the FILE once, so the text is moved once and never per
    function.  Functions without a branch, if no such file has them, belong to
    the files of all branches of their path; a file without a branch holds those
    whose branch has no file of that path.
    """
    branch = F.coalesce("branch", F.lit("")).alias("branch") if "branch" in nodes.columns else F.lit("").alias("branch")
    functions = (
        nodes.where(F.col("kind").isin("FUNCTION", "METHOD") & F.col("id").isNotNull() & F.col("path").isNotNull())
        .select("id", "path", branch, "name", "line_number", (F.col("source") if with_code else F.lit(None).cast("string")).alias("source"))
        .groupBy("path", "branch")
        .agg(F.collect_set(F.struct("id", "name", "line_number", "source")).alias("members"))
    )
    sources = files(nodes).where(F.length("source") > 0).select("path", branch, F.col("repository_path").alias("repo"), "lang", "source")
    once = [F.max("repo").alias("repo"), F.max("lang").alias("lang"), F.first("members").alias("members")]
    joined = sources.join(functions.hint("shuffle_hash"), ["path", "branch"]).groupBy("path", "branch", "source").agg(*once)
    columns = ["path", "branch", "repo", "lang", "source", "members"]
    joined = joined.select(*columns)
    if "branch" in nodes.columns:
        bare = nodes.where(F.col("kind").isin("FILE", "FUNCTION", "METHOD") & F.col("path").isNotNull() & (F.col("branch").isNull() | (F.col("branch") == "")))
        if not bare.select("kind").isEmpty():
            left = functions.join(sources.select("path", "branch").distinct(), ["path", "branch"], "left_anti").withColumnRenamed("branch", "other")
            loose = sources.join(left, "path").where((F.col("branch") == "") != (F.col("other") == ""))
            joined = joined.unionByName(loose.groupBy("path", "branch", "other", "source").agg(*once).select(*columns))
    return map_columns(joined, _extract(with_code), PAIR)


def hierarchy(rows: DataFrame) -> DataFrame:
    """``repo, place, class, base_place, base, position``: each base of each class, found in the same file, else on the same branch, else in the repository."""
    known = rows.where(F.col("node_id").isNull()).withColumn("branch", F.substring_index("place", ":", 1))
    named = known.select("repo", "branch", "place", F.col("name").alias("base")).distinct()
    wanted = known.where(F.col("owner").isNotNull()).select("repo", "branch", "place", F.col("name").alias("class"), F.col("owner").alias("base"), "position").distinct()
    near = wanted.join(named, ["repo", "branch", "place", "base"]).withColumn("base_place", F.col("place"))
    far = wanted.join(named, ["repo", "branch", "place", "base"], "left_anti")
    there = named.withColumnRenamed("place", "base_place")
    same = far.join(there, ["repo", "branch", "base"])
    other = far.join(named, ["repo", "branch", "base"], "left_anti").join(there.drop("branch"), ["repo", "base"])
    columns = ["repo", "place", "class", "base_place", "base", "position"]
    found = near.select(*columns).unionByName(same.select(*columns)).unionByName(other.select(*columns))
    return found.where((F.col("place") != F.col("base_place")) | (F.col("class") != F.col("base")))


def pairs(nodes: DataFrame, with_code: bool = True) -> DataFrame:
    """``node_id, name, code, description, origin``: functions with at least six words of description.

    ``origin`` is the node whose documentation it is: the function itself, or
    the method it overrides when its own only refers to that: the nearest one
    that is documented, of several equally near ones that of the first base.
    Functions with empty or trivial documentation are dropped, as are inheriting
    ones that no base class resolves.  Repeated rows count once; a node whose
    branches or versions differ gives every different pair.  Functions
    without id, path or line, and files with null or empty source, give no row;
    extra columns are ignored; an empty table gives no rows.  Without
    ``with_code`` the code is null and its text never read.
    """
    rows = cut(extract(nodes, with_code))
    methods = rows.where(F.col("node_id").isNotNull())
    own = methods.where(F.col("words") >= MIN_WORDS).select("node_id", "name", "code", "description", "origin")
    inherits = F.col("inherits") & (F.col("words") < MIN_WORDS) & F.col("owner").isNotNull() & F.col("name").isNotNull()
    # A node is open once for every file and class that it stands in.
    keys = ["node_id", "name", "at", "start"]
    open_ = methods.where(inherits).select("node_id", "name", F.col("place").alias("at"), F.col("owner").alias("start"), "repo", "code").distinct()
    if open_.isEmpty():
        return own.distinct()
    bases = cut(hierarchy(rows))
    documented = (
        methods.where((F.col("words") >= MIN_WORDS) & F.col("owner").isNotNull())
        .groupBy("repo", F.col("place").alias("base_place"), F.col("owner").alias("base"), "name")
        .agg(F.min_by("description", F.struct("node_id", "description")).alias("description"), F.min("node_id").alias("origin"))
    )
    code = open_.select(*keys, "code")
    open_ = cut(open_.select(*keys, "repo", F.col("at").alias("place"), F.col("start").alias("class")).distinct())
    seen, resolved = open_.select(*keys, "place", "class"), None
    while True:
        climbed = cut(
            open_.join(bases, ["repo", "place", "class"])
            .join(documented, ["repo", "base_place", "base", "name"], "left")
            .select(*keys, "repo", F.col("base_place").alias("place"), F.col("base").alias("class"), "position", "description", "origin")
        )
        first = F.min_by(F.struct("description", "origin"), F.struct("position", "origin", "place"))
        found = climbed.where(F.col("origin").isNotNull()).groupBy(*keys).agg(first.alias("x")).select(*keys, "x.*")
        resolved = found if resolved is None else resolved.unionByName(found)
        rest = climbed.select(*keys, "repo", "place", "class").distinct()
        open_ = cut(rest.join(found, keys, "left_anti").join(seen, [*keys, "place", "class"], "left_anti"))
        if open_.isEmpty():
            break
        seen = seen.unionByName(open_.select(*keys, "place", "class"))
    inherited = resolved.join(code, keys).select("node_id", "name", "code", "description", "origin")
    return own.unionByName(inherited).distinct()


def documented_functions(nodes: DataFrame) -> DataFrame:
    """``node_id`` of the pairs whose documentation is the function's own; defined results as in :func:`pairs`."""
    return pairs(nodes, with_code=False).where(F.col("origin") == F.col("node_id")).select("node_id").distinct()
