"""Python: the interpreter's own parser, started again at the next top-level statement after each error.

That parser has limits of its own: 200 open brackets, 100 levels of indentation,
4300 digits in a number, the height of its stack.  What exceeds one of them is
no error of the source.  Such a source is flattened: its innermost parts are
judged by themselves and replaced by a name or a ``pass``, and the rest is judged
again.  A statement that is beyond the limits even then has no judgement.
"""

from __future__ import annotations

import ast
import keyword
import re
import sys
import warnings

#: A line at which a top-level statement can start.
_START = re.compile(r"^(?!(?:else|elif|except|finally)\b)[^\W\d]|^@", re.M)

#: Parts are taken out at every so many open brackets or levels of indentation.
LEVELS = 50

# Messages of the parser about its own limits.
_LIMIT = re.compile(r"too many nested parentheses|too many levels of indentation|too many nested f-strings")
_TOKEN = re.compile(r"(?:[rRbBuUfFtT]{1,2}(?=['\"]))?(?P<quote>\"\"\"|'''|\"|')|#[^\n]*|\\\n|\n|[^\S\n]+|(?P<word>\w+)|\*\*=?|(?P<open>[(\[{])|(?P<close>[)\]}])|.", re.S)
_PAIRS = {"(": ")", "[": "]", "{": "}"}
# What stands inside a bracket that is no target, one of assignments, of deletions too, of augmented assignments too.
_INSIDES = {"(": ("0", "*_,", "_,", "_"), "[": ("0", "*_", "_")}
_WORDS = frozenset(keyword.kwlist) - {"True", "False", "None"}


class TooDeep(Exception):
    """The parser came to one of its limits, which says nothing about the source."""


def parse(text: str, mode: str = "exec") -> tuple[int, str] | None:
    """``(line, message)`` of the first error, if any."""
    digits = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)
    try:
        ast.parse(text, mode=mode)
    except SyntaxError as e:
        if _LIMIT.search(e.msg):
            raise TooDeep(e.msg) from e
        return e.lineno or 1, e.msg
    except RecursionError:
        return None  # the text was parsed, only its tree is too high to be built
    except MemoryError as e:
        if "Parser stack overflowed" not in str(e):
            raise  # a shortage of the machine
        raise TooDeep(str(e)) from e
    finally:
        sys.set_int_max_str_digits(digits)
    return None


def string_end(text: str, at: int, prefix: str, quote: str) -> int:
    """Where the string ends whose text starts at ``at``; expressions of a formatted one may hold its own quotes."""
    formatted, raw = not {"f", "t"}.isdisjoint(prefix.lower()), "r" in prefix.lower()
    while at < len(text):
        if text.startswith(quote, at):
            return at + len(quote)
        if text[at] == "\\":
            at = escape_end(text, at, raw) if formatted else at + 2
        elif text[at] == "\n" and len(quote) == 1:
            return at
        elif formatted and text[at] == "{" and not text.startswith("{{", at):
            at = field_end(text, at + 1, raw, quote)
        else:
            at += 2 if formatted and text.startswith("{{", at) else 1
    return min(at, len(text))


def escape_end(text: str, at: int, raw: bool) -> int:
    """Where the escape at ``at`` of a formatted string ends; brackets after a backslash keep their meaning, but for named characters."""
    if not raw and text.startswith("\\N{", at):
        return at + 3
    return at + (1 if text[at + 1 : at + 2] in ("{", "}") else 2)


def field_end(text: str, at: int, raw: bool, quote: str) -> int:
    """Where the replacement field ends whose expression starts at ``at``; its format is text in which further fields may stand."""
    depth, formatting = 0, False
    while at < len(text):
        if not formatting:
            m = _TOKEN.match(text, at)
            t = m.group()
            at = string_end(text, m.end(), t[: -len(m["quote"])], m["quote"]) if m["quote"] else m.end()
            if t == "}" and not depth:
                return at
            formatting = t == ":" and not depth
            depth += bool(m["open"]) - bool(m["close"])
        elif text.startswith(quote, at):
            return at
        elif text[at] == "\\":
            at = escape_end(text, at, raw)
        elif text[at] == "{":
            at = field_end(text, at + 1, raw, quote)
        elif text[at] == "}":
            return at + 1
        else:
            formatting = text[at] != "\n" or len(quote) > 1  # a line's end ends the format of a short string
            at += 1
    return at


def target(text: str) -> int:
    """In how many of the ways, from assignment to augmented one, a bracket may be a target."""
    return sum(parse(x) is None for x in (f"{text} = 0", f"del {text}", f"{text} += 0"))


def flattened(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text with the same lines but few open brackets and levels, as valid as before, and the errors of the parts taken out."""
    errors: list[tuple[int, str]] = []
    frames: list[tuple[str, int, bool, list[str]]] = []  # the bracket, its line, whether it follows an operand, the parts inside
    parts: list[str] = []
    heads: list[tuple[int, int]] = []  # where logical lines start: part, line
    at, line, operand, fresh, signs, negated = 0, 1, False, True, 0, False
    while at < len(text):
        m = _TOKEN.match(text, at)
        t, end = m.group(), m.end()
        if m["quote"]:
            end = string_end(text, end, t[: -len(m["quote"])], m["quote"])
            t = text[at:end]
        solid = not t.isspace() and t[0] != "#" and t != "\\\n"
        if solid and fresh and not frames:
            heads.append((len(parts), line))
            fresh = False
        if m["open"]:
            frames.append((t, line, operand and t != "{", parts))
            parts, operand, signs, negated = [], False, 0, False
        elif m["close"]:
            if not frames or _PAIRS[frames[-1][0]] != t:
                return text, [*errors, (line, f"unmatched '{t}'")]
            begin, first, trailer, outer = frames.pop()
            inner = "".join(parts)
            if (len(frames) + 1) % LEVELS == 0 and inner.strip():
                wrong = parse(("f" if trailer else "") + begin + inner + t, "eval")
                if wrong:
                    errors.append((first + wrong[0] - 1, wrong[1]))
                inside = "_" if wrong or trailer or begin == "{" else _INSIDES[begin][target(begin + inner + t)]
                inner = inside + "\n" * inner.count("\n")
            parts = outer
            parts.append(begin + inner + t)
            operand, signs, negated = True, 0, False
        else:
            if solid:
                signs = signs + 1 if t in ("+", "-", "~") else 0
                negated, again = t == "not" and not operand, negated
                # Chains that need no stack are as valid: a product for a power, few signs for many.
                if t == "**" and operand:
                    t = "* "
                elif signs > 2 or (negated and again):
                    t = " "
                operand = bool(m["quote"]) or (bool(m["word"]) and t not in _WORDS and t != " ")
            parts.append(t)
        fresh = fresh or (t == "\n" and not frames)
        line, at = line + text.count("\n", at, end), end
    if frames:
        return text, [*errors, (frames[-1][1], f"'{frames[-1][0]}' was never closed")]
    return lowered(parts, heads, errors)


def lowered(parts: list[str], heads: list[tuple[int, int]], errors: list[tuple[int, str]]) -> tuple[str, list[tuple[int, str]]]:
    """The parts as text, with deep blocks replaced by ``pass`` and long chains of ``elif`` by as many ``if``."""
    levels = [0]
    chained: dict[int, bool] = {}  # by indent, whether the last line there was an if or elif
    start, taken = None, []
    for at, line in heads:
        indent = len(parts[at - 1].expandtabs(8)) if at and parts[at - 1].isspace() and parts[at - 1] != "\n" else 0
        while levels[-1] > indent:
            chained.pop(levels.pop(), None)
        if start and len(levels) < start[2]:
            taken.append((*start[:2], at - 1 if indent else at))
            start = None
        if indent > levels[-1]:
            levels.append(indent)
            if len(levels) > LEVELS and not start and parts[at] != "case":  # cases stand in no other block, their bodies are taken out
                start = (at - 1, line, len(levels))
        if parts[at] == "elif" and chained.get(indent):
            parts[at] = "if  "
        chained[indent] = parts[at].strip() in ("if", "elif")
    if start:
        taken.append((*start[:2], len(parts)))
    for first, line, end in reversed(taken):
        block = "".join(parts[first:end])
        found = python_errors("if 1:\n" + block)
        if found is None:
            raise TooDeep("a block")
        errors += [(line + n - 2, message) for n, message in found]
        parts[first:end] = [parts[first], "pass", "\n" * block.count("\n")]
    return "".join(parts), errors


def statements(text: str) -> list[str]:
    """The text cut where top-level statements start; decorators stay with theirs."""
    cuts, at, depth, fresh, decorated = [0], 0, 0, True, False
    while at < len(text):
        m = _TOKEN.match(text, at)
        if fresh and _START.match(text, at):
            if at and not decorated:
                cuts.append(at)
            decorated = text[at] == "@"
        at, before = (string_end(text, m.end(), m.group()[: -len(m["quote"])], m["quote"]) if m["quote"] else m.end()), at
        depth = max(0, depth + bool(m["open"]) - bool(m["close"]))
        fresh = text[before] == "\n" and not depth
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def statement_errors(text: str) -> list[tuple[int, str]]:
    """The errors of those top-level statements that can be judged by themselves."""
    errors, line = [], 1
    for part in statements(text):
        try:
            wrong = parse(part)
        except TooDeep:
            wrong = None
        if wrong:
            errors += [(line + n - 1, message) for n, message in python_errors(part) or [wrong]]
        line += part.count("\n")
    return errors


def python_errors(text: str) -> list[tuple[int, str]] | None:
    """``(line, message)`` of the errors; None if none was found in what the parser can judge and some of it is beyond its limits."""
    errors = [(n, "null character") for n, x in enumerate(text.split("\n"), 1) if "\0" in x]
    text, at, line, flat = text.replace("\0", " "), 0, 1, False
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        while True:
            try:
                wrong = parse(text[at:])
            except TooDeep:
                try:
                    if flat:
                        raise
                    rest, found = flattened(text[at:])
                except TooDeep:
                    errors += [(line + n - 1, message) for n, message in statement_errors(text[at:])]
                    return sorted(errors) or None
                errors += [(line + n - 1, message) for n, message in found]
                if found and rest == text[at:]:
                    return sorted(errors)  # its brackets do not match, so there are no parts
                text, at, flat = rest, 0, True
                continue
            if wrong is None:
                return sorted(errors)
            number, message = wrong
            errors.append((line + number - 1, message))
            for _ in range(number):  # past the line of the error
                end = text.find("\n", at)
                if end < 0:
                    return sorted(errors)
                at, line = end + 1, line + 1
            start = _START.search(text, at)
            if not start:
                return sorted(errors)
            at, line = start.start(), line + text.count("\n", at, start.start())
