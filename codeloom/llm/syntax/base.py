"""Tokens as one-character kinds, and what all recursive-descent parsers share.

A source becomes a string of kinds, one character for each token: punctuation
stands for itself, ``i`` for a name, ``0`` for a number, ``s`` for a string, and
keywords and longer operators for characters of the private-use area.  Parsers
walk that string.  As most statements of most files have been seen before, the
kinds of every accepted simple statement, and of every accepted statement head
up to its brace, are remembered: whether they are valid depends on nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Callable

END, BAD, CONFLICT = "\0", chr(0xEFFE), chr(0xEFFF)

_KEYWORDS: dict[str, str] = {}
_OPERATORS: dict[str, str] = {}


def K(word: str) -> str:
    """The kind of a keyword."""
    return _KEYWORDS.setdefault(word, chr(0xE000 + len(_KEYWORDS)))


def O(op: str) -> str:  # noqa: E743
    """The kind of an operator."""
    return op if len(op) == 1 else _OPERATORS.setdefault(op, chr(0xE800 + len(_OPERATORS)))


def kinds_of(words: str) -> frozenset[str]:
    return frozenset(K(w) for w in words.split())


def ops_of(words: str) -> frozenset[str]:
    return frozenset(O(w) for w in words.split())


def spelled(kind: str) -> str:
    """A kind as a reader knows it, for messages."""
    for table in (_KEYWORDS, _OPERATORS):
        for word, k in table.items():
            if k == kind:
                return word
    return {"i": "name", "0": "number", "s": "string", "t": "template", "\n": "end of line", END: "end of file", BAD: "stray character", CONFLICT: "conflict marker"}.get(kind, kind)


# Patterns without capturing groups, so that findall gives whole tokens.
LINE_COMMENT = r"//[^\n]*"
BLOCK_COMMENT = r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
NESTED_COMMENT = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/"
MARKER = r"(?m:^(?:<<<<<<<|=======|>>>>>>>|\|\|\|\|\|\|\|)(?= |\n|\Z)[^\n]*)"
NAME = r"[^\W\d]\w*"
SUFFIX = r"(?:[uUiIfFlLdDnN]\w{0,4})?(?!\w)"
NUMBER = (
    r"0[xX][\da-fA-F_']+(?:[pP][+-]?\d+)?" + SUFFIX + r"|0[bBoO][\d_]+" + SUFFIX + r"|\d[\d_]*\.(?![.\w])|"
    r"(?:\d(?:[\d_]|'(?=\d))*(?:\.\d[\d_]*)?|(?<![\w.)\]])\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?" + SUFFIX
)
DOUBLE = r'"(?:[^"\\\n]|\\[\s\S])*"'
SINGLE = r"'(?:[^'\\\n]|\\[\s\S])*'"
CHARACTER = r"'(?:[^'\\\n]|\\[^\n][^'\n]{0,8})'"


class Lexer(dict):
    """A token pattern, and the kinds of the tokens seen so far."""

    LIMIT = 200_000

    def __init__(self, parts: list[str], keywords: str, ops: str, singles: str, classify: Callable[[str], str | None]):
        operators = sorted((o for o in ops.split() if len(o) > 1), key=len, reverse=True)
        self.pattern = re.compile("|".join([MARKER, *parts, *map(re.escape, operators), r"\S"]))
        self.words = {w: K(w) for w in keywords.split()}
        self.ops = {o: O(o) for o in operators}
        self.singles = frozenset(singles)
        self.classify = classify

    def __missing__(self, token: str) -> str:
        if len(self) > self.LIMIT:
            self.clear()
        kind = self.kind(token)
        self[token] = kind
        return kind

    def kind(self, token: str) -> str:
        if token in self.words:
            return self.words[token]
        if token in self.ops:
            return self.ops[token]
        first = token[0]
        if len(token) >= 7 and token[:7] in ("<<<<<<<", "=======", ">>>>>>>", "|||||||"):
            return CONFLICT
        own = self.classify(token)
        if own is not None:
            return own
        if first.isalpha() or first == "_":
            return "i"
        if first.isdigit() or (first == "." and len(token) > 1):
            return "0"
        if len(token) > 1 and first in "\"'`":
            return "s"
        return token if token in self.singles else BAD

    def kinds(self, text: str) -> str:
        return "".join(map(self.__getitem__, self.pattern.findall(text)))

    def place(self, text: str, index: int) -> int:
        """The line, from 1, of the token that gave kind ``index``; the last line if there is none."""
        seen = 0
        for m in self.pattern.finditer(text):
            seen += len(self[m.group()])
            if seen > index:
                return text.count("\n", 0, m.start()) + 1
        return text.count("\n") + 1


class Fail(Exception):
    def __init__(self, at: int, message: str):
        self.at, self.message = at, message


class Parser:
    """Recursive descent over kinds, with precedence climbing for expressions and panic-mode recovery."""

    BINARY: dict[str, int] = {}
    PREFIX: frozenset[str] = frozenset()
    NAMES: frozenset[str] = frozenset("i")
    #: What a simple statement, and a statement head, can be as text.
    SIMPLE = re.compile(r"[^;{}\n\0]*[;\n]")
    HEAD = re.compile(r"[^;{}\n\0]*\{")
    SYNC = re.compile(r"[^;{}\n\0]*")
    REMEMBERED = 300_000

    ok: dict[str, set[str]]
    heads: dict[str, dict[str, str]]

    def __init_subclass__(cls) -> None:
        cls.ok, cls.heads = {}, {}

    def __init__(self, kinds: str):
        self.s = kinds + END * 4
        self.p = 0
        self.d = 0
        self.nested = 0
        self.errors: list[tuple[int, str]] = []
        self.head: tuple[int, str, int] | None = None
        self._pairs: dict[int, int] | None = None

    # -- tokens

    def pk(self) -> str:
        if self.d:
            s = self.s
            while s[self.p] == "\n":
                self.p += 1
        return self.s[self.p]

    def fail(self, message: str = ""):
        raise Fail(self.p, message or f"unexpected {spelled(self.s[self.p])}")

    def need(self, kind: str, where: str = "") -> None:
        if self.pk() != kind:
            self.fail(f"expected {spelled(kind)}{where}, found {spelled(self.s[self.p])}")
        self.p += 1

    def opt(self, kind: str) -> bool:
        if self.pk() == kind:
            self.p += 1
            return True
        return False

    def name(self) -> None:
        if self.pk() not in self.NAMES:
            self.fail(f"expected a name, found {spelled(self.s[self.p])}")
        self.p += 1

    def nls(self) -> None:
        while self.s[self.p] == "\n":
            self.p += 1

    def attempt(self, rule: Callable[[], object]) -> bool:
        """Try a rule; on failure nothing has happened."""
        at, d, nested, n = self.p, self.d, self.nested, len(self.errors)
        try:
            rule()
            if len(self.errors) == n:
                return True
        except Fail:
            pass
        self.p, self.d, self.nested = at, d, nested
        del self.errors[n:]
        return False

    def closing(self, at: int) -> int:
        """The index of the bracket that closes the one at ``at``, or -1."""
        if self._pairs is None:
            self._pairs, stack = {}, []
            close = {")": "(", "]": "[", "}": "{"}
            for m in re.finditer(r"[()\[\]{}]", self.s):
                c = m.group()
                if c in "([{":
                    stack.append(m.start())
                elif stack and self.s[stack[-1]] == close[c]:
                    self._pairs[stack.pop()] = m.start()
        return self._pairs.get(at, -1)

    # -- lists and expressions

    def listed(self, close: str, item: Callable[[], object], holes: bool = False) -> None:
        """Items with commas up to ``close``, whose opening bracket was just read; a trailing comma is fine."""
        self.d += 1
        while self.pk() != close:
            if holes and self.opt(","):
                continue
            item()
            if not self.opt(","):
                break
        if self.pk() != close:
            self.fail(f"expected {close} or a comma, found {spelled(self.s[self.p])}")
        self.d -= 1
        self.p += 1

    def deeper(self) -> None:
        self.nested += 1

    def expr(self, least: int = 0) -> None:
        self.deeper()
        self.unary()
        while True:
            t = self.pk()
            level = self.BINARY.get(t)
            if level is not None and level >= least:
                self.p += 1
                if self.infix(t):
                    continue
                if self.d == 0:
                    self.nls()
                self.expr(level + 1 if level > 1 else level)
            elif not (least <= 2 and self.tail(t)):
                break
        self.nested -= 1

    def infix(self, t: str) -> bool:
        """Hook: read the right side of an operator that takes no expression there."""
        return False

    def tail(self, t: str) -> bool:
        """Hook: what may follow a whole operand, like a conditional."""
        if t == "?":
            self.p += 1
            self.expr(1)
            self.nls()
            self.need(":", " of a conditional")
            self.nls()
            self.expr(1)
            return True
        return False

    def unary(self) -> None:
        while self.pk() in self.PREFIX:
            self.p += 1
        self.primary()
        self.postfix()

    def primary(self) -> None:
        if self.pk() in "i0s":
            self.p += 1
        elif self.opt("("):
            self.listed(")", self.argument)
        else:
            self.fail()

    def argument(self) -> None:
        self.expr()

    def postfix(self) -> None:
        while True:
            t = self.pk()
            if t == "(":
                self.p += 1
                self.listed(")", self.argument)
            elif t == "[":
                self.p += 1
                self.listed("]", self.argument)
            elif t == ".":
                self.p += 1
                self.member()
            elif not self.post(t):
                return

    def member(self) -> None:
        t = self.pk()
        if t in "i0" or t in self.NAMES or chr(0xE000) <= t < chr(0xE800):
            self.p += 1
        else:
            self.fail(f"expected a member name, found {spelled(t)}")

    def post(self, t: str) -> bool:
        return False

    # -- statements

    def block(self, context: str = "block") -> None:
        self.nls() if self.s[self.p] == "\n" else None
        self.need("{")
        d, self.d = self.d, 0
        self.deeper()
        self.statements(context, "}")
        self.nested -= 1
        if self.s[self.p] != "}":
            self.fail("missing }")
        self.p += 1
        self.d = d

    def statements(self, context: str, close: str) -> None:
        ok = self.ok.setdefault(context, set())
        heads = self.heads.setdefault(context, {})
        s, simple, head_of = self.s, self.SIMPLE, self.HEAD
        while True:
            t = s[self.p]
            if t == "\n" or t == ";":
                self.p += 1
                continue
            if t == close or t == END:
                return
            start = self.p
            m = simple.match(s, start)
            if m and m.group() in ok:
                self.p = m.end()
                continue
            h = None if m else head_of.match(s, start)
            tail = heads.get(h.group()) if h else None
            errors, depth = len(self.errors), self.nested
            try:
                if tail:
                    self.p = h.end() - 1
                    getattr(self, tail)()
                    continue
                self.head = None
                self.statement(context)
                head = self.head if self.head and self.head[2] == start else None
                if len(self.errors) == errors:
                    m = simple.match(s, start)
                    if m and m.end() == self.p:
                        if len(ok) > self.REMEMBERED:
                            ok.clear()
                        ok.add(m.group())
                    elif head:
                        h = head_of.match(s, start)
                        if h and h.end() == head[0] + 1:
                            if len(heads) > self.REMEMBERED:
                                heads.clear()
                            heads[h.group()] = head[1]
            except Fail as e:
                self.errors.append((e.at, e.message))
                self.d, self.nested = 0, depth
                self.recover(max(e.at, start), start)

    def recover(self, at: int, start: int) -> None:
        """Panic mode: go on after the next statement end, or before the next brace."""
        s = self.s
        self.p = max(at, start)
        if self.p == start and s[start] == "}":  # it closes nothing, or the block would have ended
            self.p += 1
            return
        if self.p == start and s[self.p] not in "};\n" + END:
            self.p += 1
        self.p = self.SYNC.match(s, self.p).end()
        if s[self.p] in ";\n":
            self.p += 1
        elif s[self.p] == "{":
            end = self.closing(self.p)
            self.p = end + 1 if end > 0 else self.p + 1

    def statement(self, context: str) -> None:
        raise NotImplementedError

    def opens(self, start: int, tail: str) -> None:
        """Say that the statement from ``start`` reached its body with a head that needs nothing but ``tail`` now."""
        if self.s[self.p] == "{":
            self.head = (self.p, tail, start)
        keep = self.head
        getattr(self, tail)()
        self.head = keep

    def run(self) -> list[tuple[int, str]]:
        while True:
            self.statements("top", END)
            if self.p >= len(self.s) - 4:
                break
            self.p += 1
        return self.errors
