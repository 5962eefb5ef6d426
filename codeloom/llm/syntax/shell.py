"""Shell: words, quotes, substitutions and here documents, read from the text itself."""

from __future__ import annotations

import re

_BLANK = re.compile(r"(?:[ \t\r]|\\\n)+")
_COMMENT = re.compile(r"#[^\n]*")
_PLAIN = re.compile(r"[^\s\\'\"`$(){}|&;<>#]+")
_REDIRECT = re.compile(r"(?:\d+|\{\w+\})?(?:<<<|<<-?|<>|<&|>>|>&|>\||<|>|)|&>>?")
_FUNCTION = re.compile(r"[^\s'\"`$(){}|&;<>#=]+[ \t]*\([ \t]*\)")
_ASSIGNED = re.compile(r"[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=")
_MARKER = re.compile(r"(?:<<<<<<<|=======|>>>>>>>|\|\|\|\|\|\|\|)(?= |\n|\Z)[^\n]*")
_RESERVED = frozenset("if then elif else fi for while until do done case esac in function select time { } ! [[ ]]".split())
_CLOSERS = frozenset("then elif else fi do done esac } ) ;; ;& ;;&".split())


class _Stop(Exception):
    def __init__(self, at: int, message: str):
        self.at, self.message = at, message


class Shell:
    """Recursive descent over commands; after an error it goes on with the next line."""

    def __init__(self, text: str):
        self.t = text
        self.p = 0
        self.errors: list[tuple[int, str]] = []
        self.pending: list[tuple[str, bool]] = []

    def fail(self, message: str, at: int | None = None):
        raise _Stop(self.p if at is None else at, message)

    # -- lexical parts

    def blanks(self) -> None:
        while m := _BLANK.match(self.t, self.p):
            self.p = m.end()
        if self.t.startswith("#", self.p) and (self.p == 0 or self.t[self.p - 1] in " \t\n;(){}|&\r"):
            self.p = _COMMENT.match(self.t, self.p).end()

    def newline(self) -> None:
        self.p += 1
        for tag, tabs in self.pending:
            m = re.compile(rf"^{'\t*' if tabs else ''}{re.escape(tag)}\r?$", re.M).search(self.t, self.p)
            if not m:
                self.pending = []
                at, self.p = self.p, len(self.t)
                self.fail(f"here document {tag} is not closed", at)
            self.p = min(m.end(), len(self.t))
            if self.p < len(self.t):
                self.p += 1
        self.pending = []

    def lines(self) -> None:
        """Over blanks, comments and line ends."""
        while True:
            self.blanks()
            if self.t.startswith("\n", self.p):
                self.newline()
                if m := _MARKER.match(self.t, self.p):
                    at, self.p = self.p, m.end()
                    self.errors.append((at, "conflict marker"))
            else:
                return

    def quoted(self) -> None:
        """A double-quoted string, from its opening quote."""
        start = self.p
        self.p += 1
        t, n = self.t, len(self.t)
        while self.p < n:
            c = t[self.p]
            if c == '"':
                self.p += 1
                return
            if c == "\\":
                self.p += 2
            elif c == "`":
                self.backquoted()
            elif c == "$":
                self.dollar()
            else:
                self.p += 1
        self.p = n
        self.fail("string is not closed", start)

    def backquoted(self) -> None:
        start = self.p
        self.p += 1
        while self.p < len(self.t):
            c = self.t[self.p]
            self.p += 2 if c == "\\" else 1
            if c == "`":
                return
        self.fail("backquote is not closed", start)

    def dollar(self) -> None:
        start, t = self.p, self.t
        if t.startswith("$((", start):
            self.p += 3
            if self.arithmetic():
                return
            self.p = start
        if t.startswith("$(", start):
            self.p += 2
            self.commands((")",))
            if not t.startswith(")", self.p):
                self.fail("substitution is not closed", start)
            self.p += 1
        elif t.startswith("${", start):
            self.p += 2
            while self.p < len(t) and t[self.p] != "}":
                c = t[self.p]
                if c == "\\":
                    self.p += 2
                elif c == '"':
                    self.quoted()
                elif c == "'" and "\n" not in t[self.p : t.find("'", self.p + 1) + 1]:
                    end = t.find("'", self.p + 1)
                    self.p = end + 1 if end > 0 else self.p + 1
                elif c == "$":
                    self.dollar()
                elif c == "`":
                    self.backquoted()
                elif c == "\n":
                    self.fail("parameter is not closed", start)
                else:
                    self.p += 1
            if self.p >= len(t):
                self.fail("parameter is not closed", start)
            self.p += 1
        elif t.startswith("$'", start):
            self.p += 2
            while self.p < len(t) and t[self.p] != "'":
                self.p += 2 if t[self.p] == "\\" else 1
            if self.p >= len(t):
                self.fail("string is not closed", start)
            self.p += 1
        else:
            self.p += 1

    def arithmetic(self) -> bool:
        """Up to the two closing parentheses; whether they were there."""
        depth, t = 0, self.t
        while self.p < len(t):
            c = t[self.p]
            if c == "(":
                depth += 1
            elif c == ")":
                if not depth:
                    if t.startswith("))", self.p):
                        self.p += 2
                        return True
                    return False
                depth -= 1
            elif c == "$" and t[self.p + 1 : self.p + 2] in ("(", "{"):
                self.dollar()
                continue
            elif c == '"':
                self.quoted()
                continue
            elif c == "\n" and depth == 0 and t[self.p + 1 : self.p + 2] == "\n":
                return False
            self.p += 1
        return False

    def word(self) -> str | None:
        """The text of the word here, or None."""
        start, t, n = self.p, self.t, len(self.t)
        while self.p < n:
            c = t[self.p]
            if m := _PLAIN.match(t, self.p):
                self.p = m.end()
                if t.startswith("(", self.p) and _ASSIGNED.fullmatch(t[start : self.p]):
                    self.array()
                elif t.startswith("(", self.p) and self.p > start and t[self.p - 1] in "@?*+!" and self.extended:
                    self.group()
            elif c == "\\":
                self.p += 2
            elif c == "'":
                end = t.find("'", self.p + 1)
                if end < 0:
                    at, self.p = self.p, n
                    self.fail("string is not closed", at)
                self.p = end + 1
            elif c == '"':
                self.quoted()
            elif c == "`":
                self.backquoted()
            elif c == "$":
                self.dollar()
            elif c in "<>" and t.startswith("(", self.p + 1) and self.p == start:
                self.p += 2
                self.commands((")",))
                if not t.startswith(")", self.p):
                    self.fail("substitution is not closed", start)
                self.p += 1
            elif c in "{}#" and not (c == "#" and self.p == start):
                self.p += 1
            else:
                break
        return t[start : self.p] if self.p > start else None

    extended = True

    def group(self) -> None:
        depth, start = 0, self.p
        while self.p < len(self.t) and self.t[self.p] != "\n":
            depth += {"(": 1, ")": -1}.get(self.t[self.p], 0)
            self.p += 1
            if not depth:
                return
        self.fail("pattern is not closed", start)

    def array(self) -> None:
        start = self.p
        self.p += 1
        while True:
            self.lines()
            if self.t.startswith(")", self.p):
                self.p += 1
                return
            if self.word() is None:
                self.fail("array is not closed", start)

    def peek(self) -> str:
        """The plain word here, without reading it; an operator where there is none."""
        self.blanks()
        t = self.t
        for op in (";;&", ";;", ";&", "&&", "||", "((", "|&"):
            if t.startswith(op, self.p):
                return op
        if self.p < len(t) and t[self.p] in "()|&;\n":
            return t[self.p]
        m = re.compile(r"[^\s'\"`$()|&;<>\\]+").match(t, self.p)
        if m and (m.end() == len(t) or t[m.end()] in " \t\r\n;|&()<>"):
            return m.group()
        return ""

    def take(self, word: str, context: str) -> None:
        self.lines()
        if self.peek() != word:
            self.fail(f"expected {word} of {context}, found {self.peek() or self.t[self.p : self.p + 20].split(chr(10))[0] or 'end of file'}")
        self.p += len(word)

    # -- commands

    def commands(self, stops: tuple[str, ...]) -> None:
        """Commands up to one of these words, which is not read."""
        while True:
            self.lines()
            if self.p >= len(self.t):
                return
            w = self.peek()
            if w in stops:
                return
            if w in _CLOSERS:
                self.fail(f"unexpected {w}")
            if w in (";", "&", "|", "&&", "||", "|&"):
                self.fail(f"unexpected {w}")
            self.and_or()
            self.blanks()
            if self.p >= len(self.t):
                return
            c = self.t[self.p]
            if c == "\n":
                continue
            w = self.peek()
            if w in (";", "&"):
                self.p += 1
            elif w in stops or w in (";;", ";&", ";;&"):
                return
            else:
                self.fail(f"unexpected {w or c}")

    def and_or(self) -> None:
        while True:
            self.pipeline()
            w = self.peek()
            if w in ("&&", "||"):
                self.p += 2
                self.lines()
                if self.p >= len(self.t):
                    self.fail(f"command expected after {w}")
            else:
                return

    def pipeline(self) -> None:
        while self.peek() in ("!", "time"):
            self.p += len(self.peek())
        while True:
            self.command()
            w = self.peek()
            if w in ("|", "|&"):
                self.p += len(w)
                self.lines()
            else:
                return

    def command(self) -> None:
        self.blanks()
        start, w, t = self.p, self.peek(), self.t
        if w in _CLOSERS or w == "":
            if w:
                self.fail(f"unexpected {w}")
        if w == "if":
            self.p += 2
            self.filled(("then",), "if")
            self.take("then", "if")
            while True:
                self.filled(("elif", "else", "fi"), "then")
                if self.peek() == "elif":
                    self.p += 4
                    self.filled(("then",), "elif")
                    self.take("then", "elif")
                elif self.peek() == "else":
                    self.p += 4
                    self.filled(("fi",), "else")
                    break
                else:
                    break
            self.take("fi", "if")
        elif w in ("while", "until"):
            self.p += 5
            self.filled(("do",), w)
            self.do(w)
        elif w in ("for", "select"):
            self.p += len(w)
            self.blanks()
            if t.startswith("((", self.p):
                self.p += 2
                if not self.arithmetic():
                    self.fail("loop head is not closed", start)
                if self.peek() == ";":
                    self.p += 1
            else:
                name = self.word()
                if not name or not re.fullmatch(r"[A-Za-z_]\w*", name):
                    self.fail("expected a name after for")
                self.lines()
                if self.peek() == "in":
                    self.p += 2
                    self.blanks()
                    while self.word() is not None:
                        self.blanks()
                self.blanks()
                if self.peek() == ";":
                    self.p += 1
                elif self.peek() not in ("\n", "do"):
                    self.fail(f"unexpected {self.peek()} in the head of for")
            self.lines()
            if self.peek() == "{":
                self.brace()
            else:
                self.do(w)
        elif w == "case":
            self.case()
        elif w == "{":
            self.brace()
        elif w == "((":
            self.p += 2
            if not self.arithmetic():
                self.p = start + 1
                self.subshell(start)
        elif w == "(":
            self.p += 1
            self.subshell(start)
        elif w == "[[":
            self.p += 2
            while self.p < len(t):
                self.lines()
                if self.peek() == "]]":
                    self.p += 2
                    break
                if t[self.p : self.p + 1] in tuple("()<>&|!"):
                    self.p += 1
                elif self.word() is None:
                    self.fail("[[ is not closed", start)
            else:
                self.fail("[[ is not closed", start)
        elif w == "function":
            self.p += 8
            self.blanks()
            if self.word() is None:
                self.fail("expected a name after function")
            self.blanks()
            if m := re.compile(r"\([ \t]*\)").match(t, self.p):
                self.p = m.end()
            self.lines()
            self.command()
            return
        elif (m := _FUNCTION.match(t, self.p)) and w not in _RESERVED:
            self.p = m.end()
            self.lines()
            if self.peek() not in ("{", "(", "if", "for", "while", "until", "case", "[[", "(("):
                self.fail("expected the body of a function")
            self.command()
            return
        else:
            self.simple()
            return
        while self.redirect():
            pass

    def filled(self, stops: tuple[str, ...], context: str) -> None:
        self.lines()
        if self.peek() in stops:
            self.fail(f"no command after {context}")
        self.commands(stops)

    def do(self, context: str) -> None:
        self.take("do", context)
        self.filled(("done",), "do")
        self.take("done", context)

    def brace(self) -> None:
        self.p += 1
        if self.t[self.p : self.p + 1] not in (" ", "\t", "\n", "\r", ""):
            self.fail("expected a blank after {")
        self.filled(("}",), "{")
        self.take("}", "{")

    def subshell(self, start: int) -> None:
        self.filled((")",), "(")
        if not self.t.startswith(")", self.p):
            self.fail("( is not closed", start)
        self.p += 1

    def case(self) -> None:
        start = self.p
        self.p += 4
        self.blanks()
        if self.word() is None:
            self.fail("expected a word after case")
        self.take("in", "case")
        while True:
            self.lines()
            if self.p >= len(self.t):
                self.fail("case is not closed", start)
            if self.peek() == "esac":
                self.p += 4
                return
            if self.t.startswith("(", self.p):
                self.p += 1
            while True:
                self.blanks()
                if self.word() is None:
                    self.fail("expected a pattern")
                self.blanks()
                if not self.t.startswith("|", self.p):
                    break
                self.p += 1
            if not self.t.startswith(")", self.p):
                self.fail("expected ) after a pattern")
            self.p += 1
            self.commands((";;", ";&", ";;&", "esac"))
            w = self.peek()
            if w in (";;", ";&", ";;&"):
                self.p += len(w)

    def redirect(self) -> bool:
        self.blanks()
        m = _REDIRECT.match(self.t, self.p)
        if not m or not re.search(r"[<>]", m.group()) or self.t.startswith(("<(", ">("), self.p):
            return False
        op = m.group().lstrip("0123456789")
        self.p = m.end()
        self.blanks()
        at = self.p
        target = self.word()
        if target is None:
            self.fail("expected a word after a redirection", at)
        if op in ("<<", "<<-"):
            self.pending.append((re.sub(r"['\"\\]", "", target), op.endswith("-")))
        return True

    def simple(self) -> None:
        start, n = self.p, 0
        while True:
            self.blanks()
            if self.redirect():
                n += 1
                continue
            at = self.p
            w = self.word()
            if w is None:
                break
            if n == 0 and w in ("}", "]]"):
                self.fail(f"unexpected {w}", at)
            n += 1
        if not n:
            self.fail(f"unexpected {self.t[start : start + 1] or 'end of file'}", start)
        if self.t.startswith("(", self.p):
            self.fail("unexpected (")

    def run(self) -> list[tuple[int, str]]:
        t = self.t
        if m := _MARKER.match(t):
            self.errors.append((0, "conflict marker"))
            self.p = m.end()
        while self.p < len(t):
            try:
                self.commands(())
            except _Stop as e:
                self.errors.append((min(e.at, len(t)), e.message))
                end = t.find("\n", max(self.p, e.at))
                self.pending = []
                if end < 0:
                    break
                self.p = end
        return self.errors


def shell_errors(text: str) -> list[tuple[int, str]]:
    """``(line, message)`` of every error that recovery leads to."""
    return [(text.count("\n", 0, at) + 1, message) for at, message in sorted(Shell(text).run())]
