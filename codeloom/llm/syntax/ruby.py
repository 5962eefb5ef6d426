"""Ruby: a lexer that knows where a value can start, and calls without parentheses."""

from __future__ import annotations

import re
from bisect import bisect_right

from codeloom.llm.syntax.base import BAD, CONFLICT, END, Fail, K, O, kinds_of, ops_of, spelled
from codeloom.llm.syntax.lines import Lines

_WORDS = frozenset(
    "alias and begin BEGIN break case class def defined? do else elsif end END ensure false for if in module next nil not or redo rescue retry return "
    "self super then true undef unless until when while yield __FILE__ __LINE__ __dir__ __method__".split()
)
_VALUES = kinds_of("end self true false nil redo retry super __FILE__ __LINE__ __dir__ __method__") | frozenset("i0s)]}")
_OPERATORS = sorted(
    "**= <=> === ... <<= >>= &&= ||= ** == != >= <= && || << >> += -= *= /= %= &= |= ^= =~ !~ .. :: -> => &.".split(), key=len, reverse=True
)
_CLOSE = {"(": ")", "[": "]", "{": "}", "<": ">"}
_SPACE = re.compile(r"(?:[ \t\r\f\v]|\\\n)+")
_WORD = re.compile(r"[^\W\d]\w*(?:[?!](?![=~]|\Z)|[?!](?==[=~>]))?")
_VARIABLE = re.compile(r"@@?[^\W\d]\w*|\$(?:[^\W\d]\w*|-\w|[0-9~*$?!@/\;,.=:_\"<>&`'+])")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+(?![\d.])|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?")
_HEREDOC = re.compile(r"<<([~-]?)(?:\"([^\"\n]+)\"|'([^'\n]+)'|`([^`\n]+)`|([A-Z_]\w*))")
_PERCENT = re.compile(r"%(?:[wWiIqQrsx]?)([^\w\s])")
_SYMBOL = re.compile(r":(?:[^\W\d]\w*[?!=]?(?![>~=])|[^\W\d]\w*[?!]?|@@?\w+|\$\w+|\[\]=?|\*\*|<=>|===?|=~|![=~]?|<<|>>|<=|>=|[+\-]@|[+\-*/%<>&|^~])")
_MARKER = re.compile(r"(?:<<<<<<<|=======|>>>>>>>|\|\|\|\|\|\|\|)(?= |\n|\Z)[^\n]*")


def _skip(text: str, at: int, opening: str, closing: str, holes: bool) -> int:
    """The index after the literal whose content starts at ``at``, or -1."""
    depth, n = 0, len(text)
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
            continue
        if holes and c == "#" and text.startswith("#{", at):
            at = _hole(text, at + 2)
            if at < 0:
                return -1
            continue
        if c == closing:
            if not depth:
                return at + 1
            depth -= 1
        elif c == opening and opening != closing:
            depth += 1
        at += 1
    return -1


def _hole(text: str, at: int) -> int:
    """The index after the brace that closes an interpolation."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c == "}":
            if not depth:
                return at + 1
            depth -= 1
        elif c == "{":
            depth += 1
        elif c in "\"'`":
            at = _skip(text, at + 1, c, c, c != "'")
            if at < 0:
                return -1
            continue
        elif c == "\\":
            at += 1
        at += 1
    return -1


def tokens(text: str) -> tuple[str, list[int]]:
    """The kinds of the tokens and where they start."""
    kinds: list[str] = []
    starts: list[int] = []
    pending: list[tuple[str, bool]] = []
    at, n, spaced, braces = 0, len(text), True, []

    def add(kind: str, start: int) -> None:
        kinds.append(kind)
        starts.append(start)

    while at < n:
        c = text[at]
        if m := _SPACE.match(text, at):
            at, spaced = m.end(), True
            continue
        if c == "\n":
            if kinds and kinds[-1] != "\n":
                add("\n", at)
            at += 1
            for tag, indented in pending:
                m = re.compile(rf"^{'[ \t]*' if indented else ''}{re.escape(tag)}\r?$", re.M).search(text, at)
                if not m:
                    add(BAD, at)
                    return "".join(kinds), starts
                at = min(m.end() + 1, n)
            pending, spaced = [], True
            if text.startswith("=begin", at):
                m = re.compile(r"^=end\b[^\n]*", re.M).search(text, at)
                if not m:
                    add(BAD, at)
                    break
                at = m.end()
            elif re.compile(r"__END__\r?(?:\n|\Z)").match(text, at):
                break
            elif m := _MARKER.match(text, at):
                add(CONFLICT, at)
                at = m.end()
            continue
        if c == "#":
            end = text.find("\n", at)
            at = n if end < 0 else end
            continue
        if at == 0 and (m := _MARKER.match(text)):
            add(CONFLICT, 0)
            at = m.end()
            continue
        prev = kinds[-1] if kinds else "\n"
        follows = text[at + 1 : at + 2]
        value = prev not in _VALUES
        # After a name with a space before and none after, an operator starts an argument.
        argument = prev == "i" and spaced and not follows.isspace() and follows != "="
        member = prev in (".", O("&.")) or prev == K("def")
        start, glued, spaced = at, not spaced, False
        if m := _WORD.match(text, at):
            word, at = m.group(), m.end()
            if text[at : at + 1] == ":" and text[at + 1 : at + 2] != ":" and not (prev == "?" and not text[at + 1 : at + 2].isspace()) and not member:
                if not (prev != "," and "?" in kinds and text[at - 1] != "?" and _ternary(kinds)):
                    add("l", start)
                    at += 1
                    continue
            if member and word in _WORDS and prev != K("def"):
                add("i", start)
            elif word in _WORDS and not (prev == K("def") and word != "self"):
                add(K(word), start)
            else:
                add("i", start)
            continue
        if m := _VARIABLE.match(text, at):
            add("i", start)
            at = m.end()
            continue
        if c.isdigit():
            m = _NUMBER.match(text, at)
            at = m.end()
            at = at + 1 if text[at : at + 1] in ("r", "i") else at
            add(BAD if text[at : at + 1].isalpha() else "0", start)
            continue
        if c in "\"'`":
            if member:
                add("i", start)
                at += 1
                continue
            at = _skip(text, at + 1, c, c, c != "'")
            if at < 0:
                add(BAD, start)
                break
            if text[at : at + 1] == ":" and text[at + 1 : at + 2] not in (":",) and prev in "{,(|" + O("f(") + "i\n" and not _ternary(kinds):
                at += 1
                add("l", start)
            else:
                add("s", start)
            continue
        if (m := _HEREDOC.match(text, at)) and (value or (prev == "i" and not glued)) and not member:
            pending.append((next(g for g in m.groups()[1:] if g), bool(m.group(1))))
            add("s", start)
            at = m.end()
            continue
        if c == "%" and (m := _PERCENT.match(text, at)) and (value or (argument and follows != " ")) and not member:
            opening = m.group(1)
            at = _skip(text, m.end(), opening, _CLOSE.get(opening, opening), text[start + 1] not in "wiqs")
            if at < 0:
                add(BAD, start)
                break
            if text[start + 1] == "r":
                at = re.compile(r"[a-z]*").match(text, at).end()
            add("s", start)
            continue
        if c == "/" and (value or argument) and not member:
            at = _skip(text, at + 1, "/", "/", True)
            if at < 0:
                add(BAD, start)
                break
            at = re.compile(r"[a-z]*").match(text, at).end()
            add("s", start)
            continue
        if c == "?" and (value or argument) and follows and not follows.isspace() and not re.match(r"\w\w", text[at + 1 : at + 3]):
            at += 3 if follows == "\\" else 2
            add("s", start)
            continue
        if c == ":" and follows == '"':
            at = _skip(text, at + 2, '"', '"', True)
            if at < 0:
                add(BAD, start)
                break
            add("s", start)
            continue
        if c == ":" and follows != ":" and (value or not glued or prev in "(,[") and (m := _SYMBOL.match(text, at)):
            add("s", start)
            at = m.end()
            continue
        op = next((o for o in _OPERATORS if text.startswith(o, at)), c)
        at += len(op)
        if op == "(" and glued and (prev in ("i", ")", "]", O("&."), ".", "}") or prev in kinds_of("yield super defined? not")):
            add(O("f("), start)
        elif op == "[" and glued and prev in _VALUES:
            add(O("f["), start)
        elif op in ("*", "**", "&", "-", "+", "::", "!", "[", "->") and not member and op in ("*", "**", "&", "-", "+", "::") and (value or (prev == "i" and not glued and not text[at : at + 1].isspace())):
            add(O("u" + op), start)
        elif op in "()[]{}.,;:?|&<>=+-*/%!~^" or len(op) > 1:
            add(O(op), start)
        else:
            add(BAD, start)
    return "".join(kinds), starts


def _ternary(kinds: list[str]) -> bool:
    """Whether a conditional of this line still waits for its colon."""
    open_, i = 0, len(kinds) - 1
    while i >= 0 and kinds[i] != "\n":
        open_ += (kinds[i] == "?") - (kinds[i] == ":")
        i -= 1
    return open_ > 0


_JOIN = re.compile(r"\n+(?=[" + "".join(re.escape(k) for k in (".", O("&."), O("&&"), O("||"))) + r"])")
_ASSIGN = ops_of("= += -= *= /= %= **= &= |= ^= <<= >>= &&= ||=")
_ARGUMENT = (
    frozenset("i0sl[!~") | ops_of("u- u* u** u& u:: u+ -> u::") | kinds_of("nil true false self not defined? yield super lambda proc def __FILE__ __LINE__ __dir__ __method__ case if unless while begin")
) - kinds_of("if unless while")
_STOPS = kinds_of("end else elsif when in rescue ensure") | frozenset("})")


class Ruby(Lines):
    NAMES = frozenset("i")
    PREFIX = frozenset("!~+-") | ops_of("u- u+")
    BINARY = {
        O(op): i
        for i, row in enumerate(
            ["= += -= *= /= %= **= &= |= ^= <<= >>= &&= ||=", "", ".. ...", "||", "&&", "<=> == === != =~ !~", "< <= > >=", "| ^", "&", "<< >>", "+ -", "* / %", "**"], 1
        )
        for op in row.split()
    }

    def __init__(self, kinds: str):
        super().__init__(kinds)
        self.no_do = False  # in the head of a loop ``do`` opens its body
        self.callable = False

    # -- expressions

    def infix(self, t: str) -> bool:
        if t in ops_of(".. ...") and self.s[self.p] in ")]\n;" + END + K("then") + O("f("):
            return True
        if t in _ASSIGN:
            self.nls()
            self.opt(O("u*"))
            self.expr(1)
            if self.pk() == K("rescue"):
                self.p += 1
                self.expr(1)
            return True
        self.nls()
        return False

    def tail(self, t: str) -> bool:
        if t == "?":
            self.p += 1
            self.nls()
            if self.opt("l"):  # ``a ? b: c``
                self.expr(1)
                return True
            self.expr(1)
            self.nls()
            self.need(":", " of a conditional")
            self.nls()
            self.expr(1)
            return True
        return False

    def until(self, close: str, item) -> None:
        """Items with commas up to ``close``."""
        d, self.d = self.d, self.d + 1
        no_do, self.no_do = self.no_do, False
        try:
            while self.pk() != close:
                item()
                if not self.opt(","):
                    break
            self.need(close)
        finally:
            self.d, self.no_do = d, no_do

    def argument(self) -> None:
        t = self.pk()
        if t in ops_of("u* u** u& * ** &"):
            self.p += 1
            if self.pk() in ",)|]":
                return
            self.expr()
        elif t == "l":
            self.p += 1
            if self.pk() in ",)]}\n":
                return
            self.wide()
        elif t == O("..."):
            self.p += 1
        else:
            self.wide()
            if self.opt(O("=>")):
                self.nls()
                self.expr()

    def wide(self) -> None:
        if self.opt(K("not")):
            self.wide()
        else:
            self.expr()

    def arguments(self) -> None:
        """Arguments without parentheses."""
        self.argument()
        while self.s[self.p] == ",":
            self.p += 1
            self.nls()
            self.argument()

    def primary(self) -> None:
        t = self.pk()
        self.callable = False
        if t == "i":
            self.p += 1
            self.callable = True
        elif t == "s":
            while self.s[self.p] == "s":
                self.p += 1
        elif t == "0" or t in kinds_of("nil true false redo retry __FILE__ __LINE__ __dir__ __method__"):
            self.p += 1
        elif t == K("self"):
            self.p += 1
        elif t in "(" + O("f("):
            self.p += 1
            d, self.d, no_do, self.no_do = self.d, 0, self.no_do, False
            self.stmts(")")
            self.need(")")
            self.d, self.no_do = d, no_do
        elif t == "[" or t == O("f["):
            self.p += 1
            self.until("]", self.argument)
        elif t == "{":
            self.p += 1
            self.until("}", self.argument)
        elif t == O("->"):
            self.p += 1
            if self.pk() in "(" + O("f("):
                self.p += 1
                self.parameters(")")
                self.need(")")
            elif self.pk() not in "{" + K("do"):
                self.parameters("{" + K("do"))
            self.block()
        elif t in ops_of("u:: .. ..."):
            self.p += 1
            self.primary()
        elif t in (K("super"), K("yield")):
            self.p += 1
            self.callable = True
        elif t in kinds_of("return break next"):
            self.p += 1
            if self.s[self.p] in _ARGUMENT or self.s[self.p] in "({" + O("f("):
                self.arguments()
        elif t == K("defined?") or t == K("not"):
            self.p += 1
            self.expr()
        elif t == K("if") or t == K("unless"):
            self.p += 1
            self.condition()
            self.opt(K("then"))
            self.body()
            while self.opt(K("elsif")):
                self.condition()
                self.opt(K("then"))
                self.body()
            if self.opt(K("else")):
                self.body()
            self.close(t)
        elif t == K("while") or t == K("until"):
            self.p += 1
            self.condition()
            self.opt(K("do"))
            self.body()
            self.close(t)
        elif t == K("for"):
            self.p += 1
            self.parameters(K("in"))
            self.need(K("in"))
            self.condition()
            self.opt(K("do"))
            self.body()
            self.close(t)
        elif t == K("case"):
            self.case()
        elif t == K("begin"):
            self.p += 1
            self.rescued()
            self.close(t)
        elif t == K("def"):
            self.def_()
        elif t == K("class") or t == K("module"):
            self.p += 1
            d, self.d = self.d, 0
            if t == K("class") and self.opt(O("<<")):
                self.expr()
            else:
                self.opt(O("u::"))
                self.name()
                while self.opt(O("::")):
                    self.name()
                if t == K("class") and self.opt("<"):
                    self.expr()
            if self.s[self.p] not in "\n;":
                self.fail(f"expected end of line, found {self.shown()}")
            self.rescued()
            self.close(t)
            self.d = d
        elif t in kinds_of("BEGIN END") and self.s[self.p + 1] == "{":
            self.p += 1
            self.block()
        else:
            self.fail()

    def close(self, opener: str) -> None:
        self.need(K("end"), f" of {spelled(opener)}")

    def condition(self) -> None:
        no_do, self.no_do = self.no_do, True
        self.expr_statement()
        self.no_do = no_do
        if self.s[self.p] in "\n;":
            self.p += 1
        elif self.s[self.p] not in kinds_of("then do"):
            self.fail(f"expected end of a condition, found {self.shown()}")
        self.nls()

    def body(self) -> None:
        d, self.d, no_do, self.no_do = self.d, 0, self.no_do, False
        self.stmts("")
        self.d, self.no_do = d, no_do

    def rescued(self) -> None:
        self.body()
        while self.opt(K("rescue")):
            if self.s[self.p] not in "\n;" + K("then") + O("=>"):
                self.arguments_of_rescue()
            if self.opt(O("=>")):
                self.expr(2)
            self.opt(K("then"))
            self.body()
        if self.opt(K("else")):
            self.body()
        if self.opt(K("ensure")):
            self.body()

    def arguments_of_rescue(self) -> None:
        while True:
            self.opt(O("u*"))
            self.expr(2)
            if not self.opt(","):
                return
            self.nls()

    def case(self) -> None:
        self.p += 1
        if self.s[self.p] not in "\n;":
            self.expr_statement()
        while self.s[self.p] in "\n;":
            self.p += 1
        n = 0
        while self.pk() in (K("when"), K("in")):
            pattern = self.pk() == K("in")
            self.p += 1
            if pattern:
                while self.s[self.p] not in "\n;" + K("then") + END:
                    self.p = self.closing(self.p) + 1 if self.s[self.p] in "([{" and self.closing(self.p) > 0 else self.p + 1
            else:
                while True:
                    self.nls()
                    self.opt(O("u*"))
                    self.expr()
                    if not self.opt(","):
                        break
            if not self.opt(K("then")) and self.s[self.p] not in "\n;":
                self.fail(f"expected end of line or then, found {self.shown()}")
            self.body()
            n += 1
        if not n:
            self.fail(f"expected when, found {self.shown()}")
        if self.opt(K("else")):
            self.body()
        self.close(K("case"))

    def def_(self) -> None:
        self.p += 1
        d, self.d = self.d, 0
        if self.s[self.p + 1] == "." and self.s[self.p] in "i" + K("self"):
            self.p += 2
        t = self.s[self.p]
        if t == "i" or chr(0xE000) <= t < chr(0xE800):
            self.p += 1
            if self.s[self.p] == "=" and self.s[self.p + 1] in "(" + O("f("):
                self.p += 1
        elif t in "[" + O("f["):
            self.p += 1
            self.need("]")
            self.opt("=")
        elif t in self.BINARY or t in "!~" + O("!~"):
            self.p += 1
        elif t in ops_of("u- u+ u* u& u**"):
            self.p += 1
        else:
            self.fail(f"expected a method name, found {self.shown()}")
        if self.pk() in "(" + O("f("):
            self.p += 1
            self.parameters(")")
            self.need(")")
        elif self.s[self.p] not in "\n;=":
            self.parameters("\n;")
        if self.opt("="):
            self.nls()
            self.expr_statement()
        else:
            if self.s[self.p] not in "\n;" and self.s[self.p - 1] != ")":
                self.fail(f"expected end of line, found {self.shown()}")
            self.rescued()
            self.close(K("def"))
        self.d = d

    def parameters(self, stops: str) -> None:
        """Parameters of a method, block or loop, up to one of the stops."""
        if ")" in stops or "|" in stops:
            self.nls()
        while self.s[self.p] not in stops:
            if self.s[self.p] == ";" and "|" in stops:
                self.p += 1
                continue
            t = self.s[self.p]
            if t in ops_of("u* u** u& * ** &"):
                self.p += 1
                self.opt("i") or self.opt(K("nil"))
            elif t in "(" + O("f("):
                self.p += 1
                self.parameters(")")
                self.need(")")
            elif t == "l":
                self.p += 1
                if self.s[self.p] not in ",)|\n":
                    self.expr(9)
            elif t == O("..."):
                self.p += 1
            else:
                self.name()
                if self.opt("="):
                    self.expr(9)
            if ")" in stops or "|" in stops:
                self.nls()
            if not self.opt(","):
                break
            self.nls()
        if self.s[self.p] not in stops + ";":
            self.fail(f"unexpected {self.shown()} among parameters")
        if self.s[self.p] == ";" and "|" in stops:
            self.parameters(stops)

    def block(self) -> None:
        """``{ |x| … }`` or ``do |x| … end``."""
        word = self.pk() == K("do")
        self.p += 1
        d, self.d, no_do, self.no_do = self.d, 0, self.no_do, False
        self.nls()
        if self.opt(O("||")):
            pass
        elif self.opt("|"):
            self.parameters("|")
            self.need("|")
        if word:
            self.rescued()
            self.close(K("do"))
        else:
            self.stmts("}")
            self.need("}")
        self.d, self.no_do = d, no_do

    def postfix(self) -> None:
        call = self.callable
        while True:
            t = self.s[self.p] if self.d == 0 else self.pk()
            if t == O("f("):
                if not call:
                    self.fail()
                self.p += 1
                self.until(")", self.argument)
            elif t == O("f["):
                self.p += 1
                self.until("]", self.argument)
                call = True
            elif t in (".", O("&."), O("::")):
                self.p += 1
                self.nls()
                t = self.s[self.p]
                if t == "i" or chr(0xE000) <= t < chr(0xE800):
                    self.p += 1
                elif t == O("f("):
                    pass
                elif t in "!" or t in self.BINARY or t in ops_of("u- u+"):
                    self.p += 1
                else:
                    self.fail(f"expected a method name, found {self.shown()}")
                call = True
            elif t == "{" and call and self.s[self.p - 1] not in "0s":
                self.block()
            elif t == K("do") and not self.no_do:
                self.block()
            elif call and self.s[self.p] in _ARGUMENT and self.s[self.p - 1] in "i" + K("super") + K("yield") + "?!":
                self.arguments()
                call = False
            elif call and self.s[self.p] in "(" and self.s[self.p - 1] in "i" + K("super") + K("yield"):
                self.arguments()
                call = False
            else:
                return

    # -- statements

    def expr_statement(self) -> None:
        self.part()
        while self.s[self.p] in (K("and"), K("or")):
            self.p += 1
            self.nls()
            self.part()

    def part(self) -> None:
        while self.opt(K("not")):
            pass
        start = self.p
        self.opt(O("u*"))
        self.expr()
        if self.s[self.p] == "," and (self.s[start:self.p].find("=") < 0):
            q = self.p
            while self.opt(","):
                self.opt(O("u*")) or self.opt("*")
                if self.s[self.p] == "=":
                    break
                self.expr(2)
            if self.s[self.p] == "=":
                self.p += 1
                self.nls()
                self.arguments()
            else:
                self.p = q
        elif self.s[self.p] == ",":
            while self.opt(","):
                self.nls()
                self.opt(O("u*"))
                self.expr()
        elif self.p == start + 2 and self.s[start] == O("u*") and self.opt("="):
            self.arguments()
        if self.s[self.p] in (O("=>"), K("in")) and not self.no_do:
            while self.s[self.p] not in "\n;" + END:
                self.p += 1

    def one(self) -> None:
        t = self.s[self.p]
        if t == K("alias"):
            self.p += 1
            for _ in range(2):
                if self.s[self.p] in "\n;" + END:
                    self.fail("alias needs two names")
                self.p += 1
            return
        if t == K("undef"):
            self.p += 1
            self.arguments()
            return
        self.expr_statement()
        while self.s[self.p] in kinds_of("if unless while until rescue"):
            self.p += 1
            self.expr_statement()

    def stmts(self, close: str) -> None:
        stops = _STOPS if close != "top" else frozenset()
        while True:
            while self.s[self.p] in "\n;":
                self.p += 1
            t = self.s[self.p]
            if t == END or t in stops:
                return
            depth = self.nested
            try:
                self.one()
                if self.s[self.p] not in "\n;" + END and self.s[self.p] not in stops:
                    self.fail(f"expected end of line, found {self.shown()}")
            except Fail as e:
                self.errors.append((e.at, e.message))
                self.d, self.nested, self.no_do = 0, depth, False
                self.p = max(self.p, e.at)
                if self.p >= len(self.s) - 4:
                    return
                if self.s[self.p] != "\n":
                    self.p += 1
                while self.s[self.p] not in "\n" + END:
                    self.p += 1

    def run(self) -> list[tuple[int, str]]:
        self.stmts("top")
        return self.errors


def ruby_errors(text: str) -> list[tuple[int, str]]:
    """``(line, message)`` of every error that recovery leads to."""
    kinds, starts = tokens(text)
    if not kinds.strip("\n"):
        return []
    found = {i: "conflict marker" if k == CONFLICT else "stray character or literal that is not closed" for i, k in enumerate(kinds) if k in BAD + CONFLICT}
    folded = _JOIN.sub("", kinds)
    where = [i for i, k in enumerate(kinds) if k != "\n"]
    for at, message in Ruby(folded).run():
        ordinal = len(folded[:at].replace("\n", ""))
        found.setdefault(where[ordinal] if ordinal < len(where) else len(kinds), message)
    ends = [i for i, c in enumerate(text) if c == "\n"]
    return [(bisect_right(ends, starts[i] - 1 if i < len(starts) else len(text)) + 1, m) for i, m in sorted(found.items())]
