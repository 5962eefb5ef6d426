"""Go: line ends that end statements, types after names, composite literals."""

from __future__ import annotations

import re

from codeloom.llm.syntax.base import BAD, BLOCK_COMMENT, CHARACTER, CONFLICT, DOUBLE, END, K, LINE_COMMENT, NAME, NUMBER, O, Lexer, Parser, kinds_of, ops_of, spelled

_WORDS = (
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return "
    "select struct switch type var"
)
_OPS = "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^"
_ASSIGN = ops_of("= += -= *= /= %= &= |= ^= <<= >>= &^=")
_ENDERS = kinds_of("break continue fallthrough return") | ops_of("++ --") | frozenset("i0s)]}" + BAD + CONFLICT)
_LINES = re.compile(r"\n+")
_FOLD = re.compile("(?<![" + "".join(map(re.escape, sorted(_ENDERS))) + r"])\n")


def _token(token: str) -> str | None:
    if token[0] == "\n":
        return "\n"
    if token.startswith(("//", "/*")) and len(token) > 1:
        return "\n" if "\n" in token else ""
    return None


GO_LEXER = Lexer([r"\n\s*", LINE_COMMENT, BLOCK_COMMENT, NAME, NUMBER, DOUBLE, CHARACTER, r"`[^`]*`"], _WORDS, _OPS, "()[]{};,:.~!+-*/%&|^<>=", _token)


def fold(kinds: str) -> str:
    """Keep the line ends that the language reads as semicolons."""
    return _FOLD.sub("", _LINES.sub("\n", kinds))


class Go(Parser):
    BINARY = {O(op): i for i, row in enumerate(["||", "&&", "== != < <= > >=", "+ - | ^", "* / % << >> & &^"], 2) for op in row.split()}
    PREFIX = ops_of("+ - ! ^ * & <-")
    TYPES = frozenset("i*[(") | kinds_of("map chan func struct interface") | ops_of("<-")

    def __init__(self, kinds: str):
        super().__init__(kinds)
        self.bare = False  # in the head of a control statement a brace opens its body

    def end(self) -> None:
        if self.pk() in ";\n":
            self.p += 1
        elif self.pk() not in "})" + END:
            self.fail(f"expected end of statement, found {self.shown()}")

    def shown(self) -> str:
        return spelled(self.s[self.p])

    def listed(self, close: str, item, holes: bool = False) -> None:
        bare, self.bare = self.bare, False
        while self.pk() != close:
            item()
            if not self.opt(","):
                break
        self.need(close)
        self.bare = bare

    def group(self, spec) -> None:
        """One specification, or several in parentheses."""
        if self.opt("("):
            while self.pk() != ")":
                if self.pk() in ";\n":
                    self.p += 1
                    continue
                spec()
                self.end()
            self.need(")")
        else:
            spec()

    def names(self) -> None:
        self.name()
        while self.opt(","):
            self.name()

    def exprs(self) -> None:
        self.expr()
        while self.opt(","):
            self.expr()

    # -- types

    def type_(self) -> None:
        self.deeper()
        t = self.pk()
        if t == "i":
            self.p += 1
            if self.opt("."):
                self.name()
            if self.pk() == "[" and self.s[self.p + 1] != "]":
                self.attempt(self.type_arguments)
        elif t == "*":
            self.p += 1
            self.type_()
        elif t == "(":
            self.p += 1
            self.type_()
            self.need(")")
        elif t == "[":
            self.p += 1
            if self.pk() != "]" and not self.opt(O("...")):
                bare, self.bare = self.bare, False
                self.expr()
                self.bare = bare
            self.need("]")
            self.type_()
        elif t == K("map"):
            self.p += 1
            self.need("[")
            self.type_()
            self.need("]")
            self.type_()
        elif t == K("chan"):
            self.p += 1
            self.opt(O("<-"))
            self.type_()
        elif t == O("<-"):
            self.p += 1
            self.need(K("chan"))
            self.type_()
        elif t == K("func"):
            self.p += 1
            self.signature()
        elif t == K("struct"):
            self.p += 1
            self.members(self.field)
        elif t == K("interface"):
            self.p += 1
            self.members(self.element)
        else:
            self.fail(f"expected a type, found {self.shown()}")
        self.nested -= 1

    def type_arguments(self) -> None:
        self.p += 1
        self.listed("]", self.type_)

    def members(self, member) -> None:
        self.need("{")
        while self.pk() != "}":
            if self.pk() in ";\n":
                self.p += 1
                continue
            member()
            self.end()
        self.p += 1

    def field(self) -> None:
        if self.opt("*"):
            self.type_()
        else:
            self.name()
            if self.pk() == "." or self.pk() in "s;\n}":
                self.p -= 1
                self.type_()
            elif self.pk() == "[" and not self.attempt(self.type_):
                self.p -= 1
                self.type_()
            elif self.s[self.p - 1] == "i" and self.pk() not in "s;\n}":
                while self.opt(","):
                    self.name()
                self.type_()
        self.opt("s")

    def element(self) -> None:
        if self.pk() == "i" and self.s[self.p + 1] == "(":
            self.p += 1
            self.signature()
        else:
            self.constraint()

    def constraint(self) -> None:
        while True:
            self.opt("~")
            self.type_()
            if not self.opt("|"):
                return

    def type_parameters(self) -> None:
        self.need("[")
        bound = False
        while self.pk() != "]":
            self.name()
            bound = self.pk() not in ",]"
            if bound:
                self.constraint()
            if not self.opt(","):
                break
        if not bound:
            self.fail("type parameter without a constraint")
        self.need("]")

    def signature(self) -> None:
        self.parameters()
        if self.pk() == "(":
            self.parameters()
        elif self.pk() in self.TYPES:
            self.type_()

    def parameters(self) -> None:
        self.need("(")
        kinds: list[str] = []
        self.listed(")", lambda: kinds.append(self.parameter()))
        if "named" in kinds and ("type" in kinds or kinds[-1] != "named"):
            self.fail("named and unnamed parameters are mixed")

    def parameter(self) -> str:
        if self.pk() == "i":
            start = self.p
            self.p += 1
            t = self.pk()
            if t in ",)":
                return "name"
            if t == "[":
                if self.attempt(self.type_) and self.pk() in ",)":
                    return "named"
                self.p = start
            elif t == ".":
                self.p = start
            else:
                self.opt(O("..."))
                self.type_()
                return "named"
        self.opt(O("..."))
        self.type_()
        return "type"

    # -- expressions

    def tail(self, t: str) -> bool:
        return False

    def primary(self) -> None:
        t = self.pk()
        self.literal_of = False
        if t == "i":
            self.p += 1
            self.literal_of = True
        elif t in "0s":
            self.p += 1
        elif t == "(":
            self.p += 1
            bare, self.bare = self.bare, False
            self.expr()
            self.need(")")
            self.bare = bare
        elif t == K("func"):
            self.p += 1
            self.signature()
            if self.pk() == "{":
                self.block()
        elif t in "[" or t in kinds_of("map chan struct interface"):
            self.type_()
            if self.pk() == "{" and t in "[" + K("map") + K("struct"):
                self.literal()
        else:
            self.fail()

    def postfix(self) -> None:
        literal = self.literal_of
        while True:
            t = self.pk()
            if t == ".":
                self.p += 1
                if self.opt("("):
                    if not self.opt(K("type")):
                        self.type_()
                    self.need(")")
                    literal = False
                else:
                    self.name()
            elif t == "[":
                self.p += 1
                self.index()
            elif t == "(":
                self.p += 1
                self.listed(")", self.argument)
                literal = False
            elif t == "{" and literal and not self.bare:
                self.literal()
                literal = False
            else:
                return

    def argument(self) -> None:
        self.expr()
        self.opt(O("..."))

    def index(self) -> None:
        bare, self.bare = self.bare, False
        if self.pk() != ":":
            self.expr()
        if self.pk() == ",":
            while self.opt(",") and self.pk() != "]":
                self.type_()
        for _ in range(2):
            if self.opt(":") and self.pk() not in ":]":
                self.expr()
        self.need("]")
        self.bare = bare

    def literal(self) -> None:
        self.p += 1
        self.deeper()
        self.listed("}", self.keyed)
        self.nested -= 1

    def keyed(self) -> None:
        self.literal_value()
        if self.opt(":"):
            self.literal_value()

    def literal_value(self) -> None:
        if self.pk() == "{":
            self.literal()
        else:
            self.expr()

    # -- statements

    def block(self, context: str = "block") -> None:
        bare, self.bare = self.bare, False
        self.need("{")
        if context == "switch" and self.pk() not in "}" + K("case") + K("default"):
            self.fail("expected case, default or }")
        self.deeper()
        self.statements(context, "}")
        self.nested -= 1
        if self.s[self.p] != "}":
            self.fail("missing }")
        self.p += 1
        self.bare = bare

    def statement(self, context: str) -> None:
        self.bare = False
        t = self.pk()
        if t in (K("var"), K("const"), K("type")):
            self.p += 1
            self.group({K("var"): self.variables, K("const"): self.constants, K("type"): self.type_spec}[t])
        elif context == "top":
            if self.opt(K("import")):
                self.group(self.imported)
            elif self.opt(K("func")):
                if self.pk() == "(":
                    self.parameters()
                self.name()
                if self.pk() == "[":
                    self.type_parameters()
                self.signature()
                if self.pk() == "{":
                    self.block()
            else:
                self.fail(f"expected a declaration, found {self.shown()}")
        elif t == K("return"):
            self.p += 1
            if self.pk() not in ";\n}":
                self.exprs()
        elif t in (K("break"), K("continue")):
            self.p += 1
            self.opt("i")
        elif t == K("goto"):
            self.p += 1
            self.name()
        elif t == K("fallthrough"):
            self.p += 1
        elif t in (K("go"), K("defer")):
            self.p += 1
            self.expr()
        elif t == K("if"):
            self.if_()
        elif t == K("for"):
            self.for_()
        elif t == K("switch"):
            self.p += 1
            self.bare = True
            if self.pk() != "{":
                if self.pk() != ";":
                    self.simple()
                if self.pk() in ";\n":
                    self.p += 1
                    if self.pk() != "{":
                        self.simple()
            self.bare = False
            self.block("switch")
        elif t == K("select"):
            self.p += 1
            self.block("switch")
        elif t == "{":
            self.block()
        elif context == "switch" and t == K("case"):
            self.p += 1
            self.simple()
            self.need(":")
            return
        elif context == "switch" and t == K("default"):
            self.p += 1
            self.need(":")
            return
        elif t == "i" and self.s[self.p + 1] == ":":
            self.p += 2
            return
        else:
            self.simple()
        self.end()

    def imported(self) -> None:
        if self.pk() in "i.":
            self.p += 1
        self.need("s")

    def variables(self) -> None:
        self.names()
        if self.pk() != "=":
            self.type_()
        if self.opt("="):
            self.exprs()

    def constants(self) -> None:
        self.names()
        if self.pk() in self.TYPES:
            self.type_()
            if self.pk() != "=":
                self.fail("expected = of a constant")
        if self.opt("="):
            self.exprs()

    def type_spec(self) -> None:
        self.name()
        if self.pk() == "[" and self.attempt(self.generic):
            return
        self.opt("=")
        self.type_()

    def generic(self) -> None:
        self.type_parameters()
        self.opt("=")
        self.type_()

    def simple(self, loop: bool = False) -> None:
        start = self.p
        if loop and self.opt(K("range")):
            self.expr()
            return
        self.exprs()
        t = self.pk()
        if t in _ASSIGN or t == O(":="):
            if t == O(":=") and self.s[start : self.p].strip("i,"):
                self.fail("no name on the left side of :=")
            self.p += 1
            if loop and self.opt(K("range")):
                self.expr()
            else:
                self.exprs()
        elif t in ops_of("++ --"):
            self.p += 1
        elif t == O("<-"):
            self.p += 1
            self.expr()

    def if_(self) -> None:
        self.p += 1
        self.bare = True
        if self.pk() == "{":
            self.fail("if without a condition")
        if self.pk() != ";":
            self.simple()
        if self.pk() in ";\n":
            self.p += 1
            self.simple()
        self.bare = False
        self.block()
        if self.opt(K("else")):
            if self.pk() == K("if"):
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.p += 1
        self.bare = True
        if self.pk() != "{":
            if self.pk() != ";":
                self.simple(loop=True)
            if self.opt(";"):
                if self.pk() != ";":
                    self.expr()
                self.need(";")
                if self.pk() != "{":
                    self.simple()
        self.bare = False
        self.block()

    def run(self) -> list[tuple[int, str]]:
        while self.s[self.p] in "\n;":
            self.p += 1
        if self.s[self.p : self.p + 2] == K("package") + "i":
            self.p += 2
        else:
            self.errors.append((self.p, "expected a package clause"))
        return super().run()
