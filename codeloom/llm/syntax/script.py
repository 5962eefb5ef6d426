"""JavaScript and TypeScript, with JSX elements."""

from __future__ import annotations

import re

from codeloom.llm.syntax.base import BLOCK_COMMENT, DOUBLE, END, Fail, K, LINE_COMMENT, NUMBER, O, SINGLE, Lexer, Parser, kinds_of, ops_of
from codeloom.llm.syntax.braces import LEVELS, levels

_RESERVED = (
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof "
    "new return super switch this throw try typeof var void while enum null true false"
)
_SOFT = "let static async await of get set from as yield"
_SOFT_TS = _SOFT + (
    " type interface declare namespace module abstract readonly public private protected override keyof infer is asserts satisfies unique "
    "implements accessor global"
)
_OPS = "... => === !== **= <<= == != <= ++ -- << && || ?? ?. += -= *= /= %= &= ^= |= &&= ||= ??= **"

_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\})*`"
_REGEX = r"(?<=[(,=:\[!&|?{};+\n>])[ \t]*/(?![*/\s])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*(?![\w(])|\breturn[ \t]+/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"


def _token(token: str) -> str | None:
    if token[0] == "\n":
        return "\n"
    if token.startswith(("//", "/*")):
        return "" if "\n" not in token else "\n"
    if token.startswith("#!"):
        return ""
    if token[0] == "`" and len(token) > 1:
        return "t"
    if token.startswith("return") and token.endswith(tuple("/gimsuyd")) and "/" in token:
        return K("return") + "s"
    if token.lstrip(" \t").startswith("/") and len(token.strip()) > 2:
        return "s"
    if token[0] in "#$" and len(token) > 1:
        return "i"
    return None


def _parts() -> list[str]:
    return [r"\A#![^\n]*", r"\n\s*", LINE_COMMENT, BLOCK_COMMENT, _REGEX, r"[#]?(?:[^\W\d]|\$)[\w$]*", NUMBER, DOUBLE, SINGLE, _TEMPLATE]


_SINGLES = "()[]{};,:?.~!+-*/%&|^<>=@"
JS_LEXER = Lexer(_parts(), f"{_RESERVED} {_SOFT}", _OPS + " >>>= >>> >>= >> >=", _SINGLES, _token)
# Closing angle brackets stay single for type arguments; the parser puts shifts together again.
TS_LEXER = Lexer(_parts(), f"{_RESERVED} {_SOFT_TS}", _OPS, _SINGLES, _token)


def _class(kinds) -> str:
    return "[" + "".join(map(re.escape, kinds)) + "]"


_GO_ON = ops_of("= += -= *= /= %= &= ^= |= &&= ||= ??= **= <<= && || ?? | & ^ == != === !== < <= << + - * / % ** ? : , ( [ { . ?. => ! ~ ...") | kinds_of("new typeof in instanceof else extends")
_COMES_ON = ops_of("= += -= *= /= %= &= ^= |= && || ?? | & ^ == != === !== > >= % ** ? : , ) ] . ?. =>") | kinds_of("in instanceof")
_FOLD = re.compile(rf"(?<={_class(_GO_ON)})\n+|\n+(?={_class(_COMES_ON)})|\n+(?=\n)")


def fold(kinds: str) -> str:
    """Drop the line ends at which no statement can end."""
    return _FOLD.sub("", kinds)


class Script(Parser):
    BINARY = {k: v for k, v in levels(LEVELS + []).items()} | {K("instanceof"): 10, K("in"): 10}
    PREFIX = ops_of("+ - ! ~ ++ --") | kinds_of("typeof void delete await")
    NAMES = frozenset("i") | kinds_of(_SOFT)
    TS = False

    def end(self) -> None:
        t = self.s[self.p]
        if t == ";" or t == "\n":
            self.p += 1
        elif t != "}" and t != END:
            self.fail()

    # expressions

    def unary(self) -> None:
        while self.pk() in self.PREFIX:
            if self.pk() == K("await") and self.s[self.p + 1] in ")=,;.":
                break
            self.p += 1
        self.primary()
        self.postfix()

    def value(self) -> None:
        self.expr(1)

    def argument(self) -> None:
        self.opt(O("..."))
        self.expr(1)

    def comma(self) -> None:
        self.expr()
        while self.opt(","):
            self.expr()

    def arrow_body(self) -> None:
        self.need(O("=>"))
        if self.pk() == "{":
            self.block()
        else:
            self.expr(1)

    def primary(self) -> None:
        t, s = self.pk(), self.s
        if t in "0st":
            self.p += 1
        elif t in self.NAMES:
            self.p += 1
            if t == K("async") and s[self.p] == K("function"):
                self.function(False)
            elif t == K("async") and s[self.p] in self.NAMES and s[self.p + 1] == O("=>"):
                self.p += 1
                self.arrow_body()
            elif s[self.p] == O("=>"):
                self.arrow_body()
            elif t == K("async") and s[self.p] == "(" and self.arrow_at(self.p):
                self.arrow()
            elif t == K("yield") and s[self.p] not in ";\n)],}=." and s[self.p] not in self.BINARY:
                self.opt("*")
                self.expr(1)
        elif t == "(":
            if self.arrow_at(self.p):
                self.arrow()
            else:
                self.p += 1
                self.d += 1
                self.argument()
                while self.opt(","):
                    self.argument()
                self.d -= 1
                self.need(")")
        elif t == "[":
            self.p += 1
            self.listed("]", self.argument, holes=True)
        elif t == "{":
            self.p += 1
            self.listed("}", self.property)
        elif t == K("function"):
            self.function(False)
        elif t == K("class") or t == "@":
            self.decorators()
            self.class_(self.p, False)
        elif t == K("new"):
            self.p += 1
            if self.opt("."):
                self.member()
            else:
                self.primary()
                while self.pk() == "." or self.pk() == "[":
                    if self.opt("."):
                        self.member()
                    else:
                        self.p += 1
                        self.listed("]", self.argument)
                self.type_arguments()
        elif t in kinds_of("this super null true false"):
            self.p += 1
        elif t == K("import") and s[self.p + 1] in "(.":
            self.p += 1
        elif t == "<":
            if not (self.TS and self.attempt(self.generic_arrow)):
                self.element()
        else:
            self.fail()

    def arrow_at(self, at: int) -> bool:
        """Whether the parentheses at ``at`` are the parameters of an arrow function."""
        end = self.closing(at)
        return end > 0 and self.s[end + 1] == O("=>")

    def arrow(self) -> None:
        self.need("(")
        self.listed(")", self.parameter)
        self.arrow_body()

    def generic_arrow(self) -> None:
        self.fail()

    def type_arguments(self) -> None:
        pass

    def property(self) -> None:
        s = self.s
        if self.opt(O("...")):
            self.expr(1)
            return
        self.pk()
        while s[self.p] in kinds_of("async get set") and s[self.p + 1] not in "(,:}=\n":
            self.p += 1
        self.opt("*")
        self.key()
        t = self.pk()
        if t == "(" or t == "<":
            self.method()
        elif self.opt(":"):
            self.expr(1)
        elif self.opt("="):
            self.expr(1)

    def key(self) -> None:
        t = self.pk()
        if t == "[":
            self.p += 1
            self.listed("]", self.argument)
        elif t in "0s" or t in self.NAMES or chr(0xE000) <= t < chr(0xE800):
            self.p += 1
        else:
            self.fail("expected a property name")

    def method(self) -> None:
        d, self.d = self.d, 0
        self.signature()
        self.block()
        self.d = d

    def signature(self) -> None:
        self.need("(")
        self.listed(")", self.parameter)

    def parameter(self) -> None:
        self.decorators()
        self.opt(O("..."))
        self.binding()
        if self.opt("="):
            self.expr(1)

    def binding(self) -> None:
        if self.opt("{"):
            self.listed("}", self.bound_property)
        elif self.opt("["):
            self.listed("]", self.bound_item, holes=True)
        else:
            self.name()

    def bound_item(self) -> None:
        self.opt(O("..."))
        self.binding()
        if self.opt("="):
            self.expr(1)

    def bound_property(self) -> None:
        if self.opt(O("...")):
            self.name()
            return
        self.key()
        if self.opt(":"):
            self.binding()
        if self.opt("="):
            self.expr(1)

    def post(self, t: str) -> bool:
        if t == O("?."):
            self.p += 1
            if self.pk() not in "([":
                self.member()
        elif t == O("++") or t == O("--"):
            self.p += 1
        elif t == "t":
            self.p += 1
        else:
            return False
        return True

    def element(self) -> None:
        """A JSX element or fragment."""
        self.need("<")
        d, self.d = self.d, 1
        if not self.opt(">"):
            self.tag()
            while self.pk() not in "/>":
                if self.opt("{"):
                    self.need(O("..."))
                    self.expr(1)
                    self.need("}")
                    continue
                self.tag()
                if self.opt("="):
                    if self.pk() == "s":
                        self.p += 1
                    elif self.opt("{"):
                        self.expr()
                        self.need("}")
                    else:
                        self.element()
            if self.opt("/"):
                self.need(">")
                self.d = d
                return
            self.need(">")
        while not (self.pk() == "<" and self.s[self.p + 1] == "/"):
            if self.s[self.p] == END:
                self.fail("element is not closed")
            if self.s[self.p] == "<":
                self.element()
            elif self.opt("{"):
                if self.pk() != "}":
                    self.argument()
                self.need("}")
            else:
                self.p += 1
        self.p += 2
        if self.pk() != ">":
            self.tag()
        self.need(">")
        self.d = d

    def tag(self) -> None:
        self.key()
        while self.pk() in ".-:":
            self.p += 1
            self.key()

    # functions and classes

    def function(self, named: bool) -> None:
        self.need(K("function"))
        self.opt("*")
        if self.pk() in self.NAMES:
            self.p += 1
        elif named:
            self.fail("expected a function name")
        d, self.d = self.d, 0
        self.signature()
        self.block()
        self.d = d

    def decorators(self) -> None:
        while self.s[self.p] == "@":
            self.p += 1
            if self.opt("("):
                self.listed(")", self.expr)
            else:
                self.name()
                while self.opt("."):
                    self.member()
            if self.pk() == "(":
                self.p += 1
                self.listed(")", self.argument)
            self.nls()

    def class_(self, start: int, named: bool) -> None:
        self.need(K("class"))
        if self.pk() in self.NAMES and self.pk() != K("implements"):
            self.p += 1
        elif named:
            self.fail("expected a class name")
        self.heritage()
        self.nls()
        self.opens(start, "body_class")

    def heritage(self) -> None:
        if self.opt(K("extends")):
            self.primary()
            while self.pk() == ".":
                self.p += 1
                self.member()
            if self.pk() == "(":
                self.p += 1
                self.listed(")", self.argument)

    def body_class(self) -> None:
        self.block("class")

    def body_function(self) -> None:
        self.block()

    MODIFIERS = kinds_of("static async get set")

    def class_member(self, start: int) -> None:
        s = self.s
        self.decorators()
        if s[self.p] == K("static") and s[self.p + 1] == "{":
            self.p += 1
            self.block()
            return
        while s[self.p] in self.MODIFIERS and s[self.p + 1] not in "(=;:\n}?!<":
            self.p += 1
        self.opt("*")
        self.member_name()
        t = s[self.p]
        if t == "(" or (t == "<" and self.TS):
            self.signature()
            if self.TS and s[self.p] in ";\n}":
                self.end()
                return
            self.nls()
            self.opens(start, "body_function")
            return
        self.field()
        self.end()

    def member_name(self) -> None:
        self.key()

    def field(self) -> None:
        if self.opt("="):
            self.expr(1)

    # statements

    def variables(self) -> None:
        while True:
            self.binding()
            self.annotation()
            if self.opt("="):
                self.expr(1)
            if not self.opt(","):
                return

    def annotation(self) -> None:
        pass

    def condition(self) -> None:
        self.need("(")
        self.d += 1
        self.comma()
        self.d -= 1
        self.need(")")

    def sub(self) -> None:
        self.nls()
        t = self.s[self.p]
        if t == "{":
            self.block()
        elif t in ("}", END):
            self.fail("missing statement")
        elif t == ";":
            self.p += 1
        else:
            self.deeper()
            self.statement("block")
            self.nested -= 1

    def after(self, word: str) -> bool:
        """Whether a keyword comes next, maybe on a later line; if so, read it."""
        q = self.p
        while self.s[q] == "\n":
            q += 1
        if self.s[q] == K(word):
            self.p = q + 1
            return True
        return False

    def body(self) -> None:
        self.sub()

    def body_if(self) -> None:
        self.sub()
        if self.after("else"):
            self.sub()

    def body_do(self) -> None:
        self.sub()
        if not self.after("while"):
            self.fail("expected while")
        self.condition()
        self.opt(";")

    def body_try(self) -> None:
        self.block()
        n = 0
        if self.after("catch"):
            if self.opt("("):
                self.binding()
                self.annotation()
                self.need(")")
            self.block()
            n += 1
        if self.after("finally"):
            self.block()
            n += 1
        if not n:
            self.fail("try without catch")

    def body_switch(self) -> None:
        self.block("switch")

    def for_head(self) -> None:
        self.need("(")
        self.d += 1
        t = self.pk()
        declared = t in kinds_of("var let const") and self.s[self.p + 1] not in "=.;"
        if declared:
            self.p += 1
            self.binding()
            self.annotation()
            if self.pk() in kinds_of("of in"):
                self.p += 1
                self.expr()
                self.d -= 1
                self.need(")")
                return
            if self.opt("="):
                self.expr(1)
            if self.opt(","):
                self.variables()
        elif t != ";":
            if self.attempt(self.each_target):
                self.expr()
                self.d -= 1
                self.need(")")
                return
            self.comma()
        self.need(";")
        if self.pk() != ";":
            self.comma()
        self.need(";")
        if self.pk() != ")":
            self.comma()
        self.d -= 1
        self.need(")")

    def each_target(self) -> None:
        self.unary()
        if self.pk() not in kinds_of("of in"):
            self.fail()
        self.p += 1

    def statement(self, context: str) -> None:
        start, t, s = self.p, self.s[self.p], self.s
        if context == "class":
            self.class_member(start)
            return
        if context == "switch" and (t == K("case") or (t == K("default") and s[self.p + 1] == ":")):
            self.p += 1
            if t == K("case"):
                self.comma()
            self.need(":")
            return
        if t == "{":
            self.block()
        elif t in kinds_of("var const") or (t == K("let") and (s[self.p + 1] in self.NAMES or s[self.p + 1] in "[{")):
            self.p += 1
            if t == K("const") and self.TS and s[self.p] == K("enum"):
                self.statement(context)
                return
            self.variables()
            self.end()
        elif t == K("function") or (t == K("async") and s[self.p + 1] == K("function")):
            self.opt(K("async"))
            self.declared_function(start)
        elif t == K("class") or t == "@":
            self.decorators()
            if s[self.p] in kinds_of("export abstract"):
                self.statement(context)
                return
            self.class_(start, True)
        elif t == K("if"):
            self.p += 1
            self.condition()
            self.opens(start, "body_if")
        elif t == K("for"):
            self.p += 1
            self.opt(K("await"))
            self.for_head()
            self.opens(start, "body")
        elif t == K("while"):
            self.p += 1
            self.condition()
            self.opens(start, "body")
        elif t == K("do"):
            self.p += 1
            self.opens(start, "body_do")
        elif t == K("switch"):
            self.p += 1
            self.condition()
            self.nls()
            self.opens(start, "body_switch")
        elif t == K("try"):
            self.p += 1
            self.opens(start, "body_try")
        elif t == K("return") or t == K("throw"):
            self.p += 1
            if s[self.p] not in ";\n}" + END:
                self.comma()
            elif t == K("throw"):
                self.fail("throw needs a value")
            self.end()
        elif t in kinds_of("break continue"):
            self.p += 1
            if s[self.p] in self.NAMES:
                self.p += 1
            self.end()
        elif t == K("debugger"):
            self.p += 1
            self.end()
        elif t == K("import") and s[self.p + 1] not in "(.":
            self.import_()
        elif t == K("export"):
            self.export(start, context)
        elif t in self.NAMES and s[self.p + 1] == ":":
            self.p += 2
            self.sub()
        elif not self.own_statement(start, t, context):
            self.comma()
            self.end()

    def own_statement(self, start: int, t: str, context: str) -> bool:
        return False

    def declared_function(self, start: int) -> None:
        self.need(K("function"))
        self.opt("*")
        self.name()
        self.signature()
        if self.TS and self.s[self.p] in ";\n}" + END:
            self.end()
            return
        self.nls()
        self.opens(start, "body_function")

    def import_(self) -> None:
        self.p += 1
        if self.TS and self.s[self.p] == K("type") and self.s[self.p + 1] not in "=" + K("from"):
            self.p += 1
        if self.pk() != "s":
            while True:
                if self.opt("{"):
                    self.listed("}", self.imported)
                elif self.opt("*"):
                    self.need(K("as"))
                    self.name()
                else:
                    self.name()
                if not self.opt(","):
                    break
            if self.TS and self.opt("="):
                self.expr(1)
                self.end()
                return
            self.need(K("from"))
        self.need("s")
        self.attributes()
        self.end()

    def attributes(self) -> None:
        if self.s[self.p] == "i" and self.s[self.p + 1] == "{":
            self.p += 2
            self.listed("}", self.property)

    def imported(self) -> None:
        if self.TS and self.s[self.p] == K("type") and self.s[self.p + 1] not in ",}" + K("as"):
            self.p += 1
        self.key()
        if self.opt(K("as")):
            self.key()

    def export(self, start: int, context: str) -> None:
        s = self.s
        self.p += 1
        if self.TS and s[self.p] == K("type") and s[self.p + 1] in "{*":
            self.p += 1
        t = s[self.p]
        if t == K("default"):
            self.p += 1
            t = s[self.p]
            if t == K("function") or (t == K("async") and s[self.p + 1] == K("function")):
                self.opt(K("async"))
                self.function(False)
            elif t == K("class") or t == "@" or (self.TS and t in kinds_of("abstract interface")):
                self.decorators()
                if s[self.p] in kinds_of("abstract interface"):
                    self.statement(context)
                else:
                    self.class_(start, False)
            else:
                self.expr(1)
                self.end()
        elif t == "{" or t == "*":
            self.p += 1
            if t == "*":
                if self.opt(K("as")):
                    self.key()
                self.need(K("from"))
                self.need("s")
            else:
                self.listed("}", self.imported)
                if self.opt(K("from")):
                    self.need("s")
            self.attributes()
            self.end()
        elif self.TS and t == "=":
            self.p += 1
            self.expr(1)
            self.end()
        elif t in kinds_of("var let const function class async") or t == "@" or (self.TS and t in self.NAMES):
            self.statement(context)
            if self.head and self.head[2] == start + 1:
                self.head = (self.head[0], self.head[1], start)
        else:
            self.fail("nothing to export")


class TypeScript(Script):
    TS = True
    NAMES = frozenset("i") | kinds_of(_SOFT_TS)
    BINARY = Script.BINARY | {K("as"): 10, K("satisfies"): 10}
    MODIFIERS = kinds_of("static async get set public private protected readonly abstract override declare accessor")

    def infix(self, t: str) -> bool:
        if t == K("as") or t == K("satisfies"):
            if not self.opt(K("const")):
                self.type_()
            return True
        if t == ">":
            while self.s[self.p] in ">=":
                self.p += 1
        return False

    def post(self, t: str) -> bool:
        if t == "!" and self.s[self.p + 1] not in "=":
            self.p += 1
            return True
        if t == "<" and self.attempt(self.call_types):
            return True
        return super().post(t)

    def call_types(self) -> None:
        self.type_arguments()
        if self.pk() not in "(t":
            self.fail()

    def arrow_at(self, at: int) -> bool:
        if super().arrow_at(at):
            return True
        end = self.closing(at)
        if end < 0 or self.s[end + 1] != ":":
            return False
        here = self.p, self.d
        self.p = end + 2
        try:
            self.type_()
            return self.pk() == O("=>")
        except Fail:
            return False
        finally:
            self.p, self.d = here

    def arrow(self) -> None:
        self.need("(")
        self.listed(")", self.parameter)
        if self.opt(":"):
            self.type_()
        self.arrow_body()

    def generic_arrow(self) -> None:
        self.type_parameters()
        self.arrow()

    def type_arguments(self) -> None:
        if self.opt("<"):
            self.d += 1
            while self.pk() != ">":
                self.type_()
                if not self.opt(","):
                    break
            self.d -= 1
            self.need(">")

    def type_parameters(self) -> None:
        if self.opt("<"):
            self.d += 1
            while self.pk() != ">":
                while self.pk() in kinds_of("const in") and self.s[self.p + 1] in self.NAMES:
                    self.p += 1
                self.name()
                if self.opt(K("extends")):
                    self.type_()
                if self.opt("="):
                    self.type_()
                if not self.opt(","):
                    break
            self.d -= 1
            self.need(">")

    def signature(self) -> None:
        self.type_parameters()
        self.need("(")
        self.listed(")", self.parameter)
        if self.opt(":"):
            self.type_()

    def parameter(self) -> None:
        self.decorators()
        while self.pk() in kinds_of("public private protected readonly override") and self.s[self.p + 1] not in ",):?=":
            self.p += 1
        self.opt(O("..."))
        if self.pk() == K("this"):
            self.p += 1
        else:
            self.binding()
        self.opt("?")
        self.annotation()
        if self.opt("="):
            self.expr(1)

    def annotation(self) -> None:
        if self.pk() == "!" and self.s[self.p + 1] == ":":
            self.p += 1
        if self.opt(":"):
            self.type_()

    def member_name(self) -> None:
        if self.s[self.p] == "[" and self.s[self.p + 1] in self.NAMES and self.s[self.p + 2] == ":":
            self.p += 1
            self.name()
            self.annotation()
            self.need("]")
        else:
            self.key()
        self.opt("?") or self.opt("!")

    def field(self) -> None:
        self.annotation()
        if self.opt("="):
            self.expr(1)

    def heritage(self) -> None:
        self.type_parameters()
        super().heritage()
        self.type_arguments()
        if self.opt(K("implements")):
            self.type_()
            while self.opt(","):
                self.type_()

    def type_(self) -> None:
        self.deeper()
        self.opt("|") or self.opt("&")
        self.type_part()
        while self.pk() in "|&":
            self.p += 1
            self.type_part()
        if self.s[self.p] == K("extends"):
            self.p += 1
            self.type_()
            self.need("?")
            self.type_()
            self.need(":")
            self.type_()
        self.nested -= 1

    def type_part(self) -> None:
        s = self.s
        t = self.pk()
        while t in kinds_of("keyof typeof readonly unique infer asserts abstract") and s[self.p + 1] not in ",;)>=|&\n[]}":
            self.p += 1
            t = self.pk()
        if t in self.NAMES or t in kinds_of("this null void true false"):
            self.p += 1
            if s[self.p] == K("is"):
                self.p += 1
                self.type_()
                return
            while self.opt("."):
                self.member()
            self.type_arguments()
        elif t in "0st":
            self.p += 1
        elif t == "-" and s[self.p + 1] == "0":
            self.p += 2
        elif t == "(" or t == "<" or t == K("new"):
            self.opt(K("new"))
            self.type_parameters()
            end = self.closing(self.p)
            self.need("(")
            if end > 0 and s[end + 1] == O("=>"):
                self.listed(")", self.parameter)
                self.p += 1
                self.type_()
                return
            self.d += 1
            self.type_()
            self.d -= 1
            self.need(")")
        elif t == "[":
            self.p += 1
            self.listed("]", self.tuple_item)
        elif t == "{":
            self.type_body()
        elif t == K("import"):
            self.p += 1
            self.need("(")
            self.need("s")
            self.need(")")
            while self.opt("."):
                self.member()
            self.type_arguments()
        else:
            self.fail("expected a type")
        while s[self.p] == "[":
            self.p += 1
            if self.pk() != "]":
                self.type_()
            self.need("]")

    def tuple_item(self) -> None:
        self.opt(O("..."))
        if self.s[self.p] in self.NAMES and self.s[self.p + 1] in ":?":
            self.p += 1
            self.opt("?")
            self.need(":")
        self.type_()
        self.opt("?")

    def type_body(self) -> None:
        self.need("{")
        d, self.d = self.d, 0
        while True:
            while self.s[self.p] in "\n;,":
                self.p += 1
            if self.s[self.p] == "}":
                break
            self.type_member()
            if self.s[self.p] not in "\n;,}":
                self.fail("expected the end of a member")
        self.p += 1
        self.d = d

    def type_member(self) -> None:
        s = self.s
        while s[self.p] in kinds_of("readonly get set") and s[self.p + 1] not in "(:?;,\n}<":
            self.p += 1
        self.opt("+") or self.opt("-")
        self.opt(K("readonly")) if s[self.p + 1] == "[" else None
        self.opt(K("new"))
        if s[self.p] == "[":
            if s[self.p + 1] in self.NAMES and s[self.p + 2] in (":", K("in")):
                self.p += 3
                self.type_()
                if self.opt(K("as")):
                    self.type_()
                self.need("]")
            else:
                self.key()
            self.opt("+") or self.opt("-")
            self.opt("?")
        elif s[self.p] not in "(<":
            self.key()
            self.opt("?")
        if s[self.p] in "(<":
            self.signature()
        else:
            self.annotation()

    def own_statement(self, start: int, t: str, context: str) -> bool:
        s = self.s
        if t == K("declare") and (s[self.p + 1] in self.NAMES or s[self.p + 1] in kinds_of("var const function class enum")):
            self.p += 1
            if s[self.p] == K("global") and s[self.p + 1] == "{":
                self.p += 1
                self.block("top")
            else:
                self.statement(context)
        elif t == K("abstract") and s[self.p + 1] == K("class"):
            self.p += 1
            self.class_(start, True)
        elif t == K("interface") and s[self.p + 1] in self.NAMES:
            self.p += 2
            self.type_parameters()
            if self.opt(K("extends")):
                self.type_()
                while self.opt(","):
                    self.type_()
            self.nls()
            self.type_body()
        elif t == K("type") and s[self.p + 1] in self.NAMES:
            self.p += 2
            self.type_parameters()
            self.need("=")
            self.type_()
            self.end()
        elif t == K("enum"):
            self.p += 1
            self.name()
            self.need("{")
            self.listed("}", self.enumerator)
        elif t in kinds_of("namespace module") and s[self.p + 1] in "i" + "s":
            self.p += 2
            while self.opt("."):
                self.name()
            self.block("top")
        else:
            return False
        return True

    def enumerator(self) -> None:
        self.key()
        if self.opt("="):
            self.expr(1)

