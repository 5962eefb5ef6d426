"""Swift: line ends that end statements, trailing closures, patterns, types after names."""

from __future__ import annotations

from codeloom.llm.syntax.base import K, LINE_COMMENT, NAME, NESTED_COMMENT, NUMBER, O, Lexer, kinds_of, ops_of
from codeloom.llm.syntax.lines import Lines, fold_before

_HARD = (
    "associatedtype class deinit enum extension fileprivate func import init inout internal let operator private precedencegroup protocol public "
    "rethrows static struct subscript typealias var break case catch continue default defer do else fallthrough for guard if in repeat return throw "
    "switch where while as false is nil self Self super throws true try"
)
_SOFT = (
    "actor any async await some open final override mutating nonmutating lazy weak unowned optional required convenience dynamic indirect prefix "
    "infix postfix nonisolated isolated get set willSet didSet consuming borrowing"
)
_OPS = "... ..< -> && || ?? == != === !== <= >= += -= *= /= %= &= |= ^= << >> <<= >>= &+ &- &* ~= as? as! try? try!"
_HOLE = r"\\\((?:[^()\"\n]|\"(?:[^\"\\\n]|\\.)*\"|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\)"
_TEXT = r'"""[ \t]*\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""'
_STRING = r'"(?:[^"\\\n]|' + _HOLE + r'|\\[^\n(])*"(?!")|""(?!")'
_RAW = r'#"(?:[^"\n]|"(?!#))*"#'


def _token(token: str) -> str | None:
    if token[0] == "\n":
        return "\n"
    if token.startswith("//") or (token.startswith("/*") and len(token) > 3) or token.startswith("#!"):
        return ""
    if token[0] == "#":
        return "s" if token[1:2] == '"' else "i" if token[1:2] in tuple("sackfld") and not token.startswith(("#if", "#else", "#end", "#error", "#warn", "#sourceL")) else ""
    if token[0] == "@" and len(token) > 1:
        return ""
    if token[0] in "`$" and len(token) > 1:
        return "i"
    if token[0] == "?":
        return "?" if token[1:2].isspace() else O("?.") if len(token) == 1 else None
    return None


SWIFT_LEXER = Lexer(
    [
        r"\n\s*", r"\A#![^\n]*", LINE_COMMENT, NESTED_COMMENT, r"#(?:if|elseif|else|endif|error|warning|sourceLocation)\b[^\n]*", r"#[a-z]\w*", _RAW,
        r"@(?:escaping|autoclosure|Sendable|MainActor|unchecked|retroactive)\b(?!\()", r"as[?!]|try[?!]", r"\?\?=?", r"\?[ \t]+", _TEXT, NAME, r"`\w+`|\$\w+", NUMBER, _STRING,
    ],
    _HARD + " " + _SOFT, _OPS, "()[]{};,:?.!+-*/%<>=@&|^~\\", _token,
)

fold = fold_before({".", "{", "?", ":", O("?."), O("&&"), O("||"), O("??"), K("else"), K("catch"), K("where")})

_MODIFIERS = kinds_of(
    "fileprivate internal private public static open final override mutating nonmutating lazy weak unowned optional required convenience dynamic "
    "indirect prefix infix postfix nonisolated isolated consuming borrowing async"
)
_DECLARES = kinds_of("class struct enum protocol extension func var let init deinit subscript typealias associatedtype import operator precedencegroup actor case")
_STARTS = frozenset("i0s([{-+!~.&\\@") | kinds_of(_SOFT) | kinds_of("self Self super nil true false try await if switch") | ops_of("try? try! ...")


class Swift(Lines):
    NAMES = frozenset("i") | kinds_of(_SOFT)
    PREFIX = ops_of("+ - ! ~ & ... ..<")
    BINARY = {
        O(op): i
        for i, row in enumerate(["= += -= *= /= %= &= |= ^= <<= >>=", "", "||", "&&", "== != === !== < > <= >= ~=", "??", "... ..<", "+ - | ^ &+ &-", "* / % & &*", "<< >>"], 1)
        for op in row.split()
    } | {K("is"): 6, K("as"): 6, O("as?"): 6, O("as!"): 6}

    def __init__(self, kinds: str):
        super().__init__(kinds)
        self.bare = False  # in the head of a control statement a brace opens its body

    def inside(self, close: str, item) -> None:
        bare, self.bare = self.bare, False
        self.closed(close, item)
        self.bare = bare

    # -- types

    def type_(self) -> None:
        while self.pk() in "@" + K("inout") + K("some") + K("any") + K("isolated") + K("consuming") + K("borrowing"):
            self.attribute() if self.pk() == "@" else self.opt(self.pk())
        if self.opt("("):
            self.inside(")", self.tuple_type)
        elif self.opt("["):
            self.type_()
            if self.opt(":"):
                self.type_()
            self.need("]")
        elif self.opt(K("Self")):
            pass
        else:
            self.name()
        while True:
            t = self.pk()
            if t == "<":
                self.type_arguments()
            elif t in "?!" or t == O("??"):
                self.p += 1
            elif t == O("?."):
                self.p += 1
                if self.s[self.p] in self.NAMES and self.s[self.p - 1] == ".":
                    self.p += 1
            elif t == "." and self.s[self.p + 1] in self.NAMES | frozenset(K("Self")):
                self.p += 2
            else:
                break
        while self.pk() in (K("async"), K("throws"), K("rethrows")) and self.s[self.p + 1] in kinds_of("throws rethrows") | ops_of("->"):
            self.p += 1
        if self.opt(O("->")):
            self.type_()
        elif self.s[self.p] == "&" and self.s[self.p + 1] in self.NAMES:
            self.p += 1
            self.type_()

    def tuple_type(self) -> None:
        if self.pk() in self.NAMES and (self.s[self.p + 1] == ":" or (self.s[self.p + 1] in self.NAMES and self.s[self.p + 2] == ":")):
            while not self.opt(":"):
                self.p += 1
        self.type_()
        self.opt(O("..."))
        if self.opt("="):
            self.expr()

    def type_arguments(self) -> None:
        self.need("<")
        self.d += 1
        while True:
            self.type_()
            if not self.opt(","):
                break
        self.need(">")
        self.d -= 1

    def generics(self) -> None:
        if self.pk() == "<":
            self.p += 1
            self.d += 1
            while True:
                self.name()
                if self.opt(":"):
                    self.type_()
                if not self.opt(","):
                    break
            self.need(">")
            self.d -= 1

    def where(self) -> None:
        if self.opt(K("where")):
            while True:
                self.type_()
                if self.opt(O("==")) or self.opt(":"):
                    self.type_()
                else:
                    self.fail(f"expected a requirement, found {self.shown()}")
                if not self.opt(","):
                    return

    # -- expressions

    def unary(self) -> None:
        while self.pk() in (K("try"), O("try?"), O("try!"), K("await")):
            self.p += 1
        super().unary()

    def infix(self, t: str) -> bool:
        if t in (K("is"), K("as"), O("as?"), O("as!")):
            self.type_()
            return True
        if t == O("...") and self.pk() not in _STARTS:
            return True
        if t == "=":
            self.nls()
        return False

    def tail(self, t: str) -> bool:
        if t == "?":
            self.p += 1
            self.nls()
            self.expr(2)
            self.nls()
            self.need(":", " of a conditional")
            self.nls()
            self.expr(2)
            return True
        return False

    def primary(self) -> None:
        t = self.pk()
        if t in "0s" or t in kinds_of("nil true false self Self super"):
            self.p += 1
        elif t in self.NAMES:
            self.p += 1
        elif t == "(":
            self.p += 1
            self.inside(")", self.argument)
        elif t == "[":
            self.p += 1
            if self.opt(":"):
                self.need("]")
            else:
                self.inside("]", self.keyed)
        elif t == "{":
            if self.bare:
                self.fail("expected an expression")
            self.closure()
        elif t == ".":
            self.p += 1
            self.member()
        elif t == "\\":
            self.p += 1
            if self.pk() in self.NAMES:
                self.p += 1
            if self.pk() not in "." + O("?."):
                self.fail()
        elif t == K("if"):
            self.if_()
        elif t == K("switch"):
            self.switch()
        else:
            self.fail()

    def member(self) -> None:
        if self.pk() in self.NAMES or self.pk() in "0" or chr(0xE000) <= self.pk() < chr(0xE800):
            self.p += 1
        else:
            self.fail(f"expected a member name, found {self.shown()}")

    def keyed(self) -> None:
        self.expr()
        if self.opt(":"):
            self.expr()

    def argument(self) -> None:
        if self.s[self.p + 1] == ":" and (self.pk() in self.NAMES or chr(0xE000) <= self.pk() < chr(0xE800)):
            self.p += 2
        if self.pk() in self.BINARY and self.s[self.p + 1] in ",)":  # an operator as a function
            self.p += 1
            return
        if self.pk() in (K("let"), K("var")):
            self.p += 1
        self.expr()

    def postfix(self) -> None:
        while True:
            t = self.pk()
            if t == "(" and self.s[self.p - 1] != "\n":
                self.p += 1
                self.inside(")", self.argument)
            elif t == "[" and self.s[self.p - 1] != "\n":
                self.p += 1
                self.inside("]", self.argument)
            elif t == ".":
                self.p += 1
                self.member()
            elif t == O("?."):
                self.p += 1
            elif t == "!" and self.s[self.p + 1] != "=":
                self.p += 1
            elif t == "<" and self.attempt(self.call_types):
                pass
            elif t == "{" and not self.bare and self.s[self.p - 1] not in "0s":
                self.closure()
                while self.pk() in self.NAMES and self.s[self.p + 1] == ":" and self.s[self.p + 2] == "{":
                    self.p += 2
                    self.closure()
            else:
                return

    def call_types(self) -> None:
        self.type_arguments()
        if self.s[self.p] not in "({.":
            self.fail()

    def closure(self) -> None:
        bare, self.bare = self.bare, False
        self.braces("block", lambda: self.attempt(self.closure_head))
        self.bare = bare

    def closure_head(self) -> None:
        self.nls()
        while self.pk() == "@":
            self.attribute()
        if self.opt("["):
            self.closed("]", self.capture)
        if self.opt("("):
            self.closed(")", self.closure_parameter)
        elif self.pk() in self.NAMES:
            self.name()
            while self.opt(","):
                self.name()
        while self.pk() in (K("async"), K("throws")):
            self.p += 1
        if self.opt(O("->")):
            self.type_()
        self.need(K("in"))

    def capture(self) -> None:
        while self.pk() in (K("weak"), K("unowned")) and self.s[self.p + 1] != ",":
            self.p += 1
        if not self.opt(K("self")):
            self.name()
        if self.opt("="):
            self.expr()

    def closure_parameter(self) -> None:
        self.name()
        if self.pk() in self.NAMES:
            self.name()
        if self.opt(":"):
            self.type_()

    # -- statements

    def headed(self, rule) -> None:
        bare, self.bare = self.bare, True
        rule()
        self.bare = bare

    def conditions(self) -> None:
        while True:
            self.nls()
            if self.opt(K("case")):
                self.pattern()
                self.need("=")
                self.expr(2)
            elif self.pk() in (K("let"), K("var")):
                self.p += 1
                self.pattern()
                if self.opt(":"):
                    self.type_()
                if self.opt("="):
                    self.expr(2)
            else:
                self.expr(2)
            if not self.opt(","):
                return

    def pattern(self) -> None:
        if self.pk() in (K("let"), K("var")):
            self.p += 1
        if self.opt(K("is")):
            self.type_()
        else:
            self.expr(2)

    def if_(self) -> None:
        self.p += 1
        self.headed(self.conditions)
        self.braces("block")
        if self.opt(K("else")):
            if self.pk() == K("if"):
                self.if_()
            else:
                self.braces("block")

    def switch(self) -> None:
        self.p += 1
        self.headed(self.expr)
        self.braces("switch")

    def attribute(self) -> None:
        self.need("@")
        self.name()
        if self.s[self.p] == "(":
            end = self.closing(self.p)
            if end < 0:
                self.fail("missing )")
            self.p = end + 1

    def statement(self, context: str) -> None:
        self.bare = False
        while self.pk() == "@":
            self.attribute()
            self.nls()
        while self.pk() in _MODIFIERS or (self.pk() == K("class") and self.s[self.p + 1] in kinds_of("func var let subscript")):
            q = self.p + 1
            if self.s[q] == "(":
                q = self.closing(q) + 1
            while self.s[q] == "\n":
                q += 1
            if self.s[q] not in _MODIFIERS | _DECLARES and self.s[q] != "@":
                break
            self.p = q
            while self.pk() == "@":
                self.attribute()
                self.nls()
        t = self.pk()
        after = self.s[self.p + 1]
        if t == K("import"):
            self.p += 1
            if self.pk() in _DECLARES:
                self.p += 1
            self.name()
            while self.opt("."):
                self.name()
        elif t in kinds_of("class struct enum protocol extension") or (t == K("actor") and after in self.NAMES):
            self.p += 1
            self.type_() if t == K("extension") else self.name()
            self.generics()
            if self.opt(":"):
                while True:
                    self.nls()
                    if not self.opt(K("class")):
                        self.type_()
                    if not self.opt(","):
                        break
            self.where()
            self.braces("enum" if t == K("enum") else "protocol" if t == K("protocol") else "class")
        elif t == K("func"):
            self.p += 1
            if self.pk() in self.NAMES:
                self.p += 1
            else:
                while self.pk() in self.BINARY or self.pk() in "!~":
                    self.p += 1
            self.function()
        elif t in (K("var"), K("let")):
            self.p += 1
            self.variables()
        elif t == K("init") and after in "(<?!" + O("?."):
            self.p += 1
            while self.pk() in "?!" + O("?."):
                self.p += 1
            self.function()
        elif t == K("deinit"):
            self.p += 1
            self.braces("block")
        elif t == K("subscript"):
            self.p += 1
            self.function()
        elif t in (K("typealias"), K("associatedtype")):
            self.p += 1
            self.name()
            self.generics()
            if self.opt(":"):
                self.type_()
            if self.opt("="):
                self.type_()
            self.where()
        elif t in (K("operator"), K("precedencegroup")):
            while self.s[self.p] not in "{\n":
                self.p += 1
            if self.s[self.p] == "{":
                self.p = self.closing(self.p) + 1 or self.p
        elif t == K("case") and context in ("enum", "switch"):
            self.p += 1
            self.enum_case() if context == "enum" else self.switch_case()
            if context == "switch":
                return
        elif t == K("default") and context == "switch":
            self.p += 1
            self.need(":")
            return
        elif context in ("class", "enum", "protocol"):
            if t in kinds_of("get set willSet didSet"):
                self.accessor()
                return
            else:
                self.fail(f"expected a member, found {self.shown()}")
        elif t in kinds_of("get set willSet didSet") and after in "{(\n}" + K("set") + K("get") + K("async") + K("throws") and context == "accessors":
            self.accessor()
            return
        elif t == K("if"):
            self.if_()
        elif t == K("guard"):
            self.p += 1
            self.headed(self.conditions)
            self.need(K("else"))
            self.braces("block")
        elif t == K("switch"):
            self.switch()
        elif t == K("for"):
            self.p += 1
            while self.pk() in (K("try"), K("await"), K("case")):
                self.p += 1
            self.headed(self.each)
            self.braces("block")
        elif t == K("while"):
            self.p += 1
            self.headed(self.conditions)
            self.braces("block")
        elif t == K("repeat"):
            self.p += 1
            self.braces("block")
            self.nls()
            self.need(K("while"))
            self.expr()
        elif t == K("do"):
            self.p += 1
            self.braces("block")
            while self.opt(K("catch")):
                if self.pk() != "{":
                    self.headed(self.caught)
                self.braces("block")
        elif t == K("defer"):
            self.p += 1
            self.braces("block")
        elif t in (K("return"), K("throw")):
            self.p += 1
            if self.s[self.p] in _STARTS:
                self.expr()
        elif t in (K("break"), K("continue")):
            self.p += 1
            if self.s[self.p] in self.NAMES:
                self.p += 1
        elif t == K("fallthrough"):
            self.p += 1
        elif t in self.NAMES and after == ":" and self.s[self.p + 2] in kinds_of("for while repeat switch if do") | frozenset("\n"):
            self.p += 2
            self.nls()
            self.statement(context)
            return
        else:
            self.expr()
        self.end()

    def each(self) -> None:
        self.pattern()
        if self.opt(":"):
            self.type_()
        self.need(K("in"))
        self.expr()
        if self.opt(K("where")):
            self.expr()

    def caught(self) -> None:
        while True:
            self.pattern()
            if self.opt(K("where")):
                self.expr()
            if not self.opt(","):
                return

    def switch_case(self) -> None:
        while True:
            self.nls()
            self.pattern()
            if self.opt(K("where")):
                self.expr(2)
            if not self.opt(","):
                break
        self.need(":")

    def enum_case(self) -> None:
        while True:
            self.name()
            if self.opt("("):
                self.inside(")", self.tuple_type)
            if self.opt("="):
                self.expr()
            if not self.opt(","):
                return
            self.nls()

    def function(self) -> None:
        self.generics()
        self.need("(")
        self.inside(")", self.parameter)
        while self.pk() in (K("async"), K("throws"), K("rethrows")):
            self.p += 1
        if self.opt(O("->")):
            self.type_()
        self.where()
        if self.pk() == "{":
            self.braces("accessors")

    def parameter(self) -> None:
        while self.pk() == "@":
            self.attribute()
        if self.pk() in self.NAMES or chr(0xE000) <= self.pk() < chr(0xE800):
            self.p += 1
        if self.pk() in self.NAMES:
            self.p += 1
        self.need(":")
        self.type_()
        self.opt(O("..."))
        if self.opt("="):
            self.expr()

    def variables(self) -> None:
        while True:
            if self.opt("("):
                self.inside(")", self.pattern)
            else:
                self.name()
            if self.opt(":"):
                self.type_()
            if self.opt("="):
                self.nls()
                self.expr(2)
            if self.pk() == "{":
                self.braces("accessors")
            if not self.opt(","):
                return
            self.nls()

    def accessor(self) -> None:
        self.p += 1
        if self.opt("("):
            self.name()
            self.need(")")
        while self.pk() in (K("async"), K("throws")):
            self.p += 1
        if self.pk() == "{":
            self.braces("block")
