"""Kotlin: expressions that are statements, trailing lambdas, types after names."""

from __future__ import annotations

from codeloom.llm.syntax.base import CHARACTER, K, LINE_COMMENT, NAME, NESTED_COMMENT, NUMBER, O, Lexer, kinds_of, ops_of
from codeloom.llm.syntax.lines import Lines, fold_before

_HARD = "as break class continue do else false for fun if in interface is null object package return super this throw true try typealias typeof val var when while"
_SOFT = (
    "by catch constructor finally get import init set where public private protected internal open final abstract sealed override enum annotation "
    "data inner value companion lateinit const inline noinline crossinline tailrec operator infix external suspend expect actual vararg reified out"
)
_OPS = "... ..< .. ?: ?. !! :: -> ++ -- && || == != === !== <= >= += -= *= /= %= as?"
_HOLE = r"\$\{(?:[^{}\"]|\"(?:[^\"\\\n]|\\[\s\S])*\"|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
_TEXT = r'"""(?:' + _HOLE + r'|[^"$]|\$(?!\{)|"(?!""))*"{3,5}'
_STRING = r'"(?:[^"\\\n$]|\\[^\n]|\$(?!\{)|' + _HOLE + r')*"'


def _token(token: str) -> str | None:
    if token[0] == "\n":
        return "\n"
    if token.startswith("//") or (token.startswith("/*") and len(token) > 3) or token.startswith("#!"):
        return ""
    if token[0] == "`" and len(token) > 1:
        return "i"
    return None


KOTLIN_LEXER = Lexer(
    [r"\n\s*", r"\A#![^\n]*", LINE_COMMENT, NESTED_COMMENT, r"as\?", _TEXT, NAME, r"`[^`\n]+`", NUMBER, _STRING, CHARACTER],
    _HARD + " " + _SOFT, _OPS, "()[]{};,:?.!+-*/%<>=@&$", _token,
)

fold = fold_before({".", "{", O("?."), O("?:"), O("&&"), O("||")})

_MODIFIERS = kinds_of(
    "public private protected internal open final abstract sealed override enum annotation data inner value companion lateinit const inline noinline "
    "crossinline tailrec operator infix external suspend expect actual vararg reified"
)
_DECLARES = kinds_of("class interface object fun val var typealias constructor")
_JUMPS = kinds_of("return throw break continue")
_STARTS = frozenset("i0s([{-+!@") | kinds_of(_SOFT) | kinds_of("if when try object fun this super null true false return throw break continue") | ops_of("++ -- ::")


class Kotlin(Lines):
    NAMES = frozenset("i") | kinds_of(_SOFT)
    PREFIX = ops_of("+ - ! ++ -- !!")
    BINARY = {
        O(op): i
        for i, row in enumerate(["= += -= *= /= %=", "||", "&&", "== != === !==", "< > <= >=", "", "?:", "", ".. ..<", "+ -", "* / %"], 1)
        for op in row.split()
    } | {K("in"): 6, K("is"): 6, K("as"): 12, O("as?"): 12}

    # -- types

    def type_(self) -> None:
        while self.pk() == "@" or (self.pk() == K("suspend") and self.s[self.p + 1] in self.NAMES | frozenset("(")):
            self.annotation() if self.pk() == "@" else self.need(K("suspend"))
        if self.opt("("):
            self.closed(")", self.type_parameter_or_type)
            while self.opt("?"):
                pass
            if self.opt("."):
                self.need("(")
                self.closed(")", self.type_parameter_or_type)
            if self.opt(O("->")):
                self.type_()
            return
        self.name()
        while True:
            if self.pk() == "<":
                self.type_arguments()
            while self.pk() in "?" + O("?.") + O("!!"):
                after = self.pk() == O("?.")
                self.p += 1
                if after:
                    self.name()
            if self.s[self.p] == "." and self.s[self.p + 1] in self.NAMES:
                self.p += 2
            elif self.s[self.p] == "." and self.s[self.p + 1] == "(":
                self.p += 2
                self.closed(")", self.type_parameter_or_type)
                self.need(O("->"))
                self.type_()
                return
            else:
                break
        if self.s[self.p] == "&":
            self.p += 1
            self.type_()

    def type_parameter_or_type(self) -> None:
        if self.pk() in self.NAMES and self.s[self.p + 1] == ":":
            self.p += 2
        self.type_()

    def type_arguments(self) -> None:
        self.need("<")
        self.d += 1
        while True:
            if not self.opt("*"):
                if self.pk() in (K("in"), K("out")):
                    self.p += 1
                self.type_()
            if not self.opt(",") or self.pk() == ">":
                break
        self.need(">")
        self.d -= 1

    def type_parameters(self) -> None:
        self.need("<")
        self.d += 1
        while True:
            while self.pk() == K("reified") or self.pk() in (K("in"), K("out")):
                self.p += 1
            self.name()
            if self.opt(":"):
                self.type_()
            if not self.opt(",") or self.pk() == ">":
                break
        self.need(">")
        self.d -= 1

    def where(self) -> None:
        if self.skip_to(K("where")):
            self.p += 1
            while True:
                self.name()
                self.need(":")
                self.type_()
                if not self.opt(","):
                    return
                self.nls()

    # -- expressions

    def infix(self, t: str) -> bool:
        if t in (K("is"), K("as"), O("as?")):
            self.type_()
            return True
        return False

    def tail(self, t: str) -> bool:
        """A call of an infix function, or a negated ``in`` and ``is``."""
        if t == "!" and self.s[self.p + 1] in (K("in"), K("is")):
            self.p += 1
            is_type = self.s[self.p] == K("is")
            self.p += 1
            self.type_() if is_type else self.expr(7)
            return True
        if t in self.NAMES and t != K("where") and self.s[self.p + 1] in _STARTS:
            self.p += 1
            self.expr(9)
            return True
        return False

    def primary(self) -> None:
        t = self.pk()
        if t in "0s" or t in kinds_of("null true false"):
            self.p += 1
        elif t == K("suspend") and self.s[self.p + 1] == "{":
            self.p += 1
        elif t in self.NAMES:
            self.p += 1
            if self.s[self.p] == "@" and self.s[self.p + 1] in "{" + K("for") + K("while") + K("do"):
                self.p += 1
                self.primary() if self.s[self.p] == "{" else self.loop()
        elif t == "(":
            self.p += 1
            self.d += 1
            self.expr()
            self.need(")")
            self.d -= 1
        elif t == "{":
            self.lambda_()
        elif t == "[":
            self.p += 1
            self.closed("]", self.expr)
        elif t == K("if"):
            self.p += 1
            self.condition()
            self.body()
            if self.otherwise():
                self.body()
        elif t == K("when"):
            self.when()
        elif t == K("try"):
            self.try_()
        elif t in _JUMPS:
            self.p += 1
            if self.s[self.p] == "@":
                self.p += 1
                self.name()
            if t == K("throw") or (t == K("return") and self.s[self.p] in _STARTS):
                self.expr(2)
        elif t in (K("this"), K("super")):
            self.p += 1
            if self.s[self.p] == "<":
                self.type_arguments()
            if self.s[self.p] == "@":
                self.p += 1
                self.name()
        elif t == K("object"):
            self.p += 1
            if self.opt(":"):
                self.supertypes()
            self.braces("class")
        elif t == K("fun"):
            self.p += 1
            if self.pk() != "(":
                self.receiver()
            self.function_rest()
        elif t == O("::"):
            self.p += 1
            if not self.opt(K("class")):
                self.name()
        elif t == "@":
            self.annotation()
            self.primary()
        else:
            self.fail()

    def otherwise(self) -> bool:
        p = self.p
        while self.s[p] in "\n;":
            p += 1
        if self.s[p] == K("else") and self.s[p + 1] != O("->"):
            self.p = p + 1
            return True
        return False

    def postfix(self) -> None:
        while True:
            t = self.pk()
            if t == "(":
                if self.s[self.p - 1] == "\n":
                    return
                self.p += 1
                self.closed(")", self.argument)
            elif t == "[":
                if self.s[self.p - 1] == "\n":
                    return
                self.p += 1
                self.closed("]", self.expr)
            elif t == "." or t == O("?."):
                self.p += 1
                self.nls()
                if self.pk() in self.NAMES or self.pk() == K("class"):
                    self.p += 1
                elif self.pk() == "(":
                    continue
                else:
                    self.fail(f"expected a member name, found {self.shown()}")
            elif t == O("::"):
                self.p += 1
                if not self.opt(K("class")):
                    self.name()
            elif t in (O("!!"), O("++"), O("--")):
                self.p += 1
            elif t == "?" and self.s[self.p + 1] == O("::"):
                self.p += 1
            elif t == "<" and self.attempt(self.call_types):
                pass
            elif t == "{" and self.lambdas:
                self.lambda_()
            elif t in self.NAMES and self.s[self.p + 1] == "@" and self.s[self.p + 2] == "{" and self.s[self.p - 1] == ")":
                self.p += 2
                self.lambda_()
            else:
                return

    lambdas = True

    def call_types(self) -> None:
        self.type_arguments()
        if self.s[self.p] not in "({." + O("::") + O("?."):
            self.fail()

    def argument(self) -> None:
        if self.pk() in self.NAMES and self.s[self.p + 1] == "=":
            self.p += 2
        self.opt("*")
        self.expr()

    def lambda_(self) -> None:
        self.braces("block", lambda: self.attempt(self.lambda_parameters))

    def lambda_parameters(self) -> None:
        self.nls()
        while self.pk() != O("->"):
            if self.opt("("):
                self.closed(")", self.lambda_parameter)
            else:
                self.lambda_parameter()
            self.nls()
            if not self.opt(","):
                break
            self.nls()
        self.need(O("->"))

    def lambda_parameter(self) -> None:
        self.name()
        if self.opt(":"):
            self.type_()

    def condition(self) -> None:
        self.need("(")
        self.d += 1
        self.expr()
        self.need(")")
        self.d -= 1

    def body(self) -> None:
        """One statement or a block, as a branch or the body of a loop."""
        d, self.d = self.d, 0
        if self.skip_to("{"):
            self.braces("block")
        elif self.s[self.p] != ";":
            self.nls()
            self.loop() if self.pk() in kinds_of("for while do") else self.expr()
        self.d = d

    def when(self) -> None:
        self.p += 1
        if self.opt("("):
            self.d += 1
            if self.opt(K("val")):
                self.name()
                if self.opt(":"):
                    self.type_()
                self.need("=")
            self.expr()
            self.need(")")
            self.d -= 1
        d, self.d = self.d, 0
        self.nls()
        self.need("{")
        while True:
            while self.s[self.p] in "\n;":
                self.p += 1
            if self.opt("}"):
                break
            if not self.opt(K("else")):
                while True:
                    self.nls()
                    if self.pk() == "!" and self.s[self.p + 1] in (K("in"), K("is")):
                        self.p += 1
                    if self.opt(K("is")):
                        self.type_()
                    else:
                        self.opt(K("in"))
                        self.expr()
                    self.nls()
                    if not self.opt(",") or self.skip_to(O("->")):
                        break
            if self.opt(K("if")):
                self.expr()
            self.need(O("->"))
            self.body()
            if self.s[self.p] not in "\n;}":
                self.fail(f"expected end of a branch, found {self.shown()}")
        self.d = d

    def try_(self) -> None:
        self.p += 1
        self.braces("block")
        n = 0
        while self.skip_to(K("catch")):
            self.p += 1
            self.need("(")
            self.closed(")", self.parameter)
            self.braces("block")
            n += 1
        if self.skip_to(K("finally")):
            self.p += 1
            self.braces("block")
            n += 1
        if not n:
            self.fail("try without catch or finally")

    # -- statements

    def loop(self) -> None:
        t = self.pk()
        self.p += 1
        if t == K("for"):
            self.need("(")
            self.d += 1
            while self.pk() == "@":
                self.annotation()
            self.pattern()
            self.need(K("in"))
            self.expr()
            self.need(")")
            self.d -= 1
            self.body()
        elif t == K("while"):
            self.condition()
            self.body()
        else:
            self.braces("block")
            self.nls()
            self.need(K("while"))
            self.condition()

    def pattern(self) -> None:
        if self.opt("("):
            self.closed(")", self.lambda_parameter)
        else:
            self.lambda_parameter()

    def annotation(self) -> None:
        self.need("@")
        if self.pk() in self.NAMES and self.s[self.p + 1] == ":":
            self.p += 2
        if self.opt("["):
            while self.pk() != "]":
                self.annotation_name()
            self.p += 1
        else:
            self.annotation_name()

    def annotation_name(self) -> None:
        self.type_name()
        if self.s[self.p] == "(":
            self.p += 1
            self.closed(")", self.argument)

    def type_name(self) -> None:
        self.name()
        while self.s[self.p] == "." and self.s[self.p + 1] in self.NAMES:
            self.p += 2
        if self.s[self.p] == "<":
            self.type_arguments()

    def statement(self, context: str) -> None:
        while self.pk() == "@":
            self.annotation()
            self.nls()
        enum = False
        while self.pk() in _MODIFIERS:
            q = self.p + 1
            while self.s[q] == "\n":
                q += 1
            if self.s[q] not in _MODIFIERS | _DECLARES and self.s[q] != "@" and self.s[q] not in kinds_of("get set init"):
                break
            enum = enum or self.pk() == K("enum")
            self.p = q
            while self.pk() == "@":
                self.annotation()
                self.nls()
        t = self.pk()
        after = self.s[self.p + 1]
        if t == K("package"):
            self.p += 1
            self.dotted()
        elif t == K("import") and after in self.NAMES:
            self.p += 1
            self.dotted()
            if self.opt(K("as")):
                self.name()
        elif t == K("class") or t == K("interface") or (t == K("object") and after in self.NAMES | frozenset("{:\n")):
            self.class_(t, enum)
        elif t == K("fun") and after == K("interface"):
            self.p += 1
            self.class_(K("interface"), False)
        elif t == K("fun") and after != "(":
            self.p += 1
            if self.pk() == "<":
                self.type_parameters()
            self.receiver(required=True)
            self.function_rest()
        elif t in (K("val"), K("var")):
            self.variable()
        elif t == K("typealias"):
            self.p += 1
            self.name()
            if self.pk() == "<":
                self.type_parameters()
            self.need("=")
            self.type_()
        elif context == "class" and t == K("constructor"):
            self.p += 1
            self.need("(")
            self.closed(")", self.parameter)
            if self.opt(":"):
                if self.pk() not in (K("this"), K("super")):
                    self.fail(f"expected this or super, found {self.shown()}")
                self.p += 1
                self.need("(")
                self.closed(")", self.argument)
            if self.skip_to("{"):
                self.braces("block")
        elif context == "class" and t == K("init"):
            self.p += 1
            self.braces("block")
        elif t in (K("get"), K("set")) and (after in "\n;" or (after == "(" and self.s[self.p + 2] in self.NAMES | frozenset(")"))):
            self.accessor()
        elif t in kinds_of("for while do"):
            self.loop()
        elif t in self.NAMES and after == "@" and self.s[self.p + 2] in kinds_of("for while do"):
            self.p += 2
            self.loop()
        elif context == "class":
            self.fail(f"expected a member, found {self.shown()}")
        else:
            self.expr()
        self.end()

    def accessor(self) -> None:
        self.p += 1
        if self.s[self.p] in "\n;":
            return
        self.need("(")
        self.closed(")", self.lambda_parameter)
        if self.opt(":"):
            self.type_()
        if self.opt("="):
            self.nls()
            self.expr()
        elif self.pk() == "{":
            self.braces("block")

    def dotted(self) -> None:
        self.name()
        while self.opt("."):
            if self.opt("*"):
                return
            self.name()

    def class_(self, t: str, enum: bool) -> None:
        self.p += 1
        if t == K("object"):
            if self.pk() in self.NAMES:
                self.p += 1
        else:
            self.name()
        if self.pk() == "<":
            self.type_parameters()
        while self.pk() == "@" or self.pk() in _MODIFIERS:
            self.annotation() if self.pk() == "@" else self.name()
        self.opt(K("constructor"))
        if self.opt("("):
            self.closed(")", self.parameter)
        if self.skip_to(":"):
            self.p += 1
            self.supertypes()
        self.where()
        if self.skip_to("{"):
            self.braces("class", self.entries if enum else None)

    def supertypes(self) -> None:
        while True:
            self.nls()
            while self.pk() == "@":
                self.annotation()
            self.type_()
            if self.s[self.p] == "(":
                self.p += 1
                self.closed(")", self.argument)
            elif self.opt(K("by")):
                keep, self.lambdas = self.lambdas, False
                self.expr()
                self.lambdas = keep
            if not self.opt(","):
                return

    def entries(self) -> None:
        self.nls()
        while self.pk() in self.NAMES or self.pk() == "@":
            while self.pk() == "@":
                self.annotation()
                self.nls()
            self.name()
            if self.opt("("):
                self.closed(")", self.argument)
            if self.pk() == "{":
                self.braces("class")
            self.nls()
            if not self.opt(","):
                break
            self.nls()
        self.nls()
        if self.pk() not in ";}":
            self.fail(f"expected , or ; after an entry, found {self.shown()}")

    def parameter(self) -> None:
        while self.pk() == "@":
            self.annotation()
        while self.pk() in _MODIFIERS and self.s[self.p + 1] not in ":":
            self.p += 1
        if self.pk() in (K("val"), K("var")):
            self.p += 1
        self.name()
        self.need(":")
        self.type_()
        if self.opt("="):
            self.expr()

    def receiver(self, required: bool = False) -> None:
        """``Type.name`` before the parameters of a function."""
        if self.opt("("):
            self.type_()
            self.need(")")
            self.need(".")
        while True:
            self.name()
            if self.pk() == "<":
                self.type_arguments()
            while self.opt("?"):
                pass
            if self.pk() not in "." + O("?."):
                return
            self.p += 1
            if not required and self.pk() == "(":
                return

    def function_rest(self) -> None:
        self.need("(")
        self.closed(")", self.parameter)
        if self.skip_to(":"):
            self.p += 1
            self.type_()
        self.where()
        if self.skip_to("="):
            self.p += 1
            self.nls()
            self.expr()
        elif self.skip_to("{"):
            self.braces("block")

    def variable(self) -> None:
        self.p += 1
        if self.pk() == "<":
            self.type_parameters()
        if self.pk() == "(" and self.attempt(self.pattern):
            pass
        else:
            self.receiver(required=True)
        if self.opt(":"):
            self.type_()
        self.where()
        if self.skip_to("="):
            self.p += 1
            self.nls()
            self.expr(2)
        elif self.skip_to(K("by")):
            self.p += 1
            self.nls()
            self.expr(2)
