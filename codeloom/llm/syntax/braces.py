"""C, C++ and Java: statements that end with semicolons, types before names."""

from __future__ import annotations

import re

from codeloom.llm.syntax.base import (
    BLOCK_COMMENT, CHARACTER, DOUBLE, END, K, LINE_COMMENT, NAME, NUMBER, O, Lexer, Parser, kinds_of, ops_of,
)

C_OPS = "... <<= >>= -> ++ -- << >> <= >= == != && || += -= *= /= %= &= ^= |= ##"
LEVELS = [
    "= += -= *= /= %= &= ^= |= <<= >>= >>>= **= &&= ||= ??=", "??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= <=>", "<< >> >>>", "+ -", "* / %", "**",
]


def levels(rows: list[str], least: int = 1) -> dict[str, int]:
    """Binary operators by precedence; the lowest row is assignment, on level 1."""
    return {O(op): i + (least if i == 0 else least + 1) for i, row in enumerate(rows) for op in row.split()}


_C_WORDS = (
    "if else for while do switch case default break continue return goto sizeof struct union enum typedef "
    "void char short int long float double signed unsigned bool _Bool auto "
    "const static extern inline volatile register restrict"
)
_CPP_WORDS = _C_WORDS + (
    " class namespace template typename using public private protected virtual explicit friend mutable constexpr consteval constinit "
    "noexcept operator new delete this throw try catch nullptr true false static_cast dynamic_cast const_cast reinterpret_cast "
    "static_assert decltype alignas thread_local wchar_t char8_t char16_t char32_t co_await co_yield co_return typeid final override"
)
_JAVA_WORDS = (
    "if else for while do switch case default break continue return throw try catch finally synchronized assert new this super "
    "class interface enum package import extends implements throws instanceof void boolean byte char short int long float double "
    "public private protected static final abstract native transient volatile strictfp true false null var record sealed permits yield when"
)


def _plain(token: str) -> str | None:
    return "" if token.startswith(("//", "/*")) and len(token) > 1 and (token[1] == "/" or token.endswith("*/")) else None


def _c_token(token: str) -> str | None:
    if token.startswith("#"):
        return ""
    if len(token) > 2 and token[-1] == '"' and token[0] in "RLuU":
        return "s"
    if len(token) > 2 and token[-1] == "'" and token[0] in "LuU":
        return "s"
    return _plain(token)


_DIRECTIVE = r"(?m:^[ \t]*#[ \t]*(?:include|define|undef|ifn?def|if|elif(?:n?def)?|else|endif|pragma|error|warning|line|import)\b(?:[^\n\\/]|\\\n|\\|/(?!\*)|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)*)|(?m:^[ \t]*#[ \t]*$)"
_RAW = r'(?:u8|[LuU])?R"\((?:[^)]|\)(?!"))*\)"|(?:u8|[LuU])?R"\w+\([\s\S]*?\)\w+"'
_PREFIXED = r"(?:u8|[LuU])" + DOUBLE + r"|[LuU]" + CHARACTER

C_LEXER = Lexer([LINE_COMMENT, BLOCK_COMMENT, _DIRECTIVE, _PREFIXED, NAME, NUMBER, DOUBLE, CHARACTER], _C_WORDS, C_OPS, "()[]{};,:?.~!+-*/%&|^<>=", _c_token)
CPP_LEXER = Lexer(
    [LINE_COMMENT, BLOCK_COMMENT, _DIRECTIVE, _RAW, _PREFIXED, NAME, NUMBER, DOUBLE, CHARACTER],
    _CPP_WORDS, C_OPS + " :: ->* .* <=>", "()[]{};,:?.~!+-*/%&|^<>=", _c_token,
)
_TEXT = r'"""[\s\S]*?(?<!\\)"""'
JAVA_LEXER = Lexer(
    [LINE_COMMENT, BLOCK_COMMENT, _TEXT, NAME + r"|\$\w*", NUMBER, DOUBLE, CHARACTER],
    _JAVA_WORDS, "... -> :: ++ -- << >> <= >= == != && || += -= *= /= %= &= ^= |= <<= >>=", "()[]{};,:?.~!+-*/%&|^<>=@", _plain,
)

_MODIFIERS = kinds_of(
    "const static extern inline volatile register restrict virtual explicit friend mutable constexpr consteval constinit thread_local"
)
_BUILTIN = kinds_of("void char short int long float double signed unsigned bool _Bool auto wchar_t char8_t char16_t char32_t")
_TAGS = kinds_of("struct union enum class typename")


class Braces(Parser):
    """What the three languages share."""

    BINARY = levels(LEVELS)
    PREFIX = ops_of("+ - ! ~ * & ++ -- &&")
    SIMPLE = re.compile(r"[^;{}\0]*;")
    HEAD = re.compile(r"[^;{}\0]*\{")
    SYNC = re.compile(r"[^;{}\0]*")

    def semicolon(self) -> None:
        self.need(";")

    def post(self, t: str) -> bool:
        if t == O("++") or t == O("--"):
            self.p += 1
            return True
        return False

    def condition(self) -> None:
        self.need("(")
        self.listed(")", self.expr)

    # tails of statement heads

    def body_if(self) -> None:
        self.sub()
        if self.pk() == K("else"):
            self.p += 1
            self.sub()

    def body(self) -> None:
        self.sub()

    def body_do(self) -> None:
        self.sub()
        self.need(K("while"))
        self.condition()
        self.semicolon()

    def body_try(self) -> None:
        self.block()
        n = 0
        while self.pk() == K("catch"):
            self.p += 1
            self.need("(")
            self.caught()
            self.need(")")
            self.block()
            n += 1
        if self.opt(K("finally")):
            self.block()
            n += 1
        if not n:
            self.fail("try without catch")

    def body_switch(self) -> None:
        self.block("switch")

    def sub(self) -> None:
        """One statement, which may be a block."""
        if self.s[self.p] == "{":
            self.block()
        else:
            if self.s[self.p] in ("}", END):
                self.fail("missing statement")
            if self.s[self.p] == ";":
                self.p += 1
                return
            self.deeper()
            self.statement("block")
            self.nested -= 1

    def caught(self) -> None:
        raise NotImplementedError

    def flow(self, start: int, t: str) -> bool:
        """Control statements; whether ``t`` starts one."""
        if t == K("if"):
            self.p += 1
            self.opt(K("constexpr"))
            self.condition()
            self.opens(start, "body_if")
        elif t == K("while"):
            self.p += 1
            self.condition()
            self.opens(start, "body")
        elif t == K("for"):
            self.p += 1
            self.for_head()
            self.opens(start, "body")
        elif t == K("do"):
            self.p += 1
            self.opens(start, "body_do")
        elif t == K("switch"):
            self.p += 1
            self.condition()
            self.opens(start, "body_switch")
        elif t == K("return") or t == K("throw"):
            self.p += 1
            if self.pk() != ";":
                self.value()
            self.semicolon()
        elif t in (K("break"), K("continue")):
            self.p += 1
            if self.pk() in self.NAMES:
                self.p += 1
            self.semicolon()
        elif t == K("else") or t == K("catch") or t == K("finally"):
            self.fail()
        else:
            return False
        return True

    def value(self) -> None:
        self.expr()

    def for_head(self) -> None:
        raise NotImplementedError


class C(Braces):
    CPP = False

    def angle(self, p: int) -> int:
        """The index after the template arguments that start at ``p``, or -1."""
        s, depth = self.s, 0
        allowed = "i0s,*&()[].: \n"
        while True:
            c = s[p]
            if c == "<":
                depth += 1
            elif c == ">":
                depth -= 1
            elif c == O(">>"):
                depth -= 2
            elif not (c in allowed or c in _BUILTIN or c in _MODIFIERS or c in _TAGS or c == O("::") or c == O("...") or c == O("&&") or c in _LITERAL):
                return -1
            p += 1
            if depth <= 0:
                return p if depth == 0 else -1

    def type_end(self, p: int) -> int:
        """The index after the type at ``p``, or -1."""
        s = self.s
        while s[p] in _MODIFIERS:
            p += 1
        c = s[p]
        if c in _BUILTIN:
            while s[p] in _BUILTIN or s[p] in _MODIFIERS:
                p += 1
        elif c in _TAGS:
            p += 1
            if s[p] == K("class"):
                p += 1
            if s[p] != "i":
                return -1
            p += 1
        elif self.CPP and c == K("decltype") and s[p + 1] == "(":
            p = self.closing(p + 1) + 1
            if p <= 0:
                return -1
        elif c == "i" or (self.CPP and c == O("::")):
            while True:
                if s[p] == O("::"):
                    p += 1
                if s[p] == K("typename") or s[p] == K("template"):
                    p += 1
                if s[p] != "i":
                    return -1
                p += 1
                if self.CPP and s[p] == "<":
                    q = self.angle(p)
                    if q < 0:
                        break
                    p = q
                if not (self.CPP and s[p] == O("::") and s[p + 1] in "i" + K("template")):
                    break
        else:
            return -1
        while s[p] in "*&" or s[p] in _MODIFIERS or (self.CPP and s[p] == O("&&")) or s[p] == O("..."):
            p += 1
        return p

    def condition(self) -> None:
        self.need("(")
        self.d += 1
        if self.CPP and (q := self.type_end(self.p)) > 0 and self.s[q] == "i" and self.s[q + 1] in "={":
            self.p = q + 1
            self.initializer()
            if self.opt(";"):
                self.expr()
        else:
            self.expr()
            while self.opt(","):
                self.expr()
        self.d -= 1
        self.need(")")

    def for_head(self) -> None:
        self.need("(")
        if self.pk() != ";":
            q = self.type_end(self.p)
            if q > 0 and (self.s[q] == "i" or (self.s[q] == "[" and self.CPP)):
                self.p = q
                if self.s[q] == "[":
                    self.p = self.closing(q) + 1
                else:
                    self.p += 1
                if self.CPP and self.opt(":"):
                    self.value()
                    self.need(")")
                    return
                self.declarators_after_name()
            else:
                self.expr()
                while self.opt(","):
                    self.expr()
        self.need(";")
        if self.pk() != ";":
            self.expr()
        self.need(";")
        if self.pk() != ")":
            self.expr()
            while self.opt(","):
                self.expr()
        self.need(")")

    def initializer(self) -> None:
        """``= value``, ``{values}``, or nothing."""
        if self.opt("="):
            self.value()
        elif self.CPP and self.pk() == "{":
            self.value()

    def value(self) -> None:
        if self.opt("{"):
            self.listed("}", self.element)
        else:
            self.expr(1)

    def element(self) -> None:
        while self.pk() in ".[":
            if self.opt("."):
                self.need("i")
            else:
                self.p += 1
                self.expr()
                self.need("]")
            if self.opt("="):
                break
        self.value()

    def argument(self) -> None:
        if self.pk() == "{":
            self.value()
        elif not (self.type_argument()):
            self.expr(1)
            self.opt(O("..."))

    def type_argument(self) -> bool:
        """A type as an argument, as in ``sizeof(long *)``."""
        q = self.type_end(self.p)
        if q > 0 and self.s[q] in ",)" and (self.s[self.p] in _BUILTIN or self.s[self.p] in _TAGS or self.s[self.p] in _MODIFIERS or self.s[q - 1] in "*&"):
            self.p = q
            return True
        return False

    def array(self) -> None:
        while self.opt("["):
            if self.pk() != "]":
                self.expr()
            self.need("]")

    def declarators_after_name(self) -> None:
        while True:
            self.array()
            if self.opt(":"):
                self.expr(3)
            self.initializer()
            if not self.opt(","):
                return
            while self.pk() in "*&" or self.pk() in _MODIFIERS:
                self.p += 1
            self.need("i")

    def parameter(self) -> None:
        if self.opt(O("...")):
            return
        q = self.type_end(self.p)
        if q < 0:
            self.fail("expected a parameter")
        self.p = q
        if self.pk() == "(" and self.s[self.p + 1] in "*&^":  # a function pointer
            self.p += 1
            while self.pk() in "*&^":
                self.p += 1
            self.opt("i")
            self.need(")")
            self.need("(")
            self.listed(")", self.parameter)
            return
        if self.pk() == "i":
            self.p += 1
        self.array()
        if self.CPP and self.opt("="):
            self.value()

    def primary(self) -> None:
        t = self.pk()
        if t == "s":
            while self.pk() == "s" or (self.pk() == "i" and self.s[self.p + 1] == "s"):
                self.p += 1
        elif t == "0":
            self.p += 1
        elif t == "i" or t in _LITERAL or (self.CPP and t == O("::")):
            self.qualified()
        elif t == "(":
            self.parenthesised()
        elif t == K("sizeof"):
            self.p += 1
            if self.pk() == "(":
                self.p += 1
                self.listed(")", self.argument)
            else:
                self.unary()
        elif self.CPP:
            self.cpp_primary(t)
        else:
            self.fail()

    def qualified(self) -> None:
        s = self.s
        if s[self.p] in _LITERAL:
            self.p += 1
            return
        while True:
            if s[self.p] == O("::"):
                self.p += 1
            if s[self.p] == "~":
                self.p += 1
            self.need("i")
            if self.CPP and s[self.p] == "<":
                q = self.angle(self.p)
                if q > 0 and s[q] in "({" + O("::"):
                    self.p = q
            if not (self.CPP and s[self.p] == O("::")):
                return

    def parenthesised(self) -> None:
        """A cast or an expression in parentheses."""
        q = self.type_end(self.p + 1)
        if q > 0 and self.s[q] == ")":
            after = self.s[q + 1]
            sure = self.s[self.p + 1] in _BUILTIN or self.s[self.p + 1] in _TAGS or self.s[self.p + 1] in _MODIFIERS or self.s[q - 1] in "*&"
            if sure and after == "{":
                self.p = q + 1
                self.value()
                return
            if after in "i0s(~!" or after in _LITERAL or (sure and after in self.PREFIX) or (self.CPP and after in _CPP_STARTS):
                self.p = q + 1
                self.unary()
                return
        self.p += 1
        self.d += 1
        self.expr()
        while self.opt(","):
            self.expr()
        self.d -= 1
        self.need(")")

    def cpp_primary(self, t: str) -> None:
        if t == "[":
            self.p += 1
            self.listed("]", self.capture)
            if self.opt("("):
                self.listed(")", self.parameter)
            while self.pk() in kinds_of("mutable noexcept constexpr"):
                self.p += 1
            if self.opt(O("->")):
                self.p = self.type_end(self.p)
                if self.p < 0:
                    self.p = 0
                    self.fail("expected a type")
            self.block()
        elif t == K("new"):
            self.p += 1
            q = self.type_end(self.p)
            if q < 0:
                self.fail("expected a type")
            self.p = q
            if self.pk() == "{":
                self.value()
        elif t == K("delete"):
            self.p += 1
            if self.opt("["):
                self.need("]")
            self.unary()
        elif t == K("throw"):
            self.p += 1
            if self.pk() not in ";),:":
                self.expr()
        elif t in kinds_of("co_await co_yield"):
            self.p += 1
            self.expr()
        elif t in kinds_of("static_cast dynamic_cast const_cast reinterpret_cast"):
            self.p += 1
            q = self.angle(self.p) if self.pk() == "<" else -1
            if q < 0:
                self.fail("expected a type in < >")
            self.p = q
            self.need("(")
            self.listed(")", self.argument)
        elif t in kinds_of("typeid decltype alignas noexcept"):
            self.p += 1
            self.need("(")
            self.listed(")", self.argument)
        elif t in _BUILTIN:
            self.p += 1
            if self.pk() not in "({":
                self.fail("unexpected type")
        elif t == K("operator"):
            self.operator()
        else:
            self.fail()

    def capture(self) -> None:
        self.opt("&") or self.opt("=") or self.opt("*")
        if self.pk() == "i" or self.pk() == K("this"):
            self.p += 1
            if self.opt("="):
                self.expr(1)
        self.opt(O("..."))

    def operator(self) -> None:
        self.p += 1
        if self.opt("("):
            self.need(")")
        elif self.opt("["):
            self.need("]")
        elif (q := self.type_end(self.p)) > 0:
            self.p = q
        else:
            self.p += 1
            if self.s[self.p] == "s":
                self.p += 1

    def post(self, t: str) -> bool:
        if t == O("++") or t == O("--"):
            self.p += 1
        elif t == O("->"):
            self.p += 1
            self.opt("~")
            self.opt(K("template"))
            self.member()
            if self.CPP and self.s[self.p] == "<" and (q := self.angle(self.p)) > 0 and self.s[q] == "(":
                self.p = q
        elif self.CPP and t == "{" and self.s[self.p - 1] in "i>" + "".join(_BUILTIN) and self.d:
            self.value()
        elif self.CPP and t in ops_of("->* .*"):
            self.p += 1
            self.unary()
        else:
            return False
        return True

    def caught(self) -> None:
        if not self.opt(O("...")):
            self.parameter()

    def attributes(self) -> None:
        while self.s[self.p] == "[" and self.s[self.p + 1] == "[":
            self.p = self.closing(self.p) + 1

    def statement(self, context: str) -> None:
        start, t = self.p, self.s[self.p]
        if t == "[" and self.s[self.p + 1] == "[":
            self.attributes()
            t = self.s[self.p]
        if context in ("block", "switch"):
            if t == "{":
                self.block()
                return
            if context == "switch" or t in (K("case"), K("default")):
                if t == K("case"):
                    self.p += 1
                    self.expr(3)
                    if self.opt(O("...")):
                        self.expr(3)
                    self.need(":")
                    return
                if t == K("default") and self.s[self.p + 1] == ":":
                    self.p += 2
                    return
            if self.flow(start, t):
                return
            if t == K("goto"):
                self.p += 1
                self.need("i")
                self.semicolon()
                return
            if t == "i" and self.s[self.p + 1] == ":":
                self.p += 2
                return
            if self.CPP and t == K("try"):
                self.p += 1
                self.opens(start, "body_try")
                return
        if t == K("typedef"):
            self.p += 1
            self.declaration(context, start)
            return
        if t == K("extern") and self.s[self.p + 1] == "s":
            self.p += 2
            if self.s[self.p] == "{":
                self.block("top")
            else:
                self.declaration(context, start)
            return
        if self.CPP and self.cpp_statement(context, start, t):
            return
        self.declaration(context, start)

    def cpp_statement(self, context: str, start: int, t: str) -> bool:
        if t == K("template"):
            self.p += 1
            if self.s[self.p] == "<":
                depth = 0
                while True:  # parameters may hold defaults, so only brackets are followed
                    c = self.s[self.p]
                    depth += (c == "<") - (c == ">") - 2 * (c == O(">>"))
                    if c in ";{}" + END:
                        self.fail("template parameters are not closed")
                    self.p += 1
                    if depth <= 0:
                        break
            self.statement(context)
        elif t == K("namespace"):
            self.p += 1
            while self.pk() in ("i", O("::")):
                self.p += 1
            if self.opt("="):
                self.qualified()
                self.semicolon()
            else:
                self.opens(start, "body_namespace")
        elif t == K("inline") and self.s[self.p + 1] == K("namespace"):
            self.p += 1
            self.cpp_statement(context, start, K("namespace"))
        elif t == K("using"):
            self.p += 1
            self.opt(K("namespace")) or self.opt(K("typename"))
            q = self.type_end(self.p)
            if q < 0:
                self.fail("expected a name")
            self.p = q
            if self.opt("="):
                q = self.type_end(self.p)
                if q < 0:
                    self.fail("expected a type")
                self.p = q
                if self.opt("("):
                    self.listed(")", self.parameter)
            self.semicolon()
        elif t in (K("public"), K("private"), K("protected")) and context == "class":
            self.p += 1
            self.need(":")
        elif t == K("static_assert"):
            self.p += 1
            self.need("(")
            self.listed(")", self.argument)
            self.semicolon()
        elif t == K("co_return"):
            self.p += 1
            if self.pk() != ";":
                self.value()
            self.semicolon()
        else:
            return False
        return True

    def body_namespace(self) -> None:
        self.block("top")

    def body_class(self) -> None:
        self.block("class")
        while self.pk() in "*&":
            self.p += 1
        if self.pk() == "i":
            self.p += 1
            self.declarators_after_name()
        self.need(";", " after a type")

    def body_enum(self) -> None:
        self.need("{")
        self.listed("}", self.enumerator)
        if self.pk() == "i":
            self.p += 1
            self.declarators_after_name()
        self.need(";", " after an enum")

    def enumerator(self) -> None:
        self.need("i")
        if self.opt("="):
            self.expr(1)

    def body_function(self) -> None:
        self.block()

    def tagged(self, start: int) -> bool:
        """A struct, union, enum or class with a body."""
        s, p = self.s, self.p
        while s[p] in _MODIFIERS:
            p += 1
        tag = s[p]
        if tag not in _TAGS or tag == K("typename") or (not self.CPP and tag == K("class")):
            return False
        p += 1
        if s[p] in _TAGS:
            p += 1
        while s[p] == "[" and s[p + 1] == "[":
            p = self.closing(p) + 1
        while s[p] in ("i", O("::")):
            p += 1
        if s[p] == "<" and self.CPP:
            q = self.angle(p)
            p = q if q > 0 else p
        if s[p] == K("final"):
            p += 1
        if s[p] == ":" and self.CPP:
            self.p = p + 1
            while True:
                while self.pk() in kinds_of("public private protected virtual"):
                    self.p += 1
                q = self.type_end(self.p)
                if q < 0:
                    self.fail("expected a base class")
                self.p = q
                if not self.opt(","):
                    break
            p = self.p
        if s[p] != "{":
            return False
        self.p = p
        self.opens(start, "body_enum" if tag == K("enum") else "body_class")
        return True

    def declaration(self, context: str, start: int) -> None:
        at = self.p
        if self.tagged(start):
            return
        self.p = at
        s = self.s
        p = at
        while s[p] in _MODIFIERS:
            p += 1
        if self.CPP and (s[p] == "~" or s[p] == K("operator") or (context == "class" and s[p] == "i" and s[p + 1] == "(")):
            self.p = p + (s[p] == "~")
            if s[p] == K("operator"):
                self.operator()
            else:
                self.need("i")
            self.function(start)
            return
        q = self.type_end(at)
        if q > 0 and s[q] == ";" and s[at] in (_TAGS | _MODIFIERS | _BUILTIN):
            self.p = q + 1
            return
        if q > 0 and (s[q] == "i" or (self.CPP and s[q] == K("operator"))):
            self.p = q
            if self.CPP:
                while s[self.p] == "i" and s[self.p + 1] == O("::"):
                    self.p += 2
                    if s[self.p] == "~":
                        self.p += 1
            if s[self.p] == K("operator"):
                self.operator()
            else:
                self.need("i")
            if s[self.p] == "(":
                if context in ("block", "switch"):
                    here = self.p
                    if self.attempt(lambda: self.function(start)):
                        return
                    self.p = here + 1
                    self.listed(")", self.argument)
                    self.semicolon()
                else:
                    self.function(start)
                return
            self.declarators_after_name()
            self.semicolon()
            return
        if q > 0 and s[q] == "(" and s[q + 1] in "*&^" and s[self.closing(q) + 1] in "([":  # a pointer to a function
            self.p = q + 2
            while self.pk() in "*&^":
                self.p += 1
            self.opt("i")
            self.array()
            self.need(")")
            self.need("(")
            self.listed(")", self.parameter)
            self.initializer()
            self.semicolon()
            return
        if q > 0 and self.CPP and s[q] == "[" and s[at] in _BUILTIN | _MODIFIERS:  # structured binding
            self.p = self.closing(q) + 1
            self.initializer()
            self.semicolon()
            return
        if self.CPP and q > 0 and s[q] == "(" and context == "top" and O("::") in s[at:q]:  # a constructor outside its class
            self.p = q
            self.function(start)
            return
        if context in ("block", "switch"):
            self.expr()
            while self.opt(","):
                self.expr()
            self.semicolon()
            return
        if s[at] == "i" and s[at + 1] == "(" and self.closing(at + 1) > 0 and s[self.closing(at + 1) + 1] == ";":  # a macro
            self.p = at + 2
            self.listed(")", self.argument)
            self.semicolon()
            return
        self.fail("expected a declaration" if q < 0 else f"unexpected {s[q]!r} in a declaration")

    def function(self, start: int) -> None:
        self.need("(")
        if self.s[self.p] == K("void") and self.s[self.p + 1] == ")":
            self.p += 2
        else:
            self.listed(")", self.parameter)
        s = self.s
        if self.CPP:
            while s[self.p] in kinds_of("const noexcept override final volatile throw") or s[self.p] in ("&", O("&&")):
                self.p += 1
                if s[self.p] == "(":
                    self.p = self.closing(self.p) + 1
            if self.opt(O("->")):
                q = self.type_end(self.p)
                if q < 0:
                    self.fail("expected a type")
                self.p = q
            if self.opt(":"):  # initialisers of members
                while True:
                    q = self.type_end(self.p)
                    if q < 0:
                        self.fail("expected a member")
                    self.p = q
                    if self.opt("("):
                        self.listed(")", self.argument)
                    else:
                        self.value()
                    if not self.opt(","):
                        break
            if self.opt("="):
                if self.pk() in ("0", K("default"), K("delete")):
                    self.p += 1
                else:
                    self.fail()
        if self.opt(";"):
            return
        if self.opt(","):
            self.declarators_after_name()
            self.semicolon()
            return
        if s[self.p] != "{":
            self.fail(f"expected a body, found {s[self.p]!r}")
        self.opens(start, "body_function")


_LITERAL = kinds_of("nullptr true false this")
_CPP_STARTS = kinds_of("new static_cast dynamic_cast const_cast reinterpret_cast sizeof") | ops_of("::")


class Cpp(C):
    CPP = True
    BINARY = levels(LEVELS) | {O("->*"): 14, O(".*"): 14}


_JAVA_MODS = kinds_of("public private protected static final abstract native transient volatile strictfp synchronized default sealed")
_JAVA_TYPES = kinds_of("void boolean byte char short int long float double var")


class Java(Braces):
    BINARY = {k: v for k, v in levels(LEVELS).items()} | {K("instanceof"): 10}
    PREFIX = ops_of("+ - ! ~ ++ --")
    NAMES = frozenset("i") | kinds_of("record sealed permits yield when var")

    def angle(self, p: int) -> int:
        s, depth = self.s, 0
        while True:
            c = s[p]
            depth += (c == "<") - (c == ">") - 2 * (c == O(">>"))
            if c not in "i,.?&<>[]@" + O(">>") and c not in _JAVA_TYPES and c not in kinds_of("extends super") and c not in self.NAMES:
                return -1
            p += 1
            if depth <= 0:
                while s[p] == ">" and depth < 0:
                    return -1
                return p

    def type_end(self, p: int) -> int:
        s = self.s
        while s[p] == "@":
            p += 2
        if s[p] in _JAVA_TYPES:
            p += 1
        elif s[p] in self.NAMES:
            while True:
                if s[p] not in self.NAMES:
                    return -1
                p += 1
                if s[p] == "<":
                    q = self.angle(p)
                    if q < 0:
                        return -1
                    p = q
                if s[p] == "." and s[p + 1] in self.NAMES:
                    p += 1
                    continue
                break
        else:
            return -1
        while s[p] == "[" and s[p + 1] == "]":
            p += 2
        return p

    def type_(self) -> None:
        q = self.type_end(self.p)
        if q < 0:
            self.fail("expected a type")
        self.p = q

    def annotations(self) -> None:
        s = self.s
        while True:
            if s[self.p] == "@" and s[self.p + 1] != K("interface"):
                self.p += 1
                self.name()
                while s[self.p] == ".":
                    self.p += 1
                    self.name()
                if s[self.p] == "(":
                    self.p += 1
                    self.listed(")", self.annotation_value)
            elif s[self.p] in _JAVA_MODS and not (s[self.p] == K("default") and s[self.p + 1] in (":", O("->"))):
                self.p += 1
            else:
                return

    def annotation_value(self) -> None:
        if self.pk() == "{":
            self.p += 1
            self.listed("}", self.annotation_value)
        elif self.pk() == "@":
            self.annotations()
        else:
            self.expr()

    def infix(self, t: str) -> bool:
        if t == K("instanceof"):
            self.opt(K("final"))
            self.type_()
            if self.pk() in self.NAMES:
                self.p += 1
            elif self.opt("("):
                self.listed(")", self.parameter)
            return True
        return False

    def value(self) -> None:
        if self.opt("{"):
            self.listed("}", self.value)
        else:
            self.expr(1)

    def argument(self) -> None:
        self.expr(1)

    def lambda_body(self) -> None:
        self.need(O("->"))
        if self.pk() == "{":
            self.block()
        else:
            self.expr(1)

    def primary(self) -> None:
        t, s = self.pk(), self.s
        if t in self.NAMES and s[self.p + 1] == O("->"):
            self.p += 1
            self.lambda_body()
        elif t == "(":
            end = self.closing(self.p)
            if end > 0 and s[end + 1] == O("->"):
                self.p += 1
                self.listed(")", self.lambda_parameter)
                self.lambda_body()
                return
            q = self.type_end(self.p + 1)
            while q > 0 and s[q] == "&":
                q = self.type_end(q + 1)
            if q > 0 and s[q] == ")":
                after = s[q + 1]
                simple = s[self.p + 1] in _JAVA_TYPES
                if after in "i0s(!~" or after in self.NAMES or after in kinds_of("this super new true false null switch") or (simple and after in "+-"):
                    self.p = q + 1
                    self.unary()
                    return
            self.p += 1
            self.d += 1
            self.expr()
            self.d -= 1
            self.need(")")
        elif t == K("new"):
            self.p += 1
            q = self.p
            while s[q] in self.NAMES or s[q] == "." or s[q] in _JAVA_TYPES:
                q += 1
                if s[q] == "<" and (r := self.angle(q)) > 0:
                    q = r
                elif s[q] == "<" and s[q + 1] == ">":
                    q += 2
            if q == self.p:
                self.fail("expected a type")
            self.p = q
            if self.opt("("):
                self.listed(")", self.argument)
                if self.pk() == "{":
                    self.block("class")
            elif self.pk() == "[":
                while self.opt("["):
                    if self.pk() != "]":
                        self.expr()
                    self.need("]")
                if self.pk() == "{":
                    self.value()
            else:
                self.fail("expected ( or [")
        elif t == K("switch"):
            self.p += 1
            self.condition()
            self.body_switch()
        elif t in "i0s" or t in self.NAMES or t in kinds_of("this super true false null"):
            self.p += 1
            if s[self.p] == "<" and (q := self.angle(self.p)) > 0 and s[q] == O("::"):
                self.p = q
            while s[self.p] == "[" and s[self.p + 1] == "]":
                self.p += 2
        elif t in _JAVA_TYPES and (s[self.p + 1] in "." + O("::") or s[self.p + 1] == "["):
            self.p += 1
            while s[self.p] == "[":
                self.p += 2
        else:
            self.fail()

    def lambda_parameter(self) -> None:
        self.annotations()
        if self.s[self.p] in self.NAMES and self.s[self.p + 1] in ",)":
            self.p += 1
        else:
            self.parameter()

    def post(self, t: str) -> bool:
        if t == O("++") or t == O("--"):
            self.p += 1
        elif t == O("::"):
            self.p += 1
            if not self.opt(K("new")):
                self.name()
        else:
            return False
        return True

    def member(self) -> None:
        if self.s[self.p] == "<" and (q := self.angle(self.p)) > 0:
            self.p = q
        if self.pk() in self.NAMES or self.pk() in kinds_of("this super new class"):
            self.p += 1
            if self.s[self.p - 1] == K("new"):
                self.p -= 1
                self.primary()
        else:
            self.fail("expected a member name")

    def parameter(self) -> None:
        self.annotations()
        self.type_()
        self.opt(O("..."))
        if self.pk() == K("this"):
            self.p += 1
        else:
            self.name()
        while self.opt("["):
            self.need("]")

    def caught(self) -> None:
        self.annotations()
        self.type_()
        while self.opt("|"):
            self.type_()
        self.name()

    def for_head(self) -> None:
        self.need("(")
        self.annotations()
        if self.pk() != ";":
            q = self.type_end(self.p)
            if q > 0 and self.s[q] in self.NAMES:
                self.p = q + 1
                if self.opt(":"):
                    self.expr()
                    self.need(")")
                    return
                self.variables()
            else:
                self.expr()
                while self.opt(","):
                    self.expr()
        self.need(";")
        if self.pk() != ";":
            self.expr()
        self.need(";")
        if self.pk() != ")":
            self.expr()
            while self.opt(","):
                self.expr()
        self.need(")")

    def variables(self) -> None:
        """What may follow a declared name."""
        while True:
            while self.opt("["):
                self.need("]")
            if self.opt("="):
                self.value()
            if not self.opt(","):
                return
            self.name()

    def statement(self, context: str) -> None:
        start, t, s = self.p, self.s[self.p], self.s
        if context in ("block", "switch"):
            if t == "{":
                self.block()
                return
            if t == K("case") or (t == K("default") and s[self.p + 1] in (":", O("->"))):
                self.p += 1
                if t == K("case"):
                    while True:
                        if not self.attempt(self.case_pattern):
                            self.expr(2)
                        if self.opt(K("when")):
                            self.expr(2)
                        if not self.opt(","):
                            break
                if self.opt(O("->")):
                    if self.pk() == "{":
                        self.block()
                    elif self.pk() == K("throw"):
                        self.statement("block")
                    else:
                        self.expr()
                        self.semicolon()
                else:
                    self.need(":")
                return
            if t == K("try"):
                self.p += 1
                if self.opt("("):
                    self.d += 1
                    while self.pk() != ")":
                        q = self.type_end(self.p)
                        if q > 0 and s[q] in self.NAMES:
                            self.p = q + 1
                            self.need("=")
                        self.expr()
                        if not self.opt(";"):
                            break
                    self.d -= 1
                    self.need(")")
                    self.block()
                    while self.opt(K("catch")):
                        self.need("(")
                        self.caught()
                        self.need(")")
                        self.block()
                    if self.opt(K("finally")):
                        self.block()
                else:
                    self.opens(start, "body_try")
                return
            if self.flow(start, t):
                return
            if t == K("synchronized") and s[self.p + 1] == "(":
                self.p += 1
                self.condition()
                self.block()
                return
            if t == K("assert"):
                self.p += 1
                self.expr()
                if self.opt(":"):
                    self.expr()
                self.semicolon()
                return
            if t == K("yield") and s[self.p + 1] not in "=.(":
                self.p += 1
                self.expr()
                self.semicolon()
                return
            if t == "i" and s[self.p + 1] == ":":
                self.p += 2
                return
        elif context == "top":
            if t == K("package") or (t == "@" and False):
                self.p += 1
                self.dotted()
                self.semicolon()
                return
            if t == K("import"):
                self.p += 1
                self.opt(K("static"))
                self.dotted()
                self.semicolon()
                return
        elif t == "{" or (t == K("static") and s[self.p + 1] == "{"):
            self.p += t != "{"
            self.block()
            return
        self.annotations()
        t = s[self.p]
        if t == K("class") or (t == K("record") and s[self.p + 1] in self.NAMES and s[self.p + 2] in "(<"):
            self.p += 1
            self.name()
            self.generics()
            if self.opt("("):
                self.listed(")", self.parameter)
            self.supertypes()
            self.opens(start, "body_class")
        elif t == K("interface") or (t == "@" and s[self.p + 1] == K("interface")):
            self.p += 2 if t == "@" else 1
            self.name()
            self.generics()
            self.supertypes()
            self.opens(start, "body_class")
        elif t == K("enum"):
            self.p += 1
            self.name()
            self.supertypes()
            self.enum_body()
        elif context == "class":
            self.class_member(start)
        elif context == "top":
            self.fail("expected a type declaration")
        else:
            q = self.type_end(self.p)
            if q > 0 and s[q] in self.NAMES:
                self.p = q + 1
                self.variables()
            else:
                self.expr()
            self.semicolon()

    def case_pattern(self) -> None:
        self.type_()
        if self.opt("("):
            self.listed(")", self.case_pattern_or_name)
        else:
            self.name()

    def case_pattern_or_name(self) -> None:
        self.case_pattern()

    def dotted(self) -> None:
        self.name()
        while self.opt("."):
            if self.opt("*"):
                return
            self.name()

    def generics(self) -> None:
        if self.s[self.p] == "<":
            q = self.angle(self.p)
            if q < 0:
                self.fail("type parameters")
            self.p = q

    def supertypes(self) -> None:
        while self.pk() in kinds_of("extends implements permits"):
            self.p += 1
            self.type_()
            while self.opt(","):
                self.type_()

    def body_class(self) -> None:
        self.block("class")

    def enum_body(self) -> None:
        self.need("{")
        while self.s[self.p] in self.NAMES or self.s[self.p] == "@":
            self.annotations()
            self.name()
            if self.opt("("):
                self.listed(")", self.argument)
            if self.s[self.p] == "{":
                self.block("class")
            if not self.opt(","):
                break
        if self.opt(";"):
            self.statements("class", "}")
        self.need("}")

    def class_member(self, start: int) -> None:
        s = self.s
        self.generics()
        if s[self.p] in self.NAMES and s[self.p + 1] == "(":  # a constructor
            self.p += 1
        elif s[self.p] in self.NAMES and s[self.p + 1] == "{":  # a compact one
            self.p += 1
            self.opens(start, "body_method")
            return
        else:
            self.type_()
            self.name()
        if not self.opt("("):
            self.variables()
            self.semicolon()
            return
        self.listed(")", self.parameter)
        while self.opt("["):
            self.need("]")
        if self.opt(K("throws")):
            self.type_()
            while self.opt(","):
                self.type_()
        if self.opt(K("default")):
            self.annotation_value()
        if self.opt(";"):
            return
        self.opens(start, "body_method")

    def body_method(self) -> None:
        self.block()

    def sub(self) -> None:
        if self.s[self.p] == "{":
            self.block()
        else:
            super().sub()
