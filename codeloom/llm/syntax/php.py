"""PHP: statements that end with semicolons, variables with a dollar sign, text outside its tags."""

from __future__ import annotations

import re

from codeloom.llm.syntax.base import BLOCK_COMMENT, END, K, O, Lexer, kinds_of, ops_of
from codeloom.llm.syntax.lines import Lines

_WORDS = (
    "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor "
    "endforeach endif endswitch endwhile enum exit extends final finally fn for foreach function global goto if implements include include_once "
    "instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static "
    "switch throw trait try unset use var while xor yield from die eval true false null"
)
_OPS = "**= ... <=> === !== <<= >>= ??= ?-> -> => :: ++ -- ** << >> <= >= == != <> && || ?? += -= *= /= .= %= &= |= ^="
_CASTS = r"\([ \t]*(?:int|integer|bool|boolean|float|double|string|array|object)[ \t]*\)"


def _token(token: str) -> str | None:
    if token.startswith("?>"):
        return ";"
    if token.endswith(("<?php", "<?=")):
        return ""
    if token.startswith(("//", "/*")) and len(token) > 3 or token.startswith("//") or (token[0] == "#" and token[:2] != "#["):
        return ""
    if token.startswith("<<<") and len(token) > 3:
        return "s"
    if token.startswith("$") and len(token) > 1:
        return "v"
    if token.startswith("(") and len(token) > 1:
        return "!"
    if token == "#[":
        return "@["
    if token[0] == "\\" and len(token) > 1:
        return "i"
    if len(token) > 1 and "\\" in token and token[0] not in "\"'`":
        return "i"
    return None


class PhpLexer(Lexer):
    """PHP after its opening tag; text before it is nothing."""

    def __missing__(self, token: str) -> str:
        if token[0].isalpha() and token.lower() in self.words:
            self[token] = self.words[token.lower()]
            return self[token]
        return super().__missing__(token)

    def kinds(self, text: str) -> str:
        if not re.search(r"<\?(?:php\b|=)", text):
            return ""  # all of it is text
        return "".join(self[m.group()] for m in self.pattern.finditer(text))


PHP_LEXER = PhpLexer(
    [
        r"\A(?:[^<]|<(?!\?(?:php\b|=)))*(?:<\?(?:php\b|=)|\Z)", r"\?>(?:[^<]|<(?!\?(?:php\b|=)))*(?:<\?(?:php\b|=)|\Z)",
        r"#\[", r"(?://|#)(?:[^\n?]|\?(?!>))*", BLOCK_COMMENT,
        r"<<<[ \t]*\"?(?P<tag>[A-Za-z_]\w*)\"?\n(?:[\s\S]*?\n)?[ \t]*(?P=tag)\b", r"<<<[ \t]*'(?P<raw>[A-Za-z_]\w*)'\n(?:[\s\S]*?\n)?[ \t]*(?P=raw)\b",
        r"\$[^\W\d]\w*", r"\\?[^\W\d]\w*(?:\\[^\W\d]\w*)+|\\[^\W\d]\w*", r"[^\W\d]\w*", _CASTS,
        r"0[xX][\da-fA-F_]+(?!\w)|0[bB][01_]+(?!\w)|(?:\d[\d_]*(?:\.\d[\d_]*|\.(?!\.))?|\.\d[\d_]*)(?:[eE][+-]?\d+)?(?!\w)", r'"(?:[^"\\]|\\[\s\S])*"', r"'(?:[^'\\]|\\[\s\S])*'", r"`(?:[^`\\]|\\[\s\S])*`",
    ],
    _WORDS, _OPS, "()[]{};,:?.!+-*/%<>=@&|^~$\\", _token,
)

_ASSIGN = "= += -= *= /= .= %= **= <<= >>= &= ^= |= ??="
_MODIFIERS = kinds_of("public protected private static abstract final readonly var")
_CALLS = kinds_of("isset empty list array exit die eval unset static from enum readonly")
_INCLUDES = kinds_of("include include_once require require_once print yield clone new throw echo")
_ENDINGS = {"if": "endif", "while": "endwhile", "for": "endfor", "foreach": "endforeach", "switch": "endswitch"}


class Php(Lines):
    NAMES = frozenset("i") | kinds_of("enum from readonly")
    PREFIX = ops_of("+ - ! ~ @ & ++ --")
    BINARY = {
        O(op): i
        for i, row in enumerate([_ASSIGN, "", "", "", "", "??", "||", "&&", "|", "^", "&", "== != === !== <> <=>", "< <= > >=", ".", "<< >>", "+ -", "* / %"], 1)
        for op in row.split()
    } | {K("or"): 2, K("xor"): 3, K("and"): 4, K("instanceof"): 19, O("**"): 20}

    def semicolon(self) -> None:
        if self.s[self.p] == END and self.p and self.s[self.p - 1] == ";":
            return
        self.need(";")

    def type_(self) -> None:
        self.opt("?")
        while True:
            if self.opt("("):
                self.type_()
                self.need(")")
            elif self.pk() in self.NAMES or self.pk() in kinds_of("array callable static null true false"):
                self.p += 1
            else:
                self.fail(f"expected a type, found {self.shown()}")
            if self.s[self.p] == "&" and self.s[self.p + 1] in "v&" + O("..."):
                return
            if not (self.opt("|") or self.opt("&")):
                return

    # -- expressions

    def infix(self, t: str) -> bool:
        if t == "=" and self.pk() == "&":
            self.p += 1
        return False

    def tail(self, t: str) -> bool:
        if t == "?":
            self.p += 1
            if not self.opt(":"):
                self.expr(5)
                self.need(":", " of a conditional")
            self.expr(5)
            return True
        return False

    def primary(self) -> None:
        t = self.pk()
        if t == "v" or t in "0s":
            self.p += 1
        elif t == "$":
            self.p += 1
            if self.opt("{"):
                self.expr()
                self.need("}")
            else:
                self.primary()
        elif t == K("new"):
            self.p += 1
            self.attributes()
            if self.opt(K("readonly")) or self.pk() == K("class"):
                self.need(K("class"))
                if self.opt("("):
                    self.closed(")", self.argument)
                self.heritage()
                self.braces("class")
            elif self.opt("("):
                self.expr()
                self.need(")")
            elif self.pk() == "v":
                self.p += 1
            else:
                self.member()
            if self.opt("("):
                self.closed(")", self.argument)
        elif t in (K("function"), K("fn")) or (t == K("static") and self.s[self.p + 1] in (K("function"), K("fn"))):
            self.opt(K("static"))
            arrow = self.pk() == K("fn")
            self.p += 1
            self.opt("&")
            self.need("(")
            self.closed(")", self.parameter)
            if self.opt(K("use")):
                self.need("(")
                self.closed(")", self.used)
            if self.opt(":"):
                self.type_()
            if arrow:
                self.need(O("=>"))
                self.expr()
            else:
                self.braces("block")
        elif t == K("match"):
            self.p += 1
            self.need("(")
            self.expr()
            self.need(")")
            self.need("{")
            self.closed("}", self.arm)
        elif t in _INCLUDES:
            self.p += 1
            if t == K("yield"):
                self.opt(K("from"))
                if self.pk() in ";)],":
                    return
            self.expr(5)
            if t == K("yield") and self.opt(O("=>")):
                self.expr(5)
        elif t == "@" and self.s[self.p + 1] == "[":
            self.attributes()
            self.primary()
        elif t in self.NAMES or t in _CALLS or t in kinds_of("true false null class"):
            self.p += 1
        elif t == "(":
            self.p += 1
            self.d += 1
            self.expr()
            self.need(")")
            self.d -= 1
        elif t == "[":
            self.p += 1
            self.closed("]", self.element)
        else:
            self.fail()

    def arm(self) -> None:
        if not self.opt(K("default")):
            while True:
                self.expr()
                if not self.opt(",") or self.pk() == O("=>"):
                    break
        self.need(O("=>"))
        self.expr()

    def used(self) -> None:
        self.opt("&")
        self.need("v")

    def element(self) -> None:
        if self.pk() == ",":
            return
        self.opt(O("...")) or self.opt("&")
        self.expr()
        if self.opt(O("=>")):
            self.opt("&")
            self.expr()

    def argument(self) -> None:
        if self.opt(O("...")):
            if self.pk() == ")":
                return
        elif self.s[self.p + 1] == ":" and (self.pk() in self.NAMES or chr(0xE000) <= self.pk() < chr(0xE800)):
            self.p += 2
        self.element()

    def member(self) -> None:
        if self.pk() in self.NAMES or chr(0xE000) <= self.pk() < chr(0xE800):
            self.p += 1
        else:
            self.fail(f"expected a name, found {self.shown()}")

    def postfix(self) -> None:
        while True:
            t = self.pk()
            if t == "(":
                self.p += 1
                self.closed(")", self.argument)
            elif t == "[":
                self.p += 1
                if not self.opt("]"):
                    self.expr()
                    self.need("]")
            elif t in (O("->"), O("?->"), O("::")):
                self.p += 1
                if self.pk() == "v":
                    self.p += 1
                elif self.opt("{"):
                    self.expr()
                    self.need("}")
                elif self.pk() == "$":
                    self.primary()
                else:
                    self.member()
            elif t in (O("++"), O("--")):
                self.p += 1
            else:
                return

    # -- statements

    def attributes(self) -> None:
        while self.s[self.p] == "@" and self.s[self.p + 1] == "[":
            self.p += 2
            self.closed("]", self.expr)

    def condition(self) -> None:
        self.need("(")
        self.d += 1
        self.expr()
        self.need(")")
        self.d -= 1

    def sub(self) -> None:
        if self.pk() == "{":
            self.braces("block")
        elif self.pk() in "}" + END:
            self.fail("missing statement")
        elif not self.opt(";"):
            self.statement("block")

    def body(self, word: str) -> None:
        """A statement, or statements between a colon and the closing word."""
        if self.opt(":"):
            while self.s[self.p] not in kinds_of(_ENDINGS[word]) | frozenset("}" + END):
                if not self.opt(";"):
                    self.statement("switch" if word == "switch" else "block")
            self.need(K(_ENDINGS[word]))
            self.semicolon()
        else:
            self.sub()

    def if_(self) -> None:
        self.p += 1
        self.condition()
        if self.opt(":"):
            stops = kinds_of("elseif else endif") | frozenset("}" + END)
            while True:
                while self.s[self.p] not in stops:
                    if not self.opt(";"):
                        self.statement("block")
                if self.opt(K("elseif")):
                    self.condition()
                elif not self.opt(K("else")):
                    break
                self.need(":")
            self.need(K("endif"))
            self.semicolon()
            return
        self.sub()
        while self.pk() == K("elseif"):
            self.p += 1
            self.condition()
            self.sub()
        if self.opt(K("else")):
            self.sub()

    def statement(self, context: str) -> None:
        if context == "class":
            self.class_member()
            return
        self.attributes()
        t, after = self.pk(), self.s[self.p + 1]
        if t == "{":
            self.braces("block")
        elif t == K("if"):
            self.if_()
        elif t == K("while"):
            self.p += 1
            self.condition()
            self.body("while")
        elif t == K("do"):
            self.p += 1
            self.sub()
            self.need(K("while"))
            self.condition()
            self.semicolon()
        elif t == K("for"):
            self.p += 1
            self.need("(")
            for close in ";;)":
                if self.pk() != close:
                    self.expr()
                    while self.opt(","):
                        self.expr()
                self.need(close)
            self.body("for")
        elif t == K("foreach"):
            self.p += 1
            self.need("(")
            self.expr()
            self.need(K("as"))
            self.element()
            self.need(")")
            self.body("foreach")
        elif t == K("switch"):
            self.p += 1
            self.condition()
            if self.pk() == "{":
                self.braces("switch")
            else:
                self.body("switch")
        elif context == "switch" and t in (K("case"), K("default")):
            self.p += 1
            if t == K("case"):
                self.expr()
            if not self.opt(":"):
                self.need(";")
        elif t == K("try"):
            self.p += 1
            self.braces("block")
            n = 0
            while self.opt(K("catch")):
                self.need("(")
                self.type_()
                self.opt("v")
                self.need(")")
                self.braces("block")
                n += 1
            if self.opt(K("finally")):
                self.braces("block")
                n += 1
            if not n:
                self.fail("try without catch or finally")
        elif t == K("function") and (after in self.NAMES or after in "&" or chr(0xE000) <= after < chr(0xE800)) and not (after == "&" and self.s[self.p + 2] == "("):
            self.p += 1
            self.function()
        elif t in kinds_of("abstract final class trait interface") or (t == K("readonly") and after in kinds_of("class final abstract")) or (t == K("enum") and after in "i"):
            while self.pk() in kinds_of("abstract final readonly"):
                self.p += 1
            if self.pk() not in kinds_of("class trait interface enum"):
                self.fail(f"expected class, found {self.shown()}")
            self.p += 1
            self.name()
            if self.opt(":"):
                self.type_()
            self.heritage()
            self.braces("class")
        elif t == K("namespace") and after != "\\":
            self.p += 1
            self.opt("i")
            if self.pk() == "{":
                self.braces("top")
            else:
                self.semicolon()
        elif t == K("use"):
            self.p += 1
            if self.pk() in (K("function"), K("const")):
                self.p += 1
            self.used_names()
            self.semicolon()
        elif t == K("const"):
            self.p += 1
            self.constants()
        elif t in (K("return"), K("break"), K("continue")):
            self.p += 1
            if self.pk() != ";":
                self.expr()
            self.semicolon()
        elif t in (K("echo"), K("global"), K("unset")) or (t == K("static") and after == "v"):
            self.p += 1
            self.expr()
            while self.opt(","):
                self.expr()
            self.semicolon()
        elif t == K("declare"):
            self.p += 1
            self.condition()
            if not self.opt(";"):
                self.sub()
        elif t == K("goto"):
            self.p += 1
            self.name()
            self.semicolon()
        elif t == "i" and after == ":" and self.s[self.p + 2] != ":":
            self.p += 2
        else:
            self.expr()
            self.semicolon()

    def used_names(self) -> None:
        while True:
            if self.pk() in (K("function"), K("const")):
                self.p += 1
            self.name()
            if self.opt("\\") or self.pk() == "{":
                self.need("{")
                self.used_names()
                self.need("}")
            if self.opt(K("as")):
                self.name()
            if not self.opt(",") or self.pk() == "}":
                return

    def constants(self) -> None:
        if self.s[self.p + 1] not in "=":
            self.type_()
        while True:
            self.member()
            self.need("=")
            self.expr()
            if not self.opt(","):
                break
        self.semicolon()

    def heritage(self) -> None:
        while self.pk() in (K("extends"), K("implements")):
            self.p += 1
            self.name()
            while self.opt(","):
                self.name()

    def function(self) -> None:
        self.opt("&")
        self.member()
        self.need("(")
        self.closed(")", self.parameter)
        if self.opt(":"):
            self.type_()
        if self.pk() == "{":
            self.braces("block")
        else:
            self.semicolon()

    def parameter(self) -> None:
        self.attributes()
        while self.pk() in _MODIFIERS:
            self.p += 1
        if self.pk() not in "v&" + O("..."):
            self.type_()
        self.opt("&")
        self.opt(O("..."))
        self.need("v")
        if self.opt("="):
            self.expr()

    def class_member(self) -> None:
        self.attributes()
        start = self.p
        while self.pk() in _MODIFIERS:
            self.p += 1
        t = self.pk()
        if t == K("use"):
            self.p += 1
            self.name()
            while self.opt(","):
                self.name()
            if self.pk() == "{":
                self.p = self.closing(self.p) + 1 or self.p
            else:
                self.semicolon()
        elif t == K("const"):
            self.p += 1
            self.constants()
        elif t == K("function"):
            self.p += 1
            self.function()
        elif t == K("case"):
            self.p += 1
            self.member()
            if self.opt("="):
                self.expr()
            self.semicolon()
        elif self.p > start:
            if t != "v":
                self.type_()
            while True:
                self.need("v")
                if self.opt("="):
                    self.expr()
                if not self.opt(","):
                    break
            self.semicolon()
        else:
            self.fail(f"expected a member, found {self.shown()}")
