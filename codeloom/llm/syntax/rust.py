"""Rust: blocks that are expressions, patterns, types after names, macros as token trees."""

from __future__ import annotations

from codeloom.llm.syntax.base import LINE_COMMENT, NAME, NESTED_COMMENT, NUMBER, O, END, K, Lexer, kinds_of, ops_of
from codeloom.llm.syntax.lines import Lines

_WORDS = (
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self "
    "static struct super trait true type unsafe use where while union default auto macro_rules"
)
# A run of ``>`` is read one by one, as it may close several lists of types.
_OPS = "..= ... .. :: -> => && || == != <= += -= *= /= %= &= |= ^= << <<="


def _token(token: str) -> str | None:
    if token.startswith("//") or (token.startswith("/*") and len(token) > 3) or token.startswith("#!/"):
        return ""
    if token[0] == "'" and len(token) > 1 and token[-1] != "'":
        return "'"
    if token.startswith("r#") and len(token) > 2 and token[2] not in "\"#":
        return "i"
    if len(token) > 2 and token[-1] in "\"'#" and token[0] in "brc":
        return "s"
    return None


RUST_LEXER = Lexer(
    [
        r"\A#!/[^\n]*", LINE_COMMENT, NESTED_COMMENT, r'(?:b|c)?r"[^"]*"', r'(?:b|c)?r#"(?:[^"]|"(?!#))*"#', r'(?:b|c)?r##+"(?:[^"]|"(?!##))*"##+',
        r'[bc]?"(?:[^"\\]|\\[\s\S])*"', r"b?'(?:[^'\\\n]|\\[^\n][^'\n]{0,10})'", r"'[^\W\d]\w*", r"r#[^\W\d]\w*", NAME, r"\.(?=\d)", NUMBER,
    ],
    _WORDS, _OPS, "()[]{};,:?.!+-*/%<>=@&|^#$~", _token,
)

_SOFT = kinds_of("union default auto macro_rules")
_PATH = frozenset("i") | _SOFT | kinds_of("self Self super crate")
_BLOCKS = kinds_of("if match while loop for unsafe")
_ENDS = frozenset(";,)]}" + END) | ops_of("=>")


class Rust(Lines):
    NAMES = frozenset("i") | _SOFT
    PREFIX = ops_of("- ! *")
    BINARY = {
        O(op): i
        for i, row in enumerate(["= += -= *= /= %= &= |= ^= <<=", ".. ..= ...", "||", "&&", "== != < > <=", "|", "^", "&", "<<", "+ -", "* / %"], 1)
        for op in row.split()
    } | {K("as"): 13}

    def __init__(self, kinds: str):
        super().__init__(kinds)
        self.bare = False  # in the head of a control statement a brace opens its body

    def inside(self, close: str, item) -> None:
        bare, self.bare = self.bare, False
        self.closed(close, item)
        self.bare = bare

    # -- types and paths

    def type_(self) -> None:
        t = self.s[self.p]
        if t == "&" or t == O("&&"):
            self.p += 1
            self.opt("'")
            self.opt(K("mut"))
            self.type_()
        elif t == "*":
            self.p += 1
            if self.pk() not in (K("const"), K("mut")):
                self.fail("expected const or mut")
            self.p += 1
            self.type_()
        elif t == "(":
            self.p += 1
            self.closed(")", self.type_)
        elif t == "[":
            self.p += 1
            self.type_()
            if self.opt(";"):
                self.expr()
            self.need("]")
        elif t == "!":
            self.p += 1
        elif t in (K("dyn"), K("impl")):
            self.p += 1
            self.bounds()
        elif t == K("for"):
            self.higher()
            self.type_()
        elif t in (K("fn"), K("unsafe"), K("extern")):
            while self.pk() in (K("unsafe"), K("extern"), "s"):
                self.p += 1
            self.need(K("fn"))
            self.need("(")
            self.closed(")", self.fn_type_parameter)
            if self.opt(O("->")):
                self.type_()
        elif t == "<":
            self.qualified()
        else:
            self.path(types=True)
            if self.s[self.p] == "!":
                self.p += 1
                self.tree()

    def fn_type_parameter(self) -> None:
        if self.pk() in self.NAMES and self.s[self.p + 1] == ":":
            self.p += 2
        if not self.opt(O("...")):
            self.type_()

    def qualified(self) -> None:
        self.need("<")
        self.type_()
        if self.opt(K("as")):
            self.type_()
        self.need(">")
        while self.opt(O("::")):
            self.segment(True)

    def segment(self, types: bool) -> None:
        if self.pk() not in _PATH:
            self.fail(f"expected a name, found {self.shown()}")
        self.p += 1
        if types and self.s[self.p] == "<":
            self.arguments()
        elif types and self.s[self.p] == "(":
            self.p += 1
            self.closed(")", self.type_)
            if self.opt(O("->")):
                self.type_()

    def path(self, types: bool) -> None:
        self.opt(O("::"))
        if self.s[self.p] == "$":
            self.p += 1
        self.segment(types)
        while self.s[self.p] == O("::"):
            self.p += 1
            if self.s[self.p] == "<":
                self.arguments()
            elif self.s[self.p] == "(" and types:
                continue
            else:
                self.segment(types)

    def arguments(self) -> None:
        self.need("<")
        while self.s[self.p] != ">":
            if self.opt("'") or self.opt("0") or self.opt("s"):
                pass
            elif self.s[self.p] == "{":
                self.block()
            elif self.s[self.p] == "-":
                self.p += 1
                self.need("0")
            else:
                self.type_()
                if self.opt("="):
                    self.type_()
                elif self.opt(":"):
                    self.bounds()
            if not self.opt(","):
                break
        self.need(">")

    def higher(self) -> None:
        self.need(K("for"))
        self.generics()

    def bounds(self) -> None:
        while True:
            if self.opt("'"):
                pass
            elif self.opt("("):
                self.bounds()
                self.need(")")
            else:
                self.opt("?") or self.opt("~")
                self.opt(K("const"))
                if self.pk() == K("for"):
                    self.higher()
                self.path(types=True)
            if not self.opt("+"):
                return

    def generics(self) -> None:
        if self.s[self.p] != "<":
            return
        self.p += 1
        while self.s[self.p] != ">":
            self.attributes()
            if self.opt(K("const")):
                self.name()
                self.need(":")
                self.type_()
                if self.opt("="):
                    self.block() if self.pk() == "{" else self.primary()
            else:
                if not self.opt("'"):
                    self.name()
                if self.opt(":") and self.s[self.p] not in ",>=":
                    self.bounds()
                if self.opt("="):
                    self.type_()
            if not self.opt(","):
                break
        self.need(">")

    def where(self) -> None:
        if self.opt(K("where")):
            while self.s[self.p] not in "{;" + END:
                if not self.opt("'"):
                    if self.pk() == K("for"):
                        self.higher()
                    self.type_()
                self.need(":")
                if self.s[self.p] not in ",{;":
                    self.bounds()
                if not self.opt(","):
                    return

    # -- macros and attributes

    def tree(self) -> None:
        if self.s[self.p] not in "([{":
            self.fail(f"expected the arguments of a macro, found {self.shown()}")
        end = self.closing(self.p)
        if end < 0:
            self.fail("a bracket of a macro is not closed")
        self.p = end + 1

    def attributes(self) -> None:
        while self.s[self.p] == "#" and self.s[self.p + 1] in "![":
            self.p += 1
            self.opt("!")
            if self.pk() != "[":
                self.fail()
            self.tree()

    # -- patterns

    def pattern(self) -> None:
        self.opt("|")
        while True:
            self.pattern_part()
            if not self.opt("|"):
                return

    def pattern_part(self) -> None:
        t = self.s[self.p]
        if t in "0s-" or t in kinds_of("true false"):
            self.range_end()
            if self.s[self.p] in ops_of("..= ... .."):
                self.p += 1
                if self.s[self.p] not in _ENDS and self.s[self.p] not in "|=" + K("if"):
                    self.range_end()
        elif t in ops_of(".. ..="):
            self.p += 1
            if self.s[self.p] in "0s-":
                self.range_end()
        elif t == "&" or t == O("&&"):
            self.p += 1
            self.opt(K("mut"))
            self.pattern_part()
        elif t == "(":
            self.p += 1
            self.closed(")", self.pattern)
        elif t == "[":
            self.p += 1
            self.closed("]", self.pattern)
        elif t in (K("ref"), K("mut")):
            while self.pk() in (K("ref"), K("mut")):
                self.p += 1
            self.name()
            if self.opt("@"):
                self.pattern_part()
        elif t == "<":
            self.qualified()
        else:
            self.path(types=False)
            if self.s[self.p] == "!":
                self.p += 1
                self.tree()
            elif self.opt("@"):
                self.pattern_part()
            elif self.opt("("):
                self.closed(")", self.pattern)
            elif self.s[self.p] == "{":
                self.p += 1
                self.closed("}", self.pattern_field)
            elif self.s[self.p] in ops_of("..= .."):
                self.p += 1
                if self.s[self.p] not in _ENDS:
                    self.range_end()

    def range_end(self) -> None:
        self.opt("-")
        if self.s[self.p] in "0s" or self.s[self.p] in kinds_of("true false"):
            self.p += 1
        else:
            self.path(types=False)

    def pattern_field(self) -> None:
        self.attributes()
        if self.opt(O("..")):
            return
        while self.pk() in (K("ref"), K("mut")):
            self.p += 1
        if not self.opt("0"):
            self.name()
        if self.opt(":"):
            self.pattern()

    # -- expressions

    def infix(self, t: str) -> bool:
        if t == K("as"):
            self.type_()
            return True
        if t == ">":
            self.opt(">")
            self.opt("=")
            return False
        if t in ops_of(".. ..= ...") and (self.pk() in _ENDS or (self.bare and self.pk() == "{")):
            return True
        return False

    def tail(self, t: str) -> bool:
        return False

    def unary(self) -> None:
        while True:
            if self.pk() in self.PREFIX:
                self.p += 1
            elif self.pk() in "&" + O("&&"):
                self.p += 1
                self.opt(K("mut"))
            else:
                break
        if self.pk() in ops_of(".. ..="):
            self.p += 1
            if self.pk() in _ENDS or (self.bare and self.pk() == "{"):
                return
        self.primary()
        self.postfix()

    def primary(self) -> None:
        t = self.pk()
        if t in "0s" or t in kinds_of("true false"):
            self.p += 1
        elif t == "(":
            self.p += 1
            self.inside(")", self.expr)
        elif t == "[":
            self.p += 1
            bare, self.bare = self.bare, False
            if self.pk() != "]":
                self.expr()
                if self.opt(";"):
                    self.expr()
                else:
                    while self.opt(",") and self.pk() != "]":
                        self.expr()
            self.need("]")
            self.bare = bare
        elif t == "{":
            self.block()
        elif t in _BLOCKS or (t == K("async") and "{" in (self.s[self.p + 1], self.s[self.p + 2]) and self.s[self.p + 1] in "{" + K("move")) or (t == K("const") and self.s[self.p + 1] == "{"):
            self.control()
        elif t == "'":
            self.p += 1
            self.need(":")
            self.block() if self.pk() == "{" else self.control()
        elif t in "|" + O("||") + K("move") + K("static") + K("async"):
            while self.pk() in (K("move"), K("static"), K("async")):
                self.p += 1
            if not self.opt(O("||")):
                self.need("|")
                self.closed("|", self.closure_parameter)
            if self.opt(O("->")):
                self.type_()
                self.block()
            else:
                self.expr()
        elif t in kinds_of("return break"):
            self.p += 1
            self.opt("'")
            if self.pk() not in _ENDS and not (self.bare and self.pk() == "{"):
                self.expr()
        elif t == K("continue"):
            self.p += 1
            self.opt("'")
        elif t == "<":
            self.qualified()
        elif t == K("let"):  # a chained condition
            self.p += 1
            self.pattern()
            self.need("=")
            self.expr(4)
        elif t in _PATH or t in "$" + O("::"):
            self.path(types=False)
            if self.pk() == "!" and self.s[self.p + 1] in "([{":
                self.p += 1
                self.tree()
            elif self.pk() == "{" and not self.bare:
                self.p += 1
                self.closed("}", self.field_value)
        else:
            self.fail()

    def closure_parameter(self) -> None:
        self.attributes()
        self.pattern_part()
        if self.opt(":"):
            self.type_()

    def field_value(self) -> None:
        self.attributes()
        if self.opt(O("..")):
            if self.pk() != "}":
                self.expr()
            return
        if not self.opt("0"):
            self.name()
        if self.opt(":"):
            self.expr()

    def postfix(self) -> None:
        while True:
            t = self.pk()
            if t == "(":
                self.p += 1
                self.inside(")", self.expr)
            elif t == "[":
                self.p += 1
                self.inside("]", self.expr)
            elif t == "?":
                self.p += 1
            elif t == ".":
                self.p += 1
                if self.pk() in self.NAMES or self.pk() in "0" + K("await"):
                    self.p += 1
                    if self.pk() == O("::"):
                        self.p += 1
                        self.arguments()
                else:
                    self.fail(f"expected a member name, found {self.shown()}")
            else:
                return

    def headed(self, rule) -> None:
        bare, self.bare = self.bare, True
        rule()
        self.bare = bare

    def control(self) -> None:
        t = self.pk()
        self.p += 1
        if t == K("if"):
            self.headed(self.condition)
            self.block()
            if self.opt(K("else")):
                if self.pk() == K("if"):
                    self.control()
                else:
                    self.block()
        elif t == K("while"):
            self.headed(self.condition)
            self.block()
        elif t == K("for"):
            self.pattern()
            self.need(K("in"))
            self.headed(self.expr)
            self.block()
        elif t == K("match"):
            self.headed(self.expr)
            bare, self.bare = self.bare, False
            self.need("{")
            self.attributes()
            while self.pk() != "}":
                self.attributes()
                self.pattern()
                if self.opt(K("if")):
                    self.expr()
                self.need(O("=>"))
                block = self.pk() == "{"
                if block:
                    self.block()
                    if self.pk() in ".?":
                        self.postfix()
                else:
                    self.expr()
                if not self.opt(",") and not block and self.pk() != "}":
                    self.fail(f"expected a comma after an arm, found {self.shown()}")
            self.p += 1
            self.bare = bare
        elif t == K("async"):
            self.opt(K("move"))
            self.block()
        else:
            self.block()

    def condition(self) -> None:
        self.expr(2)

    def block(self, context: str = "block") -> None:
        bare, self.bare = self.bare, False
        self.braces(context, self.attributes)
        self.bare = bare

    # -- statements and items

    def statement(self, context: str) -> None:
        self.bare = False
        start = self.p
        self.attributes()
        if self.p > start and self.s[self.p] in "}" + END:
            return
        start = self.p
        if self.opt(K("pub")) and self.s[self.p] == "(":
            self.tree()
        visible = self.p > start
        t = self.s[self.p]
        after = self.s[self.p + 1]
        while t in kinds_of("default const async unsafe extern") and after in kinds_of("fn async unsafe extern impl trait const") | frozenset("s"):
            self.p += 1
            self.opt("s")
            t, after = self.s[self.p], self.s[self.p + 1]
        if t == K("extern") and after in "s{":
            self.p += 1
            self.opt("s")
            if self.s[self.p] == "{":
                self.block("items")
                return
            t, after = self.s[self.p], self.s[self.p + 1]
        if t == K("fn"):
            self.p += 1
            self.name()
            self.generics()
            self.need("(")
            self.closed(")", self.parameter)
            if self.opt(O("->")):
                self.type_()
            self.where()
            if not self.opt(";"):
                self.block()
        elif t in (K("struct"), K("enum")) or (t == K("union") and after in "i"):
            self.p += 1
            self.name()
            self.generics()
            self.where()
            if self.opt("{"):
                self.closed("}", self.variant if t == K("enum") else self.field)
            else:
                if t == K("enum"):
                    self.fail(f"expected {{, found {self.shown()}")
                if self.opt("("):
                    self.closed(")", self.tuple_field)
                self.where()
                self.need(";")
        elif t in (K("trait"), K("auto")) and (visible or after in self.NAMES | frozenset(K("trait"))):
            self.opt(K("auto"))
            self.need(K("trait"))
            self.name()
            self.generics()
            if self.opt(":") and self.pk() not in "{" + K("where"):
                self.bounds()
            self.where()
            self.block("items")
        elif t == K("impl"):
            self.p += 1
            self.generics()
            self.opt("!")
            self.type_()
            if self.opt(K("for")):
                self.type_()
            self.where()
            self.block("items")
        elif t == K("mod"):
            self.p += 1
            self.name()
            if not self.opt(";"):
                self.block("items")
        elif t == K("use"):
            self.p += 1
            self.use_tree()
            self.need(";")
        elif t == K("extern") and after == K("crate"):
            self.p += 2
            if not self.opt(K("self")):
                self.name()
            if self.opt(K("as")):
                self.name()
            self.need(";")
        elif t == K("type"):
            self.p += 1
            self.name()
            self.generics()
            if self.opt(":"):
                self.bounds()
            self.where()
            if self.opt("="):
                self.type_()
            self.where()
            self.need(";")
        elif t == K("static") and after not in "|" + O("||") + K("move") or (t == K("const") and after != "{"):
            self.p += 1
            self.opt(K("mut"))
            self.name()
            self.need(":")
            self.type_()
            if self.opt("="):
                self.expr()
            self.need(";")
        elif t == K("macro_rules") and after == "!":
            self.p += 2
            self.name()
            self.tree()
            self.opt(";")
        elif visible:
            self.fail(f"expected an item, found {self.shown()}")
        elif context in ("top", "items"):
            self.path(types=False)
            self.need("!")
            brace = self.s[self.p] == "{"
            self.tree()
            if not brace:
                self.need(";")
        elif t == K("let"):
            self.p += 1
            self.pattern()
            if self.opt(":"):
                self.type_()
            if self.opt("="):
                self.expr()
                if self.opt(K("else")):
                    self.block()
            self.need(";")
        else:
            block = t in _BLOCKS or t == "{" or (t == "'" and after == ":")
            if block:
                if t == "'":
                    self.p += 2
                self.block() if self.s[self.p] == "{" else self.control()
                if self.s[self.p] in ".?":
                    self.postfix()
                    block = False
                elif self.opt(";"):
                    return
            else:
                macro = self.s[self.p] in _PATH
                self.expr()
                block = macro and self.s[self.p - 1] == "}"
            if not block and self.s[self.p] in self.BINARY:
                self.p += 1
                self.expr()
            if not block and self.s[self.p] != "}":
                self.need(";")

    def parameter(self) -> None:
        self.attributes()
        if self.opt(O("...")):
            return
        start = self.p
        if self.pk() == "&":
            self.p += 1
            self.opt("'")
        self.opt(K("mut"))
        if self.opt(K("self")):
            if self.opt(":"):
                self.type_()
            return
        self.p = start
        self.pattern_part()
        self.need(":")
        self.type_()

    def visibility(self) -> None:
        self.attributes()
        if self.opt(K("pub")) and self.s[self.p] == "(" and self.s[self.p + 1] in kinds_of("crate super self in"):
            self.tree()

    def field(self) -> None:
        self.visibility()
        self.name()
        self.need(":")
        self.type_()

    def tuple_field(self) -> None:
        self.visibility()
        self.type_()

    def variant(self) -> None:
        self.visibility()
        self.name()
        if self.opt("{"):
            self.closed("}", self.field)
        elif self.opt("("):
            self.closed(")", self.tuple_field)
        if self.opt("="):
            self.expr()

    def use_tree(self) -> None:
        self.opt(O("::"))
        while True:
            if self.opt("*"):
                return
            if self.opt("{"):
                self.closed("}", self.use_tree)
                return
            if self.pk() not in _PATH:
                self.fail(f"expected a name, found {self.shown()}")
            self.p += 1
            if not self.opt(O("::")):
                break
        if self.opt(K("as")):
            self.name()
