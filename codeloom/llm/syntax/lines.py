"""What languages share whose statements end with their lines."""

from __future__ import annotations

import re

from codeloom.llm.syntax.base import END, Parser, spelled


def fold_before(kinds: str):
    """A function that drops the line ends before tokens of these kinds, which go on with the line above."""
    pattern = re.compile(r"\n+(?=[" + "".join(map(re.escape, sorted(kinds))) + "])")
    return lambda text: pattern.sub("", text)


class Lines(Parser):
    def end(self) -> None:
        """The end of a statement: a line end, a semicolon, or what closes the block."""
        if self.s[self.p] in ";\n":
            self.p += 1
        elif self.s[self.p] not in "})" + END:
            self.fail(f"expected end of statement, found {self.shown()}")

    def shown(self) -> str:
        return spelled(self.s[self.p])

    def skip_to(self, kinds) -> bool:
        """Go over line ends if one of these kinds follows them."""
        p = self.p
        while self.s[p] == "\n":
            p += 1
        if self.s[p] in kinds:
            self.p = p
            return True
        return False

    def braces(self, context: str, rule=None) -> None:
        """A block with its own line ends, also inside parentheses."""
        d, self.d = self.d, 0
        self.nls()
        self.need("{")
        if rule:
            rule()
        self.statements(context, "}")
        if self.s[self.p] != "}":
            self.fail("missing }")
        self.p += 1
        self.d = d

    def closed(self, close: str, item) -> None:
        """``listed`` after its opening bracket; on failure the depth is as before."""
        d = self.d
        try:
            self.listed(close, item)
        finally:
            self.d = d
