"""JSON, read without recursion so that no depth is too much."""

from __future__ import annotations

from codeloom.llm.syntax.base import END, NAME, Lexer, kinds_of, spelled

_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.+-])"

JSON_LEXER = Lexer([_STRING, _NUMBER, NAME, r"[^\S \t\r\n]"], "true false null", "", "{}[]:,", lambda t: "0" if t[0] == "-" and len(t) > 1 else None)

_SCALARS = frozenset("0s") | kinds_of("true false null")


class Json:
    """A value after another with a stack of what is open; after an error it goes on at the next comma or closing bracket."""

    def __init__(self, kinds: str):
        self.s = kinds + END

    def run(self) -> list[tuple[int, str]]:
        s, p, state, stack, errors = self.s, 0, "value", [], []
        while True:
            t = s[p]
            if state == "after":
                if not stack:
                    if t != END:
                        errors.append((p, f"unexpected {spelled(t)} after the value"))
                    return errors
                if t == ",":
                    state, p = ("key" if stack[-1] == "}" else "value"), p + 1
                    continue
                if t == stack[-1]:
                    stack.pop()
                    p += 1
                    continue
            elif state in ("value", "first value"):
                if t in "{[":
                    stack.append("}" if t == "{" else "]")
                    state, p = ("first key" if t == "{" else "first value"), p + 1
                    continue
                if t in _SCALARS:
                    state, p = "after", p + 1
                    continue
                if t == "]" and state == "first value":
                    state = "after"
                    continue
            elif state in ("key", "first key"):
                if t == "s" and s[p + 1] == ":":
                    state, p = "value", p + 2
                    continue
                if t == "}" and state == "first key":
                    state = "after"
                    continue
                if t == "s":
                    p += 1
            errors.append((p, f"unexpected {spelled(s[p])}" + (f", expected a comma or {stack[-1]}" if state == "after" else "")))
            depth = 0
            while s[p] != END and (depth or s[p] not in ",}]"):
                depth += (s[p] in "{[") - (s[p] in "}]")
                p += 1
            if s[p] == END:
                return errors
            if s[p] != "," and stack and s[p] != stack[-1]:
                p += 1
            elif s[p] != "," and not stack:
                p += 1
            elif s[p] == "," and not stack:
                return errors
            state = "after"
