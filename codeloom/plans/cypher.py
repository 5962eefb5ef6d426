"""A subset of Cypher, compiled to DataFrames over a graph.

``MATCH`` with node and edge patterns, several kinds, property maps and bounded
or unbounded lengths; ``OPTIONAL MATCH``; ``WHERE`` with comparisons, text and
list predicates and (negated) patterns; ``WITH``, ``UNWIND``, ``RETURN`` with
aggregates, ``DISTINCT``, ``ORDER BY``, ``SKIP`` and ``LIMIT``.  Parameters are
``$name`` and are never spliced into text.  Every hop is an equi-join; a pattern
predicate is a semi or anti join; a length of more than one is a closure, so it
yields each pair of ends once, with the least length.  Anything else is a
``CypherError`` that names the place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.graph import NODE_COLUMNS, Graph
from codeloom.operators import traversal

_TOKEN = re.compile(r"\s*(?:(?P<s>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<n>\d+\.\d+|\d+(?!\.\d))|(?P<p>\$\w+)|(?P<w>[A-Za-z_]\w*|`[^`]+`)|(?P<o><>|<=|>=|=~|\.\.|->|<-|[-+*/%()\[\]{},.:|=<>]))")
_AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
_RESERVED = {"match", "optional", "where", "with", "return", "order", "by", "limit", "skip", "unwind", "as", "and", "or", "not", "in", "is", "null", "contains", "starts", "ends", "distinct", "case", "when", "then", "else", "end", "asc", "desc", "true", "false", "xor"}
#: No walk is longer than the nodes it visits; a closure ends when a level is empty.
UNBOUNDED = 1 << 30


class CypherError(ValueError):
    pass


def kind_of(label: str) -> str:
    """``TypeAlias`` as ``TYPE_ALIAS``."""
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "_", label).upper()


@dataclass
class Node:
    name: str
    kinds: list[str] = field(default_factory=list)
    equal: list[tuple[str, object]] = field(default_factory=list)


@dataclass
class Hop:
    name: str
    kinds: list[str]
    low: int
    high: int
    forward: bool
    both: bool
    many: bool


class Compiler:
    def __init__(self, g: Graph, text: str, values: dict):
        self.g, self.text, self.values = g, text, values
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise CypherError(f"cannot read {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup or "", m.group(m.lastgroup), m.start(m.lastgroup)))
            at = m.end()
        self.p, self.fresh = 0, 0
        self.rows: DataFrame | None = None
        self.nodes: set[str] = set()
        self.hops: set[str] = set()
        self.scalars: set[str] = set()
        self.aggregated = False

    # -- tokens

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.p + ahead][1] if self.p + ahead < len(self.tokens) else ""

    def word(self, *words: str) -> bool:
        """Read these words, in any case, if they come."""
        for i, w in enumerate(words):
            if self.peek(i).lower() != w or self.tokens[self.p + i][0] != "w":
                return False
        self.p += len(words)
        return True

    def op(self, sign: str) -> bool:
        if self.peek() == sign and self.tokens[self.p][0] == "o":
            self.p += 1
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.op(sign):
            self.fail(f"expected {sign}")

    def fail(self, message: str):
        at = self.tokens[self.p][2] if self.p < len(self.tokens) else len(self.text)
        raise CypherError(f"{message} at {self.text[at:at + 20]!r}")

    def name(self) -> str:
        kind, text, _ = self.tokens[self.p] if self.p < len(self.tokens) else ("", "", 0)
        if kind != "w":
            self.fail("expected a name")
        self.p += 1
        return text.strip("`")

    def hidden(self) -> str:
        self.fresh += 1
        return f"_{self.fresh}"

    # -- patterns

    def node(self) -> Node:
        self.need("(")
        out = Node(self.name() if self.tokens[self.p][0] == "w" else self.hidden())
        while self.op(":"):
            out.kinds.append(kind_of(self.name()))
            while self.op("|"):
                self.op(":")
                out.kinds.append(kind_of(self.name()))
        if self.op("{"):
            while not self.op("}"):
                key = self.name()
                self.need(":")
                out.equal.append((key, self.expression()))
                self.op(",")
        self.need(")")
        return out

    def hop(self) -> Hop:
        back = self.op("<-")
        if not back:
            self.need("-")
        name, kinds, low, high, many = self.hidden(), [], 1, 1, False
        if self.op("["):
            if self.tokens[self.p][0] == "w":
                name = self.name()
            if self.op(":"):
                kinds.append(self.name())
                while self.op("|"):
                    self.op(":")
                    kinds.append(self.name())
            if self.op("*"):
                many = True
                low, high = 1, UNBOUNDED
                number = lambda: int(self.tokens[self.p][1]) if self.tokens[self.p][0] == "n" else None
                if (n := number()) is not None:
                    self.p += 1
                    low = high = n
                if self.op(".."):
                    high = UNBOUNDED
                    if (n := number()) is not None:
                        self.p += 1
                        high = n
            self.need("]")
        ahead = self.op("->")
        if not ahead:
            self.need("-")
        return Hop(name, [k.upper() for k in kinds], low, high, not back, ahead == back, many)

    def path(self) -> list:
        out: list = [self.node()]
        while self.peek() in ("-", "<-"):
            out += [self.hop(), self.node()]
        return out

    def scan(self, n: Node, prefix: str) -> DataFrame:
        rows = self.g.nodes
        if n.kinds:
            rows = rows.where(F.col("kind").isin(*n.kinds))
        return rows.select(*[F.col(c).alias(f"{prefix}__{c}") for c in ("id", *NODE_COLUMNS)])

    def check(self, rows: DataFrame, n: Node) -> DataFrame:
        for key, value in n.equal:
            rows = rows.where(F.col(f"{n.name}__{key}") == value)
        return rows

    def edges(self, h: Hop) -> DataFrame:
        e = self.g.edges if not h.kinds else self.g.edges.where(F.col("kind").isin(*h.kinds))
        return e.select("src", "dst", "kind", "confidence", "line_number", "callee_name")

    def chain(self, path: list, rows: DataFrame | None, bound: set[str], optional: bool = False) -> DataFrame:
        """Join a path to what is bound so far."""
        first = path[0]
        how = "left" if optional else "inner"
        if rows is None:
            rows = self.check(self.scan(first, first.name), first)
        elif first.name not in bound:
            if any(isinstance(n, Node) and n.name in bound for n in path[1:]):
                return self.chain(self.reversed(path), rows, bound, optional)
            rows = rows.join(self.check(self.scan(first, first.name), first), how="left" if optional else "cross")
        elif first.kinds and not optional:
            rows = rows.where(F.col(f"{first.name}__kind").isin(*first.kinds))
        bound.add(first.name)
        here = first.name
        for h, n in zip(path[1::2], path[2::2]):
            pairs = self.pairs(h, rows, here)
            if n.name in bound:
                pairs = pairs.withColumnsRenamed({"_a": f"{here}__id", "_b": f"{n.name}__id"})
                rows = rows.join(pairs, [f"{here}__id", f"{n.name}__id"], how)
            else:
                target = self.check(self.scan(n, n.name), n)
                rows = rows.join(pairs.join(target, F.col("_b") == F.col(f"{n.name}__id")).drop("_b").withColumnRenamed("_a", f"{here}__id"), f"{here}__id", how)
                bound.add(n.name)
            here = n.name
        return rows

    def reversed(self, path: list) -> list:
        turn = lambda h: Hop(h.name, h.kinds, h.low, h.high, not h.forward, h.both, h.many)
        return [turn(x) if isinstance(x, Hop) else x for x in path[::-1]]

    def pairs(self, h: Hop, rows: DataFrame, here: str) -> DataFrame:
        """``_a, _b`` and the columns of a hop: both ends of an edge, or of a walk."""
        e = self.edges(h)
        if h.many:
            links = e.select("src", "dst").distinct()
            if h.both:
                links = links.unionByName(traversal.reverse(links)).distinct()
            elif not h.forward:
                links = traversal.reverse(links)
            roots = rows.select(F.col(f"{here}__id").alias("root")).where(F.col("root").isNotNull()).distinct()
            walked = traversal.closure(links, roots, h.high, itself=h.low == 0).where(F.col("depth") >= h.low)
            return walked.select(F.col("root").alias("_a"), F.col("id").alias("_b"), F.col("depth").alias(f"{h.name}__depth"))
        extra = [F.col(c).alias(f"{h.name}__{c}") for c in ("kind", "confidence", "line_number", "callee_name")]
        a, b = ("src", "dst") if h.forward else ("dst", "src")
        out = e.select(F.col(a).alias("_a"), F.col(b).alias("_b"), *extra)
        return out.unionByName(e.select(F.col(b).alias("_a"), F.col(a).alias("_b"), *extra)) if h.both else out

    # -- expressions

    def expression(self) -> Column:
        left = self.conjunction()
        while self.word("or"):
            left = left | self.conjunction()
        return left

    def conjunction(self) -> Column:
        left = self.negation()
        while self.word("and"):
            left = left & self.negation()
        return left

    def negation(self) -> Column:
        return ~self.negation() if self.word("not") else self.comparison()

    def comparison(self) -> Column:
        left = self.sum()
        for sign, rule in (("=", lambda a, b: a == b), ("<>", lambda a, b: a != b), ("<=", lambda a, b: a <= b), (">=", lambda a, b: a >= b), ("<", lambda a, b: a < b), (">", lambda a, b: a > b)):
            if self.op(sign):
                return rule(left, self.sum())
        if self.op("=~"):
            return F.rlike(left, F.concat(F.lit("^(?:"), self.sum(), F.lit(")$")))
        if self.word("contains"):
            return left.contains(self.sum())
        if self.word("starts", "with"):
            return left.startswith(self.sum())
        if self.word("ends", "with"):
            return left.endswith(self.sum())
        if self.word("in"):
            return F.array_contains(self.sum(), left)
        if self.word("is", "not", "null"):
            return left.isNotNull()
        if self.word("is", "null"):
            return left.isNull()
        return left

    def sum(self) -> Column:
        left = self.product()
        while self.peek() in ("+", "-") and self.tokens[self.p][0] == "o":
            left = left + self.product() if self.op("+") else left - (self.need("-") or self.product())
        return left

    def product(self) -> Column:
        left = self.value()
        while self.peek() in ("*", "/", "%") and self.tokens[self.p][0] == "o":
            left = left * self.value() if self.op("*") else left / self.value() if self.op("/") else left % (self.need("%") or self.value())
        return left

    def value(self) -> Column:
        kind, text, _ = self.tokens[self.p] if self.p < len(self.tokens) else ("", "", 0)
        if kind == "s":
            self.p += 1
            return F.lit(re.sub(r"\\(.)", r"\1", text[1:-1]))
        if kind == "n":
            self.p += 1
            return F.lit(float(text) if "." in text else int(text))
        if kind == "p":
            self.p += 1
            if text[1:] not in self.values:
                self.fail(f"no value for {text}")
            v = self.values[text[1:]]
            return F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
        if self.op("-"):
            return -self.value()
        if self.op("("):
            out = self.expression()
            self.need(")")
            return out
        if self.op("["):
            items = []
            while not self.op("]"):
                items.append(self.expression())
                self.op(",")
            return F.array(*items)
        if kind != "w":
            self.fail("expected a value")
        for literal, v in (("true", True), ("false", False), ("null", None)):
            if self.word(literal):
                return F.lit(v)
        if self.word("case"):
            return self.case()
        name = self.name()
        if self.op("("):
            return self.function(name.lower())
        if self.op("."):
            key = self.name()
            if name not in self.nodes | self.hops:
                self.fail(f"{name} is not bound")
            return F.col(f"{name}__{key}")
        if name in self.nodes:
            return F.col(f"{name}__id")
        if name in self.scalars:
            return F.col(name)
        self.fail(f"{name} is not bound")

    def case(self) -> Column:
        out, subject = F, None
        if self.peek().lower() != "when":
            subject = self.expression()
        while self.word("when"):
            test = self.expression()
            if not self.word("then"):
                self.fail("expected THEN")
            out = out.when(test if subject is None else subject == test, self.expression())
        if self.word("else"):
            out = out.otherwise(self.expression())
        if not self.word("end"):
            self.fail("expected END")
        return out

    def function(self, name: str) -> Column:
        if name in _AGGREGATES:
            self.aggregated = True
            if name == "count" and self.op("*"):
                self.need(")")
                return F.count("*")
            distinct = self.word("distinct")
            x = self.expression()
            self.need(")")
            if name == "collect":
                return F.array_sort(F.collect_set(x) if distinct else F.collect_list(x))
            if name == "count":
                return F.countDistinct(x) if distinct else F.count(x)
            return {"sum": F.sum_distinct if distinct else F.sum, "avg": F.avg, "min": F.min, "max": F.max}[name](x)
        if name in ("type", "labels", "length", "id"):
            var = self.name()
            self.need(")")
            column = {"type": "kind", "labels": "kind", "length": "depth", "id": "id"}[name]
            return F.array(F.col(f"{var}__{column}")) if name == "labels" else F.col(f"{var}__{column}")
        args = []
        while not self.op(")"):
            args.append(self.expression())
            self.op(",")
        rules = {
            "size": lambda x: F.size(x), "coalesce": lambda *x: F.coalesce(*x), "tointeger": lambda x: F.try_to_number(x.cast("string"), F.lit("S999999999999")).cast("long"), "tostring": lambda x: x.cast("string"),
            "tolower": lambda x: F.lower(x), "toupper": lambda x: F.upper(x), "trim": lambda x: F.trim(x), "split": lambda x, y: F.split_part(x, y, F.lit(1)), "abs": lambda x: F.abs(x), "round": lambda x, n=F.lit(0): F.round(x, 0),
            "head": lambda x: F.try_element_at(x, F.lit(1)), "last": lambda x: F.try_element_at(x, F.lit(-1)), "replace": lambda x, a, b: F.replace(x, a, b), "substring": lambda x, a, b: F.substr(x, a + 1, b),
        }
        if name not in rules:
            self.fail(f"no function {name}")
        return rules[name](*args)

    # -- clauses

    def predicate_pattern(self) -> tuple[bool, list] | None:
        """``NOT (pattern)`` or a pattern alone, if one comes."""
        at = self.p
        negated = self.word("not")
        wrapped = self.word("exists") and self.op("(") if self.peek().lower() == "exists" else False
        if self.peek() == "(":
            try:
                path = self.path()
                if len(path) > 1:
                    if wrapped:
                        self.need(")")
                    return negated, path
            except (CypherError, IndexError):
                pass
        self.p = at
        return None

    def where(self) -> None:
        """Conjuncts that are patterns become semi and anti joins, the others filters."""
        while True:
            pattern = self.predicate_pattern()
            if pattern:
                negated, path = pattern
                anchor = next((n.name for n in path if isinstance(n, Node) and n.name in self.nodes), None)
                if anchor is None:
                    self.fail("a pattern predicate needs a bound node")
                if isinstance(path[0], Node) and path[0].name != anchor:
                    path = self.reversed(path)
                if path[0].name != anchor:
                    self.fail("a bound node must be at an end of a pattern predicate")
                ids = self.rows.select(f"{anchor}__id").distinct()
                found = self.chain(path, ids, {anchor}).select(f"{anchor}__id").distinct()
                self.rows = self.rows.join(found, f"{anchor}__id", "left_anti" if negated else "left_semi")
            else:
                rule = self.negation()
                while self.word("or"):
                    rule = rule | self.conjunction()
                self.rows = self.rows.where(rule)
            if not self.word("and"):
                return

    def items(self) -> list[tuple[str, Column, bool]]:
        out = []
        while True:
            start, self.aggregated = self.p, False
            x = self.expression()
            end = self.p
            alias = self.name() if self.word("as") else "".join(t for _, t, _ in self.tokens[start:end])
            out.append((alias, x, self.aggregated))
            if not self.op(","):
                return out

    def project(self, final: bool) -> None:
        distinct = self.word("distinct")
        start = self.p
        items = self.items()
        if self.rows is None:
            self.fail("nothing is bound")
        kept: list[str] = []
        if not final:  # nodes that are passed on keep their columns
            named = {t[1] for t in self.tokens[start : self.p]}
            kept = [c for n in self.nodes & named if any(a == n for a, _, _ in items) for c in self.rows.columns if c.startswith(n + "__")]
        plain = [(a, x) for a, x, agg in items if not agg and not (a in self.nodes and kept)]
        if any(agg for *_, agg in items):
            keys = [x.alias(a) for a, x in plain] + [F.col(c) for c in kept]
            rows = self.rows.groupBy(*keys).agg(*[x.alias(a) for a, x, agg in items if agg]) if keys else self.rows.agg(*[x.alias(a) for a, x, agg in items if agg])
            rows = rows.select(*[a for a, *_ in items if a in rows.columns], *kept)
        elif final and self.word("order", "by") and not distinct:
            self.p -= 2
            rows = self.rows.withColumns({f"{a}": x for a, x, _ in items})
        else:
            rows = self.rows.select(*[x.alias(a) for a, x in plain], *kept)
        rows = rows.distinct() if distinct else rows
        self.rows, self.scalars = rows, {a for a, *_ in items}
        if not final:
            self.nodes = {a for a, *_ in items if f"{a}__id" in rows.columns}
            self.hops = set()
        if self.word("order", "by"):
            order = []
            while True:
                x = self.expression()
                order.append(F.desc_nulls_last(x) if self.word("desc") else (self.word("asc"), F.asc_nulls_first(x))[1])
                if not self.op(","):
                    break
            self.rows = self.rows.orderBy(*order)
        if self.word("skip"):
            self.rows = self.rows.offset(int(self.tokens[self.p][1]))
            self.p += 1
        if self.word("limit"):
            kind, text, _ = self.tokens[self.p]
            self.rows = self.rows.limit(int(self.values[text[1:]] if kind == "p" else text))
            self.p += 1
        if final:
            self.rows = self.rows.select(*[F.col(f"`{a}`") for a, *_ in items])
        elif self.word("where"):
            self.where()

    def run(self) -> DataFrame:
        while self.p < len(self.tokens):
            if self.word("optional", "match") or self.word("match"):
                optional = self.tokens[self.p - 2][1].lower() == "optional" if self.p >= 2 else False
                while True:
                    path = self.path()
                    self.rows = self.chain(path, self.rows, self.nodes, optional)
                    self.hops |= {h.name for h in path[1::2]}
                    if not self.op(","):
                        break
                if self.word("where"):
                    self.where()
            elif self.word("unwind"):
                values = self.value()
                if not self.word("as"):
                    self.fail("expected AS")
                name = self.name()
                base = self.rows if self.rows is not None else self.g.raw_nodes.sparkSession.range(1).select()
                self.rows = base.withColumn(name, F.explode(values))
                self.scalars.add(name)
            elif self.word("with"):
                self.project(False)
            elif self.word("return"):
                self.project(True)
                if self.p < len(self.tokens):
                    self.fail("unexpected text after RETURN")
                return self.rows
            else:
                self.fail("expected a clause")
        raise CypherError("a query must end with RETURN")


def cypher(g: Graph, text: str, **values) -> DataFrame:
    """The rows of a query; columns are named by their aliases or texts."""
    return Compiler(g, text, values).run()
