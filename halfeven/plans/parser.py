"""From text to syntax trees.

Expressions are tuples whose first item names the node:
  ("col", qualifier or None, name) ("num", text) ("str", text) ("bool", value) ("null",) ("param", n)
  ("temporal", type name, text) ("now", name) ("neg", x) ("pos", x) ("bin", op, x, y) ("call", name, args)
  ("cast", x, SqlType) ("extract", field, x) ("zone", x, name) ("agg", kind, x or None) ("query", Query)
  ("and", x, y) ("or", x, y) ("not", x) ("cmp", op, x, y) ("isnull", x, negated) ("is", x, truth, negated)
  ("between", x, lo, hi, negated) ("in", x, items, negated) ("inquery", x, Query, negated) ("exists", Query)
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from ..errors import PARAMETERS, SYNTAX, UNSUPPORTED, EngineError
from ..functions.types import BIGINT, BOOLEAN, DATE, SqlType, decimal

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<str>'(?:[^']|'')*')|(?P<op><>|!=|<=|>=|[-+*/%(),.;=<>?]))")

# Words that the dialect knows and refuses, and words that end a list of sources.
REFUSED = {"right", "full", "cross", "natural", "using", "union", "intersect", "except", "with", "over", "offset", "lateral", "any", "all", "some", "like", "case"}
_STOP = {"join", "inner", "left", "on", "where", "group", "having", "order", "limit", "as", "set", "values", *REFUSED}
AGGREGATES = ("count", "sum", "avg", "min", "max")


@dataclass
class Query:
    items: list[tuple[Any, str | None]] = field(default_factory=list)  # ("star",) stands for all columns
    distinct: bool = False
    sources: list[tuple[str, Any, str | None, Any]] = field(default_factory=list)  # (first | inner | left, table name or Query, alias, condition)
    where: Any = None
    group: Any = None
    having: Any = None
    order: tuple[str | None, str, bool] | None = None  # (qualifier, name, descending)
    limit: int | None = None


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise EngineError(SYNTAX, f"unexpected text: {text[at:at + 20].strip()}")
            kind = m.lastgroup
            self.tokens.append((kind, m[kind].lower() if kind == "name" else m[kind]))
            at = m.end()
        while self.tokens and self.tokens[-1] == ("op", ";"):
            self.tokens.pop()
        self.at = self.params = 0

    # tokens

    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + n] if self.at + n < len(self.tokens) else ("end", "")

    def sees(self, *words: str) -> bool:
        return all(self.peek(k) == ("op" if not w[0].isalpha() else "name", w) for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.sees(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise self.wrong(" ".join(words).upper())

    def wrong(self, wanted: str) -> EngineError:
        kind, text = self.peek()
        if kind == "name" and text in REFUSED:
            return EngineError(UNSUPPORTED, f"{text.upper()} is not supported")
        return EngineError(SYNTAX, f"expected {wanted}, found {text or 'the end'}")

    def name(self, what: str = "a name") -> str:
        kind, text = self.peek()
        if kind != "name":
            raise self.wrong(what)
        self.at += 1
        return text

    def number(self) -> int:
        sign = -1 if self.take("-") else 1
        kind, text = self.peek()
        if kind != "num" or "." in text:
            raise self.wrong("a whole number")
        self.at += 1
        return sign * int(text)

    def string(self) -> str:
        kind, text = self.peek()
        if kind != "str":
            raise self.wrong("a text")
        self.at += 1
        return text[1:-1].replace("''", "'")

    def end(self) -> None:
        if self.peek()[0] != "end":
            raise self.wrong("the end")

    # queries

    def query(self) -> Query:
        self.need("select")
        q = Query(distinct=self.take("distinct"))
        while True:
            if self.take("*"):
                q.items.append((("star",), None))
            else:
                x = self.expression()
                alias = self.name() if self.take("as") or self.peek()[0] == "name" and self.peek()[1] not in {*_STOP, "from"} else None
                q.items.append((x, alias))
            if not self.take(","):
                break
        if self.take("from"):
            q.sources.append(("first", *self.source(), None))
            while True:
                if self.take("left"):
                    self.take("outer")
                    self.need("join")
                    kind = "left"
                elif self.take("join") or self.take("inner", "join"):
                    kind = "inner"
                else:
                    break
                what, alias = self.source()
                self.need("on")
                q.sources.append((kind, what, alias, self.expression()))
        if self.take("where"):
            q.where = self.expression()
        if self.take("group"):
            self.need("by")
            q.group = self.expression()
            if self.sees(","):
                raise EngineError(UNSUPPORTED, "GROUP BY takes one key")
        if self.take("having"):
            q.having = self.expression()
        if self.take("order"):
            self.need("by")
            first = self.name()
            q.order = (first, self.name(), False) if self.take(".") else (None, first, False)
            if self.take("desc"):
                q.order = (*q.order[:2], True)
            else:
                self.take("asc")
            if self.sees(","):
                raise EngineError(UNSUPPORTED, "ORDER BY takes one key")
        if self.take("limit"):
            q.limit = self.number()
            if q.limit < 0:
                raise EngineError(SYNTAX, "LIMIT is negative")
        return q

    def source(self) -> tuple[Any, str | None]:
        if self.take("("):
            if not self.sees("select"):
                raise EngineError(UNSUPPORTED, "parentheses hold a query here")
            what: Any = self.query()
            self.need(")")
        else:
            what = self.name("a table")
        alias = self.name() if self.take("as") or self.peek()[0] == "name" and self.peek()[1] not in _STOP else None
        if isinstance(what, Query) and alias is None:
            raise EngineError(SYNTAX, "a derived table needs an alias")
        return what, alias

    # expressions, by rising precedence

    def expression(self):
        x = self._and()
        while self.take("or"):
            x = ("or", x, self._and())
        return x

    def _and(self):
        x = self._not()
        while self.take("and"):
            x = ("and", x, self._not())
        return x

    def _not(self):
        return ("not", self._not()) if self.take("not") else self._predicate()

    def _predicate(self):
        x = self._sum()
        kind, op = self.peek()
        if kind == "op" and op in ("=", "<>", "!=", "<", "<=", ">", ">="):
            self.at += 1
            return ("cmp", "<>" if op == "!=" else op, x, self._sum())
        if self.take("is"):
            negated = self.take("not")
            if self.take("null"):
                return ("isnull", x, negated)
            for truth in ("true", "false", "unknown"):
                if self.take(truth):
                    return ("is", x, truth, negated)
            raise self.wrong("NULL, TRUE, FALSE or UNKNOWN")
        negated = self.take("not")
        if self.take("between"):
            lo = self._sum()
            self.need("and")
            return ("between", x, lo, self._sum(), negated)
        if self.take("in"):
            self.need("(")
            if self.sees("select"):
                q = self.query()
                self.need(")")
                return ("inquery", x, q, negated)
            items = [self._sum()]
            while self.take(","):
                items.append(self._sum())
            self.need(")")
            return ("in", x, items, negated)
        if negated:
            raise self.wrong("BETWEEN or IN")
        return x

    def _sum(self):
        x = self._product()
        while self.peek() in (("op", "+"), ("op", "-")):
            op = self.peek()[1]
            self.at += 1
            x = ("bin", op, x, self._product())
        return x

    def _product(self):
        x = self._unary()
        while self.peek() in (("op", "*"), ("op", "/"), ("op", "%")):
            op = self.peek()[1]
            self.at += 1
            x = ("bin", op, x, self._unary())
        return x

    def _unary(self):
        if self.take("-"):
            return ("neg", self._unary())
        if self.take("+"):
            return ("pos", self._unary())
        x = self._primary()
        while self.take("at", "time", "zone"):
            x = ("zone", x, self.string())
        return x

    def _primary(self):
        kind, text = self.peek()
        if kind == "num":
            self.at += 1
            return ("num", text)
        if kind == "str":
            return ("str", self.string())
        if self.take("?"):
            self.params += 1
            return ("param", self.params - 1)
        if self.take("("):
            if self.sees("select"):
                x = ("query", self.query())
            else:
                x = self.expression()
            self.need(")")
            return x
        if kind != "name" or text in REFUSED:
            raise self.wrong("an expression")
        self.at += 1
        if text in ("true", "false"):
            return ("bool", text == "true")
        if text == "null":
            return ("null",)
        if text in ("current_date", "current_timestamp", "localtime", "localtimestamp"):
            return ("now", text)
        if text in ("date", "time", "timestamp") and self.peek()[0] == "str":
            return ("temporal", text, self.string())
        if text == "timestamp" and self.take("with", "time", "zone"):
            return ("temporal", "timestamptz", self.string())
        if text == "exists" and self.take("("):
            q = self.query()
            self.need(")")
            return ("exists", q)
        if text == "cast" and self.take("("):
            x = self.expression()
            self.need("as")
            to = self.type()
            self.need(")")
            return ("cast", x, to)
        if text == "extract" and self.take("("):
            part = self.name("a field").upper()
            self.need("from")
            x = self._sum()
            self.need(")")
            return ("extract", part, x)
        if self.sees("("):
            self.at += 1
            if text == "count" and self.take("*"):
                self.need(")")
                return ("agg", "count", None)
            if self.sees("distinct"):
                raise EngineError(UNSUPPORTED, f"{text.upper()}(DISTINCT) is not supported")
            args = [self._sum()]
            while self.take(","):
                args.append(self._sum())
            self.need(")")
            return ("agg", text, args[0]) if text in AGGREGATES and len(args) == 1 else ("call", text, args)
        if self.take("."):
            return ("col", text, self.name("a column"))
        return ("col", None, text)

    def type(self) -> SqlType:
        name = self.name("a type")
        sizes = []
        if self.take("("):
            sizes.append(self.number())
            if self.take(","):
                sizes.append(self.number())
            self.need(")")
        if name == "decimal" and len(sizes) == 2 and 1 <= sizes[0] <= 18 and 0 <= sizes[1] <= sizes[0]:
            return decimal(*sizes)
        if name == "varchar" and len(sizes) == 1 and 1 <= sizes[0] <= 255:
            return SqlType("varchar", sizes[0])
        if name in ("time", "timestamp") and len(sizes) <= 1 and all(0 <= s <= 6 for s in sizes):
            zoned = self.take("with", "time", "zone")
            if zoned and name == "time":
                raise EngineError(UNSUPPORTED, "TIME WITH TIME ZONE")
            return SqlType("timestamptz" if zoned else name, sizes[0] if sizes else 6)
        for t in (BIGINT, BOOLEAN, DATE):
            if name == t.name and not sizes:
                return t
        raise EngineError(UNSUPPORTED, f"no type {name.upper()}{tuple(sizes) if sizes else ''}")


def parse_query(text: str) -> tuple[Query, int]:
    """A query and the number of its parameters."""
    p = Parser(text)
    q = p.query()
    p.end()
    return q, p.params


def need_parameters(expected: int, given: int) -> None:
    if expected != given:
        raise EngineError(PARAMETERS, f"{expected} parameters are needed, {given} given")
