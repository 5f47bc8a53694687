"""From syntax trees to Spark SQL.

A query becomes one Spark SQL statement over temp views, with every type derived here and written out
as a cast or check where Spark's own rule differs.  What to scan, push down, join and how is left to
Catalyst and adaptive execution.  Every source has an alias of its own (s1, s2, ...), so correlated
references cannot be mistaken.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from ..errors import MISMATCH, SYNTAX, UNDEFINED, UNSUPPORTED, EngineError
from ..functions import exact, temporal
from ..functions import types as ty
from ..functions.exact import Typed
from ..functions.types import BIGINT, BOOLEAN, DATE, NULL, SqlType
from .parser import Query

Columns = list[tuple[str, SqlType]]


@dataclass
class Relation:
    """What a name stands for: Spark SQL of a source, its columns, and its primary key if it has one."""

    sql: str
    columns: Columns
    key: str | None = None


@dataclass
class Source:
    alias: str
    name: str
    relation: Relation

    def column(self, name: str) -> Typed | None:
        for column, kind in self.relation.columns:
            if column == name:
                return Typed(f"{self.alias}.`{name}`", kind, True)
        return None


@dataclass
class Scope:
    sources: list[Source] = field(default_factory=list)
    parent: Scope | None = None
    #: Sources of the parent that this block reads again, because a block inside it refers to them.
    taken: dict[str, Source] = field(default_factory=dict)

    def find(self, qualifier: str | None, name: str) -> Typed | None:
        for sources in (self.sources, self.taken.values()):
            found = [c for s in sources if qualifier in (None, s.name) and (c := s.column(name))]
            if len(found) > 1:
                raise EngineError(SYNTAX, f"{name} is ambiguous")
            if found:
                return found[0]
        return None


class Compiler:
    def __init__(self, resolve: Callable[[str], Relation], parameters: tuple = (), zone: str = "UTC", now: dt.datetime | None = None):
        self.resolve, self.parameters, self.zone = resolve, parameters, zone
        self.now = now or dt.datetime.now(dt.timezone.utc)
        self.aliases = 0

    # blocks

    def query(self, q: Query, parent: Scope | None = None, subquery: bool = False) -> Relation:
        """Spark SQL of a block and its output columns."""
        taken: dict[str, Source] = {}
        while True:
            aliases = self.aliases
            scope = Scope(parent=parent, taken=dict(taken))
            out = self._block(q, scope, subquery)
            if scope.taken.keys() == taken.keys():
                return out
            taken, self.aliases = scope.taken, max(aliases, self.aliases)

    def _source(self, what: Any, alias: str | None, scope: Scope) -> Source:
        self.aliases += 1
        if isinstance(what, Query):
            relation = self.query(what)
            relation = Relation(f"({relation.sql})", relation.columns)
        else:
            relation = self.resolve(what)
        name = alias or what
        if any(s.name == name for s in scope.sources):
            raise EngineError(SYNTAX, f"two sources are named {name}")
        source = Source(f"s{self.aliases}", name, relation)
        scope.sources.append(source)
        return source

    def _block(self, q: Query, scope: Scope, subquery: bool) -> Relation:
        text = []
        for kind, what, alias, on in q.sources:
            source = self._source(what, alias, scope)
            named = f"{source.relation.sql} {source.alias}"
            text.append(named if kind == "first" else f"{kind.upper()} JOIN {named} ON {self.condition(on, scope)}")
        aggregated = any(_has_aggregate(x) for x, _ in q.items) or q.group is not None or q.having is not None
        items = self._items(q, scope, subquery)
        if q.distinct and len(items) != 1:
            raise EngineError(UNSUPPORTED, "DISTINCT takes one expression")
        where = [self.condition(q.where, scope)] if q.where is not None else []
        group = self.value(q.group, scope) if q.group is not None else None
        if group is not None and group.type == BOOLEAN and q.group[0] != "col":
            raise EngineError(MISMATCH, "a computed BOOLEAN is no group key")
        having = self.condition(_with_aliases(q.having, q.items), scope) if q.having is not None else None
        for name, source in scope.taken.items():
            outer = next(s for s in [*scope.parent.sources, *scope.parent.taken.values()] if s.name == name)
            keys = [source.relation.key] if source.relation.key else [c for c, _ in source.relation.columns]
            where += [f"{source.alias}.`{k}` <=> {outer.alias}.`{k}`" for k in keys]
        if len({n for n, _, _ in items}) != len(items):
            raise EngineError(SYNTAX, "two output columns have one name")
        sql = "SELECT " + ("DISTINCT " if q.distinct else "") + ", ".join(f"{x.sql} AS `{n}`" for n, x, _ in items)
        sources = [" ".join(text), *[f"{s.relation.sql} {s.alias}" for s in scope.taken.values()]]
        if text:
            sql += " FROM " + ", ".join(sources)
        if where:
            sql += " WHERE " + " AND ".join(f"({w})" for w in where)
        if group is not None:
            sql += f" GROUP BY {group.sql}"
        if having is not None:
            sql += f" HAVING {having}"
        if q.order is not None:
            sql += " ORDER BY " + self._order(q, scope, items, aggregated)
        if q.limit is not None:
            sql += f" LIMIT {q.limit}"
        return Relation(sql, [(n, x.type) for n, x, _ in items])

    def _items(self, q: Query, scope: Scope, subquery: bool) -> list[tuple[str, Typed, Any]]:
        out = []
        for x, alias in q.items:
            if x == ("star",):
                if len(q.sources) != 1 or isinstance(q.sources[0][1], Query) or subquery:
                    raise EngineError(UNSUPPORTED, "SELECT * takes one table or view")
                out += [(c, scope.sources[0].column(c), ("col", None, c)) for c, _ in scope.sources[0].relation.columns]
                continue
            if _has(x, ("query", "exists", "inquery")):
                raise EngineError(UNSUPPORTED, "subqueries stand in WHERE, ON and HAVING only")
            if alias is None:
                alias = x[2] if x[0] == "col" else x[1] if x[0] == "agg" else "null" if x[0] == "null" else "expression"
            value = self.value(x, scope)
            if value.type == NULL:
                value = Typed(f"CAST({value.sql} AS BIGINT)", BIGINT)
            out.append((alias, value, x))
        return out

    def _order(self, q: Query, scope: Scope, items: list, aggregated: bool) -> str:
        qualifier, name, down = q.order
        way = "DESC" if down else "ASC"
        chosen = next((x for n, x, _ in items if n == name), None) if qualifier is None else None
        if chosen is None:
            if q.distinct or aggregated or len(scope.sources) > 1:
                raise EngineError(UNSUPPORTED, "ORDER BY names an output column here")
            chosen = self.value(("col", qualifier, name), scope)
        if chosen.type == BOOLEAN:
            raise EngineError(MISMATCH, "BOOLEAN has no order")
        key = f"`{name}`" if q.distinct or aggregated else chosen.sql
        ties = []
        if not (q.distinct or aggregated) and len(scope.sources) == 1 and (k := scope.sources[0].relation.key):
            ties = [f"{scope.sources[0].alias}.`{k}` {way}"]
        return ", ".join([f"{key} {way}", *ties])

    # expressions

    def truth(self, x: Any, scope: Scope) -> str:
        return self._truth(x, scope).sql

    def _truth(self, x: Any, scope: Scope) -> Typed:
        out = self.value(x, scope)
        if out.type not in (BOOLEAN, NULL):
            raise EngineError(MISMATCH, f"a condition is needed, not {out.type.shown}")
        return Typed(f"CAST({out.sql} AS BOOLEAN)", BOOLEAN, True) if out.type == NULL else out

    def condition(self, x: Any, scope: Scope) -> str:
        """A condition of which only the truth counts (WHERE, ON, HAVING): unknown may stand as false."""
        return _conjunction([self._member(part, scope) or self._truth(part, scope) for part in _flat("and", x)]).sql

    def _member(self, x: Any, scope: Scope) -> Typed | None:
        """[NOT] IN (SELECT ...) as a semi or anti join on its key; None for other conditions.

        Catalyst's own join for NOT IN broadcasts the subquery whatever its size, so it becomes an anti join and two
        tests: whether the subquery has a row, and whether it has a null.
        """
        if x[0] == "not" and x[1][0] == "inquery":
            x = (*x[1][:3], not x[1][3])
        if x[0] != "inquery" or _has_aggregate(x[1]):
            return None
        if not x[3]:
            return self._in_rows(scope, x[1], x[2])
        a, found, empty, null = self._membership(scope, x[1], x[2])
        return Typed(f"(({empty} OR ({a.sql} IS NOT NULL AND NOT {null})) AND NOT {found})", BOOLEAN, a.safe)

    def _membership(self, scope: Scope, x: Any, q: Query) -> tuple[Typed, str, str, str]:
        """x, and as conditions: the query has x; it has no row; it has a null."""
        a, b = self.value(x, scope), self.query(q, scope, True)
        if len(b.columns) != 1:
            raise EngineError(SYNTAX, "IN takes a query of one column")
        name, kind = b.columns[0]
        ty.comparable(a.type, kind)
        self.aliases += 1
        rows, column = f"({b.sql}) s{self.aliases}", f"s{self.aliases}.`{name}`"
        inner = self.value(x, Scope(parent=scope))  # x inside the subquery, one level deeper
        x_sql = f"CAST(NULL AS {kind.spark})" if inner.type == NULL else inner.sql
        return a, f"EXISTS (SELECT 1 FROM {rows} WHERE {column} = {x_sql})", f"NOT EXISTS (SELECT 1 FROM {rows})", f"EXISTS (SELECT 1 FROM {rows} WHERE {column} IS NULL)"

    def _column(self, scope: Scope | None, qualifier: str | None, name: str) -> Typed:
        block = scope
        while block is not None:
            if found := block.find(qualifier, name):
                break
            block = block.parent
        else:
            raise EngineError(UNDEFINED, f"no column {f'{qualifier}.' if qualifier else ''}{name}")
        # Catalyst correlates one level: the blocks between read an older ancestor's source again, tied by its key
        path = []
        at = scope
        while at is not block:
            path.append(at)
            at = at.parent
        owner = next(s for s in [*block.sources, *block.taken.values()] if qualifier in (None, s.name) and s.column(name))
        for between in reversed(path[1:]):
            if owner.name not in between.taken:
                self.aliases += 1
                between.taken[owner.name] = Source(f"s{self.aliases}", owner.name, owner.relation)
            owner = between.taken[owner.name]
        return owner.column(name)

    def value(self, x: Any, scope: Scope | None) -> Typed:
        return getattr(self, f"_{x[0]}_")(scope, *x[1:])

    def _col_(self, scope, qualifier, name):
        return self._column(scope, qualifier, name)

    def _num_(self, scope, text):
        if "." in text:
            whole, fraction = text.split(".")
            digits = len(whole.lstrip("0") + fraction)
            return Typed(f"CAST('{text}' AS DECIMAL({max(digits, len(fraction), 1)},{len(fraction)}))", ty.decimal(max(digits, len(fraction), 1), len(fraction)), True)
        return Typed(f"{int(text)}L", BIGINT, True)

    def _str_(self, scope, text):
        return Typed("'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'", SqlType("varchar", max(1, len(text))), True)

    def _bool_(self, scope, value):
        return Typed(str(value).upper(), BOOLEAN, True)

    def _null_(self, scope):
        return Typed("CAST(NULL AS BIGINT)", NULL, True)

    def _param_(self, scope, n):
        value = self.parameters[n]
        if value is None:
            return self._null_(scope)
        if isinstance(value, bool):
            return self._bool_(scope, value)
        if isinstance(value, int):
            return Typed(f"{value}L", BIGINT, True)
        if isinstance(value, Decimal):
            sign, digits, e = value.as_tuple()
            s = max(0, -e)
            p = max(len(digits) + max(0, e), s, 1)
            return Typed(f"CAST('{value:f}' AS DECIMAL({p},{s}))", ty.decimal(p, s), True)
        if isinstance(value, str):
            return self._str_(scope, value)
        if isinstance(value, dt.datetime):
            return temporal.literal("timestamptz", value.isoformat(sep=" ", timespec="microseconds")) if value.tzinfo else temporal.literal("timestamp", value.isoformat(sep=" ", timespec="microseconds"))
        if isinstance(value, (dt.date, dt.time)):
            return temporal.literal("date" if isinstance(value, dt.date) else "time", value.isoformat())
        raise EngineError(MISMATCH, f"no type for parameters like {value!r}")

    def _temporal_(self, scope, name, text):
        return temporal.literal(name, text)

    def _now_(self, scope, name):
        from zoneinfo import ZoneInfo

        if name == "current_timestamp":
            return temporal.literal("timestamptz", self.now.isoformat(sep=" ", timespec="microseconds"))
        zone = ZoneInfo(self.zone) if "/" in self.zone or self.zone == "UTC" else dt.datetime.strptime(self.zone, "%z").tzinfo
        local = self.now.astimezone(zone).replace(tzinfo=None)
        if name == "current_date":
            return temporal.literal("date", f"{local:%Y-%m-%d}")
        if name == "localtime":
            return temporal.literal("time", f"{local:%H:%M:%S.%f}")
        return temporal.literal("timestamp", local.isoformat(sep=" ", timespec="microseconds"))

    def _neg_(self, scope, x):
        if x[0] == "num" and "." not in x[1]:
            return Typed(f"(-{int(x[1])}L)" if int(x[1]) < 2**63 else "(-9223372036854775807L - 1L)", BIGINT, True)
        return exact.negate(self.value(x, scope))

    def _pos_(self, scope, x):
        out = self.value(x, scope)
        ty.numeric(out.type)
        return out

    def _bin_(self, scope, op, x, y):
        a, b = self.value(x, scope), self.value(y, scope)
        if op in "+-" and a.type == DATE and b.type in (BIGINT, NULL):
            return temporal.shift(op, a, b)
        if op == "+" and b.type == DATE and a.type == BIGINT:
            return temporal.shift(op, b, a)
        if op == "-" and a.type == DATE and b.type == DATE:
            return temporal.days_between(a, b)
        if op in "+-":
            return exact.add(op, a, b)
        return {"*": exact.multiply, "/": exact.divide, "%": exact.remainder}[op](a, b)

    def _call_(self, scope, name, args):
        if name in ("round", "truncate") and len(args) == 2 and args[1][0] == "num" and args[1][1].isdigit() and int(args[1][1]) <= 18:
            return (exact.round_to if name == "round" else exact.truncate)(self.value(args[0], scope), int(args[1][1]))
        if name in ("ceil", "floor", "abs") and len(args) == 1:
            x = self.value(args[0], scope)
            return exact.absolute(x) if name == "abs" else exact.whole(name, x)
        raise EngineError(UNSUPPORTED, f"no function {name.upper()} with {len(args)} arguments")

    def _cast_(self, scope, x, to):
        v = self.value(x, scope)
        a, b = v.type, to
        if a == NULL:
            return Typed(f"CAST(NULL AS {to.spark})", to, True)
        if a.name in ty.NUMERIC and b.name in ty.NUMERIC:
            widens = b.digits[1] >= a.digits[1] and b.digits[0] - b.digits[1] >= a.digits[0] - a.digits[1]
            return replace(exact.to_number(v, to), safe=v.safe and widens)
        if a.name == b.name == "varchar":
            return temporal.fits(v, to) if b.a < a.a else Typed(v.sql, to, v.safe)
        if a.name in ty.TEMPORAL and b.name == "varchar":
            return temporal.to_text(v, to)
        if a.name == "varchar" and b.name in ty.TEMPORAL:
            return temporal.from_text(v, to)
        if a.name == b.name:
            return temporal.precision(v, to) if a.name in ty.TEMPORAL else v
        if (a.name, b.name) == ("date", "timestamp"):
            return Typed(f"CAST({v.sql} AS TIMESTAMP_NTZ)", to, v.safe)
        if (a.name, b.name) == ("timestamp", "date"):
            return temporal.to_date(v)
        if {a.name, b.name} == {"timestamp", "timestamptz"}:
            return temporal.precision(temporal.at_zone(v, self.zone), to)
        raise EngineError(MISMATCH, f"no cast from {a.shown} to {b.shown}")

    def _extract_(self, scope, part, x):
        v = self.value(x, scope)
        return replace(temporal.extract(part, v), safe=v.safe)

    def _zone_(self, scope, x, name):
        return temporal.at_zone(self.value(x, scope), name)

    def _agg_(self, scope, kind, x):
        if kind == "count":
            return Typed("count(*)" if x is None else f"count({self.value(x, scope).sql})", BIGINT, True)
        v = self.value(x, scope)
        if kind in ("sum", "avg"):
            return exact.total(v) if kind == "sum" else exact.average(v)
        if v.type == BOOLEAN:
            raise EngineError(MISMATCH, "BOOLEAN has no order")
        return Typed(f"{kind}({v.sql})", v.type, v.safe)

    # conditions

    def _pair(self, x: Any, y: Any, scope) -> tuple[Typed, Typed]:
        a, b = self.value(x, scope), self.value(y, scope)
        ty.comparable(a.type, b.type)
        if a.type.name == b.type.name == "time" and a.type.a != b.type.a:  # Spark compares equal precisions only
            to = SqlType("time", max(a.type.a, b.type.a))
            a, b = temporal.precision(a, to), temporal.precision(b, to)
        return a, b

    def _cmp_(self, scope, op, x, y):
        a, b = self._pair(x, y, scope)
        if op not in ("=", "<>") and BOOLEAN in (a.type, b.type):
            raise EngineError(MISMATCH, "BOOLEAN has no order")
        null = lambda v, o: f"CAST(NULL AS {o.type.spark})" if v.type == NULL else v.sql
        return Typed(f"({null(a, b)} {op} {null(b, a)})", BOOLEAN, a.safe and b.safe)

    def _and_(self, scope, x, y):
        return _conjunction([self._truth(part, scope) for part in _flat("and", ("and", x, y))])

    def _or_(self, scope, x, y):
        return _disjunction([self._truth(part, scope) for part in _flat("or", ("or", x, y))])

    def _not_(self, scope, x):
        v = self._truth(x, scope)
        return Typed(f"(NOT {v.sql})", BOOLEAN, v.safe)

    def _isnull_(self, scope, x, negated):
        v = self.value(x, scope)
        return Typed(f"({v.sql} IS {'NOT ' if negated else ''}NULL)", BOOLEAN, v.safe)

    def _is_(self, scope, x, truth, negated):
        word, v = "UNKNOWN" if truth == "unknown" else truth.upper(), self._truth(x, scope)
        return Typed(f"({v.sql} IS {'NOT ' if negated else ''}{word})", BOOLEAN, v.safe)

    def _between_(self, scope, x, lo, hi, negated):
        a, b = self._pair(x, lo, scope)
        c = self._pair(x, hi, scope)[1]
        if a.type == BOOLEAN:
            raise EngineError(MISMATCH, "BOOLEAN has no order")
        return Typed(f"({a.sql} {'NOT ' if negated else ''}BETWEEN {b.sql} AND {c.sql})", BOOLEAN, a.safe and b.safe and c.safe)

    def _in_(self, scope, x, items, negated):
        a = self.value(x, scope)
        values = [self.value(i, scope) for i in items]
        for v in values:
            ty.comparable(a.type, v.type)
        listed = ", ".join(f"CAST(NULL AS {a.type.spark})" if v.type == NULL else v.sql for v in values)
        return Typed(f"({a.sql} {'NOT ' if negated else ''}IN ({listed}))", BOOLEAN, all(v.safe for v in (a, *values)))

    def _in_rows(self, scope, x, q):
        a, b = self.value(x, scope), self.query(q, scope, True)
        if len(b.columns) != 1:
            raise EngineError(SYNTAX, "IN takes a query of one column")
        ty.comparable(a.type, b.columns[0][1])
        return Typed(f"({a.sql} IN ({b.sql}))", BOOLEAN, a.safe)

    def _inquery_(self, scope, x, q, negated):
        """Where unknown is not false: the three values are spelled out, each with a test that joins by the key."""
        if _has_aggregate(x):
            v = self._in_rows(scope, x, q)
            return Typed(f"(NOT {v.sql})", BOOLEAN, v.safe) if negated else v
        a, found, empty, null = self._membership(scope, x, q)
        yes, no = ("FALSE", "TRUE") if negated else ("TRUE", "FALSE")
        return Typed(f"(CASE WHEN {found} THEN {yes} WHEN {empty} THEN {no} WHEN {a.sql} IS NULL OR {null} THEN CAST(NULL AS BOOLEAN) ELSE {no} END)", BOOLEAN, a.safe)

    def _exists_(self, scope, q):
        return Typed(f"EXISTS ({self.query(q, scope, True).sql})", BOOLEAN, True)

    def _query_(self, scope, q):
        b = self.query(q, scope, True)
        if len(b.columns) != 1:
            raise EngineError(SYNTAX, "a scalar query has one column")
        return Typed(f"({b.sql})", b.columns[0][1], True)


def _flat(kind: str, x: Any) -> list[Any]:
    """The operands of a chain of AND or of OR, from the left."""
    out, left = [], x
    while left[0] == kind:
        out.append(left[2])
        left = left[1]
    parts = [left, *reversed(out)]
    return [p for part in parts for p in (_flat(kind, part) if part[0] == kind else [part])] if any(p[0] == kind for p in parts) else parts


def _conjunction(parts: list[Typed]) -> Typed:
    """AND decides from the left: an operand that may raise is reached only where none before it is false.

    All operands that cannot raise are conjuncts of their own, so that joins and scans take them; the others stand in one
    CASE.  There every operand is written twice, however long the chain is.
    """
    plain = [p.sql for p in parts if p.safe]
    if len(parts) == 1 or len(plain) == len(parts) or (len(plain) == len(parts) - 1 and not parts[0].safe):
        return Typed(f"({' AND '.join(p.sql for p in parts)})" if len(parts) > 1 else parts[0].sql, BOOLEAN, len(plain) == len(parts))
    last = max(k for k, p in enumerate(parts) if not p.safe)
    first = next(k for k, p in enumerate(parts) if not p.safe)
    guard = parts[last].sql
    for p in reversed(parts[first:last]):
        guard = f"CASE WHEN {p.sql} IS FALSE THEN FALSE ELSE ({guard} AND {p.sql}) END"
    before = " AND ".join(p.sql for p in parts[:first])
    guard = f"(CASE WHEN ({before}) IS FALSE THEN FALSE ELSE {guard} END)" if before else f"({guard})"
    return Typed(f"({' AND '.join([*plain, guard])})", BOOLEAN, False)


def _disjunction(parts: list[Typed]) -> Typed:
    """OR decides from the left: an operand that may raise is reached only where none before it is true."""
    if all(p.safe for p in parts[1:]):
        return Typed(f"({' OR '.join(p.sql for p in parts)})", BOOLEAN, parts[0].safe)
    out = parts[-1].sql
    for p in reversed(parts[:-1]):
        out = f"CASE WHEN {p.sql} THEN TRUE ELSE ({out} OR {p.sql}) END"
    return Typed(f"({out})", BOOLEAN, False)


def _has(x: Any, kinds: tuple[str, ...]) -> bool:
    if isinstance(x, tuple):
        return bool(x) and x[0] in kinds or any(_has(y, kinds) for y in x[1:])
    return isinstance(x, list) and any(_has(y, kinds) for y in x)


def _has_aggregate(x: Any) -> bool:
    return _has(x, ("agg",))


def _with_aliases(x: Any, items: list[tuple[Any, str | None]]) -> Any:
    """HAVING may name output columns: they stand for their expressions."""
    named = {alias: e for e, alias in items if alias}
    if isinstance(x, tuple):
        if x[:2] == ("col", None) and x[2] in named:
            return named[x[2]]
        return tuple(_with_aliases(y, items) for y in x)
    return [_with_aliases(y, items) for y in x] if isinstance(x, list) else x
