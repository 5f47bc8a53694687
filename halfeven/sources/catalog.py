"""What a database knows: tables, views, sequences, indexes and statistics.

A catalog is a value.  Statements change a copy, and a transaction keeps or drops copies; a table's rows
are a list of immutable Parquet folders, so a copy shares them.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from typing import Any

from ..errors import CONFLICT, SYNTAX, UNDEFINED, EngineError
from ..functions.types import SqlType

RESERVED = "_halfeven_"


@dataclass
class Column:
    name: str
    type: SqlType
    not_null: bool = False
    default: Any = None
    check: Any = None
    unique: bool = False
    references: str | None = None
    identity: bool = False


@dataclass
class Table:
    name: str
    columns: list[Column]
    paths: list[str] = field(default_factory=list)
    frame: Any = None  # rows that the engine only reads
    indexes: dict[str, tuple[str, bool]] = field(default_factory=dict)  # name: (column, unique)
    next_identity: int = 1
    statistics: list[tuple] | None = None

    @property
    def key(self) -> str | None:
        return self.columns[0].name if self.columns and self.columns[0].unique else None

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise EngineError(UNDEFINED, f"no column {name} in {self.name}")


@dataclass
class View:
    name: str
    text: str
    reads: tuple[str, ...]


@dataclass
class Sequence:
    next: int
    step: int


class Catalog:
    def __init__(self):
        self.tables: dict[str, Table] = {}
        self.views: dict[str, View] = {}
        self.sequences: dict[str, Sequence] = {}

    def copy(self) -> Catalog:
        out = Catalog()
        for name in ("tables", "views", "sequences"):
            setattr(out, name, {k: copy.copy(v) for k, v in getattr(self, name).items()})
        for t in out.tables.values():
            t.columns, t.paths, t.indexes = [copy.copy(c) for c in t.columns], list(t.paths), dict(t.indexes)
        return out

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise EngineError(UNDEFINED, f"no table {name}")
        return self.tables[name]

    def new_name(self, name: str) -> str:
        if name.startswith(RESERVED) or len(name) > 64:
            raise EngineError(SYNTAX, f"{name} can't be a name")
        if name in self.tables or name in self.views or name in self.sequences:
            raise EngineError(SYNTAX, f"{name} exists")
        return name

    def users(self, name: str, column: str | None = None) -> list[str]:
        """Views and foreign keys that need a table."""
        return [v.name for v in self.views.values() if name in v.reads] + [t.name for t in self.tables.values() for c in t.columns if c.references == name and t.name != name]

    def need_unused(self, name: str) -> None:
        if used := self.users(name):
            raise EngineError("2BP01", f"{name} is used by {', '.join(used)}")


def merged(now: Catalog, base: Catalog, mine: Catalog, read: set[str]) -> Catalog:
    """`now` with what a transaction changed between `base` and `mine`.

    It conflicts with what others have committed since if they changed an object that it read or changed, or if names or
    references no longer fit.
    """
    out = now.copy()
    for kind in ("tables", "views", "sequences"):
        ours, was, theirs, into = (getattr(c, kind) for c in (mine, base, now, out))
        for name in {*ours, *was}:
            changed = ours.get(name) != was.get(name)
            if (changed or name in read) and theirs.get(name) != was.get(name):
                raise EngineError(CONFLICT, f"another transaction has changed {name}")
            if changed and name in ours:
                into[name] = ours[name]
            elif changed:
                del into[name]
    names = [*out.tables, *out.views, *out.sequences]
    needed = {r for v in out.views.values() for r in v.reads} | {c.references for t in out.tables.values() for c in t.columns if c.references}
    if len(set(names)) != len(names) or not needed <= {*out.tables, *out.views}:
        raise EngineError(CONFLICT, "another transaction has changed a name or what refers to it")
    return out
