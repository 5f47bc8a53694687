"""Sessions: statements in the dialect over tables of Parquet snapshots.

`Engine` holds the committed catalog, `Session` a user's transaction, time zone and permissions.  A query
is compiled to one Spark SQL statement and returned as a lazy DataFrame.  A change writes new immutable
folders, checks constraints against them and then swaps the catalog entry, so a statement that fails
leaves nothing behind and readers keep their snapshot.
"""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import ACCESS, CHECK, CONFLICT, FOREIGN_KEY, MISMATCH, NOT_NULL, SYNTAX, TRANSACTION, UNIQUE, UNSUPPORTED, EngineError, translated
from ..functions import exact, temporal
from ..functions import types as ty
from ..functions.exact import Typed
from ..functions.types import BIGINT, NULL, SqlType
from ..sources.catalog import Catalog, Column, Sequence, Table, View, merged
from ..sources.tables import configured, snapshot_path
from .compiler import Compiler, Relation, Scope, Source
from .parser import Parser, Query, need_parameters

PERMISSIONS = ("READ", "WRITE", "SCHEMA", "ADMIN")
ISOLATION = ("serializable", "read committed", "repeatable read")


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = configured(spark)
        self.catalog = Catalog()
        self.version = 0
        self.writer = threading.Lock()
        self.batches: dict[tuple[str, str], int] = {}  # of streams, the last batch that a table has taken

    def register(self, name: str, frame: DataFrame, key: str | None = None) -> None:
        """A table that is only read, for instance Parquet files; `key` is a column without equal values."""
        columns = [Column(f.name.lower(), ty.of_spark(f.dataType)) for f in frame.schema.fields]
        for c in columns:
            c.unique = c.not_null = c.name == key
        columns.sort(key=lambda c: not c.unique)
        frame = frame.select(*[F.col(f"`{c.name}`") for c in columns])
        self.catalog.tables[name.lower()] = Table(name.lower(), columns, frame=frame)

    def session(self, permissions: tuple[str, ...] = PERMISSIONS) -> Session:
        return Session(self, permissions)


class Session:
    def __init__(self, engine: Engine, permissions: tuple[str, ...] = PERMISSIONS):
        self.engine, self.spark, self.permissions = engine, engine.spark, set(permissions)
        self.zone = "UTC"
        self.mine: Catalog | None = None  # of an open transaction
        self.base = 0
        self.savepoints: list[tuple[str, Catalog]] = []
        self.wrote = False
        self.snapshot: Catalog | None = None  # what was committed when the transaction began
        self.read: set[str] = set()  # tables and views that it has read
        self._views: dict[tuple, str] = {}

    @property
    def catalog(self) -> Catalog:
        return self.mine if self.mine is not None else self.engine.catalog

    # reading

    def rows(self, table: Table) -> DataFrame:
        self.read.add(table.name)
        if table.frame is not None:
            return table.frame
        schema = ", ".join(f"`{c.name}` {c.type.spark}" for c in table.columns)
        return self.spark.read.schema(schema).parquet(*table.paths) if table.paths else self.spark.createDataFrame([], schema)

    def _relation(self, name: str) -> Relation:
        self.read.add(name)
        if name in self.catalog.views:
            q = Parser(self.catalog.views[name].text).query()
            inner = self._compiler(()).query(q)
            return Relation(f"({inner.sql})", inner.columns)
        table = self.catalog.table(name)
        stored = (name, id(table.frame), *table.paths, *[c.name for c in table.columns])
        if stored not in self._views:
            view = f"halfeven_{uuid.uuid4().hex}"
            self.rows(table).createOrReplaceTempView(view)
            self._views[stored] = view
        return Relation(self._views[stored], [(c.name, c.type) for c in table.columns], table.key)

    def _compiler(self, parameters: tuple) -> Compiler:
        return Compiler(self._relation, parameters, self.zone, dt.datetime.now(dt.timezone.utc))

    def query(self, text: str, parameters: tuple = ()) -> DataFrame:
        """The rows of a SELECT, SHOW, EXPLAIN, ANALYZE or NEXT VALUE statement; a SELECT runs when an action asks for it."""
        p = Parser(text)
        if p.sees("select", "next"):
            return self._next_value(p)
        if p.sees("show"):
            return self._show(p)
        if p.take("explain"):
            return self._explain(p, parameters)
        if p.take("analyze"):
            return self._analyze(p)
        self._need("READ")
        return self.spark.sql(self.compiled(p, parameters).sql)

    def compiled(self, p: Parser, parameters: tuple = ()) -> Relation:
        q = p.query()
        p.end()
        need_parameters(p.params, len(parameters))
        return self._compiler(tuple(parameters)).query(q)

    def stream(self, text: str, parameters: tuple = ()) -> Iterator[Row]:
        """Rows one after another, without gathering them all; Spark's errors come as EngineError."""
        try:
            yield from self.query(text, parameters).toLocalIterator()
        except EngineError:
            raise
        except Exception as e:
            raise translated(e) or e from e

    # statements

    def execute(self, text: str, parameters: tuple = ()) -> int | None:
        """Runs any other statement; returns the number of changed rows, or None."""
        p = Parser(text)
        kind, word = p.peek()
        p.at += 1
        run = {
            "create": self._create, "drop": self._drop, "alter": self._alter, "insert": self._insert, "update": self._update, "delete": self._delete, "set": self._set,
            "begin": self._begin, "commit": self._commit, "rollback": self._rollback, "savepoint": self._savepoint, "release": self._release, "checkpoint": self._checkpoint,
        }.get(word if kind == "name" else "")
        if run is None:
            raise EngineError(SYNTAX, f"no such statement: {word}")
        self._parameters = tuple(parameters)
        try:
            if word in ("begin", "commit", "rollback", "savepoint", "release", "set", "checkpoint"):
                return run(p)
            return self._changing(lambda: run(p), "WRITE" if word in ("insert", "update", "delete") else "SCHEMA")
        except EngineError:
            raise
        except Exception as e:
            raise translated(e) or e from e

    def _need(self, permission: str) -> None:
        if permission not in self.permissions:
            raise EngineError(ACCESS, f"{permission} permission is needed")

    def _changing(self, run, permission: str):
        """One statement, whole or not at all; outside a transaction it commits."""
        self._need(permission)
        if self.mine is not None:
            before, self.mine = self.mine, self.mine.copy()
            try:
                out = run()
            except BaseException:
                self.mine = before
                raise
            self.wrote = True
            return out
        self._begin(None)
        try:
            out = run()
            self.wrote = True
            self._commit(None)
            return out
        finally:
            self._end()

    # transactions

    def _begin(self, p: Parser | None) -> None:
        if self.mine is not None:
            raise EngineError(TRANSACTION, "a transaction is open")
        if p is not None and p.peek()[0] != "end":
            level = " ".join(p.name() for _ in range(2 if p.peek()[1] in ("read", "repeatable") else 1))
            if level not in ISOLATION:
                raise EngineError(SYNTAX, f"no isolation level {level}")
            p.end()
        self.mine, self.snapshot, self.base = self.engine.catalog.copy(), self.engine.catalog.copy(), self.engine.version
        self.wrote, self.savepoints, self.read = False, [], set()

    def _end(self) -> None:
        self.mine, self.snapshot, self.savepoints, self.wrote = None, None, [], False

    def _need_open(self) -> None:
        if self.mine is None:
            raise EngineError(TRANSACTION, "no transaction is open")

    def _commit(self, p: Parser | None) -> None:
        self._need_open()
        try:
            if self.wrote:
                with self.engine.writer:
                    if self.engine.version != self.base:
                        self.mine = merged(self.engine.catalog, self.snapshot, self.mine, self.read)
                    self.engine.catalog, self.engine.version = self.mine, self.engine.version + 1
        finally:
            self._end()

    def _rollback(self, p: Parser) -> None:
        self._need_open()
        if p.take("to"):
            p.take("savepoint")
            at = self._find(p.name())
            self.mine = self.savepoints[at][1].copy()
            del self.savepoints[at + 1 :]
        else:
            self._end()

    def _savepoint(self, p: Parser) -> None:
        self._need_open()
        self.savepoints.append((p.name(), self.mine.copy()))

    def _release(self, p: Parser) -> None:
        self._need_open()
        p.need("savepoint")
        del self.savepoints[self._find(p.name()) :]

    def _find(self, name: str) -> int:
        for k in range(len(self.savepoints) - 1, -1, -1):
            if self.savepoints[k][0] == name:
                return k
        raise EngineError("3B001", f"no savepoint {name}")

    def _checkpoint(self, p: Parser) -> None:
        """Rewrites tables of several folders as one."""
        self._need("ADMIN")
        if self.mine is not None:
            raise EngineError(CONFLICT, "CHECKPOINT inside a transaction")

        def compact():
            for t in self.mine.tables.values():
                if len(t.paths) > 1:
                    t.paths = [self._stored(self.rows(t), t.name)]

        self._changing(compact, "ADMIN")

    def _set(self, p: Parser) -> None:
        p.need("time", "zone")
        self.zone = temporal.zone_name(p.string())
        p.end()

    # definitions

    def _create(self, p: Parser) -> None:
        unique = p.take("unique")
        if p.take("index"):
            name = p.name()
            p.need("on")
            table = self.mine.table(p.name())
            p.need("(")
            column = table.column(p.name())
            p.need(")")
            if any(name in t.indexes for t in self.mine.tables.values()):
                raise EngineError(SYNTAX, f"{name} exists")
            if unique:
                self._need_unique(self.rows(table), column.name)
                column.unique = True
            table.indexes[name] = (column.name, unique)
        elif unique:
            raise p.wrong("INDEX")
        elif p.take("table"):
            self._create_table(p)
        elif p.take("view"):
            self._create_view(p)
        else:
            p.need("sequence")
            name = self.mine.new_name(p.name())
            start = p.number() if p.take("start", "with") else 1
            step = p.number() if p.take("increment", "by") else 1
            if not step:
                raise EngineError(SYNTAX, "INCREMENT BY 0")
            self.mine.sequences[name] = Sequence(start, step)
        p.end()

    def _create_table(self, p: Parser) -> None:
        name = self.mine.new_name(p.name())
        if not p.take("("):
            self.mine.tables[name] = Table(name, [Column("key", BIGINT, True, unique=True), Column("value", BIGINT)])
            return
        columns: list[Column] = []
        while True:
            c = Column(p.name("a column"), p.type())
            if any(o.name == c.name for o in columns):
                raise EngineError(SYNTAX, f"two columns are named {c.name}")
            primary = False
            while p.peek() not in (("op", ","), ("op", ")")):
                if p.take("primary", "key"):
                    primary = c.unique = c.not_null = True
                elif p.take("not", "null"):
                    c.not_null = True
                elif p.take("unique"):
                    c.unique = True
                elif p.take("generated", "always", "as", "identity"):
                    c.identity = True
                elif p.take("default"):
                    c.default = p._sum()
                elif p.take("check"):
                    p.need("(")
                    c.check = p.expression()
                    p.need(")")
                elif p.take("references"):
                    c.references = p.name()
                    parent = self.mine.table(c.references) if c.references != name else None
                    if p.take("("):
                        if p.name() != (parent.key if parent else columns[0].name):
                            raise EngineError(UNSUPPORTED, "a foreign key refers to a primary key")
                        p.need(")")
                else:
                    raise p.wrong("a column constraint")
            if primary == bool(columns) or primary and c.type != BIGINT:
                raise EngineError(SYNTAX, "the first column, and only it, is BIGINT PRIMARY KEY")
            columns.append(c)
            if not p.take(","):
                break
        p.need(")")
        self.mine.tables[name] = Table(name, columns)

    def _create_view(self, p: Parser) -> None:
        name = self.mine.new_name(p.name())
        p.need("as")
        begin = p.at
        q = p.query()
        if q.order or q.limit is not None or any(x == ("star",) for x, _ in q.items):
            raise EngineError(UNSUPPORTED, "views have no ORDER BY, LIMIT or *")
        self._compiler(()).query(q)
        text = " ".join(t for _, t in p.tokens[begin : p.at])
        self.mine.views[name] = View(name, text, tuple(_sources(q)))

    def _drop(self, p: Parser) -> None:
        for word, held in (("table", self.mine.tables), ("view", self.mine.views), ("sequence", self.mine.sequences)):
            if p.take(word):
                name = p.name()
                if name not in held:
                    raise EngineError("42704", f"no {word} {name}")
                self.mine.need_unused(name)
                del held[name]
                return p.end()
        p.need("index")
        name = p.name()
        p.need("on")
        table = self.mine.table(p.name())
        if name not in table.indexes:
            raise EngineError("42704", f"no index {name}")
        column, unique = table.indexes.pop(name)
        if unique and column != table.key:
            table.column(column).unique = False
        p.end()

    def _alter(self, p: Parser) -> None:
        if p.take("index"):
            old = p.name()
            p.need("rename", "to")
            new = p.name()
            table = next((t for t in self.mine.tables.values() if old in t.indexes), None)
            if table is None or any(new in t.indexes for t in self.mine.tables.values()):
                raise EngineError("42704", f"{old} can't become {new}")
            table.indexes[new] = table.indexes.pop(old)
            return p.end()
        p.need("table")
        table = self.mine.table(p.name())
        self.mine.need_unused(table.name)
        p.need("rename")
        if p.take("column"):
            column = table.column(p.name())
            p.need("to")
            new, old = p.name(), column.name
            if any(c.name == new for c in table.columns):
                raise EngineError(SYNTAX, f"{new} exists")
            frame = self.rows(table).withColumnRenamed(old, new)
            column.name = new
            if table.frame is not None:
                table.frame = frame
            else:
                table.paths = [self._stored(frame, table.name)]
            table.indexes = {n: (new if c == old else c, u) for n, (c, u) in table.indexes.items()}
        else:
            p.need("to")
            new = self.mine.new_name(p.name())
            del self.mine.tables[table.name]
            table.name = new
            self.mine.tables[new] = table
        p.end()

    # rows

    def _stored(self, rows: DataFrame, name: str) -> str:
        path = snapshot_path(self.spark, name)
        rows.write.parquet(path)
        return path

    def _assigned(self, v: Typed, c: Column) -> Typed:
        """A value as a column takes it: texts are held to length, numbers to range."""
        if v.type == NULL:
            return Typed(f"CAST(NULL AS {c.type.spark})", c.type)
        if c.type.name == v.type.name == "varchar":
            return temporal.fits(v, c.type)
        if c.type.name == "decimal" and v.type.name in ty.NUMERIC:
            return exact.to_number(v, c.type)
        if c.type.name == v.type.name:
            return temporal.precision(v, c.type) if c.type.name in ty.TEMPORAL else v
        raise EngineError(MISMATCH, f"{c.name} is {c.type.shown}, not {v.type.shown}")

    def _writable(self, name: str) -> Table:
        table = self.mine.table(name)
        if table.frame is not None:
            raise EngineError(UNSUPPORTED, f"{name} is only read")
        return table

    def _insert(self, p: Parser) -> int:
        p.need("into")
        table = self._writable(p.name())
        named = [c.name for c in table.columns if not c.identity]
        if p.take("("):
            named = [p.name()]
            while p.take(","):
                named.append(p.name())
            p.need(")")
        targets = [table.column(n) for n in named]
        if any(c.identity for c in targets):
            raise EngineError(UNSUPPORTED, "an identity column is always generated")
        p.need("values")
        compiler, rows = self._compiler(self._parameters), []
        while True:
            p.need("(")
            given = {}
            for k, c in enumerate(targets):
                if k:
                    p.need(",")
                given[c.name] = c.default if p.take("default") else p._sum()
            p.need(")")
            values = []
            for c in table.columns:
                if c.identity:
                    value = f"{table.next_identity}L"
                    table.next_identity += 1
                else:
                    value = self._assigned(compiler.value(given.get(c.name, c.default) or ("null",), None), c).sql
                values.append(f"CAST({value} AS {c.type.spark}) AS `{c.name}`")
            rows.append(f"struct({', '.join(values)})")
            if not p.take(","):
                break
        p.end()
        need_parameters(p.params, len(self._parameters))
        path = self._stored(self.spark.sql(f"SELECT inline(array({', '.join(rows)}))"), table.name)
        self._checked(table, self.spark.read.parquet(path), self.rows(table))
        table.paths.append(path)
        return len(rows)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds the rows of a DataFrame to a table, whole or not at all: the way to load more than literals can say.

        Columns are taken by name; columns that `rows` lacks are null.  The constraints of INSERT hold.
        """

        def run() -> None:
            table = self._writable(name)
            have = {c.lower() for c in rows.columns}
            items = [(F.col(f"`{c.name}`") if c.name in have else F.lit(None)).cast(c.type.spark).alias(c.name) for c in table.columns]
            path = self._stored(rows.select(*items), table.name)
            self._checked(table, self.spark.read.schema(self.rows(table).schema).parquet(path), self.rows(table))
            table.paths.append(path)

        self._changing(run, "WRITE")

    def _checked(self, table: Table, new: DataFrame, old: DataFrame | None) -> None:
        """Holds new rows against the constraints; `old` are rows that stay beside them."""
        scope = Scope([Source("v", table.name, Relation("", [(c.name, c.type) for c in table.columns]))])
        compiler = self._compiler(())
        for c in table.columns:
            if c.not_null and new.where(F.col(c.name).isNull()).take(1):
                raise EngineError(NOT_NULL, f"{c.name} is null")
            if c.check is not None and new.alias("v").where(f"({compiler.truth(c.check, scope)}) IS FALSE").take(1):
                raise EngineError(CHECK, f"the check of {c.name} failed")
            if c.unique:
                self._need_unique(new, c.name)
                if old is not None and old.join(new.select(c.name), c.name, "left_semi").take(1):
                    raise EngineError(UNIQUE, f"{c.name} has equal values")
            if c.references:
                parent = self.mine.table(c.references)
                keys = self.rows(parent).select(F.col(parent.key).alias("k"))
                if c.references == table.name:
                    keys = new.select(F.col(parent.key).alias("k")).unionByName(keys) if old is not None else new.select(F.col(parent.key).alias("k"))
                if new.where(F.col(c.name).isNotNull()).join(keys, F.col(c.name) == F.col("k"), "left_anti").take(1):
                    raise EngineError(FOREIGN_KEY, f"{c.name} has no row in {c.references}")

    def _need_unique(self, rows: DataFrame, column: str) -> None:
        if rows.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1").take(1):
            raise EngineError(UNIQUE, f"{column} has equal values")

    def _need_parents(self, table: Table, rows: DataFrame) -> None:
        """Rows of other tables (and this one) that refer to `table` must find their keys in `rows`."""
        for child in self.mine.tables.values():
            for c in child.columns:
                if c.references == table.name:
                    held = rows if child is table else self.rows(child)
                    keys = rows.select(F.col(table.key).alias("k"))
                    if held.where(F.col(c.name).isNotNull()).select(F.col(c.name).alias("c")).join(keys, F.col("c") == F.col("k"), "left_anti").take(1):
                        raise EngineError(FOREIGN_KEY, f"{child.name}.{c.name} refers to a row of {table.name}")

    def _matching(self, p: Parser, table: Table, compiler: Compiler) -> tuple[str, str]:
        """The mandatory WHERE of UPDATE and DELETE, and the source that it reads."""
        p.need("where")
        where = p.expression()
        p.end()
        need_parameters(p.params, len(self._parameters))
        self.scope = Scope([Source("t", table.name, self._relation(table.name))])
        return compiler.truth(where, self.scope), f"{self.scope.sources[0].relation.sql} t"

    def _update(self, p: Parser) -> int:
        table = self._writable(p.name())
        p.need("set")
        sets = {}
        while True:
            column = table.column(p.name())
            if column.name == table.key:
                raise EngineError(UNSUPPORTED, "a primary key stays")
            p.need("=")
            sets[column.name] = column.default or ("null",) if p.take("default") else p.expression()
            if not p.take(","):
                break
        compiler = self._compiler(self._parameters)
        where, source = self._matching(p, table, compiler)
        items = []
        for c in table.columns:
            old = f"t.`{c.name}`"
            if c.name in sets:
                new = self._assigned(compiler.value(sets[c.name], self.scope), c).sql
                old = f"CAST(CASE WHEN {where} THEN {new} ELSE {old} END AS {c.type.spark})"
            items.append(f"{old} AS `{c.name}`")
        changed = self.spark.sql(f"SELECT count(*) FROM {source} WHERE {where}").first()[0]
        if changed:
            path = self._stored(self.spark.sql(f"SELECT {', '.join(items)} FROM {source}"), table.name)
            self._checked(table, self.spark.read.parquet(path), None)
            table.paths = [path]
        return changed

    def _delete(self, p: Parser) -> int:
        p.need("from")
        table = self._writable(p.name())
        where, source = self._matching(p, table, self._compiler(self._parameters))
        columns = ", ".join(f"t.`{c.name}`" for c in table.columns)
        gone = self.spark.sql(f"SELECT count(*) FROM {source} WHERE {where}").first()[0]
        if gone:
            path = self._stored(self.spark.sql(f"SELECT {columns} FROM {source} WHERE ({where}) IS NOT TRUE"), table.name)
            self._need_parents(table, self.spark.read.schema(self.rows(table).schema).parquet(path))
            table.paths = [path]
        return gone

    def _next_value(self, p: Parser) -> DataFrame:
        p.need("select", "next", "value", "for")
        name = p.name()
        p.end()

        def take():
            if name not in self.mine.sequences:
                raise EngineError("42704", f"no sequence {name}")
            s = self.mine.sequences[name]
            s.next += s.step
            return s.next - s.step

        value = self._changing(take, "WRITE")
        return self.spark.sql(f"SELECT {value}L AS next_value")

    # the catalog as rows

    def _show(self, p: Parser) -> DataFrame:
        self._need("READ")
        p.need("show")
        if p.take("tables"):
            rows = [(n, "TABLE") for n in self.catalog.tables] + [(n, "VIEW") for n in self.catalog.views]
            return self.spark.createDataFrame(sorted(rows), "table_name string, table_type string")
        indexes = p.take("indexes")
        if not indexes:
            p.need("columns")
        p.need("from")
        name = p.name()
        p.end()
        if indexes:
            t = self.catalog.table(name)
            rows = [(t.name, "primary", t.key, True, True)] if t.key else []
            rows += [(t.name, n, c, u, False) for n, (c, u) in sorted(t.indexes.items())]
            return self.spark.createDataFrame(rows, "table_name string, index_name string, column_name string, is_unique boolean, is_primary boolean")
        nullable = {c.name: not c.not_null for c in self.catalog.tables[name].columns} if name in self.catalog.tables else {}
        rows = [(c, t.shown, nullable.get(c, True), k + 1) for k, (c, t) in enumerate(self._relation(name).columns)]
        return self.spark.createDataFrame(rows, "column_name string, type string, is_nullable boolean, ordinal bigint")

    def _analyze(self, p: Parser) -> DataFrame:
        """Statistics in one aggregation: rows, and per column nulls, distinct values (exact), least and greatest."""
        self._need("ADMIN")
        p.take("table")
        table = self.catalog.table(p.name())
        p.end()
        rows = self.rows(table)
        aggs = [F.count(F.lit(1)).alias("n")]
        for k, c in enumerate(table.columns):
            v = F.col(c.name)
            text = (lambda x: x.cast("string")) if c.type.name != "time" else (lambda x: F.lit(None).cast("string"))
            aggs += [F.count(v).alias(f"c{k}"), F.count_distinct(v).alias(f"d{k}"), text(F.min(v)).alias(f"lo{k}"), text(F.max(v)).alias(f"hi{k}")]
        got = rows.agg(*aggs).first()
        table.statistics = [(table.name, c.name, got["n"], got["n"] - got[f"c{k}"], got[f"d{k}"], got[f"lo{k}"], got[f"hi{k}"]) for k, c in enumerate(table.columns)]
        return self.spark.createDataFrame(table.statistics, "table_name string, column_name string, row_count bigint, null_count bigint, distinct_count bigint, min_value string, max_value string")

    def _explain(self, p: Parser, parameters: tuple) -> DataFrame:
        """The physical plan as rows (operator, detail, rows): detail is the depth; with ANALYZE the first has the result's rows."""
        self._need("READ")
        analyze = p.take("analyze")
        frame = self.spark.sql(self.compiled(p, parameters).sql)
        count = frame.count() if analyze else None
        rows = []
        for line in frame._jdf.queryExecution().sparkPlan().toString().split("\n"):
            body = line.lstrip(" :+-*")
            if body:
                depth = (len(line) - len(body)) // 3
                rows.append((body.split(" ")[0].split("(")[0][:64], depth, count if not rows else None))
        return self.spark.createDataFrame(rows, "operator string, detail bigint, rows bigint")


def _sources(q: Query) -> list[str]:
    return [n for _, what, _, _ in q.sources for n in (_sources(what) if isinstance(what, Query) else [what])]
