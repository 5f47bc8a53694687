"""Backups: a committed catalog and its tables as one folder, and an engine from such a folder."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

from ..functions.types import SqlType
from .catalog import Column, Sequence, Table, View


def _plain(x: Any) -> Any:
    """Syntax trees and types as JSON values."""
    if isinstance(x, SqlType):
        return {"type": [x.name, x.a, x.b]}
    if isinstance(x, tuple):
        return {"tuple": [_plain(v) for v in x]}
    return [_plain(v) for v in x] if isinstance(x, list) else x


def _tree(x: Any) -> Any:
    if isinstance(x, dict):
        return SqlType(*x["type"]) if "type" in x else tuple(_tree(v) for v in x["tuple"])
    return [_tree(v) for v in x] if isinstance(x, list) else x


def backup(engine, path: str) -> None:
    """Writes what is committed to `path`, a new folder that all executors reach.  Tables that are only read are left out."""
    catalog, session, spark = engine.catalog, engine.session(), engine.spark
    tables = {}
    for t in catalog.tables.values():
        if t.frame is None:
            session.rows(t).write.parquet(f"{path}/tables/{t.name}")
            tables[t.name] = {"columns": [{k: _plain(v) for k, v in vars(c).items()} for c in t.columns], "indexes": t.indexes, "next_identity": t.next_identity}
    views = {v.name: [v.text, list(v.reads)] for v in catalog.views.values() if all(r in tables or r in catalog.views for r in v.reads)}
    sequences = {n: [s.next, s.step] for n, s in catalog.sequences.items()}
    text = json.dumps({"tables": tables, "views": views, "sequences": sequences})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/catalog")


def restore(spark: SparkSession, path: str):
    """An engine with the tables, views and sequences of a backup.  Its folders are read where they are, and never changed."""
    from ..plans.session import Engine

    engine = Engine(spark)
    held = json.loads(spark.read.text(f"{path}/catalog").first()["value"])
    for name, t in held["tables"].items():
        columns = [Column(**{k: _tree(v) for k, v in c.items()}) for c in t["columns"]]
        engine.catalog.tables[name] = Table(name, columns, [f"{path}/tables/{name}"], None, {n: tuple(i) for n, i in t["indexes"].items()}, t["next_identity"])
    engine.catalog.views = {n: View(n, text, tuple(reads)) for n, (text, reads) in held["views"].items()}
    engine.catalog.sequences = {n: Sequence(*s) for n, s in held["sequences"].items()}
    return engine
