from decimal import Decimal

import pytest

from halfeven.catalogue import fixture
from halfeven.errors import EngineError
from halfeven.operators.frames import Frame
from halfeven.plans.session import Engine
from halfeven.streaming.load import append_stream


def test_frames(spark):
    numbers, outer, inner = (Frame(fixture(spark, n), "id") for n in ("numbers", "outer_rows", "inner_rows"))
    assert [tuple(r) for r in numbers.where("x > 1.00").order("x", descending=True, limit=2).select("id", "x + 1.00 AS y").df.collect()] == [(3, Decimal("89.10")), (1, Decimal("4.75"))]
    assert sorted(r.n for r in outer.group("region", "COUNT(*) AS n", "COUNT(*) > 1").df.collect()) == [2, 2]
    got = outer.join(inner, "t.value = o.value", ["t.id AS a", "o.id AS b"], "LEFT").df.collect()
    assert sorted((r.a, r.b or 0) for r in got) == [(1, 21), (1, 25), (2, 21), (2, 25), (3, 0), (4, 24), (5, 26), (6, 23)]
    assert [r.id for r in outer.where("value NOT IN (SELECT value FROM i)", i=inner).df.collect()] == []
    assert outer.distinct("region").df.count() == 4
    assert outer.aggregate("SUM(value) AS s").df.first().s == 56


def test_streams_append_whole_batches(spark, tmp_path):
    db = Engine(spark).session()
    db.execute("CREATE TABLE seen (id BIGINT PRIMARY KEY, v DECIMAL(8,2) CHECK (v >= 0.00))")
    spark.range(5).selectExpr("id", "CAST(id AS DECIMAL(8,2)) AS v").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long, v decimal(8,2)").parquet(f"{tmp_path}/in")
    append_stream(db, "seen", stream(), f"{tmp_path}/at").awaitTermination()
    append_stream(db, "seen", stream(), f"{tmp_path}/at").awaitTermination()
    assert db.query("SELECT SUM(v) AS s FROM seen").first().s == Decimal("10.00")
    with pytest.raises(EngineError):
        db.append("seen", spark.sql("SELECT 9L AS id, CAST(-1 AS DECIMAL(8,2)) AS v"))
    assert db.query("SELECT COUNT(*) AS n FROM seen").first().n == 5
