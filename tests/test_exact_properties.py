"""Arithmetic against Python's decimals, on random and on awkward values."""

import random
from decimal import ROUND_DOWN, ROUND_HALF_EVEN, Decimal, getcontext

import pytest

from halfeven.functions import types as ty
from halfeven.functions.types import decimal
from halfeven.plans.session import Engine

getcontext().prec = 80
SHAPES = [((8, 2), (6, 3)), ((5, 0), (3, 3)), ((12, 4), (4, 1)), ((18, 9), (2, 1))]


def values(rng, p, s, n):
    top = 10**p - 1
    units = [rng.randrange(-top, top + 1) for _ in range(n)] + [rng.randrange(-99, 100) for _ in range(n)] + [1, -1, top, -top, 5, 25]
    return [Decimal(u).scaleb(-s) for u in units]


def half_even(x, scale):
    return x.quantize(Decimal(1).scaleb(-scale), ROUND_HALF_EVEN)


@pytest.mark.parametrize("a, b", SHAPES)
def test_quotients_products_and_rounding(spark, a, b):
    rng = random.Random(str((a, b)))
    x, y = values(rng, *a, 60), values(rng, *b, 60)
    x = x[: len(y)]
    q, m = ty.arithmetic("/", decimal(*a), decimal(*b)), ty.arithmetic("*", decimal(*a), decimal(*b))
    rows = []
    for k, (u, v) in enumerate(zip(x, y, strict=False)):
        fits = v != 0 and abs(half_even(u / v, q.b)) < Decimal(10) ** (q.a - q.b) and abs(half_even(u * v, m.b)) < Decimal(10) ** (m.a - m.b)
        if fits and abs(half_even(u, 1)) < Decimal(10) ** (a[0] - a[1]):  # what rounds up out of its type raises
            rows.append((k, u, v))
    engine = Engine(spark)
    engine.register("t", spark.createDataFrame(rows, f"id long, x decimal({a[0]},{a[1]}), y decimal({b[0]},{b[1]})"), "id")
    got = engine.session().query("SELECT id, x / y AS q, x * y AS m, ROUND(x, 1) AS r, TRUNCATE(x, 1) AS d FROM t").collect()
    assert len(got) == len(rows) > 50
    for r in got:
        _, u, v = next(w for w in rows if w[0] == r.id)
        assert r.q == half_even(u / v, q.b), (u, v)
        assert r.m == half_even(u * v, m.b), (u, v)
        assert r.r == half_even(u, 1) and r.d == u.quantize(Decimal("0.1"), ROUND_DOWN)


def test_average_of_ties(spark):
    engine = Engine(spark)
    rows = [(k, k % 7, Decimal(k * k % 1000).scaleb(-2), k * 3) for k in range(500)]
    engine.register("t", spark.createDataFrame(rows, "id long, g long, x decimal(8,2), n long"), "id")
    db = engine.session()
    for g, x, n in ((r.g, r.x, db.query("SELECT AVG(n) AS n FROM t WHERE g = ?", (r.g,)).first().n) for r in db.query("SELECT g, AVG(x) AS x FROM t GROUP BY g").collect()):
        mine = [r for r in rows if r[1] == g]
        assert x == half_even(sum(r[2] for r in mine) / len(mine), 6)
        assert n == half_even(Decimal(sum(r[3] for r in mine)) / len(mine), 0)
