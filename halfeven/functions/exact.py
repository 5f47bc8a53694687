"""Exact arithmetic as Spark SQL text.

An expression is a `Typed`: SQL text and the dialect's type.  All arithmetic is decimal or BIGINT and
runs in Spark's generated code; a result that does not fit its type raises (ANSI mode), and quotients
and roundings go half-even.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import DIVISION, OUT_OF_RANGE
from . import types as ty
from .types import BIGINT, SqlType


@dataclass(frozen=True)
class Typed:
    """SQL text, its type, and whether its evaluation is sure not to raise."""

    sql: str
    type: SqlType
    safe: bool = False


#: Operands up to this many characters stand wherever they are needed; longer ones are bound to a name once.
INLINE = 600


def bound(body, *operands: Typed) -> Typed:
    """body(*operands), where the body writes its operands several times.

    Long operands are bound to a lambda's variable, so that the text of nested expressions grows with their number only.
    """
    if sum(len(x.sql) for x in operands) <= INLINE:
        return body(*operands)
    named = ", ".join(f"{x.sql} AS x{k}" for k, x in enumerate(operands))
    out = body(*[Typed(f"v.x{k}", x.type, x.safe) for k, x in enumerate(operands)])
    return Typed(f"transform(array(struct({named})), v -> {out.sql})[0]", out.type, out.safe)


def fail(state: str, message: str) -> str:
    return f"raise_error('SQLSTATE:{state} {message}')"


def failing(state: str, message: str, to: str) -> str:
    """An expression of a Spark type that raises (TIME takes casts from text only)."""
    return f"CAST(CAST({fail(state, message)} AS STRING) AS {to})"


def fitted(sql: str, to: SqlType) -> Typed:
    """A number cast to its derived type; one that doesn't fit raises."""
    return Typed(f"CAST({sql} AS {to.spark})", to)


def wide(x: Typed, scale: int | None = None) -> str:
    """x with 38 digits."""
    s = x.type.digits[1] if scale is None else scale
    return f"CAST({x.sql} AS DECIMAL(38,{s}))"


def add(op: str, x: Typed, y: Typed) -> Typed:
    to = ty.arithmetic(op, x.type, y.type)
    if to == BIGINT:
        return Typed(f"({x.sql} {op} {y.sql})", to)
    exact = f"(CAST({x.sql} AS DECIMAL(19,{x.type.digits[1]})) {op} CAST({y.sql} AS DECIMAL(19,{y.type.digits[1]})))" if max(x.type.digits[0], y.type.digits[0]) <= 19 else f"({x.sql} {op} {y.sql})"
    return fitted(half_even(exact, to.b), to)


def multiply(x: Typed, y: Typed) -> Typed:
    to = ty.arithmetic("*", x.type, y.type)
    if to == BIGINT:
        return Typed(f"({x.sql} * {y.sql})", to)
    as_decimal = lambda v: f"CAST({v.sql} AS DECIMAL({v.type.digits[0]},{v.type.digits[1]}))"
    return fitted(half_even(f"({as_decimal(x)} * {as_decimal(y)})", to.b), to)


def half_even(sql: str, scale: int) -> str:
    return f"bround({sql}, {scale})"


def _quotient(n: str, d: str) -> str:
    """n / d for whole decimals of 38 digits, rounded half-even: the truncated quotient, moved by one if the rest says so."""
    q, r = f"({n} div {d})", f"({n} % {d})"
    up = f"(2 * abs({r}) > abs({d}) OR (2 * abs({r}) = abs({d}) AND {q} % 2 <> 0))"
    return f"({q} + CASE WHEN {up} THEN CAST(sign({n}) * sign({d}) AS BIGINT) ELSE 0L END)"


def quotient(n: str, n_scale: int, d: str, d_scale: int, to: SqlType) -> str:
    """Half-even n / d at the scale of `to`; n and d are SQL of decimals with these scales."""
    move = to.b - n_scale + d_scale
    ten = lambda e: f"CAST({10**e} AS DECIMAL({e + 1},0))"
    up, down = units_text(n, n_scale), units_text(d, d_scale)
    if move > 0:
        up = f"CAST({up} * {ten(move)} AS DECIMAL(38,0))"
    elif move < 0:
        down = f"CAST({down} * {ten(-move)} AS DECIMAL(38,0))"
    return f"CAST(CAST({_quotient(up, down)} AS DECIMAL(19,0)) * CAST(1 AS DECIMAL(1,0)) / {ten(to.b)} AS {to.spark})" if to.b else f"CAST({_quotient(up, down)} AS {to.spark})"


def units_text(sql: str, scale: int) -> str:
    """A decimal's unscaled value."""
    return f"CAST({sql} * {10**scale} AS DECIMAL(38,0))" if scale else f"CAST({sql} AS DECIMAL(38,0))"


def divide(x: Typed, y: Typed) -> Typed:
    return bound(_divide, x, y)


def _divide(x: Typed, y: Typed) -> Typed:
    to = ty.arithmetic("/", x.type, y.type)
    if to == BIGINT:
        zero = f"CASE WHEN {y.sql} = 0 AND {x.sql} IS NOT NULL THEN CAST({fail(DIVISION, 'division by zero')} AS BIGINT) ELSE {x.sql} div nullif({y.sql}, 0) END"
        return Typed(f"({zero})", to)
    q = quotient(f"CAST({x.sql} AS DECIMAL(19,{x.type.digits[1]}))", x.type.digits[1], f"nullif(CAST({y.sql} AS DECIMAL(19,{y.type.digits[1]})), 0)", y.type.digits[1], to)
    return Typed(f"(CASE WHEN {y.sql} = 0 AND {x.sql} IS NOT NULL THEN CAST({fail(DIVISION, 'division by zero')} AS {to.spark}) ELSE {q} END)", to)


def remainder(x: Typed, y: Typed) -> Typed:
    return bound(_remainder, x, y)


def _remainder(x: Typed, y: Typed) -> Typed:
    to = ty.arithmetic("%", x.type, y.type)
    body = f"{x.sql} % nullif({y.sql}, 0)" if to == BIGINT else f"CAST(CAST({x.sql} AS DECIMAL(38,{x.type.digits[1]})) % nullif(CAST({y.sql} AS DECIMAL(38,{y.type.digits[1]})), 0) AS {to.spark})"
    return Typed(f"(CASE WHEN {y.sql} = 0 AND {x.sql} IS NOT NULL THEN CAST({fail(DIVISION, 'division by zero')} AS {to.spark}) ELSE {body} END)", to)


def negate(x: Typed) -> Typed:
    ty.numeric(x.type)
    return Typed(f"(-{x.sql})", x.type)


def absolute(x: Typed) -> Typed:
    ty.numeric(x.type)
    return Typed(f"abs({x.sql})", x.type)


def whole(name: str, x: Typed) -> Typed:
    to = ty.whole(x.type)
    return x if to == BIGINT else fitted(f"{name}({x.sql})", to)


def round_to(x: Typed, k: int) -> Typed:
    to = ty.rounded(x.type, k)
    return x if to == BIGINT else fitted(half_even(x.sql, k), to)


def truncate(x: Typed, k: int) -> Typed:
    return bound(lambda v: _truncate(v, k), x)


def _truncate(x: Typed, k: int) -> Typed:
    to = ty.rounded(x.type, k)
    if to == BIGINT or k >= x.type.b:
        return x if to == BIGINT else fitted(x.sql, to)
    unit = f"CAST({'0.' + '0' * (k - 1) + '1' if k else '1'} AS DECIMAL({k + 1},{k}))"
    return fitted(f"({x.sql} - {x.sql} % {unit})", to)


def to_number(x: Typed, to: SqlType) -> Typed:
    """CAST between numbers: a scale that shrinks rounds half-even; a fraction that BIGINT would lose raises."""
    if to == BIGINT and x.type.name == "decimal":
        lost = fail(OUT_OF_RANGE, "the fraction would be lost")
        return bound(lambda v: Typed(f"(CASE WHEN {v.sql} <> CAST({v.sql} AS BIGINT) THEN CAST({lost} AS BIGINT) ELSE CAST({v.sql} AS BIGINT) END)", to), x)
    return fitted(half_even(x.sql, to.b) if x.type.name == "decimal" and to.b < x.type.b else x.sql, to)


# aggregates


def total(x: Typed) -> Typed:
    """SUM: any partial sum fits; only the final value may overflow."""
    return fitted(f"sum({wide(x)})", ty.summed(x.type))


def average(x: Typed) -> Typed:
    to, scale = ty.averaged(x.type), x.type.digits[1]
    body = lambda s, n: Typed(quotient(s.sql, scale, f"CAST(nullif({n.sql}, 0) AS DECIMAL(19,0))", 0, to), to)
    return bound(body, Typed(f"sum({wide(x)})", SqlType("decimal", 38, scale)), Typed(f"count({x.sql})", BIGINT))
