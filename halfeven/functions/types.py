"""The dialect's types and how results of expressions are typed.

Decimals have at most 18 digits.  BIGINT takes part in decimal arithmetic as 19 digits without a
fraction.  A result that needs more than 18 digits keeps its integer digits and gives up scale.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import MISMATCH, EngineError

MAX_DIGITS = 18
NUMERIC, TEMPORAL = ("bigint", "decimal"), ("date", "time", "timestamp", "timestamptz")


@dataclass(frozen=True)
class SqlType:
    """name: bigint, boolean, decimal, varchar, date, time, timestamp, timestamptz or null; a: precision or length, b: scale."""

    name: str
    a: int = 0
    b: int = 0

    @property
    def spark(self) -> str:
        return {
            "decimal": f"DECIMAL({self.a},{self.b})",
            "varchar": "STRING",
            "timestamp": "TIMESTAMP_NTZ",
            "timestamptz": "TIMESTAMP",
            "time": f"TIME({self.a})",
            "null": "BIGINT",
        }.get(self.name, self.name.upper())

    @property
    def shown(self) -> str:
        """The type as the dialect writes it."""
        if self.name == "decimal":
            return f"DECIMAL({self.a},{self.b})"
        if self.name in ("varchar", "time", "timestamp"):
            return f"{self.name.upper()}({self.a})"
        return f"TIMESTAMP({self.a}) WITH TIME ZONE" if self.name == "timestamptz" else self.name.upper()

    @property
    def digits(self) -> tuple[int, int]:
        """Precision and scale as arithmetic sees them."""
        return (19, 0) if self.name in ("bigint", "null") else (self.a, self.b)


BIGINT, BOOLEAN, DATE, NULL = SqlType("bigint"), SqlType("boolean"), SqlType("date"), SqlType("null")


def decimal(p: int, s: int) -> SqlType:
    return SqlType("decimal", p, s)


def bounded(integer: int, scale: int) -> SqlType:
    """A decimal with these digits, cut to 18: integer digits stay, the scale gives way."""
    integer = min(integer, MAX_DIGITS)
    scale = min(scale, MAX_DIGITS - integer)
    return decimal(max(1, integer + scale), scale)


def numeric(*types: SqlType) -> None:
    for t in types:
        if t.name not in (*NUMERIC, "null"):
            raise EngineError(MISMATCH, f"a number is needed, not {t.shown}")


def arithmetic(op: str, x: SqlType, y: SqlType) -> SqlType:
    """The type of x op y."""
    numeric(x, y)
    if "decimal" not in (x.name, y.name):
        return BIGINT
    (p1, s1), (p2, s2) = x.digits, y.digits
    i1, i2 = p1 - s1, p2 - s2
    if op in "+-":
        return bounded(max(i1, i2) + 1, max(s1, s2))
    if op == "*":
        return bounded(i1 + i2, s1 + s2)
    if op == "/":
        return bounded(i1 + s2, max(6, s1 + p2 + 1))
    return bounded(min(i1, i2), max(s1, s2))


def rounded(x: SqlType, k: int) -> SqlType:
    """The type of ROUND or TRUNCATE to k places."""
    numeric(x)
    if x.name != "decimal":
        if k:
            raise EngineError(MISMATCH, "BIGINT is rounded to 0 places only")
        return BIGINT
    return bounded(x.a - x.b, k)


def whole(x: SqlType) -> SqlType:
    """The type of CEIL and FLOOR."""
    numeric(x)
    return decimal(MAX_DIGITS, 0) if x.name == "decimal" else BIGINT


def summed(x: SqlType) -> SqlType:
    numeric(x)
    return decimal(MAX_DIGITS, x.b) if x.name == "decimal" else BIGINT


def averaged(x: SqlType) -> SqlType:
    numeric(x)
    p, s = x.digits
    return decimal(MAX_DIGITS, min(max(s, 6), max(0, MAX_DIGITS - (p - s))))


def comparable(x: SqlType, y: SqlType) -> None:
    """Operands compare within one family only; temporal ones need the same type."""
    family = lambda t: "number" if t.name in NUMERIC else t.name
    if "null" not in (x.name, y.name) and family(x) != family(y):
        raise EngineError(MISMATCH, f"{x.shown} and {y.shown} do not compare")


def common(types: list[SqlType]) -> SqlType:
    """A type that holds values of all of these."""
    out = NULL
    for t in types:
        comparable(out, t)
        if out.name == "null":
            out = t
        elif t.name == "decimal" or out.name == "decimal" and t.name == "bigint":
            (p1, s1), (p2, s2) = out.digits, t.digits
            out = bounded(max(p1 - s1, p2 - s2), max(s1, s2))
        elif t.name in ("varchar", "time", "timestamp", "timestamptz"):
            out = SqlType(t.name, max(t.a, out.a))
    return out


def of_spark(kind) -> SqlType:
    """The dialect's type for a Spark column type: integers are BIGINT, texts VARCHAR(255)."""
    from pyspark.sql import types as T

    if isinstance(kind, T.DecimalType):
        return decimal(kind.precision, kind.scale)
    names = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint", "boolean": "boolean", "string": "varchar", "date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamptz"}
    name = names.get(kind.simpleString()) or ("time" if kind.simpleString().startswith("time(") else None)
    if name is None:
        raise EngineError(MISMATCH, f"columns of type {kind.simpleString()} have no type here")
    return SqlType(name, {"varchar": 255, "timestamp": 6, "timestamptz": 6, "time": 6}.get(name, 0))
