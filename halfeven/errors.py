"""Errors with SQLSTATE codes."""

from __future__ import annotations

# The SQLSTATE codes of the dialect.
SYNTAX, UNSUPPORTED, MISMATCH, UNDEFINED = "42601", "0A000", "42804", "42704"
TRUNCATION, OUT_OF_RANGE, BAD_TEMPORAL, TEMPORAL_RANGE, ZONE, DIVISION = "22001", "22003", "22007", "22008", "22009", "22012"
CARDINALITY, NOT_NULL, FOREIGN_KEY, UNIQUE, CHECK = "21000", "23502", "23503", "23505", "23514"
PARAMETERS, ACCESS, CONFLICT, TRANSACTION = "07001", "42501", "40001", "25000"

#: Spark's error conditions and the codes they stand for.
_CONDITIONS = {
    "DIVIDE_BY_ZERO": DIVISION,
    "REMAINDER_BY_ZERO": DIVISION,
    "ARITHMETIC_OVERFLOW": OUT_OF_RANGE,
    "NUMERIC_VALUE_OUT_OF_RANGE": OUT_OF_RANGE,
    "CAST_OVERFLOW": OUT_OF_RANGE,
    "SCALAR_SUBQUERY_TOO_MANY_ROWS": CARDINALITY,
    "CAST_INVALID_INPUT": BAD_TEMPORAL,
    "DATETIME_OVERFLOW": TEMPORAL_RANGE,
}


class EngineError(Exception):
    """A statement failed; `sqlstate` says why."""

    def __init__(self, sqlstate: str, message: str):
        super().__init__(f"[{sqlstate}] {message}")
        self.sqlstate = sqlstate


def translated(error: Exception) -> EngineError | None:
    """The engine's error for one that Spark raised while running a query, if it has one.

    Checks that the compiler adds raise `SQLSTATE:xxxxx text` by raise_error().
    """
    import re

    text = str(error)
    if found := re.search(r"USER_RAISED_EXCEPTION\] SQLSTATE:(\w{5}) (.*?)(?: SQLSTATE: P0001)?$", text, re.M):
        return EngineError(found[1], found[2].strip())
    for condition, state in _CONDITIONS.items():
        if condition in text:
            return EngineError(state, condition.lower().replace("_", " "))
    return None
