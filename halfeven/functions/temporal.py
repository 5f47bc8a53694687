"""Dates, times and timestamps as Spark SQL text: strict texts, lossless casts, checked zones."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from ..errors import BAD_TEMPORAL, MISMATCH, TEMPORAL_RANGE, TRUNCATION, ZONE, EngineError
from .exact import Typed, bound, fail, failing
from .types import BIGINT, DATE, SqlType, decimal

# The canonical texts.
_DATE, _TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.][0-9]{1,6})?"
PATTERNS = {
    "date": f"^{_DATE}$",
    "time": f"^{_TIME}$",
    "timestamp": f"^{_DATE} {_TIME}$",
    "timestamptz": f"^{_DATE} {_TIME}[+-][0-9]{{2}}:[0-9]{{2}}$",
}
FIELDS = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "TIMEZONE_HOUR", "TIMEZONE_MINUTE")


def literal(name: str, text: str) -> Typed:
    """A temporal literal; a text of another form or a date that doesn't exist is an error."""
    if not re.fullmatch(PATTERNS[name][1:-1], text):
        raise EngineError(BAD_TEMPORAL, f"not a {name}: {text}")
    digits = len(text.split(".")[1].split("+")[0].split("-")[0]) if "." in text else 0
    try:
        if name == "date":
            datetime.strptime(text, "%Y-%m-%d")
            return Typed(f"DATE '{text}'", DATE, True)
        if name == "time":
            datetime.strptime(text.split(".")[0], "%H:%M:%S")
            return Typed(f"CAST('{text}' AS TIME({max(digits, 0)}))", SqlType("time", digits), True)
        if name == "timestamp":
            datetime.strptime(text.split(".")[0], "%Y-%m-%d %H:%M:%S")
            return Typed(f"TIMESTAMP_NTZ '{text}'", SqlType("timestamp", digits), True)
        instant = datetime.fromisoformat(text).astimezone(timezone.utc)
        return Typed(f"TIMESTAMP '{instant:%Y-%m-%d %H:%M:%S.%f}+00:00'", SqlType("timestamptz", digits), True)
    except ValueError:
        raise EngineError(TEMPORAL_RANGE, f"no such {name}: {text}") from None


def extract(field: str, x: Typed) -> Typed:
    has_date, has_time = x.type.name in ("date", "timestamp", "timestamptz"), x.type.name in ("time", "timestamp", "timestamptz")
    if field not in FIELDS or not (has_date if field in ("YEAR", "MONTH", "DAY") else x.type.name == "timestamptz" if field.startswith("TIMEZONE") else has_time):
        raise EngineError(MISMATCH, f"no {field} in {x.type.shown}")
    if field.startswith("TIMEZONE"):
        return Typed(f"(CASE WHEN {x.sql} IS NOT NULL THEN 0L END)", BIGINT)
    if field == "SECOND":
        return Typed(f"CAST(extract(SECOND FROM {x.sql}) AS DECIMAL({2 + x.type.a},{x.type.a}))", decimal(2 + x.type.a, x.type.a))
    return Typed(f"CAST(extract({field} FROM {x.sql}) AS BIGINT)", BIGINT)


def _checked_date(sql: str, near: str) -> Typed:
    return Typed(f"(CASE WHEN {sql} NOT BETWEEN DATE '0001-01-01' AND DATE '9999-12-31' THEN CAST({fail(TEMPORAL_RANGE, near)} AS DATE) ELSE {sql} END)", DATE)


def shift(op: str, x: Typed, days: Typed) -> Typed:
    """date + n, date - n; years 1 to 9999 only."""
    n = days.sql if op == "+" else f"(-{days.sql})"
    far = f"(CASE WHEN abs({n}) > 4000000 THEN CAST({fail(TEMPORAL_RANGE, 'date out of range')} AS INT) ELSE CAST({n} AS INT) END)"
    return _checked_date(f"date_add({x.sql}, {far})", "date out of range")


def days_between(x: Typed, y: Typed) -> Typed:
    return Typed(f"CAST(datediff({x.sql}, {y.sql}) AS BIGINT)", BIGINT)


# casts


def _fraction(p: int) -> str:
    return "." + "S" * p if p else ""


def to_text(x: Typed, to: SqlType) -> Typed:
    """The canonical text; 22001 if it is longer than the type."""
    p, name = x.type.a, x.type.name
    if name == "date":
        text = f"date_format({x.sql}, 'yyyy-MM-dd')"
    elif name == "time":
        text = f"date_format(TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, 0) + make_dt_interval(0, CAST(extract(HOUR FROM {x.sql}) AS INT), CAST(extract(MINUTE FROM {x.sql}) AS INT), extract(SECOND FROM {x.sql})), 'HH:mm:ss{_fraction(p)}')"
    else:
        zone = "+00:00" if name == "timestamptz" else ""
        local = f"CAST({x.sql} AS TIMESTAMP_NTZ)" if name == "timestamptz" else x.sql
        text = f"concat(date_format({local}, 'yyyy-MM-dd HH:mm:ss{_fraction(p)}'), '{zone}')"
    return fits(Typed(text, to), to)


def fits(x: Typed, to: SqlType) -> Typed:
    """A text held to the length of its type."""
    return Typed(f"(CASE WHEN char_length({x.sql}) > {to.a} THEN CAST({fail(TRUNCATION, f'text is longer than {to.a}')} AS STRING) ELSE {x.sql} END)", to)


def from_text(x: Typed, to: SqlType) -> Typed:
    """A strict parse: another form is 22007, a value out of range (or too many digits of seconds) 22008."""
    pattern = PATTERNS[to.name]
    parsed = {"date": f"CAST(try_to_date({x.sql}, 'yyyy-MM-dd') AS DATE)", "time": f"try_cast({x.sql} AS TIME(6))", "timestamp": f"try_cast({x.sql} AS TIMESTAMP_NTZ)", "timestamptz": f"try_cast({x.sql} AS TIMESTAMP)"}[to.name]
    kind = SqlType(to.name, 6).spark
    bad, gone = failing(BAD_TEMPORAL, f"not a {to.name}", kind), failing(TEMPORAL_RANGE, f"no such {to.name}", kind)
    value = f"(CASE WHEN {x.sql} NOT RLIKE '{pattern}' THEN {bad} WHEN {parsed} IS NULL AND {x.sql} IS NOT NULL THEN {gone} ELSE {parsed} END)"
    return precision(Typed(value, SqlType(to.name, 6)), to) if to.name != "date" else Typed(value, to)


def precision(x: Typed, to: SqlType) -> Typed:
    """Another precision of the same type; digits that would be lost are 22008."""
    if to.a >= x.type.a or to.name == "date":
        return Typed(f"CAST({x.sql} AS {to.spark})" if to.name == "time" else x.sql, to)
    lost = f"(CAST(extract(SECOND FROM {x.sql}) AS DECIMAL(8,6)) * {10**to.a}) % 1 <> 0"
    return Typed(f"(CASE WHEN {lost} THEN {failing(TEMPORAL_RANGE, 'seconds would lose digits', to.spark)} ELSE CAST({x.sql} AS {to.spark}) END)", to)


def to_date(x: Typed) -> Typed:
    """TIMESTAMP to DATE at midnight only."""
    d = f"CAST({x.sql} AS DATE)"
    return Typed(f"(CASE WHEN CAST({d} AS TIMESTAMP_NTZ) <> {x.sql} THEN CAST({fail(TEMPORAL_RANGE, 'not at midnight')} AS DATE) ELSE {d} END)", DATE)


def zone_name(name: str) -> str:
    """UTC, an offset up to 14:00 or a region with a slash; others are 22009."""
    from zoneinfo import ZoneInfo

    if name.upper() == "UTC":
        return "UTC"
    if found := re.fullmatch(r"([+-])([0-9]{2}):([0-9]{2})", name):
        if int(found[3]) < 60 and int(found[2]) * 60 + int(found[3]) <= 840:
            return name
    elif "/" in name and re.fullmatch(r"[A-Za-z0-9_+/-]+", name):
        try:
            ZoneInfo(name)
            return name
        except Exception:  # zoneinfo raises several kinds for unknown names
            pass
    raise EngineError(ZONE, f"no such time zone: {name}")


def at_zone(x: Typed, zone: str) -> Typed:
    """A local timestamp in a zone as an instant (gaps and overlaps are 22009), or an instant as that zone's local timestamp."""
    zone = zone_name(zone)
    if x.type.name == "timestamptz":
        return Typed(f"convert_timezone('UTC', '{zone}', CAST({x.sql} AS TIMESTAMP_NTZ))", SqlType("timestamp", x.type.a))
    if x.type.name != "timestamp":
        raise EngineError(MISMATCH, f"no time zone for {x.type.shown}")
    to = SqlType("timestamptz", x.type.a)
    if "/" not in zone:  # a fixed offset skips nothing
        return Typed(f"CAST(convert_timezone('{zone}', 'UTC', {x.sql}) AS TIMESTAMP)", to)
    return bound(lambda local: _one_instant(local, zone, to), x)


def _one_instant(local: Typed, zone: str, to: SqlType) -> Typed:
    """The instant that a region's clock shows as `local`; 22009 if there is none, or two.

    A skipped time does not come back from its instant.  Of a time that stands twice Java takes the earlier instant; the
    later one follows from the offset of a day later, and shows the same time.
    """
    clock = lambda t: f"convert_timezone('UTC', '{zone}', {t})"
    utc = f"convert_timezone('{zone}', 'UTC', {local.sql})"
    next_day = f"({utc} + INTERVAL '1' DAY)"
    later = f"({local.sql} - ({clock(next_day)} - {next_day}))"
    bad = f"{clock(utc)} <> {local.sql} OR {later} <> {utc} AND {clock(later)} = {local.sql}"
    return Typed(f"(CASE WHEN {bad} THEN CAST({fail(ZONE, 'the local time is skipped or stands twice')} AS TIMESTAMP) ELSE CAST({utc} AS TIMESTAMP) END)", to)
