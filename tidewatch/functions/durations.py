"""Durations as whole microseconds, to and from text."""

from __future__ import annotations

import re
from datetime import timedelta

SECOND = 1_000_000
UNITS = {"ms": 1000, "s": SECOND, "m": 60 * SECOND, "h": 3600 * SECOND, "d": 86400 * SECOND, "w": 604800 * SECOND}
TEXT = re.compile(r"\s*(\d+(?:\.\d+)?)\s*(ms|[smhdw])\s*")


def micros(value: str | timedelta | int | float) -> int:
    """'45m', '1.5h', a timedelta, or a number of seconds, in microseconds."""
    if isinstance(value, timedelta):
        return value // timedelta(microseconds=1)
    if isinstance(value, int | float):
        return round(value * SECOND)
    m = TEXT.fullmatch(value)
    if not m:
        raise ValueError(f"not a duration: {value!r}")
    return round(float(m[1]) * UNITS[m[2]])


def duration_text(us: int) -> str:
    """One unit (w, d, h, m) where it divides evenly, else hours, minutes and rounded seconds."""
    if us == 0:
        return "0s"
    for unit in "wdhm":
        if us >= UNITS[unit] and us % UNITS[unit] == 0:
            return f"{us // UNITS[unit]}{unit}"
    left, parts = round(us / SECOND), ""
    for unit in "hms":
        n, left = divmod(left, UNITS[unit] // SECOND)
        parts += f"{n}{unit}" if n else ""
    return parts or f"{us / SECOND:g}s"


def duration_column(us):
    """duration_text() of a column of microseconds."""
    from pyspark.sql import functions as F

    whole = F.bround(us / F.lit(SECOND)).cast("bigint")
    piece = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    parts = F.concat(piece(F.floor(whole / 3600), "h"), piece(F.floor(whole / 60) % 60, "m"), piece(whole % 60, "s"))
    text = F.when(us == 0, "0s")
    for unit in "wdhm":
        text = text.when((us >= UNITS[unit]) & (us % UNITS[unit] == 0), F.concat(F.floor(us / UNITS[unit]).cast("string"), F.lit(unit)))
    return text.otherwise(F.when(parts != "", parts).otherwise(F.concat((us / SECOND).cast("string"), F.lit("s"))))
