"""Display helpers: local time strings, relative minutes, fixed-point numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fraudspark.functions.scalar import half_up, local_ms


def ist_string(ts_ms: Column) -> Column:
    """``2024-01-31 23:05 IST``, whatever the session time zone is."""
    # Wall-clock arithmetic on a zone-free timestamp keeps the session zone out of it.
    day = F.date_add(
        F.lit("1970-01-01").cast("date"),
        F.floor(local_ms(ts_ms) / 86_400_000).cast("int"),
    )
    minute = F.floor(F.pmod(local_ms(ts_ms), F.lit(86_400_000)) / 60_000)
    hh = F.lpad(F.floor(minute / 60).cast("string"), 2, "0")
    mm = F.lpad(F.pmod(minute, F.lit(60)).cast("string"), 2, "0")
    return F.concat(day.cast("string"), F.lit(" "), hh, F.lit(":"), mm, F.lit(" IST"))


def minutes_before(anchor_ms: Column, ts_ms: Column) -> Column:
    return half_up((anchor_ms - ts_ms) / F.lit(60_000.0), 1)


def fixed(c: Column, digits: int) -> Column:
    """A number with a fixed count of decimals and no grouping, like ``3.10``."""
    if digits == 0:
        return F.floor(c + 0.5).cast("bigint").cast("string")
    scale = 10**digits
    units = F.floor(F.abs(c) * float(scale) + 0.5).cast("bigint")
    sign = F.when((c < 0) & (units > 0), F.lit("-")).otherwise(F.lit(""))
    whole = F.floor(units / scale).cast("bigint").cast("string")
    part = F.lpad(F.pmod(units, F.lit(scale)).cast("string"), digits, "0")
    return F.concat(sign, whole, F.lit("."), part)


def grouped(c: Column) -> Column:
    """A whole number with thousands separators, like ``12,345``."""
    return F.regexp_replace(fixed(c, 0), r"(\d)(?=(\d{3})+$)", "$1,")


def percent(c: Column) -> Column:
    return F.concat(fixed(c * 100.0, 0), F.lit("%"))
