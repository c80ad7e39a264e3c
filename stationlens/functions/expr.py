"""Column builders that the operators share. All are JVM-side expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Timestamp layouts of trip files, tried in order; the last resort is Spark's own parser.
TRIP_TIME_LAYOUTS = ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def parse_time(c: Column, layouts: Iterable[str] = TRIP_TIME_LAYOUTS) -> Column:
    """The first layout that fits, null if none does (never an error)."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(x)) for x in layouts), F.try_to_timestamp(c))


def iso_weekday(c: Column) -> Column:
    """1 Monday to 7 Sunday."""
    return (F.weekday(c) + 1).cast("int")


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with microseconds kept."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def hash_parts(*parts: Column, null: str = "null") -> Column:
    """SHA-256 of the parts joined by ``|``, nulls written out so that they keep their place."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit(null)) for p in parts)), 256)


def codes(*rules: tuple[Column, str]) -> Column:
    """The codes of the conditions that hold, in order; an unknown condition counts as not holding."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(code)) for condition, code in rules)))


def missing_or(c: Column, wrong: Column) -> Column:
    return c.isNull() | wrong


def utc_text(c: Column) -> Column:
    """``2024-01-01T00:00:07Z``, to the second, in a UTC session."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def percent_of(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.when(whole > 0, 100.0 * part / whole).otherwise(0.0), digits)
