"""Column functions: escaping, key formats, times."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ParseError

NANOS = 1_000_000_000


def escape(value: Column) -> Column:
    """Line ends and tabs as two characters each, for a line of text."""
    return F.replace(F.replace(value, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))


def unescape(value: Column) -> Column:
    """The inverse of :func:`escape`; other backslashes stay as they are."""
    return F.replace(F.replace(value, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))


def pad(value: Column, width: int, left: bool = True, fill: str = " ") -> Column:
    """At least ``width`` characters; longer values are not cut."""
    padded = F.lpad(value, width, fill) if left else F.rpad(value, width, fill)
    return F.when(F.length(value) < width, padded).otherwise(value)


def key_format(value: Column, form: str) -> Column:
    """A component of a row key by its format: ``%0n`` zeros in front, ``%n`` blanks in front, ``%-n`` blanks behind."""
    m = re.fullmatch(r"%(0|-)?([0-9]+)", form)
    if not m:
        raise ParseError(f"bad key format '{form}'")
    return pad(value, int(m[2]), left=m[1] != "-", fill="0" if m[1] == "0" else " ")


def family_of(column: Column) -> Column:
    return F.substring_index(column, ":", 1)


def qualifier_of(column: Column) -> Column:
    """What follows the first colon; empty without one."""
    return F.when(F.contains(column, F.lit(":")), F.substring(column, F.locate(":", column) + 1, F.length(column))).otherwise(F.lit(""))


def nanos_of(stamp: Column) -> Column:
    """Nanoseconds of a timestamp column; one without a zone is taken as UTC, whatever the session's zone."""
    moment = stamp.cast("timestamp")
    as_utc = F.when(F.typeof(stamp) == "timestamp_ntz", F.from_utc_timestamp(moment, F.current_timezone())).otherwise(moment)
    return F.unix_micros(as_utc) * 1000


def render_nanos(ts: Column) -> Column:
    """``YYYY-MM-DD hh:mm:ss.nnnnnnnnn`` in UTC, independent of the session's zone."""
    rest = F.pmod(ts, F.lit(NANOS))
    seconds = F.round((ts - rest) / F.lit(NANOS)).cast("long")  # a whole number but for the division's rounding
    days = F.floor(seconds / 86_400).cast("int")
    second = F.pmod(seconds, F.lit(86_400))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(second / 3600)), two(F.floor(second / 60) % 60), two(second % 60))
    return F.concat(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd"), F.lit(" "), clock, F.lit("."), F.lpad(rest.cast("string"), 9, "0"))


def parse_datetime(text: str) -> int:
    """Nanoseconds of a full date or datetime literal in UTC.

    What follows the dot is a number of nanoseconds, not a fraction.
    """
    m = re.fullmatch(r"\s*(\d{4})-(\d{2})-(\d{2})(?:\s*(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?)?\s*", text)
    if not m:
        raise ParseError(f"'{text}' is not a date")
    try:
        moment = datetime(*(int(x or 0) for x in m.groups()[:6]), tzinfo=UTC)
    except ValueError as e:
        raise ParseError(f"'{text}' is not a date: {e}") from None
    return int(moment.timestamp()) * NANOS + int(m[7] or 0)


def datetime_nanos(text: Column) -> Column:
    """Nanoseconds of ``YYYY-MM-DD HH:MM:SS`` in UTC; null for anything else."""
    whole = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(F.concat(text, F.lit(" UTC")), F.lit("yyyy-MM-dd HH:mm:ss z")))
    return F.unix_micros(whole) * 1000


#: Seconds of each unit; a month has thirty days.
UNITS = {"MONTH": 2_592_000, "WEEK": 604_800, "DAY": 86_400, "HOUR": 3_600, "MINUTE": 60, "SECOND": 1}


def seconds_of(number: float, unit: str = "SECONDS") -> int:
    """A duration in whole seconds; the rest is cut off."""
    return int(number * UNITS[unit.upper().removesuffix("S")])
