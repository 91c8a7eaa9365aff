"""Period labels and date parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def label(day: Column, granularity: str) -> Column:
    """A date's period: 2025-12-29, 2026-W01 (ISO week year), 2025-12, 2025-Q4 or 2025."""
    match granularity:
        case "day":
            return F.date_format(day, "yyyy-MM-dd")
        case "week":
            return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
        case "month":
            return F.date_format(day, "yyyy-MM")
        case "quarter":
            return F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day).cast("string"))
        case "year":
            return F.date_format(day, "yyyy")
    raise ValueError(f"unknown granularity '{granularity}'")


def strict_day(column: Column) -> Column:
    """The date in a string's first ten characters, read as yyyy-MM-dd; null if they aren't one."""
    head = F.substring(column, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def period(column: Column, kind: T.DataType, granularity: str) -> Column:
    """The operations language's derived period: strings by their first ten characters, dates, timestamps."""
    if isinstance(kind, T.StringType):
        return label(strict_day(column), granularity)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return label(F.to_date(column), granularity)
    raise TypeError(f"a period needs a string, date or timestamp, not {kind.simpleString()}")


#: Date formats in the order in which they are tried.
DATE_FORMATS = [
    "yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "MM-dd-yyyy",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX", "M/d/yyyy",
]


def parsed_timestamp(column: Column) -> Column:
    """A string as a timestamp without zone, by the first format that fits; offsets are brought to UTC.

    A slash date that fits day-first is read day-first.
    """
    plain = [F.try_to_timestamp(column, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS if "XXX" not in f]
    fraction = F.regexp_replace(column, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:\.\d+)?(Z|[+-]\d{2}:\d{2})$", "$1T$2$3")
    zoned = F.to_utc_timestamp(F.try_to_timestamp(fraction, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.current_timezone()).cast("timestamp_ntz")
    return F.coalesce(*plain[:8], zoned, *plain[8:])


def any_day(column: Column, kind: T.DataType) -> Column:
    """A date from whatever a time column holds: dates, timestamps, text, or seconds or milliseconds since 1970."""
    if isinstance(kind, T.StringType):
        return F.to_date(parsed_timestamp(column))
    if isinstance(kind, (T.LongType, T.IntegerType, T.DoubleType, T.FloatType, T.ShortType)):
        seconds = F.when(column > 4102444800, column / 1000).otherwise(column.cast("double"))
        return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    return F.to_date(column)


def shifted(kind: str, start: Column, steps: Column) -> Column:
    """The first day of the period `steps` weeks or months after the one that begins at `start`."""
    return F.date_add(start, (steps * 7).cast("int")) if kind == "week" else F.add_months(start, steps.cast("int"))
