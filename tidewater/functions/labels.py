"""Period keys of events and what comes so many periods later; compact numbers."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.periods import label, parsed_timestamp


def period_key(timestamp: Column, kind: str) -> Column:
    """A text time's ISO week (kind `week`) or month; its first ten characters where it can't be read."""
    day = F.to_date(parsed_timestamp(timestamp))
    return F.coalesce(label(day, "week" if kind == "week" else "month"), F.substring(timestamp, 1, 10))


def offset_key(key: str, steps: int) -> str:
    """The key so many weeks or months on, over the ends of years; a key of neither kind stays."""
    if m := re.fullmatch(r"(\d{4})-W(\d{2})", key):
        try:
            day = dt.date.fromisocalendar(int(m[1]), int(m[2]), 1) + dt.timedelta(weeks=steps)
        except ValueError:
            return key
        year, week, _ = day.isocalendar()
        return f"{year:04d}-W{week:02d}"
    if (m := re.fullmatch(r"(\d{4})-(\d{2})", key)) and 1 <= int(m[2]) <= 12:
        months = int(m[1]) * 12 + int(m[2]) - 1 + steps
        return f"{months // 12:04d}-{months % 12 + 1:02d}"
    return key


def compact(x: float | None) -> str:
    """1234567 as 1.2M; small numbers with up to two decimals."""
    if x is None or x != x:
        return "-"
    for size, mark in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")):
        if abs(x) >= size:
            return f"{x / size:.1f}".rstrip("0").rstrip(".") + mark
    return f"{x:.2f}".rstrip("0").rstrip(".") if x != int(x) else str(int(x))
