"""How a page of results is ordered and drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nested_order(df: DataFrame, fields: list[str], measure: str | None = None, descending: bool = True) -> DataFrame:
    """Adds place: rows group by group, each level by its total of the measure, or by label without one.

    Ties go by label; the label `other` comes after all others and null after that. A page has few
    rows; its places are counted in one task.
    """
    order, prefix = [], []
    for f in fields:
        prefix.append(f)
        if measure:
            total = F.sum(F.col(f"`{measure}`")).over(Window.partitionBy(*[F.col(f"`{p}`") for p in prefix]))
            df = df.withColumn(f"_total_{len(prefix)}", total)
            order.append(F.desc(f"_total_{len(prefix)}") if descending else F.asc(f"_total_{len(prefix)}"))
        text = F.col(f"`{f}`").cast("string")
        order += [F.when(text.isNull(), 2).when(F.lower(text) == "other", 1).otherwise(0), text]
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    return df.withColumn("place", place).drop(*[f"_total_{i + 1}" for i in range(len(fields))])


def band(values: list[float], width: float = 2.0) -> tuple[list[float], list[float]]:
    """A chart's band of so many deviations around the mean."""
    n = len(values)
    mean = sum(values) / n
    spread = (sum((v - mean) ** 2 for v in values) / (n - 1)) ** 0.5 if n > 1 else 0.0
    return [mean - width * spread] * n, [mean + width * spread] * n


#: Column names by which the parts of a document are known, first match wins.
DOCUMENT_FIELDS = {
    "id": ["id", "uri"], "number": ["number"], "title": ["title", "subject", "name"], "body": ["body", "text", "description", "content"],
    "created": ["created_at", "timestamp", "date"], "url": ["url", "html_url", "link"],
}


def document_fields(columns: list[str]) -> dict[str, str]:
    """Which column holds which part of a document."""
    lower = {c.lower(): c for c in reversed(columns)}
    firsts = {part: next((n for n in names if n in lower), None) for part, names in DOCUMENT_FIELDS.items()}
    return {part: lower[name] for part, name in firsts.items() if name}


def merged_schema(detected: dict[str, str], resolved: dict[str, str | None]) -> dict[str, list[str] | str | None]:
    """Roles from declared meanings where there are any, else as detected: the time axis, dimensions and measures."""
    role = {c: (resolved.get(c) or detected[c]).lower() for c in detected}
    times = [c for c in detected if role[c] == "time"]
    declared = [c for c in times if (resolved.get(c) or "").lower() == "time"]
    return {
        "time": (declared or times or [None])[0],
        "dimensions": [c for c in detected if role[c] in ("dimension", "entity")],
        "measures": [c for c in detected if role[c] == "measure"],
    }


def due(last_started: float | None, interval: float, now: float) -> bool:
    """Whether a job that runs every so many seconds should start."""
    return last_started is None or now - last_started >= interval
