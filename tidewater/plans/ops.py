"""The operations language: seven dataframe operators in an ordered chain, as data and as JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

VERSION = 1
FILTER_OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "in", "isNull", "isNotNull")
AGGREGATIONS = ("count", "sum", "avg", "min", "max", "median", "std", "first", "last")
GRANULARITIES = ("day", "week", "month", "quarter", "year")


class RecipeError(ValueError):
    """A chain that can't be run on its input."""


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Select:
    columns: list[str]


@dataclass(frozen=True)
class Agg:
    column: str
    function: str
    alias: str | None = None

    @property
    def name(self) -> str:
        """The output column: the alias, else `len` for a count of rows, else the source column."""
        return self.alias or ("len" if self.column == "*" else self.column)


@dataclass(frozen=True)
class GroupBy:
    by: list[str]
    aggs: list[Agg]


@dataclass(frozen=True)
class Pivot:
    index: list[str]
    columns: str
    values: str
    agg: str | None = None


@dataclass(frozen=True)
class Sort:
    by: str
    descending: bool = False


@dataclass(frozen=True)
class Limit:
    n: int


@dataclass(frozen=True)
class Period:
    name: str
    column: str
    granularity: str


@dataclass(frozen=True)
class WithColumns:
    columns: list[Period]


Operation = Filter | Select | GroupBy | Pivot | Sort | Limit | WithColumns


@dataclass(frozen=True)
class Recipe:
    operations: list[Operation] = field(default_factory=list)
    version: int = VERSION


def reads(op: Operation) -> list[str]:
    """Input columns that an operation looks at."""
    match op:
        case Filter(column=c):
            return [c]
        case Select(columns=cs):
            return list(cs)
        case GroupBy(by=by, aggs=aggs):
            return [*by, *(a.column for a in aggs if a.column != "*")]
        case Pivot(index=index, columns=c, values=v):
            return [*index, c, v]
        case Sort(by=c):
            return [c]
        case WithColumns(columns=cs):
            return [c.column for c in cs]
    return []


def _known_after(op: Operation, known: list[str] | None) -> list[str] | None:
    """Columns after an operation; None once a pivot has made them depend on the data."""
    match op:
        case Select(columns=cs):
            return list(cs)
        case GroupBy(by=by, aggs=aggs):
            return [*by, *(a.name for a in aggs)]
        case Pivot():
            return None
        case WithColumns(columns=cs):
            return None if known is None else [*known, *(c.name for c in cs)]
    return known


def validate(recipe: Recipe, input_columns: Iterable[str]) -> None:
    """Raises RecipeError unless every operation reads columns that its input has.

    Unlike a plain check of the input's names this follows selections and aggregations, so sorting
    by `count` after an unnamed count("*"), whose column is `len`, fails here and not at run time.
    """
    if recipe.version > VERSION:
        raise RecipeError(f"recipe version {recipe.version} is newer than {VERSION}")
    if not recipe.operations:
        raise RecipeError("a recipe needs at least one operation")
    known: list[str] | None = list(input_columns)
    for op in recipe.operations:
        if known is not None:
            for c in reads(op):
                if c not in known:
                    raise RecipeError(f"recipe references column '{c}', which the input does not have")
        match op:
            case Filter(op=o) if o not in FILTER_OPS:
                raise RecipeError(f"unknown filter '{o}'")
            case Pivot(agg=a) if a is not None and a not in AGGREGATIONS:
                raise RecipeError(f"unknown aggregation '{a}'")
            case Limit(n=n) if n < 0:
                raise RecipeError("a limit can't be negative")
            case GroupBy(by=by, aggs=aggs):
                for a in aggs:
                    if a.function not in AGGREGATIONS or (a.column == "*" and a.function != "count"):
                        raise RecipeError(f"unknown aggregation '{a.function}' of '{a.column}'")
                names = [*by, *(a.name for a in aggs)]
                if len(set(names)) < len(names):
                    raise RecipeError(f"duplicate output columns in {names}")
            case WithColumns(columns=cs):
                for c in cs:
                    if c.granularity not in GRANULARITIES:
                        raise RecipeError(f"unknown granularity '{c.granularity}'")
        known = _known_after(op, known)


_TAGS = {"filter": Filter, "select": Select, "groupBy": GroupBy, "pivot": Pivot, "sort": Sort, "limit": Limit, "withColumns": WithColumns}


def to_dict(op: Operation) -> dict:
    tag = next(t for t, c in _TAGS.items() if isinstance(op, c))
    match op:
        case GroupBy(by=by, aggs=aggs):
            return {"type": tag, "by": list(by), "aggs": [{"column": a.column, "function": a.function, "alias": a.alias} for a in aggs]}
        case WithColumns(columns=cs):
            return {"type": tag, "columns": [{"name": c.name, "expr": {"fn": "period", "column": c.column, "granularity": c.granularity}} for c in cs]}
    return {"type": tag, **vars(op)}


def from_dict(d: dict) -> Operation:
    body = {k: v for k, v in d.items() if k != "type"}
    kind = d.get("type")
    if kind not in _TAGS:
        raise RecipeError(f"unknown operation '{kind}'")
    try:
        if kind == "groupBy":
            return GroupBy(body["by"], [Agg(a["column"], a["function"], a.get("alias")) for a in body["aggs"]])
        if kind == "withColumns":
            for c in body["columns"]:
                if c["expr"].get("fn") != "period":
                    raise RecipeError(f"unknown expression '{c['expr'].get('fn')}'")
            return WithColumns([Period(c["name"], c["expr"]["column"], c["expr"]["granularity"]) for c in body["columns"]])
        return _TAGS[kind](**body)
    except (KeyError, TypeError) as e:
        raise RecipeError(f"operation '{kind}': {e}") from e


def dumps(recipe: Recipe) -> str:
    return json.dumps({"version": recipe.version, "operations": [to_dict(o) for o in recipe.operations]})


def loads(text: str) -> Recipe:
    raw = json.loads(text)
    if isinstance(raw, list):
        raw = {"operations": raw}
    return Recipe([from_dict(o) for o in raw["operations"]], raw.get("version", VERSION))
