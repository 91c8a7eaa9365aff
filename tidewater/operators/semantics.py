"""Layered column meanings, declared metrics as SQL, coverage and declaration changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAYERS = ["User", "Agent", "Declared", "Detected"]
FIELDS = ["role", "description", "label", "polarity", "unit"]
SQL_NAMES = {
    "count": "COUNT", "sum": "SUM", "avg": "AVG", "min": "MIN", "max": "MAX", "median": "MEDIAN", "std": "STDDEV", "first": "FIRST_VALUE", "last": "LAST_VALUE",
}


def resolved(opinions: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """One row per column: for every field the first opinion by layer (User, Agent, Declared, Detected), then the newest.

    opinions: (column, layer, at, fields..); a null field is no opinion, an empty text clears the field.
    """
    layer = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer"))
    pick = [
        F.nullif(F.min_by(f, F.when(F.col(f).isNotNull(), F.struct(layer.alias("l"), (-F.col("at")).alias("t")))), F.lit("")).alias(f) for f in fields
    ]
    return opinions.groupBy("column").agg(*pick)


def coverage(meanings: DataFrame) -> DataFrame:
    return meanings.agg(F.count(F.lit(1)).alias("columns"), F.count("role").alias("with_role"), F.count("description").alias("described"))


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Metric:
    name: str
    column: str
    aggregation: str
    filters: tuple[Predicate, ...] = ()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def predicate_sql(p: Predicate) -> str:
    c = _quoted(p.column)
    match p.op:
        case "isNull":
            return f"{c} IS NULL"
        case "isNotNull":
            return f"{c} IS NOT NULL"
        case "in":
            return f"{c} IN ({', '.join(map(literal, p.value))})" if p.value else "FALSE"
        case "contains":
            return f"contains(CAST({c} AS STRING), {literal(p.value)})"
    sign = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}[p.op]
    return f"{c} {sign} {literal(p.value)}"


def metric_sql(m: Metric) -> str:
    """AGG(column), or AGG(CASE WHEN filters THEN column END); a count of rows counts 1."""
    what = "1" if m.column == "*" else _quoted(m.column)
    if m.filters:
        what = f"CASE WHEN {' AND '.join(map(predicate_sql, m.filters))} THEN {what} END"
    return f"{SQL_NAMES[m.aggregation]}({what})"


def metrics(df: DataFrame, by: list[str], wanted: list[Metric]) -> DataFrame:
    return df.groupBy(*[F.col(_quoted(c)) for c in by]).agg(*[F.expr(metric_sql(m)).alias(m.name) for m in wanted])


def metric_match(known: list[Metric], column: str, aggregation: str, filters: set[Predicate]) -> Metric | None:
    """The declared metric that a series shows: same column and aggregation, its filters among the series'."""
    return next((m for m in known if m.column == column and m.aggregation == aggregation and set(m.filters) <= filters), None)


def changes(old: dict[str, dict], new: dict[str, dict]) -> list[tuple[str, str, str | None, object, object]]:
    """(kind, column, field, before, after) between two declarations of columns."""
    out: list[tuple] = [("added", c, None, None, None) for c in sorted(new.keys() - old.keys())]
    out += [("removed", c, None, None, None) for c in sorted(old.keys() - new.keys())]
    for c in sorted(old.keys() & new.keys()):
        for f in sorted(old[c].keys() | new[c].keys()):
            if old[c].get(f) != new[c].get(f):
                out.append(("changed", c, f, old[c].get(f), new[c].get(f)))
    return out


def carried(meanings: dict[str, dict], before: dict[str, str], after: dict[str, str], periods: set[str], reshaped: bool) -> dict[str, dict]:
    """Meanings of a model's output: an unchanged name and type keeps its own, a derived period is a time, an aggregate a measure."""
    out = {}
    for c, kind in after.items():
        if c in periods:
            out[c] = {"role": "Time"}
        elif before.get(c) == kind and c in meanings:
            out[c] = meanings[c]
        elif reshaped and kind in ("bigint", "int", "double", "float") or (reshaped and kind.startswith("decimal")):
            out[c] = {"role": "Measure"}
    return out


def many_to_one(df: DataFrame, other: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """A declared relationship as a left join; the other side must have each key once."""
    keys = [b for _, b in pairs]
    place = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    checked = other.withColumn("_n", place).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("a relationship's key is there twice"))).otherwise(F.col("_n")))
    test = [df[a] == checked[b] for a, b in pairs]
    return df.join(checked.where("_n = 1"), test, "left").drop("_n")
