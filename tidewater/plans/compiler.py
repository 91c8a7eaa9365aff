"""Operation chains as DataFrame plans.

Everything is declared; Catalyst orders, prunes and pushes down. Only a pivot looks at the data
before the plan is complete, for its header values.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.periods import period
from tidewater.plans import ops
from tidewater.plans.ops import RecipeError

#: Header values that a pivot may have.
MAX_HEADERS = 10_000
_COMPARE = {
    "eq": Column.__eq__, "ne": Column.__ne__, "gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__,
}


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _literal(value: Any) -> Column:
    if isinstance(value, (list, dict)):
        raise RecipeError(f"a filter can't compare with {value!r}")
    return F.lit(value)


def _coerced(column: Column, kind: T.DataType, value: Any) -> tuple[Column, Column]:
    """Both sides of a comparison; text against times is read as a time, a bare date as a calendar day."""
    if isinstance(value, str):
        text = value.strip()
        if isinstance(kind, T.DateType):
            return column, F.try_to_date(F.lit(text[:10]), "yyyy-MM-dd")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            if len(text) == 10:
                return F.to_date(column), F.try_to_date(F.lit(text), "yyyy-MM-dd")
            if len(text) == 16:
                text += ":00"
            return column, F.try_to_timestamp(F.lit(text.replace(" ", "T"))).cast(kind)
    return column, _literal(value)


def condition(schema: T.StructType, op: ops.Filter) -> Column:
    """One predicate; null compares with nothing, so its rows go, for `ne` too."""
    column, kind = named(op.column), schema[op.column].dataType
    match op.op:
        case "isNull":
            return column.isNull()
        case "isNotNull":
            return column.isNotNull()
        case "contains":
            if not isinstance(op.value, str):
                raise RecipeError("contains needs a text")
            return F.contains(column.cast("string"), F.lit(op.value))
        case "in":
            if not isinstance(op.value, list):
                raise RecipeError("in needs a list")
            return reduce(Column.__or__, (column == _literal(v) for v in op.value)) if op.value else F.lit(False)
    left, right = _coerced(column, kind, op.value)
    return _COMPARE[op.op](left, right)


def aggregate(function: str, column: Column, order: Column | None) -> Column:
    match function:
        case "count":
            return F.count(column)
        case "sum":
            return F.coalesce(F.sum(column), F.lit(0))
        case "avg":
            return F.avg(column)
        case "min":
            return F.min(column)
        case "max":
            return F.max(column)
        case "median":
            return F.median(column)
        case "std":
            return F.stddev_samp(column)
    if order is None:
        raise RecipeError(f"{function} needs an order of rows")
    return F.min_by(column, order) if function == "first" else F.max_by(column, order)


def _needs_order(operations: list[ops.Operation]) -> bool:
    return any(
        (isinstance(o, ops.GroupBy) and any(a.function in ("first", "last") for a in o.aggs)) or isinstance(o, ops.Pivot) for o in operations
    )


def _pivot(df: DataFrame, op: ops.Pivot, order: str) -> DataFrame:
    """Index values as rows, header values as columns in the order in which they first appear.

    Without an aggregation every cell must have one row. A null header is the column `null`.
    """
    headers = [
        r[0] for r in df.groupBy(named(op.columns).alias("h")).agg(F.min(named(order)).alias("o")).orderBy("o").limit(MAX_HEADERS + 1).collect()
    ]
    if len(headers) > MAX_HEADERS:
        raise RecipeError(f"'{op.columns}' has more than {MAX_HEADERS} values")
    value = named(op.values)
    if op.agg is None:
        cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("pivot without agg: a cell has several rows"))).otherwise(F.first(value))
    else:
        cell = aggregate(op.agg, value, named(order))
    mark = F.coalesce(named(op.columns).cast("string"), F.lit("null"))
    names = ["null" if h is None else str(h).lower() if isinstance(h, bool) else str(h) for h in headers]
    source = df.withColumn("_header", mark)
    if op.columns in op.index:
        raise RecipeError("a pivot's column can't be its index")
    out = source.groupBy(*map(named, op.index)).pivot("_header", names).agg(cell)
    if op.agg in ("count", "sum"):
        out = out.fillna(0, subset=[n for n in names])
    return out


def _step(df: DataFrame, op: ops.Operation, order: str | None) -> DataFrame:
    match op:
        case ops.Filter():
            return df.filter(condition(df.schema, op))
        case ops.Select(columns=cs):
            return df.select(*map(named, cs), *([named(order)] if order and order in df.columns and order not in cs else []))
        case ops.GroupBy(by=by, aggs=aggs):
            at = named(order) if order and order in df.columns else None
            made = [aggregate(a.function, F.lit(1) if a.column == "*" else named(a.column), at).alias(a.name) for a in aggs]
            return df.groupBy(*map(named, by)).agg(*made) if made else df.select(*map(named, by)).distinct()
        case ops.Pivot():
            return _pivot(df, op, order)
        case ops.Sort(by=c, descending=d):
            return df.orderBy(named(c).desc_nulls_first() if d else named(c).asc_nulls_first())
        case ops.Limit(n=n):
            return df.limit(n)
        case ops.WithColumns(columns=cs):
            return df.withColumns({c.name: period(named(c.column), df.schema[c.column].dataType, c.granularity) for c in cs})
    raise RecipeError(f"unknown operation {op!r}")


def compile_chain(df: DataFrame, recipe: ops.Recipe, order_by: str | None = None) -> DataFrame:
    """The chain with limits in place, as models run it.

    first, last and a pivot's header order need an order of rows: the column order_by, else the
    order in which the input is scanned.
    """
    ops.validate(recipe, df.columns)
    order, own = order_by, False
    if order is None and _needs_order(recipe.operations):
        order, own = "_scan_order", True
        df = df.withColumn(order, F.monotonically_increasing_id())
    out = reduce(lambda d, o: _step(d, o, order), recipe.operations, df)
    return out.drop(order) if own and order in out.columns else out


def run_query(df: DataFrame, recipe: ops.Recipe, order_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The chain as an interactive query runs it: (page, all rows).

    Limits are taken out, and the last one cuts the result of all other operations; counting the
    second DataFrame gives the total.
    """
    ops.validate(recipe, df.columns)
    limits = [o.n for o in recipe.operations if isinstance(o, ops.Limit)]
    rest = [o for o in recipe.operations if not isinstance(o, ops.Limit)]
    whole = compile_chain(df, ops.Recipe(rest, recipe.version), order_by) if rest else df
    return (whole.limit(limits[-1]) if limits else whole), whole
