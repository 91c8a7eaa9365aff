import datetime as dt

import pytest

from tidewater.plans import ops
from tidewater.plans.compiler import compile_chain, run_query
from tidewater.plans.ops import Agg, Filter, GroupBy, Limit, Period, Pivot, Recipe, RecipeError, Select, Sort, WithColumns


@pytest.fixture(scope="module")
def tickets(spark):
    rows = [(1, "a", "x", "en"), (2, "a", "x", "sv"), (3, "a", "y", "en"), (4, "b", "y", "en"), (5, "b", "z", "en"), (6, "b", "z", "sv")]
    return spark.createDataFrame(rows, "id int, category string, subcategory string, language string")


def run(df, *operations, order_by=None):
    return compile_chain(df, Recipe(list(operations)), order_by)


def test_pivot_keeps_index_as_rows_and_headers_in_first_order(tickets):
    out = run(tickets, Pivot(["category"], "subcategory", "id", "count"), order_by="id")
    assert out.columns == ["category", "x", "y", "z"]
    assert sorted(map(tuple, out.collect())) == [("a", 2, 1, 0), ("b", 0, 1, 2)]


def test_pivot_counts_its_own_column_and_null_headers(spark, tickets):
    assert sorted(map(tuple, run(tickets, Pivot(["category"], "language", "language", "count"), order_by="id").collect())) == [("a", 2, 1), ("b", 2, 1)]
    df = spark.createDataFrame([(1, "p", None), (2, "p", "k")], "id int, i string, h string")
    assert run(df, Pivot(["i"], "h", "id", "max"), order_by="id").columns == ["i", "null", "k"]


def test_pivot_without_aggregation_fails_on_duplicates(tickets):
    with pytest.raises(Exception, match="several rows"):
        run(tickets, Pivot(["category"], "subcategory", "id"), order_by="id").collect()


def test_periods_of_text(spark):
    df = spark.createDataFrame([("2024-12-30T10:00:00Z",), ("2025-01-01",), ("2024-03-15T00:00:00+02:00",), ("bogus",), (None,)], "ts string")
    out = run(df, WithColumns([Period(g, "ts", g) for g in ops.GRANULARITIES])).drop("ts").collect()
    assert [tuple(r) for r in out] == [
        ("2024-12-30", "2025-W01", "2024-12", "2024-Q4", "2024"), ("2025-01-01", "2025-W01", "2025-01", "2025-Q1", "2025"),
        ("2024-03-15", "2024-W11", "2024-03", "2024-Q1", "2024"), (None,) * 5, (None,) * 5,
    ]


def test_a_period_needs_a_time(spark):
    with pytest.raises(TypeError):
        run(spark.createDataFrame([(1,)], "n int"), WithColumns([Period("p", "n", "day")]))


def test_temporal_filters(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 15), dt.datetime(2024, 1, 15, 10, 30)), (2, dt.date(2024, 2, 1), dt.datetime(2024, 2, 1))], "id int, d date, t timestamp_ntz")
    ids = lambda f: [r.id for r in run(df, f, Sort("id")).collect()]
    assert ids(Filter("d", "eq", "2024-01-15")) == [1] and ids(Filter("t", "eq", "2024-01-15")) == [1]
    assert ids(Filter("t", "gt", "2024-01-15T10:30")) == [2] and ids(Filter("t", "gte", "2024-01-15 10:30")) == [1, 2]
    assert ids(Filter("d", "gt", "never")) == [] and ids(Filter("t", "ne", "2024-01-15")) == [2]


def test_filters_on_nulls_and_odd_values(spark):
    df = spark.createDataFrame([(1, "a.b", 5), (2, None, 6), (3, "A%", None)], "`i.d` int, s string, n int")
    ids = lambda f: [r[0] for r in run(df, f, Sort("i.d"), Select(["i.d"])).collect()]
    assert ids(Filter("s", "ne", "a.b")) == [3] and ids(Filter("s", "isNull")) == [2] and ids(Filter("s", "eq", None)) == []
    assert ids(Filter("s", "contains", "%")) == [3] and ids(Filter("n", "in", [5, 7])) == [1] and ids(Filter("n", "in", [])) == []
    for bad in (Filter("s", "contains", 4), Filter("n", "in", 4), Filter("n", "eq", [1])):
        with pytest.raises(RecipeError):
            ids(bad)


def test_aggregates_of_nulls_and_single_rows(spark):
    df = spark.createDataFrame([(1, "g", None), (2, "g", 3.0), (3, None, None)], "o int, g string, v double")
    aggs = [Agg("*", "count"), Agg("v", "count", "c"), Agg("v", "sum", "s"), Agg("v", "std", "d"), Agg("v", "first", "f"), Agg("v", "last", "l"), Agg("v", "median", "m")]
    out = {r.g: tuple(r)[1:] for r in run(df, GroupBy(["g"], aggs), order_by="o").collect()}
    assert out == {"g": (2, 1, 3.0, None, None, 3.0, 3.0), None: (1, 0, 0.0, None, None, None, None)}


def test_sort_puts_nulls_first_both_ways(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "n int")
    assert [r.n for r in run(df, Sort("n")).collect()] == [None, 1, 2] and [r.n for r in run(df, Sort("n", True)).collect()] == [None, 2, 1]


def test_limits_are_hoisted_in_queries_only(spark):
    df = spark.range(20).toDF("n")
    chain = Recipe([Limit(5), Filter("n", "gte", 3), Sort("n"), Limit(9)])
    page, whole = run_query(df, chain)
    assert page.count() == 9 and whole.count() == 17 and compile_chain(df.coalesce(1), chain).count() == 2


def test_round_trip_and_validation():
    recipe = Recipe([Filter("a", "eq", 1), WithColumns([Period("m", "d", "month")]), GroupBy(["m"], [Agg("*", "count"), Agg("a", "sum", "s")]), Sort("s", True), Limit(3), Select(["m"])])
    assert ops.loads(ops.dumps(recipe)) == recipe and ops.loads('[{"type": "limit", "n": 1}]').version == 1
    ops.validate(recipe, ["a", "d"])
    for bad, columns in [
        (Recipe([]), ["a"]), (Recipe([Select(["b"])]), ["a"]), (Recipe([Limit(1)], 2), ["a"]), (Recipe([Select(["a"]), Sort("d")]), ["a", "d"]),
        (Recipe([GroupBy(["a"], [Agg("*", "count")]), Sort("count")]), ["a"]), (Recipe([GroupBy(["a"], [Agg("a", "sum")])]), ["a"]), (Recipe([Filter("a", "like", 1)]), ["a"]),
    ]:
        with pytest.raises(RecipeError):
            ops.validate(bad, columns)
    for text in ('[{"type": "join"}]', '[{"type": "limit"}]', '[{"type": "withColumns", "columns": [{"name": "x", "expr": {"fn": "raw", "column": "a"}}]}]'):
        with pytest.raises(RecipeError):
            ops.loads(text)


def test_plans_push_filters_and_prune_columns(spark, tmp_path):
    spark.range(100).selectExpr("id a", "id b", "id c").write.parquet(f"{tmp_path}/t")
    df = run(spark.read.parquet(f"{tmp_path}/t"), Filter("a", "gt", 5), GroupBy(["b"], [Agg("*", "count")]))
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThan(a,5)" in plan and "ReadSchema: struct<a:bigint,b:bigint>" in plan
