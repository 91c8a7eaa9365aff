"""Registered queries of the operations language, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.plans import ops
from tidewater.plans.compiler import compile_chain, run_query

Q: dict = {}
S: dict[str, str] = {}


def _chain(name: str, table: str, operations: list[dict], sql: str, order_by: str | None = None, page: bool = False) -> None:
    recipe = ops.Recipe([ops.from_dict(o) for o in operations])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return run_query(df, recipe, order_by)[0] if page else compile_chain(df, recipe, order_by)

    Q[name], S[name] = run, sql


def f(column: str, op: str, value=None) -> dict:
    return {"type": "filter", "column": column, "op": op, "value": value}


def per(name: str, column: str, granularity: str) -> dict:
    return {"type": "withColumns", "columns": [{"name": name, "expr": {"fn": "period", "column": column, "granularity": granularity}}]}


def group(by: list[str], *aggs: tuple) -> dict:
    return {"type": "groupBy", "by": by, "aggs": [{"column": c, "function": fn, "alias": a} for c, fn, a in aggs]}


_chain(
    "chain_monthly_revenue", "lineitem",
    [
        f("l_quantity", "gte", 10), per("month", "l_shipdate", "month"),
        group(["month", "l_returnflag"], ("l_quantity", "sum", "quantity"), ("*", "count", "lines"), ("l_linenumber", "max", "lines_most")),
        {"type": "sort", "by": "month", "descending": True},
    ],
    """SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag, sum(l_quantity) AS quantity, count(*) AS lines, max(l_linenumber) AS lines_most
       FROM lineitem WHERE l_quantity >= 10 GROUP BY 1, 2""",
)
for _g, _fmt in {
    "day": "strftime(o_orderdate, '%Y-%m-%d')",
    "week": "strftime(o_orderdate, '%G-W%V')",
    "month": "strftime(o_orderdate, '%Y-%m')",
    "quarter": "strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate)",
    "year": "strftime(o_orderdate, '%Y')",
}.items():
    _chain(
        f"chain_period_{_g}", "orders",
        [per("period", "o_orderdate", _g), group(["period"], ("*", "count", "n"), ("o_custkey", "min", "first_customer"))],
        f"SELECT {_fmt} AS period, count(*) AS n, min(o_custkey) AS first_customer FROM orders GROUP BY 1",
    )
for _op, _sign in {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}.items():
    _chain(
        f"chain_filter_{_op}", "lineitem", [f("l_linenumber", _op, 3), group(["l_linenumber", "l_linestatus"], ("*", "count", None))],
        f"SELECT l_linenumber, l_linestatus, count(*) AS len FROM lineitem WHERE l_linenumber {_sign} 3 GROUP BY 1, 2",
    )
    _chain(
        f"chain_filter_day_{_op}", "orders", [f("o_orderdate", _op, "1997-03-15"), group(["o_orderstatus"], ("*", "count", "n"))],
        f"SELECT o_orderstatus, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) {_sign} DATE '1997-03-15' GROUP BY 1",
    )
_chain(
    "chain_filter_minute", "events", [f("ts", "gte", "2024-01-10T10:30"), f("ts", "lt", "2024-02-01 00:00"), group(["event_type"], ("*", "count", "n"))],
    "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10 10:30:00' AND ts < TIMESTAMP '2024-02-01 00:00:00' GROUP BY 1",
)
_chain(
    "chain_filter_unparsable", "orders", [f("o_orderdate", "gt", "no date"), {"type": "select", "columns": ["o_orderkey"]}],
    "SELECT o_orderkey FROM orders WHERE false",
)
_chain(
    "chain_contains", "part", [f("p_type", "contains", "A"), f("p_size", "contains", "1"), {"type": "select", "columns": ["p_partkey", "p_type", "p_size"]}],
    "SELECT p_partkey, p_type, p_size FROM part WHERE contains(p_type, 'A') AND contains(CAST(p_size AS VARCHAR), '1')",
)
_chain(
    "chain_in", "customer", [f("c_mktsegment", "in", ["BUILDING", "MACHINERY", None]), {"type": "select", "columns": ["c_custkey", "c_mktsegment"]}],
    "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
)
_chain("chain_in_empty", "customer", [f("c_mktsegment", "in", []), {"type": "select", "columns": ["c_custkey"]}], "SELECT c_custkey FROM customer WHERE false")
_chain("chain_eq_null", "customer", [f("c_name", "eq", None), {"type": "select", "columns": ["c_custkey"]}], "SELECT c_custkey FROM customer WHERE false")
_chain(
    "chain_is_null", "documents", [f("lang", "isNull"), group([], ("*", "count", "n"))], "SELECT count(*) AS n FROM documents WHERE lang IS NULL",
)
_chain(
    "chain_is_not_null", "documents", [f("lang", "isNotNull"), group(["lang"], ("doc_id", "count", "n"), ("n_chars", "sum", "chars"))],
    "SELECT lang, count(doc_id) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang IS NOT NULL GROUP BY 1",
)
_chain(
    "chain_aggregates", "part",
    [group(["p_brand"], ("p_size", "count", "n"), ("p_size", "sum", "total"), ("p_size", "avg", "mean"), ("p_size", "min", "low"), ("p_size", "max", "high"))],
    "SELECT p_brand, count(p_size) AS n, CAST(sum(p_size) AS BIGINT) AS total, avg(p_size) AS mean, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY 1",
)
_chain(
    "chain_median", "lineitem", [group(["l_returnflag"], ("l_quantity", "median", "middle"))],
    "SELECT l_returnflag, median(l_quantity) AS middle FROM lineitem GROUP BY 1",
)
_chain(
    "chain_std_single", "region", [group(["r_regionkey"], ("r_regionkey", "std", "spread"))],
    "SELECT r_regionkey, stddev_samp(r_regionkey) AS spread FROM region GROUP BY 1",
)
_chain(
    "chain_first_last", "events", [group(["event_type"], ("user_id", "first", "first_user"), ("user_id", "last", "last_user"))],
    "SELECT event_type, min_by(user_id, event_id) AS first_user, max_by(user_id, event_id) AS last_user FROM events GROUP BY 1", order_by="event_id",
)
_chain(
    "chain_having", "customer", [group(["c_nationkey"], ("*", "count", None)), f("len", "gt", 1), {"type": "sort", "by": "len"}],
    "SELECT c_nationkey, count(*) AS len FROM customer GROUP BY 1 HAVING count(*) > 1",
)
_chain(
    "chain_sort_limit", "orders", [{"type": "sort", "by": "o_orderkey", "descending": True}, {"type": "limit", "n": 25}, {"type": "select", "columns": ["o_orderkey", "o_custkey"]}],
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 25",
)
_chain(
    "chain_limit_in_place", "orders",
    [{"type": "sort", "by": "o_orderkey"}, {"type": "limit", "n": 40}, f("o_orderstatus", "eq", "F"), {"type": "select", "columns": ["o_orderkey"]}],
    "SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 40) WHERE o_orderstatus = 'F'",
)
_chain(
    "query_limit_hoisted", "orders",
    [{"type": "limit", "n": 99}, f("o_orderstatus", "eq", "F"), {"type": "select", "columns": ["o_orderkey"]}, {"type": "sort", "by": "o_orderkey"}, {"type": "limit", "n": 7}],
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 7", page=True,
)
_chain("chain_select", "nation", [{"type": "select", "columns": ["n_name", "n_regionkey"]}], "SELECT n_name, n_regionkey FROM nation")
_chain(
    "pivot_count", "lineitem", [{"type": "pivot", "index": ["l_linestatus"], "columns": "l_returnflag", "values": "l_returnflag", "agg": "count"}],
    """SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS "A", count(*) FILTER (l_returnflag = 'N') AS "N", count(*) FILTER (l_returnflag = 'R') AS "R"
       FROM lineitem GROUP BY 1""",
)
_chain(
    "pivot_max", "lineitem", [{"type": "pivot", "index": ["l_linestatus"], "columns": "l_returnflag", "values": "l_linenumber", "agg": "max"}],
    """SELECT l_linestatus, max(l_linenumber) FILTER (l_returnflag = 'A') AS "A", max(l_linenumber) FILTER (l_returnflag = 'N') AS "N",
       max(l_linenumber) FILTER (l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1""",
)
_chain(
    "pivot_unaggregated", "region", [{"type": "pivot", "index": ["r_regionkey"], "columns": "r_name", "values": "r_name"}],
    """SELECT r_regionkey, max(r_name) FILTER (r_name = 'AFRICA') AS "AFRICA", max(r_name) FILTER (r_name = 'AMERICA') AS "AMERICA", max(r_name) FILTER (r_name = 'ASIA') AS "ASIA",
       max(r_name) FILTER (r_name = 'EUROPE') AS "EUROPE", max(r_name) FILTER (r_name = 'MIDDLE EAST') AS "MIDDLE EAST" FROM region GROUP BY 1""",
)


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidewater.operators.display import nested_order

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind = F.when(F.col("p_partkey") % 7 == 0, None).when(F.col("p_partkey") % 5 == 0, "other").otherwise(F.col("p_type"))
    return nested_order(part.groupBy(kind.alias("kind"), F.col("p_size").alias("size")).agg(F.count(F.lit(1)).alias("n")), ["kind", "size"], "n")


Q["display_nested_order"] = _nested
S["display_nested_order"] = """
WITH g AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'other' ELSE p_type END AS kind, p_size AS size, count(*) AS n FROM part GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY kind) AS total FROM g)
SELECT kind, size, n, CAST(row_number() OVER (ORDER BY total DESC, CASE WHEN kind IS NULL THEN 2 WHEN lower(kind) = 'other' THEN 1 ELSE 0 END, kind, n DESC, CAST(size AS VARCHAR)) AS INTEGER) AS place FROM t"""


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidewater.functions.labels import period_key

    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(period_key(text, "week").alias("week"), period_key(text, "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))


Q["period_keys"] = _keys
S["period_keys"] = "SELECT strftime(ts, '%G-W%V') AS week, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1, 2"
