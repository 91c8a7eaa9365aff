"""Registered queries of the table layer with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import shared_dir
from tidewater.sources import store as st

Q: dict = {}
S: dict[str, str] = {}


def _store(spark: SparkSession) -> st.Store:
    return st.Store(spark, shared_dir(spark, "store"))


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store_merge(spark, sf_dir):
    """Half of the customers, then an upsert of changed and new ones."""
    c = _t(spark, sf_dir, "customer")
    s = _store(spark)
    s.write(c.where("c_custkey % 2 = 0"), "crm", "customer")
    s.merge(c.where("c_custkey % 3 = 0").withColumn("c_name", F.upper("c_name")).withColumn("tier", F.lit("new")), "crm", "customer", ["c_custkey"])
    return s.read("crm", "customer")


Q["store_merge"] = store_merge
S["store_merge"] = """
SELECT c_custkey, upper(c_name) AS c_name, c_nationkey, c_acctbal, c_mktsegment, 'new' AS tier FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, NULL FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0"""


def store_merge_counts(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey")
    n = st.merge_counts(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0"), ["c_custkey"])
    return spark.createDataFrame([(n["rows_updated"], n["rows_inserted"])], "rows_updated long, rows_inserted long")


Q["store_merge_counts"] = store_merge_counts
S["store_merge_counts"] = """
SELECT count(*) FILTER (c_custkey % 6 = 0) AS rows_updated, count(*) FILTER (c_custkey % 3 = 0) - count(*) FILTER (c_custkey % 6 = 0) AS rows_inserted FROM customer"""


def store_append_evolved(spark, sf_dir):
    """Two appends, the second without one column and with another."""
    n, s = _t(spark, sf_dir, "nation"), _store(spark)
    s.ingest(n.where("n_regionkey < 2"), "geo", "nation")
    s.ingest(n.where("n_regionkey >= 2").select("n_nationkey", "n_name", F.lit(True).alias("late")), "geo", "nation")
    return s.read("geo", "nation")


Q["store_append_evolved"] = store_append_evolved
S["store_append_evolved"] = """
SELECT n_nationkey, n_name, CASE WHEN n_regionkey < 2 THEN n_regionkey END AS n_regionkey, CASE WHEN n_regionkey >= 2 THEN true END AS late FROM nation"""


def store_pruned_scan(spark, sf_dir):
    """A partitioned table, one partition value and a range of a data column."""
    s = _store(spark)
    s.write(_t(spark, sf_dir, "orders"), "shop", "orders", ["o_orderstatus"])
    return s.scan("shop", "orders", [st.Eq("o_orderstatus", "F"), st.Between("o_custkey", 9, 100)]).select("o_orderkey", "o_custkey", "o_orderstatus")


Q["store_pruned_scan"] = store_pruned_scan
S["store_pruned_scan"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_custkey BETWEEN 9 AND 100"


def store_partition_values(spark, sf_dir):
    s = _store(spark)
    s.write(_t(spark, sf_dir, "orders"), "shop", "orders", ["o_orderstatus"])
    return s.partition_values("shop", "orders", "o_orderstatus")


Q["store_partition_values"] = store_partition_values
S["store_partition_values"] = "SELECT DISTINCT o_orderstatus FROM orders"


def store_compacted(spark, sf_dir):
    o, s = _t(spark, sf_dir, "orders"), _store(spark)
    for k in range(3):
        s.ingest(o.where(f"o_orderkey % 3 = {k}"), "shop", "orders", partition_by=["o_orderstatus"])
    s.compact("shop", "orders")
    return s.read("shop", "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))


Q["store_compacted"] = store_compacted
S["store_compacted"] = "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1"

Q["store_column_stats"] = lambda spark, sf_dir: st.column_stats(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
S["store_column_stats"] = """
SELECT 'c_custkey' AS "column", CAST(min(c_custkey) AS VARCHAR) AS min, CAST(max(c_custkey) AS VARCHAR) AS max, count(*) FILTER (c_custkey IS NULL) AS null_count FROM customer
UNION ALL SELECT 'c_name', min(c_name), max(c_name), count(*) FILTER (c_name IS NULL) FROM customer
UNION ALL SELECT 'c_mktsegment', min(c_mktsegment), max(c_mktsegment), count(*) FILTER (c_mktsegment IS NULL) FROM customer"""


def store_file_stats(spark, sf_dir):
    return st.file_stats(_t(spark, sf_dir, "supplier").select("s_suppkey", "s_name")).drop("file")


Q["store_file_stats"] = store_file_stats
S["store_file_stats"] = """
SELECT 's_suppkey' AS "column", CAST(min(s_suppkey) AS VARCHAR) AS min, CAST(max(s_suppkey) AS VARCHAR) AS max, count(*) FILTER (s_suppkey IS NULL) AS null_count FROM supplier
UNION ALL SELECT 's_name', min(s_name), max(s_name), count(*) FILTER (s_name IS NULL) FROM supplier"""


def store_empty_write(spark, sf_dir):
    s = _store(spark)
    s.write(_t(spark, sf_dir, "region").where("false"), "geo", "region")
    return s.read("geo", "region")


Q["store_empty_write"] = store_empty_write
S["store_empty_write"] = "SELECT * FROM region WHERE false"


def store_sync(spark, sf_dir):
    """A connector's two incremental runs over orders by date."""
    o, s = _t(spark, sf_dir, "orders"), _store(spark)
    o = o.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).select("o_orderkey", "o_orderdate")

    def fetch(cursor):
        return o.where(o.o_orderdate < "1996-01-01") if cursor is None else o.where(o.o_orderdate >= cursor)

    st.sync(s, "erp", "orders", fetch, ["o_orderkey"], "o_orderdate")
    st.sync(s, "erp", "orders", fetch, ["o_orderkey"], "o_orderdate")
    return s.read("erp", "orders")


Q["store_sync"] = store_sync
S["store_sync"] = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders"
