"""Registered queries of streams, semantics and models with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import models as M
from tidewater.operators import semantics as Z
from tidewater.operators.event_queries import raw_events
from tidewater.plans import ops
from tidewater.sources.queries import _store
from tidewater.streaming import events as V

Q: dict = {}
S: dict[str, str] = {}


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, sessionised until the input is used up."""
    store = _store(spark)
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    files = f"{store.root}/in"
    raw.select(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").cast("string").alias("user_id"), F.lit("").alias("visitor_id"), F.col("event_type").alias("event_name")).write.parquet(files)
    stream = spark.readStream.schema("id string, timestamp timestamp, user_id string, visitor_id string, event_name string").parquet(files)
    V.replace_batches(V.sessions(stream, "0 seconds"), lambda batch, _: store.write(batch, "web", "sessions"), f"{store.root}/at", {"availableNow": True}).awaitTermination()
    return store.read("web", "sessions").select("who", "events", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"))


Q["stream_sessions"] = stream_sessions
S["stream_sessions"] = """WITH e AS (SELECT user_id, event_id, ts, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS since FROM events),
a AS (SELECT *, sum(CASE WHEN since IS NULL OR since >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT CAST(user_id AS VARCHAR) AS who, count(*) AS events, min(ts) AS started, max(ts) AS ended FROM a GROUP BY user_id, s"""


def stream_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events through the intake stream into files by their own date, read back; then again, which must add nothing."""
    store = _store(spark)
    files, out, at = f"{store.root}/raw", f"{store.root}/events", f"{store.root}/at"
    raw_events(spark.read.parquet(f"{sf_dir}/events.parquet")).write.parquet(files)
    for _ in range(2):
        stream = spark.readStream.schema(V.RAW).parquet(files)
        V.write_partitioned(V.enriched(stream, "salt").drop("timestamp"), out, at, {"availableNow": True}).awaitTermination()
    back = spark.read.parquet(out).withColumn("date", F.col("date").cast("string"))
    return back.groupBy("date", "device_type", "screen_size").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("visitor_id").alias("visitors"), F.count(F.when(F.col("properties") == "{}", 1)).alias("bare"),
        F.min(F.length("visitor_id")).alias("id_length"),
    )


Q["stream_intake"] = stream_intake
S["stream_intake"] = """WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS date, event_id % 1500 AS w, event_id % 991 % 3 AS agent FROM events)
SELECT date, CASE WHEN w <= 575 THEN 'Mobile' WHEN agent = 1 THEN 'Tablet' ELSE 'Desktop' END AS device_type, CASE WHEN w <= 575 THEN 'Small' WHEN w <= 991 THEN 'Medium' ELSE 'Large' END AS screen_size,
       count(*) AS n, count(DISTINCT event_id) AS ids, count(DISTINCT (user_id % 200, agent)) AS visitors, count(*) FILTER (event_id % 2 = 1 OR props = '{}') AS bare, 16 AS id_length FROM e GROUP BY 1, 2, 3"""


def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as two files of a stream, the second with changed and new ones, upserted batch by batch; a rebuild is due only once."""
    store = _store(spark)
    c, files = spark.read.parquet(f"{sf_dir}/customer.parquet"), f"{store.root}/changes"
    c.where("c_nationkey < 15").select("c_custkey", "c_name", F.lit(0).alias("change")).coalesce(1).write.parquet(files)
    rebuilds: list[int] = []
    due = V.Debounced(lambda: rebuilds.append(1))

    def upsert(batch: DataFrame, _: int) -> None:
        store.merge(batch, "crm", "customer", ["c_custkey"])
        due()

    for _ in range(2):
        stream = spark.readStream.schema("c_custkey long, c_name string, change int").parquet(files)
        V.merge_batches(stream, upsert, f"{store.root}/at", {"availableNow": True}).awaitTermination()
        if c is not None:
            c.where("c_nationkey >= 10").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(1).alias("change")).coalesce(1).write.mode("append").parquet(files)
            c = None
    return store.read("crm", "customer").withColumn("rebuilds", F.lit(len(rebuilds)))


Q["stream_merge"] = stream_merge
S["stream_merge"] = """SELECT c_custkey, CASE WHEN c_nationkey >= 10 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_nationkey >= 10 THEN 1 ELSE 0 END AS change, 1 AS rebuilds FROM customer"""


def model_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to monthly sums to yearly maxima, built again in order after the input changed."""
    store = _store(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderstatus")
    models = M.Models(store)
    by = lambda c, g, *a: ops.Recipe([ops.WithColumns([ops.Period(g, c, g)]), ops.GroupBy([g], list(a))])
    models.add(M.Model("months", "shop", "orders", by("o_orderdate", "month", ops.Agg("*", "count", "orders"), ops.Agg("o_orderdate", "min", "first_day"))))
    models.add(M.Model("years", "shop", "months", by("first_day", "year", ops.Agg("orders", "max", "busiest"), ops.Agg("orders", "sum", "orders"))))
    store.write(orders.where("o_orderstatus = 'F'"), "shop", "orders")
    models.refresh("orders")
    store.write(orders, "shop", "orders")
    models.refresh("orders")
    return store.read("shop", "years")


Q["model_rebuild"] = model_rebuild
S["model_rebuild"] = """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders FROM orders GROUP BY 1)
SELECT month[:4] AS year, max(orders) AS busiest, CAST(sum(orders) AS BIGINT) AS orders FROM m GROUP BY 1"""

_METRICS = [
    Z.Metric("lines", "*", "count"), Z.Metric("returned", "*", "count", (Z.Predicate("l_returnflag", "eq", "R"),)),
    Z.Metric("large", "l_quantity", "max", (Z.Predicate("l_quantity", "lt", 40), Z.Predicate("l_linestatus", "in", ["O", "F"]))),
]
Q["declared_metrics"] = lambda spark, sf_dir: Z.metrics(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_linestatus"], _METRICS)
S["declared_metrics"] = """SELECT l_linestatus, count(1) AS lines, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned,
max(CASE WHEN l_quantity < 40 AND l_linestatus IN ('O', 'F') THEN l_quantity END) AS large FROM lineitem GROUP BY 1"""

_ALL = [Z.Metric(a, "l_quantity", a, (Z.Predicate("l_shipdate", "isNotNull"), Z.Predicate("l_returnflag", "ne", "A"))) for a in ("count", "sum", "avg", "min", "max", "median", "std")]
_ALL += [Z.Metric(a, "l_linestatus", a, (Z.Predicate("l_linestatus", "contains", "O"),)) for a in ("first", "last")]  # equal within a group
Q["declared_aggregates"] = lambda spark, sf_dir: Z.metrics(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_linenumber", "l_linestatus"], _ALL).withColumns({c: F.round(c, 6) for c in ("sum", "avg", "std")})
S["declared_aggregates"] = """WITH l AS (SELECT *, CASE WHEN l_shipdate IS NOT NULL AND l_returnflag <> 'A' THEN l_quantity END AS q, CASE WHEN l_linestatus = 'O' THEN 'O' END AS o FROM lineitem)
SELECT l_linenumber, l_linestatus, count(q) AS count, round(sum(q), 6) AS sum, round(avg(q), 6) AS avg, min(q) AS min, max(q) AS max, median(q) AS median, round(stddev_samp(q), 6) AS std, min(o) AS first, max(o) AS last FROM l GROUP BY 1, 2"""


def resolved_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as columns with opinions of four layers."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    layer = F.element_at(F.array(*map(F.lit, Z.LAYERS)), (F.col("c_custkey") % 4 + 1).cast("int"))
    opinions = c.select(F.col("c_nationkey").cast("string").alias("column"), layer.alias("layer"), F.col("c_custkey").alias("at"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("role"), F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.col("c_name")).alias("description"))
    return Z.resolved(opinions, ["role", "description"])


Q["resolved_meanings"] = resolved_meanings
S["resolved_meanings"] = """WITH o AS (SELECT CAST(c_nationkey AS VARCHAR) AS col, c_custkey % 4 AS layer, c_custkey AS at_, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS role,
CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS description FROM customer)
SELECT col AS "column", nullif(arg_min(role, (layer, -at_)) FILTER (role IS NOT NULL), '') AS role, nullif(arg_min(description, (layer, -at_)) FILTER (description IS NOT NULL), '') AS description FROM o GROUP BY 1"""

Q["semantic_coverage"] = lambda spark, sf_dir: Z.coverage(resolved_meanings(spark, sf_dir))
S["semantic_coverage"] = f"""WITH r AS ({S["resolved_meanings"]}) SELECT count(*) AS columns, count(role) AS with_role, count(description) AS described FROM r"""
