"""Event ingestion as a stream: enriched columns, sessions, partitioned files, incremental merges.

Offsets in the checkpoint make the intake durable; a batch is written under its own id, so a
repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import web
from tidewater.operators.events import identity

#: A gap of exactly 30 minutes begins a new session, while session_window keeps it in one.
GAP = "29 minutes 59.999999 seconds"
#: State of a query whose result is never closed: RocksDB on local disks, with so many MB of memory in an executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
}
RAW = "id string, timestamp timestamp, source string, visitor_id string, user_id string, event_name string, url string, referrer string, user_agent string, ip string, screen_width int, properties string"


def enriched(raw: DataFrame, salt: str = "") -> DataFrame:
    """Raw events with page, campaign, referrer, browser, device and a daily visitor id."""
    url, agent = F.col("url"), F.coalesce("user_agent", F.lit(""))
    browser, browser_version = web.browser(agent)
    os, os_version = web.system(agent)
    day = F.date_format("timestamp", "yyyy-MM-dd")
    made = {
        "user_id": F.coalesce("user_id", F.lit("")),
        "visitor_id": F.coalesce("visitor_id", web.visitor_id(F.concat(F.lit(salt), day), F.coalesce("source", F.lit("")), F.coalesce("ip", F.lit("")), agent)),
        "page_url": web.clean_url(url), "hostname": web.host(url), "pathname": web.path(url),
        "referrer_source": web.referrer_source(F.col("referrer"), web.host(url)),
        **{f"utm_{u}": web.utm(url, u) for u in web.UTM},
        "browser": browser, "browser_version": browser_version, "os": os, "os_version": os_version,
        "device_type": web.device(os, F.col("screen_width")), "screen_size": web.screen(F.col("screen_width")),
        "properties": F.coalesce("properties", F.lit("{}")), "date": day,
    }
    return raw.withColumns(made).drop("ip", "user_agent", "url")


def sessions(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Sessions by identity with a gap of 30 minutes: bounds, events and page views; closed once the watermark passes them."""
    who = identity().alias("who")
    return (
        events.withWatermark("timestamp", late)
        .groupBy(F.session_window("timestamp", GAP).alias("w"), who)
        .agg(F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("event_name") == "pageview", 1)).alias("pageviews"), F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"))
        .drop("w")
    )


def write_partitioned(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """A query that appends events to Parquet by their own date, every 60 seconds unless told otherwise."""
    return (
        events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("compression", "zstd")
        .partitionBy("date").outputMode("append").trigger(**(trigger or {"processingTime": "60 seconds"})).start()
    )


def merge_batches(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """A query that hands every micro-batch to an upsert; an upsert by key may see a batch twice."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def replace_batches(result: DataFrame, replace: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """A query that hands the whole result so far of an aggregation to a replacement with every micro-batch.

    Executors write it, and the driver holds no rows. The state is kept on the executors' disks.
    """
    conf = result.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            conf.set(k, v)
        return result.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


class Debounced:
    """Calls a function at most once in so many seconds, for work that follows batches."""

    def __init__(self, call: Callable[[], None], seconds: float = 600.0, clock: Callable[[], float] | None = None):
        import time

        self.call, self.seconds, self.clock, self.last = call, seconds, clock or time.time, None

    def __call__(self, *_) -> bool:
        now = self.clock()
        if self.last is not None and now - self.last < self.seconds:
            return False
        self.last = now
        self.call()
        return True
