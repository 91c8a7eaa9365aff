"""Web and product analytics over an event table.

Events have text columns id, timestamp, visitor_id, user_id, session_id, event_name and whatever
dimensions a breakdown names. Timestamps may be text (ISO, compared as text) or timestamps. The
identity in product queries is the user where there is one, else the visitor.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.periods import label, shifted

FUNNEL_WINDOW = 7 * 86400
SESSION_GAP = 30 * 60


def with_user(df: DataFrame) -> DataFrame:
    """Events of an older shape: a missing or null user_id is the empty text."""
    user = F.coalesce(F.col("user_id").cast("string"), F.lit("")) if "user_id" in df.columns else F.lit("")
    return df.withColumn("user_id", user)


def adapted(events: DataFrame) -> DataFrame:
    """The synthetic events table (event_id, ts, user_id, event_type, value, props) in the shape of this module."""
    user = F.col("user_id").cast("string")
    df = events.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), user.alias("visitor_id"), user.alias("user_id"),
        F.col("event_type").alias("event_name"), F.lit("").alias("page_url"), F.col("props").alias("properties"),
    )
    return sessionised(df)


def identity() -> Column:
    user = F.coalesce(F.col("user_id"), F.lit(""))
    return F.when(user != "", user).otherwise(F.col("visitor_id"))


def n_unique(column: Column) -> Column:
    """Distinct values, null being one."""
    return F.count_distinct(column) + F.coalesce(F.max(column.isNull().cast("long")), F.lit(0))


def _is_text(df: DataFrame) -> bool:
    return isinstance(df.schema["timestamp"].dataType, T.StringType)


def _moment(df: DataFrame) -> Column:
    """The event's time as a timestamp without zone; null where text can't be read."""
    t = F.col("timestamp")
    if not _is_text(df):
        return t.cast("timestamp_ntz")
    utc = F.regexp_replace(t, r"(Z|[+-]00:?00)$", "")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(utc).cast("timestamp_ntz"))


def _day(df: DataFrame) -> Column:
    return F.substring("timestamp", 1, 10) if _is_text(df) else F.date_format("timestamp", "yyyy-MM-dd")


def preset_range(preset: str | None, start: str | None, end: str | None, now: dt.datetime) -> tuple[str, str]:
    """Bounds of a named period; explicit bounds count if both are given, as they are."""
    if start and end:
        return start, end
    today = now.date()
    first = {"today": today, "7d": today - dt.timedelta(days=7), "month": today.replace(day=1), "12m": today - dt.timedelta(days=365)}.get(
        preset or "30d", today - dt.timedelta(days=30)
    )
    return f"{first.isoformat()}T00:00:00", f"{today.isoformat()}T23:59:59"


def between(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Events from start on and before end; text is compared as text, so a bare end date excludes its day."""
    bound = F.lit if _is_text(df) else lambda s: F.try_to_timestamp(F.lit(s)).cast("timestamp_ntz")
    if start:
        df = df.where(F.col("timestamp") >= bound(start))
    return df.where(F.col("timestamp") < bound(end)) if end else df


def stats(df: DataFrame) -> DataFrame:
    """One row: visitors, pageviews (all events), sessions, bounces (sessions with one pageview), bounce_rate, avg_visit_duration."""
    whole = df.agg(n_unique(F.col("visitor_id")).alias("visitors"), F.count(F.lit(1)).alias("pageviews"), n_unique(F.col("session_id")).alias("sessions"))
    views = df.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.count(F.when(F.col("event_name") == "pageview", 1)).alias("views"))
    bounced = views.agg(F.count(F.when(F.col("views") == 1, 1)).alias("bounces"))
    rate = F.when(F.col("sessions") > 0, F.col("bounces") / F.col("sessions")).otherwise(0.0)
    one = F.lit(1).alias("_one")  # both sides are one row
    both = whole.select("*", one).join(F.broadcast(bounced.select("*", one)), "_one").drop("_one")
    return both.withColumn("bounce_rate", rate).withColumn("avg_visit_duration", F.lit(0.0))


def timeseries(df: DataFrame) -> DataFrame:
    """Visitors and events of each day that has events, by day."""
    return df.groupBy(_day(df).alias("date")).agg(n_unique(F.col("visitor_id")).alias("visitors"), F.count(F.lit(1)).alias("pageviews")).orderBy("date")


def breakdown(df: DataFrame, dimension: str, limit: int = 20) -> DataFrame:
    """The values of a dimension with most visitors; null is the empty text, ties go by name."""
    name = F.coalesce(F.col(f"`{dimension}`").cast("string"), F.lit("")).alias("name")
    rows = df.groupBy(name).agg(n_unique(F.col("visitor_id")).alias("visitors"), F.count(F.lit(1)).alias("pageviews"))
    return rows.orderBy(F.desc("visitors"), "name").limit(limit)


def event_list(df: DataFrame, limit: int = 50) -> DataFrame:
    """Event names by count, with unique identities."""
    rows = df.groupBy("event_name").agg(F.count(F.lit(1)).alias("count"), n_unique(identity()).alias("unique_users"))
    return rows.orderBy(F.desc("count"), "event_name").limit(limit)


def funnel(df: DataFrame, steps: list[str], window: int = FUNNEL_WINDOW) -> DataFrame:
    """Users who reach each step in order within `window` seconds of their first first step.

    The first occurrence of the first step fixes the anchor for good; one event satisfies one step;
    ties in time go by id; unreadable times are skipped. All steps are found in windows of one
    partitioning by identity, so events are shuffled once whatever the number of steps.
    """
    spark = df.sparkSession
    if not steps:
        return spark.createDataFrame([], "step int, event_name string, count long, conversion_rate double, drop_off_rate double")
    rows = df.select(identity().alias("who"), "event_name", F.struct(_moment(df).alias("t"), F.col("id").alias("id")).alias("at"))
    rows = rows.where(F.col("event_name").isin(list(set(steps))) & F.col("at.t").isNotNull())
    own = Window.partitionBy("who")
    rows = rows.withColumn("s0", F.min(F.when(F.col("event_name") == steps[0], F.col("at"))).over(own))
    last = F.col("s0.t") + F.expr(f"INTERVAL {window} SECONDS")
    for k, name in enumerate(steps[1:], 1):
        fits = (F.col("event_name") == name) & (F.col("at") > F.col(f"s{k - 1}")) & (F.col("at.t") <= last)
        rows = rows.withColumn(f"s{k}", F.min(F.when(fits, F.col("at"))).over(own))
    users = rows.groupBy("who").agg(*[F.max(F.col(f"s{k}").isNotNull()).alias(f"s{k}") for k in range(len(steps))])
    counts = users.agg(*[F.count(F.when(F.col(f"s{k}"), 1)).alias(f"s{k}") for k in range(len(steps))])
    reached = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(n).alias("event_name"), F.col(f"s{k}").alias("count"), F.col("s0").alias("first"), F.col(f"s{max(0, k - 1)}").alias("prev")) for k, n in enumerate(steps)])
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return counts.select(F.inline(reached)).select(
        "step", "event_name", "count", rate(F.col("count"), F.col("first")).alias("conversion_rate"),
        F.when(F.col("step") == 0, 0.0).otherwise(rate(F.col("prev") - F.col("count"), F.col("prev"))).alias("drop_off_rate"),
    )


def retention(df: DataFrame, cohort_event: str, return_event: str, kind: str = "week", periods: int = 8) -> DataFrame:
    """Rows (cohort, cohort_size, step, retained, rate): shares of a cohort active `step` periods later.

    An identity's cohort is the period of its first cohort event; the last `periods` cohorts and
    steps 0 to periods - 1 are shown, 0 where nobody, or nothing yet, is there.
    """
    unit = "week" if kind == "week" else "month"
    rows = df.select(identity().alias("who"), "event_name", F.date_trunc(unit, _moment(df).cast("timestamp")).cast("date").alias("begin")).where(F.col("begin").isNotNull())
    born = rows.where(F.col("event_name") == cohort_event).groupBy("who").agg(F.min("begin").alias("cohort"))
    active = rows.where(F.col("event_name") == return_event).select("who", "begin").distinct()
    sizes = born.groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_size")).orderBy(F.desc("cohort")).limit(periods)
    steps = sizes.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(periods - 1)))).withColumn("begin", shifted(unit, F.col("cohort"), F.col("step")))
    seen = born.join(active, "who").groupBy("cohort", "begin").agg(F.count(F.lit(1)).alias("retained"))
    out = steps.join(seen, ["cohort", "begin"], "left").withColumn("retained", F.coalesce("retained", F.lit(0)))
    return out.select(label(F.col("cohort"), unit).alias("cohort"), "cohort_size", "step", "retained", (F.col("retained") / F.col("cohort_size")).alias("rate"))


def timeline(df: DataFrame, who: str, limit: int = 200) -> DataFrame:
    """An identity's newest events."""
    rows = df.where(identity() == who).orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)
    return rows.select("id", "timestamp", "event_name", F.coalesce("page_url", F.lit("")).alias("page_url"), F.coalesce("properties", F.lit("{}")).alias("properties"))


def sessionised(df: DataFrame, gap: int = SESSION_GAP) -> DataFrame:
    """Adds session_id: a new session begins where an identity was silent for `gap` seconds or more.

    Events whose time can't be read are sessions of their own.
    """
    rows = df.withColumn("_t", _moment(df)).withColumn("_who", identity())
    at = Window.partitionBy("_who", F.col("_t").isNull()).orderBy("_t", "id")
    since = F.col("_t").cast("timestamp").cast("double") - F.lag("_t").over(at).cast("timestamp").cast("double")
    fresh = F.when(F.col("_t").isNull() | since.isNull() | (since >= gap), 1).otherwise(0)
    number = F.sum("_fresh").over(at.rowsBetween(Window.unboundedPreceding, 0))
    name = F.concat(F.coalesce("_who", F.lit("")), F.when(F.col("_t").isNull(), F.lit("?")).otherwise(F.lit("#")), number.cast("string"))
    return rows.withColumn("_fresh", fresh).withColumn("session_id", name).drop("_t", "_who", "_fresh")


def user_search(df: DataFrame, prefix: str, limit: int = 50) -> DataFrame:
    """Users whose id begins with a text, taken literally, newest first."""
    users = with_user(df).where((F.col("user_id") != "") & F.startswith(F.col("user_id"), F.lit(prefix)))
    rows = users.groupBy("user_id").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("events"))
    return rows.orderBy(F.desc("last_seen"), "user_id").limit(limit)


def merged_traits(profiles: DataFrame, updates: DataFrame) -> DataFrame:
    """Profiles (user_id, traits map, updated_at) after updates of the same shape: newer values win, key by key."""
    rows = profiles.unionByName(updates)
    each = rows.select("user_id", "updated_at", F.explode_outer("traits").alias("key", "value"))
    newest = each.groupBy("user_id", "key").agg(F.max_by("value", "updated_at").alias("value"), F.max("updated_at").alias("updated_at"))
    pairs = F.map_from_entries(F.filter(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda e: e["key"].isNotNull()))
    return newest.groupBy("user_id").agg(pairs.alias("traits"), F.max("updated_at").alias("updated_at"))


