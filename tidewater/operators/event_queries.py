"""Registered event queries with their SQL; the synthetic events are adapted first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import web
from tidewater.operators import events as E

Q: dict = {}
S: dict[str, str] = {}

_SESSIONS = """e AS (
  SELECT event_id AS id, ts AS timestamp, CAST(user_id AS VARCHAR) AS visitor_id, event_type AS event_name,
         date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS since FROM events),
a AS (
  SELECT *, visitor_id || '#' || CAST(sum(CASE WHEN since IS NULL OR since >= 1800000000 THEN 1 ELSE 0 END)
         OVER (PARTITION BY visitor_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM e)"""


def _add(name: str, run, sql: str | None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(E.adapted(spark.read.parquet(f"{sf_dir}/events.parquet")))

    Q[name] = query
    if sql:
        S[name] = sql


_add("events_sessionised", lambda e: e.select("id", "visitor_id", "session_id"), f"WITH {_SESSIONS} SELECT id, visitor_id, session_id FROM a")
_add(
    "events_stats",
    lambda e: E.stats(E.between(e.withColumn("event_name", F.when(F.col("event_name") == "view", "pageview").otherwise(F.col("event_name"))), "2024-01-03T00:00:00", "2024-01-20T00:00:00")),
    f"""WITH {_SESSIONS}, r AS (SELECT * FROM a WHERE timestamp >= TIMESTAMP '2024-01-03' AND timestamp < TIMESTAMP '2024-01-20'),
    v AS (SELECT session_id, count(*) FILTER (event_name = 'view') AS views FROM r GROUP BY 1)
    SELECT count(DISTINCT visitor_id) AS visitors, count(*) AS pageviews, count(DISTINCT session_id) AS sessions,
           (SELECT count(*) FROM v WHERE views = 1) AS bounces, (SELECT count(*) FROM v WHERE views = 1) / count(DISTINCT session_id) AS bounce_rate,
           0.0::DOUBLE AS avg_visit_duration FROM r""",
)
_add(
    "events_timeseries", E.timeseries,
    "SELECT strftime(ts, '%Y-%m-%d') AS date, count(DISTINCT user_id) AS visitors, count(*) AS pageviews FROM events GROUP BY 1",
)
_add(
    "events_breakdown", lambda e: E.breakdown(e, "event_name"),
    "SELECT event_type AS name, count(DISTINCT user_id) AS visitors, count(*) AS pageviews FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
_add(
    "events_breakdown_null", lambda e: E.breakdown(e.withColumn("country", F.when(F.col("id") % 3 == 0, F.col("event_name"))), "country"),
    "SELECT coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, '') AS name, count(DISTINCT user_id) AS visitors, count(*) AS pageviews FROM events GROUP BY 1",
)
_add(
    "events_list", E.event_list,
    "SELECT event_type AS event_name, count(*) AS count, count(DISTINCT user_id) AS unique_users FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 50",
)
_STEPS = ["view", "click", "purchase"]
_add(
    "events_funnel", lambda e: E.funnel(e, _STEPS),
    """WITH e AS (SELECT user_id, event_type, ts, event_id FROM events),
    s0 AS (SELECT user_id, min((ts, event_id)) AS at, min(ts) AS anchor FROM e WHERE event_type = 'view' GROUP BY 1),
    s1 AS (SELECT e.user_id, min((ts, event_id)) AS at, any_value(anchor) AS anchor FROM e JOIN s0 USING (user_id)
           WHERE event_type = 'click' AND (ts, event_id) > s0.at AND ts <= anchor + INTERVAL 7 DAY GROUP BY 1),
    s2 AS (SELECT e.user_id, min((ts, event_id)) AS at FROM e JOIN s1 USING (user_id)
           WHERE event_type = 'purchase' AND (ts, event_id) > s1.at AND ts <= anchor + INTERVAL 7 DAY GROUP BY 1),
    n AS (SELECT (SELECT count(*) FROM s0) AS a, (SELECT count(*) FROM s1) AS b, (SELECT count(*) FROM s2) AS c)
    SELECT 0 AS step, 'view' AS event_name, a AS count, 1.0::DOUBLE AS conversion_rate, 0.0::DOUBLE AS drop_off_rate FROM n
    UNION ALL SELECT 1, 'click', b, b / a, (a - b) / a FROM n UNION ALL SELECT 2, 'purchase', c, c / a, (b - c) / b FROM n""",
)
_add(
    "events_funnel_tight", lambda e: E.funnel(e, ["view", "view", "error"], window=86400),
    """WITH e AS (SELECT user_id, event_type, ts, event_id FROM events),
    s0 AS (SELECT user_id, min((ts, event_id)) AS at, min(ts) AS anchor FROM e WHERE event_type = 'view' GROUP BY 1),
    s1 AS (SELECT e.user_id, min((ts, event_id)) AS at, any_value(anchor) AS anchor FROM e JOIN s0 USING (user_id)
           WHERE event_type = 'view' AND (ts, event_id) > s0.at AND ts <= anchor + INTERVAL 1 DAY GROUP BY 1),
    s2 AS (SELECT e.user_id, min((ts, event_id)) AS at FROM e JOIN s1 USING (user_id)
           WHERE event_type = 'error' AND (ts, event_id) > s1.at AND ts <= anchor + INTERVAL 1 DAY GROUP BY 1),
    n AS (SELECT (SELECT count(*) FROM s0) AS a, (SELECT count(*) FROM s1) AS b, (SELECT count(*) FROM s2) AS c)
    SELECT 0 AS step, 'view' AS event_name, a AS count, 1.0::DOUBLE AS conversion_rate, 0.0::DOUBLE AS drop_off_rate FROM n
    UNION ALL SELECT 1, 'view', b, b / a, (a - b) / a FROM n
    UNION ALL SELECT 2, 'error', c, c / a, CASE WHEN b > 0 THEN (b - c) / b ELSE 0 END FROM n""",
)
for _kind, _fmt in {"week": "%G-W%V", "month": "%Y-%m"}.items():
    _add(
        f"events_retention_{_kind}", lambda e, k=_kind: E.retention(e, "signup", "purchase", k),
        f"""WITH r AS (SELECT user_id, event_type, date_trunc('{_kind}', ts)::DATE AS begin FROM events),
        born AS (SELECT user_id, min(begin) AS cohort FROM r WHERE event_type = 'signup' GROUP BY 1),
        act AS (SELECT DISTINCT user_id, begin FROM r WHERE event_type = 'purchase'),
        sizes AS (SELECT cohort, count(*) AS cohort_size FROM born GROUP BY 1 ORDER BY 1 DESC LIMIT 8),
        steps AS (SELECT *, CAST(step AS INTEGER) AS k, (cohort + CAST(step AS INTEGER) * INTERVAL 1 {_kind})::DATE AS begin FROM sizes, range(8) t(step)),
        seen AS (SELECT cohort, begin, count(*) AS retained FROM born JOIN act USING (user_id) GROUP BY 1, 2)
        SELECT strftime(cohort, '{_fmt}') AS cohort, cohort_size, k AS step, coalesce(retained, 0) AS retained, coalesce(retained, 0) / cohort_size AS rate
        FROM steps LEFT JOIN seen USING (cohort, begin)""",
    )
_add(
    "events_timeline", lambda e: E.timeline(e, "42"),
    """SELECT event_id AS id, ts AS timestamp, event_type AS event_name, '' AS page_url, coalesce(props, '{}') AS properties
       FROM events WHERE user_id = 42 ORDER BY ts DESC, event_id DESC LIMIT 200""",
)
_add(
    "events_user_search", lambda e: E.user_search(e, "1", 50),
    """SELECT CAST(user_id AS VARCHAR) AS user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS events FROM events
       WHERE starts_with(CAST(user_id AS VARCHAR), '1') GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 50""",
)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", web.host(url).alias("host"), web.path(url).alias("path"), web.clean_url(url).alias("clean"), web.utm(url, "source").alias("utm_source"))


Q["url_parts"] = _pages
S["url_parts"] = r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host,
       CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END AS path,
       regexp_extract(url, '^([a-z]+://[^/:?#]+)', 1) || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/'
            ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END AS clean,
       regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) AS utm_source
FROM pages"""


#: Pages, referrers and agents that visits are given by their ids, so that every dimension has values.
_URLS = ["https://shop.example/", "https://shop.example:8443/cart?utm_source=news&utm_medium=mail", "http://shop.example/a%20b?utm_source=ad%26co&x=1#top", "https://shop.example/item/7?utm_campaign=spring", "not a url"]
_REFERRERS = ["", "https://www.google.com/search?q=x", "https://news.ycombinator.com/item", "https://shop.example/", "https://netflix.com/", "https://old.reddit.com/r/x"]
_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
]


def raw_events(events: DataFrame) -> DataFrame:
    """The synthetic events as an intake would get them."""
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % by % len(values) + 1).cast("int"))
    return events.select(
        F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit("site").alias("source"), F.lit(None).cast("string").alias("visitor_id"),
        F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("event_name"), pick(_URLS, 1000).alias("url"), pick(_REFERRERS, 997).alias("referrer"), pick(_AGENTS, 991).alias("user_agent"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 200).alias("ip"), (F.col("event_id") % 1500).cast("int").alias("screen_width"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("properties"),
    )


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


#: What each of the raw values comes to.
_SHOWN = {
    "pathname": ("1000", ["/", "/cart", "/a%20b", "/item/7", "not a url"]),
    "utm_source": ("1000", ["", "news", "ad&co", "", ""]),
    "utm_medium": ("1000", ["", "mail", "", "", ""]),
    "utm_campaign": ("1000", ["", "", "", "spring", ""]),
    "referrer_source": ("997", ["Direct", "Google", "Hacker News", "Direct", "netflix.com", "Reddit"]),
    "browser": ("991", ["Chrome", "Mobile Safari", "Firefox"]),
    "os": ("991", ["Windows", "iOS", "Linux"]),
}


def _dimension(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tidewater.streaming.events import enriched

        return E.breakdown(enriched(raw_events(spark.read.parquet(f"{sf_dir}/events.parquet"))).withColumn("visitor_id", F.col("user_id")), name)

    return run


for _name, (_by, _values) in _SHOWN.items():
    Q[f"events_breakdown_{_name}"] = _dimension(_name)
    _case = f"{_list(_values)}[event_id % {_by} % {len(_values)} + 1]"
    if _name == "referrer_source":  # the own host is direct only where the page has one
        _case = f"CASE WHEN event_id % 1000 % 5 = 4 AND event_id % 997 % 6 = 3 THEN 'shop.example' ELSE {_case} END"
    S[f"events_breakdown_{_name}"] = f"SELECT {_case} AS name, count(DISTINCT user_id) AS visitors, count(*) AS pageviews FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"
