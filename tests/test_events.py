import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.functions import web
from tidewater.operators import events as E

SHAPE = "id string, timestamp string, visitor_id string, session_id string, event_name string, page_url string"


@pytest.fixture(scope="module")
def four(spark):
    rows = [("e1", "2026-01-01T10:00:00Z", "v1", "s1", "pageview", "/home"), ("e2", "2026-01-01T11:00:00Z", "v1", "s1", "pageview", "/about"),
            ("e3", "2026-01-02T09:00:00Z", "v2", "s2", "pageview", "/home"), ("e4", "2026-01-02T10:00:00Z", "v3", "s3", "click", "/home")]
    return E.with_user(spark.createDataFrame(rows, SHAPE))


def test_stats(four):
    r = E.stats(four).first()
    assert (r.visitors, r.pageviews, r.sessions, r.bounces, r.avg_visit_duration) == (3, 4, 3, 1, 0.0) and r.bounce_rate == pytest.approx(1 / 3)


def test_empty(spark):
    none = E.with_user(spark.createDataFrame([], SHAPE))
    assert tuple(E.stats(none).first()) == (0, 0, 0, 0, 0.0, 0.0)
    assert E.timeseries(none).collect() == E.breakdown(none, "page_url").collect() == E.event_list(none).collect() == []
    assert [r["count"] for r in E.funnel(none, ["a", "b"]).collect()] == [0, 0] and E.funnel(none, []).collect() == []


def test_days_breakdown_and_bounds(four):
    assert [tuple(r) for r in E.timeseries(four).collect()] == [("2026-01-01", 1, 2), ("2026-01-02", 2, 2)]
    assert [tuple(r) for r in E.breakdown(four, "page_url").collect()] == [("/home", 3, 3), ("/about", 1, 1)]
    assert E.between(four, "2026-01-01T10:00:00Z", "2026-01-02T10:00:00Z").count() == 3


def test_user_shim(spark):
    df = spark.createDataFrame([("a", "u1"), ("b", None)], "id string, user_id string")
    assert [r.user_id for r in E.with_user(df).orderBy("id").collect()] == ["u1", ""] and E.with_user(df.drop("user_id")).first().user_id == ""


def test_null_counts_as_a_visitor(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "visitor_id string")
    assert df.agg(E.n_unique(F.col("visitor_id"))).first()[0] == 2


def events(spark, rows):
    return spark.createDataFrame([(str(i), t, v, u, n) for i, (t, v, u, n) in enumerate(rows)], "id string, timestamp string, visitor_id string, user_id string, event_name string")


def test_funnel_cases(spark):
    day = lambda d, h=0: f"2026-01-{d:02d}T{h:02d}:00:00Z"
    rows = [
        (day(1), "a", "", "s"), (day(9), "a", "", "m"),  # too late
        (day(2), "b", "", "m"), (day(3), "b", "", "s"),  # out of order
        (day(1), "c", "", "s"), (day(20), "c", "", "s"), (day(21), "c", "", "m"),  # the anchor stays the first
        (day(1), "d", "u", "s"), (day(2), "e", "u", "m"), (day(3), "f", "u", "e"),  # a user over visitors
        ("no time", "g", "", "s"), (day(8), "h", "", "m"), (day(1), "h", "", "s"), (day(8, 1), "h", "", "e"),  # exactly seven days, then past them
    ]
    got = [tuple(r) for r in E.funnel(events(spark, rows), ["s", "m", "e"]).orderBy("step").collect()]
    assert [g[2] for g in got] == [5, 2, 1] and got[1][3:] == (0.4, 0.6) and got[2][3:] == (0.2, 0.5)
    repeated = events(spark, [(day(1), "a", "", "s"), (day(2), "a", "", "s"), (day(1), "b", "", "s")])
    assert [r["count"] for r in E.funnel(repeated, ["s", "s"]).orderBy("step").collect()] == [2, 1]


def test_retention(spark):
    rows = [("2025-12-29T01:00:00Z", "a", "", "join"), ("2026-01-06T00:00:00Z", "a", "", "use"), ("2026-01-07T00:00:00Z", "b", "", "join"), ("2025-12-30T00:00:00Z", "c", "", "join"), ("2025-12-31T00:00:00Z", "c", "", "use")]
    got = {(r.cohort, r.step): (r.cohort_size, r.rate) for r in E.retention(events(spark, rows), "join", "use", "week", 3).collect()}
    assert got[("2026-W01", 0)] == (2, 0.5) and got[("2026-W01", 1)] == (2, 0.5) and got[("2026-W01", 2)] == (2, 0.0) and got[("2026-W02", 0)] == (1, 0.0)
    assert {c for c, _ in got} == {"2026-W01", "2026-W02"}
    months = E.retention(events(spark, rows), "join", "use", "month", 1).collect()
    assert [(r.cohort, r.rate) for r in months] == [("2026-01", 0.0)]


@pytest.mark.parametrize(("minutes", "seconds", "same"), [(29, 0, True), (29, 59, True), (30, 0, False), (31, 0, False)])
def test_session_gap(spark, minutes, seconds, same):
    rows = [("2026-01-01T10:00:00Z", "v1", "u", "x"), (f"2026-01-01T10:{minutes:02d}:{seconds:02d}Z", "v2", "u", "x")]
    assert (E.sessionised(events(spark, rows)).select("session_id").distinct().count() == 1) == same


def test_unreadable_times_are_sessions_of_their_own(spark):
    rows = [("bad", "v", "", "x"), ("worse", "v", "", "x"), ("2026-01-01T10:00:00Z", "v", "", "x")]
    assert E.sessionised(events(spark, rows)).select("session_id").distinct().count() == 3


def test_presets():
    now = dt.datetime(2026, 4, 15, 9)
    assert E.preset_range("month", None, None, now) == ("2026-04-01T00:00:00", "2026-04-15T23:59:59")
    assert E.preset_range("12m", None, None, now)[0] == "2025-04-15T00:00:00" and E.preset_range("odd", "x", None, now)[0] == "2026-03-16T00:00:00"
    assert E.preset_range("7d", "a", "b", now) == ("a", "b")


def test_urls_and_referrers(spark):
    u = "https://example.com:8080/blog?utm_source=twitter&utm_medium=a%20b&extra=1#x"
    df = spark.createDataFrame([(u, "")], "u string, r string")
    r = df.select(web.host(F.col("u")), web.path(F.col("u")), web.clean_url(F.col("u")), web.utm(F.col("u"), "medium"), web.utm(F.col("u"), "term")).first()
    assert tuple(r) == ("example.com", "/blog", "https://example.com/blog", "a b", "")
    refs = {None: "Direct", "": "Direct", "https://example.com/x": "Direct", "https://www.google.com/search": "Google", "https://t.co/a": "Twitter", "https://netflix.com": "netflix.com", "https://microsoft.com/": "microsoft.com", "https://myblog.dev/p": "myblog.dev", "https://news.ycombinator.com/": "Hacker News"}
    df = spark.createDataFrame(list(refs.items()), "r string, want string")
    assert df.where(web.referrer_source(F.col("r"), F.lit("example.com")) != F.col("want")).count() == 0


def test_devices_and_agents(spark):
    df = spark.createDataFrame([("Android", 500, "Mobile"), ("Android", 900, "Tablet"), ("iOS", None, "Mobile"), ("Windows", 575, "Mobile"), ("Windows", None, "Desktop"), ("Mac OS X", 1400, "Desktop")], "os string, w int, want string")
    assert df.where(web.device(F.col("os"), F.col("w")) != F.col("want")).count() == 0
    agent = F.lit("Mozilla/5.0 (Linux; Android 14; Pixel) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Mobile Safari/537.36")
    b, o = web.browser(agent), web.system(agent)
    assert tuple(spark.range(1).select(*b, *o).first()) == ("Chrome", "120.0", "Android", "14")


def test_traits_merge(spark):
    shape = "user_id string, traits map<string,string>, updated_at long"
    old = spark.createDataFrame([("u", {"a": "1", "b": "2"}, 1), ("w", {}, 1)], shape)
    got = {r.user_id: r.traits for r in E.merged_traits(old, spark.createDataFrame([("u", {"b": "3", "c": "4"}, 2)], shape)).collect()}
    assert got == {"u": {"a": "1", "b": "3", "c": "4"}, "w": {}}
