import datetime as dt

import pytest

from tidewater.sources.store import Store
from tidewater.streaming import events as V
from tidewater.streaming import queries as SQ
from tidewater.streaming.events import Debounced

START = dt.datetime(2026, 1, 1)


def test_debounced_calls_once_in_its_interval():
    calls, now = [], [100.0]
    due = Debounced(lambda: calls.append(now[0]), 60.0, lambda: now[0])
    seen = []
    for t in (100.0, 101.0, 159.9, 160.0, 161.0, 400.0):
        now[0] = t
        seen.append(due())
    assert seen == [True, False, False, True, False, True] and calls == [100.0, 160.0, 400.0]


def minutes(*at):
    return [START + dt.timedelta(minutes=m) for m in at]


@pytest.mark.parametrize("empty", [False, True])
def test_sessions_of_a_stream_stay_in_files(spark, tmp_path, empty):
    at = {1: minutes(0, 29, 59, 120), 2: minutes(0, 30), 3: minutes(5)}
    rows = [] if empty else [(10 * u + i, t, u, "view") for u, ts in at.items() for i, t in enumerate(ts)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    views = len(spark.catalog.listTables())
    got = SQ.stream_sessions(spark, str(tmp_path))
    want = [("1", 2, *minutes(0, 29)), ("1", 1, *minutes(59, 59)), ("1", 1, *minutes(120, 120)), ("2", 1, *minutes(0, 0)), ("2", 1, *minutes(30, 30)), ("3", 1, *minutes(5, 5))]
    assert sorted(tuple(r) for r in got.collect()) == ([] if empty else sorted(want))
    assert got.inputFiles() and len(spark.catalog.listTables()) == views  # no table of rows in the driver


def test_a_later_run_replaces_the_whole_result(spark, tmp_path):
    store, files = Store(spark, f"file://{tmp_path}/store"), str(tmp_path / "in")
    shape = "id string, timestamp timestamp, user_id string, visitor_id string, event_name string"
    for at in ((0, 50), (25, 90)):  # 25 joins the sessions at 0 and 50
        spark.createDataFrame([(str(m), t, "u", "", "pageview") for m, t in zip(at, minutes(*at))], shape).coalesce(1).write.mode("append").parquet(files)
        sessions = V.sessions(spark.readStream.schema(shape).parquet(files), "2 hours")
        V.replace_batches(sessions, lambda batch, _: store.write(batch, "web", "sessions"), f"{tmp_path}/at", {"availableNow": True}).awaitTermination()
    assert sorted((r.events, r.started, r.ended) for r in store.read("web", "sessions").collect()) == [(1, *minutes(90, 90)), (3, *minutes(0, 50))]


def test_state_of_a_whole_result_is_on_disk(spark, tmp_path):
    shape = "id string, timestamp timestamp, user_id string, visitor_id string, event_name string"
    spark.createDataFrame([("1", START, "u", "", "pageview")], shape).write.parquet(f"{tmp_path}/in")
    before = {k: spark.conf.get(k, None) for k in V.STATE}
    V.replace_batches(V.sessions(spark.readStream.schema(shape).parquet(f"{tmp_path}/in")), lambda batch, _: batch.write.parquet(f"{tmp_path}/out"), f"{tmp_path}/at", {"availableNow": True}).awaitTermination()
    assert list((tmp_path / "at/state/0").glob("*/1.zip"))  # RocksDB's snapshots; the state in memory writes .delta files
    assert before == {k: spark.conf.get(k, None) for k in V.STATE}
