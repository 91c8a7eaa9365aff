import pytest
from pyspark.sql import functions as F

from tidewater.functions.labels import compact, offset_key, period_key
from tidewater.functions.periods import any_day, parsed_timestamp
from tidewater.operators.display import band, document_fields, due, merged_schema, nested_order


@pytest.mark.parametrize(("key", "steps", "want"), [("2026-W52", 2, "2027-W01"), ("2026-11", 3, "2027-02"), ("2026-W01", -1, "2025-W52"), ("odd", 4, "odd"), ("2026-13", 1, "2026-13"), ("2026-W60", 1, "2026-W60")])
def test_offsets(key, steps, want):
    assert offset_key(key, steps) == want


def test_keys(spark):
    df = spark.createDataFrame([("2026-04-15T10:00:00Z",), ("2025-12-29T00:00:00+00:00",), ("not a time",)], "t string")
    got = df.select(period_key(F.col("t"), "week"), period_key(F.col("t"), "month")).collect()
    assert [tuple(r) for r in got] == [("2026-W16", "2026-04"), ("2026-W01", "2025-12"), ("not a time",) * 2]


def test_date_formats(spark):
    texts = {"2026-03-04": "2026-03-04", "2026/03/04": "2026-03-04", "04-03-2026": "2026-03-04", "04/03/2026": "2026-03-04", "12/31/2026": "2026-12-31", "2026-03-04 05:06:07": "2026-03-04", "2026-03-04T23:30:00-02:00": "2026-03-05", "3/4/2026": "2026-03-04", "x": None}
    df = spark.createDataFrame(list(texts.items()), "t string, want string")
    assert df.where(~F.to_date(parsed_timestamp(F.col("t"))).cast("string").eqNullSafe(F.col("want"))).collect() == []
    numbers = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_000,)], "n long")
    assert {str(r[0]) for r in numbers.select(any_day(F.col("n"), numbers.schema["n"].dataType)).collect()} == {"2023-11-14"}


def test_numbers():
    assert [compact(x) for x in (1234567, 999, 0.125, 2e9, -1500, None)] == ["1.2M", "999", "0.12", "2B", "-1.5K", "-"]


def test_nested_order(spark):
    df = spark.createDataFrame([("b", "x", 1), ("b", "y", 5), ("a", "x", 6), ("other", "x", 6), (None, "x", 6)], "g string, h string, n int")
    got = nested_order(df, ["g", "h"], "n").orderBy("place").collect()
    assert [(r.g, r.h) for r in got] == [("a", "x"), ("b", "y"), ("b", "x"), ("other", "x"), (None, "x")]


def test_small_helpers():
    assert document_fields(["Title", "name", "content", "id", "html_url"]) == {"id": "id", "title": "Title", "body": "content", "url": "html_url"}
    assert merged_schema({"d": "time", "t": "dimension", "v": "measure", "w": "measure"}, {"t": "Time", "w": "Dimension"}) == {"time": "t", "dimensions": ["w"], "measures": ["v"]}
    assert due(None, 5, 0) and due(0, 5, 5) and not due(1, 5, 5) and band([1.0, 3.0])[1][0] == pytest.approx(2 + 2 * 2**0.5)
