import pytest
from pyspark.sql import functions as F

from tidewater.operators.models import Cycle, Model, Models
from tidewater.plans import ops
from tidewater.sources import store as st


@pytest.fixture
def store(spark, tmp_path):
    return st.Store(spark, "file://" + str(tmp_path))


def frame(spark, rows, shape="id long, v string"):
    return spark.createDataFrame(rows, shape)


def test_merge(spark, store):
    first, second = frame(spark, [(1, "a"), (2, "b"), (3, "c")]), frame(spark, [(2, "B"), (3, "C"), (4, "d"), (5, "e")])
    assert store.merge(first, "s", "t", ["id"]) == {"rows_updated": 0, "rows_inserted": 3}
    assert store.merge(second, "s", "t", ["id"]) == {"rows_updated": 2, "rows_inserted": 2}
    assert sorted(map(tuple, store.read("s", "t").collect())) == [(1, "a"), (2, "B"), (3, "C"), (4, "d"), (5, "e")]
    with pytest.raises(ValueError):
        st.merged(first, second, [])


def test_modes(spark, store):
    df = frame(spark, [(1, "a")])
    assert store.ingest(df.where("false"), "s", "t") is None and store.read("s", "t") is None
    store.ingest(df, "s", "t")
    store.ingest(df, "s", "t", "ignore")
    with pytest.raises(st.TableExists):
        store.ingest(df, "s", "t", "errorifexists")
    assert store.ingest(df, "s", "t").version == 2 and store.read("s", "t").count() == 2
    assert store.ingest(df, "s", "t", "overwrite").version == 3 and store.read("s", "t").count() == 1
    with pytest.raises(ValueError):
        store.ingest(df, "s", "t", "upsert")
    assert store.tables("s") == ["t"] and store.delete("s", "t") and store.read("s", "t") is None


def test_versions(spark, store):
    df = frame(spark, [(1, "a")])
    store.replace(df, "s", "t", expected_version=0)
    store.replace(df, "s", "t", expected_version=1)
    with pytest.raises(st.VersionConflict):
        store.replace(df, "s", "t", expected_version=1)
    taken = store.manifest("s", "t")
    with pytest.raises(st.VersionConflict):
        store._commit("s", "t", taken)


def test_empty_tables_keep_their_columns(spark, store):
    store.write(frame(spark, []), "s", "t", ["v"])
    assert store.read("s", "t").columns == ["id", "v"] and store.read("s", "t").count() == 0
    store.ingest(frame(spark, [(1, "x")]), "s", "t")
    assert [tuple(r) for r in store.read("s", "t").collect()] == [(1, "x")]


def test_union_by_name_takes_the_first_type(spark):
    out = st.union_by_name([frame(spark, [(1, "a")]), frame(spark, [("2", 5)], "id string, w int")])
    assert out.dtypes == [("id", "bigint"), ("v", "string"), ("w", "int")] and sorted(map(str, out.collect())) == ["Row(id=1, v='a', w=None)", "Row(id=2, v=None, w=5)"]


def test_scan_prunes_by_type(spark, store):
    df = spark.range(30).select(F.col("id"), (F.col("id") % 3).cast("string").alias("p"))
    store.write(df, "s", "t", ["p"])
    got = store.scan("s", "t", [st.Eq("p", "1"), st.Between("id", 9, 20)])
    assert sorted(r.id for r in got.collect()) == [10, 13, 16, 19]
    assert "PartitionFilters: [isnotnull(p" in got._jdf.queryExecution().toString() or "PartitionFilters: [" in got._jdf.queryExecution().toString()
    assert store.scan("s", "none") is None and store.scan("s", "t", [st.Between("id", 40)]).count() == 0


def test_compaction(spark, store):
    for k in range(3):
        store.ingest(frame(spark, [(k, "x")]), "s", "t")
    assert store.compact("s", "t") == 3 and store.compact("s", "t") == 0 and store.read("s", "t").count() == 3


def test_stats(spark):
    df = spark.createDataFrame([(1, None, [1]), (10, "b", None), (9, "a", None)], "n int, s string, x array<int>")
    assert [tuple(r) for r in st.column_stats(df).collect()] == [("n", "1", "10", 0), ("s", "a", "b", 1), ("x", None, None, 2)]


def test_csv(spark, store, tmp_path):
    (tmp_path / "My Orders.csv").write_text("d,n,s\n2026-01-01,1,a\n2026-01-02,2,\n")
    assert st.upload_csv(store, str(tmp_path / "My Orders.csv"), "up") == "my_orders"
    assert store.read("up", "my_orders").dtypes == [("d", "date"), ("n", "int"), ("s", "string")]
    (tmp_path / "none.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        st.upload_csv(store, str(tmp_path / "none.csv"), "up")


def test_sync_resumes_at_its_cursor(spark, store):
    seen = []

    def fetch(cursor):
        seen.append(cursor)
        return frame(spark, [(1, "2026-01-01"), (2, "2026-01-02")]) if cursor is None else frame(spark, [(2, "2026-01-05")]) if cursor < "2026-01-05" else frame(spark, [])

    for _ in range(3):
        st.sync(store, "c", "t", fetch, ["id"], "v")
    assert seen == [None, "2026-01-02", "2026-01-05"] and sorted(map(tuple, store.read("c", "t").collect())) == [(1, "2026-01-01"), (2, "2026-01-05")]


def test_models(spark, store):
    count = ops.Recipe([ops.GroupBy(["v"], [ops.Agg("*", "count", "n")])])
    models = Models(store)
    models.add(Model("b", "s", "t", count))
    models.add(Model("c", "s", "b", ops.Recipe([ops.Filter("n", "gt", 1)])))
    with pytest.raises(Cycle):
        models.add(Model("t", "s", "c", count))
    with pytest.raises(Cycle):
        models.add(Model("x", "s", "x", count))
    store.write(frame(spark, [(1, "a"), (2, "a"), (3, "b")]), "s", "t")
    assert [b.name for b in models.refresh("t")] == ["b", "c"]
    assert [tuple(r) for r in store.read("s", "c").collect()] == [("a", 2)]


def test_a_commit_in_between_is_not_lost(spark, store, monkeypatch):
    df = frame(spark, [(1, "a")])
    store.write(df, "s", "t")
    real = store._add

    def late(rows, source, table, by):
        monkeypatch.setattr(store, "_add", real)
        store.ingest(frame(spark, [(9, "other writer")]), "s", "t")
        return real(rows, source, table, by)

    for change in (
        lambda: store.replace(frame(spark, [(2, "b")]), "s", "t", expected_version=store.manifest("s", "t").version),
        lambda: store.merge(frame(spark, [(1, "B")]), "s", "t", ["id"]),
        lambda: store.ingest(frame(spark, [(3, "c")]), "s", "t"),
    ):
        before = store.manifest("s", "t").version
        monkeypatch.setattr(store, "_add", late)
        with pytest.raises(st.VersionConflict):
            change()
        assert store.manifest("s", "t").version == before + 1
    assert sorted(map(tuple, store.read("s", "t").collect())) == [(1, "a"), (9, "other writer"), (9, "other writer"), (9, "other writer")]


def test_csv_rows_that_misfit_fail(spark, tmp_path):
    (tmp_path / "late.csv").write_text("a,b\n" + "".join(f"{i},x\n" for i in range(1500)) + "abc,x\n")
    df = st.load_csv(spark, str(tmp_path / "late.csv"))
    assert df.dtypes[0] == ("a", "int")
    with pytest.raises(Exception, match="(?i)malformed"):
        df.agg(F.sum("a")).collect()


def test_compact_deals_a_large_partition_out(spark, store):
    rows = [(i, "hot" if i % 10 else "cold") for i in range(300)]
    for part in (rows[:150], rows[150:]):
        store.ingest(frame(spark, part), "s", "t", partition_by=["v"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would go into one task again
    try:
        assert store.compact("s", "t", rows_per_file=20) == 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    out = store.read("s", "t")
    assert sorted(map(tuple, out.collect())) == sorted(rows)
    files = out.withColumn("file", F.input_file_name()).groupBy("v").agg(F.count_distinct("file").alias("n"))
    assert {r.v: r.n for r in files.collect()}["hot"] > 1


def test_compact_keeps_rows_with_maps_and_nulls(spark, store):
    rows = [(i % 7 or None, "hot", {"k": i}) for i in range(80)]
    for part in (rows[:40], rows[40:]):
        store.ingest(spark.createDataFrame(part, "a int, v string, m map<string,int>"), "s", "maps", partition_by=["v"])
    assert store.compact("s", "maps", rows_per_file=20) == 2
    got = [(r.a, r.v, r.m["k"]) for r in store.read("s", "maps").collect()]
    assert sorted(got, key=lambda r: r[2]) == [(a, v, m["k"]) for a, v, m in rows]
