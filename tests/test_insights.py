import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import statistics as st
from tidewater.operators import insights as I
from tidewater.operators import reports as R
from tidewater.operators import semantics as Z
from tidewater.operators import text as X


@pytest.mark.parametrize(
    ("got", "want"),
    [(st.normal_cdf(1.959964), 0.975), (st.t_p(2.228139, 10), 0.05), (st.t_p(12.7062, 1), 0.05), (st.chi2_p(18.307, 10), 0.05), (st.chi2_p(0.5, 3), 0.918891),
     (st.binomial_tail(3, 10, 0.5), 0.9453125), (st.t_quantile(0.975, 5), 2.570582), (st.correlation_p(0.5, 20), 0.024769), (st.welch_p(10, 2, 30, 11, 3, 40), 0.099465),
     (st.kolmogorov_p(0.3, 50, 60), 0.0102), (st.z_p(0), 1.0)],
)
def test_distributions(got, want):
    assert got == pytest.approx(want, abs=2e-3 if want == 0.0102 else 2e-5)


@pytest.fixture(scope="module")
def full(spark):
    rng = random.Random(3)
    rows = []
    for d in range(90):
        for r, base in (("NA", 100.0), ("EU", 80.0), ("APAC", 60.0)):
            for c in ("web", "mobile"):
                v = base + 0.5 * d + rng.random() + (500 if r == "NA" and d == 88 else 0)
                rows.append((str(dt.date(2026, 1, 1) + dt.timedelta(days=d)), r, c, v, base / 10 + 0.1 * d))
    return spark.createDataFrame(rows, "date string, region string, channel string, revenue double, units double").withColumn("date", F.to_date("date"))


def test_schema(full):
    assert I.detect_schema(full) == {"date": "time", "region": "dimension", "channel": "dimension", "revenue": "measure", "units": "measure"}


def test_trends_report(full):
    found = R.trends(full, "date", ["region", "channel"], ["revenue", "units"], "day")
    assert found and [f.rank for f in found] == list(range(1, len(found) + 1))
    keys = [R.story(f) for f in found if R.story(f)]
    assert len(keys) == len(set(keys))
    assert {f.kind for f in found} & {"trend", "change_point", "anomaly"}
    assert "revenue" in R.to_markdown(found) and "<li>" in R.to_html(found) and R.to_json(found).startswith("[")


def test_nulls_don_t_shift_values(spark):
    df = spark.createDataFrame([("2026-01-01", None), ("2026-02-01", 4.0), ("2026-03-01", 8.0)], "d string, v double")
    s = I.series(I.cube(I.prepared(df, "d", [], ["v"]), [], ["v"]), ["v"]).where("agg = 'mean'").orderBy("period").collect()
    assert [r.v for r in s] == [None, 4.0, 8.0]


def test_eu_drop_is_the_top_driver(spark):
    rows = [(dt.date(2026, 1, 5) + dt.timedelta(days=7 * w + d), r, (b + (d * 3 + k) % 5) * (0.5 if r == "EU" and w == 7 else 1.0)) for w in range(8) for d in range(7) for r, b in (("EU", 100), ("NA", 60), ("APAC", 40)) for k in range(3)]
    df = spark.createDataFrame(rows, "date date, region string, revenue double")
    top = R.drivers(df, "date", ["region"], ["revenue"], "week")
    driver = next(f for f in top if f.kind == "driver")
    assert (driver.dimension, driver.value) == ("region", "EU") and driver.details["delta"] < 0
    review = R.review(df, "date", ["region"], ["revenue"], "week", polarity={"revenue": R.HIGHER})
    assert review and review[0].sentiment == "bad" and review[0].children[0].value == "EU"


def test_offsetting_moves(spark):
    rows = [("2026-01", r, v) for r, v in (("EU", 80.0), ("NA", 60.0))] + [("2026-02", r, v) for r, v in (("EU", 40.0), ("NA", 100.0))]
    base = spark.createDataFrame([(p, r, v) for p, r, v in rows for _ in range(5)], "period string, region string, revenue double")
    got = I.drivers(I.cube(base, ["region"], ["revenue"]), "revenue", "2026-02", "2026-01").collect()
    assert all(r.offsetting for r in got) and {r.value: round(r.contribution_pct) for r in got} == {"EU": -50, "NA": 50}


def test_no_time_reports(spark):
    df = spark.createDataFrame([("EU", 480.0 + 5 * i) for i in range(6)] + [("NA", 50.0), ("NA", 52.0), ("APAC", 30.0), ("LATAM", 20.0), ("MEA", 10.0)], "region string, revenue double")
    assert R.drivers(df, None, ["region"], ["revenue"]) and R.review(df, None, ["region"], ["revenue"])


def test_noise_gives_few_findings(spark):
    rng = random.Random(11)
    rows = [(f"s{k}", "", "m", "mean", "id", f"{i:03d}", rng.gauss(100, 5), 1, 1.0) for k in range(60) for i in range(30)]
    s = I.indexed(spark.createDataFrame(rows, "dimension string, value string, measure string, agg string, transform string, period string, v double, n long, impact double"))
    assert I.trends(s).where("significance > 0.5").count() <= 2
    assert I.last_points(s).where("p_value < 0.01").count() <= 5


def test_selection_and_novelty():
    make = lambda kind, m, sig: R.Finding(kind, m, {"slope": 1.0, "z_score": 3.0, "r_squared": 1.0}, 0.0, sig, 1.0)
    picked = R.selected([make("trend", "a", 1.0), make("trend", "a2", 0.9), make("anomaly", "b", 0.85)], 3)
    assert [f.measure for f in picked] == ["a", "b", "a2"]
    assert R.novelty(0, 5) == 1.0 and R.novelty(1, 0) == 0.5 and R.novelty(9, 1000) == pytest.approx(1.0, abs=1e-6)
    f = make("trend", "a", 1.0)
    shown = {f.fingerprint: (1, 0.0, R.signature(f))}
    assert R.with_novelty([f], shown, 0.0)[0].novelty == 0.5 and f.score == 0.75
    assert R.fingerprint("a") == "af63dc4c8601ec8c" and [x.measure for x in R.curated(picked, {picked[0].fingerprint}, {picked[2].fingerprint})] == ["a2", "b"]


def test_dedup():
    make = lambda sig, *kids: R.Finding("trend", "m", {"slope": 1.0, "r_squared": 1.0}, 0.0, sig, 1.0, children=list(kids))
    out = R.deduped([make(0.5), make(0.9, make(1.0), make(1.2))])
    assert len(out) == 1 and [c.significance for c in out[0].children] == [1.2, 0.5]


def test_text(spark):
    rows = [(1, "Panic in tokio::spawn", "E0308 at src/main.rs"), (2, "dark mode please", None), (3, "App panics: parseHTTPResponse", ""), (4, "export to CSV", "csv export")]
    df = spark.createDataFrame(rows, "id int, title string, body string")
    index = X.index(df, "id", ["title", "body"])
    assert sorted(r.id for r in X.search(index, ["panic"]).collect()) == [1, 3] and [r.id for r in X.search(index, ["panic"], whole=True).collect()] == [1]
    assert [r.id for r in X.search(index, ["panic"], ["tokio"]).collect()] == [3]
    assert {r.term: r.df for r in X.doc_freq(index, 1).collect()}["dark mode"] == 1
    assert X.code_words("Panic in tokio::spawn E0308 at src/main.rs v1.2 parseHTTPResponse") == ["panic", "in", "tokio::spawn", "e0308", "at", "src/main.rs", "v1.2", "parsehttpresponse", "parse", "http", "response"]
    assert X.match_ranges("abcabc", ["ab", "bc"]) == [(0, 6)] and "needle" in X.snippet("x " * 300 + "needle" + " y" * 300, ["needle"])
    langs = spark.createDataFrame([("the cat and the dog are in the house",), ("der Hund und die Katze sind in dem Haus und das ist gut",), ("short",)], "t string").select(X.language(F.col("t"))).collect()
    assert [r[0] for r in langs] == ["en", "de", None]


def test_semantics(spark):
    opinions = spark.createDataFrame([("a", "Detected", 1, "Measure", "x"), ("a", "User", 2, None, ""), ("a", "Agent", 3, "Time", "y"), ("a", "Agent", 4, "Entity", None)], "column string, layer string, at long, role string, description string")
    assert tuple(Z.resolved(opinions, ["role", "description"]).first()) == ("a", "Entity", None)
    m = Z.Metric("x", "v", "sum", (Z.Predicate("s", "eq", "it's"), Z.Predicate("n", "isNotNull")))
    assert Z.metric_sql(m) == "SUM(CASE WHEN `s` = 'it\\'s' AND `n` IS NOT NULL THEN `v` END)"
    assert Z.metrics(spark.createDataFrame([("it's", 1, 2.0), ("q", 1, 3.0)], "s string, n int, v double"), [], [m]).first()[0] == 2.0
    assert Z.changes({"a": {"role": "x"}, "b": {}}, {"a": {"role": "y"}, "c": {}}) == [("added", "c", None, None, None), ("removed", "b", None, None, None), ("changed", "a", "role", "x", "y")]
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "id int, name string")
    assert sorted((r.k, r.name or "") for r in Z.many_to_one(left, right, [("k", "id")]).collect()) == [(1, "a"), (2, "")]
    assert math.isclose(R.effect(R.Finding("trend", "m", {"slope": 0.0, "r_squared": 1.0})), 0.7)


@pytest.mark.parametrize("buckets", [2, 7, 512])
def test_running_sums_do_not_depend_on_the_buckets(spark, buckets):
    rng = random.Random(buckets)
    places = {k: sorted({round(rng.gauss(0, 3), 1) for _ in range(n)}) for k, n in (("a", 150), ("b", 1), ("c", 12))}
    rows = [(k, v, rng.randrange(9)) for k, vs in places.items() for v in vs]
    got = I.running(spark.createDataFrame(rows, "k string, v double, n long"), ["k"], "v", ["n"], buckets).collect()
    want = {(k, v): (sum(n for j, u, n in rows if j == k and u <= v), sum(n for j, _, n in rows if j == k)) for k, v, _ in rows}
    assert len(got) == len(rows) and {(r.k, r.v): (r.n_upto, r.n_all) for r in got} == want


def test_running_sums_of_no_rows(spark):
    empty = spark.createDataFrame([], "k string, v double, n long")
    assert I.running(empty, ["k"], "v", ["n"]).collect() == []


def test_concentration_with_equal_segments(spark):
    sums = {"a": 50.0, "b": 10.0, "c": 10.0, "d": 10.0, "e": 5.0, "f": 5.0, None: 10.0}
    df = spark.createDataFrame([("p", k, v / 2) for k, v in sums.items() for _ in range(2)] + [("p", "a", -5.0), ("p", "g", None)], "period string, d string, v double")
    got = I.concentration(df, ["d"], ["v"]).first()
    shares = sorted(v / 100 for v in sums.values())
    below, area = 0.0, 0.0
    for x in shares:
        area += 2 * below + x
        below += x
    assert (got.segments, got["rows"]) == (7, 14) and got.hhi == pytest.approx(sum(x * x for x in shares)) and got.top_share == pytest.approx(70)
    assert got.gini == pytest.approx(1 - area / 7)


def test_concentration_of_sums_whose_last_digits_vary(spark):
    """Sums of doubles depend on their order, which differs whenever a plan is computed again; here each value does."""
    digits = F.udf(lambda v: v * (1 + random.SystemRandom().uniform(-1e-12, 1e-12)), "double").asNondeterministic()
    sums = [100.0 + i for i in range(40)]
    df = spark.createDataFrame([("p", str(i), v) for i, v in enumerate(sums)], "period string, d string, v double").withColumn("v", digits("v"))
    got = I.concentration(df, ["d"], ["v"], hhi=0.0).first()
    total = sum(sums)
    area = sum((2 * sum(sums[:i]) + v) / total for i, v in enumerate(sums))
    assert (got.segments, got["rows"]) == (40, 40) and got.hhi == pytest.approx(sum((v / total) ** 2 for v in sums))
    assert got.top_share == pytest.approx(sum(sums[-3:]) / total * 100) and got.gini == pytest.approx(1 - area / 40)


def test_membership_counts_all_and_lists_the_first(spark):
    base = spark.createDataFrame([("1", f"old{i:03d}") for i in range(30)] + [("2", f"new{i:03d}") for i in range(40)] + [("1", "both"), ("2", "both"), ("2", None)], "period string, d string")
    got = I.membership(base, ["d"], "2", "1", listed=3).first()
    assert (got.added, got.removed, got.previous_size, got.current_size) == (40, 30, 31, 41)
    assert got.added_values == ["new000", "new001", "new002"] and got.removed_values == ["old000", "old001", "old002"]


@pytest.mark.parametrize("n", [1, 3, 10, 49, 50, 60])
def test_even_sample(spark, n):
    df = spark.createDataFrame([(i,) for i in range(50)], "k long")
    assert sorted(r.k for r in I.evenly(df, "k", n).collect()) == ([i * 50 // n for i in range(n)] if n < 50 else list(range(50)))
    ties = spark.createDataFrame([(i // 20, i) for i in range(50)], "k long, i long")
    assert sorted(r.k for r in I.evenly(ties, "k", n).collect()) == ([i * 50 // n // 20 for i in range(n)] if n < 50 else [i // 20 for i in range(50)])


def test_shuffled_sample_is_the_same_again(spark):
    df = spark.range(200)
    first = [r.id for r in I.shuffled_sample(df, "id", 20, 1).collect()]
    assert len(set(first)) == 20 and first == [r.id for r in I.shuffled_sample(df.repartition(7), "id", 20, 1).collect()]
    assert first != [r.id for r in I.shuffled_sample(df, "id", 20, 2).collect()]


def test_term_counts_of_a_search(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, "red hen"), (3, "blue fox"), (4, None), (5, "")], "id int, t string")
    index = X.index(df, "id", ["t"])
    got = {r.term: (r.df, r.y) for r in X.term_counts(index, X.chosen(["red"]), 1).collect()}
    assert got == {"red": (2, 2), "fox": (2, 1), "hen": (1, 1), "blue": (1, 0), "red fox": (1, 1), "red hen": (1, 1), "blue fox": (1, 0)}
    assert X.term_counts(index, X.chosen(["red"], ["hen"]), 2).where("term = 'red'").first().y == 1
    assert [tuple(r) for r in X.common_terms(X.term_counts(index, X.chosen(["red"]), 1), 2, 2).collect()] == [("red", 2, 1.0), ("fox", 1, 0.5)]
