"""Registered insight queries with their SQL, over lineitem by quarter of shipping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import insights as I
from tidewater.session import importable

Q: dict = {}
S: dict[str, str] = {}

DIMS, MEASURES = ["l_returnflag", "l_linestatus", "l_linenumber"], ["l_quantity", "l_extendedprice"]
_BASE = """base AS (
  SELECT strftime(l_shipdate, '%Y') || '-Q' || quarter(l_shipdate) AS period, l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
         l_quantity, l_extendedprice FROM lineitem),
sliced AS (
  SELECT 'l_returnflag' AS dimension, l_returnflag AS value, * FROM base UNION ALL SELECT 'l_linestatus', l_linestatus, * FROM base
  UNION ALL SELECT 'l_linenumber', l_linenumber, * FROM base),
cube AS (
  SELECT '' AS dimension, '' AS value, period, count(*) AS n, sum(l_quantity) AS q, sum(l_quantity * l_quantity) AS q2, sum(l_extendedprice) AS e FROM base GROUP BY period
  UNION ALL SELECT dimension, value, period, count(*), sum(l_quantity), sum(l_quantity * l_quantity), sum(l_extendedprice) FROM sliced GROUP BY 1, 2, 3)"""
# Every slice of these dimensions is above the least share, and every one is there in every period.
_SERIES = f"""{_BASE},
grid AS (SELECT s.dimension, s.value, p.period FROM (SELECT DISTINCT dimension, value FROM cube) s, (SELECT DISTINCT period FROM cube) p),
impacts AS (SELECT dimension, value, sum(n) / (SELECT count(*) FROM base) AS impact FROM cube GROUP BY 1, 2),
full_cube AS (SELECT dimension, value, period, coalesce(n, 0) AS n, coalesce(q, 0) AS q, coalesce(e, 0) AS e FROM grid LEFT JOIN cube USING (dimension, value, period)),
series AS (
  SELECT dimension, value, 'rows' AS measure, 'count' AS agg, period, n::DOUBLE AS v, n, impact FROM full_cube JOIN impacts USING (dimension, value) WHERE impact >= 0.02
  UNION ALL SELECT dimension, value, 'l_quantity', 'sum', period, q, n, impact FROM full_cube JOIN impacts USING (dimension, value) WHERE impact >= 0.02
  UNION ALL SELECT dimension, value, 'l_quantity', 'mean', period, CASE WHEN n > 0 THEN q / n END, n, impact FROM full_cube JOIN impacts USING (dimension, value) WHERE impact >= 0.02
  UNION ALL SELECT dimension, value, 'l_extendedprice', 'sum', period, e, n, impact FROM full_cube JOIN impacts USING (dimension, value) WHERE impact >= 0.02
  UNION ALL SELECT dimension, value, 'l_extendedprice', 'mean', period, CASE WHEN n > 0 THEN e / n END, n, impact FROM full_cube JOIN impacts USING (dimension, value) WHERE impact >= 0.02),
fromfirst AS (SELECT *, min(period) FILTER (v IS NOT NULL) OVER (PARTITION BY dimension, value, measure, agg) AS f FROM series),
gapless AS (SELECT * FROM fromfirst WHERE period >= f QUALIFY count(*) FILTER (v IS NULL) OVER (PARTITION BY dimension, value, measure, agg) = 0),
indexed AS (
  SELECT *, row_number() OVER (PARTITION BY dimension, value, measure, agg ORDER BY period) - 1 AS idx,
         count(*) OVER (PARTITION BY dimension, value, measure, agg) AS points FROM gapless)"""


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return I.prepared(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_shipdate", DIMS, MEASURES, "quarter")


def _add(name: str, run, sql: str | None) -> None:
    Q[name] = lambda spark, sf_dir: run(_base(spark, sf_dir))
    if sql:
        S[name] = sql


def _r(df: DataFrame, *cols: str, digits: int = 4) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


_KEYS = ["dimension", "value", "measure", "agg"]
_add(
    "insight_cube",
    lambda b: _r(I.cube(b, DIMS, MEASURES), "l_quantity|sum", "l_quantity|sq", "l_extendedprice|sum", digits=2).select("dimension", "value", "period", "n", F.col("`l_quantity|sum`").alias("q"), F.col("`l_quantity|sq`").alias("q2"), F.col("`l_extendedprice|sum`").alias("e")),
    f"WITH {_BASE} SELECT dimension, value, period, n, round(q, 2) AS q, round(q2, 2) AS q2, round(e, 2) AS e FROM cube",
)
_add(
    "insight_pair_counts",
    lambda b: _r(I.pair_counts(b, DIMS), "impact", digits=6),
    f"""WITH {_BASE}, p AS (
      SELECT 'l_returnflag' AS dimension_a, l_returnflag AS value_a, 'l_linestatus' AS dimension_b, l_linestatus AS value_b, period FROM base
      UNION ALL SELECT 'l_returnflag', l_returnflag, 'l_linenumber', l_linenumber, period FROM base UNION ALL SELECT 'l_linestatus', l_linestatus, 'l_linenumber', l_linenumber, period FROM base),
    c AS (SELECT dimension_a, value_a, dimension_b, value_b, period, count(*) AS n FROM p GROUP BY ALL),
    i AS (SELECT *, sum(n) OVER (PARTITION BY dimension_a, value_a, dimension_b, value_b) / (SELECT count(*) FROM base) AS impact FROM c)
    SELECT dimension_a, value_a, dimension_b, value_b, period, n, round(impact, 6) AS impact FROM i WHERE impact >= 0.02""",
)


def _series(b: DataFrame) -> DataFrame:
    return I.series(I.cube(b, DIMS, MEASURES), MEASURES)


_add("insight_series", lambda b: _r(_series(b), "v", "impact").drop("n"), f"WITH {_SERIES} SELECT dimension, value, measure, agg, period, round(v, 4) AS v, round(impact, 4) AS impact FROM series")
_OWN = "OVER (PARTITION BY dimension, value, measure, agg ORDER BY period)"
for _t, _sql in {
    "delta": f"SELECT dimension, value, measure, agg, period, round(v - p, 3) AS v FROM (SELECT *, lag(v) {_OWN} AS p, row_number() {_OWN} AS i FROM series) WHERE i > 1",
    "pct": f"SELECT dimension, value, measure, agg, period, round(CASE WHEN abs(p) >= 1e-9 THEN (v - p) / abs(p) * 100 END, 3) AS v FROM (SELECT *, lag(v) {_OWN} AS p, row_number() {_OWN} AS i FROM series) WHERE i > 1",
    "share": """SELECT s.dimension, s.value, s.measure, s.agg, s.period, round(CASE WHEN t.v <> 0 THEN s.v / t.v END, 3) AS v FROM series s
                JOIN (SELECT * FROM series WHERE dimension = '') t USING (measure, agg, period) WHERE s.dimension <> '' AND s.agg <> 'mean'""",
    "rank": """SELECT dimension, value, measure, agg, period, rank() OVER (PARTITION BY dimension, period ORDER BY n DESC)::DOUBLE AS v FROM series
               WHERE measure = 'rows' AND dimension IN ('l_returnflag', 'l_linenumber')""",
}.items():
    _add(f"insight_series_{_t}", lambda b, t=_t: _r(I.derived(_series(b)).where(F.col("transform") == t), "v", digits=3).select(*_KEYS, "period", "v"), f"WITH {_SERIES} {_sql}")

_add(
    "insight_trend",
    lambda b: _r(I.trends(I.indexed(_series(b), _KEYS), _KEYS), "slope", "r_squared", digits=5).select(*_KEYS, "points", "slope", "r_squared"),
    f"""WITH {_SERIES} SELECT dimension, value, measure, agg, max(points) AS points, round(regr_slope(v, idx), 5) AS slope,
        round(CASE WHEN regr_syy(v, idx) > 0 THEN regr_r2(v, idx) ELSE 0 END, 5) AS r_squared FROM indexed WHERE points >= 3 GROUP BY 1, 2, 3, 4""",
)
_add(
    "insight_anomaly",
    lambda b: _r(I.last_points(I.indexed(_series(b), _KEYS), _KEYS), "mean", "std", "z_score", digits=3).select(*_KEYS, "period", "mean", "std", "z_score"),
    f"""WITH {_SERIES}, a AS (SELECT dimension, value, measure, agg, max_by(period, idx) AS period, max_by(v, idx) AS last, avg(v) FILTER (idx < points - 1) AS mean,
        stddev_samp(v) FILTER (idx < points - 1) AS std FROM indexed WHERE points >= 4 GROUP BY 1, 2, 3, 4)
        SELECT dimension, value, measure, agg, period, round(mean, 3) AS mean, round(std, 3) AS std, round((last - mean) / std, 3) AS z_score FROM a WHERE std > 0 AND abs((last - mean) / std) > 2""",
)
_add(
    "insight_change_point",
    lambda b: _r(I.change_points(I.indexed(_series(b), _KEYS), _KEYS), "before_mean", "after_mean", "shift", digits=3).select(*_KEYS, "period", "before_mean", "after_mean", "shift"),
    f"""WITH {_SERIES}, m AS (SELECT *, avg(v) OVER w AS m, stddev_samp(v) OVER w AS sd FROM indexed WHERE points >= 6 WINDOW w AS (PARTITION BY dimension, value, measure, agg)),
    c AS (SELECT *, abs(sum(v - m) OVER (PARTITION BY dimension, value, measure, agg ORDER BY idx)) AS c FROM m WHERE sd > 0),
    k AS (SELECT *, first_value(idx) OVER (PARTITION BY dimension, value, measure, agg ORDER BY round(c, 9) DESC, idx) AS cp FROM c),
    g AS (SELECT dimension, value, measure, agg, max(period) FILTER (idx = cp) AS period, avg(v) FILTER (idx <= cp) AS b, avg(v) FILTER (idx > cp) AS a FROM k WHERE cp >= 2 AND cp <= points - 3 GROUP BY 1, 2, 3, 4)
    SELECT dimension, value, measure, agg, period, round(b, 3) AS before_mean, round(a, 3) AS after_mean, round(abs(a - b) / greatest(abs(b), 1e-6), 3) AS shift
    FROM g WHERE abs(a - b) / greatest(abs(b), 1e-6) >= 0.15""",
)
_add(
    "insight_forecast",
    lambda b: _r(I.forecasts(I.indexed(_series(b), _KEYS), _KEYS, least=-1, p=2.0), "expected", "deviation_percent", digits=3).select(*_KEYS, "period", "expected", "deviation_percent"),
    f"""WITH {_SERIES}, g AS (SELECT dimension, value, measure, agg, max(points) AS n, max_by(period, idx) AS period, max_by(v, idx) AS actual, regr_slope(v, idx) FILTER (idx < points - 1) AS b,
        regr_intercept(v, idx) FILTER (idx < points - 1) AS a, regr_syy(v, idx) FILTER (idx < points - 1) AS syy, regr_sxy(v, idx) FILTER (idx < points - 1) AS sxy, regr_sxx(v, idx) FILTER (idx < points - 1) AS sxx
        FROM indexed WHERE points >= 5 GROUP BY 1, 2, 3, 4)
    SELECT dimension, value, measure, agg, period, round(a + b * (n - 1), 3) AS expected, round((actual - a - b * (n - 1)) / abs(a + b * (n - 1)) * 100, 3) AS deviation_percent
    FROM g WHERE a + b * (n - 1) <> 0 AND syy - sxy * sxy / sxx > 0""",
)
_add(
    "insight_distribution_shift",
    lambda b: _r(I.distribution_shift(b, MEASURES, "1998-Q4", "1995-Q1", least=0.0), "ks_statistic", "p_value", digits=6),
    f"""WITH {_BASE}, r AS (SELECT 'l_quantity' AS measure, l_quantity AS v, period FROM base UNION ALL SELECT 'l_extendedprice', l_extendedprice, period FROM base),
    c AS (SELECT measure, v, count(*) FILTER (period = '1995-Q1') AS a, count(*) FILTER (period = '1998-Q4') AS b FROM r WHERE period IN ('1995-Q1', '1998-Q4') GROUP BY 1, 2),
    g AS (SELECT *, abs(sum(a) OVER u / sum(a) OVER w - sum(b) OVER u / sum(b) OVER w) AS g FROM c WINDOW u AS (PARTITION BY measure ORDER BY v), w AS (PARTITION BY measure)),
    k AS (SELECT measure, max(g) AS d, sum(a) AS a, sum(b) AS b, sqrt(sum(a) * sum(b) / (sum(a) + sum(b))) AS n FROM g GROUP BY 1 HAVING sum(a) >= 5 AND sum(b) >= 5),
    x AS (SELECT *, -2 * power((n + 0.12 + 0.11 / n) * d, 2) AS x FROM k)
    SELECT measure, round(d, 6) AS ks_statistic, CAST(a AS BIGINT) AS previous_n, CAST(b AS BIGINT) AS current_n,
           round(greatest(0, least(1, 2 * (exp(x) - exp(4 * x) + exp(9 * x) - exp(16 * x) + exp(25 * x)))), 6) AS p_value FROM x""",
)
_add(
    "insight_concentration",
    lambda b: _r(I.concentration(b, DIMS, MEASURES), "hhi", "top_share", "gini", digits=6).drop("p_value"),
    f"""WITH {_BASE}, r AS (SELECT dimension, value, 'l_quantity' AS measure, l_quantity AS v FROM sliced UNION ALL SELECT dimension, value, 'l_extendedprice', l_extendedprice FROM sliced),
    s AS (SELECT dimension, measure, value, sum(v) AS s, count(*) AS n FROM r WHERE v > 0 GROUP BY 1, 2, 3),
    h AS (SELECT *, s / sum(s) OVER (PARTITION BY dimension, measure) AS share FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY dimension, measure ORDER BY share DESC, value) AS place, sum(share) OVER (PARTITION BY dimension, measure ORDER BY share, value) AS cum FROM h),
    g AS (SELECT dimension, measure, sum(share * share) AS hhi, sum(share) FILTER (place <= 3) * 100 AS top_share, count(*) AS segments, CAST(sum(n) AS BIGINT) AS rows, 1 - sum(2 * cum - share) / count(*) AS gini FROM k GROUP BY 1, 2)
    SELECT dimension, measure, round(hhi, 6) AS hhi, round(top_share, 6) AS top_share, segments, rows, round(greatest(0, least(1, gini)), 6) AS gini FROM g WHERE hhi >= 0.25 OR top_share >= 60""",
)
_add(
    "insight_dominance",
    lambda b: _r(I.dominance(I.cube(b, DIMS, MEASURES), MEASURES), "share", "expected_share", digits=6).drop("p_value", "significance"),
    f"""WITH {_BASE}, r AS (SELECT dimension, value, 'rows' AS measure, n::DOUBLE AS v FROM cube WHERE dimension <> '' UNION ALL SELECT dimension, value, 'l_quantity', q FROM cube WHERE dimension <> ''
        UNION ALL SELECT dimension, value, 'l_extendedprice', e FROM cube WHERE dimension <> ''),
    s AS (SELECT dimension, measure, value, greatest(0, sum(v)) AS v FROM r GROUP BY 1, 2, 3),
    p AS (SELECT *, v / sum(v) OVER w AS share, row_number() OVER (PARTITION BY dimension, measure ORDER BY v DESC, value) AS place FROM s WINDOW w AS (PARTITION BY dimension, measure))
    SELECT dimension, measure, count(*) AS "values", min_by(value, place) AS value, round(max(share), 6) AS share, round(exp(regr_intercept(ln(share), ln(place)) FILTER (place >= 2)), 6) AS expected_share
    FROM p GROUP BY 1, 2 HAVING count(*) >= 4""",
)
_add(
    "insight_membership",
    lambda b: I.membership(b, DIMS, "1998-Q4", "1995-Q1").select("dimension", "added", "removed", "previous_size", "current_size"),
    f"""WITH {_BASE}, h AS (SELECT dimension, value, bool_or(period = '1998-Q4') AS now, bool_or(period = '1995-Q1') AS past FROM sliced WHERE period IN ('1998-Q4', '1995-Q1') GROUP BY 1, 2)
    SELECT dimension, count(*) FILTER (now AND NOT past) AS added, count(*) FILTER (past AND NOT now) AS removed, count(*) FILTER (past) AS previous_size, count(*) FILTER (now) AS current_size
    FROM h GROUP BY 1 HAVING count(*) FILTER (past) > 0 AND count(*) FILTER (now) > 0 AND count(*) FILTER (now <> past) > 0""",
)
_add(
    "insight_outlier_clusters",
    lambda b: I.outlier_clusters(b, MEASURES, 1.0).select("period", "direction", F.concat_ws(",", "columns").alias("columns"), "cluster_size"),
    f"""WITH {_BASE}, m AS (SELECT 'l_quantity' AS measure, period, avg(l_quantity) AS m FROM base GROUP BY 2 UNION ALL SELECT 'l_extendedprice', period, avg(l_extendedprice) FROM base GROUP BY 2),
    z AS (SELECT *, (m - avg(m) OVER w) / stddev_samp(m) OVER w AS z FROM m WINDOW w AS (PARTITION BY measure))
    SELECT period, CASE WHEN z > 0 THEN 'spike' ELSE 'dip' END AS direction, string_agg(measure, ',' ORDER BY measure) AS columns, count(*) AS cluster_size
    FROM z WHERE abs(z) > 1 GROUP BY 1, 2 HAVING count(*) >= 2""",
)
_add(
    "insight_period_stats", lambda b: _r(I.period_stats(b, "l_quantity"), "sum", "mean", "std"),
    f"""WITH {_BASE} SELECT period, count(l_quantity) AS count, round(sum(l_quantity), 4) AS sum, round(avg(l_quantity), 4) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 4) AS std FROM base GROUP BY 1""",
)
_add(
    "insight_period_comparison",
    lambda b: _r(I.period_comparison(b.where("l_quantity > 45 or period = '1995-Q1'"), MEASURES, "1998-Q2", "1995-Q1"), "current_mean", "previous_mean", "change_percent").select("measure", "current_mean", "previous_mean", "current_n", "previous_n", "change_percent"),
    f"""WITH {_BASE}, r AS (SELECT 'l_quantity' AS measure, l_quantity AS v, period FROM base WHERE l_quantity > 45 OR period = '1995-Q1'
        UNION ALL SELECT 'l_extendedprice', l_extendedprice, period FROM base WHERE l_quantity > 45 OR period = '1995-Q1'),
    g AS (SELECT measure, avg(v) FILTER (period = '1998-Q2') AS c, count(v) FILTER (period = '1998-Q2') AS cn, avg(v) FILTER (period = '1995-Q1') AS p, count(v) FILTER (period = '1995-Q1') AS pn FROM r GROUP BY 1)
    SELECT measure, round(c, 4) AS current_mean, round(p, 4) AS previous_mean, cn AS current_n, pn AS previous_n, round((c - p) / abs(p) * 100, 4) AS change_percent FROM g WHERE abs((c - p) / abs(p) * 100) > 50""",
)
_add(
    "insight_segments",
    lambda b: _r(I.segment_attribution(b, DIMS, MEASURES), "segment_mean", "other_mean", "contribution", "change_percent").drop("p_value"),
    f"""WITH {_BASE}, r AS (SELECT dimension, value, 'l_quantity' AS measure, l_quantity AS v FROM sliced UNION ALL SELECT dimension, value, 'l_extendedprice', l_extendedprice FROM sliced),
    g AS (SELECT dimension, measure, value, count(*) AS n, sum(v) AS s FROM r GROUP BY 1, 2, 3),
    t AS (SELECT *, sum(n) OVER w AS tn, sum(s) OVER w AS ts FROM g WINDOW w AS (PARTITION BY dimension, measure)),
    c AS (SELECT dimension, measure, value, n, s / n AS m, (ts - s) / (tn - n) AS o, (s / n - ts / tn) * n / tn AS c FROM t WHERE n >= 2 AND tn - n >= 2)
    SELECT dimension, measure, value, n, round(m, 4) AS segment_mean, round(o, 4) AS other_mean, round(c, 4) AS contribution, round((m - o) / o * 100, 4) AS change_percent
    FROM c QUALIFY row_number() OVER (PARTITION BY dimension, measure ORDER BY abs(round(c, 9)) DESC, value) = 1""",
)
_add(
    "insight_period_segments",
    lambda b: _r(I.period_segments(b, DIMS, ["l_quantity"], "1996-Q1"), "change_percent", "contribution", "contribution_pct", digits=3),
    f"""WITH {_BASE}, g AS (SELECT dimension, value, count(*) FILTER (period = '1996-Q1') AS n, sum(l_quantity) FILTER (period = '1996-Q1') AS a, count(*) FILTER (period <> '1996-Q1') AS m, sum(l_quantity) FILTER (period <> '1996-Q1') AS b FROM sliced GROUP BY 1, 2),
    t AS (SELECT *, (sum(a) OVER w / sum(n) OVER w - sum(b) OVER w / sum(m) OVER w) * sum(n) OVER w AS total FROM g WINDOW w AS (PARTITION BY dimension))
    SELECT dimension, 'l_quantity' AS measure, value, n, round((a / n - b / m) / abs(b / m) * 100, 3) AS change_percent, round((a / n - b / m) * n, 3) AS contribution, round((a / n - b / m) * n / total * 100, 3) AS contribution_pct
    FROM t WHERE n > 0 AND m > 0 AND abs(total) >= 0.0001""",
)
_add(
    "insight_correlation",
    lambda b: _r(I.correlations(b, MEASURES, 0.0, 2.0), "r_value", digits=6).drop("p_value"),
    f"WITH {_BASE} SELECT 'l_quantity' AS column_a, 'l_extendedprice' AS column_b, round(corr(l_quantity, l_extendedprice), 6) AS r_value, count(*) AS n FROM base",
)
_add(
    "insight_drivers",
    lambda b: _r(I.drivers(I.cube(b, DIMS, MEASURES), "l_quantity", "1996-Q1", "1995-Q4"), "delta", "contribution_pct", "change_percent", digits=3).select("dimension", "value", "delta", "contribution_pct", "change_percent", "offsetting", "place"),
    f"""WITH {_BASE}, g AS (SELECT dimension, value, coalesce(sum(q) FILTER (period = '1996-Q1'), 0) AS c, coalesce(sum(q) FILTER (period = '1995-Q4'), 0) AS p FROM cube WHERE period IN ('1996-Q1', '1995-Q4') GROUP BY 1, 2),
    d AS (SELECT *, c - p AS delta FROM g), t AS (SELECT delta AS total FROM d WHERE dimension = ''), x AS (SELECT sum(abs(delta)) AS gross FROM d WHERE dimension <> ''),
    o AS (SELECT d.*, total, gross, gross > 0 AND abs(total) < 0.25 * gross AS offsetting FROM d, t, x WHERE dimension <> '' AND delta <> 0),
    k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY abs(round(delta, 6)) DESC, value) <= 3),
    f AS (SELECT *, CAST(row_number() OVER (ORDER BY abs(round(delta, 6)) DESC, dimension, value) AS INTEGER) AS place FROM k)
    SELECT dimension, value, round(delta, 3) AS delta, round(delta / CASE WHEN offsetting THEN gross ELSE greatest(abs(total), 1e-12) END * 100, 3) AS contribution_pct,
           round(CASE WHEN abs(p) > 1e-12 THEN delta / abs(p) * 100 ELSE 0 END, 3) AS change_percent, offsetting, place FROM f WHERE place <= 8""",
)


def _autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("ts")).agg(F.count(F.lit(1)).alias("v"))
    wave = o.withColumn("v", F.col("v") + 40 * F.pmod(F.datediff("ts", F.lit("1992-01-01")), F.lit(7))).withColumn("series", F.lit("orders"))
    return _r(I.seasonality(wave, ["series"]), "autocorrelation", digits=4).drop("p_value")


Q["insight_seasonality"] = _autocorrelation
# Over thousands of days the p-value of a correlation beyond 0.5 is 0 to any digit, so the strongest one wins.
S["insight_seasonality"] = f"""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS ts, count(*) AS n FROM orders GROUP BY 1),
w AS (SELECT n + 40 * (date_diff('day', DATE '1992-01-01', ts) % 7) AS v, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n, date_diff('day', lag(ts) OVER (ORDER BY ts), ts) AS gap FROM o),
d AS (SELECT *, avg(gap) OVER () AS days FROM w),
t AS (SELECT i, v, n, period_days, season, CAST(round(period_days / days) AS BIGINT) AS lag FROM d, (VALUES {", ".join(f"({d}, '{name}')" for d, name in I.SEASONS)}) s(period_days, season)),
r AS (SELECT a.period_days, a.season, corr(a.v, b.v) AS r FROM t a JOIN t b ON b.season = a.season AND b.i = a.i + a.lag WHERE a.lag > 0 AND a.n >= 2 * a.lag + 3 GROUP BY 1, 2)
SELECT 'orders' AS series, period_days, season, round(r, 4) AS autocorrelation FROM r WHERE abs(r) > 0.5 ORDER BY abs(r) DESC LIMIT 1"""
Q["insight_schema"] = lambda spark, sf_dir: spark.createDataFrame(sorted(I.detect_schema(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).items()), "column string, role string")
_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_GIVEN = {"l_returnflag": "dimension", "l_linestatus": "dimension", "l_shipdate": "time"}
S["insight_schema"] = " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) < 20 AND count(DISTINCT {c}) / count(*) < 0.05 THEN 'dimension' ELSE 'measure' END AS role FROM lineitem" for c in _NUMBERS]
    + [f"SELECT '{c}', '{role}'" for c, role in _GIVEN.items()]
)
Q["insight_profile"] = lambda spark, sf_dir: I.profile(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment"), order="c_custkey").withColumn("samples", F.array_join("samples", ","))
S["insight_profile"] = """WITH f AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 1000),
s AS (SELECT (SELECT string_agg(v, ',' ORDER BY c) FROM (SELECT c_mktsegment AS v, min(c_custkey) AS c FROM f GROUP BY 1 ORDER BY 2 LIMIT 5)) AS m,
      (SELECT string_agg(c_name, ',' ORDER BY c_custkey) FROM (SELECT * FROM f ORDER BY c_custkey LIMIT 5)) AS n, (SELECT string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) FROM (SELECT * FROM f ORDER BY c_custkey LIMIT 5)) AS k)
SELECT 'c_custkey' AS "column", 'bigint' AS type, count(DISTINCT c_custkey) AS "distinct", 0.0::DOUBLE AS null_share, CAST(min(c_custkey) AS VARCHAR) AS min, CAST(max(c_custkey) AS VARCHAR) AS max, any_value(k) AS samples FROM customer, s
UNION ALL SELECT 'c_name', 'string', count(DISTINCT c_name), 0.0, NULL, NULL, any_value(n) FROM customer, s UNION ALL SELECT 'c_mktsegment', 'string', count(DISTINCT c_mktsegment), 0.0, NULL, NULL, any_value(m) FROM customer, s"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that came and went between two quarters."""
    base = I.prepared(spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("part", F.col("l_partkey").cast("string")), "l_shipdate", ["part"], ["l_quantity"], "quarter")
    return I.membership(base, ["part"], "1995-Q2", "1995-Q1").select("dimension", "added", "removed", "previous_size", "current_size", F.array_join(F.slice("added_values", 1, 3), ",").alias("first_added"))


Q["insight_membership_parts"] = _parts
S["insight_membership_parts"] = """WITH b AS (SELECT CAST(l_partkey AS VARCHAR) AS value, bool_or(l_shipdate >= DATE '1995-04-01') AS now, bool_or(l_shipdate < DATE '1995-04-01') AS past
  FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1995-07-01' GROUP BY 1)
SELECT 'part' AS dimension, count(*) FILTER (now AND NOT past) AS added, count(*) FILTER (past AND NOT now) AS removed, count(*) FILTER (past) AS previous_size, count(*) FILTER (now) AS current_size,
       array_to_string(list_sort(list(value) FILTER (now AND NOT past))[:3], ',') AS first_added FROM b"""


Q["sample_evenly"] = lambda spark, sf_dir: I.evenly(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), "o_orderkey", 100)
S["sample_evenly"] = """WITH p AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_custkey FROM p WHERE i IN (SELECT k * (SELECT count(*) FROM orders) // 100 FROM range(100) t(k))"""
Q["sample_shuffled"] = lambda spark, sf_dir: I.shuffled_sample(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey", 100, 7)
S["sample_shuffled"] = "SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey) LIMIT 100"


def _report(which: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tidewater.operators import reports

        df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        return reports.as_frame(spark, getattr(reports, which)(df, "l_shipdate", DIMS[:2], MEASURES, "quarter"))

    return run


for _which in ("trends", "review", "drivers"):
    Q[f"report_{_which}"] = _report(_which)
