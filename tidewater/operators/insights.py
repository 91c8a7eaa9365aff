"""Series derived from a table, and detectors over them, as DataFrame plans.

prepared -> cube -> series -> derived -> detectors. One pass over the raw rows makes the cube of
counts and moments by period and slice (partial sums map-side); everything later works on that.
Null values are left out pairwise: a mean divides by the rows that have the measure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import statistics as st
from tidewater.functions.periods import any_day, label
from tidewater.session import stored

#: Values of a dimension that get series, the least share of rows, and series in all.
TOP_VALUES, MIN_IMPACT, BUDGET = 12, 0.02, 20_000
KEY = ["dimension", "value", "measure", "agg", "transform"]
#: Pieces that the sorted values of one column are cut into, and values of a kind that a finding lists.
BUCKETS, LISTED = 512, 100


def prepared(df: DataFrame, time: str | None, dims: list[str], measures: list[str], granularity: str = "month") -> DataFrame:
    """Rows (period, dimensions as text, measures as finite doubles)."""
    day = label(any_day(F.col(f"`{time}`"), df.schema[time].dataType), granularity) if time else F.lit(None).cast("string")
    number = lambda m: F.when(F.isnan(F.col(f"`{m}`").cast("double")), None).otherwise(F.col(f"`{m}`").cast("double"))
    return df.select(day.alias("period"), *[F.col(f"`{d}`").cast("string").alias(d) for d in dims], *[number(m).alias(m) for m in measures])


def _moments(measures: list[str]) -> list[Column]:
    made = [F.count(F.lit(1)).alias("n")]
    for m in measures:
        c = F.col(f"`{m}`")
        made += [F.count(c).alias(f"{m}|n"), F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{m}|sum"), F.coalesce(F.sum(c * c), F.lit(0.0)).alias(f"{m}|sq")]
    return made


def _slices(base: DataFrame, dims: list[str]) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"`{d}`").alias("value")) for d in dims])
    return base.withColumn("_s", F.explode(parts)).select("*", "_s.dimension", "_s.value").drop("_s").where("value is not null and value <> ''")


def top_values(base: DataFrame, dims: list[str], k: int = TOP_VALUES) -> DataFrame:
    """The k most frequent values of each dimension, blank ones left out; ties by value."""
    counts = _slices(base.select(*[F.col(f"`{d}`") for d in dims]), dims).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("rows"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def cube(base: DataFrame, dims: list[str], measures: list[str], k: int = TOP_VALUES) -> DataFrame:
    """Counts, sums and sums of squares by period: of the table (empty dimension and value) and of each top slice."""
    rows = base.where("period is not null")
    whole = rows.groupBy("period").agg(*_moments(measures)).withColumn("dimension", F.lit("")).withColumn("value", F.lit(""))
    if not dims:
        return whole
    sliced = _slices(rows, dims).groupBy("dimension", "value", "period").agg(*_moments(measures))
    kept = sliced.join(F.broadcast(top_values(base, dims, k).select("dimension", "value")), ["dimension", "value"])  # k rows a dimension
    return whole.unionByName(kept)


def pair_counts(base: DataFrame, dims: list[str], k: int = TOP_VALUES, least: float = MIN_IMPACT) -> DataFrame:
    """Rows by period of pairs of top values of two dimensions, from a share of `least` of all rows on."""
    names = [(a, b) for i, a in enumerate(dims) for b in dims[i + 1 :]]
    parts = F.array(*[F.struct(F.lit(a).alias("dimension_a"), F.col(f"`{a}`").alias("value_a"), F.lit(b).alias("dimension_b"), F.col(f"`{b}`").alias("value_b")) for a, b in names])
    rows = base.where("period is not null").withColumn("_p", F.explode(parts)).select("period", "_p.*")
    counts = rows.groupBy("dimension_a", "value_a", "dimension_b", "value_b", "period").agg(F.count(F.lit(1)).alias("n"))
    top = F.broadcast(top_values(base, dims, k).select("dimension", "value"))
    for s in "ab":
        counts = counts.join(top.withColumnsRenamed({"dimension": f"dimension_{s}", "value": f"value_{s}"}), [f"dimension_{s}", f"value_{s}"])
    total = base.count()
    own = Window.partitionBy("dimension_a", "value_a", "dimension_b", "value_b")
    return counts.withColumn("impact", F.sum("n").over(own) / total).where(F.col("impact") >= least)


def series(cubed: DataFrame, measures: list[str], least: float = MIN_IMPACT, budget: int = BUDGET) -> DataFrame:
    """Long rows (dimension, value, measure, agg, period, v, n, impact), every slice at every period.

    Row counts, and sum and mean of each measure. An absent cell is a count and sum of 0 and no
    mean. Slices under the least share of rows go, and so do the smallest beyond the budget.
    """
    periods = cubed.where("dimension = ''").select("period", F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    slices = cubed.groupBy("dimension", "value").agg(F.sum("n").alias("rows"))
    per_slice = 1 + 2 * len(measures)
    grid = slices.join(F.broadcast(periods), F.lit(True)).withColumn("impact", F.col("rows") / F.col("total")).where(F.col("impact") >= least)
    place = F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("impact"), "dimension", "value"))
    grid = grid.withColumn("_place", place).where(F.col("_place") <= max(1, budget // per_slice)).drop("_place", "rows", "total")
    cells = grid.join(cubed, ["dimension", "value", "period"], "left").fillna(0)
    kinds = [F.struct(F.lit("rows").alias("measure"), F.lit("count").alias("agg"), F.col("n").cast("double").alias("v"))]
    for m in measures:
        total, count = F.col(f"`{m}|sum`"), F.col(f"`{m}|n`")
        kinds.append(F.struct(F.lit(m).alias("measure"), F.lit("sum").alias("agg"), total.alias("v")))
        kinds.append(F.struct(F.lit(m).alias("measure"), F.lit("mean").alias("agg"), F.when(count > 0, total / count).alias("v")))
    return cells.withColumn("_k", F.explode(F.array(*kinds))).select("dimension", "value", "_k.measure", "_k.agg", "period", "_k.v", "n", "impact")


def derived(s: DataFrame) -> DataFrame:
    """The series themselves, their differences, percent differences and shares of the total, and ranks among siblings."""
    own = Window.partitionBy("dimension", "value", "measure", "agg").orderBy("period")
    each = Window.partitionBy("dimension", "value", "measure", "agg")
    prev = F.lag("v").over(own)
    steps = s.withColumn("_prev", prev).withColumn("_i", F.row_number().over(own)).withColumn("_n", F.count(F.lit(1)).over(each))
    moved = steps.where("_n >= 4 and _i > 1")
    same = s.withColumn("transform", F.lit("id"))
    delta = moved.withColumn("v", F.col("v") - F.col("_prev")).withColumn("transform", F.lit("delta"))
    percent = F.when(F.abs("_prev") >= 1e-9, F.try_divide(F.col("v") - F.col("_prev"), F.abs("_prev")) * 100)
    pct = moved.withColumn("v", percent).withColumn("transform", F.lit("pct"))
    parts = s.where("dimension <> '' and agg <> 'mean'")
    totals = s.where("dimension = ''").select("measure", "agg", "period", F.col("v").alias("_all"))
    share = parts.join(F.broadcast(totals), ["measure", "agg", "period"]).withColumn("v", F.when(F.col("_all") != 0, F.try_divide(F.col("v"), F.col("_all")))).withColumn("transform", F.lit("share"))
    siblings = parts.where("measure = 'rows'").withColumn("_k", F.size(F.collect_set("value").over(Window.partitionBy("dimension", "period"))))
    rank = siblings.where("_k >= 3").withColumn("v", F.rank().over(Window.partitionBy("dimension", "period").orderBy(F.desc("n"))).cast("double")).withColumn("transform", F.lit("rank"))
    cols = ["dimension", "value", "measure", "agg", "transform", "period", "v", "n", "impact"]
    return reduce(DataFrame.unionByName, [x.select(*cols) for x in (same, delta, pct, share, rank)])


def indexed(s: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Adds idx and points; leading gaps are cut off, a series with a gap inside is left out."""
    own = Window.partitionBy(*keys)
    s = s.withColumn("_from", F.min(F.when(F.col("v").isNotNull(), F.col("period"))).over(own)).where("period >= _from")
    s = s.withColumn("_gap", F.max(F.col("v").isNull()).over(own)).where(~F.col("_gap"))
    return s.withColumn("idx", F.row_number().over(own.orderBy("period")) - 1).withColumn("points", F.count(F.lit(1)).over(own)).drop("_from", "_gap")


def _capped(score: Column, points: Column) -> Column:
    """Few points can't be convincing."""
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.when(points < 6, F.least(unit, F.lit(0.6))).otherwise(unit)


def _y0(slope: Column, mean_y: Column, mean_x: Column) -> Column:
    return mean_y - slope * mean_x


def trends(s: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Least squares over 0..n-1, from three points: slope, r_squared (0 for a constant), p_value, significance."""
    fit = s.where("points >= 3").groupBy(*keys).agg(
        F.max("points").alias("points"), F.max("impact").alias("impact"), F.max_by("period", "idx").alias("period"),
        F.regr_slope("v", "idx").alias("slope"), F.regr_intercept("v", "idx").alias("intercept"),
        F.when(F.regr_syy("v", "idx") > 0, F.regr_r2("v", "idx")).otherwise(0.0).alias("r_squared"),
    )
    fit = fit.withColumn("p_value", st.column(st.correlation_p, F.sqrt("r_squared"), F.col("points")))
    return fit.withColumn("significance", _capped(F.col("r_squared") * (1 - F.col("p_value")), F.col("points")))


def last_points(s: DataFrame, keys: list[str] = KEY, z: float = 2.0) -> DataFrame:
    """The last point against the rest, from four points: z of plain mean and deviation, and detrended significance."""
    before = lambda c: F.when(F.col("idx") < F.col("points") - 1, c)
    v, x = before(F.col("v")), before(F.col("idx").cast("double"))
    row = s.where("points >= 4").groupBy(*keys).agg(
        F.max("points").alias("points"), F.max("impact").alias("impact"), F.max_by("period", "idx").alias("period"), F.max_by("v", "idx").alias("actual"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.regr_slope(v, x).alias("slope"), F.regr_intercept(v, x).alias("intercept"),
        F.regr_sxx(v, x).alias("sxx"), F.regr_sxy(v, x).alias("sxy"), F.regr_syy(v, x).alias("syy"),
    )
    row = row.withColumn("z_score", F.when(F.col("std") > 0, (F.col("actual") - F.col("mean")) / F.col("std")))
    expected = F.col("intercept") + F.col("slope") * (F.col("points") - 1)
    sigma = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))) / (F.col("points") - 2))
    row = row.withColumn("expected", expected).withColumn("sigma", sigma)
    row = row.withColumn("p_value", F.when(F.col("sigma") > 1e-12, st.column(st.z_p, F.try_divide(F.col("actual") - F.col("expected"), F.col("sigma")))).otherwise(1.0))
    row = row.withColumn("significance", _capped(1 - F.col("p_value"), F.col("points"))).drop("sxx", "sxy", "syy", "slope", "intercept")
    return row.where(F.abs("z_score") > z)


def change_points(s: DataFrame, keys: list[str] = KEY, least: float = 0.15) -> DataFrame:
    """Where the running sum of deviations from the mean peaks, from six points, two away from the ends, if means differ enough."""
    own = Window.partitionBy(*keys)
    s = s.where("points >= 6").withColumn("_m", F.avg("v").over(own)).withColumn("_sd", F.stddev_samp("v").over(own)).where("_sd > 0")
    s = s.withColumn("_c", F.abs(F.sum(F.col("v") - F.col("_m")).over(own.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))))
    s = s.withColumn("cp", F.max(F.struct(F.round("_c", 9), -F.col("idx"))).over(own)).withColumn("cp", -F.col("cp").getField("col2"))
    s = s.where("cp >= 2 and cp <= points - 3")
    side = lambda c: F.when(F.col("idx") <= F.col("cp"), F.col("v")) if c else F.when(F.col("idx") > F.col("cp"), F.col("v"))
    row = s.groupBy(*keys).agg(
        F.max("points").alias("points"), F.max("impact").alias("impact"), F.max(F.when(F.col("idx") == F.col("cp"), F.col("period"))).alias("period"),
        F.max("_c").alias("cusum"), F.avg(side(True)).alias("before_mean"), F.avg(side(False)).alias("after_mean"),
        F.stddev_samp(side(True)).alias("_s1"), F.stddev_samp(side(False)).alias("_s2"), F.count(side(True)).alias("_n1"), F.count(side(False)).alias("_n2"),
    )
    row = row.withColumn("shift", F.abs(F.col("after_mean") - F.col("before_mean")) / F.greatest(F.abs("before_mean"), F.lit(1e-6))).where(F.col("shift") >= least)
    p = st.column(st.welch_p, F.col("before_mean"), F.col("_s1"), F.col("_n1"), F.col("after_mean"), F.col("_s2"), F.col("_n2"))
    row = row.withColumn("p_value", F.least(F.lit(1.0), p * F.greatest(F.lit(1), F.col("points") - 4)))
    return row.withColumn("significance", _capped(1 - F.col("p_value"), F.col("points"))).drop("_s1", "_s2", "_n1", "_n2")


def rank_changes(s: DataFrame, keys: list[str] = KEY, least: int = 2) -> DataFrame:
    """Mean rank in the first and the last few periods, from six points; a jump of two places or more."""
    s = s.where("transform = 'rank' and points >= 6").withColumn("_w", F.greatest(F.lit(2), F.least(F.lit(4), F.floor(F.col("points") / 3))))
    row = s.groupBy(*keys).agg(
        F.max("points").alias("points"), F.max("impact").alias("impact"), F.max_by("period", "idx").alias("period"),
        F.avg(F.when(F.col("idx") < F.col("_w"), F.col("v"))).alias("first"), F.avg(F.when(F.col("idx") >= F.col("points") - F.col("_w"), F.col("v"))).alias("last"),
        F.greatest(F.lit(2.0), F.round(F.max("v"))).cast("long").alias("siblings"),
    )
    place = lambda c: F.greatest(F.lit(1.0), F.round(c)).cast("long")
    row = row.withColumn("previous_rank", place(F.col("first"))).withColumn("new_rank", place(F.col("last"))).drop("first", "last")
    jump = F.abs(F.col("previous_rank") - F.col("new_rank"))
    share = F.greatest(F.lit(0.0), (F.col("siblings") - jump) / F.col("siblings"))
    row = row.where(jump >= least).withColumn("p_value", F.when(F.col("siblings") < 3, 1.0).otherwise(share * share))
    return row.withColumn("significance", F.when(F.col("siblings") < 3, 0.0).otherwise(_capped(1 - F.col("p_value"), F.col("points"))))


def forecasts(s: DataFrame, keys: list[str] = KEY, least: float = 20.0, p: float = 0.05) -> DataFrame:
    """The last point against a line through the others, with its 95 % prediction interval, from five points."""
    before = lambda c: F.when(F.col("idx") < F.col("points") - 1, c)
    v, x = before(F.col("v")), before(F.col("idx").cast("double"))
    row = s.where("points >= 5").groupBy(*keys).agg(
        F.max("points").alias("points"), F.max("impact").alias("impact"), F.max_by("period", "idx").alias("period"), F.max_by("v", "idx").alias("actual"),
        F.regr_slope(v, x).alias("_b"), F.regr_intercept(v, x).alias("_a"), F.regr_sxx(v, x).alias("_sxx"), F.regr_sxy(v, x).alias("_sxy"),
        F.regr_syy(v, x).alias("_syy"), F.avg(x).alias("_mx"), F.count(v).alias("_n"),
    )
    row = row.withColumn("expected", F.col("_a") + F.col("_b") * (F.col("points") - 1)).where("expected <> 0")
    error = F.sqrt(F.greatest(F.lit(0.0), F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx")) / (F.col("_n") - 2))
    at = F.col("points") - 1 - F.col("_mx")
    row = row.withColumn("_se", error * F.sqrt(1 + 1 / F.col("_n") + at * at / F.col("_sxx"))).where("_se > 0")
    t = st.column(lambda df: st.t_quantile(0.975, df), F.col("_n") - 2)
    row = row.withColumn("low", F.col("expected") - t * F.col("_se")).withColumn("high", F.col("expected") + t * F.col("_se"))
    row = row.withColumn("p_value", st.column(st.t_p, (F.col("actual") - F.col("expected")) / F.col("_se"), F.col("_n") - 2))
    row = row.withColumn("deviation_percent", (F.col("actual") - F.col("expected")) / F.abs("expected") * 100)
    return row.where((F.abs("deviation_percent") > least) & (F.col("p_value") < p)).drop("_b", "_a", "_sxx", "_sxy", "_syy", "_mx", "_n", "_se")


#: Days of the seasons that are tried, and their names.
SEASONS = [(7, "weekly"), (14, "biweekly"), (30, "monthly"), (90, "quarterly"), (365, "yearly")]


def seasonality(rows: DataFrame, keys: list[str], at: str = "ts", v: str = "v") -> DataFrame:
    """The strongest season of each series of (at, v) rows in time order, by correlation with itself some days later.

    Lags are days over the mean positive spacing of rows; at least 14 rows and twice the lag plus
    three; |r| > 0.5 and p < 0.05; the best by |r| / (p + 0.001).
    """
    order = Window.partitionBy(*keys).orderBy(at, v)
    own = Window.partitionBy(*keys)
    seconds = F.col(at).cast("timestamp").cast("double")
    rows = rows.where(F.col(v).isNotNull()).withColumn("_gap", seconds - F.lag(seconds).over(order)).withColumn("_n", F.count(F.lit(1)).over(own))
    rows = rows.withColumn("_days", F.avg(F.when(F.col("_gap") > 0, F.col("_gap"))).over(own) / 86400).withColumn("_i", F.row_number().over(order) - 1).where("_n >= 14 and _days > 0")
    tries = F.explode(F.array(*[F.struct(F.lit(d).alias("period_days"), F.lit(name).alias("season")) for d, name in SEASONS]))
    tried = rows.withColumn("_t", tries).withColumn("_lag", F.round(F.col("_t.period_days") / F.col("_days")).cast("long")).where("_lag > 0 and _n >= 2 * _lag + 3")
    left = tried.select(*keys, "_t", "_lag", "_n", (F.col("_i") + F.col("_lag")).alias("_i"), F.col(v).alias("_x"))
    right = tried.select(*keys, "_t", "_i", F.col(v).alias("_y"))
    pairs = left.join(right, [*keys, "_t", "_i"]).groupBy(*keys, "_t", "_lag", "_n").agg(F.corr("_x", "_y").alias("autocorrelation"))
    pairs = pairs.where("autocorrelation is not null").withColumn("p_value", st.column(st.autocorrelation_p, F.col("autocorrelation"), F.col("_n"), F.col("_lag")))
    pairs = pairs.where((F.abs("autocorrelation") > 0.5) & (F.col("p_value") < 0.05))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("autocorrelation") / (F.col("p_value") + 0.001)), "_t.period_days"))
    return pairs.withColumn("_b", best).where("_b = 1").select(*keys, "_t.period_days", "_t.season", "autocorrelation", "p_value")


def latest_periods(base: DataFrame) -> tuple[str | None, str | None]:
    """The last and the one before last period label."""
    got = [r[0] for r in base.where("period is not null").select("period").distinct().orderBy(F.desc("period")).limit(2).collect()]
    return (got[0] if got else None, got[1] if len(got) > 1 else None)


def running(cells: DataFrame, keys: list[str], at: str, sums: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds to rows of one place `at` each, for each sum s, `s_upto` (up to and with the row, by `at`) and `s_all`, by key.

    A key may hold most rows: they are cut at approximate quantiles into buckets, which are summed
    one by one; only keys x buckets rows meet in one place. Keys should be few, such as columns.
    Cells are computed more than once and must be the same each time, `at` to the last digit.
    """
    shares = [i / buckets for i in range(1, buckets)]
    cuts = cells.groupBy(*keys).agg(F.percentile_approx(at, shares, 10 * buckets).alias("_cuts"))
    cuts = cells.sparkSession.createDataFrame(cuts.collect(), cuts.schema)  # keys x buckets numbers, the same for both uses below
    nth = F.size(F.filter("_cuts", lambda c: c < F.col(at)))
    placed = cells.join(F.broadcast(cuts), keys).withColumn("_bucket", nth).drop("_cuts")
    each, whole = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    totals = placed.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    totals = totals.select(*keys, "_bucket", *[x for c in sums for x in (F.coalesce(F.sum(f"_{c}").over(each), F.lit(0)).alias(f"_{c}"), F.sum(f"_{c}").over(whole).alias(f"{c}_all"))])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({f"{c}_upto": F.sum(c).over(inside) for c in sums}).join(F.broadcast(totals), [*keys, "_bucket"])
    return out.withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"_{c}") for c in sums}).drop("_bucket", *[f"_{c}" for c in sums])


def distribution_shift(base: DataFrame, measures: list[str], current: str, previous: str, least: float = 0.2) -> DataFrame:
    """Kolmogorov-Smirnov distance between a measure's values of two periods, five values each at least."""
    parts = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"`{m}`").alias("v")) for m in measures])
    rows = base.where(F.col("period").isin(current, previous)).withColumn("_m", F.explode(parts)).select("period", "_m.measure", "_m.v").where("v is not null")
    cells = rows.groupBy("measure", "v").agg(F.count(F.when(F.col("period") == previous, 1)).alias("a"), F.count(F.when(F.col("period") == current, 1)).alias("b"))
    gap = F.abs(F.try_divide("a_upto", "a_all") - F.try_divide("b_upto", "b_all"))
    row = running(cells, ["measure"], "v", ["a", "b"]).withColumn("_g", gap).groupBy("measure").agg(F.max("_g").alias("ks_statistic"), F.sum("a").alias("previous_n"), F.sum("b").alias("current_n"))
    row = row.where((F.col("previous_n") >= 5) & (F.col("current_n") >= 5) & (F.col("ks_statistic") >= least))
    return row.withColumn("p_value", st.column(st.kolmogorov_p, F.col("ks_statistic"), F.col("previous_n"), F.col("current_n")))


def histogram(base: DataFrame, measure: str, bins: int = 20) -> DataFrame:
    """Rows (period, bin, n) in equal bins between the measure's bounds."""
    low, high = base.agg(F.min(measure), F.max(measure)).first()
    if low is None:
        return base.select("period", F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    place = F.least(F.lit(bins - 1), F.floor((F.col(measure) - low) / ((high - low) or 1.0) * bins)).cast("int")
    return base.where(F.col(measure).isNotNull()).groupBy("period", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def concentration(base: DataFrame, dims: list[str], measures: list[str], hhi: float = 0.25, top: float = 60.0) -> DataFrame:
    """HHI, share of the top three and Gini of a measure's positive values over a dimension's segments, if concentrated."""
    parts = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(f"`{d}`"), F.lit("")).alias("value"), F.lit(m).alias("measure"), F.col(f"`{m}`").alias("v")) for d in dims for m in measures])
    rows = base.withColumn("_p", F.explode(parts)).select("_p.*").where("v > 0")
    sums = rows.groupBy("dimension", "measure", "value").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    # Segments of one sum are one row; where m of them follow an area below, they add m steps to the Lorenz curve.
    sizes = sums.groupBy("dimension", "measure", "s").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")).withColumn("t", F.col("m") * F.col("s"))
    # A sum of doubles may end in other digits when it is computed again, and so miss its bucket: the sums are written once.
    sizes = running(stored(sizes, "sizes"), ["dimension", "measure"], "s", ["m", "t"])
    share, below = F.col("s") / F.col("t_all"), (F.col("t_upto") - F.col("t")) / F.col("t_all")
    leading = F.greatest(F.lit(0), F.least(F.col("m"), 3 - (F.col("m_all") - F.col("m_upto"))))
    row = sizes.groupBy("dimension", "measure").agg(
        F.sum(F.col("m") * share * share).alias("hhi"), (F.sum(leading * share) * 100).alias("top_share"),
        F.sum("m").alias("segments"), F.sum("n").alias("rows"), F.sum(2 * F.col("m") * below + F.col("m") * F.col("m") * share).alias("_area"),
    )
    row = row.withColumn("gini", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_area") / F.col("segments")))).drop("_area")
    row = row.where((F.col("hhi") >= hhi) | (F.col("top_share") >= top))
    return row.withColumn("p_value", st.column(st.concentration_p, F.col("hhi"), F.col("segments"), F.col("rows")))


def dominance(cubed: DataFrame, measures: list[str]) -> DataFrame:
    """The leader's share among a dimension's top values against a power law through the others, from four values."""
    kinds = [F.struct(F.lit("rows").alias("measure"), F.col("n").cast("double").alias("v"))] + [F.struct(F.lit(m).alias("measure"), F.col(f"`{m}|sum`").alias("v")) for m in measures]
    rows = cubed.where("dimension <> ''").withColumn("_k", F.explode(F.array(*kinds))).groupBy("dimension", "value", "_k.measure").agg(F.greatest(F.lit(0.0), F.sum("_k.v")).alias("v"))
    whole = Window.partitionBy("dimension", "measure")
    rows = rows.withColumn("share", F.try_divide(F.col("v"), F.sum("v").over(whole))).withColumn("place", F.row_number().over(whole.orderBy(F.desc("v"), "value")))
    tail = lambda c: F.when(F.col("place") >= 2, c)
    y, x = tail(F.ln(F.greatest(F.col("share"), F.lit(1e-12)))), tail(F.ln(F.col("place").cast("double")))
    row = rows.groupBy("dimension", "measure").agg(
        F.count(F.lit(1)).alias("values"), F.min_by("value", "place").alias("value"), F.max("share").alias("share"),
        F.regr_intercept(y, x).alias("_a"), F.regr_sxx(y, x).alias("_sxx"), F.regr_sxy(y, x).alias("_sxy"), F.regr_syy(y, x).alias("_syy"),
    )
    row = row.where("values >= 4 and share is not null").withColumn("expected_share", F.exp("_a"))
    sigma = F.greatest(F.lit(1e-6), F.sqrt(F.greatest(F.lit(0.0), F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx")) / (F.col("values") - 2)))
    row = row.withColumn("p_value", st.column(lambda z: 1 - st.normal_cdf(z), (F.ln(F.greatest(F.col("share"), F.lit(1e-12))) - F.col("_a")) / sigma))
    return row.withColumn("significance", _capped(1 - F.col("p_value"), F.col("values"))).drop("_a", "_sxx", "_sxy", "_syy")


def membership(base: DataFrame, dims: list[str], current: str, previous: str, listed: int = LISTED) -> DataFrame:
    """Values of a dimension that came and went between two periods, blank ones left out: all are counted, the first of each kind listed."""
    here = _slices(base.where(F.col("period").isin(current, previous)), dims).groupBy("dimension", "value").agg(
        F.max(F.col("period") == current).alias("now"), F.max(F.col("period") == previous).alias("then")
    )
    row = here.groupBy("dimension").agg(
        F.count(F.when(F.col("now") & ~F.col("then"), 1)).alias("added"), F.count(F.when(~F.col("now") & F.col("then"), 1)).alias("removed"),
        F.count(F.when(F.col("then"), 1)).alias("previous_size"), F.count(F.when(F.col("now"), 1)).alias("current_size"),
    )
    place = F.row_number().over(Window.partitionBy("dimension", "now").orderBy("value"))  # Spark keeps the first ones of each task before it shuffles
    first = here.where("now <> then").withColumn("_r", place).where(F.col("_r") <= listed)
    first = first.groupBy("dimension").agg(*[F.array_sort(F.collect_list(F.when(c, F.col("value")))).alias(f"{name}_values") for name, c in (("added", F.col("now")), ("removed", F.col("then")))])
    row = row.join(first, "dimension")
    row = row.where("previous_size > 0 and current_size > 0 and added + removed > 0")
    return row.withColumn("p_value", st.column(st.churn_p, F.col("added"), F.col("removed"), F.col("previous_size")))


def outlier_clusters(base: DataFrame, measures: list[str], z: float = 2.0) -> DataFrame:
    """Periods in which two or more measures' means lie beyond z deviations on the same side."""
    parts = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"`{m}`").alias("v")) for m in measures])
    rows = base.where("period is not null").withColumn("_m", F.explode(parts)).select("period", "_m.measure", "_m.v")
    means = rows.groupBy("measure", "period").agg(F.avg("v").alias("m")).where("m is not null")
    own = Window.partitionBy("measure")
    scored = means.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_sd", F.stddev_samp("m").over(own)).withColumn("z", F.try_divide(F.col("m") - F.avg("m").over(own), F.col("_sd")))
    periods = means.agg(F.count_distinct("period")).first()[0]
    out = scored.where((F.col("_n") >= 3) & (F.abs("z") > z)).groupBy("period", F.when(F.col("z") > 0, "spike").otherwise("dip").alias("direction")).agg(
        F.array_sort(F.collect_set("measure")).alias("columns"), F.count(F.lit(1)).alias("cluster_size")
    )
    return out.where("cluster_size >= 2").withColumn("p_value", st.column(lambda k: st.cluster_p(int(k), len(measures), periods), F.col("cluster_size")))


def common_segment(base: DataFrame, dims: list[str], period: str) -> DataFrame:
    """The value of a dimension that more than half of a period's rows share, if one does."""
    counts = _slices(base.where(F.col("period") == period), dims).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    total = base.where(F.col("period") == period).count()
    return counts.where(F.col("n") > total / 2).orderBy(F.desc("n"), "dimension")


def period_comparison(base: DataFrame, measures: list[str], current: str, previous: str) -> DataFrame:
    """Means of two periods with Welch's test; kept if p < 0.05 and the change is over 10 %, or it is over 50 %."""
    parts = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"`{m}`").alias("v")) for m in measures])
    rows = base.where(F.col("period").isin(current, previous)).withColumn("_m", F.explode(parts)).select("period", "_m.measure", "_m.v")
    now, then = F.when(F.col("period") == current, F.col("v")), F.when(F.col("period") == previous, F.col("v"))
    row = rows.groupBy("measure").agg(
        F.avg(now).alias("current_mean"), F.coalesce(F.stddev_samp(now), F.lit(0.0)).alias("_s1"), F.count(now).alias("current_n"),
        F.avg(then).alias("previous_mean"), F.coalesce(F.stddev_samp(then), F.lit(0.0)).alias("_s2"), F.count(then).alias("previous_n"),
    ).where("current_n > 0 and previous_n > 0")
    row = row.withColumn("change_percent", F.coalesce(F.try_divide(F.col("current_mean") - F.col("previous_mean"), F.abs("previous_mean")) * 100, F.lit(0.0)))
    p = st.column(st.welch_p, F.col("current_mean"), F.col("_s1"), F.col("current_n"), F.col("previous_mean"), F.col("_s2"), F.col("previous_n"))
    row = row.withColumn("p_value", p).withColumn("significance", _capped(1 - F.col("p_value"), F.least("current_n", "previous_n"))).drop("_s1", "_s2")
    return row.where(((F.col("p_value") < 0.05) & (F.abs("change_percent") > 10)) | (F.abs("change_percent") > 50))


def segment_attribution(base: DataFrame, dims: list[str], measures: list[str]) -> DataFrame:
    """For each dimension and measure the segment whose mean moves the whole most, against all other rows."""
    parts = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(f"`{d}`"), F.lit("")).alias("value"), F.lit(m).alias("measure"), F.col(f"`{m}`").alias("v")) for d in dims for m in measures])
    rows = base.withColumn("_p", F.explode(parts)).select("_p.*").where("v is not null")
    own = rows.groupBy("dimension", "measure", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    totals = own.groupBy("dimension", "measure").agg(*[F.sum(c).alias(f"all_{c}") for c in "nsq"])  # a row for each pair of columns
    own = own.join(F.broadcast(totals), ["dimension", "measure"])
    own = own.where("n >= 2 and all_n - n >= 2 and all_n >= 3")
    mean, other_n = F.col("s") / F.col("n"), F.col("all_n") - F.col("n")
    other = (F.col("all_s") - F.col("s")) / other_n
    spread = lambda n, m, q: F.sqrt(F.greatest(F.lit(0.0), (q - n * m * m) / (n - 1)))
    own = own.withColumns({
        "segment_mean": mean, "other_mean": other, "contribution": (mean - F.col("all_s") / F.col("all_n")) * F.col("n") / F.col("all_n"),
        "change_percent": F.coalesce(F.try_divide(mean - other, other) * 100, F.lit(0.0)),
        "p_value": st.column(st.welch_p, mean, spread(F.col("n"), mean, F.col("q")), F.col("n"), other, spread(other_n, other, F.col("all_q") - F.col("q")), other_n),
    })
    best = F.min(F.struct((-F.abs(F.round("contribution", 9))).alias("_c"), *["value", "n", "segment_mean", "other_mean", "contribution", "change_percent", "p_value"]))
    return own.groupBy("dimension", "measure").agg(best.alias("_b")).select("dimension", "measure", "_b.*").select("dimension", "measure", F.when(F.col("value") == "", "(blank)").otherwise(F.col("value")).alias("value"), "n", "segment_mean", "other_mean", "contribution", "change_percent", "p_value")


def period_segments(base: DataFrame, dims: list[str], measures: list[str], period: str) -> DataFrame:
    """How far each segment makes a period's mean differ from the other periods': change, contribution and share of the whole."""
    parts = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(f"`{d}`"), F.lit("")).alias("value"), F.lit(m).alias("measure"), F.col(f"`{m}`").alias("v")) for d in dims for m in measures])
    rows = base.where("period is not null").withColumn("_here", F.col("period") == period).withColumn("_p", F.explode(parts)).select("_here", "_p.*").where("v is not null")
    here, there = F.when(F.col("_here"), F.col("v")), F.when(~F.col("_here"), F.col("v"))
    seg = rows.groupBy("dimension", "measure", "value").agg(F.count(here).alias("n"), F.sum(here).alias("_a"), F.count(there).alias("_m"), F.sum(there).alias("_b"))
    total = (F.try_divide(F.sum("_a"), F.sum("n")) - F.try_divide(F.sum("_b"), F.sum("_m"))) * F.sum("n")
    seg = seg.join(F.broadcast(seg.groupBy("dimension", "measure").agg(total.alias("_total"))), ["dimension", "measure"])  # a row for each pair of columns
    seg = seg.where((F.col("n") > 0) & (F.col("_m") > 0) & (F.abs("_total") >= 0.0001))
    now, then = F.col("_a") / F.col("n"), F.col("_b") / F.col("_m")
    return seg.select(
        "dimension", "measure", F.when(F.col("value") == "", "(blank)").otherwise(F.col("value")).alias("value"), "n",
        F.coalesce(F.try_divide(now - then, F.abs(then)) * 100, F.lit(0.0)).alias("change_percent"), ((now - then) * F.col("n")).alias("contribution"),
        ((now - then) * F.col("n") / F.col("_total") * 100).alias("contribution_pct"),
    )


def correlations(base: DataFrame, measures: list[str], least: float = 0.5, p: float = 0.05) -> DataFrame:
    """Pairs of measures that go together, over rows that have both."""
    pairs = [(a, b) for i, a in enumerate(measures) for b in measures[i + 1 :]]
    parts = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for a, b in pairs])
    rows = base.withColumn("_p", F.explode(parts)).select("_p.*").where("x is not null and y is not null")
    row = rows.groupBy("column_a", "column_b").agg(F.corr("x", "y").alias("r_value"), F.count(F.lit(1)).alias("n")).where("n >= 3 and r_value is not null")
    row = row.withColumn("p_value", st.column(st.correlation_p, F.col("r_value"), F.col("n")))
    return row.where((F.col("p_value") < p) & (F.abs("r_value") > least))


def drivers(cubed: DataFrame, measure: str, current: str, previous: str, per_dim: int = 3, most: int = 8) -> DataFrame:
    """What a measure's change between two periods is made of, slice by slice: change, contribution, Bonferroni-corrected Welch test.

    Moves offset each other where the net change is under a quarter of the gross one; contributions
    are then shares of the gross one. Three slices of a dimension and eight in all are kept.
    """
    now, then = F.col("period") == current, F.col("period") == previous
    pick = lambda c, k: F.coalesce(F.sum(F.when(c, F.col(f"`{measure}|{k}`"))), F.lit(0))
    row = cubed.where(now | then).groupBy("dimension", "value").agg(*[pick(c, k).alias(f"{side}_{k}") for side, c in (("curr", now), ("prev", then)) for k in ("sum", "sq", "n")])
    row = row.withColumn("delta", F.col("curr_sum") - F.col("prev_sum"))
    total = row.where("dimension = ''").select(F.col("delta").alias("delta_total"))
    parts = row.where("dimension <> ''")
    gross = parts.agg(F.sum(F.abs("delta")).alias("gross"), F.greatest(F.lit(1), F.count(F.when(F.abs("delta") > 0, 1))).alias("tested"))
    parts = parts.where(F.abs("delta") > 0).join(F.broadcast(total), F.lit(True)).join(F.broadcast(gross), F.lit(True))  # one row each
    parts = parts.withColumn("offsetting", (F.col("gross") > 0) & (F.abs("delta_total") < 0.25 * F.col("gross")))
    base = F.when(F.col("offsetting"), F.col("gross")).otherwise(F.greatest(F.abs("delta_total"), F.lit(1e-12)))
    mean = lambda s: F.try_divide(F.col(f"{s}_sum"), F.col(f"{s}_n"))
    spread = lambda s: F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col(f"{s}_sq") - F.col(f"{s}_n") * mean(s) * mean(s), F.col(f"{s}_n") - 1)))
    p = F.coalesce(st.column(st.welch_p, mean("curr"), spread("curr"), F.col("curr_n"), mean("prev"), spread("prev"), F.col("prev_n")), F.lit(1.0))
    parts = parts.withColumns({
        "contribution_pct": F.col("delta") / base * 100, "change_percent": F.when(F.abs("prev_sum") > 1e-12, F.try_divide(F.col("delta"), F.abs("prev_sum")) * 100).otherwise(0.0),
        "p_value": F.least(F.lit(1.0), p * F.col("tested")),
    })
    parts = parts.withColumn("significance", _capped(1 - F.col("p_value"), F.least("curr_n", "prev_n")))
    order = [F.desc(F.abs(F.round("delta", 6))), "dimension", "value"]
    parts = parts.withColumn("_d", F.row_number().over(Window.partitionBy("dimension").orderBy(*order))).where(F.col("_d") <= per_dim)
    parts = parts.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).where(F.col("place") <= most)
    return parts.select("dimension", "value", F.col("prev_sum").alias("prev_value"), F.col("curr_sum").alias("curr_value"), "delta", "contribution_pct", "change_percent", "p_value", "significance", "offsetting", "delta_total", "gross", "place")


def period_stats(base: DataFrame, measure: str) -> DataFrame:
    """Count, sum, mean and sample deviation (0 for one row) by period."""
    c = F.col(f"`{measure}`")
    rows = base.where("period is not null").where(c.isNotNull())
    return rows.groupBy("period").agg(F.count(c).alias("count"), F.sum(c).alias("sum"), F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"))


def detect_schema(df: DataFrame) -> dict[str, str]:
    """A role for each column: time, measure, dimension or other.

    Dates are times; numbers are measures unless they have fewer than 20 values that make up less
    than 5 % of rows; text is a dimension, or a time where its name is date, timestamp or time.
    """
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    made = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(numbers)]).first()
    roles = {}
    for f in df.schema:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            roles[f.name] = "time"
        elif f.name in numbers:
            n = made[f"d{numbers.index(f.name)}"]
            roles[f.name] = "dimension" if n < 20 and made["rows"] and n / made["rows"] < 0.05 else "measure"
        elif isinstance(f.dataType, T.StringType):
            roles[f.name] = "time" if f.name.lower() in ("date", "timestamp", "time") else "dimension"
        else:
            roles[f.name] = "other"
    if "time" not in roles.values():
        for c in df.columns:
            if "date" in c.lower() or "time" in c.lower():
                roles[c] = "time"
                break
    return roles


def profile(df: DataFrame, samples: int = 5, most: int = 60, order: str | None = None, head: int = 1000) -> DataFrame:
    """Rows (column, type, distinct, null_share, min, max, samples) of the first columns; one pass.

    Samples are the first distinct values, as text, of the first `head` rows, by an order if one is named.
    """
    made, first = [], []
    for f in df.schema.fields[:most]:
        c = F.col(f"`{f.name}`")
        bounded = isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
        low, high = (F.min(c).cast("string"), F.max(c).cast("string")) if bounded else (F.lit(None).cast("string"),) * 2
        flat = c if isinstance(f.dataType, T.AtomicType) else F.to_json(F.struct(c))
        made.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count_distinct(flat).alias("distinct"),
            F.coalesce(F.try_divide(F.count(F.when(c.isNull(), 1)), F.count(F.lit(1))), F.lit(0.0)).alias("null_share"), low.alias("min"), high.alias("max"),
        ))
        first.append(F.struct(F.lit(f.name).alias("column"), F.slice(F.array_distinct(F.collect_list(flat.cast("string"))), 1, samples).alias("samples")))
    top = (df.orderBy(order) if order else df).limit(head).coalesce(1).agg(F.array(*first).alias("p")).select(F.inline("p"))
    return df.agg(F.array(*made).alias("p")).select(F.inline("p")).join(F.broadcast(top), "column")  # a row for each column


def evenly(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at even places in the order of a number, date or time, best a distinct one; all rows where there are no more.

    Which of several rows of one value are taken goes by their hash, and those rows meet in one task.
    """
    keys = df.groupBy(F.lit("").alias("_k"), F.col(f"`{order}`").alias("_at")).agg(F.count(F.lit(1)).alias("m"))
    total = df.count()
    if total <= n:
        return df
    last = F.col("m_upto")  # places of a value's rows: from last - m to last - 1; place i is taken where i * n / total passes a whole number
    taken = F.floor((last * n - 1) / total) - F.floor(((last - F.col("m")) * n - 1) / total)
    picked = running(keys, ["_k"], "_at", ["m"]).select("_at", taken.alias("_taken")).where("_taken > 0")
    rows = df.join(picked, F.col(f"`{order}`") == F.col("_at"))
    nth = F.row_number().over(Window.partitionBy("_at").orderBy(*[F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]))
    return rows.withColumn("_n", nth).where("_n <= _taken").drop("_at", "_taken", "_n")


def shuffled_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows that a seed picks by the hash of a key, the same on every run; a top n by task, then one of all."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))), F.col(f"`{key}`")).limit(n)
