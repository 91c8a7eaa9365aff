"""Findings scored, told apart and ranked: the trends, review and drivers reports.

Detectors run on the cluster over aggregated series; their findings, a bounded number of rows, are
gathered, and what is sequential (dedup, novelty, diverse selection) runs on those.
"""

from __future__ import annotations

import html
import json
import math
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.statistics import column, correlation_p
from tidewater.operators import insights as I
from tidewater.session import importable

#: Findings that are gathered from one detector, most significant first.
GATHERED = 2000
MIN_SIGNIFICANCE, DEPTH1_SIGNIFICANCE, MIN_EFFECT = 0.5, 0.8, 0.1
KPI, BAD_NEWS = 1.5, 1.25
CHILD_OVER_PARENT = 1.2
SAME_MEASURE, SAME_KIND, SAME_DIMENSION = 0.6, 0.8, 0.8
RECOVERY_DAYS = 14.0
HIGHER, LOWER, NEUTRAL = "HigherIsBetter", "LowerIsBetter", "Neutral"


@dataclass
class Finding:
    kind: str
    measure: str
    details: dict[str, Any]
    p_value: float = 1.0
    significance: float = 0.0
    impact: float = 0.0
    novelty: float = 1.0
    dimension: str | None = None
    value: str | None = None
    period: str | None = None
    transform: str = "id"
    agg: str = ""
    kpi_boost: float = 1.0
    polarity_boost: float = 1.0
    sentiment: str | None = None
    rank: int | None = None
    children: list[Finding] = field(default_factory=list)

    @property
    def score(self) -> float:
        return self.significance * math.sqrt(max(0.0, self.impact)) * (0.5 + 0.5 * min(1.0, max(0.0, self.novelty))) * self.kpi_boost * self.polarity_boost

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.kind, self.measure, self.agg, self.transform, self.dimension or "", self.value or "")


def fingerprint(*parts: str) -> str:
    """FNV-1a, 64 bits, over the parts with bars between."""
    h = 0xCBF29CE484222325
    for b in "|".join(parts).encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return f"{h:016x}"


def _unit(x: float) -> float:
    return min(1.0, max(0.0, x)) if math.isfinite(x) else 0.0


def effect(f: Finding) -> float:
    """The size of a finding, by its kind, from 0 to 1."""
    d = f.details
    match f.kind:
        case "anomaly":
            return _unit(abs(d["z_score"]) / 5)
        case "segment":
            return _unit(max(abs(d.get("contribution_pct") or 0.0) / 100, abs(d["change_percent"]) / 200))
        case "correlation":
            return _unit(abs(d["r_value"]))
        case "trend":
            return _unit(0.7 * d["r_squared"] + 0.3 * math.tanh(10 * abs(d["slope"])))
        case "period_comparison":
            return _unit(abs(d["change_percent"]) / 100)
        case "seasonality":
            return _unit(abs(d["autocorrelation"]))
        case "forecast_deviation":
            return _unit(abs(d["deviation_percent"]) / 100)
        case "outlier_cluster":
            return _unit(d["cluster_size"] / max(1, d["columns_tested"]))
        case "concentration":
            return _unit(max(d["hhi"], d["top_share"] / 100))
        case "distribution_shift":
            return _unit(d["ks_statistic"])
        case "membership_change":
            return _unit((d["added"] + d["removed"]) / max(1, d["previous_size"] + d["added"]))
        case "change_point":
            return _unit(abs(d["after_mean"] - d["before_mean"]) / max(abs(d["before_mean"]), 1e-6))
        case "rank_change":
            return _unit(abs(d["previous_rank"] - d["new_rank"]) / max(1, d["siblings"]))
        case "top_dominance":
            return _unit(d["share"])
        case "driver":
            return _unit(abs(d["contribution_pct"]) / 100)
    return 0.0


def rises(f: Finding) -> bool | None:
    """Whether the finding is of something going up; None where it has no direction."""
    d = f.details
    match f.kind:
        case "anomaly":
            return d["z_score"] > 0
        case "period_comparison" | "segment":
            return d["change_percent"] > 0
        case "trend":
            return d["slope"] > 0
        case "forecast_deviation":
            return d["deviation_percent"] > 0
        case "outlier_cluster":
            return d["direction"] == "spike"
        case "change_point":
            return d["after_mean"] > d["before_mean"]
        case "rank_change":
            return d["new_rank"] < d["previous_rank"]
        case "driver":
            return d["delta"] > 0
    return None


def judged(findings: Iterable[Finding], polarity: dict[str, str] | None = None, kpis: Iterable[str] = ()) -> list[Finding]:
    """Adds sentiment, the boost of bad news and the boost of key measures."""
    kpis, out = set(kpis), list(findings)
    for f in out:
        cols = f.details.get("columns") if f.kind == "outlier_cluster" else [f.measure]
        f.kpi_boost = KPI if f.kind != "membership_change" and kpis & set(cols or []) else 1.0
        want, up = (polarity or {}).get(f.measure), rises(f)
        if want in (HIGHER, LOWER) and up is not None:
            good = up == (want == HIGHER)
            f.sentiment, f.polarity_boost = ("good", 1.0) if good else ("bad", BAD_NEWS)
    return out


def story(f: Finding) -> str | None:
    if f.kind in ("correlation", "outlier_cluster", "membership_change"):
        return None
    if f.kind in ("rank_change", "top_dominance"):
        return f"{f.kind}:{f.dimension}={f.value}"
    return f.measure


def deduped(roots: list[Finding]) -> list[Finding]:
    """Children that don't clearly beat their parent go; roots of one story hang under the best of them."""
    for f in roots:
        f.children = [c for c in f.children if f.score <= 0 or c.score >= f.score * CHILD_OVER_PARENT]
    best: dict[str, Finding] = {}
    out = []
    for f in sorted(roots, key=lambda f: (-f.score, f.fingerprint)):
        key = story(f)
        if key is None or key not in best:
            out.append(f)
            if key is not None:
                best[key] = f
        else:
            best[key].children.append(f)
    return out


def novelty(shown: int, days: float) -> float:
    """How new a finding still is after it was shown so often, so many days ago."""
    return _unit(1 - (1 - 0.5**shown) * math.exp(-max(0.0, days) / RECOVERY_DAYS))


def signature(f: Finding) -> str:
    """Direction and tenth of the score: while it stays, a shown finding counts as known."""
    up = rises(f)
    return ("=" if up is None else "+" if up else "-") + str(int(_unit(f.score) * 10))


def with_novelty(findings: list[Finding], history: dict[str, tuple[int, float, str]], now: float) -> list[Finding]:
    """history: fingerprint -> (times shown, time last shown in seconds, signature)."""
    for f in findings:
        seen = history.get(f.fingerprint)
        if seen and seen[2] == signature(f):
            f.novelty = novelty(seen[0], (now - seen[1]) / 86400)
    return findings


def selected(findings: list[Finding], most: int) -> list[Finding]:
    """Greedy choice: every finding chosen lowers those with its measure, kind or dimension."""
    left, out = list(findings), []
    worth = {id(f): f.score for f in left}
    while left and len(out) < most:
        top = max(left, key=lambda f: worth[id(f)])
        left.remove(top)
        out.append(top)
        top.rank = len(out)
        for f in left:
            worth[id(f)] *= (SAME_MEASURE if f.measure == top.measure else 1.0) * (SAME_KIND if f.kind == top.kind else 1.0)
            worth[id(f)] *= SAME_DIMENSION if f.dimension and f.dimension == top.dimension else 1.0
    return out


def curated(findings: list[Finding], dismissed: set[str] = frozenset(), pinned: set[str] = frozenset()) -> list[Finding]:
    """Without the dismissed ones, the pinned ones first."""
    kept = [f for f in findings if f.fingerprint not in dismissed]
    return sorted(kept, key=lambda f: f.fingerprint not in pinned)


_OWN = ("dimension", "value", "measure", "agg", "transform", "period", "impact", "p_value", "significance", "points")


def _gathered(df: DataFrame, kind: str, measure: str | None = None, impact: float | None = None) -> list[Finding]:
    """A detector's rows as findings; where a detector has no impact of its own the effect stands in."""
    order = F.desc("significance") if "significance" in df.columns else F.asc("p_value")
    out = []
    for r in df.orderBy(order).limit(GATHERED).collect():
        d = r.asDict(recursive=True)
        f = Finding(
            kind, measure or d.get("measure") or "", {k: v for k, v in d.items() if k not in _OWN}, d.get("p_value") if d.get("p_value") is not None else 1.0,
            d.get("significance") if d.get("significance") is not None else 1 - (d.get("p_value") or 0.0), 0.0,
            dimension=d.get("dimension") or None, value=d.get("value") or None, period=d.get("period"), transform=d.get("transform") or "id", agg=d.get("agg") or "",
        )
        f.impact = d["impact"] if d.get("impact") is not None else impact if impact is not None else effect(f)
        out.append(f)
    return out


def _kept(findings: Iterable[Finding], least: float) -> list[Finding]:
    return [f for f in findings if f.impact >= least and f.significance >= MIN_SIGNIFICANCE]


def _ranked(findings: list[Finding], polarity, kpis, history, now, most) -> list[Finding]:
    return selected(with_novelty(deduped(judged(findings, polarity, kpis)), history or {}, now), most)


def trends(
    df: DataFrame, time: str, dims: list[str], measures: list[str], granularity: str = "day", least: float = MIN_EFFECT, most: int = 50,
    polarity: dict[str, str] | None = None, kpis: Iterable[str] = (), history: dict | None = None, now: float = 0.0,
) -> list[Finding]:
    """All detectors over derived series and periods, ranked."""
    importable(df.sparkSession)
    base = I.prepared(df, time, dims, measures, granularity).cache()
    try:
        cubed = I.cube(base, dims, measures).cache()
        if cubed.where("dimension = ''").count() < 3:
            return []
        s = I.indexed(I.derived(I.series(cubed, measures))).cache()
        plain = s.where("transform <> 'rank'")
        found = _gathered(I.trends(plain), "trend") + _gathered(I.last_points(plain), "anomaly") + _gathered(I.change_points(plain), "change_point")
        found += _gathered(I.rank_changes(s), "rank_change")
        found = [f for f in found if f.significance >= (DEPTH1_SIGNIFICANCE if f.dimension else MIN_SIGNIFICANCE)]
        found += [f for f in _gathered(I.dominance(cubed, measures), "top_dominance") if f.significance >= DEPTH1_SIGNIFICANCE] if dims else []
        whole = s.where("dimension = '' and transform = 'id' and agg <> 'sum'")
        found += _kept(_gathered(I.forecasts(whole).drop("impact"), "forecast_deviation"), least)
        stamps = df.select(F.col(time).alias("t"), *measures)
        long = stamps.select(I.any_day(F.col("t"), df.schema[time].dataType).alias("ts"), F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])).alias("m"))
        daily = long.select("ts", "m.*").groupBy("measure", "ts").agg(F.avg("v").alias("v"))
        found += _kept(_gathered(I.seasonality(daily, ["measure"]), "seasonality"), least)
        current, previous = I.latest_periods(base)
        found += _kept(_gathered(I.distribution_shift(base, measures, current, previous), "distribution_shift"), least)
        if dims:
            found += _kept(_gathered(I.concentration(base, dims, measures), "concentration"), least)
            found += _kept(_gathered(I.membership(base, dims, current, previous), "membership_change", "membership"), least)
        clusters = _gathered(I.outlier_clusters(base, measures).withColumn("columns_tested", F.lit(len(measures))), "outlier_cluster", "cluster")
        found += _kept(clusters, least)
        return _ranked(found, polarity, kpis, history, now, most)
    finally:
        base.unpersist()


def review(
    df: DataFrame, time: str | None, dims: list[str], measures: list[str], cadence: str = "week", least: float = MIN_EFFECT, most: int = 50,
    polarity: dict[str, str] | None = None, kpis: Iterable[str] = (), history: dict | None = None, now: float = 0.0,
) -> list[Finding]:
    """The latest period against the one before and against history, with the segments behind each change; without time, segments and correlations."""
    importable(df.sparkSession)
    base = I.prepared(df, time, dims, measures, cadence)
    if time is None:
        found = _gathered(I.segment_attribution(base, dims, measures), "segment") if dims else []
        links = _gathered(I.correlations(base, measures).withColumn("measure", F.col("column_a")), "correlation") if len(measures) > 1 else []
        for f in found:
            f.children = [c for c in links if f.measure in (c.details["column_a"], c.details["column_b"])]
        return _ranked(_kept(found, least), polarity, kpis, history, now, most)
    current, previous = I.latest_periods(base)
    if previous is None:
        return []
    found = _gathered(I.period_comparison(base, measures, current, previous).withColumn("period", F.lit(current)), "period_comparison")
    s = I.indexed(I.series(I.cube(base, [], measures), measures).withColumn("transform", F.lit("id")))
    found += _gathered(I.last_points(s.where("agg <> 'sum'")).drop("impact"), "anomaly")
    found = _kept(found, least)
    if dims and found:
        parts = _gathered(I.period_segments(base, dims, measures, current).withColumn("p_value", F.lit(0.0)), "segment")
        for f in found:
            own = [p for p in parts if p.measure == f.measure]
            f.children = sorted(own, key=lambda p: -abs(p.details["contribution_pct"] or 0.0))[:1]
    return _ranked(found, polarity, kpis, history, now, most)


def drivers(
    df: DataFrame, time: str | None, dims: list[str], measures: list[str], granularity: str = "week", kpis: list[str] | None = None, most: int = 50,
    polarity: dict[str, str] | None = None, history: dict | None = None, now: float = 0.0,
) -> list[Finding]:
    """What the change of each key measure between the latest periods is made of, then dominance and concentration; without time, the latter."""
    importable(df.sparkSession)
    base = I.prepared(df, time, dims, measures, granularity)
    found: list[Finding] = []
    shown = base if time else base.withColumn("period", F.lit("all"))
    cubed = I.cube(shown, dims, measures).cache()
    current, previous = I.latest_periods(base)
    if previous is not None:
        for m in kpis or measures:
            parts = _gathered(I.drivers(cubed, m, current, previous).orderBy("place"), "driver", m)
            parts.sort(key=lambda f: f.details["place"])
            if parts and max(p.significance for p in parts) >= MIN_SIGNIFICANCE:
                top = max(parts, key=lambda p: abs(p.details["delta"]))
                root = Finding("driver", m, {**top.details, "top_dimension": top.dimension, "top_value": top.value}, top.p_value, top.significance, min(1.0, abs(top.details["contribution_pct"]) / 100), dimension=top.dimension, value=top.value, period=current, agg="sum")
                root.children = [p for p in parts if p is not top]
                found.append(root)
    found += [f for f in _gathered(I.dominance(cubed, measures), "top_dominance") if f.significance >= DEPTH1_SIGNIFICANCE]
    found += _kept(_gathered(I.concentration(base, dims, measures), "concentration"), MIN_EFFECT)
    out = judged(found, polarity, kpis or ())
    return selected(with_novelty(sorted(out, key=lambda f: -f.score), history or {}, now), most)


def correlation_matrix(base: DataFrame, measures: list[str]) -> DataFrame:
    pairs = I.correlations(base, measures, -1.0, 2.0)
    return pairs.withColumn("p_value", column(correlation_p, F.col("r_value"), F.col("n")))


def stride(values: list, most: int = 200) -> list:
    """At most so many points of a series, at an even stride, for a chart."""
    step = max(1, -(-len(values) // most))
    return values[::step]


def sentence(f: Finding) -> str:
    where = f' for {f.dimension}="{f.value}"' if f.dimension else ""
    when = f" in {f.period}" if f.period else ""
    facts = ", ".join(f"{k} {v:.4g}" if isinstance(v, float) else f"{k} {v}" for k, v in f.details.items() if isinstance(v, (int, float, str)) and not isinstance(v, bool))
    return f"{f.kind.replace('_', ' ')} of {f.measure}{where}{when}: {facts} (p={f.p_value:.4f}, score {f.score:.2f})"


def to_json(findings: list[Finding]) -> str:
    rows = [asdict(f) | {"score": f.score, "fingerprint": f.fingerprint, "summary": sentence(f)} for f in findings]
    return json.dumps(rows, default=str, indent=2)


def to_markdown(findings: list[Finding], title: str = "Insights") -> str:
    lines = [f"# {title}", ""]
    for f in findings:
        lines.append(f"{f.rank or '-'}. {sentence(f)}")
        lines += [f"   - {sentence(c)}" for c in f.children]
    return "\n".join(lines) + "\n"


def to_html(findings: list[Finding], title: str = "Insights") -> str:
    def item(f: Finding) -> str:
        inner = "".join(map(item, f.children))
        return f"<li>{html.escape(sentence(f))}{f'<ul>{inner}</ul>' if inner else ''}</li>"

    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><ol>{''.join(map(item, findings))}</ol>"


def as_frame(spark, findings: list[Finding]) -> DataFrame:
    """Findings as rows, parents before children."""
    rows = []

    def add(f: Finding, parent: str | None) -> None:
        rows.append((f.fingerprint, parent, f.kind, f.measure, f.agg, f.transform, f.dimension, f.value, f.period, float(f.p_value), float(f.significance), float(f.impact), float(f.novelty), float(f.score), f.sentiment, f.rank, json.dumps(f.details, default=str, sort_keys=True)))
        for c in f.children:
            add(c, f.fingerprint)

    for f in findings:
        add(f, None)
    return spark.createDataFrame(rows, "fingerprint string, parent string, kind string, measure string, agg string, transform string, dimension string, value string, period string, p_value double, significance double, impact double, novelty double, score double, sentiment string, rank int, details string")
