import random
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import common, vectors

SHAPE = "vec_id long, embedding array<float>, label int, node long, kept string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for i in range(160):
        out.append((i, rng.normal(size=6).tolist()))
    for i in range(160, 260):  # neighbours, near the threshold too
        out.append((i, (np.array(out[i % 11][1]) + rng.normal(size=6) * 0.3 * rng.random()).tolist()))
    out += [(i, out[5][1]) for i in range(260, 300)] + [(300, [2 * x for x in out[5][1]])]
    out += [(301, None), (302, []), (303, [0.0] * 6), (304, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (305, [float("nan")] * 6), (306, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (307, [1.0, 2.0]), (None, out[7][1]), (3, out[3][1])]
    out += [(308, [1.0, 2.01]), (309, [2.0, 1.0]), (310, [5.0]), (311, [1e30, 2e30]), (312, [-3.0]), (313, [1e-30, 0.0, 0.0]), (314, [3e38, 0.0, 1e30])]
    return [(*r, 1, 5, "x") for r in out]


def brute(rows):
    good = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, (_, v, *_) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    good = [(i, v / np.abs(v).max()) for i, v in good]
    unit = [v / np.linalg.norm(v) for _, v in good]
    hit = np.array([[a is not b and len(a) == len(b) and a @ b >= 0.95 for b in unit] for a in unit])
    above = list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    links = Counter()
    for a, b in zip(*np.nonzero(hit)):
        links[good[a][0]] += 1
        above[top(good[a][0])] = top(good[b][0])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return Counter((r[0], links[i], least.get(top(i)), r[0] == least.get(top(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize(("cell", "few"), [(4096, common.FEW), (7, common.FEW), (20, 0)])
def test_vector_groups(spark, rows, monkeypatch, cell, few):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "components", lambda e: common.components(e, few))
    df = spark.createDataFrame(rows, SHAPE).repartition(4)
    assert Counter(tuple(r) for r in vectors.vector_groups(df).collect()) == brute(rows)


def test_empty_and_unusable(spark):
    assert vectors.vector_groups(spark.createDataFrame([], SHAPE)).collect() == []
    got = vectors.vector_groups(spark.createDataFrame([(1, None, 0, 0, ""), (2, [0.0], 0, 0, "")], SHAPE)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_lengths_and_magnitudes_of_doubles(spark):
    rows = [(1, [1e200, 1e-200]), (2, [1.0, 0.0]), (3, [1e-200, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [2.0, 0.0, 0.0]), (6, [5e-324, 0.0])] + [(i, [0.0, 1.0, float(i)]) for i in range(10, 14)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.vector_groups(df).collect()}
    assert [got[i] for i in (1, 2, 3, 6)] == [(3, 1)] * 4 and got[4] == got[5] == (1, 4) and got[13] == (3, 10)


def test_labels_against_plain_search():
    rng = np.random.default_rng(9)
    for n, m, share in ((1, 1, 1.0), (30, 20, 0.05), (700, 600, 0.002)):
        hit = rng.random((n, m)) < share
        rows, cols = vectors._labels(hit)
        above = list(range(n + m))

        def top(x):
            while above[x] != x:
                x = above[x]
            return x

        for x, y in zip(*np.nonzero(hit), strict=True):
            a, b = top(x), top(n + y)
            above[max(a, b)] = min(a, b)
        assert rows.tolist() == [top(x) for x in range(n)]
        assert all(c == top(n + y) for y, c in enumerate(cols) if hit[:, y].any())


@pytest.mark.parametrize("few", [500_000, 0])
def test_components(spark, few):
    rng = random.Random(3)
    edges = [(rng.randint(-200, 200), rng.randint(-200, 200)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 4)]
    above = {}

    def top(x):
        above.setdefault(x, x)
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    assert dict(map(tuple, common.components(df, few).collect())) == {x: top(x) for x in above}


@pytest.mark.parametrize("joined", ["true", "false"])
def test_numbered(spark, joined):
    """Over one partition that adaptive execution made of all, and over several."""
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", joined)
    try:
        check_numbered(spark, F)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_numbered(spark, F):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 5).alias("g"))
    got = common.numbered(df, "g", [F.desc("id")], "slot").collect()
    want = {}
    for g in {r.g for r in got}:
        for k, i in enumerate(sorted((r.id for r in got if r.g == g), reverse=True)):
            want[i] = k
    assert {r.id: r.slot for r in got} == want
