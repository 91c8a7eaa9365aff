import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_documents import brute_components, check_packing, library  # noqa: F401

from tidewater.llm import common, registry


def test_registry_has_every_operator():
    assert [int(q[2:].split("_")[0]) for q in registry.queries()] == list(range(1, 11))


def test_pipeline(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns
        now = spark.createDataFrame(out.collect(), out.schema)
        seen.append((name, now.count()))
    assert [n for _, n in seen] == sorted((n for _, n in seen[:3]), reverse=True) + [seen[3][1]]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    tokens = packed.groupBy("doc_id").agg(F.sum("length").alias("n")).count()
    assert tokens == now.select("doc_id").distinct().count()


def has_letter(text):
    return text is not None and any(c.isalpha() for c in text)


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    order = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
    return [min(g, key=order) for g in groups.values()]


def brute_near(rows):
    own = {doc for doc, _, least in brute_components(rows) if doc == least}
    return [r for r in rows if r[0] in own]


def brute_drawn(rows):
    """How often a mix draws each key: once a pass in which its first word lies before its source's target."""
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for i, r in enumerate(rows)}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    size = {s: sum(words[i] for i, r in enumerate(rows) if r[3] == s) for s in sources}
    capped = set()
    while True:
        unit = (1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)) / max(1, sum(weight[s] for s in sources if s not in capped))
        more = {s for s in sources if s not in capped and unit * weight[s] > 2 * size[s]}
        if not more:
            break
        capped |= more
    place = lambda i: (hashlib.md5(f"mix-1:{'null' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), words[i])
    low, high = Counter(), Counter()
    for s in sources:
        goal = 2 * size[s] if s in capped else unit * weight[s]
        at = 0
        for i in sorted((i for i, r in enumerate(rows) if r[3] == s), key=place):
            if words[i]:
                for times, target in ((low, math.floor(goal)), (high, math.ceil(goal))):
                    times[rows[i][0]] = max(times[rows[i][0]], sum(at + k * size[s] < target for k in range(2)))
            at += words[i]
    return low, high


def test_pipeline_equals_brute_force(spark, docs, rows, tmp_path, library):  # noqa: F811
    """Each stage's rows, from the rows that the stage before kept, and the rows of run()."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(names).write.parquet(f"{tmp_path}/documents.parquet")
    frame, now = spark.read.parquet(f"{tmp_path}/documents.parquet"), [r[:5] for r in rows]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == names
        got = [tuple(r) for r in out.collect()]
        if name == "language_id":
            want = [r for r in now if has_letter(r[1])]
            labels = {r[2] for r in now} - {None}
            assert all(r[2] in labels for r in got)
            bare = lambda rs: Counter((*r[:2], *r[3:]) for r in rs)
            assert bare(got) == bare(want)
            given = Counter(r for r in want if r[2] is not None)
            assert given <= Counter(got)
        elif name == "exact_dedup":
            assert Counter(got) == Counter(brute_exact(now))
        elif name == "jaccard_join":
            assert Counter(got) == Counter(brute_near(now))
        else:
            low, high = brute_drawn(now)
            times = Counter(r[0] for r in got)
            same = Counter(r[0] for r in now)
            assert set(got) <= set(now)
            assert all(low[k] * n <= times[k] <= high[k] * n for k, n in same.items())
        now, frame = got, spark.createDataFrame(got, out.schema)
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), now, library)


def test_a_workers_table_goes_when_another_operator_runs(monkeypatch):
    monkeypatch.setattr(common, "_held", {})
    monkeypatch.setattr(common, "_user", "")
    common._settle("a")
    first = common.held("t", list)
    common._settle("a")
    assert common.held("t", list) is first
    common._settle("b")
    assert not common._held and common.held("u", list) is not first
    common.held("v", list)
    assert list(common._held) == ["v"]
