"""N-gram Jaccard self-join by adaptive multi-match prefixes.

One global order puts shingles that many documents hold last, by the logarithm of their document
frequency, and the rest by hash. A document with n shingles and required overlap o = ceil(0.85 n)
shows its first p + l - 1 shingles, p = n - o + 1. Two linked documents share at least l shingles
among those for every l up to o, so each document chooses its own l: the larger the number of
candidates that its first p shingles would bring, the longer its prefix and the more matches it
asks for. A pair is asked for the smaller of its two l, counted within that length.

Frequent shingles (only their order and this choice depend on the list, never the result) are not
paired up: documents that show the same one are chained to one of them, on the map side first. The
candidates fall into connected groups, in blocks by size. Blocks are compared with themselves and
their neighbours first, which joins up near copies; then, of larger groups, only blocks that are not
yet in one component. Only a spanning forest of the links goes on, so no list, however long, is
turned into pairs, and a large group of near copies takes comparisons in proportion to its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import components, importable, neutral, numbered, partitions, tidy, written
from tidewater.llm.shingles import WORDS, set_id, shingle_sets

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A shingle is frequent when more documents hold it; a longer list is chained, not paired.
FREQUENT = 32
#: Entries that the broadcast list of frequent shingles may have; the most frequent ones go in.
LISTED = 500_000
#: Documents in a block that is compared in full.
BLOCK = 256
#: Shingles gathered before a task sends its counts on, and postings.
GATHER, POSTED = 4_000_000, 1_000_000

_POST = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<u4"), ("level", "<u2"), ("asks", "<u2"), ("hub", "u1")])


def _packed(a: np.ndarray) -> bytes:
    """Records, byte by byte in columns, which compress better."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def _unpacked(raw: bytes, dtype: np.dtype) -> np.ndarray:
    size = dtype.itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(dtype)[:, 0]


def _by_range(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where each of the equal ranges begins in sorted keys of so many bits."""
    return np.searchsorted(keys, np.array([(r << bits) // ranges for r in range(ranges)], dtype=keys.dtype))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The payloads of each range in a partition sorted by (range, payload)."""
    now, held = None, []
    for b in batches:
        for r, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if r != now and held:
                yield held
                held = []
            now = r
            held.append(payload)
    if held:
        yield held


_COUNT = np.dtype([("token", "<u4"), ("n", "<u4")])


def frequent_shingles(texts: DataFrame, words: int = WORDS, listed: int = LISTED) -> tuple[np.ndarray, np.ndarray, float]:
    """Upper halves of the hashes of frequent shingles, sorted, the logarithm of their counts, and the mean list of the others.

    Counts cover all documents and are summed map-side; the list holds at most `listed` entries.
    """
    ranges = 4 * partitions(texts.sparkSession)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            at = np.append(_by_range(tokens, 32, ranges), len(tokens))
            rows = np.empty(len(tokens), dtype=_COUNT)
            rows["token"], rows["n"] = tokens, n
            full = [r for r in range(ranges) if at[r + 1] > at[r]]
            packs = []
            for r in full:
                part = rows[at[r] : at[r + 1]].copy()
                part["token"][1:] = np.diff(part["token"])
                packs.append(_packed(part))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(packs, pa.binary())], names=["range", "payload"])

        for b in batches:
            for s in shingle_sets(b.column(0), words):
                if len(s):
                    held.append((s >> np.uint64(32)).astype(np.uint32))
                    size += len(s)
                    if size >= GATHER:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for payloads in _ranges(batches):
            parts = [_unpacked(x, _COUNT) for x in payloads]
            tokens = np.concatenate([np.cumsum(x["token"], dtype=np.uint32) for x in parts])
            order = np.argsort(tokens, kind="stable")
            tokens = tokens[order]
            first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            n = np.add.reduceat(np.concatenate([x["n"] for x in parts])[order].astype(np.int64), first)
            often, rare = n > FREQUENT, n[n <= FREQUENT]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None, *tokens[first][often].tolist()], pa.int64()),
                    pa.array([int(rare.sum()), *n[often].tolist()], pa.int64()),
                    pa.array([float((rare * rare).sum()), *([0.0] * int(often.sum()))], pa.float64()),
                ],
                names=["token", "n", "squares"],
            )

    # Without a number of its own, so that adaptive execution makes as many tasks, and files, as the counts fill.
    sent = texts.mapInArrow(count, "range int, payload binary").repartition("range").sortWithinPartitions("range")
    found = written(sent.mapInArrow(add, "token long, n long, squares double"))
    mean = found.where("token is null").agg(F.sum("squares") / F.sum("n")).first()[0] or 1.0
    found = found.where("token is not null").withColumn("grade", F.floor(F.log2("n")).cast("int"))
    least, kept = 64, 0
    for grade, n in sorted(found.groupBy("grade").count().collect(), reverse=True):  # one row for each power of two
        if kept + n > listed:
            break
        least, kept = grade, kept + n
    rows = found.where(F.col("grade") >= least).select("token", "grade").orderBy("token").toPandas()
    return rows["token"].to_numpy(np.uint32), rows["grade"].to_numpy(np.uint16), float(mean) - 1.0


def _prefixes(often, ranges: int, words: int):
    """Of each document its row and the postings of its prefix; see the module's head."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, grades, mean = often.value
        hubs: dict[int, int] = {}
        chained: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        size = 0
        known: set[int] = set()

        def out(kind, docs=(), ns=(), nodes=(), at=(), payloads=()):
            n = max(len(docs), len(payloads))
            blank = [None] * n
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([kind] * n, pa.int32()),
                    pa.array(docs if len(docs) else blank, pa.int64()),
                    pa.array(ns if len(ns) else blank, pa.int64()),
                    pa.array(nodes if len(nodes) else blank, pa.int64()),
                    pa.array(at if len(at) else blank, pa.int32()),
                    pa.array(payloads if len(payloads) else blank, pa.binary()),
                ],
                names=["kind", "doc_id", "n", "node", "range", "payload"],
            )

        def flush():
            nonlocal held, size
            if held:
                rows = np.concatenate(held)
                rows = rows[np.argsort(rows["token"], kind="stable")]
                at = np.append(_by_range(rows["token"], 64, ranges), len(rows))
                full = [r for r in range(ranges) if at[r + 1] > at[r]]
                yield out(1, at=full, payloads=[_packed(rows[at[r] : at[r + 1]]) for r in full])
                held, size = [], 0
            if chained:
                pairs = np.array(sorted(chained), dtype=np.int64)
                chained.clear()
                yield out(2, docs=pairs[:, 0], nodes=pairs[:, 1])

        def post(shown, node, n, level, asks, hub):
            rows = np.empty(len(shown), dtype=_POST)
            rows["token"], rows["node"], rows["n"], rows["level"], rows["asks"], rows["hub"] = shown, node, n, level, asks, hub
            held.append(rows)

        for b in batches:
            docs, ns, nodes = b.column(0).to_pylist(), [], []
            for s in shingle_sets(b.column(1), words):
                n = len(s)
                node = set_id(s) if n else 0
                ns.append(n)
                nodes.append(node)
                if not n or node in known:
                    continue
                if len(known) >= 1_000_000:
                    known.clear()
                known.add(node)
                overlap = -(-PERCENT * n // 100)
                p = n - overlap + 1
                if len(tokens):
                    upper = (s >> np.uint64(32)).astype(np.uint32)
                    at = np.minimum(np.searchsorted(tokens, upper), len(tokens) - 1)
                    grade = np.where(tokens[at] == upper, grades[at], 0)
                else:
                    grade = np.zeros(n, np.uint16)
                if grade.any():
                    order = np.argsort(grade, kind="stable")
                    s, grade = s[order], grade[order]
                first = grade[:p]
                cost = float((first == 0).sum()) * mean + float(np.exp2(first[first > 0].astype(np.float64)).sum())
                asks = min(overlap, 1 + math.ceil(math.log2(1.0 + cost)))
                shown = p + asks - 1
                level = np.maximum(1, np.arange(shown) - p + 2)
                light = grade[:shown] == 0
                if light.any():
                    post(s[:shown][light], node, n, level[light], asks, 0)
                    size += int(light.sum())
                for t in s[:shown][~light].tolist():
                    hub = hubs.setdefault(t, node)
                    if hub != node:
                        chained.add((hub, node))
            yield out(0, docs=docs, ns=ns, nodes=nodes)
            if size >= POSTED or len(chained) >= 500_000:
                yield from flush()
        if hubs:
            post(np.fromiter(hubs.keys(), np.uint64, len(hubs)), np.fromiter(hubs.values(), np.int64, len(hubs)), 0, 0, 0, 1)
        yield from flush()

    return run


@tidy
def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a range of shingles: (a, b, hits, needed), needed 0 for chained ones."""
    for payloads in _ranges(batches):
        rows = np.concatenate([_unpacked(x, _POST) for x in payloads])
        rows = rows[np.lexsort((rows["node"], rows["token"]))]
        fresh = np.concatenate(([True], (rows["token"][1:] != rows["token"][:-1]) | (rows["node"][1:] != rows["node"][:-1])))
        rows = rows[fresh]
        first = np.flatnonzero(np.concatenate(([True], rows["token"][1:] != rows["token"][:-1])))
        length = np.diff(np.append(first, len(rows)))
        hub = rows["hub"][first] > 0
        found = []
        chain = (length > 1) & (hub | (length > 2 * FREQUENT))
        for f, k in zip(first[chain], length[chain], strict=True):
            nodes = rows["node"][f : f + k]
            found.append(np.stack([np.full(k - 1, nodes[0]), nodes[1:], np.zeros(k - 1, np.int64)], axis=1))
        paired = (length > 1) & ~hub & (length <= 2 * FREQUENT)
        for k in np.unique(length[paired]):
            at = first[paired & (length == k)][:, None] + np.arange(k)
            i, j = np.triu_indices(k, 1)
            a, b = rows[at[:, i].ravel()], rows[at[:, j].ravel()]
            need = np.minimum(a["asks"], b["asks"])
            n, m = a["n"].astype(np.int64), b["n"].astype(np.int64)
            good = (np.maximum(a["level"], b["level"]) <= need) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
            found.append(np.stack([a["node"][good], b["node"][good], need[good].astype(np.int64)], axis=1))
        if not found:
            continue
        pairs, hits = np.unique(np.concatenate(found), axis=0, return_counts=True)
        if len(pairs):
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(hits.astype(np.int64)), pa.array(pairs[:, 2])], names=["a", "b", "hits", "needed"]
            )


def forest(k: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs of 0..k-1 that span what all the given pairs connect."""
    above = list(range(k))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    kept = []
    for x, y in pairs:
        a, b = top(x), top(y)
        if a != b:
            above[b] = a
            kept.append((x, y))
    return kept


def links_within(sets: list[np.ndarray], cut: int | None = None) -> np.ndarray:
    """Index pairs of sets that link; with a cut, only pairs across it. Overlaps come from products of 0/1 blocks."""
    k = len(sets)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = n > 1
    place = np.cumsum(often) - 1
    keep = often[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(256, 1_000_000 // k)
    rows = slice(0, k if cut is None else cut)
    both = np.zeros((rows.stop, k), dtype=np.float64)
    top = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, top, width):
        i, j = np.searchsorted(column, [lo, lo + width])
        block = np.zeros((k, min(width, top - lo)), dtype=np.float32)
        block[owner[i:j], column[i:j] - lo] = 1
        both += block[rows] @ block.T
    size = np.array([len(s) for s in sets], dtype=np.float64)
    linked = 100 * both >= PERCENT * (size[rows, None] + size[None, :] - both)
    x, y = np.nonzero(linked)
    return np.stack([x, y], axis=1)[(x < y) & (y >= rows.stop if cut is not None else True)]


@tidy
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links in each pair of blocks, from rows (grp, i, j, node, side, body) sorted by key and side."""

    def solve(held):
        seen: dict[int, tuple[int, np.ndarray]] = {}
        for node, side, body in held:
            seen.setdefault(node, (side, np.frombuffer(body, np.uint64)))
        if len(seen) < 2:
            return None
        nodes = sorted(seen, key=lambda x: seen[x][0])
        cut = sum(seen[x][0] == 0 for x in nodes)
        pairs = links_within([seen[x][1] for x in nodes], None if cut == len(nodes) else cut)
        kept = forest(len(nodes), map(tuple, pairs.tolist()))
        if not kept:
            return None
        return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in kept], pa.int64()), pa.array([nodes[y] for _, y in kept], pa.int64())], names=["a", "b"])

    now, held = None, []
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(6)]
        for *key, node, side, body in zip(*cols, strict=True):
            if key != now:
                if held and (got := solve(held)):
                    yield got
                now, held = key, []
            held.append((node, side, body))
    if held and (got := solve(held)):
        yield got


def _blocked(members: DataFrame, order: list[str]) -> DataFrame:
    """Members of groups (grp, ..) with the number of their block of BLOCK, in the given order."""
    ranked = numbered(members, "grp", [F.col(c) for c in order], "rank")
    return ranked.withColumn("block", F.floor(F.col("rank") / BLOCK).cast("int")).drop("rank")


def _meetings(members: DataFrame, which) -> DataFrame:
    """Pairs of blocks (grp, i, j) of a group that fit a condition on x and y and whose sizes allow a link."""
    part = F.col("part") if "part" in members.columns else F.lit(0)
    blocks = members.groupBy("grp", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min(part).alias("part"), F.max(part).alias("last_part"))
    sizes = f"x.grp = y.grp and x.block <= y.block and 100 * x.high >= {PERCENT} * y.low and 100 * y.high >= {PERCENT} * x.low"
    return blocks.alias("x").join(blocks.alias("y"), F.expr(sizes) & which).select(F.col("x.grp").alias("grp"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))


def _compared(texts: DataFrame, members: DataFrame, meets: DataFrame, words: int) -> DataFrame:
    """Edges (a, b) that span the links within the pairs of blocks. Each member's set is shipped once for each pair."""
    sides = meets.select("grp", F.col("i").alias("block"), F.struct("i", "j", F.lit(0).alias("side")).alias("t")).union(
        meets.where("i < j").select("grp", F.col("j").alias("block"), F.struct("i", "j", F.lit(1).alias("side")).alias("t"))
    )
    aims = sides.groupBy("grp", "block").agg(F.collect_list("t").alias("aims"))
    wanted = written(members.join(aims, ["grp", "block"]).select("doc_id", "node", "grp", "aims"))

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(shingle_sets(b.column(3), words))
            good = [i for i, (s, node) in enumerate(zip(found, b.column(0).to_pylist(), strict=True)) if len(s) and set_id(s) == node]
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array([found[i].tobytes() for i in good], pa.binary())],
                names=["node", "grp", "aims", "body"],
            )

    held = (
        texts.join(wanted.hint("merge"), texts["doc_id"].eqNullSafe(wanted["doc_id"]))  # candidates grow with the corpus: one plan at all sizes
        .select("node", "grp", "aims", "text")
        .mapInArrow(sets, "node long, grp long, aims array<struct<i:int,j:int,side:int>>, body binary")
        .select("grp", F.explode("aims").alias("t"), "node", "body")
        .select("grp", "t.i", "t.j", "node", "t.side", "body")
        .repartition(partitions(texts.sparkSession), "grp", "i", "j")
        .sortWithinPartitions("grp", "i", "j", "side")
    )
    return held.mapInArrow(_verified, "a long, b long")


def jaccard_groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of df.

    A text's set holds its distinct shingles of `words` words (A-Z lower-cased); a shorter text has
    one, the whole sequence; null, empty and blank texts have none and link with nothing, so they
    are their own component. Texts link when 100 * intersection >= 85 * union; component_id is the
    smallest key reachable by links. Repeated rows and equal texts link with each other, null keys
    count as largest. Other columns of df are ignored; an empty df gives no rows.
    """
    spark = df.sparkSession
    importable(spark)
    parts = partitions(spark)
    ranges = 4 * parts
    texts = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    often = spark.sparkContext.broadcast(frequent_shingles(texts.select("text"), words))
    shown = written(texts.mapInArrow(_prefixes(often, ranges, words), "kind int, doc_id long, n long, node long, range int, payload binary"))
    docs = shown.where("kind = 0").select("doc_id", "n", "node")

    posted = shown.where("kind = 1").select("range", "payload").repartition(parts, "range").sortWithinPartitions("range")
    pairs = posted.mapInArrow(_matches, "a long, b long, hits long, needed long")
    pairs = pairs.groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.min("needed").alias("needed")).where("hits >= needed").select("a", "b")
    chained = shown.where("kind = 2").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    groups = components(pairs.union(chained))

    nodes = written(docs.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")))
    members = nodes.join(groups, "node").select(F.col("root").alias("grp"), "node", "n", "doc_id")
    members = written(_blocked(members, ["n", "node"]))
    # First blocks with themselves and their neighbours by size, which joins up what is much alike.
    near = F.expr("y.block - x.block between 0 and 1")
    joined = components(_compared(texts, members, _meetings(members, near), words))
    # Then, in groups of several blocks, what these didn't compare: blocks anew by component, all pairs but those within one.
    large = members.groupBy("grp").agg(F.max("block").alias("last")).where("last > 1").select("grp")
    rest = members.join(large, "grp", "left_semi").drop("block").join(joined, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    rest = written(_blocked(rest, ["part", "n", "node"]))
    apart = F.expr("x.block <= y.block and not (x.part = x.last_part and x.part = y.part and y.part = y.last_part)")
    stars = joined.select(F.col("node").alias("a"), F.col("root").alias("b"))  # they connect what the first links did
    linked = components(stars.union(_compared(texts, rest, _meetings(rest, apart), words)))
    named = nodes.join(linked, "node", "left").withColumn("top", F.coalesce("root", "node"))
    least = named.groupBy("top").agg(F.min("doc_id").alias("component_id"))
    fate = written(named.join(least, "top").select("node", "component_id"))
    return docs.join(fate.hint("merge"), "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def drop_near(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """df with one row of each component of linked texts, the one with the smallest key; all its columns.

    Rows that share a key stay or go together: they stay if the smallest key of one of them is its own.
    """
    groups = written(jaccard_groups(df, key, text, words).select("doc_id", "component_id"))
    rows = groups.groupBy("doc_id").agg(F.max(F.col("component_id").eqNullSafe(F.col("doc_id"))).alias("stays"))
    gone = written(rows.where("not stays").select(F.col("doc_id").alias("_gone")))
    plain, names = neutral(df)
    kept = plain.join(gone.hint("merge"), F.col(names[key]).cast("long").eqNullSafe(F.col("_gone")), "left_anti")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
