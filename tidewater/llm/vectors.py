"""Embedding near-dedup by an exact metric range join: pivots, cells and replicated boundaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import components, importable, partitions, tidy, written
from tidewater.llm.shingles import mixed

COSINE = 0.95
#: Vectors that a cell should hold, and pivots at least and at most.
CELL, LEAST, MOST = 4096, 8, 1024


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Indices of usable vectors (not empty, finite, not zero), their lengths, and their values as bytes in double precision."""
    column = column.cast(pa.large_list(pa.float64()))
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, dims, body = [], [], []
    for dim in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == dim)
        x = np.asarray(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(rows), dim)
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        at.append(rows[good])
        dims.append(np.full(int(good.sum()), dim))
        body += [v.tobytes() for v in x[good] + 0.0]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *at]), np.concatenate([none, *dims]), body


def _node(body: list[bytes], dim: int) -> np.ndarray:
    """A 64-bit number that equal vectors share."""
    x = np.frombuffer(b"".join(body), dtype=np.uint64).reshape(-1, dim)
    roll = mixed(np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    return mixed((mixed(x) * roll).sum(axis=1, dtype=np.uint64) + np.uint64(dim)).view(np.int64)


def _units(body: list[bytes], dim: int) -> np.ndarray:
    """Vectors brought to length 1; first to a largest component of 1, so that no square over- or underflows."""
    x = np.frombuffer(b"".join(body), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _least(hit: np.ndarray, label: np.ndarray, out: np.ndarray) -> np.ndarray:
    """out, or the least label of the columns that a row hits, in strips."""
    for lo in range(0, len(hit), 512):
        part = np.where(hit[lo : lo + 512], label, np.iinfo(np.int64).max)
        np.minimum(out[lo : lo + 512], part.min(axis=1), out=out[lo : lo + 512])
    return out


def _labels(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the graph whose edges are the true cells, a label for each row and column: the least row of its component."""
    rows, cols = np.arange(hit.shape[0]), np.full(hit.shape[1], np.iinfo(np.int64).max)
    while True:
        cols = _least(hit.T, rows, cols)
        new = _least(hit, cols, rows.copy())
        new = np.minimum(new, new[np.minimum(new, len(new) - 1)])
        if (new == rows).all():
            return rows, cols
        rows = new


def vector_groups(df: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of df.

    Vectors of equal length link when their cosine, in double precision, is at least `cosine` (over
    0); n_links counts the other rows linked directly, component_id is the smallest key reachable and
    kept says whether it is the row's own. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; very large and very small ones are scaled first. Rows
    with equal vectors link with each other, null keys count as largest. Other columns of df are
    ignored; an empty df gives no rows.

    Equal vectors are one point with a count. Points of one length go to the cell of their nearest
    pivot; a length with up to CELL points is one cell. With r the distance that the cosine means on
    the unit sphere, a point x of cell i can have a partner in cell j only if
    d(x, p_j) <= d(x, p_i) + 2 r, d(x, p_j) <= radius of j + r, and x lies within r of the plane
    between both pivots; then it is copied to j, for j > i. Cells hold blocks of bounded size; a
    block streams its copies and sends on link counts and each point's component, not pairs.
    """
    spark = df.sparkSession
    importable(spark)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))

    @tidy
    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, dims, body = _rows(b.column(1))
            node, bad = np.zeros(b.num_rows, dtype=np.int64), np.ones(b.num_rows, dtype=bool)
            held, size = np.full(b.num_rows, None, dtype=object), np.zeros(b.num_rows, dtype=np.int32)
            for dim in np.unique(dims):
                here = np.flatnonzero(dims == dim)
                node[at[here]] = _node([body[i] for i in here], int(dim))
            for i, x in zip(at.tolist(), body, strict=True):
                held[i] = x
            bad[at], size[at] = False, dims
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(node, mask=bad), pa.array(size), pa.array(held.tolist(), pa.binary())], names=["vec_id", "node", "dim", "body"]
            )

    named = written(rows.mapInArrow(points, "vec_id long, node long, dim int, body binary"))
    nodes = written(
        named.where("node is not null")
        .groupBy("node", "dim")
        .agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"), F.first("body").alias("body"))
    )
    counts = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}  # a row for each length
    if not counts:
        return named.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    pivots: dict[int, np.ndarray] = {}
    apart: dict[int, np.ndarray] = {}
    first: dict[int, int] = {}
    cells = 0
    for dim, n in sorted(counts.items()):
        first[dim] = cells
        if n > CELL:
            k = min(MOST, max(LEAST, math.ceil(n / CELL)))
            own = nodes.where(F.col("dim") == dim).select("body", F.xxhash64("node").alias("h"), "node")
            picked = own.orderBy("h", "node").limit(k).select("body").collect()  # at most MOST rows
            pivots[dim] = _units([r["body"] for r in picked], dim)
            apart[dim] = np.sqrt(np.maximum(0, 2 - 2 * pivots[dim] @ pivots[dim].T))
        cells += len(pivots.get(dim, [0]))
    reach = math.sqrt(2 - 2 * cosine) + 1e-7

    def by_dim(b: pa.RecordBatch, column: int, body: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        dims, raw = b.column(column).to_numpy(), b.column(body)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            yield dim, at, _units(raw.take(pa.array(at)).to_pylist(), dim)

    @tidy
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, away = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for dim, at, u in by_dim(b, 1, 3):
                cell[at] = first[dim]
                if dim in pivots:
                    far = np.sqrt(np.maximum(0, 2 - 2 * u @ pivots[dim].T))
                    cell[at] += far.argmin(axis=1).astype(np.int32)
                    away[at] = far.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(away)], names=["node", "dim", "n", "body", "cell", "away"])

    homes = written(nodes.select("node", "dim", "n", "body").mapInArrow(assign, "node long, dim int, n long, body binary, cell int, away double"))
    size, radius = np.zeros(cells, np.int64), np.full(cells, -1.0)
    for r in homes.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect():  # a row for each cell
        size[r["cell"]], radius[r["cell"]] = r["n"], r["away"]
    blocks = np.maximum(1, -(-size // CELL))

    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home = b.column(4).to_numpy().astype(np.int64)
            every = np.arange(len(home))
            block = (mixed(b.column(0).to_numpy().view(np.uint64)) % blocks[home].astype(np.uint64)).astype(np.int64)
            take, cell, part, copy = [every], [home], [block], [np.zeros(len(every), np.int32)]

            def send(rows, to_cell, to_block):
                take.append(rows)  # noqa: B023
                cell.append(to_cell)  # noqa: B023
                part.append(np.full(len(rows), to_block))  # noqa: B023
                copy.append(np.ones(len(rows), np.int32))  # noqa: B023

            for to in range(int(blocks[home].max(initial=1))):
                later = np.flatnonzero((blocks[home] > to) & (block < to))
                send(later, home[later], to)
            for dim, at, u in by_dim(b, 1, 3):
                if dim not in pivots:
                    continue
                own, mine = np.arange(len(at)), home[at] - first[dim]
                far2 = np.maximum(0, 2 - 2 * u @ pivots[dim].T)
                far = np.sqrt(far2)
                span = slice(first[dim], first[dim] + len(pivots[dim]))
                near = far <= np.minimum(far[own, mine][:, None] + 2 * reach, radius[None, span] + reach)
                near &= far2 - far2[own, mine][:, None] <= 2 * reach * apart[dim][mine] + 1e-7
                near &= np.arange(len(pivots[dim]))[None, :] > mine[:, None]
                x, j = np.nonzero(near)
                j = j + first[dim]
                for to in range(int(blocks[j].max(initial=1))):
                    has = blocks[j] > to
                    send(at[x[has]], j[has], to)
            at = pa.array(np.concatenate(take))
            whole = pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(part).astype(np.int32)), pa.array(np.concatenate(copy)), *(b.column(i).take(at) for i in range(4))],
                names=["cell", "block", "copy", "node", "dim", "n", "body"],
            )
            for lo in range(0, whole.num_rows, 8192):
                yield whole.slice(lo, 8192)

    def sent(nodes, links, roots):
        """Link counts of the nodes that have any, and an edge from each to the root of its component."""
        some, moved = links > 0, roots != nodes
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((nodes[some], nodes[moved]))),
                pa.array(np.concatenate((nodes[some], roots[moved])), mask=np.arange(int(some.sum() + moved.sum())) < some.sum()),
                pa.array(np.concatenate((links[some], np.zeros(int(moved.sum()), np.int64)))),
            ],
            names=["a", "b", "links"],
        )

    def inside(nodes, n, u):
        hit = np.empty((len(u), len(u)), dtype=bool)
        for lo in range(0, len(u), 1024):
            hit[lo : lo + 1024] = u[lo : lo + 1024] @ u.T >= cosine
        hit |= hit.T  # rounding may differ by side
        np.fill_diagonal(hit, False)
        links = np.concatenate([hit[lo : lo + 1024] @ n for lo in range(0, len(u), 1024)])
        some = np.flatnonzero(links)
        roots = nodes.copy()
        if len(some):
            own = hit[np.ix_(some, some)]
            np.fill_diagonal(own, True)  # a row and a column are the same point
            roots[some] = nodes[some][_labels(own)[0]]
        return sent(nodes, links, roots)

    def across(nodes, n, u, others, m, v):
        hit = np.concatenate([u[lo : lo + 1024] @ v.T >= cosine for lo in range(0, len(u), 1024)])
        links = np.concatenate([hit[lo : lo + 1024] @ m for lo in range(0, len(u), 1024)])
        theirs = np.concatenate([hit[:, lo : lo + 1024].T @ n for lo in range(0, len(v), 1024)])
        x, y = np.flatnonzero(links), np.flatnonzero(theirs)
        roots, their_roots = nodes.copy(), others.copy()
        if len(x):
            rows, cols = _labels(hit[np.ix_(x, y)])
            roots[x], their_roots[y] = nodes[x][rows], nodes[x][cols]
        return sent(np.concatenate((nodes, others)), np.concatenate((links, theirs)), np.concatenate((roots, their_roots)))

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, home = None, [], None

        def close():
            nonlocal home
            if home is None and held:
                home = tuple(np.concatenate([h[i] for h in held]) for i in range(3))
                held.clear()
                return inside(*home)
            return None

        for b in batches:
            keys = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            nodes, dims, n, body = b.column(3).to_numpy(), b.column(4).to_numpy(), b.column(5).to_numpy(), b.column(6)
            for lo, hi in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if key != tuple(keys[lo, :2]):
                    if got := close():
                        yield got
                    key, home = tuple(keys[lo, :2]), None
                u = _units(body.slice(lo, hi - lo).to_pylist(), int(dims[lo]))
                if keys[lo, 2] == 0:
                    held.append((nodes[lo:hi], n[lo:hi], u))
                else:
                    if got := close():
                        yield got
                    if home is not None:
                        yield across(*home, nodes[lo:hi], n[lo:hi], u)
        if got := close():
            yield got

    dealt = homes.mapInArrow(deal, "cell int, block int, copy int, node long, dim int, n long, body binary")
    dealt = dealt.repartition(partitions(spark), "cell", "block").sortWithinPartitions("cell", "block", "copy")
    met = written(dealt.mapInArrow(meet, "a long, b long, links long"))
    links = met.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = components(met.where("b is not null").select("a", "b"))
    whole = nodes.select("node", "vec_id", "n").join(links, "node", "left").join(joined, "node", "left").withColumn("top", F.coalesce("root", "node"))
    least = whole.groupBy("top").agg(F.min("vec_id").alias("component_id"))
    fate = written(whole.join(least, "top").select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    return named.select("vec_id", "node").join(fate.hint("merge"), "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("node").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
