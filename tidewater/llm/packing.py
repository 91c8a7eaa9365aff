"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target proportions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import importable, tidy, written
from tidewater.llm.tokens import shipped, vocabulary_path

#: Tokens in a sequence, sequences in a window, and the id that ends a document.
LENGTH, WINDOW, END = 2048, 8, 1
#: Sources with a smaller share than one in so many wait in one queue together.
QUEUES = 4096
#: Numbers that a worker keeps of the windows it has seen.
SEEN = 500_000


class Schedule:
    """Deficit round-robin over queues of known length, in closed form.

    Each round adds a window's quantum to every open queue's deficit, in proportion to its weight,
    and takes whole tokens off it; what rounding leaves over goes to the largest deficits, and what
    is left of a deficit waits for the next window. When a queue runs dry the others share its part.
    Since documents may be cut, the tokens taken from each queue before window w follow from w
    alone, so tasks compute their own windows and agree.
    """

    def __init__(self, lengths: list[int], weights: list[float], window: int):
        self.lengths = np.array(lengths, dtype=np.int64)
        self.weights = np.array(weights, dtype=np.float64)
        self.window = window
        self.total = int(self.lengths.sum())
        dry = np.sort(np.unique(self.lengths / self.weights))
        self.levels = np.concatenate(([0.0], dry))
        self.emitted = np.array([np.minimum(self.lengths, self.weights * x).sum() for x in self.levels])
        self.seen: dict[int, np.ndarray] = {}

    def taken(self, w: int) -> np.ndarray:
        """Tokens that each queue has given before window w."""
        got = self.seen.get(w)
        if got is None:
            upto = min(w * self.window, self.total)
            if upto == self.total:
                got = self.lengths
            else:
                share = np.minimum(self.lengths, self.weights * np.interp(upto, self.emitted, self.levels))
                got = np.floor(share).astype(np.int64)
                left = upto - int(got.sum())
                deficit = np.where(got < self.lengths, share - got, -1.0)
                while left > 0:
                    most = np.argsort(-deficit, kind="stable")[: min(left, int((got < self.lengths).sum()))]
                    got[most] += 1
                    deficit = np.where(got < self.lengths, deficit, -1.0)
                    left = upto - int(got.sum())
                while left < 0:
                    got[np.argsort(np.where(got > 0, share - got, np.inf), kind="stable")[: -left]] -= 1
                    left = upto - int(got.sum())
            if len(self.seen) * len(got) >= SEEN:
                self.seen.clear()
            self.seen[w] = got
        return got

    def pieces(self, queue: int, at: int, n: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """Cuts tokens at..at+n of a queue into (start, length, sequence, offset)."""
        per = self.window // length
        level = at / self.weights[queue]
        w = int(np.interp(level, self.levels, self.emitted)) // self.window
        while w and self.taken(w)[queue] > at:
            w -= 1
        done = 0
        while done < n:
            while self.taken(w + 1)[queue] <= at + done:
                w += 1
            before, after = self.taken(w), self.taken(w + 1)
            place = int((after[:queue] - before[:queue]).sum()) + at + done - int(before[queue])
            room = min(n - done, int(after[queue]) - at - done, length - place % length)
            yield done, room, w * per + place // length, place % length
            done += room


def tokenized(df: DataFrame, path: str, key: str, text: str, source: str, end: int = END) -> DataFrame:
    """Rows (doc_id, source, part, before, n, ids): 16-bit ids with the end id, and the tokens of the same source before it in its partition."""

    made = shipped(df.sparkSession, path)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = made(), TaskContext.get().partitionId()
        tail = np.array([end], dtype=np.uint16).tobytes()
        held: dict[str | None, int] = {}
        for b in batches:
            ids = [x.tobytes() + tail for x in table.ids(b.column(2))]
            n = [len(x) // 2 for x in ids]
            before = []
            for s, k in zip(b.column(1).to_pylist(), n, strict=True):
                before.append(held.get(s, 0))
                held[s] = before[-1] + k
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([part] * len(n), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "source", "part", "before", "n", "ids"],
            )

    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, part int, before long, n long, ids binary")


def pack(
    df: DataFrame, weights: dict[str | None, float] | None = None, length: int = LENGTH, window: int = WINDOW,
    path: str | None = None, key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source), one per piece.

    All documents' ids, each document ended by id 1, are packed into sequences of `length`. A window
    of `window` sequences holds every source in its target proportion to within a token: by default
    the sources' own shares, so that all run dry together, or the given weights of sources until one
    runs dry; sources of under 1 in QUEUES of the tokens wait in one queue together, in the order of
    their names. Every sequence but the last is full. A null text is empty and gives its end id; a null
    source is a source of its own; repeated rows are packed each; an empty df gives no rows. A very
    long text is tokenised in stretches; its ids are held whole, two bytes each. Other columns of df
    are ignored.

    Plan: one pass over the texts writes ids with each document's place among its source's tokens in
    its partition; sums per source and partition give the places overall; a second pass over the ids
    computes its own windows. Neither texts nor ids are shuffled while the sums are small enough to
    broadcast; beyond that they are joined by source and partition.
    """
    importable(df.sparkSession)
    path = path or vocabulary_path()
    rows = written(tokenized(df, path, key, text, source))
    sums = written(rows.groupBy(F.col("source").alias("_s"), F.col("part").alias("_p")).agg(F.sum("n").alias("_n")))
    total = sums.agg(F.sum("_n")).first()[0] or 0
    by_source = sums.groupBy("_s").agg(F.sum("_n").alias("n")).withColumn("own", F.col("n") * QUEUES >= total)
    own = sorted(((r["_s"], r["n"]) for r in by_source.where("own").collect()), key=lambda r: (r[0] is None, r[0] or ""))  # at most QUEUES rows
    rest = total - sum(n for _, n in own)
    names = [s for s, _ in own]
    lengths = [n for _, n in own]
    least = min(range(len(own)), key=lambda q: lengths[q], default=0)
    if rest and rest * QUEUES >= total:
        least = len(lengths)
        lengths.append(rest)
    elif rest:
        lengths[least] += rest
    shares = [float(n) for n in lengths]
    if weights is not None:
        shares = [float(weights.get(s, 0.0)) for s in names] + [float(sum(v for k, v in weights.items() if k not in names)) or 1.0] * (len(lengths) - len(names))
        if any(x * length * window < 2 * sum(shares) for x in shares):
            raise ValueError("every source needs a weight of at least two tokens a window")
    plan = Schedule(lengths, shares, length * window) if total else None
    queue = F.lit(least)
    if names:
        known = {s: q for q, s in enumerate(names)}
        table = df.sparkSession.createDataFrame([(s, q) for s, q in known.items()], "_name string, _q int")
        sums = sums.join(F.broadcast(table), F.col("_s").eqNullSafe(F.col("_name")), "left").drop("_name")
        queue = F.coalesce("_q", F.lit(least))
    before = Window.partitionBy("queue").orderBy(F.col("_s").asc_nulls_first(), "_p").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.withColumn("queue", queue.cast("int")).withColumn("base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_s", "_p", "queue", "base")
    placed = rows.join(written(places), F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, queues, ats, ns, sources = (b.column(i).to_pylist() for i in range(5))
            out: list[list] = [[] for _ in range(8)]
            for doc, q, at, n, name, ids in zip(docs, queues, ats, ns, sources, b.column(5), strict=True):
                wide = memoryview(np.frombuffer(ids.as_buffer(), dtype=np.uint16).astype("<u4").tobytes())
                for row in plan.pieces(q, at, n, length):
                    start, k, sequence, offset = row
                    for col, x in zip(out, (doc, start, k, zlib.crc32(wide[4 * start : 4 * (start + k)]), n, sequence, offset, name), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in out[:7]), pa.array(out[7], pa.string())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
            )

    return placed.select("doc_id", "queue", (F.col("base") + F.col("before")).alias("at"), "n", "source", "ids").mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    )
