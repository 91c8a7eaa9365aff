"""What the operators of this subpackage share: scratch tables, row numbers without a hot task, components."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.session import importable, shared_dir

__all__ = ["components", "held", "importable", "neutral", "numbered", "partitions", "table", "tidy", "written"]

#: Edges that one task may join up.
FEW = 500_000


_held: dict[str, object] = {}
_user = ""


def _settle(user: str) -> None:
    """Lets the worker's table go if the task that begins belongs to another operator than the last one.

    Functions sent to workers carry copies of the variables they name, so this is one they call by name.
    """
    global _user
    if user != _user:
        _held.clear()
    _user = user


def held(name: str, make: Callable[[], object]) -> object:
    """A worker's one large table: made when first asked for, and let go when another one is, or another operator runs.

    Python workers live on between stages, so tables of earlier stages would add up.
    """
    if name not in _held:
        _held.clear()
        gc.collect()
        _held[name] = make()
    return _held[name]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives a task's freed memory back to the system when it ends.

    Idle workers otherwise keep it through the stages that follow.
    """

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _settle(run.__module__)
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library than glibc
                pass

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared scratch folder and reads it back."""
    spark = df.sparkSession
    path = shared_dir(spark, "llm")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def neutral(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns called c0, c1, .. so that no name of its own can clash, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def numbered(df: DataFrame, group: str, order: list, out: str) -> DataFrame:
    """Adds `out`, a gapless number from 0 within each group (never null) in the given order.

    Rows are dealt by range over (group, order), so a group that holds most rows spreads over many
    tasks, as many as adaptive execution finds work for; only one count per partition and group goes
    through a window. df should be narrow.
    """
    dealt = (
        written(df)
        .repartitionByRange(F.col(group), *order)
        .sortWithinPartitions(F.col(group), *order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    rows = written(dealt).withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(F.col("_part").alias("_p"), F.col(group).alias("_g")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")
    )
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    return (
        rows.join(parts, (F.col("_part") == F.col("_p")) & (F.col(group) == F.col("_g")))
        .withColumn(out, F.col("_at") + F.col("_base"))
        .drop("_at", "_part", "_p", "_g", "_base")
    )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges (v, u) of one task: smaller labels spread over edges and roots until none changes."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not sum(len(v) for v, _ in held):
        return
    ends = np.concatenate([v for v, _ in held] + [u for _, u in held])
    nodes, place = np.unique(ends, return_inverse=True)
    x, y = place[: len(place) // 2], place[len(place) // 2 :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for at in (x, y, label[x], label[y]):
            np.minimum.at(new, at, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "root"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root) with the smallest node as root.

    Large-star and small-star rounds until the stars stand still. Every round is aggregation and
    join on node ids, written to the shared scratch folder; nothing but a change count reaches the
    driver. Up to `few` edges, which is counted first, one task joins them up instead: that many fit
    any task and spare the rounds. Nodes without an edge to another node have no row.
    """
    now = written(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct()
    )
    if now.count() <= few:
        return written(now.coalesce(1).mapInArrow(_joined, "node long, root long"))
    seen = None
    while True:
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).union(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        small_least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(small_least, "v")
            .select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e"))
            .select("e.v", "e.u")
            .where("v <> u")
            .distinct()
        )
        now = written(small)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(
                now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
            )
        seen = tuple(mark)
