"""Ticket enrichment: cached column functions, exploded mentions, roll-ups and vocabulary health."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.web import input_hash
from tidewater.session import importable

MENTION = "struct<type:string,subject_id:string,subject:string,surface:string,sentiment:string,incidental:boolean,resolved:boolean>"
SHARE_LOW, SHARE_HIGH, FEW = 0.02, 0.40, 5


def with_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds input_hash over the columns' names and values as text, null as the empty text."""
    return df.withColumn("input_hash", input_hash({c: F.col(f"`{c}`") for c in columns}))


def computed_cells(df: DataFrame, columns: list[str], cache: DataFrame | None, compute: Callable[[dict], dict], fields: str) -> DataFrame:
    """Cells (input_hash, fields) for every distinct input: known ones from the cache, the others by compute, once each.

    compute maps the columns' texts to the fields; it runs in batches on the executors.
    """
    importable(df.sparkSession)
    inputs = with_hash(df, columns).select("input_hash", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns]).dropDuplicates(["input_hash"])
    fresh = inputs.join(cache.select("input_hash"), "input_hash", "left_anti") if cache is not None else inputs
    schema = f"input_hash string, {fields}"
    shape = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for b in batches:
            rows = b.to_pylist()
            out = [{"input_hash": r["input_hash"]} | compute({c: r[c] for c in columns}) for r in rows]
            yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(shape))

    made = fresh.mapInArrow(run, schema)
    return made.unionByName(cache.select(*made.columns)) if cache is not None else made


def materialised(df: DataFrame, columns: list[str], cells: DataFrame) -> DataFrame:
    """df with the cells' fields joined on; columns of the same names are replaced."""
    fields = [c for c in cells.columns if c != "input_hash"]
    bare = with_hash(df.drop(*fields), columns)
    return bare.join(cells, "input_hash", "left").drop("input_hash")


def mentions(df: DataFrame, key: str, column: str = "mentions") -> DataFrame:
    """The child table: one row per mention, with its ticket and its place."""
    return df.select(F.col(key).alias("ticket_id"), F.posexplode(column).alias("ordinal", "m")).select("ticket_id", "ordinal", "m.*")


def flags(column: str = "mentions") -> dict[str, Column]:
    """Columns of a ticket from its mentions; null where they were not extracted."""
    m = F.col(column)
    has = lambda test: F.when(m.isNotNull(), F.exists(m, test))
    return {
        "has_feedback": has(lambda x: x["type"] == "feedback"),
        "has_incidental": has(lambda x: x["incidental"]),
        "has_competitor": has(lambda x: x["type"] == "competitor"),
        "mention_count": F.when(m.isNotNull(), F.size(m)),
    }


def unresolved_surfaces(child: DataFrame) -> DataFrame:
    return child.where(~F.col("resolved")).groupBy("type", "surface").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "type", "surface")


def mention_summary(child: DataFrame) -> DataFrame:
    """Mentions, distinct tickets and shares by type and subject; an unresolved one goes by its surface, none at all goes."""
    name = F.coalesce("subject", "surface")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    rows = child.where(name.isNotNull()).groupBy("type", name.alias("subject"), "resolved").agg(
        F.count(F.lit(1)).alias("mentions"), F.count_distinct("ticket_id").alias("tickets"), share(F.col("sentiment") == "negative").alias("negative_share"),
        share(F.col("sentiment") == "positive").alias("positive_share"), share(F.col("incidental")).alias("incidental_share"),
    )
    return rows.orderBy(F.desc("mentions"), "type", "subject")


def ticket_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, value, count) of each of some columns."""
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.inline(parts)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def vocabulary_health(df: DataFrame, column: str, entries: DataFrame, other: str = "other") -> DataFrame:
    """Entries (name) with their use: count, share and a verdict: unused, few, small, large or fine."""
    total = df.where(F.col(column).isNotNull()).count()
    counts = df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("count"))
    rows = entries.select("name").join(counts, "name", "left").fillna(0, ["count"]).withColumn("share", F.col("count") / F.lit(max(1, total)))
    verdict = F.when(F.col("count") == 0, "unused").when(F.col("count") < FEW, "few").when(F.col("share") < SHARE_LOW, "small").when(F.col("share") > SHARE_HIGH, "large").otherwise("fine")
    return rows.withColumn("verdict", verdict).withColumn("is_other", F.col("name") == other)


def usage_by_language(df: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows, distinct cells and tokens by language; a cell counts once, for the language of its first row (by id)."""
    first = F.row_number().over(Window.partitionBy("input_hash").orderBy("id")) == 1
    rows = df.withColumn("_first", first).join(cells.select("input_hash", "tokens"), "input_hash", "left")
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("_first"), 1)).alias("cells"), F.coalesce(F.sum(F.when(F.col("_first"), F.col("tokens"))), F.lit(0)).alias("tokens"))


def evaluated(df: DataFrame, expected: str, found: str) -> DataFrame:
    """Precision and recall of sets of pairs, over all rows."""
    hit = F.size(F.array_intersect(expected, found))
    one = df.agg(F.sum(hit).alias("hits"), F.sum(F.size(F.array_distinct(found))).alias("found"), F.sum(F.size(F.array_distinct(expected))).alias("expected"))
    return one.select("hits", F.coalesce(F.try_divide("hits", "found"), F.lit(1.0)).alias("precision"), F.coalesce(F.try_divide("hits", "expected"), F.lit(1.0)).alias("recall"))
