"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import neutral, written

#: Weights that sources get in the order of their names, over and over.
WEIGHTS = (3, 1, 2)
#: Words that the mix takes, as a share of all words, and passes over a source at most.
SHARE, PASSES = 1.5, 2
#: Words in a block at least, and slots that the schedule is kept near.
LEAST_BLOCK, SLOTS = 1024, 1 << 20
#: 2**32 over the golden ratio, odd: i * GOLDEN mod 2**32 runs through all points once.
GOLDEN = 2654435769
SEED = "mix-1"
_WORD = "[^\\x20\\x09-\\x0D]+"


def sized(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (row, doc_id, source, size, place): words, and a place in the shuffled source from key and seed."""
    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
    )
    return rows.withColumn("place", F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))


def targets(sizes: DataFrame) -> DataFrame:
    """Rows (source, number, source_size, docs, target): words that the mix takes of each source.

    Weights go by code point order of the names, null last. The share is dealt by weight; a source
    stops at PASSES times its size and the rest is dealt again until none is above: with caps sorted
    by cap over weight, the level is (share - caps before) / weights from here on, at the first cap
    that the level doesn't pass. Sources are few rows; documents were summed map-side before.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    names = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    number = F.row_number().over(names) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (number % len(WEIGHTS) + 1).cast("int")).cast("long")
    cap = F.col("source_size") * PASSES
    order = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    return (
        by_source.withColumns({"number": number, "weight": weight, "cap": cap})
        .withColumn("total", F.sum("source_size").over(every) * SHARE)
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "number", "level"))).over(every)["level"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))))
        .select("source", "number", "source_size", "docs", "target")
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> dict[str, DataFrame]:
    """The schedule and what it takes.

    `slots`: (slot, number, source, rank, pass, block) in mix order; `pieces`: (number, start,
    doc_id, size, block, begin, length), the parts of documents in each block; `rows`: every
    document with its place; `blocks`: (number, block, pass, used), the words taken.

    Schedule: M slots are needed, one for each block-sized stretch of a target. Slot i stands at the
    point i * golden ratio mod 1, which falls into the source whose share of the M slots covers it;
    a source's k-th slot takes its k-th stretch. Golden-ratio points enter an interval of k / M at
    least k times in the first 2.62 M steps (three-gap theorem), so 3 M steps fill every source,
    and slots of full sources are passed over. Ranks are counted within chunks of slots and summed.
    """
    spark = df.sparkSession
    rows = written(sized(df, key, text, source))
    plan = targets(rows)
    block = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sum("target").over(Window.partitionBy(F.lit(1))) / SLOTS)).cast("long")
    words = F.round("target").cast("long")
    stretch = lambda x: F.floor((x + F.col("block_words") - 1) / F.col("block_words")).cast("long")
    plan = plan.withColumn("block_words", block).withColumn("words", F.least(words, F.col("source_size") * PASSES))
    plan = plan.withColumn("first_pass", F.least("words", "source_size")).withColumn("second_pass", F.col("words") - F.col("first_pass"))
    plan = plan.withColumn("first_slots", stretch(F.col("first_pass"))).withColumn("slots", F.col("first_slots") + stretch(F.col("second_pass")))
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    plan = plan.withColumn("to_slot", F.sum("slots").over(upto)).withColumn("all_slots", F.sum("slots").over(Window.partitionBy(F.lit(1))))
    plan = plan.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("docs") / 2000)).cast("long"))
    plan = written(plan.withColumn("from_slot", F.col("to_slot") - F.col("slots")))

    # Where each document begins in its shuffled source: sums over buckets of places, then within a bucket.
    head = plan.select(F.col("source").alias("_s"), "number", "source_size", "target", "block_words", "buckets")
    rows = rows.join(head, _same(F.col("source"), F.col("_s"))).drop("_s")
    spread = F.floor(F.conv(F.substring("place", 1, 7), 16, 10).cast("long") * F.col("buckets") / (1 << 28)).cast("long")
    rows = rows.withColumn("bucket", spread)
    sums = rows.groupBy(F.col("number").alias("_n"), F.col("bucket").alias("_b")).agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("_n").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("held").over(ahead), F.lit(0))).drop("held")
    own = Window.partitionBy("number", "bucket").orderBy("place", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0)))
    rows = rows.join(sums, (F.col("number") == F.col("_n")) & (F.col("bucket") == F.col("_b")))
    rows = written(rows.select("doc_id", "source", "size", "number", "source_size", "target", "block_words", (F.col("base") + F.col("within")).alias("start")))

    pieces = rows.where("size > 0").select(
        "number", "start", "doc_id", "size", "block_words",
        F.explode(F.sequence(F.floor(F.col("start") / F.col("block_words")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block_words")))).alias("block"),
    )
    low = F.greatest(F.col("start"), F.col("block") * F.col("block_words"))
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_words"))
    pieces = pieces.withColumn("begin", low).withColumn("length", high - low)

    steps = plan.agg(F.coalesce(F.max("all_slots"), F.lit(0))).first()[0]
    points = spark.range(3 * steps + 8).select(F.col("id").alias("slot"), ((F.col("id") % (1 << 31)) * GOLDEN % (1 << 32)).alias("point"))
    points = points.withColumn("at", F.floor(F.col("point") * F.lit(steps) / (1 << 32)).cast("long"))
    bins = plan.where("slots > 0").select("number", "source", "from_slot", "to_slot", "slots", "first_slots", "first_pass", "second_pass", "block_words")
    # Each slot position belongs to one source: an equi-join on coarse cells of positions, then the exact bounds.
    cell = max(1, steps // 4096)
    bins = bins.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from_slot") / cell), F.floor((F.col("to_slot") - 1) / cell))))
    drawn = points.withColumn("cell", F.floor(F.col("at") / cell)).join(bins, "cell").where("at >= from_slot and at < to_slot")
    drawn = written(drawn.withColumn("chunk", F.floor(F.col("slot") / 65536)).drop("cell", "at", "point"))
    counts = drawn.groupBy(F.col("chunk").alias("_c"), F.col("number").alias("_n")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("_n").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    local = F.row_number().over(Window.partitionBy("chunk", "number").orderBy("slot")) - 1
    ranked = drawn.withColumn("local", local).join(counts, (F.col("chunk") == F.col("_c")) & (F.col("number") == F.col("_n")))
    ranked = ranked.withColumn("rank", F.col("base") + F.col("local")).where("rank < slots")
    second = F.col("rank") >= F.col("first_slots")
    slots = ranked.withColumn("pass", second.cast("int")).withColumn("block", F.when(second, F.col("rank") - F.col("first_slots")).otherwise(F.col("rank")))
    # The words of the block that the slot takes: the last stretch of a pass may be cut.
    reach = F.when(second, F.col("second_pass")).otherwise(F.col("first_pass"))
    slots = slots.withColumn("until", F.least(reach, (F.col("block") + 1) * F.col("block_words")))
    return {"rows": rows, "pieces": pieces, "plan": plan, "slots": slots.select("slot", "number", "source", "rank", "pass", "block", "until")}


def mixed_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, first_slot, n_slots), one per row of df.

    Size is the number of words (null text: 0). first_slot is the place in the mix where a document's
    first words are taken, null if none are, and n_slots the number of slots that take some of its
    words. Documents without words are never taken; a null source is a source of its own; rows with
    equal keys stand side by side in the shuffle, by size. No document is taken more than PASSES
    times. Other columns are ignored; an empty df gives no rows.
    """
    made = mix(df, key, text, source)
    slots = made["slots"].select(F.col("number").alias("_n"), F.col("block").alias("_b"), "until", "slot")
    taken = (
        made["pieces"].join(slots.hint("merge"), (F.col("number") == F.col("_n")) & (F.col("block") == F.col("_b")))
        .withColumn("words", F.least(F.col("length"), F.col("until") - F.col("begin")))
        .where("words > 0")
        .groupBy(F.col("number").alias("_n"), F.col("start").alias("_start"))
        .agg(F.sum("words").cast("long").alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"))
    )
    rows = made["rows"].join(taken, (F.col("number") == F.col("_n")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), "first_slot", F.coalesce("n_slots", zero).alias("n_slots"))


def drawn(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """df as the mix takes it, with all its columns: each row as often as a slot takes its first word.

    Texts stay whole, so a source's words come near its target to within a document or two a pass.
    Rows without words are not drawn; rows that share a key are drawn alike, as often as the one
    drawn most.
    """
    made = mix(df, key, text, source)
    slots = made["slots"].select(F.col("number").alias("_n"), F.col("block").alias("_b"), "until")
    heads = made["pieces"].where("begin = start")
    times = (
        heads.join(slots.hint("merge"), (F.col("number") == F.col("_n")) & (F.col("block") == F.col("_b")))
        .where("until > begin")
        .groupBy("number", "start", "doc_id")
        .count()
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.max("count").cast("int").alias("_times"))
    )
    plain, names = neutral(df)
    rows = plain.join(written(times).hint("merge"), F.col(names[key]).cast("long").eqNullSafe(F.col("_doc")))
    return rows.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[F.col(n).alias(c) for c, n in names.items()])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS number,
         CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS total FROM s),
l AS (
  SELECT *, (total - CAST(coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
         / CAST(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM c),
f AS (
  SELECT min_by(level, cap::DOUBLE / weight) AS level FROM l WHERE level * weight <= cap),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(f.level * weight, cap::DOUBLE)) AS target
  FROM l LEFT JOIN f ON true),
w AS (
  SELECT *, least(CAST(round(target) AS BIGINT), 2 * source_size) AS words, row_number() OVER (ORDER BY source NULLS LAST) AS number,
         greatest(1024, CAST(ceil(sum(target) OVER () / 1048576) AS BIGINT)) AS b FROM t),
x AS (SELECT *, least(words, source_size) AS one, words - least(words, source_size) AS two FROM w),
y AS (SELECT *, (one + b - 1) // b AS ones, (one + b - 1) // b + (two + b - 1) // b AS slots FROM x),
z AS (SELECT *, CAST(sum(slots) OVER (ORDER BY number) AS BIGINT) AS upto, CAST(sum(slots) OVER () AS BIGINT) AS steps FROM y),
-- Golden-ratio points through the cumulative shares: the k-th point that falls to a source takes its k-th stretch.
g AS (SELECT i AS slot, (i * 2654435769 % 4294967296) * steps // 4294967296 AS spot FROM (SELECT max(steps) AS steps FROM z), range(3 * steps + 8) r(i)),
h AS (SELECT slot, z.*, row_number() OVER (PARTITION BY number ORDER BY slot) - 1 AS k FROM g JOIN z ON spot >= upto - slots AND spot < upto),
s2 AS (
  SELECT slot, number, b, CASE WHEN k < ones THEN k ELSE k - ones END AS block, CASE WHEN k < ones THEN one ELSE two END AS reach FROM h WHERE k < slots),
p AS (
  SELECT d.doc_id, d.size, z.source_size, z.target, z.number, z.b,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
         row_number() OVER () AS rid
  FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source),
e AS (SELECT rid, number, start, size, b, unnest(range(start // b, (start + size - 1) // b + 1)) AS block FROM p WHERE size > 0),
m AS (
  SELECT rid, slot, least(least(start + size, (e.block + 1) * e.b), least(reach, (e.block + 1) * e.b)) - greatest(start, e.block * e.b) AS words
  FROM e JOIN s2 ON e.number = s2.number AND e.block = s2.block),
n AS (SELECT rid, CAST(sum(words) AS BIGINT) AS taken, min(slot) AS first_slot, count(*) AS n_slots FROM m WHERE words > 0 GROUP BY rid)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, coalesce(taken, 0) AS taken, first_slot, coalesce(n_slots, 0) AS n_slots
FROM p LEFT JOIN n USING (rid)
"""
