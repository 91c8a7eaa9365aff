"""Exact dedup by content sort: sampled splitters deal out the normalised bytes, a sort puts equals side by side.

The order is that of the leading bytes; texts that don't part there are put in order by a fingerprint,
so that splitters stay small. A fingerprint only orders: texts are equal when their bytes are, which
is found by comparing them in full, neighbours first, and over partitions at their borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import importable, neutral, partitions, tidy, written

#: Bytes of the normalised text that the splitters are made of; the fingerprint and the rank follow them.
LEAD = 64


def _fingerprint(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def _runs(body: int, mark: int):
    """Numbers the runs of equal texts of a sorted partition, from 0; a further row each for runs at its borders.

    Texts are compared in full in the column `body`, which goes no further but for the border rows.
    Texts of one fingerprint (column `mark`) that differ are held until the fingerprint changes. A
    border run is one whose fingerprint is the partition's first or last: its row has _run and _body only.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, bytes]] = []  # run and text of each text under the fingerprint `last`
        last, now, top, opening = None, -1, -1, True
        kept, names, types = [], [], []

        def border() -> pa.RecordBatch:
            n = len(group)
            return pa.RecordBatch.from_arrays(
                [*(pa.nulls(n, t) for t in types), pa.array([r for r, _ in group], pa.int64()), pa.nulls(n, pa.bool_()), pa.array([t for _, t in group], pa.binary())], names=names
            )

        for b in batches:
            if not b.num_rows:
                continue
            text, marks = b.column(body), b.column(mark)
            if not names:
                kept = [i for i in range(b.num_columns) if i != body]
                types = [b.schema.types[i] for i in kept]
                names = [*(b.schema.names[i] for i in kept), "_run", "_new", "_body"]
            follows = last is not None and marks[0].as_py() == last
            alike = np.concatenate(([follows], pc.equal(marks.slice(1), marks.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)))
            same = np.concatenate(([follows and group[-1][0] == now and text[0].as_py() == group[-1][1]], pc.equal(text.slice(1), text.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)))
            runs, new = np.empty(b.num_rows, np.int64), ~same
            if len(group) <= 1 and (alike == same).all():
                runs[:] = top + np.cumsum(new)
                changes = np.flatnonzero(~alike)
                if opening and last is not None and len(changes):
                    yield border()
                    opening = False
                if opening and len(changes) > 1:  # the first fingerprint ends in this batch
                    group = [(int(runs[0]), text[0].as_py())]
                    yield border()
                    opening = False
                if len(changes):
                    group = [(int(runs[-1]), text[int(changes[-1])].as_py())]
                now = top = int(runs[-1])
            else:
                for i in range(b.num_rows):
                    if not alike[i]:
                        if opening and last is not None:
                            yield border()
                            opening = False
                        group = []
                    last, whole = marks[i].as_py(), text[i].as_py()
                    now = next((r for r, t in group if t == whole), -1)
                    new[i] = now < 0
                    if now < 0:
                        now = top = top + 1
                        group.append((now, whole))
                    runs[i] = now
            last = marks[b.num_rows - 1].as_py()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(runs), pa.array(new), pa.nulls(b.num_rows, pa.binary())], names=names)
        if group:
            yield border()

    return run


def _content_sorted(df: DataFrame, key: str, text: str, whole: bool) -> DataFrame:
    """Rows in runs of equal texts, with _doc, _digest, _run, _new and _at (partition and place); df's own columns too, if whole.

    Border rows (_body set, see _runs) stand among them. One copy of the text is shuffled: the bare
    one, or with whole rows the original, stripped again behind the shuffle.
    """
    importable(df.sparkSession)
    full = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bare = F.regexp_replace(full, "[\\x20\\x09-\\x0D]", "").cast("binary")
    rows = df.withColumn("_text", bare).withColumn("_doc", F.col(f"`{key}`").cast("long")).withColumn("_rank", F.negative(F.length(full)))
    rows = rows.withColumn("_digest", _fingerprint(F.col("_text"))).withColumn("_lead", F.substring("_text", 1, LEAD))
    order = [F.col("_lead"), F.col("_digest"), F.col("_rank"), F.col("_doc").asc_nulls_last()]
    rows = rows.drop("_text") if whole else rows.select("_text", "_doc", "_rank", "_digest", "_lead")
    dealt = rows.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order).drop("_lead", "_rank")
    if whole:
        dealt = dealt.withColumn("_text", bare)
    fields = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes if c != "_text")
    runs = dealt.mapInArrow(_runs(dealt.columns.index("_text"), dealt.columns.index("_digest")), f"{fields}, _run long, _new boolean, _body binary")
    return written(runs.withColumn("_at", F.monotonically_increasing_id()))


def _fates(runs: DataFrame) -> DataFrame:
    """A row for each run of a partition: its place, and the size, keeper and keeper's place of its whole group.

    Runs at borders are joined up by their texts; there are two a partition, but for fingerprints that collide.
    """
    part = F.shiftright("_at", 33).alias("_part")
    each = (
        runs.where("_body is null").groupBy(part, "_run")
        .agg(F.count(F.lit(1)).alias("_n"), F.min_by("_doc", "_at").alias("_head"), F.min("_at").alias("_first"))
    )
    borders = runs.where("_body is not null").select(part, "_run", "_body").distinct()
    ends = written(each.join(borders, ["_part", "_run"]))
    whole = ends.groupBy("_body").agg(F.sum("_n").alias("group_size"), F.min("_first").alias("_keep_at"), F.min_by("_head", "_first").alias("keep_id"))
    joined = written(ends.select("_part", "_run", "_body").join(whole, "_body").drop("_body"))
    fate = each.join(joined, ["_part", "_run"], "left").select(
        "_part", "_run", "_first", F.coalesce("group_size", "_n").alias("group_size"),
        F.coalesce("_keep_at", "_first").alias("_keep_at"), F.when(F.col("_keep_at").isNull(), F.col("_head")).otherwise(F.col("keep_id")).alias("keep_id"),
    )
    return written(fate)


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one per row of df, dropped ones too.

    Texts are equal when identical after deleting every space and control character of
    [\\x20\\x09-\\x0D]; null counts as empty. Of equal texts the row with most code points in its
    original text stays, then the smallest key (null keys last); of rows that tie in both, one is
    kept. Other columns of df are ignored; an empty df gives no rows.

    Plan: splitters sampled from (leading bytes, fingerprint, rank) deal the rows out by range, so a
    text that a third of all rows share spreads over many partitions; each is sorted externally, and
    a stream compares neighbours in full. A run that goes on in the next partition is joined up by
    its text, of which each partition sends its first and its last.
    """
    runs = _content_sorted(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "key", "text", whole=False)
    fate = _fates(runs)
    rows = runs.where("_body is null").withColumn("_part", F.shiftright("_at", 33)).join(fate.hint("merge"), ["_part", "_run"])
    return rows.select(
        F.col("_doc").alias("doc_id"), "keep_id", "group_size", (F.col("_at") == F.col("_keep_at")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256")
    )


def drop_exact(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each group of equal texts, by the rules of exact_groups; all its columns.

    Rows travel whole through the content sort. A run's first row stays unless its group began in
    an earlier partition; there are at most as many of those as partitions.
    """
    plain, names = neutral(df)
    runs = _content_sorted(plain, names[key], names[text], whole=True)
    late = _fates(runs.select("_doc", "_run", "_at", "_body")).where("_first <> _keep_at").select(F.col("_first").alias("_late"))
    kept = runs.where("_new").join(written(late), F.col("_at") == F.col("_late"), "left_anti")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
