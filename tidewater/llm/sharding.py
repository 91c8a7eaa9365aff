"""Sharding by jump consistent hashing: a stable key and the shard count decide, no ring table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import importable, numbered, tidy

SHARDS = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key, by Lamping and Veach's jump rule.

    A key's shard changes from n to n + 1 shards only by moving to the new shard n.
    """
    state = keys.astype(np.uint64)
    home = np.zeros(len(state), dtype=np.int64)
    ahead = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while len(live):
        home[live] = ahead[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        reach = (home[live] + 1) * (2147483648.0 / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))
        ahead[live] = reach.astype(np.int64)
        live = live[ahead[live] < shards]
    return home


def shard(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one per row of df.

    The law is `key`: key and shard count decide, and with one more shard rows move only into the
    new one (grown_shard). Size is the text's UTF-8 bytes plus 1; a null text counts as empty. Rows
    with equal keys, null keys among them, share a shard. Slots run from 0 without gaps in each
    shard, by key (null first), size and checksum. Other columns of df are ignored; an empty df
    gives no rows.
    """
    importable(df.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    narrow = df.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(F.col(f"`{key}`").cast("long")).alias("hash"),
    )

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(jump(keys, shards).astype(np.int32)), pa.array(jump(keys, shards + 1).astype(np.int32))],
                names=["doc_id", "size", "text_crc32", "shard", "grown_shard"],
            )

    placed = narrow.mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int, grown_shard int")
    out = numbered(placed, "shard", [F.col("doc_id"), F.col("size"), F.col("text_crc32")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
