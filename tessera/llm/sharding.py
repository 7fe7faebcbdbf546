"""Sharding by jump consistent hashing.

A row's shard follows from its doc_id and the number of shards alone; with one
more shard a row either stays or moves into the new one. Slots number the rows
of a shard without gaps: each task numbers its own rows of each shard as it
reads them, the result is written, and the few counts by task and shard are
summed up to offsets. Nothing is sorted or grouped by key, so neither a hot
doc_id nor repeated rows weigh on one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import small_enough, written

_MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Offsets (24 bytes each, one a task and shard) of up to so many rows are broadcast.
BROADCAST_ROWS = 200_000


def jump(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Jump hash of 64-bit keys to ``shards`` shards, and to one more."""
    keys = keys.astype(np.int64).view(np.uint64).copy()
    now = np.zeros(len(keys), dtype=np.int64)
    at, grown = now.copy(), now.copy()
    live = np.arange(len(keys))
    while len(live):
        at[live] = np.where(now[live] < shards, now[live], at[live])
        grown[live] = now[live]
        keys[live] = keys[live] * np.uint64(2862933555777941757) + np.uint64(1)
        now[live] = ((grown[live] + 1) * (float(1 << 31) / ((keys[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[now[live] <= shards]
    return at, grown


def _number(shards: int):
    """Replaces the key, the last column, by shard, grown shard, task and number within task and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(shards, dtype=np.int64)
        for batch in batches:
            at, grown = jump(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), shards)
            order = np.argsort(at, kind="stable")
            counts = np.bincount(at, minlength=shards)
            row = np.empty(len(at), dtype=np.int64)
            row[order] = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen += counts
            made = (pa.array(at.astype(np.int32)), pa.array(grown.astype(np.int32)), pa.array(np.full(len(at), task, dtype=np.int32)), pa.array(row))
            yield pa.record_batch([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "shard", "grown_shard", "__task", "__row"])

    return run


def shard_documents(docs: DataFrame, shards: int = 16, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (default: all) with size, text_crc32, law ('key'), shard, slot and grown_shard.

    size is the text's UTF-8 bytes plus 1 (null: none, crc32 of nothing is 0).
    A null doc_id is a key of its own. Repeated rows get slots of their own.
    Slots follow the order in which the rows are read. Columns of the made names
    or beginning with __ are dropped from the input. An empty table gives no rows.
    """
    columns = [c for c in columns or docs.columns if c not in _MADE and not c.startswith("__")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    placed = docs.select(*columns, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(F.col("doc_id").cast("long")).alias("__key"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields[:-1]), "shard int, grown_shard int, __task int, __row long"])
    placed = written(placed.mapInArrow(_number(shards), schema), "placed")
    counts = placed.groupBy("shard", "__task").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(counts.select("shard", "__task", before.alias("__before")), "offsets")
    offsets = F.broadcast(offsets) if small_enough(offsets, BROADCAST_ROWS) else offsets
    slot = (F.col("__before") + F.col("__row")).alias("slot")
    return placed.join(offsets, ["shard", "__task"]).select(*columns, "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")
