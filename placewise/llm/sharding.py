"""Shards by jump consistent hashing, with gapless slots in every shard.

A key's shard depends on the key and the number of shards alone.  With one
shard more, a row stays or goes to the new shard; no table of a ring is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placewise.llm.common import hash60, ship, text_key, written

SHARDS = 40
#: Bytes counted for a row beside its text.
ROW_BYTES = 16
#: Fixed values of the published function: the multiplier of its 64-bit generator.
MULTIPLIER = 2862933555777941757


def jump_shards(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of every key with ``shards`` shards, and with one more."""
    state = keys.astype(np.uint64)
    at = np.zeros(len(keys), dtype=np.int64)
    now, grown = at.copy(), at.copy()
    live = np.arange(len(keys))
    # A key's jumps are the numbers of shards at which it moves to the newest.
    while len(live):
        state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        step = 2.0**31 / ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        at[live] = np.minimum((at[live] + 1) * step, 2.0**62).astype(np.int64)
        live = live[at[live] <= shards]
        grown[live] = at[live]
        fits = live[at[live] < shards]
        now[fits] = at[fits]
    return now, grown


def _places(keys: pd.Series, shards: pd.Series) -> pd.DataFrame:
    if not len(keys):
        return pd.DataFrame({"shard": pd.Series(dtype="int32"), "grown_shard": pd.Series(dtype="int32")})
    now, grown = jump_shards(keys.to_numpy(), int(shards.iloc[0]))
    return pd.DataFrame({"shard": now.astype("int32"), "grown_shard": grown.astype("int32")})


def _jump(key: Column, shards: Column) -> Column:
    return F.pandas_udf(_places, "struct<shard int, grown_shard int>")(key, shards)


def sharded(docs: DataFrame, shards: int = SHARDS, **carried: Column) -> DataFrame:
    """doc_id, size, the carried columns, shard, grown_shard, slot for every row.

    A null doc_id counts as empty text, so such rows share a shard; a null text
    has size 16.  Slots run from 0 in every shard in the order of doc_id (nulls
    first), then size; rows that tie in all that are interchangeable.  An empty
    table gives no row.

    Slots come from one range shuffle of short rows: each range numbers its
    rows, and the ranges' counts, one row per shard and range, shift them.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    place = _jump(hash60(text_key(F.col("doc_id"))), F.lit(shards))
    rows = ship(docs).select("doc_id", size.alias("size"), *[c.alias(n) for n, c in carried.items()], place.alias("_place"))
    flat = rows.select("doc_id", "size", *carried, "_place.shard", "_place.grown_shard")
    # The row number splits ranges where many rows share a doc_id.
    ordered = flat.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("shard", "doc_id", "size", "_row")
    ordered = ordered.sortWithinPartitions("shard", "doc_id", "size", "_row").drop("_row")
    numbered = written(ordered.mapInArrow(_number, _with(ordered, "_part int, _at long")), "numbered")
    counts = numbered.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("_n").over(earlier) - F.col("_n")
    # One row per range, and one more where a range spans two shards.
    shifts = written(counts.select("shard", "_part", before.alias("_before")), "shifts")
    return numbered.join(shifts, ["shard", "_part"]).select(
        "doc_id", "size", *carried, "shard", "grown_shard", (F.col("_at") + F.col("_before")).cast("long").alias("slot")
    )


def _with(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + more


def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, shard_now, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        at = np.zeros(len(shards), dtype=np.int64)
        for shard in np.unique(shards):
            here = np.flatnonzero(shards == shard)
            n = n if shard == shard_now else 0
            shard_now = shard
            at[here] = n + np.arange(len(here))
            n += len(here)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(shards), part, dtype=np.int32)), pa.array(at)],
            names=[*batch.schema.names, "_part", "_at"],
        )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes every row, all columns, into one folder per shard (``_shard=...``)."""
    place = _jump(hash60(text_key(F.col("doc_id"))), F.lit(shards))
    ship(docs).withColumn("_shard", place["shard"]).write.partitionBy("_shard").parquet(path)
