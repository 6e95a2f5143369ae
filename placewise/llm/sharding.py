"""Uniform sharding with exact shard sizes, by a hypergeometric communication matrix.

A uniform shuffle sends a random number of each input partition's rows to each shard. That matrix is drawn exactly:
shard sizes are fixed (counts at most one apart), and the range of partitions is halved again and again, the room in each
shard being split between the halves by the multivariate hypergeometric law. The draws of a halving depend on the seed and
the range alone, so each task draws its own row of the matrix, and nobody holds the whole. Each partition then
permutes its labels locally, rows are exchanged by shard and by a random block within the shard, and each block is
permuted again. Random blocks with uniform order inside make the whole order uniform; a block aims at BLOCK_ROWS rows and
BLOCK_BYTES of strings at most, so it is one task's sort however large a shard is.

All draws depend on seed and partition only and the input is kept in the shared folder first, so a task that runs
again after a loss gives the same rows. The driver holds a number for each partition, and that is all.

Law: `rows`. Equal texts are rows like any other and go where the shuffle takes them: a group as large as a third of
the table couldn't stay together under this law. Defined results: a null text has size 1 and the checksum of no
bytes; repeated rows each take a place of their own; an empty table gives no rows; texts of any length move whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewise.llm._common import cut, fresh

#: What a block aims at.
BLOCK_ROWS = 50_000
BLOCK_BYTES = 8 << 20


def shard_sizes(n_rows: int, n_shards: int, seed: int) -> np.ndarray:
    """Sizes at most one apart; which shards get one more is random."""
    sizes = np.full(n_shards, n_rows // n_shards, np.int64)
    sizes[np.random.default_rng([seed, 0]).permutation(n_shards)[: n_rows % n_shards]] += 1
    return sizes


def matrix_row(before: np.ndarray, sizes: np.ndarray, seed: int, at: int) -> np.ndarray:
    """How many rows of partition `at` go to each shard. before: the rows ahead of each partition, and last of all."""
    low, high, room = 0, len(before) - 1, sizes.astype(np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        first = _split(np.random.default_rng([seed, 1, low, high]), room, int(before[mid] - before[low]))
        low, high, room = (low, mid, first) if at < mid else (mid, high, room - first)
    return room


def _split(rng: np.random.Generator, room: np.ndarray, drawn: int) -> np.ndarray:
    """How many of `drawn` places, taken at random from all, each shard's room gives."""
    out, below = np.zeros_like(room), int(room.sum())
    for j, r in enumerate(room.tolist()):  # one shard after another: exact at any size
        below -= r
        out[j] = _hypergeometric(rng, r, below, drawn)
        drawn -= int(out[j])
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    if not drawn or not good:
        return 0
    if not bad:
        return drawn
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, drawn))
    # beyond the library's range: weights around the mode from the exact ratios of neighbouring probabilities
    mode = (drawn + 1) * (good + 1) // (good + bad + 2)
    wide = 40 + int(12 * (drawn * (good / (good + bad)) * (bad / (good + bad))) ** 0.5)
    k = np.arange(max(0, drawn - bad, mode - wide), min(good, drawn, mode + wide) + 1, dtype=np.float64)
    steps = np.log(good - k[:-1]) + np.log(drawn - k[:-1]) - np.log(k[1:]) - np.log(bad - drawn + k[1:])
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.exp(logs - logs.max())
    return int(rng.choice(k, p=weights / weights.sum()))


def shuffle(df: DataFrame, n_shards: int, seed: int = 42, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df with a struct column `placed` (shard int, slot long: gapless from 0 in each shard) at the end."""
    kept, names = cut(df), df.columns
    part = fresh(kept, "part")
    n_bytes = sum((F.coalesce(F.octet_length(kept[c]), F.lit(0)).cast("long") for c, t in kept.dtypes if t in ("string", "binary")), F.lit(0).cast("long"))
    counted = kept.groupBy(F.spark_partition_id().alias(part)).agg(F.count(F.lit(1)), F.sum(n_bytes)).collect()  # a row for each partition
    counts = np.zeros(1 + max((r[0] for r in counted), default=-1), np.int64)
    for r in counted:
        counts[r[0]] = r[1]
    before = np.concatenate([[0], np.cumsum(counts)])
    sizes = shard_sizes(int(before[-1]), n_shards, seed)
    wanted = max(int(before[-1]) / block_rows, sum(r[2] for r in counted) / block_bytes)
    n_blocks = max(1, math.ceil(wanted / n_shards))

    def labels() -> pa.StructArray:
        """Of all rows of the task's partition, however they come in batches."""
        at = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, 2, at])
        shards = np.repeat(np.arange(n_shards, dtype=np.int32), matrix_row(before, sizes, seed, at))
        rng.shuffle(shards)
        n = len(shards)
        return pa.StructArray.from_arrays([pa.array(shards), pa.array(rng.integers(0, n_blocks, n, dtype=np.int32)), pa.array(rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64))], ["shard", "block", "draw"])

    def labelled(fields: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, done = None, 0
            for batch in batches:
                own = labels() if own is None else own
                yield pa.RecordBatch.from_arrays([*batch.columns, own.slice(done, batch.num_rows)], fields)
                done += batch.num_rows

        return run

    label, shard, block, draw, rank, start, placed = (fresh(kept, x) for x in ("label", "shard", "block", "draw", "rank", "start", "placed"))

    def with_labels(rows: DataFrame) -> DataFrame:
        schema = rows.withColumn(label, F.lit(None).cast("struct<shard: int, block: int, draw: long>")).schema
        return rows.mapInArrow(labelled(schema.names), schema).select(*rows.columns, F.col(f"{label}.shard").alias(shard), F.col(f"{label}.block").alias(block), F.col(f"{label}.draw").alias(draw))

    sized = with_labels(kept.select(F.lit(0).alias(part))).groupBy(shard, block).agg(F.count(F.lit(1)).alias(rank))  # the same labels, without the rows
    ahead = Window.partitionBy(shard).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.select(shard, block, F.coalesce(F.sum(rank).over(ahead), F.lit(0)).alias(start))
    within = F.row_number().over(Window.partitionBy(shard, block).orderBy(draw)) - 1
    slotted = with_labels(kept).withColumn(rank, within).join(starts, [shard, block])
    return slotted.select(*names, F.struct(F.col(shard).alias("shard"), (F.col(start) + F.col(rank)).alias("slot")).alias(placed))
