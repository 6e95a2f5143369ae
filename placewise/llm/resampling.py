"""Importance resampling to a target distribution by an external sort-count over hashed n-grams.

Features are the runs of one to two consecutive words; each falls into one of BUCKETS buckets by its CRC-32. One pass over
the texts writes each partition's bucket numbers as packed 16-bit streams, beside the number of features of each
document, to the shared folder. Counting sorts a stream and run-length encodes it; a task adds up its runs, so it sends
at most BUCKETS rows on. The gain of a bucket is the scaled log ratio of its smoothed shares in the target and in the
documents. The streams are then read again: gains are gathered by bucket number and summed for each document with
np.add.reduceat, whose segments are the documents. Texts are neither read twice nor shuffled.

A document's weight is its floored mean gain; Gumbel noise from its id makes the highest scores a weighted draw without
replacement. Ranks come of a range sort and the row counts of its partitions, so no task sees all rows. What the driver
holds are BUCKETS gains and one count for each partition.

Defined results: words are runs of a-z, 0-9 and all characters beyond ASCII, after A-Z are lower-cased; a null or
word-less text has no features, weight 0 and (as any text under MIN_WORDS words) no rank; texts of any length count
whole; repeated rows score alike and take neighbouring ranks; a null doc_id counts as an empty one in the noise and comes
last among ties; without target features all counts of the target are 0; an empty table gives no rows; columns other than
doc_id and text don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.llm._common import cut, shared_path

BUCKETS = 10_000  # at most 65,536, as streams are of 16 bits
MIN_WORDS = 20
PERCENT = 25
SEED = 7
SCALE = 1000
_CHUNK = 1 << 20  # features after which a stream is closed; a document stays in one
_SPACE = zlib.crc32(b" ")
#: Bytes to what they count as: letters in lower case, digits and bytes beyond ASCII as they are, all others a space.
_FOLD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_ROW_TYPE = "doc_ids array<long>, sizes array<long>, stream binary"


def _crc_table() -> np.ndarray:
    """What each low byte adds to the register when a byte is shifted out."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def features(text: bytes | None, n_buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every run of one word, then of every run of two, in the order of the text."""
    words = (text or b"").translate(_FOLD).split()
    ones = list(map(zlib.crc32, words))
    crcs = np.array(ones, np.uint32)
    # the register of a word and a space, for all words at once; the second word continues from there
    spaced = ~(_CRC[(~crcs ^ np.uint32(32)) & 255] ^ (~crcs >> 8))
    twos = np.array(list(map(zlib.crc32, words[1:], spaced.tolist())), np.uint32)
    return (np.concatenate([crcs, twos]) % np.uint32(n_buckets)).astype(np.uint16)


def _packed(batches: Iterable[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    found: list[np.ndarray] = []

    def closed() -> pa.RecordBatch:
        sizes = [len(x) for x in found]
        whole = np.concatenate(found).astype("<u2").tobytes()
        row = [pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([whole], pa.binary())]
        return pa.RecordBatch.from_arrays(row, ["doc_ids", "sizes", "stream"])

    total = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            found.append(features(text.as_py(), n_buckets))
            total += len(found[-1])
            if total >= _CHUNK or len(ids) >= _CHUNK:
                yield closed()
                ids, found, total = [], [], 0
    if ids:
        yield closed()


def streams(docs: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """(doc_ids, sizes, stream): documents of a row, how many features each has, and their buckets, packed; kept in the shared folder."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.encode(F.col("text").cast("string"), "utf-8").alias("text"))
    path = shared_path(docs.sparkSession, "streams")
    narrow.mapInArrow(lambda batches: _packed(batches, n_buckets), _ROW_TYPE).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _run_lengths(batches: Iterable[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(n_buckets, np.int64)
    for batch in batches:
        for stream in batch.column(0):
            ordered = np.sort(np.frombuffer(stream.as_py(), "<u2"))
            if len(ordered):
                starts = np.flatnonzero(np.diff(ordered, prepend=np.uint16(ordered[0] ^ 1)))
                counts[ordered[starts]] += np.diff(starts, append=len(ordered))
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], ["bucket", "n"])


def counts(packed: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all streams in each bucket that has any."""
    runs = packed.select("stream").mapInArrow(lambda batches: _run_lengths(batches, n_buckets), "bucket int, n long")
    return runs.groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(found: DataFrame, n_buckets: int) -> np.ndarray:
    dense = np.zeros(n_buckets)
    for row in found.collect():  # n_buckets rows at most
        dense[row["bucket"]] = row["n"]
    return dense


def gains(target: DataFrame, raw: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket the floored, scaled log ratio of its shares in two count tables, one added to each count."""
    t, s = _dense(target, n_buckets), _dense(raw, n_buckets)
    ratio = (t + 1) * (s.sum() + n_buckets) / ((s + 1) * (t.sum() + n_buckets))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def _gathered(batches: Iterable[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, sizes, stream in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            n = sizes.values.to_numpy(zero_copy_only=False)
            some = n > 0
            weight = np.zeros(len(n), np.int64)
            if some.any():
                starts = (np.cumsum(n) - n)[some]
                weight[some] = np.add.reduceat(gain[np.frombuffer(stream.as_py(), "<u2")], starts) // n[some]
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(n), pa.array(weight)], ["doc_id", "n_features", "weight"])


def weights(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight) of each document."""
    return packed.select("doc_ids", "sizes", "stream").mapInArrow(lambda batches: _gathered(batches, gain), "doc_id long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Scaled standard Gumbel noise: a function of the id alone."""
    digits = F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), F.lit(8))
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log(u)))


def ranked(weighted: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """weighted with score and rank: 1, 2, 3... over the drawn part of the documents with enough words, else null."""
    scored = weighted.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    enough = F.col("n_features") >= 2 * min_words - 1
    order = [F.desc("enough"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    dealt = scored.withColumn("enough", enough).repartitionByRange(*order).sortWithinPartitions(*order)
    low = F.monotonically_increasing_id()
    placed = cut(dealt.withColumn("part", F.shiftright(low, 33)).withColumn("at", low.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("enough").alias("able")).collect()  # a row for each partition
    drawn = percent * sum(r["able"] for r in sizes) // 100
    ahead, before = [], 0
    for r in sorted(sizes):
        ahead.append((r["part"], before))
        before += r["n"]
    offsets = weighted.sparkSession.createDataFrame(ahead, "part long, before long")
    rank = F.col("before") + F.col("at") + 1
    return placed.join(F.broadcast(offsets), "part").select(*weighted.columns, "score", F.when(rank <= drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, n_buckets: int = BUCKETS, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs (doc_id, text), drawn to be like target (text)."""
    packed = streams(docs, n_buckets)
    wanted = streams(target.select(F.lit(0).alias("doc_id"), "text"), n_buckets)
    gain = gains(counts(wanted, n_buckets), counts(packed, n_buckets), n_buckets)
    return ranked(weights(packed, gain), percent, min_words, seed)
