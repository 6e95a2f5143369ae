"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it. Two fingerprints are
linked if they differ in at most DISTANCE = 2 bits. Cut into two segments of 32 bits, such a pair differs by at most
one bit in one of the segments, so both fingerprints share that segment with one bit deleted. Each distinct
fingerprint is indexed under its 64 one-wildcard segment variants; an equality join on variant finds the candidates,
whose full distance is then verified.

Copies collapse before the index (it holds distinct fingerprints), so a group of exact copies costs one entry. A
variant that exactly two fingerprints hold gives them as a pair. Those of a variant that more hold (chance meetings, at some
10^9 fingerprints) differ in at most two bits of the other segment, so they agree in one of its three blocks: variant
and block together are joined in the same way. What even then meets in crowds are clouds of fingerprints a few bits
apart, whose pairs would be quadratically many; they are linked through points at most one bit away: two fingerprints
within two bits have such a point in common, and no point has more than 65 fingerprints near it. All of that is
exact and bounded, so nothing is capped. Texts that are similar at lower likeness are the business of `similar`.

Defined results: a null or word-less text has fingerprint zero and is linked like any other; texts shorter than a
shingle have their whole word sequence as the only one; texts of any length count whole; repeated rows link; a null
doc_id never names a component unless all ids of the component are null; an empty table gives no rows; other columns,
whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.llm._common import cut
from placewise.llm.components import connected_components

DISTANCE = 2
SHINGLE = 3
SEED = 42
HOT = 1000
_CHUNK = 1 << 15
_HALF = 32
_BLOCKS = ((0, 11), (11, 11), (22, 10))  # of a segment: lowest bit and width


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of the words, A-Z in lower case, repeats included."""
    words = (text or b"").lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - size].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, size)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[i : i + _CHUNK], np.uint64)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _batches(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary() if pa.types.is_string(batch.column(1).type) else pa.large_binary())
        found = np.fromiter((fingerprint(t.as_py(), size) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of docs' columns doc_id and text; fp: the 64 bits as a signed long."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(lambda batches: _batches(batches, size), "doc_id long, fp long")


def _variants(fp: Column, at: Column) -> Column:
    """Signature number `at` (0 to 63) of fp: the segment of that bit, without that bit, under the bit's number."""
    low = fp.bitwiseAND(F.lit((1 << _HALF) - 1))
    segment = F.when(at < _HALF, low).otherwise(F.shiftrightunsigned(fp, _HALF))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % _HALF).cast("int"))
    return segment.bitwiseAND(F.bitwise_not(bit)).bitwiseOR(F.shiftleft(at.cast("long"), _HALF))


def _blocks(fp: Column, at: Column) -> list[Column]:
    """The three blocks of the segment that signature number `at` leaves out, each under its number."""
    other = F.when(at < _HALF, F.shiftrightunsigned(fp, _HALF)).otherwise(fp.bitwiseAND(F.lit((1 << _HALF) - 1)))
    return [F.shiftright(other, low).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(i << _HALF)) for i, (low, bits) in enumerate(_BLOCKS)]


def _near(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints: enough of them to connect all that are within DISTANCE bits."""
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # few bytes, many rows to come
    numbered = spread.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at"))
    index = numbered.select("fp", "at", _variants(F.col("fp"), F.col("at")).alias("sig"))
    met_by = lambda rows, *keys: rows.groupBy(*keys).agg(F.count("fp").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    verified = lambda df: df.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    shared = cut(met_by(index, "sig"))
    crowded = cut(index.join(shared.where("n > 2").select("sig"), "sig", "left_semi"))
    blocked = reduce(DataFrame.unionAll, (crowded.select("fp", "sig", b.alias("block")) for b in _blocks(F.col("fp"), F.col("at"))))
    refined = cut(met_by(blocked, "sig", "block"))
    pairs = verified(shared.where("n = 2").select("a", "b").unionByName(refined.where("n = 2").select("a", "b")).distinct())

    crowd = blocked.join(refined.where("n > 2").select("sig", "block"), ["sig", "block"], "left_semi").select("fp").distinct()
    bits = F.array(F.lit(0).cast("long"), *(F.lit(1 << j if j < 63 else -(1 << 63)).cast("long") for j in range(64)))
    around = crowd.select("fp", F.explode(bits).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("point"))
    met = around.groupBy("point").agg(F.sort_array(F.collect_set("fp")).alias("near")).where(F.size("near") > 1)
    stars = met.select(F.col("near")[0].alias("a"), F.explode("near").alias("b")).where("a <> b")
    return pairs.unionByName(verified(stars)).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id: the smallest doc_id that links reach."""
    found = cut(fingerprints(docs, size))
    nodes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    linked = connected_components(_near(nodes.select("fp"))).withColumnRenamed("node", "fp")
    linked = cut(linked.join(nodes.drop("n"), "fp"))
    least = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    named = linked.join(least, "label").select("fp", "component_id")
    per_fp = nodes.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"))
    # fewer than HOT fingerprints can have more than a share of 1 / HOT of all rows: those are broadcast, the rest joined
    hot = F.col("n") * HOT > found.count()
    common = F.broadcast(per_fp.where(hot).drop("n"))
    rest = found.join(common, "fp", "left_anti").join(per_fp.where(~hot).drop("n"), "fp")
    return found.join(common, "fp").unionByName(rest).select("doc_id", "fp", "component_id")
