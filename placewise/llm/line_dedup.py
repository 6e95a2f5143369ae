"""Line dedup with sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line stripped of ASCII white space with A-Z in lower case, held as its 128-bit XXH3 hash. A
LineIndex keeps three tables:

- postings: a row for each (key, document) once;
- references: for each key the exact number of documents that hold it and the largest doc_id among them;
- filters: for each shard of the key space a cuckoo filter over the keys that reach the threshold.

`insert` and `delete` change postings by whole documents, recount only the keys they touch, and insert into or delete
from the filters only the keys that cross the threshold; deleting what was inserted gives the first state back. Where a
shard's keys would fill its filter beyond FULL, the filters are built anew from the references, over as many shards
as the keys then ask for. When lines are dropped, each posting passes its own shard's filter, which sorts out the many
lines that can't repeat before anything is joined; the exact table then decides, so a false positive changes nothing.

Skew: a line that a third of the documents hold is counted by partial aggregation. Postings go to their shard's filter
by shard and a salt of the doc_id, with a copy of the filter for each salt, so that about GROUP_ROWS postings share one
copy; a task holds one filter at a time. The join with the reference table is one that adaptive execution can split.
Nothing is broadcast.

Defined results: a null text is one empty line; a null doc_id counts as one document, below all others; rows with
the same doc_id are one document; repeated lines within a document count once and share their fate; texts of any
length are split whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.llm._common import cut, fresh
from placewise.llm.cuckoo import CuckooFilter

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys of a shard at which a build aims; a filter takes some 5 bytes for each.
SHARD_KEYS = 250_000
#: Postings that share a copy of a filter.
GROUP_ROWS = 250_000
#: Share of a filter's slots beyond which the filters are built anew.
FULL = 0.85

_WHITE = b" \t\n\r\x0b\x0c"
_NO_ID = -(1 << 63)
_FILTERS = "shard long, slots long, filter binary"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> tuple[int, int] | None:
    """Two signed longs, or None for a line too short to count."""
    key = line.strip(_WHITE).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    digest = xxhash.xxh3_128_digest(key)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())


def _keys(batches: Iterable[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hi, lo = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), strict=True):
            found = {line_key(x, min_chars) for x in (text.as_py() or b"").split(b"\n")} - {None}
            ids += [doc_id] * len(found)
            for a, b in found:
                hi.append(a)
                lo.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["doc_id", "hi", "lo"])


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_NO_ID))


def _references(postings: DataFrame) -> DataFrame:
    return postings.groupBy("hi", "lo").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))


@dataclass(frozen=True)
class LineIndex:
    postings: DataFrame
    references: DataFrame
    filters: DataFrame
    n_shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        postings = cut(cls._read(docs, min_chars))
        references = cut(_references(postings))
        empty = docs.sparkSession.createDataFrame([], _FILTERS)
        return cls(postings, references, empty, 1, min_chars, min_docs)._rebuilt()

    def _hot(self) -> DataFrame:
        return self.references.where(F.col("n_docs") >= self.min_docs)

    def _rebuilt(self) -> LineIndex:
        """With filters made of the references."""
        bare = replace(self, filters=self.filters.where("false"), n_shards=1 + self._hot().count() // SHARD_KEYS)
        return replace(bare, filters=cut(bare._turn(self._hot().select("hi", F.lit(True).alias("add")))))

    @staticmethod
    def _read(docs: DataFrame, min_chars: int) -> DataFrame:
        narrow = docs.select(_id(F.col("doc_id")).alias("doc_id"), F.col("text").cast("string").alias("text"))
        return narrow.mapInArrow(lambda batches: _keys(batches, min_chars), "doc_id long, hi long, lo long").distinct()

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with docs in it too; what is in it already changes nothing."""
        new = cut(self._read(docs, self.min_chars).join(self.postings, ["doc_id", "hi", "lo"], "left_anti"))
        return self._recounted(cut(self.postings.unionByName(new)), new)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents whose doc_id ids has."""
        ids = ids.select(_id(F.col("doc_id")).alias("doc_id")).distinct()
        gone = cut(self.postings.join(ids, "doc_id", "left_semi"))
        return self._recounted(cut(self.postings.join(ids, "doc_id", "left_anti")), gone)

    def _recounted(self, postings: DataFrame, changed: DataFrame) -> LineIndex:
        touched = cut(changed.select("hi", "lo").distinct())
        old = self.references.join(touched, ["hi", "lo"], "left_semi")
        new = cut(_references(postings.join(touched, ["hi", "lo"], "left_semi")))
        hot = lambda df, name: df.select("hi", "lo", (F.col("n_docs") >= self.min_docs).alias(name))
        both = hot(old, "was").join(hot(new, "is"), ["hi", "lo"], "full").fillna(False, ["was", "is"])
        references = cut(self.references.join(touched, ["hi", "lo"], "left_anti").unionByName(new))
        out = replace(self, postings=postings, references=references)
        crossed = cut(both.where("was <> is").select("hi", F.col("is").alias("add")))
        return out._rebuilt() if out._overfull() else replace(out, filters=cut(out._turn(crossed)))

    def _overfull(self) -> bool:
        """Whether a shard's keys would fill its filter too much, or it has none yet."""
        shard = F.pmod("hi", F.lit(self.n_shards)).alias("shard")
        wanted = self._hot().groupBy(shard).agg(F.count(F.lit(1)).alias("n"))
        short = wanted.join(self.filters.select("shard", "slots"), "shard", "left").where(F.col("n") > FULL * F.coalesce("slots", F.lit(0)))
        return not short.isEmpty()

    def _turn(self, crossed: DataFrame) -> DataFrame:
        """The filters after adding or taking out the keys (hi, add)."""

        def turned(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            shard = int((keys if len(keys) else held)["shard"].iloc[0])
            own = CuckooFilter.from_bytes(held["filter"].iloc[0]) if len(held) else CuckooFilter(max(2 * len(keys), 1024))
            hashes = keys["hi"].to_numpy(np.int64)
            add = keys["add"].to_numpy(bool)
            own.delete(hashes[~add])
            own.insert(hashes[add])
            return pd.DataFrame({"shard": [shard], "slots": [own.slots], "filter": [own.to_bytes()]})

        sharded = crossed.withColumn("shard", F.pmod("hi", F.lit(self.n_shards)))
        return sharded.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(turned, _FILTERS)

    def _candidates(self) -> DataFrame:
        """Postings that may be of a key at the threshold: all that are, and few others."""
        n_salts = max(1, round(self.postings.count() / (self.n_shards * GROUP_ROWS)))
        nothing = F.lit(None).cast("binary")
        at = (F.pmod("hi", F.lit(self.n_shards)).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(n_salts)).alias("salt"))
        posted = self.postings.select(*at, F.lit(1).alias("kind"), "doc_id", "hi", "lo", nothing.alias("filter"))
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_salts - 1).cast("long"))).alias("salt")
        copies = self.filters.select("shard", salts, F.lit(0).alias("kind"), *(F.lit(0).cast("long").alias(c) for c in ("doc_id", "hi", "lo")), "filter")
        together = posted.unionByName(copies).repartition(self.n_shards * n_salts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")

        def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each filter comes ahead of its postings; a shard without one has no key at the threshold."""
            own, of = CuckooFilter(1), -1
            for batch in batches:
                shards, hi, n = batch.column(0).to_numpy(), batch.column(4).to_numpy(), batch.num_rows
                may, begin = np.zeros(n, bool), 0
                for end in [*np.flatnonzero(batch.column(2).to_numpy() == 0).tolist(), n]:
                    may[begin:end] = (shards[begin:end] == of) & own.contains(hi[begin:end])
                    if end < n:
                        own, of = CuckooFilter.from_bytes(batch.column(6)[end].as_py()), int(shards[end])
                    begin = end + 1
                yield batch.select(["doc_id", "hi", "lo"]).filter(pa.array(may))

        return together.mapInArrow(sift, "doc_id long, hi long, lo long")

    def drops(self) -> DataFrame:
        """(doc_id, hi, lo) of the lines to drop: keys of min_docs documents or more, but for the largest doc_id."""
        hot = self._hot().select("hi", "lo", "keeper")
        return self._candidates().join(hot, ["hi", "lo"]).where("doc_id <> keeper").select("doc_id", "hi", "lo")

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with text less the dropped lines, and a struct column `lines` (n_lines, n_dropped) at the end."""
        names, drop_col, lines_col = docs.columns, fresh(docs, "drop"), fresh(docs, "lines")
        key_col = fresh(docs, "key")
        gone = self.drops().groupBy(F.col("doc_id").alias(key_col)).agg(F.collect_list(F.struct("hi", "lo")).alias(drop_col))
        joined = docs.withColumn("text", F.col("text").cast("string")).withColumn(key_col, _id(F.col("doc_id"))).join(gone, key_col, "left").select(*names, drop_col)
        schema = docs.withColumn("text", F.col("text").cast("string")).withColumn(lines_col, F.lit(None).cast("struct<n_lines: long, n_dropped: long>")).schema
        at, min_chars = names.index("text"), self.min_chars

        def strip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, n_lines, n_dropped = [], [], []
                for text, drop in zip(_bytes(batch.column(at)), batch.column(len(names)), strict=True):
                    lines = (text.as_py() or b"").split(b"\n")
                    bad = {(x["hi"], x["lo"]) for x in drop.as_py() or ()}
                    kept = [x for x in lines if line_key(x, min_chars) not in bad] if bad else lines
                    texts.append(b"\n".join(kept).decode())
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                columns = list(batch.columns[: len(names)])
                columns[at] = pa.array(texts, batch.column(at).type)
                counts = pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["n_lines", "n_dropped"])
                yield pa.RecordBatch.from_arrays([*columns, counts], [*names, lines_col])

        return joined.mapInArrow(strip, schema)


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs (columns doc_id, text and any others) less repeated lines, with a struct column of counts at the end."""
    return LineIndex.build(docs, min_chars, min_docs).apply(docs)
