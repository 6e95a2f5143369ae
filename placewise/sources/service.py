"""A review service as a Spark data source: spark.read.format("reviews"), after register(spark).

A client answers a search with Arrow batches. The source plans one partition for each query and hands the limits and the order
on to the client. Filters stay Spark's: it plans a relation's partitions once, whichever of its plans reads them.

Options: client (`module:name` of a class that is called with the options), queries (a JSON list of texts), max_places and
max_reviews (of a query and of a place; places default by the kind of query), order (newest or oldest), retries (further attempts
of a search that fails, each after twice the wait of the one before).
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator, Mapping
from typing import Protocol

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "query string, place_id string, reviews_count bigint, nth int, pos bigint, name string, stars double, text string, publishedAtDate string, likesCount bigint"
#: Places that a search gives, by the kind of query.
PLACES = {"url": 1, "place_id": 1, "search": 5}
MAX_REVIEWS = 40
FIRST_WAIT = 0.5
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
ARROW_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split(" ") for x in SCHEMA.split(", "))])


class Client(Protocol):
    def search(self, query: str, max_places: int, max_reviews: int, order: str) -> Iterator[pa.RecordBatch]:
        """The newest or oldest reviews of the places that a query means, as ARROW_SCHEMA."""


class Folder:
    """A client over a folder of Parquet files with the reviews of each place in `place_id=...`; option path.

    A query means the places whose id begins with it, in any case; after `place_id:`, that place. The most reviewed come first.
    """

    def __init__(self, options: Mapping[str, str]):
        self.path = options["path"]

    def search(self, query: str, max_places: int, max_reviews: int, order: str) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        schema = pa.schema([("place_id", pa.string())])
        whole = ds.dataset(path, filesystem=store, format="parquet", partitioning=ds.partitioning(schema, flavor="hive"))
        exact, wanted = query.lower().startswith("place_id:"), query.removeprefix("place_id:").strip()
        names = {p for f in whole.get_fragments() for p in [ds.get_partition_keys(f.partition_expression).get("place_id")] if p is not None}
        found = [p for p in names if p == wanted] if exact else [p for p in names if p.lower().startswith(wanted.lower())]
        counts = {p: whole.count_rows(filter=pc.field("place_id") == p) for p in found}
        columns = [f.name for f in ARROW_SCHEMA if f.name in whole.schema.names]
        for place in sorted(found, key=lambda p: (-counts[p], p))[:max_places]:
            # only the columns that sort are read of all reviews; the rest of those that are asked for
            keys = whole.to_table(columns=["pos"], filter=pc.field("place_id") == place)["pos"]
            picked = pc.take(keys, pc.select_k_unstable(pa.table({"pos": keys}), min(max_reviews, len(keys)), [("pos", "descending" if order == "newest" else "ascending")]))
            rows = whole.to_table(columns=columns, filter=(pc.field("place_id") == place) & pc.field("pos").isin(picked))
            rows = rows.sort_by([("pos", "descending" if order == "newest" else "ascending")])
            added = {"query": pa.array([query] * len(rows), pa.string()), "reviews_count": pa.array([counts[place]] * len(rows), pa.int64()), "nth": pa.array(range(1, len(rows) + 1), pa.int32())}
            arrays = [added[f.name] if f.name in added else rows[f.name].cast(f.type).combine_chunks() if f.name in columns else pa.nulls(len(rows), f.type) for f in ARROW_SCHEMA]
            yield from pa.table(arrays, schema=ARROW_SCHEMA).to_batches(max_chunksize=4096)


class Search(InputPartition):
    def __init__(self, query: str):
        self.query = query


def places_of(query: str) -> int:
    lower = query.lower()
    return PLACES["url" if lower.startswith("http") else "place_id" if lower.startswith("place_id:") else "search"]


class Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.options = options
        self.queries = list(dict.fromkeys(q.strip() for q in json.loads(options.get("queries", "[]")) if q and q.strip()))

    def partitions(self) -> list[InputPartition]:
        return [Search(q) for q in self.queries]

    def read(self, partition: Search | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        module, _, name = self.options.get("client", "placewise.sources.service:Folder").partition(":")
        client: Client = getattr(importlib.import_module(module), name)(self.options)
        max_places = int(self.options.get("max_places") or places_of(partition.query))
        search = (partition.query, max_places, int(self.options.get("max_reviews") or MAX_REVIEWS), self.options.get("order", "newest"))
        retries = int(self.options.get("retries") or 0)
        for attempt in range(retries + 1):
            try:
                batches = list(client.search(*search))  # bounded by the limits; nothing goes out of a search that fails midway
                break
            except Exception as failure:
                if attempt == retries:
                    raise RuntimeError(f"unable to collect the reviews of {partition.query!r}: {failure}") from failure
                time.sleep(FIRST_WAIT * 2**attempt)
        yield from batches


class ReviewSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reviews"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    """So that spark.read.format("reviews") is known."""
    spark.dataSource.register(ReviewSource)
