"""A cache of reports that is written in generations.

Reports lie in buckets by place. An upsert writes the buckets it touches anew, into a folder of its own, and then names them in the
next manifest, which appears by one rename; so readers see all of an upsert or nothing, a run that dies leaves what was
there, and of two writers at once the later one fails and can run again. Folders that no recent manifest names are pruned.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.functions.session import cut
from placewise.functions.text import slug
from placewise.sources.readers import CACHE_DAYS

BUCKETS = 64
#: Manifests that stay readable when the cache is pruned.
KEPT = 3
SCHEMA = "place_id string, slug string, generated_at timestamp, report string"


class Conflict(RuntimeError):
    """Another writer has made the next generation meanwhile."""


class ReportCache:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm = spark._jvm.org.apache.hadoop
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # the store

    def _at(self, name: str):
        return self._jvm.fs.Path(f"{self.path}/{name}")

    def _store(self):
        return self._at("").getFileSystem(self._conf)

    def _list(self, name: str) -> list[str]:
        store, path = self._store(), self._at(name)
        return sorted(x.getPath().getName() for x in store.listStatus(path)) if store.exists(path) else []

    def generations(self) -> list[int]:
        return [int(x.split(".")[0]) for x in self._list("manifests") if x.endswith(".json")]

    def _manifest(self, generation: int) -> dict[str, str]:
        """The folder of each bucket that has reports."""
        if not generation:
            return {}
        stream = self._store().open(self._at(f"manifests/{generation:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _switch(self, generation: int, manifest: dict[str, str]) -> None:
        store, draft = self._store(), self._at(f"drafts/{uuid.uuid4().hex}")
        stream = store.create(draft)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        final = self._at(f"manifests/{generation:012d}.json")
        store.mkdirs(final.getParent())
        context = self._jvm.fs.FileContext.getFileContext(store.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.fs.Options.Rename, 0)
        try:
            context.rename(store.makeQualified(draft), store.makeQualified(final), none)  # fails if it is there
        except Exception as failure:
            store.delete(draft, False)
            if store.exists(final):
                raise Conflict(f"generation {generation} of {self.path} exists") from failure
            raise

    # reports

    def _bucket(self, place: str = "place_id") -> Column:
        return F.pmod(F.xxhash64(place), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict[str, str]) -> DataFrame:
        folders = sorted(set(manifest.values()))
        if not folders:
            return self.spark.createDataFrame([], f"{SCHEMA}, bucket int")
        parts = [self.spark.read.option("basePath", f"{self.path}/data/{f}").parquet(*(f"{self.path}/data/{f}/bucket={b}" for b, of in manifest.items() if of == f)) for f in folders]
        return reduce(DataFrame.unionByName, parts)

    def read(self, generation: int | None = None) -> DataFrame:
        """(place_id, slug, generated_at, report) of the latest generation, or of one that is still there."""
        last = max(self.generations(), default=0) if generation is None else generation
        return self._rows(self._manifest(last)).drop("bucket")

    def fresh(self, wanted: DataFrame, now: Column, days: int = CACHE_DAYS) -> DataFrame:
        """The reports of wanted places (place_id) that are less than so many days old."""
        recent = self.read().where(F.col("generated_at") > now - F.make_interval(days=F.lit(days)))
        return recent.join(wanted.select("place_id").distinct(), "place_id", "left_semi")

    def upsert(self, reports: DataFrame) -> int:
        """Puts reports (place_id, generated_at, report) in place of those of the same places: the latest, if there are several. Returns the generation."""
        last = max(self.generations(), default=0)
        named = reports.select("place_id", slug(F.col("place_id")).alias("slug"), F.col("generated_at").cast("timestamp").alias("generated_at"), F.col("report").cast("string").alias("report"))
        latest = named.groupBy("place_id").agg(F.max_by(F.struct("slug", "generated_at", "report"), F.struct("generated_at", "report")).alias("r"))
        new = cut(latest.select("place_id", "r.*").withColumn("bucket", self._bucket()))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        if not touched:
            return last
        before = self._manifest(last)
        stay = self._rows({b: f for b, f in before.items() if int(b) in touched}).join(new.select("place_id"), "place_id", "left_anti")
        folder = uuid.uuid4().hex
        stay.unionByName(new).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        self._switch(last + 1, before | {str(b): folder for b in touched})
        return last + 1

    def prune(self, kept: int = KEPT) -> list[str]:
        """Removes older manifests than the last ones, and folders that none of those name; no upsert may be under way."""
        store, generations = self._store(), sorted(self.generations())
        for old in generations[:-kept]:
            store.delete(self._at(f"manifests/{old:012d}.json"), False)
        used = {f for g in generations[-kept:] for f in self._manifest(g).values()}
        gone = [f for f in self._list("data") if f not in used]
        for f in gone:
            store.delete(self._at(f"data/{f}"), True)
        return gone
