"""Generations of the report cache: whole upserts or none, and runs that make only what isn't fresh."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.plans import analyze
from placewise.sources import schemas
from placewise.sources.cache import Conflict, ReportCache

REPORTS = "place_id string, generated_at string, report string"


def stamp(text):
    return F.lit(text).cast("timestamp")


def rows(cache, generation=None):
    return sorted((r.place_id, str(r.generated_at)[:10], r.report) for r in cache.read(generation).collect())


@pytest.fixture
def cache(spark, tmp_path):
    return ReportCache(spark, str(tmp_path / "cache"), buckets=3)


def test_upserts_replace_places(spark, cache):
    assert rows(cache) == [] and cache.upsert(spark.createDataFrame([], REPORTS)) == 0
    assert cache.upsert(spark.createDataFrame([(f"p{i}", "2024-01-01", "a") for i in range(20)] + [(None, "2024-01-01", "none")], REPORTS)) == 1
    assert cache.upsert(spark.createDataFrame([("p3", "2024-01-02", "b"), ("p3", "2024-01-03", "c"), ("new", "2024-01-02", "d")], REPORTS)) == 2
    found = {p: (d, r) for p, d, r in ((r.place_id, str(r.generated_at)[:10], r.report) for r in cache.read().collect())}
    assert len(found) == 22 and found["p3"] == ("2024-01-03", "c") and found["new"] == ("2024-01-02", "d") and found["p4"] == ("2024-01-01", "a")
    assert cache.read(1).count() == 21
    wanted = spark.createDataFrame([("p3",), ("p4",), ("gone",)], "place_id string")
    assert [r.place_id for r in cache.fresh(wanted, stamp("2024-01-08 00:00:00")).collect()] == ["p3"]  # p4 is seven days old


def test_a_run_that_dies_leaves_the_old_generation(spark, cache, monkeypatch):
    cache.upsert(spark.createDataFrame([("p", "2024-01-01", "a"), ("q", "2024-01-01", "a")], REPORTS))
    before = rows(cache)
    new = spark.createDataFrame([("p", "2024-01-02", "b")], REPORTS)
    with monkeypatch.context() as m:
        m.setattr(cache, "_switch", lambda *a: (_ for _ in ()).throw(OSError("died")))  # data written, manifest not
        with pytest.raises(OSError):
            cache.upsert(new)
    assert rows(cache) == before
    assert len(cache.prune()) == 1 and rows(cache) == before  # the orphan goes
    cache.upsert(new)
    assert ("p", "2024-01-02", "b") in rows(cache)


def test_of_two_writers_one_fails(spark, cache):
    cache.upsert(spark.createDataFrame([("p", "2024-01-01", "a")], REPORTS))
    cache._switch(2, cache._manifest(1))
    with pytest.raises(Conflict):
        cache._switch(2, {})
    assert rows(cache) == [("p", "2024-01-01", "a")]


def test_pruning_keeps_recent_generations(spark, cache):
    for day in range(1, 6):
        cache.upsert(spark.createDataFrame([("p", f"2024-01-0{day}", str(day))], REPORTS))
    cache.prune(kept=2)
    assert cache.generations() == [4, 5] and rows(cache, 4) == [("p", "2024-01-04", "4")] and rows(cache)[0][2] == "5"


def test_only_stale_places_are_analyzed(spark, cache, monkeypatch):
    review = lambda t: ("u", 5.0, t, "2024-01-01", 0)
    blank = (None,) * 12
    raw = spark.createDataFrame([(f"place {i}", *blank, False, [review(f"good place number {i}"), review("clean and friendly")]) for i in range(3)] + [("empty", *blank, False, [])], schemas.RAW_PLACE)
    raw = raw.withColumn("place_id", F.col("title"))
    asked: list[int] = []
    real = analyze.analyze

    def counted(these: DataFrame, **settings):
        asked.append(these.count())
        return real(these, **settings)

    monkeypatch.setattr(analyze, "analyze", counted)
    first = analyze.analyze_cached(raw, cache, stamp("2024-02-01 00:00:00"))
    assert {r.place_id: r.from_cache for r in first.collect()} == {"place 0": False, "place 1": False, "place 2": False, "empty": False}
    second = analyze.analyze_cached(raw, cache, stamp("2024-02-02 00:00:00"))
    assert {r.place_id: r.from_cache for r in second.collect()} == {"place 0": True, "place 1": True, "place 2": True, "empty": False}
    third = analyze.analyze_cached(raw.where("title <> 'empty'"), cache, stamp("2024-02-09 00:00:00"))
    assert not any(r.from_cache for r in third.collect()) and asked == [4, 1, 3]
