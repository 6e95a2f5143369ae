"""The review service as a data source, and exact rounding against Python's."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from placewise.functions.text import round_double, rounded
from placewise.sources import service



class Flaky(service.Folder):
    """Fails as often as its option says, counted in a file that its tasks share."""

    def __init__(self, options):
        super().__init__(options)
        self.log, self.fails = options["log"], int(options["fails"])

    def search(self, *args):
        with open(self.log, "a") as f:
            f.write("x")
        if len(open(self.log).read()) <= self.fails:
            raise ConnectionError("the service is busy")
        yield from super().search(*args)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("service") / "reviews")
    rows = [("Cafe One", p, f"u{p}", 4.0, f"text {p}") for p in range(30)] + [("cafe two", p, "v", None, None) for p in range(50)] + [("Bar", 1, "w", 1.0, "only one")]
    spark.createDataFrame(rows, "place_id string, pos long, name string, stars double, text string").write.partitionBy("place_id").parquet(path)
    service.register(spark)
    return path


def asked(spark, path, queries, **options):
    return spark.read.format("reviews").options(path=path, queries=json.dumps(queries), **options).load()


def test_limits_and_order(spark, folder):
    found = asked(spark, folder, ["cafe", "place_id: Bar", "nowhere", " cafe ", ""], max_reviews=3)
    assert found.schema.simpleString() == spark.createDataFrame([], service.SCHEMA).schema.simpleString()
    rows = sorted((r.query, r.place_id, r.reviews_count, r.nth, r.pos) for r in found.collect())
    assert rows == [("cafe", "Cafe One", 30, n, 30 - n) for n in (1, 2, 3)] + [("cafe", "cafe two", 50, n, 50 - n) for n in (1, 2, 3)] + [("place_id: Bar", "Bar", 1, 1, 1)]
    one = asked(spark, folder, ["cafe"], max_places=1, order="oldest", max_reviews=2).collect()
    assert [(r.place_id, r.pos) for r in one] == [("cafe two", 0), ("cafe two", 1)]
    assert found.where(F.col("query") == "cafe").count() == 6 and found.count() == 7  # one relation under two plans
    assert asked(spark, folder, []).count() == 0


def test_a_partition_for_each_query(spark, folder):
    assert asked(spark, folder, ["cafe", "Bar", "x"]).rdd.getNumPartitions() == 3
    assert [service.places_of(q) for q in ("https://x", "place_id:1", "Bar, Town")] == [1, 1, 5]


def test_failures_are_tried_again(spark, folder, tmp_path):
    options = {"client": "tests.test_service:Flaky", "fails": 2}
    assert asked(spark, folder, ["Bar"], retries=2, log=str(tmp_path / "a"), **options).count() == 1
    with pytest.raises(Exception, match="unable to collect the reviews of 'Bar': the service is busy"):
        asked(spark, folder, ["Bar"], retries=1, log=str(tmp_path / "b"), **options).count()


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 6])
def test_rounding_is_python_s(spark, digits):
    rng = random.Random(digits)
    values = [2.675, 0.125, 4.25, -4.35, 1e15 + 0.3, 0.0, -0.4, 1e300, float("inf"), 2**52 + 0.5, (2**52 + 1) / 100, (2**53 - 1) / 1000, 5e-324, -2.5, 1.0000005]
    values += [rng.randrange(10**6) / 1000 for _ in range(3000)] + [rng.randrange(10**6) / 8 for _ in range(1000)] + [rng.randrange(2**52, 2**53) / 10 ** rng.randrange(4) for _ in range(1000)] + [-(k + 0.5) / 100 for k in range(500)]
    df = spark.createDataFrame([(x,) for x in [*values, None]], "x double")
    got = [r[0] for r in df.select(round_double(F.col("x"), digits)).collect()]
    assert got == [x if x in (None, float("inf")) else round(x, digits) for x in [*values, None]]
    assert str(spark.createDataFrame([(float("nan"),)], "x double").select(round_double(F.col("x"), digits)).first()[0]) == "nan"


def test_rounding_of_sums_in_any_order(spark):
    noisy = [0.1 + 0.2 + 3.825, 3.825 + 0.2 + 0.1, 4.125, 4.125000000000001]
    df = spark.createDataFrame([(x,) for x in noisy], "x double")
    assert {r[0] for r in df.select(rounded(F.col("x"), 2)).collect()} == {4.12}
