"""Small literal relations that both engines read, as VALUES."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.sources import schemas

#: (place_id, idx, field, original_claim, corrected_claim, ids joined by commas)
CORRECTIONS = """
('1', 0, 'aspects.service', 'service 8', 'service is 2.5 of 10', 'r1'), ('1', 1, 'aspects.service', 'x', 'should be 2.9', 'r2'), ('1', 2, 'aspects.cleanliness', 'x', 'score 42', 'r2'),
('1', 3, 'sentiment', 'good', 'rather negative, not positive', 'r1,r2'), ('1', 4, 'keywords.positive', ' Fast ', 'not in the reviews', 'r1'), ('1', 5, 'guardrail.trust', 'x', 'trust is lower', 'r3,r4'),
('2', 0, 'aspects.ambience', 'x', '9.9 now', 'r1'), ('3', 0, 'sentiment.overall', 'bad', 'mostly Positive', 'r1'), ('3', 1, 'keywords.negative', 'slow', 'this is notable', 'r1'), ('3', 2, 'keywords.negative', 'rude', 'seen once', 'r1'),
('3', 3, 'aspects.food_quality', 'x', '0 of 10', ''), ('4', 0, 'sentiment', 'x', 'a mixed picture', 'r9'), ('5', 0, 'guardrail', 'x', 'first', 'r1'), ('5', 1, 'guardrail.fake', 'x', 'second', 'r2'), ('6', 0, 'sentiment', 'x', 'negative', 'r1')
"""
#: (place_id, verification_status, status, accuracy, hallucination_detected)
VERIFICATIONS = """
('1', 'CORRECTED', NULL, 0.8, false), ('2', 'PASS', NULL, 0.0, NULL), ('3', NULL, 'FAIL', 0.445, true), ('4', '', 'CORRECTED', NULL, false), ('5', 'FAIL', 'PASS', 0.5, NULL), ('6', 'UNAVAILABLE', NULL, NULL, NULL), ('7', NULL, NULL, NULL, NULL)
"""
#: (place_id, polarity, ord, keyword)
KEYWORDS = """
('1', 'positive', 1, 'fast'), ('1', 'positive', 2, 'Clean'), ('1', 'negative', 1, 'fast'), ('2', 'positive', 1, 'fast'), ('3', 'negative', 1, 'Slow'), ('3', 'negative', 2, 'rude'), ('3', 'positive', 1, 'slow')
"""
#: (place_id, ord, polarity, claim, aspect, ids joined by commas)
POINTS = """
('1', 0, 'positive', 'Service - quick and kind', NULL, 'r1,r3'), ('1', 1, 'positive', 'The rooms are large and very well lit all day', '', ''), ('1', 2, 'positive', 'Food', 'food_quality', 'r2'), ('1', 0, 'negative', 'Noise - at night', NULL, 'r4'),
('1', 1, 'negative', 'Queue', NULL, NULL), ('2', 30, 'positive', 'Late point', NULL, 'r9'), ('2', 0, 'negative', NULL, NULL, 'r1')
"""
#: (place_id, category, subtypes joined by bars)
CATEGORIES = """
('1', 'Barber shop', 'Barber shop|Hair salon'), ('2', 'Store', 'Food store|store|Bakery'), ('3', '', ''), ('4', 'Office', 'a|b|c|museum'), ('5', 'Zoo', 'x|y|z|u|v|w|t'), ('6', 'Art', 'ART|Gallery')
"""
#: (query, city, lat, lon)
REQUESTS = """
('https://example.org/p', '', 1.5, 2.5), ('place_id:abc', 'Bonn', 1.5, 2.5), ('PLACE_ID:x', NULL, NULL, NULL), ('Blue Cafe, Bonn', 'bonn', 50.75, 7.25), ('Old Mill a/b & c', 'Ulm', 0.0, 7.0), ('Zoo', 'Ulm', NULL, 3.5), ('A very long name of a place in town', 'Town', 10.5, 20.5)
"""
#: (short, full)
EXPANSIONS = """
('https://example.org/p', 'https://example.org/place/long'), ('Zoo', ''), ('other', 'https://example.org/o')
"""
#: (place_id, key, value)
MODELS = """
('1', 'model_a', 'big'), ('1', 'model_b', 'check'), ('2', 'sentiment_model', 'old'), ('2', 'verdict_model', 'say'), ('3', 'x', 'y')
"""
#: (id, raw)
ANSWERS = """
(1, '{"k": "v"}'), (2, '<think>no {"k": 1}</think> {"k": "v2"}'), (3, 'Here: {"k": "v3"} bye'), (4, '{"k": "v4", "l": [1, 2'), (5, '{"k": "v5'), (6, 'none'), (7, '```json
{"k": "v7"}
```'), (8, '{"k": {"m": "v8"'), (9, '} {'), (10, '')
"""


def _values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def _list(name: str, separator: str = ",") -> F.Column:
    return F.when(F.col(name) != "", F.split(name, separator)).when(F.col(name) == "", F.array().cast("array<string>"))


def corrections(spark: SparkSession) -> DataFrame:
    return _values(spark, CORRECTIONS, "place_id, idx, field, original_claim, corrected_claim, ids").withColumn("evidence_review_ids", _list("ids")).drop("ids")


def verifications(spark: SparkSession) -> DataFrame:
    rows = _values(spark, VERIFICATIONS, "place_id, verification_status, status, accuracy, hallucination_detected")
    return rows.withColumn("accuracy", F.col("accuracy").cast("double"))


def keywords(spark: SparkSession) -> DataFrame:
    return _values(spark, KEYWORDS, "place_id, polarity, ord, keyword")


def points(spark: SparkSession) -> DataFrame:
    return _values(spark, POINTS, "place_id, ord, polarity, claim, aspect, ids").withColumn("evidence_review_ids", _list("ids")).drop("ids")


def categories(spark: SparkSession) -> DataFrame:
    return _values(spark, CATEGORIES, "place_id, category, types").withColumn("subtypes", _list("types", r"\|")).drop("types")


def requests(spark: SparkSession) -> DataFrame:
    rows = _values(spark, REQUESTS, "query, city, lat, lon")
    return rows.withColumns({"lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double")})


def expansions(spark: SparkSession) -> DataFrame:
    return _values(spark, EXPANSIONS, "short, full")


def models(spark: SparkSession) -> DataFrame:
    rows = _values(spark, MODELS, "place_id, key, value").groupBy("place_id")
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("info"))


def answers(spark: SparkSession) -> DataFrame:
    return _values(spark, ANSWERS, "id, raw").withColumn("id", F.col("id").cast("long"))


#: (place_id, title, address, totalScore, reviewsCount, categoryName, description, price, phone, permanentlyClosed, temporarilyClosed)
PLACES = """
('p1', 'Blue Cafe', 'Main St 1', 4.5, 120, 'Cafe', 'A small cafe by the river with cakes', '$$', '0228', false, false), ('p2', '', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL), ('p3', 'Mill', '', 0.0, 0, '', 'short', '', '07', true, true), ('p4', 'Inn', 'x', 3.0, 5, 'Hotel', '', '$', '', false, true)
"""


def raw_places(spark: SparkSession) -> DataFrame:
    names = "place_id, title, address, totalScore, reviewsCount, categoryName, description, price, phone, permanentlyClosed, temporarilyClosed"
    rows = _values(spark, PLACES, names)
    types = dict(x.split(" ", 1) for x in re.split(r", (?=\w+ )", schemas.RAW_PLACE))
    missing = ("categories", "openingHours", "website", "locationType")
    return rows.select("place_id", *(F.col(n).cast(types[n]).alias(n) for n in names.split(", ")[1:]), *(F.lit(None).cast(types[n]).alias(n) for n in missing))
