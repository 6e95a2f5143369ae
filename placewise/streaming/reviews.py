"""Extension: keeping rating statistics of a stream of reviews. The batch operators do the work for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def distinct_reviews(reviews: DataFrame, at: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """Each review once, with state for as long as late ones may come."""
    return reviews.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_ratings(reviews: DataFrame, at: str, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(place_id, start, n, avg_rating) for windows of time."""
    grouped = reviews.withWatermark(at, late).groupBy("place_id", F.window(at, width))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("avg_rating")).select("place_id", F.col("window.start").alias("start"), "n", "avg_rating")


def rescore(reviews: DataFrame, score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a batch operator over each micro-batch and hands its rows to a sink."""
    return reviews.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: sink(score(df), epoch)).start()
