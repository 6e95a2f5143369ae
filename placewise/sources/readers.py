"""Readers and sinks. All formats are columnar or line-based, so they split over many tasks and prune columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placewise.functions.text import slug, url_quote
from placewise.sources import schemas

CACHE_DAYS = 7


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Raw places with nested reviews, one JSON object a line."""
    return spark.read.schema(schemas.RAW_PLACE).json(path)


def keyed(raw: DataFrame) -> DataFrame:
    """raw places with a place_id: title and address, and a number from 2 on for further places of the same ones, in a fixed order."""
    name = F.concat_ws(", ", F.nullif("title", F.lit("")), F.nullif("address", F.lit("")))
    row = F.xxhash64(*raw.columns)
    nth = F.row_number().over(Window.partitionBy("place_id").orderBy(F.desc_nulls_last("reviewsCount"), row))
    named = raw.withColumn("place_id", name).withColumn("__nth", nth)
    return named.withColumn("place_id", F.when(F.col("__nth") > 1, F.format_string("%s (%d)", "place_id", "__nth")).otherwise(F.col("place_id"))).drop("__nth")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REVIEWS).parquet(path)


def read_annotations(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a folder, in any store, by name: `<name>` or `<name>.parquet`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    paths = [x.getPath() for x in found if not x.getPath().getName().startswith(("_", "."))]
    return {x.getName().removesuffix(".parquet"): spark.read.parquet(x.toString()) for x in paths}


def route_requests(requests: DataFrame) -> DataFrame:
    """requests (query, lat, lon of its first suggestion if any) to source inputs: kind, input and limits.

    URLs go straight in and give one place, as do place_id: keys; other queries become a map search around the
    suggestion (three places), or a plain search (five). A latitude or longitude of zero counts as missing.
    """
    query = F.trim("query")
    located = (F.coalesce(F.col("lat"), F.lit(0.0)) != 0) & (F.coalesce(F.col("lon"), F.lit(0.0)) != 0)
    url = F.concat(F.lit("https://www.google.com/maps/search/"), url_quote(query), F.lit("/@"), F.col("lat").cast("string"), F.lit(","), F.col("lon").cast("string"), F.lit(",17z"))
    kind = F.when(F.startswith(query, F.lit("http")), "url").when(F.startswith(F.lower(query), F.lit("place_id:")), "place_id").when(located, "map").otherwise("search")
    places = F.when(F.col("kind").isin("url", "place_id"), 1).when(F.col("kind") == "map", 3).otherwise(5)
    routed = requests.withColumn("kind", kind)
    return routed.select(
        "query", "kind", F.when(F.col("kind") == "map", url).otherwise(query).alias("input"), places.alias("max_places"),
        F.lit("newest").alias("reviews_sort"), F.lit("en").alias("language"),
    )


def expand_urls(requests: DataFrame, expansions: DataFrame) -> DataFrame:
    """requests with each query that expansions (short, full) knows replaced by its full URL."""
    known = expansions.select(F.trim("short").alias("__short"), "full").dropDuplicates(["__short"])
    joined = requests.join(known, F.trim(requests["query"]) == known["__short"], "left")
    return joined.withColumn("query", F.coalesce(F.nullif("full", F.lit("")), "query")).drop("__short", "full")


def fresh_reports(reports: DataFrame, wanted: DataFrame, now: Column, days: int = CACHE_DAYS) -> DataFrame:
    """The latest report not older than so many days for each wanted query; reports: slug, generated_at, report."""
    recent = reports.where(F.col("generated_at") > now - F.make_interval(days=F.lit(days)))
    latest = recent.groupBy("slug").agg(F.max_by("report", "generated_at").alias("report"), F.max("generated_at").alias("generated_at"))
    return wanted.withColumn("slug", slug(F.col("query"))).join(latest, "slug", "left")


def write_reports(reports: DataFrame, path: str, as_json: bool = True) -> None:
    """One document a place: JSON lines for exchange, or Parquet."""
    writer = reports.write.mode("overwrite")
    writer.json(path) if as_json else writer.parquet(path)
