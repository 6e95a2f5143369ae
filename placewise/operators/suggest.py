"""Suggestions from geocoder features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.text import joined, strip
from placewise.sources.schemas import CITY_TYPES


def _or_blank(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit("")))


def first_city(features: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lat, lon) of the first feature for each query; null unless it has exactly two coordinates (lon, lat)."""
    first = features.groupBy(*keys).agg(F.min_by("coordinates", "ord").alias("at"))
    two = F.size("at") == 2
    return first.select(*keys, F.when(two, F.get("at", 1)).alias("lat"), F.when(two, F.get("at", 0)).alias("lon"))


def place_suggestions(features: DataFrame, limit: int = 7) -> DataFrame:
    """features with query and wanted (a city, or null), the feature's own city as p_city: (query, city, rank, display_name, search_name, lat, lon, type, category).

    Of 2 * limit features, each search name once; those that mention the city first, else in the given order.
    Queries of fewer than two characters have none.
    """
    name, country, state = _or_blank("name"), _or_blank("country"), _or_blank("state")
    city = strip(F.coalesce(*(F.nullif(c, F.lit("")) for c in ("p_city", "town", "village", "county")), F.lit("")))
    rows = features.where((F.length(strip(F.col("query"))) >= 2) & (name != "")).withColumns({"n": name, "c": city, "s": state, "k": country})
    at = F.row_number().over(Window.partitionBy("query", "wanted").orderBy("ord"))
    rows = rows.withColumn("at", at).where(F.col("at") <= 2 * limit)
    display, search = joined(", ", F.col("n"), F.col("c"), F.col("s"), F.col("k")), joined(", ", F.col("n"), F.col("c"), F.col("k"))
    rows = rows.withColumns({"display_name": display, "search_name": search})
    seen = F.row_number().over(Window.partitionBy("query", "wanted", "search_name").orderBy("ord"))
    rows = rows.withColumn("seen", seen).where("seen = 1")
    where = F.lower(F.concat_ws(" ", "n", "c", "s", "k"))
    wanted = F.lower(strip(F.coalesce("wanted", F.lit(""))))
    preferred = (wanted != "") & F.contains(where, wanted)
    rank = F.row_number().over(Window.partitionBy("query", "wanted").orderBy(preferred.desc(), "ord"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= limit)
    return rows.select(
        "query", F.col("wanted").alias("city"), "rank", "display_name", "search_name", F.get("coordinates", 1).alias("lat"), F.get("coordinates", 0).alias("lon"),
        F.coalesce("type", F.lit("")).alias("type"), F.coalesce("osm_key", F.lit("")).alias("category"),
    )


def city_suggestions(features: DataFrame, limit: int = 6) -> DataFrame:
    """(query, rank, label): places and boundaries, or kinds that are cities, each label once, of 3 * limit features."""
    at = F.row_number().over(Window.partitionBy("query").orderBy("ord"))
    rows = features.where(F.length(strip(F.col("query"))) >= 2).withColumn("at", at).where(F.col("at") <= 3 * limit)
    key, kind = (F.lower(F.coalesce(c, F.lit(""))) for c in ("osm_key", "osm_value"))
    rows = rows.where((key.isin("place", "boundary") | kind.isin(*CITY_TYPES)) & (_or_blank("name") != ""))
    rows = rows.withColumn("label", joined(", ", _or_blank("name"), _or_blank("country")))
    first = rows.groupBy("query", "label").agg(F.min("ord").alias("ord"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("ord"))
    return first.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "rank", "label")
