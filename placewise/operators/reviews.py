"""Places and reviews: projection with defaults, usable texts, numbering, batches, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.text import BATCH_CHARS, REVIEW_CHARS, or_default, strip

BATCH = 15


def best_places(candidates: DataFrame, key: str, order: str) -> DataFrame:
    """For each search the candidate with most reviews; of equal ones the first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("reviewsCount", F.lit(0)).desc(), order))
    return candidates.withColumn("rank", rank).where("rank = 1").drop("rank")


def project_places(raw: DataFrame) -> DataFrame:
    """Raw places to place records; empty values take the defaults."""
    text = lambda c: or_default(F.col(c), "")
    return raw.select(
        "place_id", F.coalesce(F.nullif("title", F.lit("")), "place_id").alias("name"), text("address").alias("address"), F.coalesce("totalScore", F.lit(0.0)).alias("google_score"),
        F.coalesce("reviewsCount", F.lit(0)).alias("review_count"), text("categoryName").alias("category"), F.coalesce("categories", F.array().cast("array<string>")).alias("subtypes"),
        text("description").alias("description"), text("price").alias("price"), F.coalesce("openingHours", F.array()).alias("opening_hours"), text("website").alias("website"),
        text("phone").alias("phone"), text("locationType").alias("location_type"), F.coalesce("permanentlyClosed", F.lit(False)).alias("permanently_closed"),
        F.coalesce("temporarilyClosed", F.lit(False)).alias("temporarily_closed"),
    )


def explode_reviews(raw: DataFrame) -> DataFrame:
    """The reviews of raw places, numbered from 1 in their order."""
    return raw.select("place_id", F.posexplode("reviews").alias("at", "r")).select("place_id", (F.col("at") + 1).alias("pos"), "r.*")


def usable_reviews(raw: DataFrame) -> DataFrame:
    """Raw reviews with text, as review records: stripped, cut, missing fields by default. Null texts aren't usable."""
    text = strip(F.coalesce("text", F.lit("")))
    rows = raw.withColumn("text", text).where(F.length("text") > 0)
    return rows.select(
        "place_id", "pos", or_default(F.col("name"), "Anonymous").alias("author"), or_default(F.col("stars"), 3.0, 0.0).alias("rating"),
        F.substring("text", 1, REVIEW_CHARS).alias("text"), F.nullif("publishedAtDate", F.lit("")).alias("date"), F.coalesce("likesCount", F.lit(0)).cast("long").alias("likes"),
    )


def renumbered(reviews: DataFrame, block: int = 1 << 16) -> DataFrame:
    """pos without gaps from 1 in each place, in the order of the old one.

    Numbers run within blocks of the old positions, on top of the counts of earlier blocks, so that a place with a
    large share of all reviews is many tasks.
    """
    rows = reviews.withColumn("__block", F.floor(F.col("pos") / block))
    counts = rows.groupBy("place_id", "__block").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("place_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("place_id", "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("place_id", "__block").orderBy("pos"))
    joined = rows.withColumn("__rank", within).join(counts, ["place_id", "__block"])
    return joined.withColumn("pos", (F.col("__base") + F.col("__rank")).cast("int")).select(*reviews.columns)


def review_id(pos: Column) -> Column:
    return F.concat(F.lit("r"), pos.cast("string"))


def batch_of(pos: Column) -> Column:
    return F.floor((pos - 1) / BATCH).cast("int")


def batch_prompts(reviews: DataFrame) -> DataFrame:
    """The annotator's input: one string for each batch of a place.

    Fixed values: the format of an item. A line with the review's id, stars (whole ones without a decimal point) and day,
    then the text.
    """
    day = F.coalesce(F.substring("date", 1, 10), F.lit("None"))
    whole = F.col("rating").cast("long")
    stars = F.when(F.col("rating") == whole, whole.cast("string")).otherwise(F.col("rating").cast("string"))
    item = F.concat(F.lit("["), review_id(F.col("pos")), F.lit("] ⭐"), stars, F.lit("/5  date:"), day, F.lit("\n"), F.substring("text", 1, BATCH_CHARS))
    rows = reviews.select("place_id", batch_of(F.col("pos")).alias("batch"), "pos", item.alias("item"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"])  # a batch has BATCH rows
    return rows.groupBy("place_id", "batch").agg(F.array_join(items, "\n---\n").alias("prompt"))


def funnel(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """How many reviews of each place were scraped, have text, and were cleaned and analyzed."""
    text = F.length(strip(F.coalesce("text", F.lit("")))) > 0
    before = raw.groupBy("place_id").agg(F.count(F.lit(1)).alias("raw_scraped"), F.count_if(text).alias("usable_text"))
    after = cleaned.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return before.join(after, "place_id", "left").select("place_id", "raw_scraped", "usable_text", n.alias("cleaned"), n.alias("analyzed"))


def star(rating: Column) -> Column:
    """Whole stars of a rating: cut, not rounded, and from 1 to 5."""
    return F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce(rating, F.lit(3)).cast("int")))


def rating_histogram(reviews: DataFrame) -> DataFrame:
    """(place_id, star, n): five rows for each place, those without reviews too."""
    counts = reviews.groupBy("place_id").agg(*(F.count_if(star(F.col("rating")) == k).alias(str(k)) for k in range(5, 0, -1)))
    return counts.unpivot("place_id", [str(k) for k in range(5, 0, -1)], "star", "n")


def sample(reviews: DataFrame, first: int, chars: int) -> DataFrame:
    """The first reviews of each place, with their ids and their texts cut."""
    return reviews.where(F.col("pos") <= first).select("place_id", review_id(F.col("pos")).alias("id"), "rating", F.substring("text", 1, chars).alias("text"))
