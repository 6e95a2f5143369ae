"""Review relations made of the driver's tables, for queries that have a twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.operators.reviews import batch_of, renumbered
from placewise.sources.schemas import ASPECT_NAMES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_rating() -> F.Column:
    q, t = F.col("quality"), F.col("toxic")
    return F.when((q == 1) & (t == 0), 5.0).when((q == 1) & (t == 1), 2.0).when((q == 0) & (t == 1), 1.0).otherwise(3.0)


def raw_document_reviews(spark: SparkSession, sf_dir: str, text: F.Column | None = None) -> DataFrame:
    """Raw reviews: place, pos and the fields of a scraped review, of documents. text: what is needed of the text, so that joins carry no more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("text") if text is None else text).alias("text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", label_rating().alias("stars"))
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("publishedAtDate"))
    numbered = renumbered(docs.select("doc_id", F.col("source").alias("place_id"), F.col("doc_id").alias("pos")))
    joined = docs.select("doc_id", "text").join(numbered, "doc_id").join(labels, "doc_id", "left").join(dates, "doc_id", "left")
    name = F.concat(F.lit("u"), (F.col("doc_id") % 37).cast("string"))
    return joined.select("place_id", "pos", name.alias("name"), "stars", "text", "publishedAtDate", (F.col("doc_id") % 11).alias("likesCount"))


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews without text, of orders: place_id (nation), author, rating, date."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("place_id"))
    rating = F.substring("o_orderpriority", 1, 1).cast("double")
    return orders.join(customers, "o_custkey").select("place_id", F.col("o_custkey").cast("string").alias("author"), rating.alias("rating"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))


def line_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspect scores of batches, of lineitem: place_id (supplier), batch, aspect, score and more."""
    lines = table(spark, sf_dir, "lineitem")
    names = F.array(*(F.lit(a) for a in ASPECT_NAMES))
    summary = F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat("l_returnflag", F.lit(" "), F.col("l_partkey").cast("string")))
    return lines.select(
        F.col("l_suppkey").alias("place_id"), F.col("l_orderkey").alias("batch"), names[F.col("l_linenumber") - 1].alias("aspect"),
        F.when(F.col("l_quantity") < 50, F.col("l_quantity") / 5).alias("score"), (F.col("l_partkey") % 10).alias("reviews_mentioning"),
        summary.alias("summary"), F.array(F.concat(F.lit("r"), (F.col("l_orderkey") % 50 + 1).cast("string"))).alias("evidence_review_ids"),
    )


def part_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of one aspect each, of part: place_id, batch (partkey), aspect, score and more. Every fourth place has two."""
    part = table(spark, sf_dir, "part")
    names = F.array(*(F.lit(a) for a in ASPECT_NAMES))
    place = F.col("p_partkey") - F.when(F.col("p_partkey") % 4 == 3, 1).otherwise(0)
    return part.select(
        place.alias("place_id"), F.col("p_partkey").alias("batch"), names[F.col("p_size") % 7].alias("aspect"), (F.col("p_retailprice") / 128).alias("score"), F.col("p_size").cast("long").alias("reviews_mentioning"),
        F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name")).alias("summary"), F.array(F.concat(F.lit("r"), F.col("p_size").cast("string"))).alias("evidence_review_ids"),
    )


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review scores and emotions in batches of 15, of events: place_id (user), event_id, batch, score, emotion."""
    score = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("value") / 50 - 1))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("place_id"), F.col("event_id").alias("pos"), "event_id", score.alias("score"), F.col("event_type").alias("emotion"))
    return renumbered(events).select("place_id", "event_id", batch_of(F.col("pos")).alias("batch"), "score", "emotion")
