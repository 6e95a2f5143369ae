"""What stands in when the guardrail annotator gives no positives, concerns or facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.text import claim_aspect, one_decimal

EVIDENCE_CHARS = 150


def points_as_evidence(points: DataFrame) -> DataFrame:
    """points (place_id, ord from 0, polarity, claim, aspect, evidence_review_ids) with aspect, confidence, severity and ids."""
    ids = F.col("evidence_review_ids")
    own = F.array(F.concat(F.lit("r"), (F.col("ord") + 1).cast("string")))
    positive = F.col("polarity") == "positive"
    return points.select(
        "place_id", "ord", "polarity", claim_aspect(F.coalesce("claim", F.lit("")), F.col("aspect")).alias("aspect"), F.coalesce("claim", F.lit("")).alias("evidence"),
        F.when(positive, F.round(F.lit(0.92).cast("decimal(18,9)") - F.col("ord") * F.lit(0.04).cast("decimal(18,9)"), 2).cast("double")).alias("confidence"),
        F.when(~positive, F.when(F.col("ord") == 0, "Moderate").otherwise("Minor")).alias("severity"),
        F.when(F.size(F.coalesce(ids, F.array().cast("array<string>"))) > 0, ids).otherwise(own).alias("supporting_review_ids"),
    )


def _first(reviews: DataFrame, condition: Column, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("place_id").orderBy("pos"))
    return reviews.where(condition).withColumn("ord", rank).where(F.col("ord") <= k)


def fallback_positives(reviews: DataFrame) -> DataFrame:
    rows = _first(reviews, F.col("rating") >= 4, 4)
    return rows.select("place_id", "ord", F.lit("Verified Customer Praise").alias("aspect"), F.substring("text", 1, EVIDENCE_CHARS).alias("evidence"), F.lit(0.88).alias("confidence"), F.concat(F.lit("r"), F.col("pos").cast("string")).alias("review_id"))


def fallback_concerns(reviews: DataFrame) -> DataFrame:
    rows = _first(reviews, F.col("rating") <= 3, 3)
    severity = F.when(F.col("rating") == 1, "Major").otherwise("Moderate")
    return rows.select("place_id", "ord", F.lit("Reported Customer Concern").alias("aspect"), F.substring("text", 1, EVIDENCE_CHARS).alias("evidence"), severity.alias("severity"), F.concat(F.lit("r"), F.col("pos").cast("string")).alias("review_id"))


def enriched(polarity: str, given: DataFrame, points: DataFrame, reviews: DataFrame) -> DataFrame:
    """Positives or negatives (place_id, ord from 0, aspect, evidence, confidence, severity, supporting_review_ids) of each place:
    the given ones if it has any, else its points, else what its reviews say.
    """
    columns = ("place_id", "ord", "aspect", "evidence", "confidence", "severity", "supporting_review_ids")
    own = points_as_evidence(points.where(F.col("polarity") == polarity)).select(*columns)
    last = fallback_positives(reviews).withColumn("severity", F.lit(None).cast("string")) if polarity == "positive" else fallback_concerns(reviews).withColumn("confidence", F.lit(None).cast("double"))
    last = last.withColumns({"ord": F.col("ord") - 1, "supporting_review_ids": F.array("review_id")}).select(*columns)
    own = own.join(given.select("place_id"), "place_id", "left_anti")
    chosen = given.select(*columns).unionByName(own)
    return chosen.unionByName(last.join(chosen.select("place_id"), "place_id", "left_anti"))


def verified_facts(places: DataFrame) -> DataFrame:
    """places (place_id, n, rated_avg, positive_keywords, negative_keywords) to rows (place_id, fact_no, fact)."""
    listed = lambda c, k: F.array_join(F.slice(c, 1, k), ", ")
    p, n = F.col("positive_keywords"), F.col("negative_keywords")
    facts = F.array_compact(F.array(
        F.when(F.col("rated_avg").isNotNull(), F.concat(F.lit("Average rating of analyzed sample is "), one_decimal(F.col("rated_avg")), F.lit("★ across "), F.col("n").cast("string"), F.lit(" reviews."))),
        F.when(F.size(p) > 0, F.concat(F.lit("Top verified positive customer descriptors: "), listed(p, 4), F.lit("."))),
        F.when(F.size(n) > 0, F.concat(F.lit("Top critical customer mentions: "), listed(n, 3), F.lit("."))),
    ))
    return places.select("place_id", F.posexplode(facts).alias("at", "fact")).select("place_id", (F.col("at") + 1).alias("fact_no"), "fact")


def facts_of(given: DataFrame, places: DataFrame) -> DataFrame:
    """The facts given (place_id, fact_no, fact) of each place that has any, else those of its reviews (verified_facts)."""
    own = given.where("fact IS NOT NULL").select("place_id", "fact_no", "fact")
    return own.unionByName(verified_facts(places.join(own.select("place_id"), "place_id", "left_anti")))


def sentiment_context(places: DataFrame) -> DataFrame:
    """What the guardrail annotator is shown of a place's sentiment: ten and eight keywords, five themes."""
    return places.select("place_id", F.slice("positive_keywords", 1, 10).alias("positive_keywords"), F.slice("negative_keywords", 1, 8).alias("negative_keywords"), F.slice("themes", 1, 5).alias("themes"))


def trimmed_concerns(concerns: DataFrame, most: int = 4) -> DataFrame:
    """concerns (place_id, ord from 0, ...): the first four of each place, evidence cut to 80 characters."""
    return concerns.where(F.col("ord") < most).withColumn("evidence", F.substring("evidence", 1, 80))


def listing(rows: DataFrame) -> DataFrame:
    """Positives and concerns as shown: rows without evidence are dropped, a missing severity is Minor."""
    severity = F.when(F.col("polarity") == "negative", F.coalesce(F.nullif("severity", F.lit("")), F.lit("Minor")))
    return rows.where(F.coalesce("evidence", F.lit("")) != "").withColumn("severity", severity)
