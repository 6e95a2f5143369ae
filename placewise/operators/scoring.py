"""The deterministic score: six components, a penalty, a verdict and a confidence. Rounds wherever the definition does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.text import rounded
from placewise.sources.schemas import ASPECT_WEIGHTS

#: Components in the order in which they are added, with their weights.
WEIGHTS = {"sentiment_comp": 0.30, "aspect_comp": 0.25, "rating_comp": 0.15, "trust_comp": 0.15, "consistency_comp": 0.10, "recency_comp": 0.05}


def clamp(x: Column, low: float = 0.0, high: float = 10.0) -> Column:
    """Within bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def sentiment_component(score: Column) -> Column:
    return rounded((score + 1) / 2 * 10, 2)


def aspect_scores(aspects: DataFrame) -> DataFrame:
    """(place_id, aspect_comp): weighted mean of the scores there are; places without any are left out (5.0 by default)."""
    weight = F.create_map(*(x for k, v in ASPECT_WEIGHTS.items() for x in (F.lit(k), F.lit(v))))[F.col("aspect")]
    scored = aspects.where("score IS NOT NULL").withColumn("w", weight).where("w IS NOT NULL")
    return scored.groupBy("place_id").agg(rounded(F.sum(F.col("score") * F.col("w")) / F.sum("w"), 2).alias("aspect_comp"))


def rating_component(google_score: Column, scraped_avg: Column) -> Column:
    """Twice the stars; where there is no score, twice the mean of the reviews' ratings."""
    own = rounded(F.coalesce(google_score, F.lit(0.0)) * 2, 2)
    return F.when((own == 0) & scraped_avg.isNotNull(), rounded(scraped_avg * 2, 2)).otherwise(own)


def trust_component(trust: Column, fake: Column, status: Column, accuracy: Column) -> Column:
    """Missing trust and probability are 0.7 and 0.2; a verification's accuracy scales, 0 and null counting as 1."""
    base = clamp(rounded((F.coalesce(trust, F.lit(0.7)) - F.coalesce(fake, F.lit(0.2)) * 0.5) * 10, 2))
    sure = F.coalesce(F.nullif(accuracy, F.lit(0.0)), F.lit(1.0))
    return F.when(status.isNull() | (status == "UNAVAILABLE"), base).otherwise(clamp(rounded(base * (sure * 0.5 + 0.5), 2)))


def consistency(per_review: DataFrame) -> DataFrame:
    """(place_id, consistency_comp) from review scores: spread of three scores or more, else 5.0."""
    scores = F.when(~F.isnan("score"), F.col("score"))
    comp = F.greatest(F.lit(0.0), rounded(10 - F.stddev_pop(scores) * 5, 2))
    return per_review.groupBy("place_id").agg(F.when(F.count(scores) >= 3, comp).otherwise(5.0).alias("consistency_comp"))


def recency_component(recent: Column, trend: Column, sentiment: Column) -> Column:
    base = rounded((F.coalesce(recent, sentiment) + 1) / 2 * 10, 2)
    return F.when(trend == "Declining", F.greatest(F.lit(0.0), base - 1.5)).when(trend == "Improving", F.least(F.lit(10.0), base + 1.0)).otherwise(base)


def severity_penalty(severity: Column) -> Column:
    return F.when(severity == "Major", 1.5).when(severity == "Moderate", 0.8).otherwise(0.2)


def risk_penalty(concerns: DataFrame, corrections: DataFrame) -> DataFrame:
    """(place_id, risk_penalty): concerns by severity, and 0.3 for each correction with evidence; 3 at most.

    corrections: place_id and evidence_review_ids. Corrections count even where a PASS keeps them from being applied.
    """
    has = F.size(F.coalesce("evidence_review_ids", F.array().cast("array<string>"))) > 0
    points = concerns.select("place_id", severity_penalty(F.col("severity")).alias("p")).unionByName(corrections.where(has).select("place_id", F.lit(0.3).alias("p")))
    return points.groupBy("place_id").agg(F.least(F.lit(3.0), rounded(F.sum("p"), 6)).alias("risk_penalty"))


def verdict(score: Column) -> Column:
    return F.when(score >= 8.0, "HIGHLY RECOMMENDED").when(score >= 6.5, "RECOMMENDED").when(score >= 4.5, "VISIT WITH CAUTION").otherwise("NOT RECOMMENDED")


def confidence(n: Column, consistency_comp: Column, trust: Column, status: Column, accuracy: Column) -> Column:
    up = lambda x, by: F.least(F.lit(1.0), x + by)
    sure = F.coalesce(F.nullif(accuracy, F.lit(0.0)), F.lit(1.0))
    base = F.least(F.lit(1.0), n / 50)
    base = F.when(consistency_comp >= 7, up(base, 0.15)).otherwise(base)
    base = F.when(F.coalesce(trust, F.lit(0.7)) >= 0.8, up(base, 0.1)).otherwise(base)
    passed = F.least(F.lit(1.0), up(base, 0.1) * (sure * 0.3 + 0.7))
    return rounded(F.when(status == "PASS", passed).when(status == "UNAVAILABLE", F.greatest(F.lit(0.0), base - 0.1)).when(status == "CORRECTED", F.greatest(F.lit(0.0), base - 0.05)).otherwise(base), 3)


def final_scores(parts: DataFrame) -> DataFrame:
    """parts: place_id, n, the six components, risk_penalty, trust_score, verification_status, accuracy."""
    total = sum((F.col(k) * w for k, w in list(WEIGHTS.items())[1:]), F.col("sentiment_comp") * WEIGHTS["sentiment_comp"])
    scored = parts.withColumn("composite", total).withColumn("final_score", rounded(clamp(F.col("composite") - F.col("risk_penalty")), 2))
    sure = confidence(F.col("n"), F.col("consistency_comp"), F.col("trust_score"), F.col("verification_status"), F.col("accuracy"))
    return scored.select("place_id", verdict(F.col("final_score")).alias("verdict"), "final_score", sure.alias("confidence"), *WEIGHTS, "risk_penalty", rounded(F.col("composite"), 2).alias("composite_raw"))
