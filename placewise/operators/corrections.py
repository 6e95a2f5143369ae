"""Corrections that the verifier proposes; only those with evidence count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.sources.schemas import CONCERN

PASSES = ("PASS", "UNAVAILABLE")


def evidenced(corrections: DataFrame) -> DataFrame:
    return corrections.where(F.size(F.coalesce("evidence_review_ids", F.array().cast("array<string>"))) > 0)


def evidenced_counts(corrections: DataFrame) -> DataFrame:
    """(place_id, corrections_count): corrections with evidence, counted even where a PASS keeps them from being applied."""
    return evidenced(corrections).groupBy("place_id").agg(F.count(F.lit(1)).alias("corrections_count"))


def applicable(corrections: DataFrame, verifications: DataFrame) -> DataFrame:
    """Evidenced corrections of places whose verification is neither PASS nor UNAVAILABLE."""
    open_places = verifications.where(~F.col("verification_status").isin(*PASSES)).select("place_id")
    return evidenced(corrections).join(open_places, "place_id", "left_semi")


def proposed_score(claim: Column) -> Column:
    """The first number in a claim if it is from 0 to 10, else null."""
    number = F.nullif(F.regexp_extract(claim, r"\b(\d+(?:\.\d+)?)\b", 1), F.lit("")).cast("double")
    return F.when((number >= 0) & (number <= 10), number)


def corrected_aspects(aspects: DataFrame, todo: DataFrame) -> DataFrame:
    """aspects (place_id, aspect, score, summary) after the corrections of fields `aspects.<name>`, in order of idx.

    A proposed score counts if there is none, or if it is more than half a point away from the one then in place.
    """
    rows = todo.where(F.startswith("field", F.lit("aspects."))).select("place_id", F.substring("field", 9, 10_000).alias("aspect"), "idx", "corrected_claim", proposed_score(F.col("corrected_claim")).alias("proposed"))
    rows = rows.where("proposed IS NOT NULL").groupBy("place_id", "aspect").agg(F.sort_array(F.collect_list(F.struct("idx", "proposed", "corrected_claim"))).alias("steps"))
    joined = aspects.join(rows, ["place_id", "aspect"], "left")

    def step(now: Column, s: Column) -> Column:
        taken = now["score"].isNull() | (F.abs(s["proposed"] - now["score"]) > 0.5)
        return F.when(taken, F.struct(s["proposed"].alias("score"), F.substring(s["corrected_claim"], 1, 120).alias("summary"))).otherwise(now)

    start = F.struct("score", "summary")
    done = F.coalesce(F.aggregate("steps", start, step), start)
    return joined.withColumn("__done", done).select("place_id", "aspect", F.col("__done.score").alias("score"), F.col("__done.summary").alias("summary"))


def corrected_sentiment(sentiment: DataFrame, todo: DataFrame) -> DataFrame:
    """sentiment (place_id, overall_sentiment, sentiment_score) after corrections of `sentiment` or `sentiment.overall`."""
    rows = todo.where(F.col("field").isin("sentiment", "sentiment.overall")).groupBy("place_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.lower("corrected_claim").alias("claim")))).alias("steps"))

    def step(now: Column, s: Column) -> Column:
        has = lambda word: F.contains(s["claim"], F.lit(word))
        made = lambda label, score: F.struct(F.lit(label).alias("label"), score.alias("score"))
        return F.when(has("negative"), made("Negative", -F.abs(now["score"]))).when(has("positive"), made("Positive", F.abs(now["score"]))).when(has("mixed"), made("Mixed", now["score"])).otherwise(now)

    start = F.struct(F.col("overall_sentiment").alias("label"), F.col("sentiment_score").alias("score"))
    joined = sentiment.join(rows, "place_id", "left").withColumn("__done", F.coalesce(F.aggregate("steps", start, step), start))
    return joined.select("place_id", F.col("__done.label").alias("overall_sentiment"), F.col("__done.score").alias("sentiment_score"))


def corrected_keywords(keywords: DataFrame, todo: DataFrame) -> DataFrame:
    """keywords (place_id, polarity, ord, keyword) less those that a correction of `keywords.<polarity>` says aren't there."""
    claim = F.lower("corrected_claim")
    denied = F.contains(claim, F.lit("not")) | F.contains(claim, F.lit("unsupported")) | F.contains(claim, F.lit("absent")) | F.contains(claim, F.lit("incorrect"))
    bad = todo.where(F.col("field").isin("keywords.positive", "keywords.negative") & denied).select("place_id", F.substring_index("field", ".", -1).alias("polarity"), F.trim(F.lower("original_claim")).alias("bad")).distinct()
    same = (keywords["place_id"] == bad["place_id"]) & (keywords["polarity"] == bad["polarity"]) & (F.lower(keywords["keyword"]) == bad["bad"])
    return keywords.join(bad, same, "left_anti")


def added_concerns(todo: DataFrame) -> DataFrame:
    """A concern for each correction of a guardrail field."""
    rank = F.row_number().over(Window.partitionBy("place_id").orderBy("idx"))
    rows = todo.where(F.startswith("field", F.lit("guardrail"))).withColumn("ord", rank)
    concern = F.struct(F.col("field").alias("aspect"), F.substring("corrected_claim", 1, 200).alias("evidence"), F.lit("Moderate").alias("severity"), F.col("evidence_review_ids").alias("supporting_review_ids"), F.lit("Model B correction").alias("source"))
    return rows.select("place_id", "ord", concern.cast(f"struct<{', '.join(x.replace(' ', ': ', 1) for x in CONCERN.split(', '))}>").alias("concern")).select("place_id", "ord", "concern.*")


def badge(ids: Column) -> Column:
    return F.when(F.size(F.coalesce(ids, F.array().cast("array<string>"))) > 0, "Applied").otherwise("Skipped")
