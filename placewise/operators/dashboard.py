"""Tables and labels that a dashboard shows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.text import ellipsis, joined, one_decimal, percent
from placewise.sources.schemas import ASPECT_NAMES, CATEGORY_ICONS, DEFAULT_ICON

SCORE_PARTS = {"sentiment_comp": "Sentiment", "rating_comp": "Google Rating", "trust_comp": "Trust", "consistency_comp": "Consistency"}
#: The icon of a trend.
TREND_ICONS = {"Improving": "📈", "Declining": "📉", "Stable": "➡️"}


def category_icon(category: Column, subtypes: Column, icons: Mapping[str, str] = CATEGORY_ICONS, default: str = DEFAULT_ICON) -> Column:
    """The icon of the first keyword, in the table's order, that the category and first three subtypes contain anywhere."""
    text = F.lower(F.concat_ws(" ", F.coalesce(category, F.lit("")), F.array_join(F.slice(F.coalesce(subtypes, F.array().cast("array<string>")), 1, 3), " ")))
    keys, values = F.array(*map(F.lit, icons)), F.array(*map(F.lit, icons.values()))
    hits = F.transform(keys, lambda k, i: F.when(F.contains(text, k), values[i]))
    return F.coalesce(F.get(F.array_compact(hits), 0), F.lit(default))


def subtype_tags(category: Column, subtypes: Column, most: int = 6) -> Column:
    return F.slice(F.filter(subtypes, lambda s: F.lower(s) != F.lower(category)), 1, most)


def closed_badge(permanently: Column, temporarily: Column) -> Column:
    return F.when(permanently, "PERMANENTLY CLOSED").when(temporarily, "TEMPORARILY CLOSED").otherwise("")


def meta_line(price: Column, phone: Column) -> Column:
    return joined("  ", F.when(price != "", F.concat(F.lit("💰 "), price)), F.when(phone != "", F.concat(F.lit("📞 "), phone)))


def full_query(place: Column, city: Column) -> Column:
    """The place and its city, unless the place has it already."""
    there = (F.coalesce(city, F.lit("")) == "") | F.contains(F.lower(place), F.lower(city))
    return F.when(there, place).otherwise(F.concat_ws(", ", place, city))


def url_warning(url: Column) -> Column:
    return (url != "") & ~F.startswith(url, F.lit("http"))


def score_class(score: Column) -> Column:
    return F.when(score >= 7, "good").when(score >= 5, "fair").otherwise("poor")


def bar_width(score: Column) -> Column:
    return (score * 10).cast("int")


def theme_polarity(sentiment: Column) -> Column:
    return F.when(F.contains(sentiment, F.lit("Pos")), "positive").when(F.contains(sentiment, F.lit("Neg")), "negative").otherwise("neutral")


def verdict_class(verdict: Column) -> Column:
    has = lambda x: F.contains(verdict, F.lit(x))
    return F.when(has("HIGHLY"), "highly").when(has("NOT"), "not").when(has("CAUTION"), "caution").otherwise("recommended")


def trend_icon(trend: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in TREND_ICONS.items() for x in kv))[trend], F.lit(TREND_ICONS["Stable"]))


def score_rows(scores: DataFrame, aspects: DataFrame) -> DataFrame:
    """(place_id, metric, score): the components of each place, and its aspects that have a score."""
    parts = scores.select("place_id", *(F.col(k).cast("double").alias(v) for k, v in SCORE_PARTS.items())).unpivot("place_id", list(SCORE_PARTS.values()), "metric", "score")
    named = aspects.where("score IS NOT NULL").select("place_id", F.initcap(F.replace("aspect", F.lit("_"), F.lit(" "))).alias("metric"), "score")
    return parts.unionByName(named)


def shown_aspects(aspects: DataFrame, radar: bool = False) -> DataFrame:
    """Aspects with a score; the bar chart leaves accessibility out, the radar chart doesn't."""
    names = [a for a in ASPECT_NAMES if radar or a != "accessibility"]
    return aspects.where(F.col("score").isNotNull() & F.col("aspect").isin(*names))


def shown_emotions(distribution: DataFrame) -> DataFrame:
    return distribution.where("n > 0")


def credibility_table(credibility: DataFrame) -> DataFrame:
    """credibility (place_id, aspect, credible, share): a row for each with a title, a mark and a percentage."""
    return credibility.select("place_id", F.initcap(F.replace("aspect", F.lit("_"), F.lit(" "))).alias("aspect"), F.when(F.col("credible"), "✅").otherwise("❌").alias("credible"), percent(F.coalesce("share", F.lit(0.0))).alias("share"))


def guardrail_cards(guardrail: DataFrame) -> DataFrame:
    adjusted = F.when(F.col("adjusted_rating").isNotNull(), F.concat(one_decimal(F.col("adjusted_rating")), F.lit("/5"))).otherwise("—")
    return guardrail.select("place_id", percent(F.col("trust_score")).alias("trust"), percent(F.col("fake_review_probability")).alias("fake"), adjusted.alias("adjusted"))


def verification_banner(verifications: DataFrame) -> DataFrame:
    accuracy = F.when(F.col("accuracy").isNull(), "N/A").otherwise(percent(F.col("accuracy")))
    seen = F.when(F.col("hallucination_detected").isNull(), "N/A").when(F.col("hallucination_detected"), "Yes").otherwise("No")
    return verifications.select("place_id", F.coalesce("verification_status", F.lit("PASS")).alias("status"), accuracy.alias("accuracy"), seen.alias("hallucination"))


def evidence_lines(points: DataFrame) -> DataFrame:
    """Points with their ids joined; a missing claim is blank."""
    return points.select("place_id", "ord", F.coalesce("claim", F.lit("")).alias("claim"), F.array_join(F.coalesce("evidence_review_ids", F.array().cast("array<string>")), ", ").alias("ids"))


def pros_and_cons(lists: DataFrame, rows: int = 5) -> DataFrame:
    """lists (place_id, pros, cons) side by side, a blank where one is shorter."""
    both = F.arrays_zip(F.slice("pros", 1, rows).alias("pro"), F.slice("cons", 1, rows).alias("con"))
    return lists.select("place_id", F.posexplode(both).alias("ord", "x")).select("place_id", "ord", F.coalesce("x.pro", F.lit("")).alias("pro"), F.coalesce("x.con", F.lit("")).alias("con"))


def dangling_evidence(ids: DataFrame, reviews: DataFrame) -> DataFrame:
    """Extension: evidence ids (place_id, review_id) that no review has."""
    known = reviews.select("place_id", F.concat(F.lit("r"), F.col("pos").cast("string")).alias("review_id"))
    return ids.join(known, ["place_id", "review_id"], "left_anti")


def suggestion_grid(suggestions: DataFrame, most: int = 6) -> DataFrame:
    """Suggestions (rank from 1) as buttons in two columns, with labels cut."""
    shown = suggestions.where(F.col("rank") <= most)
    return shown.select("query", F.floor((F.col("rank") - 1) / 2).cast("int").alias("row"), ((F.col("rank") - 1) % 2).alias("col"), ellipsis(F.col("display_name"), 34, 31).alias("label"))


def model_info(infos: DataFrame) -> DataFrame:
    """The models of a report, from a map with new or old keys."""
    at = lambda *keys: F.coalesce(*(F.element_at("info", F.lit(k)) for k in keys), F.lit("—"))
    return infos.select("place_id", at("model_a", "sentiment_model").alias("analyst"), at("model_b", "verifier_model").alias("verifier"), at("verdict_model", "model_a").alias("explainer"))


def non_empty(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows, as of contradictions or missing evidence, in which some of the columns isn't blank."""
    filled = F.lit(False)
    for c in columns:
        filled = filled | (F.coalesce(c, F.lit("")) != "")
    return rows.where(filled)
