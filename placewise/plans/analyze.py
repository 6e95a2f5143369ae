"""From raw places to reports, for all places at once: the whole chain of operators.

What several parts read is computed once and kept in the shared folder while the plan is made, and near-duplicates go in
rounds; the reports themselves are lazy.

Annotations are relations that a language model, or anything else, has made (see sources.schemas). What isn't given
is made from the reviews (per-review scores by a lexicon) or left to the defaults of the operators.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.session import cut
from placewise.functions.text import rounded
from placewise.operators import annotate, corrections, dashboard, dedupe, guardrail, heuristics, report, scoring, sentiment, verify
from placewise.operators import reviews as R
from placewise.plans import models
from placewise.plans.progress import Progress
from placewise.sources import schemas
from placewise.sources.cache import ReportCache
from placewise.sources.readers import CACHE_DAYS

NO_REVIEWS = "No reviews found. Try a more specific location name."
#: Rows of each list that the explainer may be shown (report.verdict_contexts takes fewer).
SHOWN = 10
QUOTES = ("standout_positive_quote", "standout_negative_quote", "crowd_profile", "temporal_trend")


def _verified(given: Mapping[str, DataFrame], ids: DataFrame, strict: bool) -> DataFrame:
    """A verification for each place: its own, else the record of an unavailable one."""
    if "verifications" not in given:
        return verify.unavailable(ids, strict)
    own = verify.with_defaults(given["verifications"]).select("place_id", "verification_status", "accuracy", "hallucination_detected")
    return own.unionByName(verify.unavailable(ids.join(own, "place_id", "left_anti"), strict))


def analyze(raw: DataFrame, annotations: Mapping[str, DataFrame] | None = None, require_verification: bool = False, strict: bool = False, ask: models.Models | None = None, page_rows: int | None = None, progress: Progress | None = None) -> DataFrame:
    """One report for each raw place (schemas.RAW_PLACE and place_id); one without reviews has an error instead.

    annotations, each optional and named after its schema: per_review, aspects, batches, themes, points, guardrail,
    positives and concerns (schemas.EVIDENCE), patterns, facts, contradictions, credibility, verifications, sections, corrections, and recommendations (place_id and
    any prose). A place without a verification gets the compatible record (PASS at 0.92), or UNAVAILABLE if strict. ask: models that make the
    annotations that aren't given. page_rows: pages of so many rows (report.paged) in place of one report for each place, for places of any size. progress: told of each step.
    """
    given, c, steps = dict(annotations or {}), F.col, progress or Progress()
    steps.begin(1, "Collecting and cleaning reviews...")
    table = lambda name, schema: given[name] if name in given else raw.sparkSession.createDataFrame([], schema)
    places, scraped = R.project_places(raw), R.explode_reviews(raw)
    reviews = steps.kept(dedupe.clean(R.usable_reviews(scraped)), 1, "reviews after cleaning")  # a dozen parts read them
    if ask is not None:
        given = models.ask(reviews, ask, steps) | given
    steps.begin(5, "Computing scores and verdicts...")
    per_review = given.get("per_review", annotate.lexicon_annotations(reviews))
    aspects = sentiment.merge_aspects(table("aspects", schemas.ASPECTS), c("batch"))
    said, fixes, points = table("batches", schemas.BATCHES), table("corrections", schemas.CORRECTIONS), sentiment.merge_points(table("points", schemas.POINTS))
    verified = _verified(given, places.select("place_id"), strict)
    todo = corrections.applicable(fixes, verified)

    batches = said.select("place_id", "batch", "sentiment_score", "overall_sentiment")
    if "batches" not in given:
        means = per_review.groupBy("place_id", "batch").agg(rounded(F.avg("score"), 3).alias("sentiment_score"))
        batches = means.withColumn("overall_sentiment", sentiment.sentiment_label(c("sentiment_score")))
    mood = corrections.corrected_sentiment(sentiment.merge_sentiment(batches), todo)
    quotes = sentiment.merge_firsts(said, *QUOTES)
    scores = corrections.corrected_aspects(aspects.select("place_id", "aspect", "score", "summary"), todo)
    keywords = corrections.corrected_keywords(sentiment.merge_keywords(said), todo)
    judged = table("guardrail", schemas.GUARDRAIL)
    trust = judged.select("place_id", "trust_score", "fake_review_probability")
    positives = guardrail.enriched("positive", table("positives", schemas.EVIDENCE), points, reviews)
    concerns = guardrail.enriched("negative", table("concerns", schemas.EVIDENCE), points, reviews)
    concerns = concerns.withColumn("source", F.lit(None).cast("string")).unionByName(corrections.added_concerns(todo).withColumns({"ord": c("ord") + 1000, "confidence": F.lit(None).cast("double")}))

    rating = F.nullif("rating", F.lit(0.0))
    stats = reviews.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("scraped_avg"), F.avg(rating).alias("rated_avg"), F.count_if(c("rating") >= 4).alias("positive"), F.count_if(c("rating") <= 2).alias("critical"))
    joined = places.select("place_id", "google_score").join(stats, "place_id").join(verified, "place_id")
    for part in (mood, quotes, scoring.aspect_scores(scores), scoring.consistency(per_review), scoring.risk_penalty(concerns, fixes), trust, verify.aspect_texts(aspects), sentiment.keyword_lists(keywords)):
        joined = joined.join(part, "place_id", "left")
    joined = steps.kept(joined, 5, "places")  # one row a place, read by the score, the checks and the facts
    mood_score = F.coalesce("sentiment_score", F.lit(0.0))
    parts = joined.select(
        "place_id", "n", "trust_score", "verification_status", "accuracy", scoring.sentiment_component(mood_score).alias("sentiment_comp"), F.coalesce("aspect_comp", F.lit(5.0)).alias("aspect_comp"),
        scoring.rating_component(c("google_score"), c("scraped_avg")).alias("rating_comp"), scoring.trust_component(c("trust_score"), c("fake_review_probability"), c("verification_status"), c("accuracy")).alias("trust_comp"),
        F.coalesce("consistency_comp", F.lit(5.0)).alias("consistency_comp"), scoring.recency_component(c("temporal_trend.recent_score"), c("temporal_trend.trend"), mood_score).alias("recency_comp"), F.coalesce("risk_penalty", F.lit(0.0)).alias("risk_penalty"),
    )
    scored = scoring.final_scores(parts)

    none = F.array().cast("array<string>")
    lists = {x: F.coalesce(x, none) for x in ("aspect_texts", "positive_keywords", "negative_keywords")}
    seen = joined.withColumns(lists | {"overall_sentiment": F.coalesce("overall_sentiment", F.lit("Positive")), "fake_probability": F.coalesce("fake_review_probability", F.lit(0.05)), "trust_score": F.coalesce(c("trust_score").cast("string"), F.lit("85"))})
    checks = verify.sections(table("sections", schemas.SECTIONS), verify.default_observations(seen))
    spoken = table("themes", schemas.THEMES)
    themes = sentiment.merge_themes(spoken, F.struct("batch", "ord"), said if "batches" in given else spoken)
    emotions = None
    if "emotion" in per_review.columns:
        emotions = sentiment.emotion_distribution(per_review.groupBy("place_id", "emotion").agg(F.count(F.lit(1)).alias("n")))
    if "emotion_distribution" in said.columns:  # what the batches counted themselves goes before
        counted = said.where("emotion_distribution IS NOT NULL").select("place_id").distinct()
        own = sentiment.merge_emotions(said.join(counted, "place_id", "left_semi").select("place_id", "batch", "emotion_distribution"))
        emotions = own if emotions is None else own.unionByName(emotions.join(counted, "place_id", "left_anti"))
    counted = verified.join(corrections.evidenced_counts(fixes), "place_id", "left").withColumn("corrections_count", F.coalesce("corrections_count", F.lit(0)))
    parts_of = {"review_stats": R.funnel(scraped, reviews), "heuristics": heuristics.heuristic_stats(reviews), "sentiment": mood, "quotes": quotes, "guardrail": judged, "verification": counted, "score": scored}
    extras = [x for x in ("emotional_tone", "review_diversity") if x in said.columns]
    if extras:
        parts_of["mood"] = sentiment.batch_extras(said, *extras)
    if "recommendations" in given:
        parts_of["recommendation"] = report.overridden(given["recommendations"], scored)
    cited = [rows.select("place_id", F.explode(ids).alias("review_id")) for rows, ids in ((points, "evidence_review_ids"), (positives, "supporting_review_ids"), (concerns, "supporting_review_ids"), (fixes, "evidence_review_ids"))]
    cited = reduce(DataFrame.unionByName, cited).distinct()
    rows_of = {
        "flags": (heuristics.merged_flags(heuristics.place_flags(reviews), table("patterns", schemas.PATTERNS)), "flag_no"), "aspects": (scores, "aspect"), "themes": (themes.drop("batch", "ord"), "first"),
        "keywords": (keywords, "ord"), "points": (points, "ord"), "positives": (positives, "ord"), "concerns": (concerns, "ord"), "facts": (guardrail.facts_of(table("facts", schemas.FACTS), seen), "fact_no"),
        "checks": (checks, "section"), "corrections": (fixes, "idx"), "reviews": (reviews, "pos"), "per_review": (per_review, F.struct("batch", F.regexp_extract("id", r"(\d+)$", 1).try_cast("long"), "id")), "dangling": (dashboard.dangling_evidence(cited, reviews), "review_id"),
    }
    if "contradictions" in given:
        rows_of["contradictions"] = (dashboard.non_empty(given["contradictions"], "positive_claim", "negative_claim"), "ord")
    if "credibility" in given:
        rows_of["credibility"] = (dashboard.credibility_table(given["credibility"]), "aspect")
    if emotions is not None:
        rows_of["emotions"] = (emotions, "emotion")
    if ask is not None and ask.verdict and "recommendations" not in given:
        steps.begin(6, "Writing pros, cons and tips...")
    if page_rows:
        if ask is not None and ask.verdict and "recommendations" not in given:  # the explainer is shown the first rows of each list
            heads = {name: (report.numbered(rows, c(o) if isinstance(o, str) else o).where(c("nth") <= SHOWN).drop("nth"), o) for name, (rows, o) in rows_of.items()}
            told = models.explain(report.assemble(places, parts_of, heads), ask.verdict, ask.reserve, ask.strong_quota)
            parts_of["recommendation"] = report.overridden(told, scored)
        failed = report.gated(verified.select("place_id", "verification_status"), require_verification).select("place_id", "error")
        failed = places.join(failed, "place_id", "left").join(stats.select("place_id", F.lit(True).alias("some")), "place_id", "left")
        parts_of["problem"] = failed.select("place_id", F.when(c("some").isNull(), NO_REVIEWS).otherwise(c("error")).alias("error")).where("error IS NOT NULL")
        return report.paged(places, parts_of, rows_of, page_rows)
    out = report.assemble(places, parts_of, rows_of)
    if ask is not None and ask.verdict and "recommendations" not in given:
        told = report.overridden(models.explain(out, ask.verdict, ask.reserve, ask.strong_quota), scored)
        out = report.assemble(out, {"recommendation": told}, {})
    out = report.gated(out.withColumn("verification_status", c("verification.verification_status")), require_verification).drop("verification_status")
    empty = F.coalesce(F.size("reviews") == 0, F.lit(True))
    of_none = {x: F.when(~empty, c(x)).alias(x) for x in ("verification", "score")}
    return out.withColumns(of_none | {"error": F.when(empty, NO_REVIEWS).otherwise(c("error"))})


def analyze_cached(raw: DataFrame, cache: ReportCache, now: Column, days: int = CACHE_DAYS, **settings: object) -> DataFrame:
    """(place_id, report as JSON, from_cache) of each raw place: those in the cache that are fresh, the others made and put there.

    A report that is an error isn't kept. settings: of analyze.
    """
    held = cut(cache.fresh(raw, now, days))
    made = analyze(raw.join(held.select("place_id"), "place_id", "left_anti"), **settings)
    made = cut(made.select("place_id", now.cast("timestamp").alias("generated_at"), F.to_json(F.struct(*made.columns)).alias("report"), F.col("error").isNull().alias("good")))
    cache.upsert(made.where("good"))
    out = lambda df, known: df.select("place_id", "report", F.lit(known).alias("from_cache"))
    return out(held, True).unionByName(out(made, False))
