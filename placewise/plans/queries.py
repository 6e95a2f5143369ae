"""Queries over the driver tables, one or more for each operator: (spark, sf_dir) to a DataFrame of scalars."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placewise.functions import text as T
from placewise.functions.session import shared_path
from placewise.operators import corrections, dashboard, dedupe, guardrail, heuristics, report, scoring, sentiment, suggest, verify
from placewise.operators import reviews as R
from placewise.plans import fixtures
from placewise.sources import adapters as A
from placewise.sources import readers, service
from placewise.sources.cache import ReportCache

Query = Callable[[SparkSession, str], DataFrame]
c = F.col


def document_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.usable_reviews(A.raw_document_reviews(spark, sf_dir))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reviews, of their texts only what near-duplicates are told by."""
    return A.raw_document_reviews(spark, sf_dir, F.substring(T.strip(c("text")), 1, T.REVIEW_CHARS))


def review_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _compared(spark, sf_dir)
    return R.funnel(raw, dedupe.greedy(R.usable_reviews(raw)))


def source_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight newest reviews of each place, as a service gives them that holds the raw reviews."""
    path = shared_path(spark, "reviews")
    A.raw_document_reviews(spark, sf_dir).write.partitionBy("place_id").parquet(path)
    service.register(spark)
    places = [r["place_id"] for r in spark.read.parquet(path).select("place_id").distinct().collect()]  # what a user would ask for
    asked = spark.read.format("reviews").options(path=path, queries=json.dumps([f"place_id: {p}" for p in places]), max_reviews=8)
    return asked.load().select("query", "place_id", "reviews_count", "nth", c("pos").cast("int").alias("pos"), "name", "stars", F.length("text").alias("n_chars"), c("publishedAtDate").alias("date"))


def exact_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and shares of them rounded as doubles: many lie just beside a tie, or on one."""
    lines = A.table(spark, sf_dir, "lineitem")
    price = c("l_extendedprice")
    values = {"net": (price * (1 - c("l_discount")), 2), "eighth": (price / 8, 2), "mill": (price / 1000, 1), "half": (c("l_quantity") / 4, 0), "negative": (-price / 200, 3)}
    return lines.select("l_orderkey", "l_linenumber", *(T.round_double(v, d).alias(name) for name, (v, d) in values.items()))


def cached_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of each place's reviews, cached for all places, then anew for those with critical reviews, and what is fresh a week after the first."""
    cache = ReportCache(spark, shared_path(spark, "cache"), buckets=8)
    rows = document_reviews(spark, sf_dir)
    of = lambda df, day: df.groupBy("place_id").agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"))).alias("report")).withColumn("generated_at", F.lit(day).cast("timestamp"))
    cache.upsert(of(rows, "2024-01-01 00:00:00"))
    cache.upsert(of(rows.where("rating <= 2"), "2024-01-05 00:00:00"))
    fresh = cache.fresh(rows, F.lit("2024-01-08 00:00:00").cast("timestamp")).select("place_id", F.lit(True).alias("fresh"))
    seen = cache.read().join(fresh, "place_id", "left")
    return seen.select("place_id", F.date_format("generated_at", "yyyy-MM-dd").alias("generated"), F.get_json_object("report", "$.n").cast("long").alias("n"), F.coalesce("fresh", F.lit(False)).alias("fresh"))


def usable_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_reviews(spark, sf_dir)
    return rows.select("place_id", "pos", "author", "rating", F.length("text").alias("n_chars"), "date", "likes")


def best_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = A.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    counts = A.order_reviews(spark, sf_dir).groupBy("place_id").agg(F.count(F.lit(1)).alias("reviewsCount"))
    found = R.best_places(nations.join(counts, c("n_nationkey") == c("place_id"), "left"), "n_regionkey", "n_nationkey")
    return found.select("n_regionkey", "n_nationkey", F.coalesce("reviewsCount", F.lit(0)).alias("reviews"))


def place_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = R.project_places(fixtures.raw_places(spark))
    return places.select("place_id", "name", "address", "google_score", "review_count", "category", F.size("subtypes").alias("n_subtypes"), "price", "permanently_closed", "temporarily_closed")


def rating_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rating_histogram(A.order_reviews(spark, sf_dir)).orderBy("place_id", F.desc("star"))


def rating_integrity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heuristics.place_flags(A.order_reviews(spark, sf_dir))


def document_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heuristics.place_flags(document_reviews(spark, sf_dir))


def short_top_rating_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = heuristics.rating_stats(document_reviews(spark, sf_dir))
    return stats.select("place_id", "short_fives", T.rounded(c("short_fives") / c("n"), 6).alias("share"), (c("short_fives") / c("n") > 0.30).alias("flagged"))


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heuristics.duplicate_pairs(document_reviews(spark, sf_dir))


def greedy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.greedy(R.usable_reviews(_compared(spark, sf_dir)))


def repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heuristics.repeated_phrases(document_reviews(spark, sf_dir))


def review_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_reviews(spark, sf_dir)
    return rows.select("place_id", R.review_id(c("pos")).alias("review_id"), R.batch_of(c("pos")).alias("batch"))


def batch_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.batch_prompts(document_reviews(spark, sf_dir)).select("place_id", "batch", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


def verifier_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample(document_reviews(spark, sf_dir), 20, T.VERIFIER_CHARS)


def guardrail_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample(document_reviews(spark, sf_dir), 18, T.GUARDRAIL_CHARS)


def heuristic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heuristics.heuristic_stats(document_reviews(spark, sf_dir))


def aspect_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("batch", "reviews_mentioning", "summary")
    merged = sentiment.merge_aspects(A.line_aspects(spark, sf_dir), order)
    return merged.select("place_id", "aspect", "score", "reviews_mentioning", "summary", "n_evidence", F.array_join("evidence_review_ids", ",").alias("ids"))


def single_batch_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part is a batch with one aspect; every fourth place has two batches, the others one."""
    merged = sentiment.merge_aspects(A.part_aspects(spark, sf_dir), c("batch"))
    return merged.select("place_id", "aspect", "score", "reviews_mentioning", "summary", F.array_join("evidence_review_ids", ",").alias("ids"))


def trimmed_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = sentiment.merge_aspects(A.line_aspects(spark, sf_dir), c("batch"))
    rows = verify.trimmed_aspects(merged)
    return rows.select("place_id", "aspect", "score", F.array_join("evidence_review_ids", ",").alias("ids"))


def aspect_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = verify.aspect_texts(sentiment.merge_aspects(A.line_aspects(spark, sf_dir), c("batch")))
    return texts.select("place_id", F.posexplode("aspect_texts").alias("ord", "observation"))


def enriched_concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third place has a concern given, every third has points only, the others neither."""
    kinds = _place_index(spark, sf_dir).withColumn("kind", c("i") % 3)
    given = kinds.where("kind = 0").select("place_id", F.lit(0).alias("ord"), F.lit("Given").alias("aspect"), F.lit("as stated").alias("evidence"), F.lit(None).cast("double").alias("confidence"), F.lit("Minor").alias("severity"), F.array(F.lit("r7")).alias("supporting_review_ids"))
    claims = kinds.where("kind = 1").select("place_id", F.posexplode(F.array(F.lit("Food - cold"), F.lit("Quiet"))).alias("ord", "claim"))
    points = claims.select("place_id", "ord", F.lit("negative").alias("polarity"), "claim", F.lit(None).cast("string").alias("aspect"), F.lit(None).cast("array<string>").alias("evidence_review_ids"))
    rows = guardrail.enriched("negative", given, points, document_reviews(spark, sf_dir))
    return rows.select("place_id", "ord", "aspect", "evidence", "severity", F.array_join("supporting_review_ids", ",").alias("ids"))


def aspect_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.aspect_scores(A.line_aspects(spark, sf_dir))


def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = A.event_scores(spark, sf_dir).groupBy("place_id", "batch").agg(T.rounded(F.avg("score"), 3).alias("sentiment_score"))
    return batches.withColumn("overall_sentiment", F.when(c("sentiment_score") > 0, "Positive").otherwise("Mixed"))


def sentiment_merge_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.merge_sentiment(event_batches(spark, sf_dir))


def emotion_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*map(F.lit, ("signup", "Excited", "purchase", "Happy", "view", "Neutral", "error", "Angry", "click", "Curious")))
    counts = A.event_scores(spark, sf_dir).groupBy("place_id", "batch", names[c("emotion")].alias("emotion")).agg(F.count(F.lit(1)).alias("n"))
    return sentiment.emotion_distribution(counts)


def shown_emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.shown_emotions(emotion_distribution(spark, sf_dir))


def first_non_empty_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_reviews(spark, sf_dir)
    quotes = rows.select("place_id", c("pos").alias("batch"), F.when(c("rating") >= 5, F.substring("text", 1, 40)).otherwise("").alias("positive_quote"), F.when(c("rating") <= 2, F.substring("text", 1, 40)).alias("negative_quote"))
    return sentiment.merge_firsts(quotes, "positive_quote", "negative_quote")


def keyword_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = document_reviews(spark, sf_dir).select("place_id", "pos", F.slice(T.words(c("text")), 1, 3).alias("keywords"))
    return sentiment.ordered_union(lists, ["place_id"], ["pos"], "keywords", "keyword")


def theme_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = A.table(spark, sf_dir, "part")
    themes = part.select(
        c("p_brand").alias("place_id"), c("p_partkey").alias("ord"), c("p_type").alias("name"), c("p_size").cast("long").alias("frequency"), c("p_name").alias("sentiment"),
        F.concat(F.lit("Q"), c("p_size").cast("string")).alias("representative_quote"), F.concat(F.lit("part "), c("p_partkey").cast("string")).alias("evidence"),
        F.array(F.concat(F.lit("r"), (c("p_partkey") % 7).cast("string"))).alias("evidence_review_ids"),
    )
    merged = sentiment.merge_themes(themes, c("ord"))
    return merged.select("place_id", "name", "frequency", "sentiment", "representative_quote", "evidence", F.array_join("evidence_review_ids", ",").alias("ids"))


def kept_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes of parts, by brand and size: of one batch for some places, which stay as they are, of two for the others."""
    part = A.table(spark, sf_dir, "part")
    place = F.concat_ws("/", "p_brand", F.floor(c("p_size") / 5).cast("string"))
    batch = F.when(F.length(place) % 2 == 0, 0).otherwise(c("p_partkey") % 2).cast("int")
    themes = part.select(place.alias("place_id"), batch.alias("batch"), c("p_partkey").alias("ord"), F.substring_index("p_type", " ", 1).alias("name"), c("p_size").cast("long").alias("frequency"), F.array(F.concat(F.lit("r"), (c("p_partkey") % 5).cast("string"))).alias("evidence_review_ids"))
    merged = sentiment.merge_themes(themes, F.struct("batch", "ord"), themes)
    return merged.select("place_id", "name", "frequency", F.array_join("evidence_review_ids", ",").alias("ids"), c("first.ord").alias("first"))


def batch_emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emotions as batches count them: users' events by 15, a single batch with whatever it names."""
    named = F.create_map(*(F.lit(x) for kv in {"signup": "Excited", "purchase": "Happy", "view": "Neutral", "error": "Angry"}.items() for x in kv))
    counts = A.event_scores(spark, sf_dir).groupBy("place_id", "batch", F.coalesce(named[c("emotion")], c("emotion")).alias("e")).agg(F.count(F.lit(1)).alias("n"))
    said = counts.groupBy("place_id", "batch").agg(F.map_from_entries(F.collect_list(F.struct("e", "n"))).alias("emotion_distribution"))
    return sentiment.merge_emotions(said)


def given_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts given for the places of even number (languages of their documents), those of the reviews for the others."""
    index = _place_index(spark, sf_dir)
    langs = A.table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(c("source").alias("place_id"), "lang").distinct().join(index.where("i % 2 = 0"), "place_id")
    nth = F.row_number().over(Window.partitionBy("place_id").orderBy("lang"))
    given = langs.select("place_id", nth.alias("fact_no"), F.concat(F.lit("Reviews in "), "lang").alias("fact"))
    rating = F.nullif("rating", F.lit(0.0))
    stats = document_reviews(spark, sf_dir).groupBy("place_id").agg(F.count(F.lit(1)).alias("n"), F.avg(rating).alias("rated_avg"))
    none = F.array().cast("array<string>")
    return guardrail.facts_of(given, stats.withColumns({"positive_keywords": none, "negative_keywords": none}))


def dangling_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that events cite and their place has no review for."""
    events = A.table(spark, sf_dir, "events")
    ids = events.select(F.concat(F.lit("src"), (c("user_id") % 20).cast("string")).alias("place_id"), F.concat(F.lit("r"), (c("event_id") % 900).cast("string")).alias("review_id")).distinct()
    return dashboard.dangling_evidence(ids, document_reviews(spark, sf_dir))


def consistency_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.consistency(A.event_scores(spark, sf_dir))


def label_concerns(spark: SparkSession, sf_dir: str, place: str) -> DataFrame:
    """A concern for each document that is toxic or of low quality."""
    labels = A.table(spark, sf_dir, "labels").join(A.table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    severity = F.when((c("quality") == 0) & (c("toxic") == 1), "Major").when(c("quality") == 0, "Moderate").when(c("toxic") == 1, "Minor")
    return labels.withColumn("severity", severity).where("severity IS NOT NULL").select(F.expr(place).alias("place_id"), "severity", "doc_id")


def risk_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    concerns = label_concerns(spark, sf_dir, "concat(lang, '-', doc_id % 97)")
    proposed = concerns.select("place_id", F.when(c("doc_id") % 2 == 0, F.array(F.lit("r1"))).alias("evidence_review_ids"))
    return scoring.risk_penalty(concerns, proposed)


def corrected_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = sentiment.merge_aspects(A.line_aspects(spark, sf_dir), c("batch")).withColumn("place_id", c("place_id").cast("string")).select("place_id", "aspect", "score", F.lit("merged").alias("summary"))
    todo = corrections.applicable(fixtures.corrections(spark), verify.with_defaults(fixtures.verifications(spark)))
    return corrections.corrected_aspects(merged, todo)


def corrected_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = corrections.applicable(fixtures.corrections(spark), verify.with_defaults(fixtures.verifications(spark)))
    rows = sentiment.merge_sentiment(event_batches(spark, sf_dir)).withColumn("place_id", c("place_id").cast("string"))
    return corrections.corrected_sentiment(rows, todo)


def corrected_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = corrections.applicable(fixtures.corrections(spark), verify.with_defaults(fixtures.verifications(spark)))
    return corrections.corrected_keywords(fixtures.keywords(spark), todo)


def correction_concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = corrections.applicable(fixtures.corrections(spark), verify.with_defaults(fixtures.verifications(spark)))
    return corrections.added_concerns(todo).select("place_id", "ord", "aspect", "evidence", "severity", F.array_join("supporting_review_ids", ",").alias("ids"), "source")


def correction_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.corrections(spark)
    return rows.select("place_id", "idx", "field", corrections.badge(c("evidence_review_ids")).alias("badge"))


def _place_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place_id, i): the sources of documents by number."""
    return A.table(spark, sf_dir, "documents").select(c("source").alias("place_id")).distinct().withColumn("i", F.substring("place_id", 4, 10).cast("long"))


def place_verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = c("i")
    status = F.element_at(F.array(*map(F.lit, ("PASS", "CORRECTED", "UNAVAILABLE", "FAIL"))), (i % 4 + 1).cast("int"))
    accuracy = F.when(i % 5 == 0, 0.0).otherwise(0.8 + i * 0.01)
    return _place_index(spark, sf_dir).select("place_id", "i", status.alias("verification_status"), accuracy.alias("accuracy"))


def place_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents").select("doc_id", c("source").alias("place_id"))
    labelled = docs.join(A.table(spark, sf_dir, "labels"), "doc_id").groupBy("place_id")
    return labelled.agg(T.rounded(F.avg((c("toxic") == 0).cast("double")), 2).alias("trust_score"), T.rounded(F.avg((c("quality") == 0).cast("double")), 2).alias("fake_probability"))


def trust_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = place_verifications(spark, sf_dir).join(place_trust(spark, sf_dir), "place_id", "left")
    return rows.select("place_id", scoring.trust_component(c("trust_score"), c("fake_probability"), c("verification_status"), c("accuracy")).alias("trust_comp"))


def recency_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = event_batches(spark, sf_dir)
    rows = batches.groupBy("place_id").agg(F.min_by("sentiment_score", "batch").alias("recent"), T.rounded(F.avg("sentiment_score"), 3).alias("mean"))
    trend = F.element_at(F.array(*map(F.lit, ("Declining", "Improving", "Stable"))), (c("place_id") % 3 + 1).cast("int"))
    recent = F.when(c("place_id") % 7 != 0, c("recent"))
    return rows.select("place_id", trend.alias("trend"), scoring.recency_component(recent, trend, c("mean")).alias("recency_comp"))


def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source of documents is a place; the other tables give its parts by number."""
    places = place_verifications(spark, sf_dir).join(place_trust(spark, sf_dir), "place_id", "left")
    stats = document_reviews(spark, sf_dir).groupBy("place_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("scraped_avg"))
    google = A.order_reviews(spark, sf_dir).where("place_id % 2 = 0").groupBy(c("place_id").cast("long").alias("i")).agg(F.avg("rating").alias("google_score"))
    aspects = aspect_weighted_score(spark, sf_dir).withColumnRenamed("place_id", "i")
    moods = sentiment_merge_label(spark, sf_dir).select(c("place_id").alias("i"), "sentiment_score")
    recent = recency_component(spark, sf_dir).select(c("place_id").alias("i"), "recency_comp")
    steady = consistency_component(spark, sf_dir).withColumnRenamed("place_id", "i")
    concerns = label_concerns(spark, sf_dir, "source").select("place_id", "severity")
    proposed = places.select("place_id", F.when(c("i") % 3 == 0, F.array(F.lit("r1"))).alias("evidence_review_ids"))
    joined = places.join(stats, "place_id").join(scoring.risk_penalty(concerns, proposed), "place_id", "left")
    for part in (google, aspects, moods, recent, steady):
        joined = joined.join(part, "i", "left")
    score = F.coalesce("sentiment_score", F.lit(0.0))
    parts = joined.select(
        "place_id", "n", "trust_score", "verification_status", "accuracy", scoring.sentiment_component(score).alias("sentiment_comp"), F.coalesce("aspect_comp", F.lit(5.0)).alias("aspect_comp"),
        scoring.rating_component(c("google_score"), c("scraped_avg")).alias("rating_comp"), scoring.trust_component(c("trust_score"), c("fake_probability"), c("verification_status"), c("accuracy")).alias("trust_comp"),
        F.coalesce("consistency_comp", F.lit(5.0)).alias("consistency_comp"), F.coalesce("recency_comp", scoring.sentiment_component(score)).alias("recency_comp"), F.coalesce("risk_penalty", F.lit(0.0)).alias("risk_penalty"),
    )
    return scoring.final_scores(parts)


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final_score(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def score_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    aspects = sentiment.merge_aspects(A.line_aspects(spark, sf_dir), c("batch")).select(F.concat(F.lit("src"), c("place_id").cast("string")).alias("place_id"), "aspect", "score")
    rows = dashboard.score_rows(final_score(spark, sf_dir), dashboard.shown_aspects(aspects))
    return rows.select("place_id", "metric", "score", dashboard.score_class(c("score")).alias("class"), dashboard.bar_width(c("score")).alias("width"))


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = final_score(spark, sf_dir)
    return report.printed(scores).join(scores.select("place_id", dashboard.verdict_class(c("verdict")).alias("class")), "place_id")


def fallback_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guardrail.fallback_positives(document_reviews(spark, sf_dir))


def fallback_concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guardrail.fallback_concerns(document_reviews(spark, sf_dir))


def point_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = guardrail.points_as_evidence(fixtures.points(spark))
    return rows.withColumn("supporting_review_ids", F.array_join("supporting_review_ids", ",")).withColumnRenamed("supporting_review_ids", "ids")


def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.evidence_lines(fixtures.points(spark).where("polarity = 'positive'"))


def verified_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_reviews(spark, sf_dir)
    stats = rows.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.nullif("rating", F.lit(0.0))).alias("rated_avg"))
    own = keyword_union(spark, sf_dir).where("ord <= 4").groupBy("place_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "keyword"))), lambda x: x["keyword"]).alias("positive_keywords"))
    return guardrail.verified_facts(stats.join(own, "place_id").withColumn("negative_keywords", F.array().cast("array<string>")))


def verification_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verify.with_defaults(fixtures.verifications(spark))
    return rows.select("place_id", "verification_status", "accuracy", "hallucination_detected")


def verification_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.verification_banner(fixtures.verifications(spark))


def verification_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_reviews(spark, sf_dir)
    stats = rows.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("rated_avg"), F.count_if(c("rating") >= 4).alias("positive"), F.count_if(c("rating") <= 2).alias("critical"))
    none = F.array().cast("array<string>")
    parts = stats.join(place_trust(spark, sf_dir), "place_id").withColumns({"overall_sentiment": F.lit("Mixed"), "aspect_texts": none, "positive_keywords": F.array(F.lit("clean"), F.lit("fast")), "negative_keywords": none})
    return verify.default_observations(parts)


def place_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.place_suggestions(_supplier_features(spark, sf_dir))


def _supplier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as geocoder features of their region's name, with the nations as cities; names repeat."""
    supplier, nation, region = (A.table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = supplier.join(nation, c("s_nationkey") == c("n_nationkey")).join(region, c("n_regionkey") == c("r_regionkey"))
    return rows.select(
        c("r_name").alias("query"), F.lit("nation_1").alias("wanted"), c("s_suppkey").alias("ord"), F.concat(F.lit(" Place "), (c("s_suppkey") % 9).cast("string")).alias("name"),
        F.when(c("s_suppkey") % 4 == 0, "").otherwise(c("n_name")).alias("p_city"), F.when(c("s_suppkey") % 8 == 0, c("n_name")).alias("town"), F.lit(None).cast("string").alias("village"),
        F.when(c("s_suppkey") % 2 == 0, "County").alias("county"), F.lit("").alias("state"), c("r_name").alias("country"), F.lit("house").alias("type"), F.lit("amenity").alias("osm_key"),
        F.array(c("s_acctbal"), c("s_suppkey").cast("double")).alias("coordinates"),
    )


def city_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (A.table(spark, sf_dir, t) for t in ("nation", "region"))
    features = nation.join(region, c("n_regionkey") == c("r_regionkey")).select(
        c("r_name").alias("query"), c("n_nationkey").alias("ord"), c("n_name").alias("name"), F.when(c("n_nationkey") % 5 == 0, "").otherwise(c("r_name")).alias("country"),
        F.when(c("n_nationkey") % 3 == 0, "Place").otherwise("highway").alias("osm_key"), F.when(c("n_nationkey") % 2 == 0, "City").otherwise("road").alias("osm_value"),
    )
    return suggest.city_suggestions(features)


def geocode_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.first_city(_supplier_features(spark, sf_dir), ["query"])


PART_ICONS = {"widget": "W", "gear": "G", "ring": "R", "bolt": "B", "hot": "H", "red": "D"}


def category_icon(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = A.table(spark, sf_dir, "part")
    return part.select("p_partkey", dashboard.category_icon(c("p_type"), F.split("p_name", " "), PART_ICONS, "?").alias("icon"))


def category_icon_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.categories(spark)
    return rows.select("place_id", dashboard.category_icon(c("category"), c("subtypes")).alias("icon"), F.array_join(dashboard.subtype_tags(c("category"), c("subtypes")), "|").alias("tags"))


def subtype_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = A.table(spark, sf_dir, "part")
    tags = dashboard.subtype_tags(F.concat(F.lit("Red "), F.lower("p_type")), F.concat(F.split("p_name", " "), F.array(F.concat(F.lit("RED "), c("p_type")))))
    return part.select("p_partkey", F.array_join(tags, "|").alias("tags"))


def credibility_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = sentiment.merge_aspects(A.line_aspects(spark, sf_dir), c("batch")).where("aspect <> 'accessibility'")
    return dashboard.credibility_table(merged.select("place_id", "aspect", (c("score") >= 5).alias("credible"), (c("score") / 10).alias("share")))


def report_cache_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = A.table(spark, sf_dir, "customer")
    wanted = customer.select("c_custkey", F.concat(F.lit("Café #"), c("c_custkey").cast("string"), F.lit(" / Main-Street")).alias("query"))
    orders = A.table(spark, sf_dir, "orders").withColumn("query", F.concat(F.lit("Café #"), c("o_custkey").cast("string"), F.lit(" / Main-Street")))
    reports = orders.select(T.slug(c("query")).alias("slug"), c("o_orderdate").alias("generated_at"), F.struct("o_orderdate", "o_orderkey").alias("report"))
    latest = readers.fresh_reports(reports, wanted, F.to_timestamp(F.lit("2000-01-05 00:00:00")), 700)
    return latest.select("c_custkey", "slug", F.to_date("generated_at").alias("day"), c("generated_at").isNotNull().alias("hit"))


def source_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.route_requests(fixtures.requests(spark))


def query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.requests(spark)
    return rows.select("query", "city", dashboard.full_query(c("query"), c("city")).alias("full_query"), dashboard.url_warning(c("query")).alias("warn"), T.ellipsis(c("query"), 32, 29).alias("label"))


def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.json_object(c("raw"))
    answers = fixtures.answers(spark).select("id", F.get_json_object(found, "$.k").alias("k"), found.isNotNull().alias("parsed"))
    broken = c("props").substr(F.lit(1), F.length("props") - (c("event_id") % 2).cast("int"))
    events = A.table(spark, sf_dir, "events").withColumn("raw", F.concat(F.lit("<think>{}</think>```json\n"), broken, F.lit("\n```")))
    return answers.unionByName(events.select((c("event_id") + 1000).alias("id"), F.get_json_object(found, "$.k").alias("k"), found.isNotNull().alias("parsed")))


def place_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.project_places(fixtures.raw_places(spark))
    return rows.select("place_id", dashboard.closed_badge(c("permanently_closed"), c("temporarily_closed")).alias("badge"), dashboard.meta_line(c("price"), c("phone")).alias("meta"), T.ellipsis(c("description"), 20, 20).alias("description"))


def guardrail_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = place_trust(spark, sf_dir).select("place_id", "trust_score", c("fake_probability").alias("fake_review_probability"), F.when(c("trust_score") < 0.9, c("trust_score") * 5).alias("adjusted_rating"))
    return dashboard.guardrail_cards(rows)


def pros_and_cons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.points(spark).groupBy("place_id").agg(
        *(F.transform(F.sort_array(F.collect_list(F.when(c("polarity") == p, F.struct("ord", "claim")))), lambda x: x["claim"]).alias(n) for p, n in (("positive", "pros"), ("negative", "cons")))
    )
    return dashboard.pros_and_cons(rows)


def theme_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = sentiment_merge_label(spark, sf_dir)
    trend = F.element_at(F.array(*map(F.lit, ("Declining", "Improving", "Stable"))), (c("place_id") % 3 + 1).cast("int"))
    return labels.select("place_id", dashboard.theme_polarity(c("overall_sentiment")).alias("polarity"), dashboard.trend_icon(trend).alias("icon"))


def url_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.route_requests(readers.expand_urls(fixtures.requests(spark), fixtures.expansions(spark))).select("query", "kind", "max_places")


def sentiment_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda n: F.transform(F.sort_array(F.collect_list(F.when(c("ord") <= n, F.struct("ord", "keyword")))), lambda x: x["keyword"])
    places = keyword_union(spark, sf_dir).where("ord <= 12").groupBy("place_id").agg(words(12).alias("positive_keywords"), words(9).alias("negative_keywords"), words(7).alias("themes"))
    rows = guardrail.sentiment_context(places)
    return rows.select("place_id", *(F.array_join(n, "|").alias(n) for n in ("positive_keywords", "negative_keywords", "themes")))


def trimmed_concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = guardrail.points_as_evidence(fixtures.points(spark)).where("polarity = 'negative'")
    return guardrail.trimmed_concerns(rows).select("place_id", "ord", "aspect", "evidence", "severity")


def evidence_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = guardrail.points_as_evidence(fixtures.points(spark)).withColumn("severity", F.when(c("ord") == 0, c("severity")))
    return guardrail.listing(rows).select("place_id", "polarity", "ord", "evidence", "severity")


def batch_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of users' events cut at a value, so that some have a single batch."""
    rows = event_batches(spark, sf_dir).where("batch = 0 or place_id % 2 = 0")
    return sentiment.batch_extras(rows.withColumn("emotional_tone", F.concat(F.lit("tone "), c("overall_sentiment"))), "emotional_tone")


def suggestion_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.suggestion_grid(place_suggestions(spark, sf_dir))


def model_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.model_info(fixtures.models(spark))


def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.verification_summary(fixtures.verifications(spark))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        final_score, verdict_counts, review_funnel, usable_reviews, best_place, place_projection, rating_histogram, rating_integrity_flags, document_flags, short_top_rating_share,
        source_reviews, cached_reports, exact_rounding, kept_themes, batch_emotions, given_facts, dangling_ids, near_duplicate_pairs, greedy_dedupe, repeated_phrases, review_batches, batch_prompts, verifier_sample, guardrail_sample, heuristic_stats, aspect_merge, single_batch_aspects, trimmed_aspects, aspect_observations, enriched_concerns, aspect_weighted_score,
        sentiment_merge_label, emotion_distribution, shown_emotions, first_non_empty_quote, keyword_union, theme_merge, consistency_component, risk_penalty, corrected_aspects, corrected_sentiment,
        corrected_keywords, correction_concerns, correction_badges, trust_component, recency_component, score_unpivot, report_text, fallback_positives, fallback_concerns, point_evidence, evidence_lines,
        verified_facts, verification_defaults, verification_banner, verification_observations, place_suggestions, city_suggestions, geocode_city, category_icon, category_icon_fixture, subtype_tags,
        credibility_table, report_cache_fresh, source_routing, query_text, json_repair, place_badges, guardrail_cards, pros_and_cons, theme_classes,
        url_expansion, sentiment_context, trimmed_concerns, evidence_listing, batch_extras, suggestion_grid, model_info, verification_summary,
    )
}
