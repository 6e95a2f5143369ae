"""Golden reports: what batches, guardrail and settings say reaches the report as it was said."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from placewise.operators import report
from placewise.plans import models
from placewise.plans.analyze import analyze
from placewise.plans.progress import Progress
from placewise.plans.settings import Settings
from placewise.sources import readers, schemas


def raw_places(spark, texts, title="Blue Cafe"):
    reviews = [(f"n{i}", 5.0 - i % 3, t, "2024-01-01", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame([(title, *(None,) * 12, False, reviews)], schemas.RAW_PLACE).withColumn("place_id", F.lit("p"))


def batches(spark, rows):
    """rows: batch, positive keywords, tone, emotions, diversity"""
    full = [("p", b, 0.5, "Positive", words, [], None, None, None, None, tone, emotions, diversity) for b, words, tone, emotions, diversity in rows]
    return spark.createDataFrame(full, f"{schemas.BATCHES}, {schemas.BATCH_EXTRAS}")


def themes(spark, *rows):
    return spark.createDataFrame([("p", b, o, name, "Positive", n, "", "", ids) for b, o, name, n, ids in rows], schemas.THEMES)


def test_a_single_batch_stays_as_it_is(spark):
    said = batches(spark, [(0, ["fast", "clean", "fast"], "Happy", {"Happy": 3, "Joyful": 1}, "High")])
    row = analyze(raw_places(spark, ["one text", "another one"]), {"batches": said, "themes": themes(spark, (0, 0, "speed", 2, ["r1"]), (0, 1, "speed", 3, ["r2"]))}).first()
    assert [k.keyword for k in sorted(row.keywords, key=lambda k: k.ord)] == ["fast", "clean", "fast"]
    assert [(t.name, t.frequency, t.evidence_review_ids) for t in row.themes] == [("speed", 2, ["r1"]), ("speed", 3, ["r2"])]
    assert {e.emotion: e.n for e in row.emotions} == {"Happy": 3, "Joyful": 1}
    assert (row.mood.emotional_tone, row.mood.review_diversity) == ("Happy", "High")


def test_batches_add_up_their_own_emotions(spark):
    said = batches(spark, [(0, ["fast"], "Happy", {"Happy": 3, "Joyful": 1, "Angry": None}, "High"), (1, ["fast", "kind"], "Angry", {"Angry": 2, "Happy": 1}, "Low")])
    spoken = [("p", 0, "r1", "positive", 0.9, "Excited", "", "")]
    row = analyze(raw_places(spark, ["one text", "another one"]), {"batches": said, "per_review": spark.createDataFrame(spoken, schemas.PER_REVIEW), "themes": themes(spark, (0, 0, "speed", 2, ["r1"]), (1, 0, "speed", 3, ["r2"]))}).first()
    assert {e.emotion: e.n for e in row.emotions} == {"Excited": 0, "Happy": 4, "Satisfied": 0, "Neutral": 0, "Disappointed": 0, "Frustrated": 0, "Angry": 2}
    assert [(t.name, t.frequency) for t in row.themes] == [("speed", 5)] and [k.keyword for k in sorted(row.keywords, key=lambda k: k.ord)] == ["fast", "kind"]
    assert (row.mood.emotional_tone, row.mood.review_diversity) == (None, None)  # several batches have none together


def test_reviews_keep_the_order_of_their_numbers(spark):
    texts = [f"text {i} of its own kind number {i * 7919}" for i in range(12)]
    row = analyze(raw_places(spark, texts)).first()
    assert [r.id for r in row.per_review] == [f"r{i}" for i in range(1, 13)]
    spoken = spark.createDataFrame([("p", 1, "r10", "", 0.1, None, "", ""), ("p", 0, "r2", "", 0.1, None, "", ""), ("p", 0, "odd", "", 0.1, None, "", ""), ("p", 0, "r1", "", 0.1, None, "", "")], schemas.PER_REVIEW)
    assert [r.id for r in analyze(raw_places(spark, texts), {"per_review": spoken}).first().per_review] == ["odd", "r1", "r2", "r10"]


GUARDRAIL = {
    "trust_score": 0.9, "credibility_score": 0.8, "fake_review_probability": 0.1, "review_quality": "High", "bias_level": "Low", "bias_direction": "None",
    "rating_integrity": {"distribution_natural": True, "adjusted_true_rating": 4.25, "anomalies": []}, "reviewer_behavior": {"sock_puppet_risk": "Low"},
    "contradiction_analysis": [{"aspect": "service", "positive_claim": "kind", "negative_claim": "rude", "resolution": "mostly kind"}, {"aspect": "food", "positive_claim": "", "negative_claim": None}],
    "aspect_credibility": {"food_quality": {"credible": True, "confidence": 0.9, "note": "n"}, "service": {"credible": False, "confidence": 0.125}},
    "genuine_positives": [{"aspect": "Coffee", "evidence": "good", "confidence": 0.8, "supporting_review_ids": ["r1", "r99"]}], "genuine_concerns": [], "suspicious_patterns": [],
    "verified_facts": ["Open since 1990."], "guardrail_summary": "Mostly real.", "analyst_recommendation": "Trust it.",
}


def say(prompt):
    if "Judge how genuine" in prompt:
        return json.dumps(GUARDRAIL)
    return json.dumps({"sentiment_score": 0.3, "overall_sentiment": "Mixed", "emotional_tone": "Happy", "emotion_distribution": {"Happy": 2}, "review_diversity": "Medium", "negative_points": [{"claim": "Noise", "aspect": "ambience", "evidence_review_ids": ["r2"]}]})


def test_guardrail_answers_in_full(spark):
    out = analyze(raw_places(spark, ["one text", "another one"]), ask=models.Models(say, say))
    row = out.first()
    assert (row.guardrail.credibility_score, row.guardrail.review_quality, row.guardrail.rating_integrity.adjusted_true_rating, row.guardrail.guardrail_summary) == (0.8, "High", 4.25, "Mostly real.")
    assert [(x.aspect, x.resolution) for x in row.contradictions] == [("service", "mostly kind")]  # an empty one says nothing
    assert [(x.aspect, x.credible, x.share) for x in row.credibility] == [("Food Quality", "✅", "90%"), ("Service", "❌", "12%")]
    assert [(f.fact_no, f.fact) for f in row.facts] == [(1, "Open since 1990.")]
    assert [(d.review_id) for d in row.dangling] == ["r99"]
    assert (row.mood.emotional_tone, row.mood.review_diversity, {e.emotion: e.n for e in row.emotions}) == ("Happy", "Medium", {"Happy": 2})
    page = report.panels(out).first().report_text.split("\n")
    assert ["Mostly real. Trust it.", "service | kind | rude | mostly kind", "✅ Food Quality 90%  ❌ Service 12%"] == page[-4:-1]
    context = report.verdict_contexts(out).first().context
    assert context.location == "p" and [(x.claim, x.aspect, x.evidence_review_ids) for x in context.negative_points] == [("Noise", "ambience", ["r2"])]


def test_settings_of_the_environment():
    assert Settings.from_environment({}) == Settings()
    found = Settings.from_environment({"PLACEWISE_STRONG_MODEL": "big", "PLACEWISE_REQUIRE_VERIFICATION": "True", "PLACEWISE_CACHE_DAYS": "3", "PLACEWISE_GAP": " 0.5 ", "PLACEWISE_FAST_MODEL": ""})
    assert (found.strong_model, found.require_verification, found.cache_days, found.gap, found.fast_model) == ("big", True, 3, 0.5, Settings.fast_model)
    assert found.model_names()["model_a"] == "big" and found.strong_quota().tokens == 14_400
    assert Settings().fast_quota().answer < Settings().fast_quota().tokens
    with pytest.raises(ValueError, match="neither true nor false"):
        Settings.from_environment({"PLACEWISE_REQUIRE_VERIFICATION": "perhaps"})


def test_places_of_one_name_stay_apart(spark):
    rows = [("A", "x", 1), ("A", "x", 5), ("A", "", 2), ("B", "x", 1)]
    named = readers.keyed(spark.createDataFrame(rows, "title string, address string, reviewsCount long"))
    assert sorted((r.place_id, r.reviewsCount) for r in named.collect()) == [("A", 2), ("A, x", 5), ("A, x (2)", 1), ("B, x", 1)]


def test_large_places_are_paged(spark):
    rng = __import__("random").Random(3)
    texts = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(99)) for _ in range(8)) for _ in range(640)]
    raw = raw_places(spark, texts).unionByName(raw_places(spark, ["only one"], "Bar").withColumn("place_id", F.lit("q"))).unionByName(raw_places(spark, [], "None").withColumn("place_id", F.lit("none")))
    whole = {r.place_id: r for r in analyze(raw).collect()}
    pages = analyze(raw, page_rows=100).collect()
    by = {}
    for r in sorted(pages, key=lambda r: r.page):
        by.setdefault((r.place_id, r.part), []).append(r)
    for place in ("p", "q"):
        for part, column in (("reviews", "reviews"), ("per_review", "per_review"), ("flags", "flags")):
            found = by.get((place, part), [])
            assert [r.page for r in found] == list(range(1, len(found) + 1)) and all(r.n_pages == len(found) for r in found)
            rows = [json.loads(r.content) for r in found]
            assert all(len(x) == 100 for x in rows[:-1]) and all(len(r.content) < 100 * 4_000 for r in found)
            key = {"reviews": "pos", "per_review": "id", "flags": "flag_no"}[part]
            assert [x[key] for page in rows for x in page] == [x[key] for x in whole[place][column]]
    assert len(by["p", "reviews"]) == 7
    head = {place: json.loads(by[place, "report"][0].content) for place in ("p", "q", "none")}
    assert head["p"]["score"]["final_score"] == whole["p"].score.final_score and "problem" not in head["p"]
    assert head["none"]["problem"]["error"].startswith("No reviews found") and ("none", "reviews") not in by


def test_explained_pages(spark):
    answers = lambda prompt: json.dumps({"one_line_verdict": "short"}) if "Explain the verdict" in prompt else say(prompt)
    pages = analyze(raw_places(spark, ["one text", "another one"]), ask=models.Models(answers, verdict=answers), page_rows=50).where("part = 'report'").first()
    assert json.loads(pages.content)["recommendation"]["one_line_verdict"] == "short"


def test_progress_tells_steps_rows_and_seconds(spark):
    told = []
    progress = Progress(lambda step, title, message: told.append((step, title, message)))
    rows = analyze(raw_places(spark, ["one text", "another one", "one text"]), ask=models.Models(say, say), progress=progress).collect()
    assert len(rows) == 1 and [(x["step"], x["what"], x["rows"]) for x in progress.log] == [(1, "reviews after cleaning", 2), (2, "batches", 1), (3, "places", 1), (5, "places", 1)]
    assert [t[0] for t in told] == [1, 1, 2, 2, 3, 3, 5, 5] and told[1][1:2] == ("Scraping Reviews",) and told[1][2].startswith("2 reviews after cleaning in ")
