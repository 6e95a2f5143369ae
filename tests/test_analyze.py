from __future__ import annotations

import json

from pyspark.sql import functions as F

from placewise.__main__ import main
from placewise.plans import models
from placewise.plans.analyze import analyze
from placewise.operators import report, sentiment, verify
from placewise.sources import readers, schemas

PLACE = {
    "title": "Blue Cafe", "address": "Main St", "totalScore": 4.5, "reviewsCount": 9, "categoryName": "Cafe",
    "reviews": [{"name": f"n{i}", "stars": s, "text": t, "publishedAtDate": "2024-01-0%d" % (i + 1)} for i, (s, t) in enumerate([(5, "great coffee and friendly staff"), (5, "great coffee and friendly staff"), (1, "slow and rude"), (4, "nice place"), (3, "")])],
}


def test_reports(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps(PLACE) + "\n" + json.dumps({"title": "Empty"}) + "\n")
    main([str(tmp_path / "in.json"), str(tmp_path / "out")])
    rows = {r["name"]: r for line in (tmp_path / "out").glob("part-*") for r in map(json.loads, line.read_text().splitlines())}
    cafe, empty = rows["Blue Cafe"], rows["Empty"]
    assert cafe["review_stats"] == {"raw_scraped": 5, "usable_text": 4, "cleaned": 3, "analyzed": 3}
    assert cafe["score"]["verdict"] in ("RECOMMENDED", "VISIT WITH CAUTION") and cafe["verification"]["accuracy"] == 0.92
    assert [f["flag"] for f in cafe["flags"]] == ["Too few reviews for high-confidence analysis — treat results with caution"]
    assert empty["error"].startswith("No reviews found") and not {"review_stats", "score", "verification"} & set(empty)
    assert [p["aspect"] for p in cafe["positives"]] == ["Verified Customer Praise"] * 2 and [x["severity"] for x in cafe["concerns"]] == ["Major"]
    assert cafe["facts"][0]["fact"] == "Average rating of analyzed sample is 3.3★ across 3 reviews."
    assert {x["section"]: x["status"] for x in cafe["checks"]} == dict.fromkeys(("sentiment", "aspects", "keywords", "guardrail", "evidence"), "PASS")
    assert {x["section"]: x["observations"][0] for x in cafe["checks"]}["guardrail"] == "Review authenticity trust score confirmed at 85% (anomaly probability: 5.0%)."
    assert [r["pos"] for r in cafe["reviews"]] == [1, 2, 3] and "error" not in cafe


def test_annotations_from_a_folder(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps(PLACE) + "\n")
    key = "Blue Cafe, Main St"
    spark.createDataFrame([(key, 0, "service", 8.25, 1, "s", ["r1"])], schemas.ASPECTS).write.parquet(str(tmp_path / "notes" / "aspects"))
    spark.createDataFrame([(key, 0.5, 0.9)], schemas.GUARDRAIL).write.parquet(str(tmp_path / "notes" / "guardrail.parquet"))
    main([str(tmp_path / "in.json"), str(tmp_path / "out"), "--annotations", str(tmp_path / "notes")])
    (row,) = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert row["score"]["aspect_comp"] == 8.25 and row["guardrail"] == {"trust_score": 0.5, "fake_review_probability": 0.9}


def test_annotations_reach_the_report(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps(PLACE) + "\n")
    raw = readers.read_places(spark, str(tmp_path / "in.json")).withColumn("place_id", F.lit("p"))
    make = spark.createDataFrame
    trend = ("Negative", -0.2, "Positive", 0.6, "Declining", "worse")
    batches = make([("p", 0, 0.5, "Positive", ["fast", "clean"], ["slow"], "", None, None, None), ("p", 1, 0.3, "Mixed", ["kind", "fast"], [], "so kind", "too slow", ("Locals", "x", "y"), trend)], schemas.BATCHES)
    aspects = make([("p", 0, "service", 8.0, 1, "", ["r9", "r3", "r10"]), ("p", 1, "service", 7.0, 2, "kind", ["r2", "r3"])], schemas.ASPECTS)
    themes = make([("p", 0, 0, "speed", "Positive", 2, "so fast", "many say so", ["r9", "r3"]), ("p", 1, 0, "speed", "Negative", 3, "slow", "one", ["r3", "r1"])], schemas.THEMES)
    points = make([("p", 0, 0, "negative", "Queue - long", None, None), ("p", 1, 0, "negative", "Noise", "", ["r2"])], schemas.POINTS)
    sections = make([("p", "sentiment", "CORRECTED", ["seen"], None, ["claim"]), ("p", "keywords", "UNAVAILABLE", [], [], None)], schemas.SECTIONS)
    patterns = make([("p", 0, "odd names"), ("p", 1, "odd names")], schemas.PATTERNS)
    said = make([("p", "prose", "HIGHLY RECOMMENDED", 9.9)], "place_id string, one_line_verdict string, label string, visit_score double")
    row = analyze(raw, {"batches": batches, "aspects": aspects, "themes": themes, "points": points, "sections": sections, "patterns": patterns, "recommendations": said})
    context = report.verdict_contexts(row).first().context
    row = row.first()
    assert (context.place_name, context.reviews_analyzed, context.verdict, context.top_positive_kw, context.top_negative_kw) == ("Blue Cafe", 3, row.score.verdict, ["fast", "clean", "kind"], ["slow"])
    assert [p.claim for p in context.negative_points] == ["Queue - long", "Noise"] and context.positive_points == [] and context.trust_score is None
    assert [tuple(t) for t in context.themes] == [("speed", "Positive", "many say so")] and [x.severity for x in context.genuine_concerns] == ["Moderate", "Minor"]
    assert (row.sentiment.sentiment_score, row.sentiment.overall_sentiment) == (0.4, "Positive")
    assert (row.quotes.standout_positive_quote, row.quotes.standout_negative_quote, row.quotes.temporal_trend.trend, row.quotes.crowd_profile.dominant_visitor_type) == ("so kind", "too slow", "Declining", "Locals")
    assert row.score.recency_comp == 2.5  # (-0.2 + 1) / 2 * 10 - 1.5
    assert [(k.polarity, k.keyword) for k in sorted(row.keywords, key=lambda k: (k.polarity, k.ord))] == [("negative", "slow"), ("positive", "fast"), ("positive", "clean"), ("positive", "kind")]
    (theme,) = row.themes
    assert (theme.frequency, theme.sentiment, theme.representative_quote, theme.evidence_review_ids) == (5, "Positive", "so fast", ["r9", "r3", "r1"])
    assert [(x.aspect, x.severity, x.supporting_review_ids) for x in row.concerns] == [("Queue", "Moderate", ["r1"]), ("Noise", "Minor", ["r2"])]
    checks = {x.section: x for x in row.checks}
    assert (checks["sentiment"].status, checks["sentiment"].observations, checks["sentiment"].issues) == ("CORRECTED", ["seen"], ["claim"])
    assert checks["keywords"].status == "PASS" and checks["keywords"].observations[0].startswith("Frequent positive terms verified in reviews: fast, clean, kind")
    assert checks["aspects"].observations == ["Service: score 7.5/10 confirmed across 3 review mention(s)."]
    assert [f.flag for f in row.flags][-1] == "odd names" and len(row.flags) == 2
    assert (row.recommendation.one_line_verdict, row.recommendation.label, row.recommendation.visit_score) == ("prose", row.score.verdict, row.score.final_score)


def test_merges_keep_first_seen_order(spark):
    aspects = spark.createDataFrame([("p", 0, "service", 8.0, 1, "", ["r9", "r3", "r10"]), ("p", 1, "service", 7.0, 2, "kind", ["r2", "r3"]), ("q", 0, "service", 7.128, 1, "", ["r2", "r2"])], schemas.ASPECTS)
    merged = sentiment.merge_aspects(aspects, F.col("batch")).where("aspect = 'service'")
    got = {r.place_id: (r.score, r.reviews_mentioning, r.summary, r.evidence_review_ids) for r in merged.collect()}
    assert got == {"p": (7.5, 3, "kind", ["r9", "r3", "r10", "r2"]), "q": (7.128, 1, "", ["r2", "r2"])}
    assert [r.evidence_review_ids for r in verify.trimmed_aspects(merged.where("place_id = 'p'")).collect()] == [["r9", "r3"]]


def test_corrections_reach_the_report(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps(PLACE) + "\n")
    raw = readers.read_places(spark, str(tmp_path / "in.json")).withColumn("place_id", F.lit("p"))
    fixes = spark.createDataFrame([("p", 0, "aspects.service", "x", "now 2 of 10", "", ["r1"])], "place_id string, idx int, field string, original_claim string, corrected_claim string, reason string, evidence_review_ids array<string>")
    aspects = spark.createDataFrame([("p", 0, "service", 8.0, 1, "s", ["r1"])], "place_id string, batch int, aspect string, score double, reviews_mentioning bigint, summary string, evidence_review_ids array<string>")
    checked = spark.createDataFrame([("p", "CORRECTED", None, 0.9, False)], "place_id string, verification_status string, status string, accuracy double, hallucination_detected boolean")
    row = analyze(raw, {"corrections": fixes, "aspects": aspects, "verifications": checked}).first()
    assert row.score.aspect_comp == 2.0 and {a.aspect: a.score for a in row.aspects}["service"] == 2.0
    assert analyze(raw, {"corrections": fixes, "aspects": aspects}).first().score.aspect_comp == 8.0  # a PASS applies nothing
    assert analyze(raw, require_verification=True, strict=True).first().error


def _say(prompt):
    if "Analyse the reviews" in prompt:
        raise RuntimeError("this model is decommissioned")
    if "Judge how genuine" in prompt:
        return json.dumps({"trust_score": 0.9, "fake_review_probability": 0.1, "genuine_concerns": [{"aspect": "Staff", "evidence": "rude", "severity": "Minor", "supporting_review_ids": ["r2"]}], "suspicious_patterns": ["odd"]})
    if "Check the analysis" in prompt:
        fix = {"field": "aspects.service", "original_claim": "x", "corrected_claim": "now 3 of 10", "reason": "", "evidence_review_ids": ["r2"]}
        return json.dumps({"status": "CORRECTED", "accuracy": 0.8, "sentiment": {"status": "FAIL", "observations": ["seen"]}, "corrections": [fix, fix | {"evidence_review_ids": []}]})
    return json.dumps({"one_line_verdict": "short", "full_verdict": "long", "recommendation": "NOT RECOMMENDED", "pros": [{"point": "coffee"}, {"point": "place"}], "cons": [{"point": "staff"}], "data_reliability": "Low"})


def _reserve(prompt):
    aspect = {"score": 8.0, "reviews_mentioning": 2, "summary": "s", "evidence_review_ids": ["r1", "r2"]}
    reviews = [{"id": "r1", "score": 0.8, "emotion": "Happy"}, {"id": "r2", "score": -0.5, "emotion": "Angry"}, {"id": "r3", "score": 0.4, "emotion": "Happy"}]
    return "```json\n" + json.dumps({"per_review": reviews, "aspect_scores": {"service": aspect}, "positive_points": [{"claim": "Coffee - good"}], "positive_keywords": ["coffee"], "overall_sentiment": "Mixed", "sentiment_score": 0.3}) + "\n```"


def test_models_reach_the_report(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps(PLACE) + "\n" + json.dumps({"title": "Empty"}) + "\n")
    raw = readers.read_places(spark, str(tmp_path / "in.json")).withColumn("place_id", F.col("title"))
    reports = analyze(raw, ask=models.Models(_say, _say, _say, _say, _reserve))
    rows = {r.place_id: r for r in reports.collect()}
    row = rows["Blue Cafe"]
    assert (row.sentiment.overall_sentiment, row.sentiment.sentiment_score, row.guardrail.trust_score) == ("Mixed", 0.3, 0.9)
    assert (row.verification.verification_status, row.verification.accuracy, row.verification.corrections_count, len(row.corrections)) == ("CORRECTED", 0.8, 1, 2)
    assert row.score.aspect_comp == 3.0 and {a.aspect: a.score for a in row.aspects}["service"] == 3.0
    assert [f.flag for f in row.flags][-1] == "odd" and [x.aspect for x in row.concerns][0] == "Staff" and [x.aspect for x in row.positives] == ["Coffee"]
    assert {x.section: x.observations for x in row.checks}["sentiment"] == ["seen"] and {e.emotion: e.n for e in row.emotions}["Happy"] == 2
    assert (row.recommendation.one_line_verdict, row.recommendation.label) == ("short", row.score.verdict) and rows["Empty"].error
    pages = {r.place_id: r.report_text.split("\n") for r in report.panels(reports).collect()}
    assert pages["Empty"] == ["Empty: No reviews found. Try a more specific location name."]
    page = pages["Blue Cafe"]
    assert page[:4] == ["Blue Cafe", "📍 Main St", "⭐ Google score: 4.5/5  (9 total reviews on Google)", "🏷  Category: Cafe"]
    assert page[4] == "Raw scraped: 5  |  Usable text: 4  |  Cleaned: 3  |  Analyzed: 3"
    assert page[5] == "Model B status: CORRECTED  |  Accuracy: 80%  |  Hallucination: False  |  Corrections applied: 2"
    assert page[-4:] == ["Pros | cons", "coffee | staff", "place | ", "long"] and page[7] == "short"
