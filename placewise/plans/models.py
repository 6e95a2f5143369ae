"""The language models' part in a report: prompts made of reviews, answers back as the tables of sources.schemas.

A model is a function from a prompt to an answer in JSON; it runs in the executors, one call for each batch or place. What a
model doesn't answer is missing from the tables, and the operators' defaults stand in for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.functions.session import cut
from placewise.functions.text import GUARDRAIL_CHARS, VERIFIER_CHARS
from placewise.operators import guardrail, heuristics, report, sentiment, verify
from placewise.operators import reviews as R
from placewise.operators.annotate import annotate
from placewise.operators.quota import Quota
from placewise.plans.progress import Progress
from placewise.sources import schemas

Model = Callable[[str], str]

#: The fields of the answers.
SENTIMENT = (
    "per_review array<struct<id: string, sentiment: string, score: double, emotion: string, intensity: string, key_phrase: string>>, "
    "aspect_scores map<string, struct<score: double, reviews_mentioning: bigint, summary: string, evidence_review_ids: array<string>>>, "
    "themes array<struct<name: string, sentiment: string, frequency: bigint, representative_quote: string, evidence: string, evidence_review_ids: array<string>>>, "
    "positive_points array<struct<claim: string, aspect: string, evidence_review_ids: array<string>>>, negative_points array<struct<claim: string, aspect: string, evidence_review_ids: array<string>>>, "
    + schemas.BATCHES.split(", ", 2)[2] + f", {schemas.BATCH_EXTRAS}"
)
_EVIDENCE = "array<struct<aspect: string, evidence: string, confidence: double, severity: string, supporting_review_ids: array<string>>>"
GUARDRAIL = (
    "trust_score double, credibility_score double, fake_review_probability double, review_quality string, bias_level string, bias_direction string, "
    "linguistic_analysis struct<templated_language_detected: boolean, copy_paste_evidence: string, vocabulary_diversity: string, writing_style_consistency: string, language_notes: string>, "
    "rating_integrity struct<distribution_natural: boolean, anomalies: array<string>, inflated_stars_estimate: double, suppressed_stars_estimate: double, adjusted_true_rating: double, rating_notes: string>, "
    "reviewer_behavior struct<sock_puppet_risk: string, coordinated_posting_risk: string, evidence: string>, "
    "contradiction_analysis array<struct<aspect: string, positive_claim: string, negative_claim: string, resolution: string>>, aspect_credibility map<string, struct<credible: boolean, confidence: double, note: string>>, "
    f"genuine_positives {_EVIDENCE}, genuine_concerns {_EVIDENCE}, suspicious_patterns array<string>, verified_facts array<string>, guardrail_summary string, analyst_recommendation string"
)
_SECTION = "struct<status: string, observations: array<string>, issues: array<string>, unsupported_claims: array<string>>"
VERIFIER = (
    f"verification_status string, status string, accuracy double, hallucination_detected boolean, {', '.join(f'{s} {_SECTION}' for s in verify.SECTIONS)}, "
    "corrections array<struct<field: string, original_claim: string, corrected_claim: string, reason: string, evidence_review_ids: array<string>>>"
)
VERDICT = (
    "one_line_verdict string, full_verdict string, best_for array<string>, avoid_if array<string>, pros array<struct<point: string, weight: string>>, "
    "cons array<struct<point: string, weight: string>>, visitor_tips array<string>, best_time string, data_reliability string"
)
GUARDRAIL_REVIEWS, VERIFIER_REVIEWS, FEWER_REVIEWS = 18, 20, 10


@dataclass(frozen=True)
class Models:
    """Which model does what; a place goes without those that are None. reserve: asked where another one is gone."""

    sentiment: Model
    guardrail: Model | None = None
    verifier: Model | None = None
    verdict: Model | None = None
    reserve: Model | None = None
    #: What the services allow: of the sentiment and verdict model, and of the guardrail and verifier.
    strong_quota: Quota | None = None
    fast_quota: Quota | None = None


def _asked(rows: DataFrame, task: str, schema: str) -> DataFrame:
    """(place_id, batch, prompt) of rows (place_id, batch, prompt): the task, the answer's form, the data."""
    head = f"{task}\nAnswer with one JSON object and nothing else. Its fields: {schema}\n\n"
    return rows.select("place_id", "batch", F.concat(F.lit(head), "prompt").alias("prompt"))


def _as_json(packed: DataFrame) -> DataFrame:
    data = F.to_json(F.struct(*(x for x in packed.columns if x != "place_id")))
    return packed.select("place_id", F.lit(0).alias("batch"), data.alias("prompt"))


def _answered(answers: DataFrame) -> DataFrame:
    return answers.where("answer IS NOT NULL").select("place_id", "batch", "answer.*")


def sentiment_tables(answers: DataFrame) -> dict[str, DataFrame]:
    """The tables per_review, aspects, themes, points and batches of answers (place_id, batch, answer of SENTIMENT)."""
    a = _answered(answers)
    listed = lambda name: a.select("place_id", "batch", F.posexplode(name).alias("ord", "x")).where("x IS NOT NULL")
    points = [listed(f"{p}_points").select("place_id", "batch", "ord", F.lit(p).alias("polarity"), "x.*") for p in ("positive", "negative")]
    return {
        "per_review": listed("per_review").select("place_id", "batch", "x.*"),
        "aspects": a.select("place_id", "batch", F.explode("aspect_scores").alias("aspect", "x")).select("place_id", "batch", "aspect", "x.*"),
        "themes": listed("themes").select("place_id", "batch", "ord", "x.*"),
        "points": points[0].unionByName(points[1]),
        "batches": a.drop("per_review", "aspect_scores", "themes", "positive_points", "negative_points"),
    }


def guardrail_tables(answers: DataFrame) -> dict[str, DataFrame]:
    """The tables guardrail, positives, concerns, patterns, facts, contradictions and credibility of answers (place_id, batch, answer of GUARDRAIL)."""
    a = _answered(answers)
    listed = lambda name: a.select("place_id", F.posexplode(name).alias("ord", "x")).where("x IS NOT NULL")
    return {
        "guardrail": a.drop("batch", "genuine_positives", "genuine_concerns", "suspicious_patterns", "verified_facts", "contradiction_analysis", "aspect_credibility"),
        "facts": listed("verified_facts").select("place_id", (F.col("ord") + 1).alias("fact_no"), F.col("x").alias("fact")),
        "contradictions": listed("contradiction_analysis").select("place_id", "ord", "x.*"),
        "credibility": a.select("place_id", F.explode("aspect_credibility").alias("aspect", "x")).select("place_id", "aspect", "x.credible", F.col("x.confidence").alias("share"), "x.note"),
        "positives": listed("genuine_positives").select("place_id", "ord", "x.*"),
        "concerns": listed("genuine_concerns").select("place_id", "ord", "x.*"),
        "patterns": listed("suspicious_patterns").select("place_id", "ord", F.col("x").alias("pattern")),
    }


def verifier_tables(answers: DataFrame) -> dict[str, DataFrame]:
    """The tables verifications, sections and corrections of answers (place_id, batch, answer of VERIFIER)."""
    a = _answered(answers)
    sections = F.explode(F.array(*(F.struct(F.lit(s).alias("section"), F.col(s).alias("x")) for s in verify.SECTIONS)))
    return {
        "verifications": a.select("place_id", "verification_status", "status", "accuracy", "hallucination_detected"),
        "sections": a.select("place_id", sections.alias("s")).where("s.x IS NOT NULL").select("place_id", "s.section", "s.x.*"),
        "corrections": a.select("place_id", F.posexplode("corrections").alias("idx", "x")).where("x IS NOT NULL").select("place_id", "idx", "x.*"),
    }


def _sample(reviews: DataFrame, first: int, chars: int) -> tuple[DataFrame, str]:
    return R.sample(reviews, first, chars).withColumn("at", F.substring("id", 2, 10).cast("int")), "at"


def ask(reviews: DataFrame, models: Models, progress: Progress | None = None) -> dict[str, DataFrame]:
    """All annotations that the models make of cleaned reviews, each answer computed once.

    The guardrail sees the merged sentiment, the flags and the first reviews; the verifier sees first reviews and
    what the two say, and is asked again with fewer reviews where it gives no answer.
    """
    steps = progress or Progress()
    steps.begin(2, "Analyzing reviews in batches...")
    prompts = _asked(R.batch_prompts(reviews), "Analyse the reviews of a place; their ids are in brackets, cite them as evidence.", SENTIMENT)
    out = sentiment_tables(steps.kept(annotate(prompts, models.sentiment, SENTIMENT, models.reserve, quota=models.strong_quota), 2, "batches"))
    places = reviews.select("place_id").distinct()
    mood = sentiment.merge_sentiment(out["batches"].select("place_id", "batch", "sentiment_score", "overall_sentiment"))
    words = sentiment.keyword_lists(sentiment.merge_keywords(out["batches"]))
    points = sentiment.merge_points(out["points"])
    if models.guardrail:
        steps.begin(3, "Checking review authenticity and trust...")
        themes = sentiment.merge_themes(out["themes"], F.struct("batch", "ord"), out["batches"]).drop("batch", "ord")
        seen = report.assemble(places.join(words, "place_id", "left"), {}, {"themes": (themes, "first")})
        parts = {"sentiment": mood, "context": guardrail.sentiment_context(seen), "quotes": sentiment.merge_firsts(out["batches"], "temporal_trend"), "stats": heuristics.heuristic_stats(reviews)}
        lists = {"flags": (heuristics.place_flags(reviews), "flag_no"), "reviews": _sample(reviews, GUARDRAIL_REVIEWS, GUARDRAIL_CHARS)}
        prompts = _asked(_as_json(report.assemble(places, parts, lists)), "Judge how genuine the reviews of a place are.", GUARDRAIL)
        out |= guardrail_tables(steps.kept(annotate(prompts, models.guardrail, GUARDRAIL, models.reserve, quota=models.fast_quota), 3, "places"))
    if models.verifier:
        steps.begin(4, "Verifying the analysis independently...")
        empty = places.sparkSession.createDataFrame([], schemas.EVIDENCE)
        concerns = guardrail.enriched("negative", out.get("concerns", empty), points, reviews)
        shown = [c.alias(n) for n, c in (("place_id", F.col("place_id")), ("positive_keywords", F.slice("positive_keywords", 1, 6)), ("negative_keywords", F.slice("negative_keywords", 1, 6)))]
        parts = {"sentiment": mood, "keywords": words.select(*shown)}
        if "guardrail" in out:
            parts["trust"] = out["guardrail"].select("place_id", "trust_score")
        ids = F.slice("supporting_review_ids", 1, 2).alias("ids")
        lists = {"aspects": (verify.trimmed_aspects(sentiment.merge_aspects(out["aspects"], F.col("batch"))).drop("summary", "n_evidence"), "aspect"), "concerns": (concerns.where("ord < 4").select("place_id", "ord", "aspect", "severity", ids), "ord")}
        for p in ("positive", "negative"):
            lists[f"{p}_points"] = (points.where(F.col("polarity") == p).where("ord < 4").select("place_id", "ord", F.substring("claim", 1, 80).alias("claim"), F.slice("evidence_review_ids", 1, 2).alias("ids")), "ord")
        packed = cut(report.assemble(places, parts, lists))
        task = "Check the analysis against the reviews of a place; correct only what they don't support, citing review ids."
        asked = lambda these, first: _asked(_as_json(report.assemble(these, {}, {"reviews": _sample(reviews, first, VERIFIER_CHARS)})), task, VERIFIER)
        answers = steps.kept(annotate(asked(packed, VERIFIER_REVIEWS), models.verifier, VERIFIER, attempts=1, quota=models.fast_quota), 4, "places")
        longer = reviews.where(F.col("pos") > FEWER_REVIEWS).select("place_id").distinct()
        silent = packed.join(answers.where("answer IS NULL"), "place_id", "left_semi").join(longer, "place_id", "left_semi")
        again = cut(annotate(asked(silent, FEWER_REVIEWS), models.verifier, VERIFIER, attempts=1, quota=models.fast_quota))
        out |= verifier_tables(answers.where("answer IS NOT NULL").unionByName(again))
    return out


def explain(reports: DataFrame, model: Model, reserve: Model | None = None, quota: Quota | None = None) -> DataFrame:
    """(place_id, the fields of VERDICT) for each report that has a score."""
    prompts = _asked(_as_json(report.verdict_contexts(reports)), "Explain the verdict on a place to a visitor; label and score stand.", VERDICT)
    return _answered(cut(annotate(prompts, model, VERDICT, reserve, quota=quota))).drop("batch")
