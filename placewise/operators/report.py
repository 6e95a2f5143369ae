"""One report for each place: nested documents from the parts, and their printed form."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.session import cut
from placewise.functions.text import joined, percent

#: Rows of a page of a report.
PAGE_ROWS = 500


def assemble(places: DataFrame, sections: Mapping[str, DataFrame], lists: Mapping[str, tuple[DataFrame, str | Column]]) -> DataFrame:
    """places with a struct column for each section (one row a place) and an array of structs for each list.

    lists: name to (rows, the column that orders them; its name, if it is to come first in each struct). Places without a section have null there, without rows an
    empty list.
    """
    out = places
    for name, part in sections.items():
        fields = [c for c in part.columns if c != "place_id"]
        out = out.join(part.select("place_id", F.struct(*fields).alias(name)), "place_id", "left")
    for name, (rows, order) in lists.items():
        if isinstance(order, str):
            fields = [order, *(c for c in rows.columns if c not in ("place_id", order))]
            ordered = F.sort_array(F.collect_list(F.struct(*fields)))
        else:
            own = F.struct(*(c for c in rows.columns if c != "place_id"))
            ordered = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), own.alias("x")))), lambda r: r["x"])
        packed = rows.groupBy("place_id").agg(ordered.alias(name))
        out = out.join(packed, "place_id", "left").withColumn(name, F.coalesce(name, F.array().cast(packed.schema[name].dataType)))
    return out


def numbered(rows: DataFrame, order: Column) -> DataFrame:
    """rows with a column nth: 1, 2, 3... in each place by order. A place of any size is dealt over many tasks, in its order."""
    sort = [F.asc_nulls_first("place_id"), F.asc_nulls_first("__o")]
    dealt = rows.withColumn("__o", order).repartitionByRange(*sort).sortWithinPartitions(*sort)
    dealt = cut(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    runs = dealt.groupBy("place_id", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))  # one for each place and each border
    before = F.sum("__n").over(Window.partitionBy("place_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("place_id").alias("__p"), F.col("__part").alias("__q"), "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    joined = dealt.join(runs, dealt["place_id"].eqNullSafe(runs["__p"]) & (dealt["__part"] == runs["__q"]))
    return joined.select(*(dealt[c] for c in rows.columns), (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias("nth"))


def paged(places: DataFrame, sections: Mapping[str, DataFrame], lists: Mapping[str, tuple[DataFrame, str | Column]], page_rows: int = PAGE_ROWS) -> DataFrame:
    """(place_id, part, page from 1, n_pages, content): what assemble nests, as pages of JSON.

    The part "report" has the place and its sections on one page; every list is a part of its own, of pages of up to page_rows rows. So
    no value grows with a place: a review's text has REVIEW_CHARS characters at most, and a page page_rows of them.
    """
    head = assemble(places, sections, {})
    out = head.select("place_id", F.lit("report").alias("part"), F.lit(1).cast("long").alias("page"), F.lit(1).cast("long").alias("n_pages"), F.to_json(F.struct(*head.columns)).alias("content"))
    for name, (rows, order) in lists.items():
        kept = numbered(rows, F.col(order) if isinstance(order, str) else order).withColumn("page", F.floor((F.col("nth") - 1) / page_rows) + 1)
        n_pages = kept.groupBy("place_id").agg(F.max("page").alias("n_pages"))
        own = F.struct(*(c for c in rows.columns if c != "place_id"))
        content = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("nth", own.alias("x")))), lambda r: r["x"]))
        pages = kept.groupBy("place_id", "page").agg(content.alias("content")).join(n_pages, "place_id")
        out = out.unionByName(pages.select("place_id", F.lit(name).alias("part"), "page", "n_pages", "content"))
    return out


def gated(reports: DataFrame, required: bool) -> DataFrame:
    """Where verification is required and unavailable, an error instead of a result."""
    failed = F.lit(required) & (F.col("verification_status") == "UNAVAILABLE")
    return reports.withColumn("error", F.when(failed, "Verification is unavailable"))


def overridden(recommendations: DataFrame, scores: DataFrame) -> DataFrame:
    """The explainer's texts under the scorer's label, score and confidence, whatever it says itself."""
    own = [c for c in recommendations.columns if c not in ("label", "visit_score", "confidence")]
    right = scores.select("place_id", F.col("verdict").alias("label"), F.col("final_score").alias("visit_score"), "confidence")
    return recommendations.select(*own).join(right, "place_id")


def verdict_contexts(reports: DataFrame, chars: int = 80) -> DataFrame:
    """(place_id, context): what the explainer is shown of each report of plans.analyze that has a score.

    Fixed values: how many keywords, points, themes, positives and concerns, in order, and how much of their evidence.
    """
    c = F.col
    first = lambda rows, most, one: F.transform(F.slice(rows, 1, most), one)
    polar = lambda name, polarity: F.filter(name, lambda x: x["polarity"] == polarity)
    short = lambda x: F.substring(F.coalesce(x["evidence"], F.lit("")), 1, chars).alias("evidence")
    point = lambda x: F.struct(*(x[n].alias(n) for n in ("claim", "aspect", "evidence_review_ids")))
    context = F.struct(
        c("place_id").alias("location"), c("name").alias("place_name"), "category", c("google_score").alias("google_official"), c("review_stats.analyzed").alias("reviews_analyzed"), c("score.verdict").alias("verdict"), c("score.final_score").alias("visit_score"),
        c("score.confidence").alias("confidence"), c("sentiment.overall_sentiment").alias("overall_sentiment"), c("sentiment.sentiment_score").alias("sentiment_score"),
        first(polar("keywords", "positive"), 6, lambda x: x["keyword"]).alias("top_positive_kw"), first(polar("keywords", "negative"), 4, lambda x: x["keyword"]).alias("top_negative_kw"),
        first(polar("points", "positive"), 5, point).alias("positive_points"), first(polar("points", "negative"), 5, point).alias("negative_points"),
        first(c("themes"), 4, lambda x: F.struct(x["name"].alias("name"), x["sentiment"].alias("sentiment"), short(x))).alias("themes"), c("guardrail.trust_score").alias("trust_score"),
        first(c("positives"), 4, lambda x: F.struct(x["aspect"].alias("aspect"), short(x))).alias("genuine_positives"),
        first(c("concerns"), 3, lambda x: F.struct(x["aspect"].alias("aspect"), x["severity"].alias("severity"), short(x))).alias("genuine_concerns"), c("score").alias("score_breakdown"),
    )
    return reports.where("score IS NOT NULL").select("place_id", context.alias("context"))


def printed(reports: DataFrame) -> DataFrame:
    """(place_id, report_text)"""
    line = F.concat_ws("\n", F.concat(F.lit("Place: "), "place_id"), F.concat(F.lit("Verdict: "), "verdict"), F.format_string("Score: %.2f/10  Confidence: %.3f", "final_score", "confidence"))
    return reports.select("place_id", line.alias("report_text"))


def panels(reports: DataFrame, most: int = 5) -> DataFrame:
    """(place_id, report_text): each report of plans.analyze as a page to read; one with an error is that error.

    Fixed values: the wording and what stands in for what is missing.
    """
    c, said = F.col, "recommendation" in reports.columns
    names = set(reports.schema["recommendation"].dataType.names) if said else set()
    told = lambda field: c(f"recommendation.{field}") if field in names else F.lit(None)
    text = lambda value, missing="": F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(missing))
    line = lambda *parts: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))
    none = F.array().cast("array<string>")
    pros, cons = (F.transform(told(x), lambda p: p["point"]) if x in names else none for x in ("pros", "cons"))
    rows = F.slice(F.arrays_zip(F.coalesce(pros, none).alias("pro"), F.coalesce(cons, none).alias("con")), 1, most)
    table = F.transform(rows, lambda r: F.concat(F.coalesce(r["pro"], F.lit("")), F.lit(" | "), F.coalesce(r["con"], F.lit(""))))
    judged = set(reports.schema["guardrail"].dataType.names) if "guardrail" in reports.columns else set()
    of = lambda field: c(f"guardrail.{field}") if field in judged else F.lit(None).cast("string")
    # what a guardrail says beyond its figures: only lines that have something
    remarks = [F.nullif(joined(" ", of("guardrail_summary"), of("analyst_recommendation")), F.lit(""))]
    if "contradictions" in reports.columns:
        remarks.append(F.nullif(F.array_join(F.transform(F.slice("contradictions", 1, most), lambda x: joined(" | ", x["aspect"], x["positive_claim"], x["negative_claim"], x["resolution"])), "\n"), F.lit("")))
    if "credibility" in reports.columns:
        remarks.append(F.nullif(F.array_join(F.transform("credibility", lambda x: F.concat_ws(" ", x["credible"], x["aspect"], x["share"])), "  "), F.lit("")))
    page = F.concat_ws(
        "\n",
        text(c("name")), line("📍 ", text(c("address"), "Address unavailable")),
        line("⭐ Google score: ", text(c("google_score"), "N/A"), "/5  (", text(c("review_count"), "0"), " total reviews on Google)"), line("🏷  Category: ", text(c("category"), "N/A")),
        line("Raw scraped: ", text(c("review_stats.raw_scraped"), "0"), "  |  Usable text: ", text(c("review_stats.usable_text"), "0"), "  |  Cleaned: ", text(c("review_stats.cleaned"), "0"), "  |  Analyzed: ", text(c("review_stats.analyzed"), "0")),
        line("Model B status: ", text(c("verification.verification_status"), "UNAVAILABLE"), "  |  Accuracy: ", F.coalesce(percent(c("verification.accuracy")), F.lit("N/A")),
             "  |  Hallucination: ", F.initcap(text(c("verification.hallucination_detected"), "none")), "  |  Corrections applied: ", F.size("corrections").cast("string")),
        line(text(c("score.verdict"), "UNKNOWN"), "  Visit score  ", text(c("score.final_score"), "?"), "/10   ·   Confidence  ", percent(F.coalesce("score.confidence", F.lit(0.0))), "   ·   Data reliability  ", text(told("data_reliability"), "?")),
        text(told("one_line_verdict")),
        line("Sentiment ", text(c("score.sentiment_comp"), "?"), "/10  ·  Rating ", text(c("score.rating_comp"), "?"), "/10  ·  Trust ", text(c("score.trust_comp"), "?"), "/10"),
        F.lit("Pros | cons"), F.array_join(table, "\n"), *remarks, text(told("full_verdict"), "No verdict generated."),
    )
    return reports.select("place_id", F.when(c("error").isNotNull(), line(text(c("name")), ": ", c("error"))).otherwise(page).alias("report_text"))


def as_json(reports: DataFrame) -> DataFrame:
    return reports.select("place_id", F.to_json(F.struct(*reports.columns)).alias("report"))


def verification_summary(reports: DataFrame) -> DataFrame:
    """Status and accuracy as the report states them: PASS and 0.94 where missing."""
    return reports.select("place_id", F.coalesce("verification_status", F.lit("PASS")).alias("verification_status"), F.coalesce("accuracy", F.lit(0.94)).alias("accuracy"))
