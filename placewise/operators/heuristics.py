"""Integrity statistics of a place's reviews, and the flags that they raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.text import jaccard, percent, rounded, trigrams, word_set, words

FIRST = 30
PAIR_THRESHOLD = 0.55


def duplicate_pairs(reviews: DataFrame) -> DataFrame:
    """(place_id, duplicate_pairs) over the first 30 reviews of each place; places without pairs have 0."""
    early = reviews.where(F.col("pos") <= FIRST).select("place_id", "pos", word_set(F.col("text")).alias("words"))
    a, b = early.alias("a"), early.alias("b")
    met = a.join(b, (F.col("a.place_id") == F.col("b.place_id")) & (F.col("a.pos") < F.col("b.pos")))  # at most 435 rows a place
    found = met.where(jaccard(F.col("a.words"), F.col("b.words")) > F.lit(PAIR_THRESHOLD)).groupBy("a.place_id").agg(F.count(F.lit(1)).alias("n"))
    places = reviews.select("place_id").distinct()
    return places.join(found, "place_id", "left").select("place_id", F.coalesce("n", F.lit(0)).alias("duplicate_pairs"))


def repeated_phrases(reviews: DataFrame, most: int = 5, at_least: int = 4) -> DataFrame:
    """(place_id, rank, phrase, cnt): of the five commonest trigrams of the first 30 texts those seen four times."""
    early = reviews.where(F.col("pos") <= FIRST)
    grams = early.select("place_id", "pos", F.posexplode(trigrams(words(F.col("text")))).alias("at", "phrase"))
    counts = grams.groupBy("place_id", "phrase").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("pos", "at")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("place_id").orderBy(F.desc("cnt"), "first"))
    return counts.withColumn("rank", rank).where((F.col("rank") <= most) & (F.col("cnt") >= at_least)).select("place_id", "rank", "phrase", "cnt")


def rating_stats(reviews: DataFrame) -> DataFrame:
    """The counts that flags compare, in one pass; reviews without a text column have null text figures."""
    text = F.col("text") if "text" in reviews.columns else F.lit(None).cast("string")
    day = F.nullif(F.substring("date", 1, 10), F.lit(""))
    short = (F.col("rating") == 5) & (F.length(text) < 12)
    return reviews.groupBy("place_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rating").alias("avg_rating"), F.count_if(F.col("rating") == 5).alias("fives"), F.count_if(F.col("rating") == 1).alias("ones"),
        F.count_distinct("rating").alias("n_ratings"), F.count_if(short).alias("short_fives"), F.avg(F.length(text)).alias("avg_length"),
        F.count_distinct("author").alias("unique_authors"), F.count(day).alias("n_dates"), F.count_distinct(day).alias("n_days"),
    )


def heuristic_stats(reviews: DataFrame) -> DataFrame:
    """One row of statistics for each place."""
    phrases = repeated_phrases(reviews).where("rank <= 3").groupBy("place_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "phrase"))), lambda x: x["phrase"]), " | ").alias("repeated"))
    stats = rating_stats(reviews).join(duplicate_pairs(reviews), "place_id").join(phrases, "place_id", "left")
    n = F.col("n")
    return stats.select(
        "place_id", n.alias("total_reviews"), rounded(F.col("avg_rating"), 2).alias("avg_rating"), rounded(F.col("fives") / n, 2).alias("five_star_pct"), rounded(F.col("ones") / n, 2).alias("one_star_pct"),
        rounded(F.col("avg_length"), 0).alias("avg_review_length"), "unique_authors", "duplicate_pairs", F.coalesce("repeated", F.lit("")).alias("repeated_phrases"),
    )


def flags(n: Column, fives: Column, ones: Column, n_ratings: Column, short_fives: Column, pairs: Column, phrases: Column, authors: Column, n_dates: Column, n_days: Column) -> Column:
    """The texts of the flags raised, in their order; phrases is null or the repeated phrases as text. The texts."""
    share = lambda x: x / n
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    raised = F.array_compact(F.array(
        F.when(share(fives) > 0.75, text("Unusually high 5-star ratio (", percent(share(fives)), ") — potential rating manipulation")),
        F.when(share(ones) > 0.40, text("High 1-star ratio (", percent(share(ones)), ") — possible targeted negative campaign")),
        F.when(n_ratings == 1, F.lit("All reviews share the exact same star rating — highly suspicious uniformity")),
        F.when(share(short_fives) > 0.30, text(short_fives.cast("string"), " very short 5-star reviews (< 12 chars) — likely filler boosts")),
        F.when(pairs >= 3, text(pairs.cast("string"), " near-duplicate review pairs (>55% word overlap)")),
        F.when(phrases.isNotNull(), text("Repeated phrases across reviews: ", phrases, " — coordinated language")),
        F.when((authors / n < 0.7) & (n > 8), text("Low author diversity (", authors.cast("string"), " unique / ", n.cast("string"), " reviews) — possible sock-puppets")),
        F.when(n < 6, F.lit("Too few reviews for high-confidence analysis — treat results with caution")),
        F.when((n_dates >= 5) & (F.try_divide(n_days, n_dates) < 0.25), F.lit("Many reviews share the same date — possible coordinated review-bombing")),
    ))
    return F.when(n == 0, F.array(F.lit("No reviews to analyze"))).otherwise(raised)


def place_flags(reviews: DataFrame) -> DataFrame:
    """(place_id, flag_no, flag): a row for each flag that a place's reviews raise."""
    stats = rating_stats(reviews)
    if "text" in reviews.columns:
        lists = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "phrase"))), lambda x: F.concat(F.lit("'"), x["phrase"], F.lit("'"))), ", ")
        phrases = repeated_phrases(reviews).where("rank <= 3").groupBy("place_id").agg(F.concat(F.lit("["), lists, F.lit("]")).alias("phrases"))
        stats = stats.join(duplicate_pairs(reviews), "place_id").join(phrases, "place_id", "left")
    else:
        stats = stats.withColumns({"duplicate_pairs": F.lit(0), "phrases": F.lit(None).cast("string")})
    c = F.col
    raised = flags(c("n"), c("fives"), c("ones"), c("n_ratings"), c("short_fives"), c("duplicate_pairs"), c("phrases"), c("unique_authors"), c("n_dates"), c("n_days"))
    return stats.select("place_id", F.posexplode(raised).alias("at", "flag")).select("place_id", (c("at") + 1).alias("flag_no"), "flag")


def merged_flags(flags: DataFrame, patterns: DataFrame) -> DataFrame:
    """(place_id, flag_no, flag): the raised flags, then the annotator's patterns (place_id, ord, pattern), each text once."""
    own = flags.select("place_id", F.struct(F.lit(0).alias("from"), F.col("flag_no").alias("at")).alias("order"), "flag")
    told = patterns.select("place_id", F.struct(F.lit(1).alias("from"), F.col("ord").alias("at")).alias("order"), F.col("pattern").alias("flag"))
    first = own.unionByName(told).groupBy("place_id", "flag").agg(F.min("order").alias("order"))
    return first.select("place_id", F.row_number().over(Window.partitionBy("place_id").orderBy("order")).alias("flag_no"), "flag")
