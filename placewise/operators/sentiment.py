"""Merging the annotations of a place's batches.

Lists keep the order of first appearance. What a place's single batch says stays as it is, unrounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.text import rounded
from placewise.sources.schemas import ASPECT_NAMES, EMOTIONS


def first_filled(value: Column, order: Column) -> Column:
    """The text of the first row, in order, that is neither null nor empty."""
    return F.min_by(value, F.when(value.isNotNull() & (value != ""), order))


def first_given(value: Column, order: Column) -> Column:
    """The value, a struct or any other, of the first row, in order, that has one."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def ordered_union(lists: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """For each key the distinct elements of its lists, as rows (keys, name, ord from 1) in order of first appearance."""
    rows = lists.select(*keys, *order, F.posexplode(value).alias("__at", name))
    first = rows.groupBy(*keys, name).agg(F.min(F.struct(*order, "__at")).alias("__first"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("__first"))).drop("__first")


def _union(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, value): for each key one list of the distinct elements of all lists, in order of first appearance."""
    elements = rows.select(*keys, order, F.posexplode(value).alias("__at", "__x"))
    first = elements.groupBy(*keys, "__x").agg(F.min(F.struct(order, "__at")).alias("__first"))
    packed = F.sort_array(F.collect_list(F.struct("__first", "__x")))
    return first.groupBy(*keys).agg(F.transform(packed, lambda x: x["__x"]).alias(value))


def _no_ids() -> Column:
    return F.array().cast("array<string>")


def merge_aspects(aspects: DataFrame, order: Column) -> DataFrame:
    """A row for each place and each of the seven aspects; batches without a score don't count.

    Columns: score (mean of batches), reviews_mentioning (sum), summary (first that is filled), n_evidence and
    evidence_review_ids (distinct, in order of first appearance). An aspect without any score has null score and
    summary and no mentions. Rows of a place's single batch stay as they are.
    """
    rows = aspects.withColumn("__o", order)
    scored = rows.where("score IS NOT NULL")
    keys = ["place_id", "aspect"]
    merged = scored.groupBy(*keys).agg(
        rounded(F.avg("score"), 2).alias("score"), F.sum("reviews_mentioning").alias("mentions"), first_filled(F.col("summary"), F.col("__o")).alias("summary")
    )
    merged = merged.join(_union(scored, keys, "__o", "evidence_review_ids"), keys, "left")
    batches = aspects.groupBy("place_id").agg((F.min("batch") == F.max("batch")).alias("single"))
    own = rows.join(batches.where("single"), "place_id").groupBy(*keys).agg(F.min_by(F.struct("score", F.col("reviews_mentioning").alias("mentions"), "summary", "evidence_review_ids"), "__o").alias("own"))
    # merged and single places are apart, so a full join would pair nothing
    found = merged.join(batches.where("single"), "place_id", "left_anti").unionByName(own.select(*keys, "own.*"))
    spine = aspects.select("place_id").distinct().select("place_id", F.explode(F.array(*(F.lit(a) for a in ASPECT_NAMES))).alias("aspect"))
    ids = F.coalesce("evidence_review_ids", _no_ids())
    return spine.join(found, keys, "left").select(*keys, "score", F.coalesce("mentions", F.lit(0)).alias("reviews_mentioning"), "summary", ids.alias("evidence_review_ids"), F.size(ids).alias("n_evidence"))


def sentiment_label(score: Column) -> Column:
    return (
        F.when(score >= 0.4, "Positive").when(score <= -0.3, "Negative").when((score >= -0.15) & (score <= 0.15), "Neutral").otherwise("Mixed")
    )


def merge_sentiment(batches: DataFrame) -> DataFrame:
    """batches (place_id, batch, sentiment_score, overall_sentiment) to a row for each place.

    Several batches: the unweighted mean, with the label it has. A single batch stays as it is.
    """
    merged = batches.groupBy("place_id").agg(
        F.count(F.lit(1)).alias("n_batches"), F.coalesce(rounded(F.avg("sentiment_score"), 3), F.lit(0.0)).alias("mean"), F.first("sentiment_score").alias("own"), F.first("overall_sentiment").alias("label")
    )
    single = F.col("n_batches") == 1
    return merged.select(
        "place_id", "n_batches", F.when(single, F.col("own")).otherwise(F.col("mean")).alias("sentiment_score"), F.when(single, F.col("label")).otherwise(sentiment_label(F.col("mean"))).alias("overall_sentiment")
    )


def emotion_distribution(counts: DataFrame) -> DataFrame:
    """counts (place_id, emotion, n) of all batches to seven rows for each place; other emotions are dropped."""
    wide = counts.groupBy("place_id").agg(*(F.coalesce(F.sum(F.when(F.col("emotion") == e, F.coalesce("n", F.lit(0)))), F.lit(0)).alias(e) for e in EMOTIONS))
    return wide.unpivot("place_id", list(EMOTIONS), "emotion", "n")


def merge_emotions(batches: DataFrame) -> DataFrame:
    """batches (place_id, batch, emotion_distribution) to (place_id, emotion, n).

    Of several batches that say something the counts of the seven emotions add up, others are dropped; a single batch stays as it is, whatever it names.
    """
    single = _singles(batches).withColumnRenamed("place_id", "__p")
    rows = batches.join(single, F.col("place_id").eqNullSafe(F.col("__p")), "left").withColumn("single", F.col("__p").isNotNull()).drop("__p")
    own = rows.where("single").select("place_id", F.explode("emotion_distribution").alias("emotion", "n"))
    many = rows.where("NOT single AND emotion_distribution IS NOT NULL").select("place_id", F.explode_outer("emotion_distribution").alias("emotion", "n"))
    return emotion_distribution(many).unionByName(own)


def _singles(batches: DataFrame) -> DataFrame:
    """(place_id) of the places that have one batch only."""
    return batches.groupBy("place_id").agg((F.min("batch") == F.max("batch")).alias("one")).where("one").select("place_id")


def merge_themes(themes: DataFrame, order: Column, batches: DataFrame | None = None) -> DataFrame:
    """themes (place_id, name, frequency, evidence_review_ids, any others): one row for each name of a place.

    Frequencies add up. Ids that later batches bring follow the first one's list, which stays as it is. All other
    columns, and `first` (the order, for sorting), are those of the first. batches (place_id, batch), if given: all themes of a place with
    a single batch stay as they are, those of one name too.
    """
    keys = ["place_id", "name"]
    rest = [c for c in themes.columns if c not in (*keys, "frequency", "evidence_review_ids")]
    if batches is not None:
        single = _singles(batches)
        own = themes.join(single, "place_id", "left_semi").withColumn("first", order).select(*keys, "frequency", *rest, "evidence_review_ids", "first")
        return merge_themes(themes.join(single, "place_id", "left_anti"), order).unionByName(own)
    rows = themes.withColumn("__o", order)
    firsts = rows.groupBy(*keys).agg(F.sum("frequency").alias("frequency"), F.min("__o").alias("first"), F.min_by(F.struct(*rest, F.col("evidence_review_ids").alias("__ids")), "__o").alias("__f"))
    joined = firsts.join(_union(rows, keys, "__o", "evidence_review_ids").select(F.col("place_id").alias("__p"), F.col("name").alias("__n"), "evidence_review_ids"), F.col("place_id").eqNullSafe(F.col("__p")) & F.col("name").eqNullSafe(F.col("__n")), "left")
    own = F.coalesce("__f.__ids", _no_ids())
    ids = F.concat(own, F.array_except(F.coalesce("evidence_review_ids", _no_ids()), own))
    return joined.select(*keys, "frequency", *(F.col(f"__f.{c}").alias(c) for c in rest), ids.alias("evidence_review_ids"), "first")


def merge_points(points: DataFrame) -> DataFrame:
    """points (place_id, batch, ord, polarity, ...) of all batches one after another: ord runs on, from 0 in each polarity."""
    order = Window.partitionBy("place_id", "polarity").orderBy("batch", "ord")
    return points.withColumn("ord", F.row_number().over(order) - 1).drop("batch")


def merge_keywords(batches: DataFrame) -> DataFrame:
    """(place_id, polarity, ord, keyword) of all batches, each keyword once; those of a single batch as they are."""
    lists = (batches.select("place_id", "batch", F.lit(p).alias("polarity"), F.col(f"{p}_keywords").alias("list")) for p in ("positive", "negative"))
    both, single = next(lists).unionByName(next(lists)), _singles(batches)
    own = both.join(single, "place_id", "left_semi").select("place_id", "polarity", F.posexplode("list").alias("at", "keyword"))
    many = ordered_union(both.join(single, "place_id", "left_anti"), ["place_id", "polarity"], ["batch"], "list", "keyword")
    return many.select("place_id", "polarity", "ord", "keyword").unionByName(own.select("place_id", "polarity", (F.col("at") + 1).alias("ord"), "keyword"))


def keyword_lists(keywords: DataFrame) -> DataFrame:
    """(place_id, positive_keywords, negative_keywords)"""
    of = lambda p: F.transform(F.sort_array(F.collect_list(F.when(F.col("polarity") == p, F.struct("ord", "keyword")))), lambda x: x["keyword"])
    return keywords.groupBy("place_id").agg(of("positive").alias("positive_keywords"), of("negative").alias("negative_keywords"))


def merge_firsts(batches: DataFrame, *columns: str) -> DataFrame:
    """For each place the first filled value, in order of batch, of each column; of a single batch its own, filled or not."""
    single = F.count(F.lit(1)) == 1
    firsts = {c: (first_filled if batches.schema[c].dataType.simpleString() == "string" else first_given)(F.col(c), F.col("batch")) for c in columns}
    return batches.groupBy("place_id").agg(*(F.when(single, F.first(c)).otherwise(x).alias(c) for c, x in firsts.items()))


def batch_extras(batches: DataFrame, *columns: str) -> DataFrame:
    """Columns that only a place's single batch can give: with several batches they are null."""
    single = F.count(F.lit(1)) == 1
    return batches.groupBy("place_id").agg(*(F.when(single, F.first(c)).alias(c) for c in columns))
