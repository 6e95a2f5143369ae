"""Edge cases worked out by hand, and an independent specification in plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from placewise.functions import text as T
from placewise.operators import annotate, dashboard, dedupe, guardrail, heuristics, report, scoring, sentiment, suggest, verify
from placewise.operators import reviews as R
from placewise.sources import readers, schemas

REVIEW = "place_id string, pos int, author string, rating double, text string, date string"


def reviews(spark, texts, place="p"):
    return spark.createDataFrame([(place, i + 1, "a", 5.0, t, None) for i, t in enumerate(texts)], REVIEW)


def kept(df):
    return sorted((r.place_id, r.pos) for r in df.collect())


def plain_greedy(texts, threshold=0.70):
    out, seen = [], []
    for i, t in enumerate(texts):
        w = set(t.lower().split())
        if not any((w | s) and len(w & s) / len(w | s) > threshold for s in seen):
            out.append(i + 1)
            seen.append(w)
    return out


def test_greedy_chain(spark):
    chain = ["1 2 3 4 5 6 7 8 9 10", "1 2 3 4 5 6 7 8 9 11", "1 2 3 4 5 6 7 8 11 12"]
    for f in (dedupe.greedy, dedupe.greedy_fold):
        assert kept(f(reviews(spark, chain))) == [("p", 1), ("p", 3)]


def test_greedy_threshold_is_strict(spark):
    pair = ["1 2 3 4 5 6 7 8", "1 2 3 4 5 6 7 9 10"]  # 7 of 10
    for f in (dedupe.greedy, dedupe.greedy_fold):
        assert len(kept(f(reviews(spark, pair)))) == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_against_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(150):
        if texts and rng.random() < 0.7:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = str(rng.randint(0, 40))
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(str(rng.randint(0, 40)) for _ in range(rng.randint(3, 12))))
    want = [("p", i) for i in plain_greedy(texts)]
    assert kept(dedupe.greedy(reviews(spark, texts))) == want
    assert kept(dedupe.greedy_fold(reviews(spark, texts))) == want


def test_greedy_on_a_template_crowd(spark, monkeypatch):
    """Variants of one template in one place: as a plain loop keeps them, and pairs in proportion to rows, not to their square."""
    rng, found, alike = random.Random(1), [], dedupe._alike

    def counted(*args):
        out = dedupe.cut(alike(*args))
        found.append(out.count())
        return out

    monkeypatch.setattr(dedupe, "_alike", counted)
    base = [f"w{i}" for i in range(20)]
    texts = []
    for _ in range(4000):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            words[rng.randrange(20)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    assert kept(dedupe.greedy(reviews(spark, texts))) == [("p", i) for i in plain_greedy(texts)]
    assert sum(found) < 2 * len(texts)


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_greedy_writes_few_pairs_of_unlike_texts(spark, monkeypatch, broadcast):
    """Texts of one small vocabulary share rare words and aren't alike: their sketches tell, so hardly a pair is written; those alike are found."""
    rng, written, verified = random.Random(3), [], dedupe._verified

    def counted(pairs, *args):
        written.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(dedupe, "_verified", counted)
    monkeypatch.setattr(dedupe, "BROADCAST_ROWS", broadcast)
    texts = [" ".join(f"w{i}" for i in rng.sample(range(400), rng.randint(30, 90))) for _ in range(600)]
    texts += [" ".join([*t.split()[3:], "new"]) for t in texts[:60]]
    want = plain_greedy(texts)
    assert len(want) == 600
    assert kept(dedupe.greedy(reviews(spark, texts))) == [("p", i) for i in want]
    assert sum(written) < len(texts)


def test_funnel_joins_carry_no_more_text_than_is_compared(spark, sf_dir, monkeypatch):
    from placewise.plans import queries

    seen, funnel = [], queries.R.funnel
    monkeypatch.setattr(queries.R, "funnel", lambda raw, cleaned: seen.append(raw) or funnel(raw, cleaned))
    queries.review_funnel(spark, sf_dir)
    assert seen[0].agg(F.max(F.length("text"))).first()[0] == 800


def test_greedy_empty_texts_and_empty_table(spark):
    assert len(kept(dedupe.greedy(reviews(spark, ["", " ", "a"])))) == 3
    assert kept(dedupe.greedy(reviews(spark, []))) == []
    assert [r.pos for r in dedupe.clean(reviews(spark, ["x y", "x y", "z"])).orderBy("pos").collect()] == [1, 2]


def test_usable_reviews(spark):
    raw = spark.createDataFrame([("p", 1, "", 0.0, "    ", "", None), ("p", 2, None, None, "\n ok" + "x" * 900, None, None)], "place_id string, pos int, name string, stars double, text string, publishedAtDate string, likesCount bigint")
    (row,) = R.usable_reviews(raw).collect()
    assert (row.author, row.rating, len(row.text), row.text[:3], row.date, row.likes) == ("Anonymous", 3.0, 800, "okx", None, 0)


def test_numbers_run_over_blocks(spark):
    df = spark.createDataFrame([(p, i) for p in "ab" for i in range(1, 60, 3)], "place_id string, pos int")
    rows = sorted(map(tuple, R.renumbered(df, block=7).collect()))
    assert rows == [(p, i) for p in "ab" for i in range(1, 21)]


def test_best_place_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("q", 1, "a", 5), ("q", 2, "b", 5), ("q", 3, "c", None)], "q string, ord int, name string, reviewsCount int")
    assert [r.name for r in R.best_places(df, "q", "ord").collect()] == ["a"]


def test_repeated_phrases_cut_before_they_filter(spark):
    phrase = [f"word{i} word{i} word{i}" for i in range(6)]
    rows = heuristics.repeated_phrases(reviews(spark, [p for p in phrase for _ in range(4)])).orderBy("rank").collect()
    assert [r.phrase for r in rows] == phrase[:5]
    assert heuristics.repeated_phrases(reviews(spark, ["two words"] * 5)).count() == 0


def test_flags_without_reviews(spark):
    zero = [F.lit(0)] * 5 + [F.lit(0), F.lit(None).cast("string")] + [F.lit(0)] * 3
    assert spark.range(1).select(heuristics.flags(*zero).alias("f")).first().f == ["No reviews to analyze"]


def test_sentiment_labels(spark):
    scores = [0.4, -0.3, 0.15, -0.15, 0.2, -0.2]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in scores], "s double").select(sentiment.sentiment_label(F.col("s"))).collect()]
    assert got == ["Positive", "Negative", "Neutral", "Neutral", "Mixed", "Mixed"]


def test_single_batch_stays_as_it_is(spark):
    df = spark.createDataFrame([("a", 0, 0.9, "Strange"), ("b", 0, 0.5, "x"), ("b", 1, 0.4, "y")], "place_id string, batch int, sentiment_score double, overall_sentiment string")
    got = {r.place_id: (r.sentiment_score, r.overall_sentiment) for r in sentiment.merge_sentiment(df).collect()}
    assert got == {"a": (0.9, "Strange"), "b": (0.45, "Positive")}


def test_verdicts(spark):
    got = [r[0] for r in spark.createDataFrame([(8.0,), (6.5,), (4.5,), (4.49,)], "s double").select(scoring.verdict(F.col("s"))).collect()]
    assert got == ["HIGHLY RECOMMENDED", "RECOMMENDED", "VISIT WITH CAUTION", "NOT RECOMMENDED"]


def test_accuracy_of_zero_counts_as_one(spark):
    row = spark.range(1).select(*(scoring.trust_component(F.lit(0.8), F.lit(0.1), F.lit("PASS"), F.lit(a)).alias(n) for a, n in ((0.0, "a"), (1.0, "b"), (0.5, "c")))).first()
    assert row.a == row.b == 7.5 and row.c == round(5.625, 2) == 5.62  # a tie of doubles goes to even


def test_penalty(spark):
    concerns = spark.createDataFrame([("a", "Major")] * 3 + [("b", "Minor"), ("c", "odd")], "place_id string, severity string")
    fixes = spark.createDataFrame([("b", ["r1"]), ("b", []), ("d", ["r1"])], "place_id string, evidence_review_ids array<string>")
    assert {r[0]: r[1] for r in scoring.risk_penalty(concerns, fixes).collect()} == {"a": 3.0, "b": 0.5, "c": 0.2, "d": 0.3}


def test_consistency_needs_three_scores(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -1.0), ("b", 0.0), ("b", 0.0), ("b", 0.0), ("b", float("nan"))], "place_id string, score double")
    assert {r[0]: r[1] for r in scoring.consistency(df).collect()} == {"a": 5.0, "b": 10.0}


def test_confidence(spark):
    one = lambda *a: spark.range(1).select(scoring.confidence(*map(F.lit, a)).alias("c")).first().c
    assert one(25, 7.0, 0.8, "PASS", 0.0) == 0.85
    assert one(25, 6.9, 0.79, "UNAVAILABLE", None) == 0.4
    assert one(25, 6.9, 0.79, "CORRECTED", 0.9) == 0.45
    assert one(100, 6.9, 0.79, "FAIL", 0.9) == 1.0


def test_unavailable(spark):
    ids = spark.createDataFrame([("a",)], "place_id string")
    assert tuple(verify.unavailable(ids).first()) == ("a", "PASS", 0.92, False)
    assert verify.unavailable(ids, strict=True).first().verification_status == "UNAVAILABLE"


def test_icon_matches_inside_words(spark):
    df = spark.createDataFrame([("Barber shop", ["x"]), ("", None)], "c string, s array<string>")
    assert [r[0] for r in df.select(dashboard.category_icon(F.col("c"), F.col("s"))).collect()] == ["🍺", "📍"]


def test_percent_takes_halves_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (1.0,)], "x double")
    assert [r[0] for r in df.select(T.percent(F.col("x"))).collect()] == ["12%", "14%", "100%"]


def test_points_and_facts(spark):
    df = spark.createDataFrame([("p", 0, "positive", "Food - good", None, None), ("p", 24, "positive", "y" * 50, None, ["r9"])], "place_id string, ord int, polarity string, claim string, aspect string, evidence_review_ids array<string>")
    a, b = guardrail.points_as_evidence(df).orderBy("ord").collect()
    assert (a.aspect, a.confidence, a.supporting_review_ids) == ("Food", 0.92, ["r1"])
    assert (len(b.aspect), b.confidence, b.supporting_review_ids) == (35, -0.04, ["r9"])


def test_trimmed_points_cut_before_they_drop(spark):
    df = spark.sql("SELECT array(null, named_struct('claim', 'a', 'evidence_review_ids', array('r1', 'r2', 'r3')), null, null, named_struct('claim', 'late', 'evidence_review_ids', array('r1'))) AS p")
    (one,) = df.select(verify.trimmed_points(F.col("p")).alias("t")).first().t
    assert (one.claim, one.ids) == ("a", ["r1", "r2"])


def test_annotator(spark):
    prompts = spark.createDataFrame([("p", 0, "x"), ("p", 1, "boom")], "place_id string, batch int, prompt string")

    def answer(prompt):
        if prompt == "boom":
            raise RuntimeError("down")
        return '```json\n{"score": 0.5, "label": "fine'

    rows = annotate.annotate(prompts, answer, "score double, label string").orderBy("batch").collect()
    assert (rows[0].answer.score, rows[0].answer.label) == (0.5, "fine") and rows[1].answer is None
    lex = annotate.lexicon_annotations(spark.createDataFrame([("p", 1, 3.0, "good good bad"), ("p", 2, 1.0, "hm")], "place_id string, pos int, rating double, text string"))
    assert [round(r.score, 3) for r in lex.orderBy("id").collect()] == [0.333, -1.0]


def test_reports_round_trip(spark, tmp_path):
    places = spark.createDataFrame([("a", "A"), ("b", "B")], "place_id string, name string")
    scores = spark.createDataFrame([("a", 7.5)], "place_id string, final_score double")
    flags = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x")], "place_id string, flag_no int, flag string")
    out = report.assemble(places, {"score": scores}, {"flags": (flags, "flag_no")})
    readers.write_reports(out, str(tmp_path / "r"))
    got = {r.place_id: r for r in spark.read.schema(out.schema).json(str(tmp_path / "r")).collect()}
    assert [f.flag for f in got["a"].flags] == ["x", "y"] and got["a"].score.final_score == 7.5
    assert got["b"].flags == [] and got["b"].score is None
    assert report.as_json(out).count() == 2
    assert report.gated(places.withColumn("verification_status", F.lit("UNAVAILABLE")), True).first().error


def test_raw_places_from_json(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"title": "T", "reviewsCount": 3, "reviews": [{"name": "n", "stars": 4, "text": "t"}, {"text": ""}]}\n')
    raw = readers.read_places(spark, str(tmp_path / "p.json")).withColumn("place_id", F.lit("p"))
    assert R.usable_reviews(R.explode_reviews(raw)).count() == 1
    assert R.project_places(raw).first().review_count == 3


def test_first_city_needs_two_coordinates(spark):
    df = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("b", 0, [1.0]), ("b", 1, [3.0, 4.0])], "query string, ord int, coordinates array<double>")
    assert {r.query: (r.lat, r.lon) for r in suggest.first_city(df, ["query"]).collect()} == {"a": (2.0, 1.0), "b": (None, None)}


def test_streams(spark, tmp_path):
    from placewise.streaming import reviews as S

    schema = "place_id string, id string, rating double, at timestamp"
    rows = [("p", "r1", 5.0, "2024-01-01 10:00:00"), ("p", "r1", 5.0, "2024-01-01 10:00:00"), ("p", "r2", 3.0, "2024-01-01 11:00:00")]
    spark.createDataFrame(rows, "place_id string, id string, rating double, at string").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    seen = []
    once = S.distinct_reviews(S.read_stream(spark, str(tmp_path / "in"), schema), "at", ["place_id", "id"])
    query = S.rescore(once, lambda df: df.groupBy("place_id").agg(F.avg("rating").alias("r")), lambda df, _: seen.extend(df.collect()), str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert [(r.place_id, r.r) for r in seen] == [("p", 4.0)]


def test_constants():
    assert tuple(schemas.ASPECT_WEIGHTS) == schemas.ASPECT_NAMES
