"""Greedy removal of near-duplicate reviews: a row goes if an earlier kept row of its place is alike.

That is the first maximal independent set of the likeness graph in order of pos; neither an anti-join nor connected
components give it. `greedy` finds it without collecting a place, and without writing the pairs of a crowd:

1. rows with equal word sets (words as 64-bit hashes) collapse to the first (later ones share its fate or are dropped by it);
2. rows are indexed under a prefix of their words in order of rarity: two sets whose likeness exceeds the threshold share a
   word among the first n - ceil(threshold * n) + 1 of each (Bayardo et al., 2007), and enough words can follow their first
   common one (the positional filter). Rows of the index carry a sketch of LANES longs, in which each word of the row turns one bit: two sketches differ in no
   more bits than their sets in words, so pairs whose sketches differ by more than the threshold allows are left before they are written;
3. each round takes the first open rows of each word, FIRST at first and GROWTH times as many in each round. A row that is among them for all its
   words has met all earlier open rows that it can be like, so it can be settled: kept if they are all dropped, dropped if one is kept.
   Then open rows are compared with the rows just kept, and with them only, and those alike are dropped.

A crowd of rows alike is gone after the round that keeps its first, at one comparison for each row. Rows that share rare words
but stay below the threshold have to be compared (the filters apart); their rounds are as many as the logarithm of the longest list.

`greedy_fold` says the same as one expression for each place; it is quadratic, and meant for small places and tests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.session import cut
from placewise.functions.text import jaccard, word_set

THRESHOLD = 0.70
#: Open rows of a word that the first round settles, and by what that grows from round to round.
FIRST = 8
GROWTH = 4
#: Longs of a sketch.
LANES = 2
#: Rows that pairs name, up to which their words are picked by a broadcast and not by an exchange of all words.
BROADCAST_ROWS = 200_000

_SKETCH = [f"s{k}" for k in range(LANES)]


def greedy_fold(reviews: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(place_id, pos) of the rows kept."""
    rows = reviews.groupBy("place_id").agg(F.sort_array(F.collect_list(F.struct("pos", word_set(F.col("text")).alias("words")))).alias("rows"))

    def step(kept: Column, row: Column) -> Column:
        alike = F.exists(kept, lambda k: jaccard(k["words"], row["words"]) > F.lit(threshold))
        return F.when(F.coalesce(alike, F.lit(False)), kept).otherwise(F.concat(kept, F.array(row)))

    none = F.slice(F.col("rows"), 1, 0)
    return rows.select("place_id", F.explode(F.aggregate("rows", none, step)).alias("k")).select("place_id", F.col("k.pos").alias("pos"))


def _sketch(words: Column) -> list[Column]:
    """LANES longs: the words turn a bit each, so where two sketches differ so do the sets, by a word at least for each bit."""
    turned = lambda held, w: held.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int")))
    lane = lambda k: F.filter(F.transform(words, lambda w: F.xxhash64(w)), lambda w: F.pmod(F.shiftright(w, 6), F.lit(LANES)) == k)
    return [F.aggregate(lane(k), F.lit(0).cast("long"), turned).alias(name) for k, name in enumerate(_SKETCH)]


def _prefix(sets: DataFrame, threshold: float) -> DataFrame:
    """(place_id, word, pos, n, rank, sketch) for sets (place_id, pos, words): a row under those of its words that others can find it by."""
    tokens = sets.select("place_id", "pos", F.size("words").alias("n"), F.explode("words").alias("word"))
    rarity = tokens.groupBy("place_id", "word").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")
    # words that one row has can't be shared; the ranks of the others start behind them
    shared = tokens.join(rarity, ["place_id", "word"])
    row = Window.partitionBy("place_id", "pos")
    rank = F.row_number().over(row.orderBy("seen", "word")) + F.col("n") - F.count(F.lit(1)).over(row)
    prefix = shared.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold)) + 1)
    return prefix.join(sets.select("place_id", "pos", *_sketch(F.col("words"))), ["place_id", "pos"]).select("place_id", "word", "pos", "n", "rank", *_SKETCH)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (place_id, a, b) whose words are alike indeed."""
    pairs = cut(pairs)
    rows = cut(pairs.select("place_id", F.explode(F.array("a", "b")).alias("pos")).distinct())
    if rows.count() <= BROADCAST_ROWS:
        sets = sets.join(F.broadcast(rows), ["place_id", "pos"], "left_semi")
    words = lambda end: sets.select("place_id", F.col("pos").alias(end), F.col("words").alias(f"words_{end}"))
    both = pairs.join(words("a"), ["place_id", "a"]).join(words("b"), ["place_id", "b"])
    return both.where(jaccard(F.col("words_a"), F.col("words_b")) > F.lit(threshold)).select("place_id", "a", "b")


def _alike(earlier: DataFrame, later: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(place_id, a, b), a < b, of rows of two indexes whose likeness exceeds the threshold."""
    left, right = (df.withColumnsRenamed({"pos": end, **{c: f"{c}{end}" for c in ("n", "rank", *_SKETCH)}}) for df, end in ((earlier, "a"), (later, "b")))
    near = (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")) & (F.col("a") < F.col("b"))
    # at their first common word, two sets can have only what follows it in common besides
    near &= 1 + F.least(F.col("na") - F.col("ranka"), F.col("nb") - F.col("rankb")) > F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-6
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in _SKETCH))
    near &= differ < F.lit((1 - threshold) / (1 + threshold)) * (F.col("na") + F.col("nb")) + 1e-6
    return _verified(left.join(right, ["place_id", "word"]).where(near).select("place_id", "a", "b").distinct(), sets, threshold)


def alike_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(place_id, a, b) with a < b for sets (place_id, pos, words) whose likeness exceeds the threshold."""
    index = _prefix(sets, threshold)
    return _alike(index, index, sets, threshold)


def _settled(pairs: DataFrame, able: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Of rows (place_id, pos) that have met all they can be like, those to keep; and rows that go. pairs: likeness so far."""
    live, gone = pairs, None
    while True:
        waiting = live.select("place_id", F.col("b").alias("pos")).distinct()
        kept = able.join(waiting, ["place_id", "pos"], "left_anti")
        kept = kept if gone is None else kept.join(gone, ["place_id", "pos"], "left_anti")
        more = cut(live.join(kept.withColumnRenamed("pos", "a"), ["place_id", "a"], "left_semi").select("place_id", F.col("b").alias("pos")).distinct())
        if more.isEmpty():
            return kept, gone
        gone = more if gone is None else gone.unionByName(more)
        for end in ("a", "b"):
            live = live.join(more.withColumnRenamed("pos", end), ["place_id", end], "left_anti")
        live = cut(live)


def greedy(reviews: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(place_id, pos) of the rows kept."""
    hashed = F.transform(word_set(F.col("text")), lambda w: F.xxhash64(w))  # long keys sort and join faster than words
    keyed = reviews.select("place_id", "pos", F.sort_array(hashed).alias("words"))
    key = F.when(F.size("words") == 0, F.array(F.col("pos").cast("long"))).otherwise(F.col("words"))
    sets = cut(keyed.groupBy("place_id", key.alias("key"), "words").agg(F.min("pos").alias("pos")).select("place_id", "pos", "words"))
    rows = ["place_id", "pos"]
    index, width, dropped = cut(_prefix(sets, threshold)), FIRST, []
    while not index.isEmpty():
        nth = F.row_number().over(Window.partitionBy("place_id", "word").orderBy("pos"))
        heads = cut(index.withColumn("nth", nth).where(F.col("nth") <= width).drop("nth"))
        met, all_met = heads.groupBy(*rows).agg(F.count(F.lit(1)).alias("m")), index.groupBy(*rows).agg(F.count(F.lit(1)).alias("all"))
        able = cut(met.join(all_met, rows).where("m = all").select(*rows))
        kept, gone = _settled(cut(_alike(heads, heads, sets, threshold)), able)
        kept = cut(kept)
        rest = index.join(kept if gone is None else kept.unionByName(gone), rows, "left_anti")
        alike = cut(_alike(index.join(kept, rows, "left_semi"), rest, sets, threshold).select("place_id", F.col("b").alias("pos")).distinct())
        dropped += [alike] if gone is None else [gone, alike]
        index, width = cut(rest.join(alike, rows, "left_anti")), width * GROWTH
    kept = sets.select(*rows)
    return kept.join(reduce(DataFrame.unionByName, dropped), rows, "left_anti") if dropped else kept


def clean(reviews: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The reviews kept, numbered anew."""
    from placewise.operators.reviews import renumbered

    return renumbered(reviews.join(greedy(reviews, threshold), ["place_id", "pos"], "left_semi"))
