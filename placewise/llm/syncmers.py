"""Document fingerprints of closed syncmers, in built-in functions only.

A text is a sequence of tokens: words, with words longer than TOKEN_CHARS cut into pieces of that length. A k-mer of
K tokens is a closed syncmer if the least hash of its inner S-mers is that of its first or its last S-mer. Whether a
k-mer is chosen depends on its own tokens alone, so equal passages have equal anchors wherever they stand, and an
edit changes only anchors that it touches. About two of K - S + 1 k-mers are chosen.

The fingerprint is the sequence of chosen hashes in text order; the likeness of two is the number of distinct
anchors they share over the number in either. `shared_passages` matches anchors by position.

Defined results: a null or word-less text has no anchors, and two texts without any are alike (1.0); a text of fewer
than K tokens, or without any closed syncmer, has its whole sequence as its only anchor; texts of any length count whole;
repeated rows have equal fingerprints. The next document is the next lower doc_id (nulls after all others), of equal ids
the one with the next lower (hash of) text; after the last comes the first, so a single document is its own next; an
empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.llm._common import WHITE, let

K = 8
S = 2
TOKEN_CHARS = 24
#: Rows of a bucket of neighbouring ids at which the pairing aims, and the most buckets that it makes.
BUCKET_ROWS = 2_000
MAX_BUCKETS = 50_000


def anchors(text: Column) -> Column:
    """The hashes of a text's closed syncmers, in text order: array<long>."""

    def inner(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - (S - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, S))))

    def chosen(h: Column) -> Column:
        def closed(g: Column) -> Column:
            def at(x: Column, i: Column) -> Column:
                last = F.get(g, i + (K - S))
                rest = [F.get(g, i + j) for j in range(1, K - S)]
                edge = F.least(x, last) <= F.least(*rest)
                return F.when(edge, F.xxhash64(x, *(rest[j - 1] for j in range(S, K - S, S)), last))

            return F.array_compact(F.transform(F.slice(g, 1, F.size(g) - (K - S)), at))

        return let(inner(h), closed)

    def of(h: Column) -> Column:
        whole = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))
        return let(F.when(F.size(h) < K, whole).otherwise(chosen(h)), lambda a: F.when(F.size(a) > 0, a).otherwise(whole))

    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^{WHITE}]{{1,{TOKEN_CHARS}}}"), F.lit(0))
    return let(F.transform(tokens, lambda w: F.xxhash64(w)), of)


def fingerprint(found: Column) -> Column:
    """Anchors as a string: the low 32 bits of each, eight hexadecimal digits, in text order."""
    return F.lower(F.array_join(F.transform(found, lambda a: F.substring(F.lpad(F.hex(a), 16, "0"), 9, 8)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Shared distinct anchors over all distinct anchors of two arrays; 1.0 if neither has any."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return let(F.size(F.array_union(a, b)), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(F.try_divide(shared, n.cast("double"))))


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text, found, next_text, next_found): each document, its anchors, and those of the next one.

    Ids are cut into buckets at approximate quantiles, so each bucket is one task's sort and rows move once. A bucket's
    highest document goes to the bucket above as well, where it follows the lowest; that of the top bucket goes
    to the bottom one. The driver holds the quantiles: MAX_BUCKETS numbers at most.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = min(MAX_BUCKETS, 1 + docs.count() // bucket_rows)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    ids = docs.select("doc_id", _bucket(F.col("doc_id"), cuts).alias("own"))
    tops = ids.groupBy("own").agg(F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("top"))
    ring = Window.orderBy("own")  # one row a bucket
    above = tops.select("own", "top", F.coalesce(F.lead("own").over(ring), F.min("own").over(Window.partitionBy())).alias("above"))

    placed = docs.withColumn("own", _bucket(F.col("doc_id"), cuts)).join(F.broadcast(above), "own")
    here = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("guest"))
    there = F.struct(F.col("above").alias("bucket"), F.lit(True).alias("guest"))
    at = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(here, there)).otherwise(F.array(here))
    spread = placed.select("doc_id", "text", F.explode(at).alias("at")).select("doc_id", "text", "at.bucket", "at.guest")
    found = spread.repartition(max(1, len(cuts) + 1), "bucket").withColumn("found", anchors(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), F.xxhash64("text").desc())
    after = F.lead(F.struct("text", "found")).over(order)
    return found.withColumn("after", after).where(~F.col("guest")).select("doc_id", "text", "found", F.col("after.text").alias("next_text"), F.col("after.found").alias("next_found"))


def _bucket(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts lie below the id; 0 for null ids. Looks through about the square root of their number, twice."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    runs = F.lit([cuts[i : i + step] for i in range(0, len(cuts), step)])
    below = lambda run: F.size(F.filter(run, lambda c: c < doc_id))
    full = F.size(F.filter(runs, lambda run: F.array_max(run) < doc_id))
    found = let(full, lambda i: i * step + F.coalesce(below(F.get(runs, i)), F.lit(0)))
    return F.when(doc_id.isNull(), F.lit(0)).otherwise(F.least(found, F.lit(len(cuts))))


def shared_passages(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, shift, n_anchors): how many anchors of documents a and b match at the distance shift, counted in anchors.

    left and right: doc_id, found. Anchors that both have more than once match in each way they can, so right should be a
    stated, bounded set of documents.
    """
    placed = lambda df, name: df.select(F.col("doc_id").alias(name), F.posexplode("found").alias(f"{name}_at", "anchor"))
    met = placed(left, "a").join(placed(right, "b"), "anchor").where("a <> b")
    return met.groupBy("a", "b", (F.col("b_at") - F.col("a_at")).alias("shift")).agg(F.count("*").alias("n_anchors"))
