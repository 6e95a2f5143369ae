"""One query for each operator: (spark, sf_dir) to the columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.llm import html_text, line_dedup, mixing, neighbours, quality, repair, resampling, sentencepiece_codec, sharding, simhash, syncmers, token_counts, warc
from placewise.llm._common import let, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = docs.select("doc_id", quality.verdict(F.col("text")).alias("v"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *(F.col(f"v.m.{c}").alias(c) for c in counts), "v.base_failed", "v.kept", F.array_join("v.failed", ",").alias("failed_rules"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shuffle(table(spark, sf_dir, "documents"), 8)
    text, placed = F.coalesce(F.col("text"), F.lit("")), rows[rows.columns[-1]]
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))
    return rows.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), placed["shard"].alias("shard"), placed["slot"].alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def op4_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    n_bytes = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = sentencepiece_codec.Codec.load(public_tokenizers.path("piece_bpe_32k.model"))
    decoded = sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), codec)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return decoded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    mixed = mixing.copies(docs, keep_text=False)
    return mixed.select("doc_id", "source", "lang", "mix.topic", "mix.tokens", F.round("mix.rate", 6).alias("rate"), (F.col("mix.copies") > 0).alias("kept"), "mix.copies")


def op9_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = syncmers.with_next(table(spark, sf_dir, "documents"))
    n_chars = F.length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = pairs.withColumn("edited", F.concat(F.left("text", n_chars - half), F.left("next_text", half)))
    own = F.col("found")
    compared = let(syncmers.anchors(F.col("edited")), lambda e: F.struct(syncmers.fingerprint(e).alias("fp"), syncmers.likeness(own, e).alias("near")))
    return edited.withColumn("e", compared).select(
        "doc_id", n_chars.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), syncmers.fingerprint(own).alias("fingerprint"),
        F.col("e.fp").alias("edited_fingerprint"), F.col("e.near").alias("near_edited"), syncmers.likeness(own, F.col("next_found")).alias("near_next"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampling.resample(docs.select("doc_id", "text"), target).select("doc_id", "n_features", "weight", "score", "rank")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.report_all(rows, repair.damaged(rows))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op3_html_text": op3_html_text,
    "op4_token_counts": op4_token_counts,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_mixing": op8_mixing,
    "op9_syncmer_fingerprints": op9_syncmer_fingerprints,
    "op10_warc": op10_warc,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_conversation_repair": op13_conversation_repair,
}
