"""The queries ``opN_<name>``: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe_codec, divergence, language_id, lexical, license_scan, mixing, near_dedup, ogg_media, quality_lm, sharding, token_counts, toxicity
from .common import Stages, fold, table
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_documents(table(spark, sf_dir, "documents"), Stages(spark))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs, drop=True).select("doc_id", "n_licenses", "license", "coverage", "first_word", "last_word", "found")


def op3_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality_lm.classify(docs.select("doc_id", "lang", "text"), labels.filter("quality = 1").select("doc_id"), Stages(spark))
    return out.select("doc_id", "n_bytes", "perplexity", "threshold", "kept")


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = ogg_media.read_media(ogg_media.store(docs, drop=True), drop=True)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "damaged_pages", "lost_pages", "index_faults")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score_texts(docs.select("doc_id", "text"), net, drop=True)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_file("word_bpe_49k.json"), drop=True).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(language_id.training_rows(docs))
    out = language_id.identify(docs.select("doc_id", "text"), model, drop=True)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_codec.encode_digest(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern(), drop=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), Stages(spark), lambda vec_id: vec_id % 20 == 0)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents").select("doc_id", "text"), Stages(spark), percent=85)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard_documents(docs, Stages(spark), drop=True)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_words")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark)
    index = lexical.build(table(spark, sf_dir, "documents"), stages)
    return lexical.search(index, table(spark, sf_dir, "benchmark"), stages)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), Stages(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix_sources, op2_license_scan, op3_quality_lm, op4_ogg_media, op5_toxicity, op6_token_counts, op7_language_id, op8_bpe_codec, op9_nearest, op10_near_dedup, op11_sharding, op12_ranked_search, op13_source_divergence)}
