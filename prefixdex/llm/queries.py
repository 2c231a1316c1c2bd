"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixdex.llm import (
    bpe, exact_dedup, jaccard_join, langid, lexical, line_dedup, lm, mixing, packing, quality, resample, secret_scan,
    substring_dedup, tables,
)
from prefixdex.plans.session import ensure_checkpoint_dir


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup(_documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_documents(spark, sf_dir))


def tokenizer() -> tuple[str, str]:
    """Rank file and pattern of the byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), *tokenizer()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.dedup(_documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir).select("doc_id", "source"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_documents(spark, sf_dir))
    digest = F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256")
    return found.select("doc_id", "source", "start", F.col("length").cast("int").alias("length"), digest, "score", "is_secret")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.classes(_documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def learned_languages(docs: DataFrame) -> langid.Model:
    """The model of the labelled documents that are not held out."""
    return langid.fit(langid.count(docs.where(tables.doc_hash() % 3 != 1)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = langid.predict(docs, learned_languages(docs))
    return found.select("doc_id", (tables.doc_hash() % 3 == 1).alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.score(_documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut = packing.pieces(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), ids=False)
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(_documents(spark, sf_dir), _benchmark(spark, sf_dir))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_documents(spark, sf_dir), _benchmark(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_jaccard_join, op3_byte_bpe, op4_lm_scoring, op5_substring_dedup,
        op6_source_mixing, op7_secret_scan, op8_exact_dedup, op9_language_id, op10_quality_rules,
        op11_best_fit_packing, op12_importance_resampling, op13_lexical_search,
    )
}
