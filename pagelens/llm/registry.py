"""Driver queries of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.sql import JACCARD, QUALITY, RESAMPLING, SPELLING

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.quality_rules import quality_rules

    return quality_rules(_read(spark, sf_dir, "documents"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.jaccard_join import jaccard_groups

    return jaccard_groups(_read(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pagelens.llm.sentencepiece_bpe import encode

    return encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False, with_digest=True)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.lm_scoring import score_documents

    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", (remainder != 1).alias("train"))
    return score_documents(docs, train_col="train").select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.toxicity import fit, score

    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(docs, labels.where(remainder != 2))
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (remainder == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.embedding_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.language_id import fit, predict

    docs = _read(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    model = fit(docs.where(remainder != 1))
    return predict(docs, model, keep=["doc_id"]).select("doc_id", (remainder == 1).alias("held_out"), "lang_pred", "score", "languages")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.sharding import shard

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    return shard(_read(spark, sf_dir, "documents"), 24).select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.substring_dedup import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"), digest_only=True)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.spelling_variants import counted_words, letter_dropped, letter_runs, spelling_forms

    runs = letter_runs(_read(spark, sf_dir, "documents"), min_length=7)
    return spelling_forms(counted_words(runs, letter_dropped(F.col("id"), F.col("run"))))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pagelens.llm.byte_bpe import encode

    return encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False, with_digest=True)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.importance_resampling import resample

    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


OPERATORS: tuple[Query, ...] = (op1_jaccard_join, op2_sentencepiece, op3_lm_scoring, op4_toxicity, op5_quality_rules, op6_embedding_dedup, op7_language_id, op8_sharding, op9_packing, op10_suffix_dedup, op11_spelling_variants, op12_byte_bpe, op13_importance_resampling)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    """The others have no SQL form: tokenizers, models, hashing with tests against brute force."""
    return {"op1_jaccard_join": JACCARD, "op5_quality_rules": QUALITY, "op11_spelling_variants": SPELLING, "op13_importance_resampling": RESAMPLING}
