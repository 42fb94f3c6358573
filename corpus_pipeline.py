"""A corpus pipeline of five operators: from raw documents to packed training sequences.

Each stage reads all that its predecessor kept, as Parquet, and its decisions take effect.

Defined cases, of every stage
  null or empty text  too short: goes in the first stage
  null id             stays where its text does; linked with nothing, never learned from
  null label          not learned from; no labels at all: nothing is toxic
  repeated rows       decided alike; of rows with equal id and text one stays from the third stage on
  ties                of a group of near copies the smallest id stays
  empty table         an empty result with the columns of the stage
  other columns       carried along, whatever their names; n_chars follows the text where it is there
  long texts          whole
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import jaccard_join, packing, quality_rules, substring_dedup, toxicity
from pagelens.llm.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document with at least this probability of being toxic goes.
TOXIC = 0.3
#: Bytes of a passage that goes where it repeats: fifty-one words of the language with the shortest ones.
PASSAGE = 240


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filter_quality(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. Learns from the labels of the documents still there, but for a quarter held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    to = max(docs.columns, key=len) + "_toxic"  # no column's name
    return toxicity.score(docs, toxicity.fit(docs, labels), to=to).where(F.col(to) < TOXIC).drop(to)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.one_per_group(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur twice are cut out of the texts; n_chars follows."""
    out = substring_dedup.remove_repeats(docs, length=PASSAGE)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("packing", packing_stage),
]

#: Embedding a classifier and a tokenizer, the stages have no SQL form; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the pieces of the last."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
