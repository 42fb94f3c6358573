"""Readers: closed and open JSON documents, site listings, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = """schemaVersion INT, site MAP<STRING,STRING>, outputDir STRING, cleanOutputDir BOOLEAN, defaults STRING,
captures ARRAY<STRUCT<id: STRING, weight: DOUBLE, page: STRING, state: STRING, intent: STRING, path: STRING,
  viewport: STRUCT<width: INT, height: INT>,
  actions: ARRAY<STRUCT<type: STRING, selector: STRING, value: STRING, key: STRING, ms: INT, settleMs: INT, state: STRING, timeoutMs: INT, x: INT, y: INT>>,
  screenshot: MAP<STRING,STRING>, enabled: BOOLEAN>>,
animations ARRAY<STRUCT<id: STRING, kind: STRING, weight: DOUBLE, page: STRING, path: STRING,
  viewport: STRUCT<width: INT, height: INT>, trigger: STRUCT<type: STRING, selector: STRING, settleBeforeMs: INT, settleMs: INT>,
  timeline: STRUCT<durationMs: INT, samplesMs: ARRAY<BIGINT>>,
  targets: ARRAY<STRUCT<name: STRING, selector: STRING, channels: ARRAY<STRING>, track: ARRAY<STRING>>>, enabled: BOOLEAN>>"""


def documents(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One row for each JSON file; a file that does not fit the schema stops the query."""
    return spark.read.schema(schema).options(multiLine=True, mode="FAILFAST").json(path).withColumn("source", F.col("_metadata.file_path"))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    return documents(spark, path, MANIFEST)


def captures(manifests: DataFrame) -> DataFrame:
    """One row for each capture with its place; only a literal false turns one off."""
    rows = manifests.select("source", F.posexplode("captures").alias("pos", "c")).select("source", "pos", "c.*")
    return rows.where(F.coalesce("enabled", F.lit(True)))


def animations(manifests: DataFrame) -> DataFrame:
    rows = manifests.select("source", F.posexplode("animations").alias("pos", "a")).select("source", "pos", "a.*")
    return rows.where(F.coalesce("enabled", F.lit(True)))


def site_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Paths and lengths of all files below a folder, contents unread."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True).load(path)
    return files.where(F.endswith("path", F.lit(suffix))).select("path", "length")


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and html of each page file."""
    return spark.read.options(wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def progress_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of append-only JSON lines."""
    return spark.read.schema("ts TIMESTAMP, event STRING, stage STRING, capture_id STRING, seconds DOUBLE, error STRING").json(path)


def json_number(payload: Column, path: str) -> Column:
    """A number at a dotted path of a JSON string; null if any object on the way is unsupported, skipped or in error."""
    steps = path.split(".")
    guards = ["$" + "".join(f".{s}" for s in steps[:i]) for i in range(len(steps))]
    bad = F.lit(False)
    for at in guards:
        for flag in ("unsupported", "skipped", "error"):
            value = F.get_json_object(payload, f"{at}.{flag}")
            bad = bad | F.coalesce(~value.isin("false", "", "0", "null"), F.lit(False))
    return F.when(~bad, F.get_json_object(payload, "$." + path).try_cast("double"))
