"""The main plan: captures of two sites to metrics and a weighted summary, as one lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.operators.coverage import coverage
from pagelens.operators.reward import animation_reward, capture_reward, capture_weight, component_html, reward_summary

#: Metric names of the long table and the components they give.
COMPONENTS = ("size", "vlm", "pixel", "block", "bbox", "cssom", "dreamsim", "bleu_1", "rouge_1", "tree_bleu", "f1")


def wide_components(metrics: DataFrame, key: str) -> DataFrame:
    """One row for each capture from (key, name, value, status); a metric that is not ok is not available."""
    value = F.when(F.coalesce(F.col("status"), F.lit("ok")) == "ok", F.col("value"))
    wide = metrics.withColumn("value", value).groupBy(key).pivot("name", list(COMPONENTS)).agg(F.max("value"))
    return wide.withColumn("html", component_html(F.col("bleu_1"), F.col("rouge_1"), F.col("tree_bleu"), F.col("f1"))).drop("bleu_1", "rouge_1", "tree_bleu", "f1")


def evaluate(captures: DataFrame, routes: DataFrame, actions: DataFrame, metrics: DataFrame, *, key: str = "capture_id", mode: str = "manifest") -> DataFrame:
    """Per capture: coverage, components, gate and score."""
    covered = coverage(routes, actions, key).select(key, "coverage")
    rows = captures.join(covered, key, "left").join(wide_components(metrics, key), key, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    rows = rows.withColumn("weight", capture_weight(mode, F.col("weight"), F.lit(None).cast("double")))
    # what is not covered has no metrics
    for c in ("size", "html", "vlm", "pixel", "block", "bbox", "cssom", "dreamsim"):
        rows = rows.withColumn(c, F.when(F.col("coverage") > 0, F.col(c)))
    return capture_reward(rows)


def summarize(captures: DataFrame, animations: DataFrame | None, by: list[str]) -> DataFrame:
    """Both weighted means over captures and animations together."""
    rows = captures.select(*by, "score", "weight", "gate_passed")
    if animations is not None:
        rows = rows.unionByName(animation_reward(animations).select(*by, "score", "weight", F.lit(True).alias("gate_passed")))
    return reward_summary(rows, by)
