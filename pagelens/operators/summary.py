"""Summaries of whole runs: means of many metrics, status rows, cost, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.means import row_mean

# The name of each mean of a run's captures and animations, and the metric it is of.
CAPTURE_MEANS = {
    "mean_screenshot_size_match": "screenshot_size_match", "mean_pixelmatch": "pixelmatch", "mean_dreamsim_score": "dreamsim", "mean_vlm_overall": "vlm_judge",
    "mean_html_text_bleu_1": "bleu_1", "mean_html_text_rouge_1_recall": "rouge_1_recall", "mean_html_tree_f1": "html_tree", "mean_visual_block_score": "visual_block",
    "mean_bbox_geometry_score": "bbox_geometry", "mean_cssom_block_style_score": "cssom_block_style",
}
ANIMATION_MEANS = {"mean_animation_bbox_iou": "bbox_iou", "mean_animation_motion_delta": "motion_delta", "mean_animation_target_pixelmatch": "target_box_pixelmatch", "mean_animation_color_delta": "color_delta"}
# Groups of the final diagnostic score.
FINAL_WEIGHTS = {"screenshot": 0.35, "html": 0.15, "block": 0.30, "vlm": 0.20}
FINAL_GROUPS = {"screenshot": ("pixelmatch", "ssim", "clip", "dreamsim"), "html": ("text", "dom"), "block": ("visual_block", "element_block_pixelmatch", "bbox_geometry", "cssom_block_style"), "vlm": ("vlm",)}
# Capture ids with a suggested weight of their own.
SUGGESTED_WEIGHTS = {"home.desktop.work-dropdown": 0.25, "home.desktop.work-section": 0.50, "contact.desktop.email-focused": 0.50}
#: Rows of the report of the least stable judgements.
WORST = 12


def suggested_weight(capture_id: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in SUGGESTED_WEIGHTS.items() for x in pair))
    return F.coalesce(known[capture_id], F.lit(1.0))


def run_summary(captures: DataFrame, targets: DataFrame, animations: DataFrame, run: list[str]) -> DataFrame:
    """One row a run. captures: run, coverage and a column for each capture metric; targets: run and the animation metrics; animations: run, status."""
    mean = lambda name, metric: F.avg(metric).alias(name)
    of_captures = captures.groupBy(*run).agg(
        F.count("*").alias("capture_count"), F.count_if(F.col("coverage") > 0).alias("covered_capture_count"), F.count_if(F.col("coverage") <= 0).alias("missing_capture_count"),
        F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("manifest_coverage_score"), *(mean(*x) for x in CAPTURE_MEANS.items()),
    )
    of_targets = targets.groupBy(*run).agg(*(mean(*x) for x in ANIMATION_MEANS.items()))
    of_animations = animations.groupBy(*run).agg(F.count("*").alias("animation_count"), F.count_if(F.col("status") == "scored").alias("scored_animation_count"))
    rows = of_captures.join(of_animations, run, "left").join(of_targets, run, "left").fillna(0, ["animation_count", "scored_animation_count"])
    return rows.withColumn("mean_animation_cssom_color", F.col("mean_animation_color_delta"))


def status_line(summary: DataFrame, columns: list[str]) -> DataFrame:
    """Adds status: a run's summary as one line of JSON."""
    return summary.withColumn("status", F.to_json(F.struct(F.lit("functional").alias("status"), *sorted(columns)), {"ignoreNullFields": "false"}))


def final_summary(pairs: DataFrame, pages: DataFrame, expected: DataFrame, run: list[str]) -> DataFrame:
    """The diagnostic score of a run: coverage times the mean of four groups by weight, of those that have a score.

    pairs: run and the pair metrics; pages: run, bleu_1, rouge_1_recall, f1; expected: run, expected (captures that should be there).
    """
    metrics = [m for k, group in FINAL_GROUPS.items() if k != "html" for m in group]
    means = pairs.groupBy(*run).agg(F.count("*").alias("matched"), *(F.avg(m).alias(m) for m in metrics))
    html = pages.groupBy(*run).agg(F.avg(row_mean(F.col("bleu_1"), F.col("rouge_1_recall"))).alias("text"), F.avg("f1").alias("dom"))
    rows = expected.join(means, run, "left").join(html, run, "left").fillna(0, ["matched"])
    rows = rows.withColumns({f"{k}_group": row_mean(*(F.col(m) for m in group)) for k, group in FINAL_GROUPS.items()})
    weight = sum((F.when(F.col(f"{k}_group").isNotNull(), w).otherwise(0.0) for k, w in FINAL_WEIGHTS.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(f"{k}_group") * w, F.lit(0.0)) for k, w in FINAL_WEIGHTS.items()), F.lit(0.0))
    coverage = F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")).otherwise(0.0)
    rows = rows.withColumn("coverage", coverage).withColumn("score", F.when(weight > 0, total / weight).otherwise(0.0) * coverage)
    return rows.select(*run, "matched", "expected", "coverage", *(f"{k}_group" for k in FINAL_WEIGHTS), "score")


def target_means(targets: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Means of an animation's targets, of the numbers there."""
    return targets.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in metrics))


def costs(calls: DataFrame, by: str = "agent") -> DataFrame:
    """Calls and cost of each agent and, with null for the agent, of all."""
    return calls.rollup(by).agg(F.count("*").alias("calls"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))


def worst(rows: DataFrame, value: str, ties: list[str], most: int = WORST) -> DataFrame:
    """The rows of the report with the largest values; those without one come last."""
    return rows.orderBy(F.coalesce(value, F.lit(-1.0)).desc(), *ties).limit(most)


def metric_problems(metrics: DataFrame, keys: list[str], allow_unsupported: bool = False) -> DataFrame:
    """For each metric: captures that lack a number though they are covered and supported, and whether no capture has one.

    metrics: keys, capture_id, coverage, status, unsupported, value.
    """
    due = (F.coalesce("coverage", F.lit(0.0)) > 0) & (F.coalesce("status", F.lit("")) != "unsupported")
    if allow_unsupported:
        due = due & ~F.coalesce("unsupported", F.lit(False))
    rows = metrics.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(due & F.col("value").isNull(), F.col("capture_id")))).alias("missing"), F.count_if(due & F.col("value").isNotNull()).alias("present"))
    return rows.withColumn("problem", F.when(F.size("missing") > 0, "missing_values").when(F.col("present") == 0, "no_values"))


def timed(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seconds, ended): a stage's time from its start event to the next end or error event."""
    by = Window.partitionBy(*keys).orderBy("ts", "event_id")
    rows = events.withColumn("__next", F.lead("event").over(by)).withColumn("__at", F.lead("ts").over(by)).where("event = 'start'")
    took = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("__at")) / 1e6
    return rows.select(*keys, "event_id", F.when(F.col("__next").isin("end", "error"), took).alias("seconds"), F.when(F.col("__next").isin("end", "error"), F.col("__next")).alias("ended"))


def with_missing(wanted: DataFrame, artifacts: DataFrame, key: str, reason: str) -> DataFrame:
    """Every wanted row with its artifact, or with nulls and a reason."""
    there = artifacts.withColumn("__there", F.lit(True))
    return wanted.join(there, key, "left").withColumn("missing_reason", F.when(F.col("__there").isNull(), reason)).drop("__there")


def page_rows(pages: DataFrame, scores: list[str], errors: list[str]) -> DataFrame:
    """A compact row a page: rounded scores, and the names of the checks that failed."""
    failed = F.filter(F.array(*(F.when(F.coalesce(F.col(e), F.lit("")) != "", F.lit(e)) for e in errors)), lambda x: x.isNotNull())
    return pages.select("page", *(F.round(c, 3).alias(c) for c in scores), failed.alias("errors"))


def capture_set(reference: DataFrame, candidate: DataFrame, key: str, metrics: list[str], run: list[str]) -> DataFrame:
    """Pairs by file name, the names that the candidate lacks, and means over the pairs."""
    both = reference.select(*run, key).join(candidate.withColumn("__there", F.lit(True)), [*run, key], "left")
    return both.groupBy(*run).agg(F.count("__there").alias("pairs"), F.array_sort(F.collect_list(F.when(F.col("__there").isNull(), F.col(key)))).alias("missing"), *(F.avg(m).alias(m) for m in metrics))


def reward_markdown(rows: DataFrame, order: str) -> DataFrame:
    """A line of Markdown for each capture of a report, in order."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("n/a")), F.lit("|"), F.lit("\\|"))
    return rows.orderBy(order).select(order, F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in rows.columns)), F.lit(" |")).alias("line"))
