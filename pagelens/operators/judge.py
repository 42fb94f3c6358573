"""Judge answers: parsing of scores and their variability over repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ten judged dimensions, and their four groups by place.
DIMENSIONS = (
    "layout_consistency", "element_alignment", "proportional_accuracy", "visual_harmony", "color_scheme_aesthetic_match", "aesthetic_resemblance",
    "font_characteristics_consistency", "textual_content_match", "numeric_special_character_accuracy", "user_interface_consistency",
)
GROUPS = {"visual": (0, 1, 2, 3), "content": (4, 5), "layout": (6, 7), "overall": (8, 9)}


def json_object(text: Column) -> Column:
    """The text from its first brace to its last, or null."""
    start, end = F.locate("{", text), F.length(text) - F.locate("}", F.reverse(text)) + 1
    return F.when((start > 0) & (end > start) & F.contains(text, F.lit("}")), F.substring(text, start, end - start + 1))


def ten_scores(text: Column) -> Column:
    """Exactly ten numbers of an answer, each within 0 and 10, or null."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(10.0), x.cast("double"))))
    return F.when(F.size(found) == 10, found)


def answer_scores(text: Column, payload: Column) -> Column:
    """Exactly ten numbers of a judge's answer, each within 0 and 10, or null.

    payload, the answer's JSON, may be a list, an object with a list of scores, with an object of
    dimensions, or with the dimensions themselves. Without any of these the numbers in the text count.
    A list of another length, or with what is no number, gives null.
    """
    v = F.try_parse_json(payload)
    there = lambda path: F.try_variant_get(v, path, "variant").isNotNull()
    given = lambda path: there(path) & ~F.is_variant_null(F.try_variant_get(v, path, "variant"))
    of = lambda path: F.array(*(F.try_variant_get(v, f"{path}.{name}", "double") for name in DIMENSIONS))
    numbers = lambda path: F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: F.try_variant_get(x, "$", "double"))
    has_scores = there("$.scores")
    dimensions = F.startswith(F.schema_of_variant(F.try_variant_get(v, "$.dimensions", "variant")), F.lit("OBJECT"))
    all_named = reduce(lambda x, y: x & y, [there(f"$.{name}") for name in DIMENSIONS])
    is_list = F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))
    found = F.when(is_list, numbers("$")).when(given("$.scores"), numbers("$.scores")).when(~has_scores & dimensions, of("$.dimensions")).when(~has_scores & all_named, of("$"))
    shaped = F.coalesce(is_list | given("$.scores") | (~has_scores & (dimensions | all_named)), F.lit(False))
    whole = (F.size(found) == len(DIMENSIONS)) & ~F.exists(found, lambda x: x.isNull() | F.isnan(x))
    return F.when(~shaped, ten_scores(text)).when(whole, F.transform(found, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(10.0), x))))


def group_scores(scores: Column, groups: dict[str, tuple[int, ...]] = GROUPS) -> dict[str, Column]:
    """Mean of each group over 10, and their mean."""
    out = {name: sum((scores[i] for i in places), F.lit(0.0)) / len(places) / 10 for name, places in groups.items()}
    return out | {"overall_mean": sum(out.values(), F.lit(0.0)) / len(out)}


def variability(runs: DataFrame, keys: list[str], repeat: str, score: str) -> DataFrame:
    """Per key: mean, population deviation and range of the repeats' means, and runs without a score."""
    repeats = runs.groupBy(*keys, repeat).agg(F.avg(score).alias("m"), F.count_if(F.col(score).isNull()).alias("errors"))
    return repeats.groupBy(*keys).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.min("m").alias("min"), F.max("m").alias("max"), F.count("*").alias("repeats"), F.sum("errors").alias("errors"))


def stage_profile(events: DataFrame, stage: str, seconds: str) -> DataFrame:
    """Per stage: runs, total, mean, errors."""
    return events.groupBy(stage).agg(F.count("*").alias("runs"), F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"), F.count_if(F.col(seconds).isNull()).alias("errors"))
