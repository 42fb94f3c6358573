"""Visual blocks: merging by box, and the scores of matched blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.geometry import Box, area_similarity, centre_similarity, iou
from pagelens.functions.style import numeric_similarity


def merge_by_box(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of one box become one: texts joined in order, colours averaged pairwise in that order.

    blocks: keys, pos, text, x y w h and colour (three numbers). The running mean of pairs depends on the order and is kept.
    """
    group = blocks.groupBy(*keys, "x", "y", "w", "h").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "colour"))).alias("b"))
    first = F.element_at("b", 1)["colour"]
    mean = F.aggregate(F.slice("b", F.lit(2), F.greatest(F.size("b") - 1, F.lit(0))), first, lambda s, x: F.zip_with(s, x["colour"], lambda a, b: (a + b) / 2))
    return group.select(*keys, F.element_at("b", 1)["pos"].alias("pos"), F.array_join(F.transform("b", lambda x: x["text"]), " ").alias("text"), "x", "y", "w", "h", mean.alias("colour"))


def _weighted(value: Column, weight: Column) -> Column:
    return F.when(F.sum(weight) > 0, F.sum(value * weight) / F.sum(weight)).otherwise(0.0)


def box_geometry(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: overlap, area and centre similarity of matched blocks, weighted by the reference's area, and their mean.

    pairs: keys, boxes r* and c*, and covered, the share of the area that was matched.
    """
    r, c = Box.of("r"), Box.of("c")
    out = pairs.groupBy(*keys).agg(*[_weighted(f(r, c), r.area).alias(n) for n, f in (("iou", iou), ("area", area_similarity), ("centre", centre_similarity))], F.max("covered").alias("covered"))
    return out.withColumn("score", (F.col("iou") + F.col("area") + F.col("centre")) / 3 * F.coalesce("covered", F.lit(1.0)))


def block_score(matched: Column, text: Column, position: Column, colour: Column, clip: Column | None = None) -> Column:
    """Fifths of size, text, position, colour and image similarity; quarters without the last."""
    parts = [matched, text, position, colour, *([] if clip is None else [clip])]
    return sum(parts[1:], parts[0]) / len(parts)


def style_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per pair the mean similarity of the numeric style properties that both sides have.

    pairs: keys, ref and cand, maps of property to number.
    """
    props = pairs.select(*keys, "ref", "cand", F.explode(F.array_union(F.map_keys("ref"), F.map_keys("cand"))).alias("prop"))
    a, b = F.try_element_at("ref", F.col("prop")), F.try_element_at("cand", F.col("prop"))
    return props.groupBy(*keys).agg(F.avg(numeric_similarity(a, b)).alias("score"), F.count(numeric_similarity(a, b)).alias("properties"))
