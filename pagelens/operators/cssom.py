"""Styles of matched elements: properties in groups, pairs, and pages.

styles: keys, pair, property, reference and candidate (values as text, null where a side has
none), a row for each property. pairs: keys, pair, the boxes rx ry rw rh and cx cy cw ch in
units of the page, weight (the reference block's area), resolved (whether both sides have an
element).

Defined cases
  null or unlike values   a property without a similarity does not count
  no properties           only the boxes count
  unknown properties      belong to no group and do not count
  repeated rows           count again
  no pairs                no row
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions.geometry import Box, box_similarity
from pagelens.functions.style import property_similarity

_SIDES = ("top", "right", "bottom", "left")
# The properties of each group.
STYLE_GROUPS = {
    "typography": ("font-family", "font-size", "font-weight", "line-height", "letter-spacing", "text-align", "text-transform"),
    "color": ("color", "background-color", *(f"border-{s}-color" for s in _SIDES)),
    "spacing": (*(f"padding-{s}" for s in _SIDES), *(f"margin-{s}" for s in _SIDES), "row-gap", "column-gap"),
    "shape": (*(f"border-{s}-width" for s in _SIDES), *(f"border-{a}-{b}-radius" for a in ("top", "bottom") for b in ("left", "right")), *(f"border-{s}-style" for s in _SIDES)),
    "effects": ("opacity", "box-shadow", "filter", "transform"),
}
GROUPS = (*STYLE_GROUPS, "layout")


def pair_scores(pairs: DataFrame, styles: DataFrame, keys: list[str]) -> DataFrame:
    """pairs with a score for each group, null without a comparable property, and their mean as score. Unresolved pairs have none."""
    by_name = {p: g for g, names in STYLE_GROUPS.items() for p in names}
    group = F.create_map(*(F.lit(x) for item in by_name.items() for x in item))[F.col("property")]
    known = styles.withColumn("__group", group).where("__group is not null")
    likeness = known.select(*keys, "pair", "__group", property_similarity(F.col("property"), F.col("reference"), F.col("candidate")).alias("__s"))
    grouped = likeness.groupBy(*keys, "pair").agg(*(F.avg(F.when(F.col("__group") == g, F.col("__s"))).alias(g) for g in STYLE_GROUPS))
    out = pairs.join(grouped, [*keys, "pair"], "left").withColumn("layout", box_similarity(Box.of("r"), Box.of("c")))
    out = out.withColumns({g: F.when(F.col("resolved"), F.col(g)) for g in GROUPS})
    there = F.filter(F.array(*GROUPS), lambda x: x.isNotNull())
    return out.withColumn("score", F.when(F.col("resolved"), F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there)))


def page_scores(scored: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Per page: means weighted by area over resolved pairs, the share of the area that was resolved, and the score adjusted by both.

    scored: from pair_scores; pages: keys, coverage and block_score of the visual blocks. A page
    with all of it perfect up to six digits has the score 1, whatever was not resolved.
    """
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    mean = lambda c: F.coalesce(F.sum(F.col(c) * weight) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), weight)), F.lit(0.0)), F.lit(0.0))
    resolved = F.sum(F.when(F.col("resolved"), weight).otherwise(0.0))
    rows = scored.groupBy(*keys).agg(
        mean("score").alias("matched_score"), F.coalesce(resolved / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(0.0)).alias("resolution_score"), *(mean(g).alias(g) for g in GROUPS),
        F.count("*").alias("pair_count"), F.count_if("resolved").alias("resolved_pair_count"), resolved.alias("weighted_area"),
    )
    one = lambda c: F.round(c, 6) == 1.0
    perfect = one("matched_score") & one("coverage") & one("block_score")
    score = F.when(F.coalesce(perfect, F.lit(False)), 1.0).otherwise(F.col("matched_score") * F.col("resolution_score") * F.col("coverage"))
    return rows.join(pages.select(*keys, "coverage", "block_score"), keys).withColumn("score", score).drop("block_score")
