"""Motion and colour over the frames of an animation, as windows over its timeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.geometry import Box, iou

MOVEMENT_FLOOR = 1.0


def motion_scores(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per target: bbox_iou, motion_delta and movement_weight.

    frames: keys, order and boxes rx ry rw rh of the reference and cx cy cw ch of the
    candidate. An interval scores 1 less the error of the candidate's movement relative to
    the reference's, weighted by that; still intervals have no weight. A frame without a box
    overlaps with nothing, and the intervals beside it are left out.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    r, c = Box.of("r"), Box.of("c")
    step = {f"d{s}{axis}": centre - F.lag(centre).over(w) for s, box in (("r", r), ("c", c)) for axis, centre in zip("xy", box.centre, strict=True)}
    boxed = reduce(lambda a, b: a & b, [F.col(s + k).isNotNull() for s in "rc" for k in "xywh"])
    moved = frames.withColumns({"iou": F.when(boxed, iou(r, c)).otherwise(0.0), **step})
    ref, cand = F.hypot("drx", "dry"), F.hypot("dcx", "dcy")
    error = F.hypot(F.col("dcx") - F.col("drx"), F.col("dcy") - F.col("dry"))
    still, both = ref <= MOVEMENT_FLOOR, (ref <= MOVEMENT_FLOOR) & (cand <= MOVEMENT_FLOOR)
    scored = moved.withColumns({"s": F.when(both, 1.0).when(still, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - error / ref)), "wt": F.when(ref.isNull() | cand.isNull(), None).when(both, 0.0).when(still, cand).otherwise(ref)})
    total = F.coalesce(F.sum("wt"), F.lit(0.0))
    return scored.groupBy(*keys).agg(F.avg("iou").alias("bbox_iou"), F.when(total > 0, F.sum(F.col("s") * F.col("wt")) / total).otherwise(1.0).alias("motion_delta"), total.alias("movement_weight"), F.count("*").alias("frames"))


def colour_delta(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per target: color_delta, the colour change since the first frame against the reference's.

    frames: keys, order, ref and cand (arrays of red, green, blue) and area. Weighted by the
    size of the reference's change and the area; null when the reference never changes.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    based = frames.withColumns({"ref0": F.first("ref").over(w), "cand0": F.first("cand").over(w)})
    delta = based.withColumns({"dr": F.zip_with("ref", "ref0", lambda a, b: a - b), "dc": F.zip_with("cand", "cand0", lambda a, b: a - b)})
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    sized = delta.withColumns({"size": norm(F.col("dr")), "error": norm(F.zip_with("dc", "dr", lambda a, b: a - b))}).where(F.col("size") > MOVEMENT_FLOOR)
    weight = F.col("size") * F.col("area")
    return sized.groupBy(*keys).agg((F.sum(F.greatest(F.lit(0.0), 1 - F.col("error") / F.col("size")) * weight) / F.sum(weight)).alias("color_delta"), F.count("*").alias("changed_frames"))
