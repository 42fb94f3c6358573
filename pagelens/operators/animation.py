"""Pairs of animations: targets of both sides put together, scored by their channels, and brought to one reward.

frames: animation keys, side (reference or candidate), target, frame, name, channels, the
box x, y, w, h, style (a map of properties) and the border widths top, right, bottom, left.
crops: animation keys, side, target, frame and the pixels x, y, r, g, b (a) of the target's
box. Frames of both sides are put together by their place in time, as far as both go.

Defined cases: an animation without frames on one side is unsupported; a target that only
one side has keeps its row, without channels or scores; a frame without a box overlaps with
nothing and takes part in no movement; a crop that only one side has is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import paths, style
from pagelens.functions.geometry import colour_area
from pagelens.operators import tiles
from pagelens.operators.motion import MOVEMENT_FLOOR, motion_scores
from pagelens.operators.reward import animation_reward

SIDES = ("reference", "candidate")
MISSING = "animation_timeline_missing"
#: Columns of animation_reward by those of the targets.
MEANS = {"bbox_iou": "bbox_iou", "motion_delta": "motion_delta", "delta_pixelmatch": "target_box_delta_pixelmatch", "pixelmatch": "target_box_pixelmatch", "color_delta": "color_delta"}


def _numbered(frames: DataFrame, keys: list[str]) -> DataFrame:
    return frames.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "side", "target").orderBy("frame")))


def _zipped(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames at the same place of both sides as the structs r and c, with the targets' channels."""
    own = [c for c in frames.columns if c not in (*keys, "side", "target", "n")]
    side = lambda s, to: frames.where(F.col("side") == s).select(*keys, "target", "n", F.struct(*own).alias(to))
    return side(SIDES[0], "r").join(side(SIDES[1], "c"), [*keys, "target", "n"])


def _colour_scores(zipped: DataFrame, keys: list[str]) -> DataFrame:
    """color_delta of each target: colours by their change since the first frame, weighted by its size and the area painted; else the other properties' equality."""
    target = [*keys, "target"]
    based = zipped.withColumns({b: F.first(f"{s}.style").over(Window.partitionBy(*target).orderBy("n")) for b, s in (("r0", "r"), ("c0", "c"))})
    names = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    props = based.withColumn("prop", F.explode(F.array_union(names(F.col("r.style")), names(F.col("c.style")))))
    value = lambda at: paths.style_value(F.try_element_at(F.col(at), F.col("prop")))
    props = props.select(*target, "n", "r", "prop", *(value(at).alias(to) for at, to in (("r.style", "rv"), ("c.style", "cv"), ("r0", "rb"), ("c0", "cb"))))
    rgb = props.withColumns({f"{c}_rgb": style.parse_rgb(F.col(c)) for c in ("rv", "cv", "rb", "cb")})
    off = lambda a, b: F.zip_with(F.slice(a, 1, 3), F.slice(b, 1, 3), lambda x, y: x - y)
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    sized = rgb.withColumns({"dr": off("rv_rgb", "rb_rgb"), "dc": off("cv_rgb", "cb_rgb")}).withColumns({"size": norm(F.col("dr")), "error": norm(F.zip_with("dc", "dr", lambda x, y: x - y))})
    colour = paths.is_colour_property(F.col("prop"))
    moved = F.when((F.col("size") > MOVEMENT_FLOOR) & F.col("error").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("error") / F.col("size")))
    box, width = F.coalesce((F.col("r.w") > 0) & (F.col("r.h") > 0), F.lit(False)), lambda c: F.greatest(F.lit(0.0), F.coalesce(F.col(f"r.{c}"), F.lit(1.0)))
    area = F.when(box, colour_area(F.col("prop"), F.col("r.w"), F.col("r.h"), *map(width, ("top", "right", "bottom", "left")))).otherwise(1.0)
    scored = sized.select(*target, "n", F.when(colour, moved).otherwise((F.col("rv") == F.col("cv")).cast("double")).alias("s"), F.when(colour & moved.isNotNull(), F.col("size") * area).alias("wt"))
    by_frame = scored.groupBy(*target, "n").agg(F.avg("s").alias("mean"), F.sum(F.col("s") * F.col("wt")).alias("total"), F.sum("wt").alias("wt"))
    return by_frame.groupBy(*target).agg(F.when(F.sum("wt") > 0, F.sum("total") / F.sum("wt")).otherwise(F.avg("mean")).alias("color_delta"))


def crop_scores(crops: DataFrame, keys: list[str]) -> DataFrame:
    """Per target: target_box_pixelmatch, the mean pixel match of its crops, and target_box_delta_pixelmatch, how well their changes since the first crop agree.

    crops: with n, the frame's place. Changes are compared in the size of the reference's first crop.
    """
    target = [*keys, "target"]
    image = [*target, "n"]
    opaque = crops if "a" in crops.columns else crops.withColumn("a", F.lit(255))
    pixels = {s: opaque.where(F.col("side") == s).select(*image, "x", "y", *tiles.RGB, "a") for s in SIDES}
    match = tiles.pixelmatch(pixels[SIDES[0]], pixels[SIDES[1]], image).groupBy(*target).agg(F.avg("score").alias("target_box_pixelmatch"))
    size = tiles.picture_sizes(pixels[SIDES[0]].where("n = 1"), target)
    change = {}
    for s, p in pixels.items():
        even = tiles.resize(p, image, p.select(*image).distinct().join(size, target), "bicubic")
        first = even.where("n = 1").select(*target, "x", "y", *(F.col(c).alias(f"{c}0") for c in tiles.RGB))
        change[s] = even.join(first, [*target, "x", "y"]).select(*image, "x", "y", *(F.abs(F.col(c) - F.col(f"{c}0")).alias(f"{s}_{c}") for c in tiles.RGB))
    total = lambda f: F.sum(reduce(lambda a, b: a + b, [f(c) for c in tiles.RGB]))
    r, c = SIDES
    sums = change[r].join(change[c], [*image, "x", "y"]).groupBy(*image).agg(total(lambda k: F.col(f"{r}_{k}")).alias("size"), total(lambda k: F.abs(F.col(f"{r}_{k}") - F.col(f"{c}_{k}"))).alias("error"))
    delta = sums.where(F.col("size") > MOVEMENT_FLOOR).groupBy(*target).agg(F.avg(F.greatest(F.lit(0.0), 1 - F.col("error") / F.col("size"))).alias("target_box_delta_pixelmatch"))
    return match.join(delta, target, "left")


def animation_targets(frames: DataFrame, keys: list[str], *, crops: DataFrame | None = None) -> DataFrame:
    """Per target of either side: name, channels (those of both sides' first frames) and the scores of its channels."""
    target = [*keys, "target"]
    numbered = _numbered(frames, keys)
    first = numbered.where("n = 1")
    of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    both = F.count_distinct("side") == 2
    channels = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("channels", F.array().cast("array<string>"))))))
    rows = first.groupBy(*target).agg(of(SIDES[0], "name").alias("name"), F.when(both, channels).otherwise(F.array().cast("array<string>")).alias("channels"))
    zipped = _zipped(numbered, keys)
    used = lambda channel: rows.where(F.array_contains("channels", channel)).select(*target)
    boxes = zipped.join(used("motion"), target).select(*target, "n", *(F.col(f"{s}.{c}").cast("double").alias(f"{s}{c}") for s in "rc" for c in "xywh"))
    out = rows.join(motion_scores(boxes, target, ["n"]).select(*target, "bbox_iou", "motion_delta"), target, "left")
    out = out.join(_colour_scores(zipped.join(used("color"), target), keys), target, "left")
    if crops is not None:
        # only frames that have their place on both sides, as far as the shorter timeline goes
        placed = zipped.select(*target, "n")
        numbers = numbered.select(*keys, "side", "target", "frame", "n").join(placed, [*target, "n"]).join(used("color"), target)
        return out.join(crop_scores(crops.join(numbers, [*keys, "side", "target", "frame"]), keys), target, "left")
    return out.withColumns({c: F.lit(None).cast("double") for c in ("target_box_pixelmatch", "target_box_delta_pixelmatch")})


def animation_pairs(frames: DataFrame, keys: list[str], *, crops: DataFrame | None = None) -> DataFrame:
    """Per animation: status, reason, the means of its targets' scores, and from them bbox, pixel, cssom, coverage and score."""
    sides = frames.groupBy(*keys).agg((F.count_distinct("side") == 2).alias("both"))
    means = animation_targets(frames, keys, crops=crops).groupBy(*keys).agg(*(F.avg(c).alias(to) for to, c in MEANS.items()))
    rows = sides.join(means, keys, "left").withColumns({c: F.when(F.col("both"), F.col(c)) for c in MEANS} | {"cssom_color": F.lit(None).cast("double")})
    rows = animation_reward(rows)
    any_part: Column = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in ("bbox", "pixel", "cssom")])
    more = {"status": F.when(F.col("both"), "scored").otherwise("unsupported"), "reason": F.when(~F.col("both"), MISSING), "coverage": (F.col("both") & any_part).cast("double")}
    return rows.withColumns(more).select(*keys, "status", "reason", *MEANS, "bbox", "pixel", "cssom", "coverage", "score")
