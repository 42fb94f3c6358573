"""Parts of pictures cut out by boxes, and matched blocks scored by the pixels inside them.

Boxes and pixels meet by tiles of the picture: a box goes to each tile it touches, a pixel
to its own, so that the join has a key and a picture's pixels are never gathered.

Defined cases: a box is clipped to its picture; one without area inside it has no crop, and
its pair counts as not scored; pairs of a picture that is missing are not scored either;
overlapping boxes each get their pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.operators import blocks, tiles
from pagelens.sources.checkpoints import cut

TILE = 64


def pixel_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """left, top, right and bottom in whole pixels of a box in shares of its picture; null without area inside."""
    edge = lambda share, size: F.greatest(F.lit(0), F.least(size, F.rint(share * size))).cast("int")
    left, top = edge(x, width), edge(y, height)
    right, bottom = F.greatest(left, edge(x + w, width)), F.greatest(top, edge(y + h, height))
    return F.when((right > left) & (bottom > top), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))


def cut_out(pixels: DataFrame, boxes: DataFrame, image: list[str], keys: list[str], *, tile: int = TILE) -> DataFrame:
    """keys, x, y and the channels of the pixels in each box, x and y from the box's corner. boxes: image, keys, box (of pixel_box)."""
    channels = [*tiles.RGB, "a"] if "a" in pixels.columns else list(tiles.RGB)
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(f"box.{a}") / tile), F.floor((F.col(f"box.{b}") - 1) / tile)))
    dealt = boxes.where("box is not null").select(*dict.fromkeys([*image, *keys]), "box", span("left", "right").alias("__tx")).withColumn("__ty", span("top", "bottom"))
    own = pixels.select(*image, "x", "y", *channels, F.floor(F.col("x") / tile).alias("__tx"), F.floor(F.col("y") / tile).alias("__ty"))
    inside = (F.col("x") >= F.col("box.left")) & (F.col("x") < F.col("box.right")) & (F.col("y") >= F.col("box.top")) & (F.col("y") < F.col("box.bottom"))
    # Spark judges pixels by the table they were made from: the hint keeps them from being broadcast
    return own.join(dealt.hint("merge"), [*image, "__tx", "__ty"]).where(inside).select(*keys, (F.col("x") - F.col("box.left")).alias("x"), (F.col("y") - F.col("box.top")).alias("y"), *channels)


def pair_pixelmatch(pairs: DataFrame, reference: DataFrame, candidate: DataFrame, image: list[str], pair: str, *, threshold: float = 0.1, tile: int = TILE) -> DataFrame:
    """pairs with pixelmatch, the score of the candidate's crop in the size of the reference's; null where either has none.

    pairs: image, pair, and boxes rx ry rw rh and cx cy cw ch in shares of the page.
    """
    keys = [*image, pair]
    crops = []
    for side, pixels in (("r", reference), ("c", candidate)):
        sized = pairs.join(tiles.picture_sizes(pixels, image), image)
        boxes = sized.select(*keys, pixel_box(*(F.col(f"{side}{k}") for k in "xywh"), F.col("width"), F.col("height")).alias("box"))
        crops.append(cut(cut_out(pixels, boxes, image, keys, tile=tile)))
    scores = tiles.pixelmatch(*crops, keys, threshold=threshold).select(*keys, F.col("score").alias("pixelmatch"))
    return pairs.join(scores, keys, "left")


def block_scores(pairs: DataFrame, reference: DataFrame, candidate: DataFrame, image: list[str], pair: str, *, threshold: float = 0.1) -> DataFrame:
    """Per page: the pixel match of its matched blocks, weighted by the reference's area, and their geometry.

    pairs: as in pair_pixelmatch, with covered, the share of the area that was matched. Gives
    matched_pixelmatch, pixelmatch_score (times covered), pair_count, scored_pair_count,
    weighted_area, and iou, area, centre and geometry_score.
    """
    scored = pair_pixelmatch(pairs, reference, candidate, image, pair, threshold=threshold)
    area = F.greatest(F.lit(0.0), F.col("rw") * F.col("rh"))
    weight = F.coalesce(F.sum(F.when(F.col("pixelmatch").isNotNull(), area)), F.lit(0.0))
    match = F.when(weight > 0, F.sum(F.col("pixelmatch") * area) / weight).otherwise(0.0)
    pixels = scored.groupBy(*image).agg(match.alias("matched_pixelmatch"), F.count("*").alias("pair_count"), F.count("pixelmatch").alias("scored_pair_count"), weight.alias("weighted_area"))
    geometry = blocks.box_geometry(pairs, image).withColumnRenamed("score", "geometry_score")
    out = pixels.join(geometry, image)
    return out.withColumn("pixelmatch_score", F.col("matched_pixelmatch") * F.coalesce("covered", F.lit(1.0))).drop("covered")
